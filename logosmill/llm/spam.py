"""Keyword-stuffed pages, link lists and product or tag pages.

A page is cut into units: lines, and the sentences of a line.  Bagged decision trees say
of each unit whether it belongs to a list of keywords, links, products or tags, by
content and link features of that unit.  They learn from weak labels of whole pages: the
words, links and prices of a page leave no doubt about some pages, and all units of such
a page take its label.  The trees see none of what the labels were made from, only how
each unit is written, so they also tell apart the parts of mixed pages.

How often pages of a host (column ``source``) are spam is the prior of its units: it
moves the odds of every unit of the host, which turns units that the trees are not sure
of.  A page is spam if more than half of its characters are in such units.

Features are counted in Arrow batches: some pages become one array of characters and one of
words, and everything else is arithmetic on these arrays, so no work is done word by
word.  (The same features as column expressions took three times the CPU time.)  The
units of a page stay in one row; only sums by page are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small, cut

# Words that hold sentences together and are no part of keyword phrases.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was on with be by as this are at from if since although not every had were what where who which "
    "would or an its than more their has have how when few against even once so about only yet then no nobody both "
    "der die das und ist ein eine einen einer dass nicht mit für auf von zu den dem des war wie wenn weil obwohl zwischen auch zugleich über "
    "gegen ohne nach seit bei sich es er sie was wurde wurden "
    "la le les des du que qui et est une un pas au aux sur dans par pour avec selon sans ne ce cette chaque était on plus bien entre depuis aussi "
    "elle ils parce avait "
    "el los las una unos y se no es con por para sin según aunque entre desde más nadie esta este cada porque había fue era también al lo su "
    "и в во не на что по как это этот эта для от из было были но если то чем потому же бы ли о об к за у при так когда или до он она они".split())

FEATURES = [
    "function_share", "function_kinds", "type_ratio", "dense_share", "again_share", "link_share", "separators", "digit_share", "upper_share",
    "ends", "word_length", "n_words", "caseless_share", "hash_share", "host_spread"]

#: Stand for the end of a unit and for a character of a link.
UNIT, LINK = "\x03", "\x02"
_LINKS = re.compile(
    r"<a\s[^>\n]*>[^\n]*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s)<>\"'\]]+|(?<![\w@.])[a-z0-9][\w-]*(?:\.[\w-]+)*\.[a-z]{2,10}/[^\s)<>\"'\]]+", re.I)
_HOST = re.compile(r"(?:https?://)?((?:[\w-]+\.)+[a-z]{2,10})(?=/)", re.I)
_PRICE = re.compile(r"\d+[.,]\d\d ?(?:EUR|USD|GBP|CHF|€|\$|£)|[€$£] ?\d|\b(?:SKU|ISBN|EAN)\b", re.I)
_PRICE_SIGNS = ("€", "$", "£", "EUR", "USD", "GBP", "CHF", "SKU", "ISBN", "EAN")
#: Lines of links and numbered references are one unit whatever is in them.
_WHOLE = re.compile(r"^(?:[^\n]*(?:\]\(|</a>)|[ \t]*\[\d+\] )[^\n]*", re.M)
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
_TOKEN = re.compile(r"[^\W\d_]+|\x03")
_CLASSES = {
    "white": " \t\r\n\u00a0\u202f\u3000" + UNIT, "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "separator": ",;|/·•»>", "hash": "#", "link": LINK,
    "end": ".!?。！？…।"}
_CLOSING, _FULL_STOPS = ([ord(c) for c in marks] for marks in ("\"'”’»」)]", "。！？।"))
# Ranges of scripts in which function words are not told apart here.
_CASELESS = [(0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x74F), (0x900, 0xDFF), (0xE00, 0xE7F), (0x1200, 0x137F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)]
_BIT = {name: 1 << i for i, name in enumerate([*_CLASSES, "caseless"])}
_TABLE = np.zeros(0x10000, dtype=np.uint8)
for _name, _members in _CLASSES.items():
    _TABLE[[ord(c) for c in _members]] |= _BIT[_name]
for _a, _b in _CASELESS:
    _TABLE[_a : _b + 1] |= _BIT["caseless"]


def _prepared(text: str) -> tuple[str, list[tuple[int, int]], float, int]:
    """``text`` with its links blotted out by LINK, the spans of its whole lines, the share of different hosts among its links, its prices."""
    for mark in (UNIT, LINK, "\r"):
        if mark in text:
            text = text.replace(mark, " ")
    prices, whole, spread = 0, [], 0.0
    capitals = text.upper()
    if any(sign in capitals for sign in _PRICE_SIGNS):
        prices = len(_PRICE.findall(text))
    if "#" in text:
        text = _CAMEL.sub(" ", text)
    if "](" in text or "</a>" in text or "[" in text:
        whole = [m.span() for m in _WHOLE.finditer(text)]
    if "/" in text or "www." in text or "](" in text:
        hosts = _HOST.findall(text)
        spread = len(set(hosts)) / len(hosts) if hosts else 0.0
        text = _LINKS.sub(lambda m: LINK * len(m[0]), text)
    return text, whole, spread, prices


def _unit_ends(points: np.ndarray, kind: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Flags of characters that close a unit: line feeds, the white space after an end mark and its closing marks, end marks of scripts without spaces."""
    end, white = (kind & _BIT["end"]) > 0, (kind & _BIT["white"]) > 0
    before = np.concatenate(([False], end[:-1]))
    shut = np.concatenate(([False], np.isin(points[:-1], _CLOSING)))
    for _ in range(2):  # up to two closing marks
        before |= shut & np.concatenate(([False], before[:-1]))
    out = white & before
    out |= np.isin(points, _FULL_STOPS)
    for a, b in whole:
        out[a:b] = False
    out[points == 10] = True
    return out


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole), dtype=np.float64), where=whole > 0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def unit_features(texts: list[str]) -> dict[str, np.ndarray]:
    """Of every unit that isn't blank: page (place in ``texts``), label, size and FEATURES.

    Words count as dense if they come four times on the page and make up 1.2 % of it or,
    where nearly every word comes again, if they come twice: running text has about as
    many words that come once as others whatever its length, a keyword list hardly any.
    label is the page's: 1 if links, prices, hashtags or repeated words leave no room for
    sentences, 0 if function words show that sentences fill the page, else NaN.
    """
    n_pages = len(texts)
    prepared, whole, spread, prices = zip(*map(_prepared, texts)) if texts else ((), (), (), ())
    spread, prices = np.array(spread, dtype=np.float64), np.array(prices, dtype=np.float64)
    joined = "".join(t + "\n" for t in prepared)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    kind = np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], 0).astype(np.uint8)
    page_stop = np.cumsum([len(t) + 1 for t in prepared]) if n_pages else np.zeros(0, dtype=np.int64)
    stops = np.flatnonzero(_unit_ends(points, kind, [(a + before, b + before) for spans, before in zip(whole, page_stop - [len(t) + 1 for t in prepared]) for a, b in spans] if n_pages else []))
    points[stops] = ord(UNIT)
    joined = points.tobytes().decode("utf-32-le", "surrogatepass")
    n_units = len(stops)
    starts = np.concatenate(([0], stops[:-1] + 1))[:n_units]
    page = np.searchsorted(page_stop, stops, side="right")
    def total(name: str) -> np.ndarray:
        there = (kind & _BIT[name]) > 0
        return np.add.reduceat(there.view(np.uint8), starts, dtype=np.int32) if there.any() else np.zeros(n_units, dtype=np.int32)

    size = stops - starts + 1 - total("white") - ((kind[stops] & _BIT["white"]) == 0)
    ends = np.zeros(n_units, dtype=bool)
    for back in (0, 1, 2, 3):
        at = stops - back
        ends |= (at >= starts) & ((kind[np.maximum(at, 0)] & _BIT["end"]) > 0)
    # Words as numbers, with the unit and page of each.
    code, kinds_of = pd.factorize(np.array(_TOKEN.findall(joined.lower()), dtype=object))
    is_stop, is_function = kinds_of == UNIT, np.array([w in FUNCTION_WORDS for w in kinds_of], dtype=bool)
    closing = is_stop[code] if len(code) else np.zeros(0, dtype=bool)
    unit = np.cumsum(closing)[~closing] if len(code) else np.zeros(0, dtype=np.int64)
    code = code[~closing]
    width = max(1, len(kinds_of))
    function = is_function[code] if len(code) else np.zeros(0, dtype=bool)
    count = lambda at, n, weights=None: np.bincount(at, weights=weights, minlength=n)[:n]
    n_words, n_function = count(unit, n_units), count(unit[function], n_units)
    pair = _distinct(unit * width + code)  # each word once a unit
    pair_unit, pair_code = pair // width, pair % width
    pair_function = is_function[pair_code] if len(pair) else np.zeros(0, dtype=bool)
    kinds, function_kinds = count(pair_unit, n_units), count(pair_unit[pair_function], n_units)
    content_pair, content_unit = pair[~pair_function], pair_unit[~pair_function]
    every = np.sort(page[unit[~function]] * width + code[~function])
    on_page = _distinct(every)
    times = np.diff(np.append(np.searchsorted(every, on_page), len(every)))
    of_page = on_page // width
    n_content, n_kinds = count(of_page, n_pages, times), count(of_page, n_pages)
    again = times >= 2
    mostly = (n_content >= 20) & (count(of_page[again], n_pages) >= 0.8 * n_kinds)
    dense = np.where(mostly[of_page], again, times >= np.maximum(4, np.ceil(0.012 * n_content))[of_page]) if len(of_page) else again
    place = np.searchsorted(on_page, page[content_unit] * width + content_pair % width)
    named = lambda flag: _ratio(count(content_unit[flag[place]], n_units) if len(place) else np.zeros(n_units), kinds - function_kinds)
    # What is said of whole pages.
    by_page = lambda v: count(page, n_pages, v)
    p_size, p_words = by_page(size), by_page(n_words)
    p_function, p_dense = _ratio(by_page(n_function), p_words), _ratio(count(of_page[dense], n_pages, times[dense]), n_content)
    link, hashes, caseless = total("link"), total("hash"), total("caseless")
    p_link, p_hash, p_caseless = (_ratio(by_page(v), p_size) for v in (link, hashes, caseless))
    p_hash, p_price = p_hash * 12, _ratio(prices, p_size) * 60
    cased = p_caseless < 0.3
    full = (p_function <= 0.12) & ((np.maximum(np.maximum(p_link, p_price), p_hash) >= 0.6) | (p_dense >= 0.6) & cased)
    stuffed = cased & (p_dense >= 0.9) & (n_kinds <= 0.2 * n_content) & (n_content >= 30)
    fine = ((p_function >= 0.25) & (p_dense <= 0.3) | (p_function >= 0.1) & (p_dense <= 0.1) | (p_caseless >= 0.4)) & (p_link <= 0.1) & (p_hash < 0.1) & (p_price < 0.1)
    label = np.where(full | stuffed, 1.0, np.where(fine, 0.0, np.nan))
    some = np.maximum(n_words, 1)
    out = {
        "page": page, "label": label[page], "size": size, "function_share": _ratio(n_function, n_words), "function_kinds": function_kinds, "type_ratio": _ratio(kinds, n_words),
        "dense_share": named(dense), "again_share": named(again), "link_share": _ratio(link, size), "separators": total("separator") / some,
        "digit_share": _ratio(total("digit"), size), "upper_share": total("upper") / some, "ends": ends, "word_length": size / some, "n_words": np.log1p(n_words),
        "caseless_share": _ratio(caseless, size), "hash_share": hashes / some, "host_spread": np.where(link > 0, spread[page], 0.0) if n_units else spread[:0]}
    return {k: v[size > 0] for k, v in out.items()}


CHUNK = 500_000  # characters whose arrays are in memory at once; a longer page is one chunk
SAMPLE_UNITS = 100  # units of one page in a training sample, at most
_WIDE = len(FEATURES) + 1


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, label, units) of all pages with a key and a text: per unit its size and FEATURES, as one run of 32-bit floats."""
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(host).cast("string").alias("host"), F.col(text).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            upto = batch["text"].str.len().cumsum().to_numpy()
            for _, part in batch.groupby(upto // CHUNK, sort=False):
                found = unit_features(part["text"].tolist())
                table = np.column_stack([found["size"], *[found[f] for f in FEATURES]]).astype(np.float32)
                at = np.searchsorted(found["page"], np.arange(len(part) + 1))
                label = np.append(found["label"], np.nan)[at[:-1]]
                label[at[:-1] == at[1:]] = np.nan
                yield pd.DataFrame({
                    key: part[key], "host": part["host"], "label": [None if np.isnan(v) else v for v in label],
                    "units": [table[a:b].tobytes() for a, b in zip(at, at[1:])]})

    return rows.mapInPandas(measure, f"{key} {rows.schema[key].dataType.simpleString()}, host string, label double, units binary").where("length(units) > 0")


def train(pages: DataFrame, key: str = "doc_id", per_class: int = 600, trees: int = 15, depth: int = 6, seed: int = 7) -> list[Tree] | None:
    """Bagged trees on the units of at most ``per_class`` weakly labelled pages of each class.

    The sample is the pages with the least hash, so it depends on neither order nor
    partitions; of a page it takes SAMPLE_UNITS units at most, evenly, which
    weigh as much as they have of its characters.  None if a class
    has no page.
    """
    rank = F.xxhash64(key, F.lit(seed))
    take = lambda v: pages.where(F.col("label") == v).withColumn("_r", rank).orderBy("_r", key).limit(per_class).select("label", "units")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, raw in zip(batch["label"], batch["units"]):
                table = np.frombuffer(raw, dtype=np.float32).reshape(-1, _WIDE)
                table = table[np.unique(np.linspace(0, len(table) - 1, min(len(table), SAMPLE_UNITS)).astype(int))]
                yield pd.DataFrame(table[:, 1:], columns=FEATURES).assign(label=label, weight=table[:, 0] / table[:, 0].sum())

    sample = cut(take(1.0).unionByName(take(0.0)).mapInPandas(unpack, ", ".join(f"{f} float" for f in FEATURES) + ", label double, weight double"))
    if sample.select("label").distinct().count() < 2:
        return None
    # Every feature may serve in every split: this is bagging, not a random forest.
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", bootstrap=True, seed=seed, labelCol="label", weightCol="weight")
    model = forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))
    return [Tree.read(tree.toDebugString) for tree in model.trees]


@dataclass
class Tree:
    """A decision tree as arrays by node; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def read(text: str) -> Tree:
        """The tree of its printed form, one line a branch or leaf, nested by indentation."""
        nodes: list[list] = []
        open_: list[int] = []
        deepest = 0
        for line in text.splitlines():
            if m := re.search(r"Else", line):
                node = open_.pop()
                nodes[node][3] = len(nodes)
            elif m := re.search(r"If \(feature (\d+) <= (\S+)\)", line):
                open_.append(len(nodes))
                deepest = max(deepest, len(open_) + line.count(" "))
                nodes.append([int(m[1]), float(m[2]), len(nodes) + 1, -1, 0.0])
            elif m := re.search(r"Predict: (\S+)", line):
                nodes.append([0, np.inf, len(nodes), len(nodes), float(m[1])])
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        return Tree(feature, threshold, left, right, value, deepest)

    def votes(self, table: np.ndarray) -> np.ndarray:
        """1 where the tree says spam, by row."""
        at = np.zeros(len(table), dtype=np.int64)
        rows = np.arange(len(table))
        for _ in range(self.depth + 1):
            following = np.where(table[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (following == at).all():
                break
            at = following
        return self.value[at].astype(np.int64)


def judged(pages: DataFrame, trees: list[Tree] | None, key: str = "doc_id") -> DataFrame:
    """(key, host, mass): the characters of a page's units by the number of trees that vote for spam."""
    n = len(trees) if trees else 1

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(u) // (4 * _WIDE) for u in batch["units"]])
            table = np.frombuffer(b"".join(batch["units"]), dtype=np.float32).reshape(-1, _WIDE)
            of = np.repeat(np.arange(len(batch)), sizes)
            votes = sum(t.votes(table[:, 1:]) for t in trees) if trees else (batch["label"].fillna(0).to_numpy()[of]).astype(np.int64)
            mass = np.bincount(of * (n + 1) + votes, weights=table[:, 0], minlength=len(batch) * (n + 1)).reshape(len(batch), n + 1)
            yield pd.DataFrame({key: batch[key], "host": batch["host"], "mass": list(mass)})

    votes = pages.mapInPandas(judge, f"{key} {pages.schema[key].dataType.simpleString()}, host string, mass array<double>")
    return votes.groupBy(key, "host").agg(F.array(*[F.sum(F.col("mass")[i]) for i in range(n + 1)]).alias("mass"))


def smoothed(votes: DataFrame, n: int, key: str = "doc_id", weight: float = 0.5, prior: float = 20.0) -> DataFrame:
    """(key, host, tree_share, share) of (key, host, mass) by votes of ``n`` trees: characters in spam units, by the trees alone and with the host's prior.

    The odds of a unit are those of its votes.  A host's rate is that of its pages with a
    tree_share above a half, drawn to the rate of all pages by ``prior`` pages' worth;
    pages without a host have no other prior than all pages.  The difference of the log
    odds of the two rates, times ``weight``, is added to those of each unit.
    """
    add = lambda a, m: a + m
    pages = votes.withColumn("total", F.aggregate("mass", F.lit(0.0), add))
    pages = cut(pages.withColumn("tree_share", F.aggregate(F.slice("mass", n // 2 + 2, n + 1), F.lit(0.0), add) / F.col("total")))
    is_spam = (F.col("tree_share") > 0.5).cast("double")
    rate = min(max(pages.agg(F.avg(is_spam)).first()[0] or 0.0, 1e-4), 1 - 1e-4)
    hosts = pages.where("host is not null").groupBy("host").agg(((F.sum(is_spam) + F.lit(rate * prior)) / (F.count("*") + F.lit(prior))).alias("host_rate"))
    odds = lambda c: F.ln(c / (1 - c))
    host_rate = F.least(F.greatest(F.coalesce("host_rate", F.lit(rate)), F.lit(1e-4)), F.lit(1 - 1e-4))
    out = pages.join(broadcast_if_small(hosts), "host", "left").withColumn("moved", F.lit(weight) * (odds(host_rate) - odds(F.lit(rate))))
    in_spam = F.aggregate(F.transform("mass", lambda m, i: F.when(odds((i + 0.5) / (n + 1)) + F.col("moved") > 1e-9, m).otherwise(0.0)), F.lit(0.0), add)
    return out.select(key, "host", "tree_share", (in_spam / F.col("total")).alias("share"))


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", weight: float = 0.5, prior: float = 20.0, per_class: int = 600) -> DataFrame:
    """:func:`smoothed` rows of all pages; if weak labels show one class only, they stand for the trees."""
    pages = cut(measured(documents, key, text, host))
    trees = train(pages, key, per_class)
    return smoothed(judged(pages, trees, key), len(trees) if trees else 1, key, weight, prior)


def spam_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", per_class: int = 600) -> DataFrame:
    """Distinct keys of pages of which more than half of the characters are in spam units.

    Null keys and null, empty or blank texts are no pages; a page sent twice, or several
    texts under one key and host, count as one page of all their units.
    """
    return scored(documents, key, text, host, per_class=per_class).where("share > 0.5").select(key).distinct()
