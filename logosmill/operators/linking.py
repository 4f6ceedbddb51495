"""Concept linking, alignment of findings, candidate edges and their decoding."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.operators import hierarchy as H


def greedy_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Non-overlapping (keys, start_pos, stop_pos, ...): by start, longer first, kept if it begins after the last kept one.

    The choice runs as a fold over one document's sorted spans.
    """
    rest = [c for c in spans.columns if c not in keys]
    item = F.struct(F.col("start_pos").alias("a"), (-F.col("stop_pos")).alias("b"), F.struct(*rest).alias("r"))
    folded_ = F.aggregate(
        F.sort_array(F.collect_list(item)), F.struct(F.lit(-1).cast("bigint").alias("end"), F.array().cast(f"array<{spans.select(F.struct(*rest).alias('r')).schema['r'].dataType.simpleString()}>").alias("kept")),
        lambda acc, x: F.when(x["a"] >= acc["end"], F.struct((-x["b"]).cast("bigint").alias("end"), F.concat(acc["kept"], F.array(x["r"])).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"])
    return spans.groupBy(*keys).agg(folded_.alias("_kept")).select(*keys, F.explode("_kept").alias("_r")).select(*keys, "_r.*")


INDEX_LIMIT = 64 << 20  # characters of an index that is broadcast
NEGATIVE_WINDOW = 25  # fixed value: tokens on either side in which a negative phrase vetoes
_CONTEXT_TOKEN = re.compile(r"[A-Za-z0-9_.+-]+")  # fixed value


def _fold(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _holds(window: str, phrases: list[str]) -> bool:
    """Whether a phrase stands in ``window`` with no letter or digit beside it."""
    for phrase in phrases:
        at = window.find(phrase)
        while at >= 0:
            stop = at + len(phrase)
            if not (window[at - 1 : at].isalnum() or window[stop : stop + 1].isalnum()):
                return True
            at = window.find(phrase, at + 1)
    return False


class ConceptScan:
    """The entries of an index by folded surface, and what of them a text mentions."""

    def __init__(self, entries: list[dict]):
        self.entries: dict[str, list[dict]] = {}
        for e in entries:
            lower = lambda ps: [p.lower() for p in ps or [] if p]
            self.entries.setdefault(_fold(e["surface"]), []).append(e | {"anchors": lower(e["anchors"]), "negative": lower(e["negative"])})
        self.machine = None

    def places(self, low: str) -> Iterator[tuple[int, str]]:
        """(start, surface) of all occurrences, overlapping ones included."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for surface in self.entries:
                self.machine.add_word(surface, surface)
            self.machine.make_automaton()
        if self.entries:
            for last, surface in self.machine.iter(low):
                yield last - len(surface) + 1, surface

    def mentions(self, text: str) -> list[tuple[int, int, list[str], bool]]:
        """(start, stop, concepts, undecided) of the mentions chosen: by start, longer first, none overlapping the one before."""
        low, tokens = _fold(text), None
        spans: dict[tuple[int, int], tuple[set[str], list[bool]]] = {}
        for start, surface in self.places(low):
            stop = start + len(surface)
            after = text[stop : stop + 2]
            if text[max(0, start - 1) : start].isalnum() or after[:1].isalnum() or (after[:1] == "." and after[1:].isalnum()):
                continue
            if start >= 2 and text[start - 1] == "-" and text[start - 2].isalnum():
                continue
            for e in self.entries[surface]:
                if (e["case_sensitive"] or e["match_policy"] == "case_exact") and text[start:stop] != e["surface"]:
                    continue
                if e["negative"] or e["match_policy"] == "context_anchored":
                    if tokens is None:
                        tokens = [m.span() for m in _CONTEXT_TOKEN.finditer(text)]
                    left, right = bisect_right(tokens, start, key=lambda t: t[1]), bisect_left(tokens, stop, key=lambda t: t[0])
                    near = tokens[max(0, left - NEGATIVE_WINDOW) : max(right, left) + NEGATIVE_WINDOW]
                    if e["negative"] and _holds(low[min([start, *(a for a, _ in near[:1])]) : max([stop, *(b for _, b in near[-1:])])], e["negative"]):
                        continue
                    if e["match_policy"] == "context_anchored":
                        n = e["anchor_window"]
                        words = lambda part: " ".join(text[a:b] for a, b in part)
                        if not _holds(f"{words(tokens[max(0, left - n) : left])} {words(tokens[right : right + n])}".lower(), e["anchors"]):
                            continue
                found = spans.setdefault((start, stop), (set(), []))
                found[0].add(e["curie"])
                found[1].append(bool(e.get("undecided")))
        chosen, last = [], -1
        for start, stop in sorted(spans, key=lambda s: (s[0], -s[1])):
            if start >= last:
                curies, undecided = spans[start, stop]
                chosen.append((start, stop, sorted(curies), len(curies) > 1 or any(undecided)))
                last = stop
        return chosen


def link_concepts(documents: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, stop_pos, surface, curies, resolution) of index entries mentioned in texts.

    ``index``: curie, surface, case_sensitive, match_policy, anchors array, negative array,
    anchor_window, and optionally undecided (a mention needs a decision from elsewhere).
    A surface is bounded by what is no letter or digit, not followed by a dot and a letter
    or digit, and not preceded by a hyphened word.  A negative phrase near by vetoes, a
    context-anchored entry needs an anchor in its window of tokens outside the match.
    Several concepts, or an undecided one, make a mention ambiguous.  Null keys and texts,
    entries without a surface, and never_link entries give nothing.

    One pass of a multi-pattern automaton over each text, in Arrow batches: nothing is
    shuffled.  The index is broadcast; its size is checked.
    """
    wanted = index.where("match_policy <> 'never_link' and trim(surface) <> ''")
    size = wanted.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size > INDEX_LIMIT:
        raise ValueError(f"an index of {size} characters is too large to broadcast; link its domains one by one")
    scan = documents.sparkSession.sparkContext.broadcast(ConceptScan([r.asDict(recursive=True) for r in wanted.collect()]))

    @F.pandas_udf("array<struct<start_pos:int,stop_pos:int,curies:array<string>,open:boolean>>")
    def find(texts: pd.Series) -> pd.Series:
        names = ("start_pos", "stop_pos", "curies", "open")
        return texts.map(lambda t: [dict(zip(names, m)) for m in scan.value.mentions(t)])

    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    found = rows.withColumn("_f", find("_t"))
    cut_ = F.transform("_f", lambda m: F.struct(
        m["start_pos"].alias("start_pos"), m["stop_pos"].alias("stop_pos"), F.substring(F.col("_t"), m["start_pos"] + 1, m["stop_pos"] - m["start_pos"]).alias("surface"),
        F.array_join(m["curies"], ",").alias("curies"), F.when(m["open"], "ambiguous").otherwise("unique").alias("resolution")))
    return found.select(key, F.inline(cut_))


def enclosing(cues: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Adds to cues (key, cue_id, start_pos, stop_pos) the narrowest node (key, node_id, first, last) around each; null if none, ties by id."""
    inside = cues.join(nodes, key).where("first <= start_pos and stop_pos <= last")
    best = inside.groupBy(key, "cue_id").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "node_id")).alias("b"))
    return cues.join(best, [key, "cue_id"], "left").withColumn("node_id", F.col("b.node_id")).drop("b")


def aligned(findings: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, path, findings): per path in document order, each finding once.

    ``findings``: key, finding_id, start_pos, stop_pos; ``items``: key, path, start_pos, stop_pos.
    """
    f = findings.select(key, "finding_id", F.col("start_pos").alias("fs"), F.col("stop_pos").alias("fe"))
    hits = f.join(items, key).where("fs < stop_pos and start_pos < fe").groupBy(key, "path", "finding_id").agg(F.min("fs").alias("at"))
    return hits.groupBy(key, "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "finding_id"))), lambda x: x["finding_id"].cast("string")), ",").alias("findings"))


def candidates(nodes: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """Ordered pairs of a document's different nodes (key, node_id, pos) with a signal (key, node_id) on either side, and their features."""
    marked = nodes.join(signals.select(key, "node_id").distinct().withColumn("sig", F.lit(True)), [key, "node_id"], "left").withColumn("sig", F.coalesce("sig", F.lit(False)))
    side = lambda p: marked.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "pos", "sig")])
    # Only pairs with a signal are formed: signalled sources with all, then all others with signalled targets.
    first = side("s").where("s_sig").join(side("t"), key)
    second = side("s").where("not s_sig").join(side("t").where("t_sig"), key)
    gap = F.col("t_pos") - F.col("s_pos")
    return first.unionByName(second).where("s_node_id <> t_node_id").select(key, F.col("s_node_id").alias("source_id"), F.col("t_node_id").alias("target_id"), (F.signum(gap) * F.log1p(F.abs(gap))).alias("distance"))


# Words in a source's first 80 characters, by flag.
LEXICAL_FLAGS = {
    "contrast": ["however", "although", "but", "whereas"], "cause": ["because", "therefore", "thus", "as a result"], "condition": ["if", "unless", "otherwise"]}


def structural_features(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Adds distances, length ratio, hops, kinds and lexical flags to pairs (key, source_id, target_id).

    ``nodes``: key, node_id, parent_id, kind, start_pos, stop_pos, first_edu, text.  hops
    counts the links of the tree path between the two; null if none joins them.  Flags look
    for the words anywhere in the source's first 80 characters, so 'but' is found in 'button'.
    """
    links = nodes.select(
        F.lit("nodes").alias("tree_table"), F.col(key).cast("string").alias("tree_id"), F.col("node_id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent"))
    paths = H.hierarchy(links).select(F.col("tree_id").alias("_k"), F.col("id").alias("_id"), "path")
    full = nodes.withColumn("_k", F.col(key).cast("string")).withColumn("_id", F.col("node_id").cast("string")).join(paths, ["_k", "_id"])
    side = lambda p: full.select(key, F.col("node_id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("path", "kind", "start_pos", "stop_pos", "first_edu", "text")])
    both = pairs.join(side("source"), [key, "source_id"]).join(side("target"), [key, "target_id"])
    gap = F.col("target_start_pos") - F.col("source_start_pos")
    shared = F.size(F.array_intersect("source_path", "target_path"))
    length = lambda p: F.greatest(F.lit(1), F.col(f"{p}_stop_pos") - F.col(f"{p}_start_pos"))
    begin = F.lower(F.substring("source_text", 1, 80))
    return both.select(
        *pairs.columns, (F.signum(gap) * F.log1p(F.abs(gap))).alias("log_distance"), (F.col("target_first_edu") - F.col("source_first_edu")).alias("edu_distance"),
        F.when(shared > 0, F.size("source_path") + F.size("target_path") - 2 * shared).alias("hops"), F.ln(length("source") / length("target")).alias("length_ratio"),
        (F.col("source_kind") == "edu").alias("source_is_edu"), (F.col("target_kind") == "edu").alias("target_is_edu"),
        *[begin.rlike("|".join(words)).alias(name) for name, words in LEXICAL_FLAGS.items()])


def decoded_edges(scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """Adds ``decision`` to scored edges (key, source_id, target_id, relation, edge_p, relation_p, signal).

    By falling joint score, then ids: accepted, or below_threshold, no_signal, self_loop, duplicate_pair.
    """
    joint = F.col("edge_p") * F.col("relation_p")
    reason = F.when(F.col("source_id") == F.col("target_id"), "self_loop").when(joint < threshold, "below_threshold").when(~F.col("signal"), "no_signal")
    rows = scores.withColumn("joint", joint).withColumn("reason", reason)
    w = Window.partitionBy(key, "source_id", "target_id", F.col("reason").isNull()).orderBy(F.desc("joint"), "relation")
    return rows.withColumn("decision", F.coalesce("reason", F.when(F.row_number().over(w) == 1, "accepted").otherwise("duplicate_pair"))).drop("reason")


def softmax(scores: Column) -> Column:
    """Stable softmax of an array of numbers."""
    top = F.array_max(scores)
    powers = F.transform(F.transform(scores, lambda x: x.cast("double")), lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def entropy(probabilities: Column) -> Column:
    return -F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0))
