"""Passages of test items inside corpus documents: Wu-Manber search over words.

Texts become sequences of words: mark-up is taken off, characters are brought to their
canonical form, then case and accents are folded.  A test string is any run of ``run``
consecutive words of an item.  For blocks of two words a shift table says how far the
search may jump without missing a test string; where the shift is zero, the hash of the
block selects the test strings that end with it, and comparing words confirms them.

Items are spread over blocks of about as many words; the blocks are read one at a time,
their tables are built once and broadcast, and the corpus is scanned once a block,
without a shuffle.  Words become numbers by way of a cache of tokens, so that the costly
folding of characters is done once a token and not once an occurrence.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logosmill.llm.canonical import canonical
from logosmill.session import cut

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt])")
#: ASCII punctuation and white space part words whatever stands beside them; all else is looked at token by token.
_TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def _without_comments(text: str) -> str:
    """Comments of any length taken off, in one pass; one that is never closed stays."""
    parts, done = [], 0
    while (start := text.find("<!--", done)) >= 0 and (stop := text.find("-->", start + 4)) >= 0:
        parts += [text[done:start], " "]
        done = stop + 3
    return "".join(parts) + text[done:] if done else text


def _tokens(text: str) -> list[str]:
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    return _TOKEN.findall(text)


def _words_in(token: str) -> list[str]:
    if token.isascii():
        return [token.lower()]
    token = unicodedata.normalize("NFKD", canonical(token).casefold())
    return _WORD.findall("".join(c for c in token if not unicodedata.combining(c)).casefold())


def words_of(text: str) -> list[str]:
    """Comparable words: unbroken runs of letters or digits."""
    return [w for token in _tokens(text) for w in _words_in(token)]


class WuManber:
    """Shift and suffix tables for runs of ``run`` words of the given items.

    Words are numbers, and a test string is a place in its item, so the tables grow with
    the number of words only.
    """

    SUFFIX = 4  # words that choose the bucket
    CACHED = 500_000  # tokens remembered; beyond that the cache begins anew

    def __init__(self, items: list[tuple[object, list[str]]], run: int):
        self.run = run
        self.suffix = min(self.SUFFIX, run)
        self.vocabulary: dict[str, int] = {}
        self.keys = [key for key, _ in items]
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        self.base = len(self.vocabulary) + 1
        self.shift: dict[int, int] = {}
        self.ending: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.cache: dict[str, list[int]] = {}
        for at, words in enumerate(self.words):
            if len(words) < run:
                continue
            for j in range(1, len(words)):
                block, jump = words[j - 1] * self.base + words[j], max(0, run - 1 - j)
                if jump < self.shift.get(block, run - 1):
                    self.shift[block] = jump
                if j >= run - 1:
                    self.ending.setdefault(tuple(words[j - self.suffix + 1 : j + 1]), []).append((at, j))

    def numbers(self, text: str) -> list[int]:
        """The words of ``text`` as numbers; 0 is a word of no item."""
        cache, out = self.cache, []
        for token in _tokens(text):
            known = cache.get(token)
            if known is None:
                if len(cache) >= self.CACHED:
                    cache.clear()
                known = cache[token] = [self.vocabulary.get(w, 0) for w in _words_in(token)]
            out += known
        return out

    def items_in(self, text: str) -> set:
        """Items of which ``text`` holds a test string."""
        words = self.numbers(text)
        found: set[int] = set()
        run, base, far, shift = self.run, self.base, self.run - 1, self.shift
        at, n = run - 1, len(words)  # where the window ends
        while at < n:
            jump = shift.get(words[at - 1] * base + words[at], far)
            if jump:
                at += jump
                continue
            for item, stop in self.ending.get(tuple(words[at - self.suffix + 1 : at + 1]), ()):
                if item not in found and self.words[item][stop - run + 1 : stop + 1] == words[at - run + 1 : at + 1]:
                    found.add(item)
            at += 1
        return {self.keys[i] for i in found}


def leaked_items(
    items: DataFrame, documents: DataFrame, run: int = 13, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text",
    block_characters: int = 5_000_000,
) -> DataFrame:
    """Distinct (item_id, doc_id) where the document holds ``run`` consecutive words of the item.

    Null texts and keys match nothing, items of fewer than ``run`` words neither.  Items
    are spread by a hash over blocks of about ``block_characters``; only one block is in
    the driver at a time, every block is searched in all documents, and with more than
    one the hits of each are written before the next is read.
    """
    if run < 2:
        raise ValueError("a run has at least two words")
    spark = documents.sparkSession
    texts = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).alias("k"), F.col(text).alias("t")).distinct()
    size = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // block_characters) or 1
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"{item_key} {kind(items, item_key)}, {doc_key} {kind(documents, doc_key)}"
    corpus = documents.where(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).select(doc_key, text)

    def search(block: int) -> DataFrame:
        own = texts.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block) if blocks > 1 else texts
        machine = spark.sparkContext.broadcast(WuManber([(r.k, words_of(r.t)) for r in own.collect()], run))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = machine.value.items_in
            for batch in batches:
                yield pd.DataFrame([(i, d) for d, t in zip(batch[doc_key], batch[text]) for i in find(t)], columns=[item_key, doc_key])

        return corpus.mapInPandas(scan, schema)

    if blocks == 1:
        return search(0).distinct()
    return reduce(DataFrame.unionByName, [cut(search(b)) for b in range(blocks)]).distinct()
