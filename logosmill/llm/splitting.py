"""Oversized texts into balanced, overlapping pieces, cut at natural boundaries.

The least number of pieces that can satisfy the limit is computed first, and targets
divide the text into equal lengths.  Each target moves to the strongest boundary near
it that keeps every later piece feasible.  If a cut would have to split a word although
the text has boundaries, a piece is added and the targets are placed again.

Sizes are counted in the requirement's unit: code points, UTF-8 bytes, or runs of
characters other than space, tab, CR and LF.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small

UNITS = ("code_points", "utf8_bytes", "whitespace_tokens")
PIECES = "row_id string, piece_no int, n_pieces int, start_pos bigint, stop_pos bigint, overlap bigint, size bigint, limit bigint, cut string, piece string"

# Boundary kinds, strongest first, with what a cut comes after.
BOUNDARIES = {
    "structural_container": r"\n[ \t\r]*\n(?=[ \t]*(?:#{1,2} |={3,}|-{3,}|\*{3,}))|\f|\n(?=#{1,2} )",
    "heading": r"\n(?=[ \t]*#{1,6} )|(?:\A|\n[ \t\r]*\n)[^\n]{1,80}[^\s.!?。！？…:;,]\r?\n[ \t\r]*\n",
    "paragraph": r"\n[ \t\r]*\n\s*",
    "sentence": r"(?<!\b[A-Z])(?<!\b(?:Dr|Mr|Nr|Sr|St|vs|cf|éd))(?<!\b(?:Mrs|Abs|Fig|art|pág))(?<!\bProf)[.!?…؟]+[)\]\"'”’»]*\s+(?![a-zà-ÿ])|[。！？।॥።፧]+[”」』）)]*\s*",
    "edu": r"[,;:–—،؛][”\"')]?\s+|[，、；：፣፥]+",
    "line": r"\n",
    "word": r"[ \t\u00a0\u2000-\u200a\u202f\u3000]+",
}
RANK = {kind: len(BOUNDARIES) - i + 1 for i, kind in enumerate(BOUNDARIES)}  # a grapheme's edge has 1, inside it 0
KINDS = {v: k for k, v in RANK.items()} | {1: "character", 0: "code point"}
_PATTERNS = {kind: re.compile(p) for kind, p in BOUNDARIES.items()}


def size_column(text: Column, unit: Column) -> Column:
    """Size of ``text`` in ``unit``; null for units that need a model to count."""
    return (
        F.when(unit == "code_points", F.length(text))
        .when(unit == "utf8_bytes", F.octet_length(text))
        .when(unit == "whitespace_tokens", F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")))
        .cast("bigint")
    )


def _costs(text: str, unit: str) -> np.ndarray:
    """Prefix sums: what the first i characters cost, counting a run at its first character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if unit == "code_points":
        each = np.ones(len(points), dtype=np.int64)
    elif unit == "utf8_bytes":
        each = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    else:
        solid = ~np.isin(points, (32, 9, 13, 10))
        each = (solid & np.concatenate(([True], ~solid[:-1]))).astype(np.int64)
    return np.concatenate(([0], np.cumsum(each)))


def _strengths(text: str, kinds: set[str]) -> np.ndarray:
    strength = np.ones(len(text) + 1, dtype=np.int8)
    for i, ch in enumerate(text):
        if ch > "˿" and (unicodedata.category(ch)[0] == "M" or ch in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= ch <= "\U0001f3ff" or (i and text[i - 1] == "\u200d")):
            strength[i] = 0
    for kind in reversed(BOUNDARIES):
        if kind in kinds or kind in ("line", "word"):
            ends = [m.end() for m in _PATTERNS[kind].finditer(text)]
            strength[ends] = RANK[kind]
    return strength


def _attempt(cost: np.ndarray, strength: np.ndarray, k: int, limit: int, overlap: int, whole_runs: bool) -> list[tuple[int, int]] | None:
    """(start, stop) of k pieces, or None if the limit cannot be kept."""
    n = len(cost) - 1
    total = int(cost[n])
    step = (total - overlap) / k
    out, start, stop = [], 0, 0
    for i in range(1, k):
        most = int(np.searchsorted(cost, cost[start] + limit, side="right")) - 1
        least = int(np.searchsorted(cost, total - (k - i) * (limit - overlap), side="left"))
        least = max(least, stop + 1)
        if whole_runs:  # a cut belongs right before a run
            while most > least and cost[min(most + 1, n)] == cost[most]:
                most -= 1
        if least > most:
            return None
        target = int(np.searchsorted(cost, i * step + overlap, side="left"))
        target = min(max(target, least), most)
        near = max(1, int((target - stop) * 0.35))
        lo, hi = max(least, target - near), min(most, target + near)
        at = lo + _best(strength[lo : hi + 1], target - lo)
        if strength[at] < RANK["word"] and (lo > least or hi < most):
            at = least + _best(strength[least : most + 1], target - least)
        out.append((start, at))
        stop = at
        # The overlap counts back in the same unit and never exceeds the size asked for.
        start = at
        if overlap:  # a run counts at its first character, so a piece begins right before one
            start = int(np.searchsorted(cost, cost[at] - overlap, side="right")) - 1 if whole_runs else int(np.searchsorted(cost, cost[at] - overlap, side="left"))
        start = min(max(start, out[-1][0] + 1), at)
    if cost[n] - cost[start] > limit:
        return None
    out.append((start, n))
    return out


def _best(window: np.ndarray, target: int) -> int:
    strongest = np.flatnonzero(window == window.max())
    return int(strongest[np.argmin(np.abs(strongest - target))])


def _needed_hard_cuts(cost: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> int:
    """How many cuts must fall inside words: what is between two boundaries and exceeds a piece."""
    n = len(cost) - 1
    at = np.concatenate(([0], 1 + np.flatnonzero(strength[1:n] >= RANK["word"]), [n]))
    between = np.diff(cost[at])
    return int(np.ceil(np.maximum(between[between > limit] - overlap, 1) / (limit - overlap)).sum() - (between > limit).sum())


def split_text(text: str, unit: str, limit: int, overlap: int, preference: list[str] | None) -> list[tuple[int, int, int]]:
    """(start, stop, strength of the cut at stop) of the pieces of ``text``.

    A text within the limit is one piece.  A limit below one counts as one, an overlap of
    the limit or more as one less than the limit.  A single code point larger than a limit
    in bytes is a piece of its own.
    """
    cost = _costs(text, unit)
    n, total = len(text), int(cost[-1])
    limit = max(limit, 1)
    if total <= limit:
        return [(0, n, RANK["paragraph"])]
    if unit == "utf8_bytes":
        limit = max(limit, 4)
    overlap = max(0, min(overlap, limit - 1))
    strength = _strengths(text, set(BOUNDARIES) if preference is None else set(preference))
    if unit == "whitespace_tokens":
        inside = np.zeros(n + 1, dtype=bool)
        solid = np.array([c not in " \t\r\n" for c in text])
        inside[1:n] = solid[1:] & solid[:-1]
        strength[inside] = 0
    least = math.ceil((total - overlap) / (limit - overlap))
    needed = _needed_hard_cuts(cost, strength, limit, overlap)
    fallback, fewest, k = None, n, least
    while k <= 2 * least + 3:
        cuts = _attempt(cost, strength, k, limit, overlap, unit == "whitespace_tokens")
        if cuts is not None:
            hard = sum(int(strength[b]) < RANK["word"] for _, b in cuts[:-1])
            if hard <= needed:
                return [(a, b, int(strength[b])) for a, b in cuts]
            if hard < fewest:
                fallback, fewest = cuts, hard
        # One piece more at first; for many pieces by a sixteenth, so the attempts stay few.
        k += max(1, (k - least) // 3, k // 16 if k - least >= 4 else 1)
    if fallback is None:  # granularity left no room: cut greedily
        fallback, start = [], 0
        while True:
            stop = max(start + 1, int(np.searchsorted(cost, cost[start] + limit, side="right")) - 1)
            stop = min(stop, n)
            fallback.append((start, stop))
            if stop == n:
                break
            back = int(np.searchsorted(cost, cost[stop] - overlap, side="left")) if overlap else stop
            start = back if start < back < stop else stop
    return [(a, b, int(strength[b])) for a, b in fallback]


def with_limits(items: DataFrame, requirements: DataFrame) -> DataFrame:
    """Items (row_id, text, requirement_id) with unit, limit, overlap and size.

    Without a requirement, with an unknown one or a null maximum, limit is null.
    """
    limits = requirements.where(F.col("requirement_id").isNotNull() & F.col("capacity_maximum").isNotNull()).select(
        "requirement_id", F.col("capacity_unit").alias("unit"),
        (F.col("capacity_maximum") - F.coalesce("capacity_margin", F.lit(0))).alias("limit"),
        F.coalesce("overlap_size", F.lit(0)).alias("overlap"), F.col("boundary_preference").alias("preference"))
    joined = items.join(broadcast_if_small(limits), "requirement_id", "left")
    return joined.withColumn("size", size_column(F.col("text"), F.col("unit")))


def split_oversized(items: DataFrame, requirements: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of every item that is larger than its requirement allows.

    ``items``: row_id, text, requirement_id.  Result: PIECES; items within their limit,
    without one, and null texts give no rows.  Equal rows sent twice count once; two
    texts under one row_id are both split.  Sizes are computed in the JVM; only oversized
    texts go to Python, where boundaries need look-around over the whole text.
    """
    large = with_limits(items, requirements).where("size > limit").withColumn("_d", F.md5("text")).dropDuplicates(["row_id", "requirement_id", "_d"])
    names = [c.split()[0] for c in PIECES.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                cuts = split_text(r.text, r.unit, int(r.limit), int(r.overlap), None if r.preference is None else list(r.preference))
                cost = _costs(r.text, r.unit)
                for i, (a, b, s) in enumerate(cuts):
                    before = cuts[i - 1][1] if i else a
                    cut = KINDS[s] if b < len(r.text) else "end"
                    rows.append((r.row_id, i, len(cuts), a, b, int(cost[before] - cost[a]), int(cost[b] - cost[a]), int(r.limit), cut, r.text[a:b] if with_text else None))
            yield pd.DataFrame(rows, columns=names)

    return large.select("row_id", "text", "unit", "limit", "overlap", "preference").mapInPandas(split, PIECES)
