"""Corpus scoring: multiset matches, precision and recall, calibration, corrections, resampling."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_counts(gold: DataFrame, pred: DataFrame, unit: list[str], criteria: dict[str, list[str]]) -> DataFrame:
    """(unit, criterion, gold, pred, matched): per key, the smaller of both counts matches.

    Null keys compare equal.  Units present on one side only count with zero on the other.
    """
    sides = gold.withColumn("_g", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(pred.withColumn("_g", F.lit(0)).withColumn("_p", F.lit(1)))
    keys = list(dict.fromkeys(k for ks in criteria.values() for k in ks))
    kinds = dict(sides.dtypes)
    # Every row once for each criterion, so that one shuffle serves them all.
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("criterion"), *[(F.col(k) if k in ks else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for name, ks in criteria.items()]))
    per = sides.select(*unit, each.alias("_k"), "_g", "_p").groupBy(*unit, "_k").agg(F.sum("_g").alias("g"), F.sum("_p").alias("p"))
    return per.groupBy(*unit, F.col("_k.criterion").alias("criterion")).agg(
        F.sum("g").alias("gold"), F.sum("p").alias("pred"), F.sum(F.least("g", "p")).alias("matched"))


def with_prf(counts: DataFrame, empty_is_one: bool = False) -> DataFrame:
    """precision, recall and f1 of (gold, pred, matched).

    0/0 counts as 0, or, with ``empty_is_one``, as 1 where both sides are empty.
    """
    both = (F.col("gold") == 0) & (F.col("pred") == 0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    whole = lambda c: F.when(both, F.lit(1.0)).otherwise(c) if empty_is_one else c
    p, r = whole(ratio(F.col("matched"), F.col("pred"))), whole(ratio(F.col("matched"), F.col("gold")))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro(counts: DataFrame, by: list[str] = ["criterion"]) -> DataFrame:  # noqa: B006
    return with_prf(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "matched")]))


def macro(counts: DataFrame, by: list[str] = ["criterion"]) -> DataFrame:  # noqa: B006
    return with_prf(counts).groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Per bin of equal width (the last closed): count, mean confidence, accuracy, gap."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    per = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return per.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def calibration_error(per_bin: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Expected and maximum calibration error."""
    return per_bin.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def holm(tests: DataFrame, key: str, p: str = "p_value", family: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``adjusted``: Holm's step-down correction within a family of tests."""
    w = Window.partitionBy(*family).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*family))
    scaled = (m - F.row_number().over(w) + 1) * F.col(p)
    out = tests.withColumn("_s", scaled)
    return out.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two half-open spans; 0 if both are empty."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(inter.cast("double"), (a1 - a0) + (b1 - b0) - inter), F.lit(0.0))


def soft_matches(gold: DataFrame, pred: DataFrame, unit: str, threshold: float = 0.5) -> DataFrame:
    """(unit, gold, pred, matched): most pairs of spans with IoU of at least ``threshold``, each span used once.

    Maximum bipartite matching by augmenting paths, per document; Python because an
    augmentation depends on all earlier ones.
    """
    def most(golds, preds) -> int:
        # A pair that overlaps enough shares more than a sliver: by begin, only a stretch of the other side can.
        begins = [c for c, _ in preds]  # sorted
        longest = max((d - c for c, d in preds), default=0)
        edges = []
        for a, b in golds:
            row = []
            for k in range(bisect_left(begins, a - longest), bisect_right(begins, b)):
                c, d = preds[k]
                inter = max(0, min(b, d) - max(a, c))
                whole = (b - a) + (d - c) - inter
                if whole > 0 and inter / whole >= threshold:
                    row.append(k)
            edges.append(row)
        owner: dict[int, int] = {}

        def grow(first: int) -> bool:
            """Find an augmenting path from a free span, and swap along it; ``came`` tells how each other span was reached."""
            came: dict[int, int] = {}
            waiting = [first]
            while waiting:
                i = waiting.pop()
                for k in edges[i]:
                    if k in came:
                        continue
                    came[k] = i
                    if k in owner:
                        waiting.append(owner[k])
                        continue
                    while True:
                        i = came[k]
                        given_up = held.get(i)
                        owner[k], held[i] = i, k
                        if given_up is None:
                            return True
                        k = given_up
            return False

        held: dict[int, int] = {}
        return sum(grow(i) for i in range(len(edges)))

    @F.pandas_udf("bigint")
    def matched(g0: pd.Series, g1: pd.Series, p0: pd.Series, p1: pd.Series) -> pd.Series:
        return pd.Series([most(list(zip(a, b)), list(zip(c, d))) for a, b, c, d in zip(g0, g1, p0, p1)])

    # One row a document, so that documents travel in batches rather than one by one.
    side = lambda df, s: df.select(unit, F.lit(s).alias("side"), F.col("start_pos").cast("bigint").alias("s"), F.col("stop_pos").cast("bigint").alias("e"))
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("s", "e"))))
    rows = side(gold, "g").unionByName(side(pred, "p")).groupBy(unit).agg(of("g").alias("g"), of("p").alias("p"))
    return rows.select(unit, F.size("g").cast("bigint").alias("gold"), F.size("p").cast("bigint").alias("pred"), matched("g.s", "g.e", "p.s", "p.e").alias("matched"))


def bootstrap(scores: DataFrame, unit: str, a: str = "a", b: str = "b", rounds: int = 1000, seed: int = 13) -> DataFrame:
    """Paired bootstrap of the mean difference a - b over units: low, high (2.5 and 97.5 %), two-sided p.

    Each unit is drawn a Poisson(1) number of times a round, by a hash of unit, round and
    seed, so a round needs no order and no collection; the result does not depend on
    partitions.
    """
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("round"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    bounds, total, p = [], 0.0, 0.36787944117144233  # e^-1
    for k in range(9):
        total += p
        bounds.append(total)
        p /= k + 1
    times = reduce(lambda acc, x: acc + (u > x).cast("int"), bounds, F.lit(0))
    drawn = scores.select(unit, (F.col(a) - F.col(b)).alias("d")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = drawn.withColumn("k", times).groupBy("round").agg((F.sum(F.col("k") * F.col("d")) / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    tail = F.least((F.count(F.when(F.col("m") <= 0, 1)) + 1) / F.lit(float(rounds + 1)), (F.count(F.when(F.col("m") >= 0, 1)) + 1) / F.lit(float(rounds + 1)))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * tail).alias("p_value"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, which is at least 1e-6."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.greatest(F.lit(1e-6), F.stddev_pop(c)).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "ms"])


def signal_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, criterion, gold, pred, matched) of signals (keys, edge_id, signal_type, signal_subtype, tokens).

    Criteria: detection by edge, type, subtype (both in any case), and token by
    incidence of tokens and edge.  Signals without an edge match nothing but stay in the
    counts.  A signal's repeated token counts once.
    """
    def rows(df: DataFrame, side: str) -> DataFrame:
        base = df.select(*keys, "edge_id", F.lower("signal_type").alias("t"), F.lower("signal_subtype").alias("st"), F.array_distinct(F.coalesce("tokens", F.array().cast("array<bigint>"))).alias("tokens"))
        none = F.lit(None).cast("string")
        kinds = [("detection", none, none), ("type", F.col("t"), none), ("subtype", F.col("t"), F.col("st"))]
        whole = base.select(*keys, "edge_id", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), a.alias("a"), b.alias("b")) for c, a, b in kinds])).alias("x")).select(*keys, "edge_id", "x.*")
        token = base.select(*keys, "edge_id", F.lit("token").alias("criterion"), F.explode(F.col("tokens").cast("array<string>")).alias("a"), none.alias("b"))
        return whole.unionByName(token).groupBy(*keys, "criterion", "edge_id", "a", "b").agg(F.count("*").alias(side))

    both = rows(gold, "g").withColumn("p", F.lit(0)).unionByName(rows(pred, "p").withColumn("g", F.lit(0)))
    one = both.groupBy(*keys, "criterion", "edge_id", "a", "b").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return one.groupBy(*keys, "criterion").agg(
        F.sum("g").alias("gold"), F.sum("p").alias("pred"), F.sum(F.when(F.col("edge_id").isNotNull(), F.least("g", "p")).otherwise(0)).alias("matched"))


def location_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, criterion, gold, pred, matched) of signals by their set of tokens: location, location_type, location_subtype; those without tokens as 'unanchored', never matched."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        at = F.array_join(F.sort_array(F.coalesce("tokens", F.array().cast("array<bigint>"))), ",")
        base = df.select(*keys, at.alias("at"), "signal_type", "signal_subtype")
        none = F.lit(None).cast("string")
        kinds = [("location", none, none), ("location_type", F.col("signal_type"), none), ("location_subtype", F.col("signal_type"), F.col("signal_subtype"))]
        found = base.where("at <> ''").select(*keys, "at", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), a.alias("a"), b.alias("b")) for c, a, b in kinds])).alias("x")).select(*keys, "at", "x.*")
        loose = base.where("at = ''").select(*keys, "at", F.lit("unanchored").alias("criterion"), none.alias("a"), none.alias("b"))
        return found.unionByName(loose).groupBy(*keys, "criterion", "at", "a", "b").agg(F.count("*").alias(side))

    both = rows(gold, "g").withColumn("p", F.lit(0)).unionByName(rows(pred, "p").withColumn("g", F.lit(0)))
    one = both.groupBy(*keys, "criterion", "at", "a", "b").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return one.groupBy(*keys, "criterion").agg(
        F.sum("g").alias("gold"), F.sum("p").alias("pred"), F.sum(F.when(F.col("criterion") != "unanchored", F.least("g", "p")).otherwise(0)).alias("matched"))


def concept_metrics(gold: DataFrame, pred: DataFrame, place: list[str]) -> DataFrame:
    """One row of counts and rates of mentions: ``gold`` (place, target or null), ``pred`` (place, targets array), each place once.

    A rate without a denominator is null.
    """
    both = gold.withColumn("_g", F.lit(1)).join(pred.withColumn("_p", F.lit(1)), place, "full")
    hit = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    counts = both.agg(
        n(F.col("_p") == 1).alias("predicted"), n(F.col("_g") == 1).alias("gold"), n(hit).alias("correct"), n(F.col("target").isNotNull()).alias("canonical"),
        n(hit & F.array_contains("targets", F.col("target"))).alias("canonical_correct"), n(F.size("targets") > 1).alias("ambiguous"), n(F.col("_g").isNull()).alias("spurious"),
        n(F.size("targets") == 0).alias("unmapped"))
    return counts.select("*", F.try_divide("correct", "predicted").alias("precision"), F.try_divide("correct", "gold").alias("recall"), F.try_divide("canonical_correct", "canonical").alias("canonical_recall"))


def temperature(rows: DataFrame, scores: str = "scores", target: str = "target", rounds: int = 60) -> float | None:
    """The temperature that makes the targets (0-based places in the arrays of scores) likeliest; None without rows.

    The likelihood is concave in the inverse temperature, so Newton steps kept inside a
    bracket find its only root of slope.  A round is one aggregation; only sums come back.
    """
    known = rows.where(F.col(target).isNotNull() & (F.size(scores) > 0)).select(F.transform(scores, lambda x: x.cast("double")).alias("s"), F.col(target).cast("int").alias("t"))
    add = lambda a, x: a + x
    low, high, beta = 1e-3, 1e3, 1.0
    for _ in range(rounds):
        b = F.lit(beta)
        weight = F.transform("s", lambda x: F.exp(b * (x - F.array_max("s"))))
        rows_ = known.select("s", "t", weight.alias("w")).withColumn("z", F.aggregate("w", F.lit(0.0), add))
        mean = F.aggregate(F.zip_with("s", "w", lambda x, w: x * w), F.lit(0.0), add) / F.col("z")
        square = F.aggregate(F.zip_with("s", "w", lambda x, w: x * x * w), F.lit(0.0), add) / F.col("z")
        slope, bend, n = rows_.select(F.get("s", F.col("t")).alias("own"), mean.alias("m"), square.alias("q")).agg(F.sum(F.col("own") - F.col("m")), F.sum(F.col("q") - F.col("m") * F.col("m")), F.count("*")).first()
        if not n:
            return None
        if slope > 0:
            low = beta
        else:
            high = beta
        step = beta + slope / bend if bend > 0 else beta
        new = step if low < step < high else (low * high) ** 0.5
        if abs(new - beta) <= 1e-9 * beta:
            break
        beta = new
    return 1 / beta
