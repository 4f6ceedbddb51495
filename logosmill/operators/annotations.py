"""Typed annotations: contracts as violation tables, roll-ups, licensed edges, views, combined outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small

# Communicative functions of each class of speech act.
ACT_FUNCTIONS = {
    "assertive": "inform agreement disagreement correction answer confirm disconfirm", "directive": "question request instruct suggest",
    "commissive": "promise offer threat", "expressive": "apology thank congratulate", "declaration": "declare",
}
# Relation types, and the evidence a type must carry and alone may carry.
RELATION_TYPES = ["Explicit", "Implicit", "AltLex", "AltLexC", "EntRel", "Hypophora", "NoRel"]
RELATION_EVIDENCE = {"Explicit": "connective_spans", "Implicit": "inferred_connectives", "AltLex": "alternative_spans", "AltLexC": "alternative_spans"}


def _rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule whose condition holds; one pass over the rows."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(names).alias("rule"))


def act_violations(acts: DataFrame, key: str = "act_id") -> DataFrame:
    """Acts (key, searle_class, function, operation, target) that break their class's contract."""
    allowed = reduce(lambda a, b: a | b, [(F.col("searle_class") == k) & F.col("function").isin(*v.split()) for k, v in ACT_FUNCTIONS.items()])
    aims = F.col("operation").isin("retract", "challenge")
    return _rules(acts, [key], {
        "unknown_class": ~F.coalesce(F.col("searle_class").isin(*ACT_FUNCTIONS), F.lit(False)),
        "function_not_of_class": F.col("searle_class").isin(*ACT_FUNCTIONS) & ~F.coalesce(allowed, F.lit(False)),
        "target_missing": aims & F.col("target").isNull(), "target_not_allowed": ~aims & F.col("target").isNotNull()})


def relation_violations(relations: DataFrame, key: str = "relation_id") -> DataFrame:
    """Relations (key, relation_type, senses, arg1, arg2, and the three kinds of evidence) that break their type's contract.

    Arguments and spans are arrays of struct<start,stop>.
    """
    n = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    kinds = sorted(set(RELATION_EVIDENCE.values()))
    kind = F.create_map(*[F.lit(x) for p in RELATION_EVIDENCE.items() for x in p])[F.col("relation_type")]
    bears = F.col("relation_type").isin(*RELATION_EVIDENCE)
    hit = lambda a, b: F.exists(F.coalesce(F.col(a), F.array().cast(relations.schema[a].dataType)), lambda x: F.exists(F.coalesce(F.col(b), F.array().cast(relations.schema[b].dataType)), lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))
    lacks = reduce(lambda a, b: a | b, [(kind == k) & (n(k) == 0) for k in kinds])
    extra = reduce(lambda a, b: a | b, [(n(k) > 0) & ~F.coalesce(kind == k, F.lit(False)) for k in kinds])
    return _rules(relations, [key], {
        "unknown_type": ~F.coalesce(F.col("relation_type").isin(*RELATION_TYPES), F.lit(False)),
        "arguments_overlap": hit("arg1", "arg2"), "repeated_sense": n("senses") != F.size(F.array_distinct(F.coalesce(F.col("senses"), F.array().cast("array<string>")))),
        "sense_missing": bears & (n("senses") == 0), "sense_not_allowed": ~bears & (n("senses") > 0), "evidence_missing": lacks, "evidence_not_allowed": extra,
        "connective_in_argument": (F.col("relation_type") == "Explicit") & (hit("connective_spans", "arg1") | hit("connective_spans", "arg2"))})


def not_catalogued(rows: DataFrame, catalogue: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Rows whose combination of values ``on`` isn't in the catalogue; nulls count as values."""
    cond = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in on])
    return rows.alias("r").join(catalogue.alias("c"), cond, "left_anti").select(*keys, *[c for c in on if c not in keys])


def layout_rollup(layouts: DataFrame, keys: list[str]) -> DataFrame:
    """Elements present of (claim, grounds, warrant, backing, qualifier, rebuttals), in that order, and whether the claim is qualified."""
    has = {
        "claim": F.col("claim").isNotNull(), "grounds": F.size("grounds") > 0, "warrant": F.col("warrant").isNotNull(), "backing": F.size("backing") > 0,
        "qualifier": F.col("qualifier").isNotNull(), "rebuttals": F.size("rebuttals") > 0}
    present = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()]), lambda x: x.isNotNull())
    return layouts.select(*keys, F.array_join(present, ",").alias("elements"), (F.coalesce(has["qualifier"], F.lit(False)) | F.coalesce(has["rebuttals"], F.lit(False))).alias("is_qualified"))


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, values): distinct values in the order they first come."""
    one = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return one.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value].cast("string")), ",").alias("values"))


def licensed_edges(candidates: DataFrame, inventory: DataFrame, maximum_distance: int, licensed: float = 0.9, fallback: float = 0.1) -> DataFrame:
    """Adds edge_p and relation to candidates (…, relations array, distance, has_signal).

    ``inventory``: relation, n.  The most frequent compatible relation counts, ties to the
    greater name; without one, the most frequent of all.
    """
    best = F.array_max(F.filter(F.transform("relations", lambda r: F.struct(F.col("_counts")[r].alias("n"), r.alias("r"))), lambda x: x["n"].isNotNull()))
    table = inventory.agg(F.map_from_entries(F.collect_list(F.struct("relation", "n"))).alias("_counts"), F.max(F.struct("n", "relation"))["relation"].alias("_default"))
    rows = candidates.crossJoin(F.broadcast(table)).withColumn("_best", best)  # one row: the inventory of relation names
    ok = F.col("has_signal") & F.col("_best").isNotNull() & (F.abs("distance") <= maximum_distance)
    return rows.withColumn("edge_p", F.when(ok, licensed).otherwise(fallback)).withColumn("relation", F.coalesce(F.col("_best.r"), F.col("_default"))).drop("_counts", "_default", "_best")


def view(outcomes: DataFrame, alignments: DataFrame, selected: list[str], key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept outcomes, kept alignments, excluded techniques per document)."""
    keep = F.col("technique").isin(*selected)
    return outcomes.where(keep), alignments.where(keep), outcomes.where(~keep).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("technique")), ",").alias("excluded"))


def combined(outcomes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, results, failures): complete if all techniques gave a result, partial if some did, else unsuccessful."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    per = outcomes.groupBy(key).agg(n("result").alias("results"), (F.count("*") - n("result")).alias("failures"))
    return per.select(key, F.when(F.col("failures") == 0, "complete").when(F.col("results") > 0, "partial").otherwise("unsuccessful").alias("status"), "results", "failures")


def derivable(outcomes: DataFrame, needs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, consumer) of derivations all of whose sources (consumer, technique) gave a result."""
    wanted = needs.groupBy("consumer").agg(F.countDistinct("technique").alias("n"))
    have = outcomes.where("kind = 'result'").select(key, "technique").distinct().join(needs, "technique").groupBy(key, "consumer").agg(F.countDistinct("technique").alias("m"))
    return have.join(wanted, "consumer").where("m = n").select(key, "consumer")


def hardest_negatives(rows: DataFrame, by: list[str], key: str, hardness: str, ratio: float) -> DataFrame:
    """All positives and, per group, the floor(positives * ratio) hardest negatives; ties by digest."""
    n = rows.groupBy(*by).agg(F.count(F.when(F.col("label"), 1)).alias("_p"))
    w = Window.partitionBy(*by, "label").orderBy(F.desc(hardness), F.sha2(F.col(key).cast("string"), 256))
    return rows.join(n, by).withColumn("_r", F.row_number().over(w)).where(F.col("label") | (F.col("_r") <= F.floor(F.col("_p") * ratio))).drop("_p", "_r")


def dispatched(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Requests (technique, structured, formalism, ...) with ``outcome`` and ``reason``: what can run, and why the rest cannot.

    ``capabilities``: technique, state, formalisms array, needs_structured.  Reasons, the
    first that holds: not_implemented, the state if it isn't 'available',
    structured_input_required, structured_input_refused, formalism_unsupported.
    """
    known = capabilities.dropDuplicates(["technique"]).withColumn("_k", F.lit(True))
    rows = requests.join(broadcast_if_small(known), "technique", "left")
    given = F.coalesce("structured", F.lit(False))
    reason = (
        F.when(F.col("_k").isNull(), "not_implemented").when(F.col("state") != "available", F.col("state")).when(F.col("needs_structured") & ~given, "structured_input_required")
        .when(~F.col("needs_structured") & given, "structured_input_refused").when(F.col("formalism").isNotNull() & ~F.array_contains("formalisms", F.col("formalism")), "formalism_unsupported"))
    return rows.select(*requests.columns, F.when(reason.isNull(), "ready").otherwise("unavailable").alias("outcome"), reason.alias("reason"))


def summary_lines(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line) of outcomes (key, technique, kind, formalism, code): a head with counts, then one line an outcome by technique."""
    line = (F.when(F.col("kind") == "result", F.concat(F.col("technique"), F.lit(": result; formalism="), F.coalesce("formalism", F.lit("(none)"))))
            .when(F.col("kind") == "failed", F.concat(F.col("technique"), F.lit(": failed; "), F.coalesce("code", F.lit("(none)"))))
            .otherwise(F.concat(F.col("technique"), F.lit(": unavailable; "), F.coalesce("code", F.lit("(none)")))))
    done = F.count(F.when(F.col("kind") == "result", 1))
    status = F.when(done == F.count("*"), "complete").when(done > 0, "partial").otherwise("unsuccessful")
    rows = outcomes.groupBy(key).agg(F.concat(F.lit("requested: "), F.count("*").cast("string"), F.lit("; status: "), status).alias("head"), F.sort_array(F.collect_list(F.struct("technique", line.alias("l")))).alias("ls"))
    return rows.select(key, F.posexplode(F.concat(F.array("head"), F.transform("ls", lambda x: x["l"]))).alias("line_no", "line"))


def resolved_labels(labels: DataFrame, coarse: DataFrame, aliases: DataFrame, categories: DataFrame) -> DataFrame:
    """``labels`` (label, ...) with ``concept`` and ``by``: found as a coarse label, as a fine one through its alias, or by the category before its first hyphen; null where none knows it.

    ``coarse``: label, concept.  ``aliases``: fine, label.  ``categories``: category, concept.  All are small tables.
    """
    low = labels.withColumn("_l", F.lower(F.trim("label")))
    one = lambda df, c, name: df.select(F.lower(F.trim(c)).alias(name), *[x for x in df.columns if x != c]).dropDuplicates([name])
    a = one(coarse, "label", "_l").withColumnRenamed("concept", "_c1")
    b = one(aliases.select("fine", F.lower(F.trim("label")).alias("_to")), "fine", "_l").join(one(coarse, "label", "_to").withColumnRenamed("concept", "_c2"), "_to").select("_l", "_c2")
    c = one(categories, "category", "_cat").withColumnRenamed("concept", "_c3")
    out = low.withColumn("_cat", F.substring_index("_l", "-", 1)).join(broadcast_if_small(a), "_l", "left").join(broadcast_if_small(b), "_l", "left").join(broadcast_if_small(c), "_cat", "left")
    by = F.when(F.col("_c1").isNotNull(), "coarse").when(F.col("_c2").isNotNull(), "alias").when(F.col("_c3").isNotNull(), "category")
    return out.select(*labels.columns, F.coalesce("_c1", "_c2", "_c3").alias("concept"), by.alias("by"))
