"""Dialogue commitments, deliberation maps, typed annotations and centering, as windows and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_proposition(text: Column) -> Column:
    squeezed = F.trim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))
    return F.regexp_replace(squeezed, "[.!;]+$", "")


# Prefixes that negate what follows.
NEGATING = ("not ", "it is false that ", "it is not the case that ")


def negations(key: Column) -> Column:
    """All canonical propositions that negate, or are negated by, ``key``."""
    forms = [F.concat(F.lit(p), key) for p in NEGATING]
    forms += [F.when(key.startswith(p), F.substring(key, F.lit(len(p) + 1), F.length(key))) for p in NEGATING]
    for verb in (" is ", " does "):
        no = f"{verb.rstrip()} not "
        at, plain = F.instr(key, no), F.instr(key, verb)
        forms.append(F.when(at > 0, F.concat(F.substring(key, F.lit(1), at - 1), F.lit(verb), F.substring(key, at + len(no), F.length(key)))))
        # The negated form's first "<verb> not" must be the one put in.
        forms.append(F.when((plain > 0) & ((at == 0) | (at >= plain)), F.concat(F.substring(key, F.lit(1), plain - 1), F.lit(no), F.substring(key, plain + len(verb), F.length(key)))))
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "") & (x != key)))


def _lives(acts: DataFrame) -> DataFrame:
    """(conv, speaker, key, begin, stop, act_id, content): how long each commitment held.

    It begins with the first assertion or concession after a retraction of the key and
    stops at the next retraction (null: never).
    """
    moves = acts.where("op in ('assert', 'concede')").select("conv", "speaker", "ord", "act_id", "content", canonical_proposition(F.col("content")).alias("key"), F.lit(0).alias("out"))
    back = acts.where("op = 'retract' and target is not null").select("conv", "speaker", "ord", "act_id", F.col("target").alias("content"), canonical_proposition(F.col("target")).alias("key"), F.lit(1).alias("out"))
    w = Window.partitionBy("conv", "speaker", "key").orderBy("ord")
    epochs = moves.unionByName(back).withColumn("epoch", F.sum("out").over(w) - F.col("out"))
    return epochs.groupBy("conv", "speaker", "key", "epoch").agg(
        F.min(F.when(F.col("out") == 0, F.struct("ord", "act_id", "content"))).alias("b"), F.min(F.when(F.col("out") == 1, F.col("ord"))).alias("stop")
    ).where("b is not null").select("conv", "speaker", "key", F.col("b.ord").alias("begin"), "stop", F.col("b.act_id").alias("act_id"), F.col("b.content").alias("content"))


def active_commitments(acts: DataFrame) -> DataFrame:
    """What each speaker is committed to at the end, as first put since the last retraction."""
    return _lives(acts).where("stop is null").select("conv", "speaker", "key", "act_id", "content")


def commitment_conflicts(acts: DataFrame) -> DataFrame:
    """(conv, speaker, earlier_act, later_act): an act against a commitment that still held."""
    later = acts.where("op in ('assert', 'concede')").select("conv", "speaker", F.col("ord").alias("at"), F.col("act_id").alias("later_act"), F.explode(negations(canonical_proposition(F.col("content")))).alias("key"))
    held = _lives(acts)
    return later.join(held, ["conv", "speaker", "key"]).where("begin < at and (stop is null or at < stop)").select("conv", "speaker", F.col("act_id").alias("earlier_act"), "later_act")


# Which relation may link which kinds.
IBIS_GRAMMAR = [
    ("responds_to", "position", "issue"), ("supports", "argument", "position"), ("objects_to", "argument", "position"),
    ("generalizes", "issue", "issue"), ("specializes", "issue", "issue"), ("questions", "issue", "issue"), ("questions", "issue", "position"),
    ("questions", "issue", "argument"), ("is_suggested_by", "issue", "issue"), ("is_suggested_by", "issue", "position"), ("is_suggested_by", "issue", "argument"), ("replaces", "issue", "issue"),
]


def ibis_violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(map_id, rule, detail) over nodes (map_id, id, kind) and links (map_id, source, relation, target)."""
    grammar = nodes.sparkSession.createDataFrame(IBIS_GRAMMAR, "relation string, sk string, tk string")
    kinds = lambda a, b: nodes.select("map_id", F.col("id").alias(a), F.col("kind").alias(b)).dropDuplicates(["map_id", a])
    typed = links.join(kinds("source", "sk"), ["map_id", "source"], "left").join(kinds("target", "tk"), ["map_id", "target"], "left")
    name = F.concat_ws(" ", "source", "relation", "target")
    rule = lambda df, n, detail: df.select("map_id", F.lit(n).alias("rule"), detail.alias("detail"))
    out = links.where("relation in ('responds_to', 'supports', 'objects_to')").groupBy("map_id", F.col("source").alias("id")).agg(F.count("*").alias("n"))
    parts = [
        rule(nodes.groupBy("map_id", "id").count().where("count > 1"), "repeated_id", F.col("id")),
        rule(typed.where("sk is null or tk is null"), "unknown_endpoint", name),
        rule(typed.where("sk is not null and tk is not null").join(F.broadcast(grammar), ["relation", "sk", "tk"], "left_anti"), "not_in_grammar", name),  # a literal table
        rule(links.where("source = target"), "self_link", name),
        rule(links.groupBy("map_id", "source", "relation", "target").count().where("count > 1"), "repeated_link", name),
        rule(nodes.where("kind in ('position', 'argument')").join(out, ["map_id", "id"], "left").where("coalesce(n, 0) <> 1"), "not_attached_once", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def deliberation_map(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(map_id, issue, position, supporting, objecting): sorted ids, positions without arguments included."""
    pos = links.where("relation = 'responds_to'").select("map_id", F.col("target").alias("issue"), F.col("source").alias("position"))
    arg = links.where("relation in ('supports', 'objects_to')").groupBy("map_id", F.col("target").alias("position")).agg(
        F.sort_array(F.collect_list(F.when(F.col("relation") == "supports", F.col("source")))).alias("supporting"),
        F.sort_array(F.collect_list(F.when(F.col("relation") == "objects_to", F.col("source")))).alias("objecting"))
    issues = nodes.where("kind = 'issue'").select("map_id", F.col("id").alias("issue"))
    return issues.join(pos, ["map_id", "issue"], "left").join(arg, ["map_id", "position"], "left").select("map_id", "issue", "position", "supporting", "objecting")


def deliberation_gaps(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(map_id, gap, id): issues without positions, positions without arguments, and nodes without any link."""
    ids = lambda c: links.select("map_id", F.col(c).alias("id"))
    lacks = lambda kind, relations: nodes.where(F.col("kind") == kind).join(links.where(F.col("relation").isin(*relations)).select("map_id", F.col("target").alias("id")), ["map_id", "id"], "left_anti")
    gap = lambda df, name: df.select("map_id", F.lit(name).alias("gap"), "id").distinct()
    return gap(lacks("issue", ["responds_to"]), "issue_without_position").unionByName(gap(lacks("position", ["supports", "objects_to"]), "position_without_argument")).unionByName(
        gap(nodes.join(ids("source").unionByName(ids("target")), ["map_id", "id"], "left_anti"), "isolated_node"))


def type_counts(rows: DataFrame, by: list[str], column: str, types: list[str]) -> DataFrame:
    """Counts of all ``types`` per group, zero where a type is absent."""
    return rows.groupBy(*by).agg(*[F.count(F.when(F.col(column) == t, 1)).alias(t) for t in types]).select(
        *by, F.explode(F.array(*[F.struct(F.lit(t).alias(column), F.col(t).alias("n")) for t in types])).alias("x")).select(*by, f"x.{column}", "x.n")


def question_rollup(questions: DataFrame, by: list[str]) -> DataFrame:
    """Open, addressed and not assessable critical questions per group."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return questions.groupBy(*by).agg(n("open", "undercut", "challenged").alias("open"), n("addressed").alias("addressed"), n("not_assessable").alias("not_assessable"))


# --- centering ------------------------------------------------------------------------

WEIGHTS = {"continue": 1.0, "retain": 0.75, "smooth_shift": 0.5, "rough_shift": 0.15}  # fixed values


def forward_centers(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, u, cf): entities of an utterance by best role (S, O, X), then first place.

    ``mentions``: doc, u, entity, role, start_pos.
    """
    rank = F.when(F.col("role") == "S", 0).when(F.col("role") == "O", 1).otherwise(2)
    best = mentions.groupBy(doc, "u", "entity").agg(F.min(F.struct(rank.alias("r"), F.col("start_pos").alias("p"))).alias("b"))
    return best.groupBy(doc, "u").agg(F.sort_array(F.collect_list(F.struct("b.r", "b.p", "entity"))).alias("x")).select(doc, "u", F.col("x.entity").alias("cf"))


def transitions(utterances: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds cp, cb and transition to (doc, u, cf); utterances without mentions have an empty cf.

    cb is the highest earlier center realised again.  Without an earlier cb, the earlier
    cf's first counts as the one to compare with.
    """
    w = Window.partitionBy(doc).orderBy("u")
    prev = F.lag("cf").over(w)
    rows = utterances.withColumn("prev", prev).withColumn("first", F.row_number().over(w) == 1)
    hit = F.filter("prev", lambda x: F.array_contains("cf", x))
    rows = rows.withColumn("cb", F.when(F.size(F.coalesce("prev", F.array())) > 0, F.get(hit, F.lit(0)))).withColumn("cp", F.get("cf", F.lit(0)))
    before = F.coalesce(F.lag("cb").over(w), F.get("prev", F.lit(0)))
    rows = rows.withColumn("before", before)
    same, top = F.col("cb") == F.col("before"), F.col("cb") == F.col("cp")
    start = F.col("first") | (F.size(F.coalesce("prev", F.array())) == 0)
    kind = (F.when(start, F.when(F.size("cf") > 0, "establishment").otherwise("zero_cb")).when(F.col("cb").isNull(), "zero_cb")
            .when(same & top, "continue").when(same, "retain").when(top, "smooth_shift").otherwise("rough_shift"))
    return rows.withColumn("transition", kind).select(doc, "u", "cf", "cp", "cb", "transition")


def coherence(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts of transitions and the local coherence score, 0 to 1, to four places."""
    n = lambda t: F.count(F.when(F.col("transition") == t, 1))
    per = rows.groupBy(doc).agg(F.count("*").alias("utterances"), *[n(t).alias(t) for t in (*WEIGHTS, "zero_cb", "establishment")])
    scored = sum((F.col(t) for t in WEIGHTS), F.lit(0)) + F.when(F.col("utterances") > 1, F.col("zero_cb")).otherwise(0)
    value = sum((F.col(t) * v for t, v in WEIGHTS.items()), F.lit(0.0))
    return per.withColumn("coherence", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(value, scored), F.lit(1.0)))), 4))
