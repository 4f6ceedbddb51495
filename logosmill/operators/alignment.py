"""From findings to sources and labels to concepts: anchors, supplied candidates, vocabularies, speakers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.operators.substrate import overlapping_spans


def clipped_anchors(spans: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, span_id, segment_id, anchor_start, anchor_stop): the anchors in the source of spans of prepared text.

    ``spans``: key, span_id, start_pos, stop_pos.  ``segments``: key, segment_id,
    start_pos, stop_pos, transformed, anchor_start, anchor_stop.  An anchor is narrowed
    to the overlap only where the segment is untransformed and as long as its anchor;
    else the whole anchor stands.  Null offsets overlap nothing.
    """
    hit = overlapping_spans(spans, segments, key)
    same = ~F.coalesce("b_transformed", F.lit(False)) & ((F.col("b_stop_pos") - F.col("b_start_pos")) == (F.col("b_anchor_stop") - F.col("b_anchor_start")))
    begin = F.col("b_anchor_start") + F.greatest(F.lit(0), F.col("a_start_pos") - F.col("b_start_pos"))
    end = F.col("b_anchor_stop") - F.greatest(F.lit(0), F.col("b_stop_pos") - F.col("a_stop_pos"))
    return hit.select(
        key, F.col("a_span_id").alias("span_id"), F.col("b_segment_id").alias("segment_id"), F.when(same, begin).otherwise(F.col("b_anchor_start")).alias("anchor_start"),
        F.when(same, end).otherwise(F.col("b_anchor_stop")).alias("anchor_stop"))


def unique_anchors(anchors: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group's anchors once, in order of their first appearance: adds ``place`` (from 0) to (keys, anchor columns)."""
    rest = [c for c in anchors.columns if c not in (*keys, order)]
    once = anchors.groupBy(*keys, *rest).agg(F.min(order).alias("_o"))
    placed = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", *rest))).alias("_a"))
    return placed.select(*keys, F.posexplode("_a").alias("place", "_x")).select(*keys, "place", *[F.col(f"_x.{c}").alias(c) for c in rest])


def quote_alignment(quotes: DataFrame, documents: DataFrame, segments: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, quote_id, start_pos, segment_id) of all literal occurrences of quotes, overlapping ones included, on the segments they touch.

    ``quotes``: key, quote_id, quote.  An empty or null quote occurs nowhere.
    """
    rows = quotes.where(F.length("quote") > 0).join(documents.select(key, F.col(text).alias("_t")), key).where(F.instr(F.col("_t"), F.col("quote")) > 0)
    # A part begins at every occurrence, also one that overlaps the one before; only the first part may begin without one.
    literal = F.concat(F.lit("(?=\\Q"), F.replace(F.col("quote"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    parts = rows.select(key, "quote_id", F.length("quote").alias("n"), F.startswith(F.col("_t"), F.col("quote")).alias("first"), F.posexplode(F.transform(F.split(F.col("_t"), literal, -1), F.length)).alias("i", "len"))
    w = Window.partitionBy(key, "quote_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("start_pos", F.coalesce(F.sum("len").over(w), F.lit(0))).where("i > 0 or first")
    hit = overlapping_spans(found.select(key, "quote_id", "start_pos", (F.col("start_pos") + F.col("n")).alias("stop_pos")), segments, key)
    return hit.select(key, F.col("a_quote_id").alias("quote_id"), F.col("a_start_pos").alias("start_pos"), F.col("b_segment_id").alias("segment_id"))


def resolved_candidates(supplied: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Supplied candidates with the concept of the mention at exactly their place and wording; resolution 'unmapped' where there is none.

    ``keys``: item, field, start, stop and quote columns of both; ``mentions`` has curies
    and resolution.  Several mentions at one place give the least curies; rows sent twice
    count once.
    """
    one = mentions.groupBy(*keys).agg(F.min(F.struct("curies", "resolution")).alias("_m"))
    return supplied.dropDuplicates(keys).join(one, keys, "left").select(*supplied.columns, F.col("_m.curies").alias("curies"), F.coalesce("_m.resolution", F.lit("unmapped")).alias("resolution"))


def unmet_speakers(sources: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """(key, unresolved, detail) of sources whose turns have unresolved speakers, or that have no turns at all.

    ``turns``: key, resolution (null counts as unresolved).
    """
    n = turns.groupBy(key).agg(F.count("*").alias("turns"), F.count(F.when(F.coalesce("resolution", F.lit("unresolved")) == "unresolved", 1)).alias("unresolved"))
    out = sources.select(key).distinct().join(n, key, "left").where("turns is null or unresolved > 0")
    return out.select(key, F.coalesce("unresolved", F.lit(0)).alias("unresolved"), F.when(F.col("turns").isNull(), "no_turns").otherwise("unresolved_turns").alias("detail"))


def observed_key(value: Column, rule: Column) -> Column:
    """The form of a label under its vocabulary's matching rule: exact_key, case_insensitive_label, rst_dt_coarse_group or rst_dt_corpus_label."""
    low = F.lower(value)
    stripped = F.regexp_replace(low, "-(?:n-e|s-e|e|n|s)$", "")
    corpus = (F.when(value != F.trim(value), value).when(low.isin("attribution-n", "attribution-n-e"), "attribution-negative")
              .when(stripped == "textualorganization", "textual-organization").otherwise(stripped))
    return F.when(rule == "rst_dt_corpus_label", corpus).when(rule.isin("case_insensitive_label", "rst_dt_coarse_group"), low).otherwise(value)


def observed_concepts(values: DataFrame, vocabulary: DataFrame, rule: str) -> DataFrame:
    """``values`` (value, ...) with concept_id, label and relationship of the vocabulary (key, concept_id, label, relationship); 'unmapped' where it has none."""
    return values.withColumn("key", observed_key(F.col("value"), F.lit(rule))).join(F.broadcast(vocabulary), "key", "left").select(
        *values.columns, "concept_id", "label", F.coalesce("relationship", F.lit("unmapped")).alias("relationship"))


def coarse_label(label: Column, families: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The family of a fine label: itself, or what stands before its first hyphen, through the aliases; null if that is no family."""
    low = F.lower(F.trim(label))
    known = [f.lower() for f in families]
    to = F.create_map(*[F.lit(x) for f in known for x in (f, (aliases or {}).get(f, f))])
    head = F.substring_index(low, "-", 1)
    return F.when(low.isin(*known), to[low]).when((F.length(low) > F.length(head) + 1) & head.isin(*known), to[head])


def first_seen_ids(mentions: DataFrame, key: str, entity: str, position: str, prefix: str = "ent_") -> DataFrame:
    """(key, entity, entity_id): entities of a document numbered from 1 in order of their first mention, ties by name."""
    first = mentions.where(F.col(entity).isNotNull()).groupBy(key, entity).agg(F.min(position).alias("_p"))
    ordered = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", F.col(entity).alias("e")))).alias("_s"))
    return ordered.select(key, F.posexplode("_s").alias("i", "x")).select(key, F.col("x.e").alias(entity), F.concat(F.lit(prefix), F.col("i") + 1).alias("entity_id"))


def order_violations(spans: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of spans that begin before the one before them in ``order`` ends."""
    before = F.lag("stop_pos").over(Window.partitionBy(key).orderBy(order))
    return spans.withColumn("_b", before).where("start_pos < _b").select(key, order)


def cue_interval(hours: Column, minutes: Column, seconds: Column, msecs: Column) -> Column:
    """Milliseconds of a cue's time; null without seconds, other missing parts count as zero."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return ((zero(hours) * 60 + zero(minutes)) * 60 + seconds.cast("bigint")) * 1000 + zero(msecs)


def figure_evidence(scheme: Column, quote: Column) -> Column:
    """The rule that a figure's quotation breaks: question_mark, repeated_word, or null."""
    words = F.regexp_extract_all(F.lower(quote), F.lit(r"([\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_]*)"), F.lit(1))
    repeated = F.size(F.array_distinct(words)) < F.size(words)
    return F.when((scheme == "rhetorical_question") & ~quote.rlike("[?？]"), "question_mark").when(scheme.isin("anaphora", "epistrophe", "chiasmus") & ~repeated, "repeated_word")


def stored_text(text: Column, source: Column, start: Column, stop: Column) -> Column:
    """What is stored of a node's text: null where its range of the source says the same; a range outside the source keeps the text."""
    inside = (start >= 0) & (stop >= start) & (stop <= F.length(source))
    return F.when(inside & (F.substring(source, start + 1, stop - start) == text), None).otherwise(text)


def resolved_text(stored: Column, source: Column, start: Column, stop: Column) -> Column:
    """The inverse of :func:`stored_text`."""
    return F.coalesce(stored, F.substring(source, start + 1, stop - start))


def realigned(units: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, unit_no, text): units (key, unit_no, text) put together again from tokens (key, ord, token).

    A unit takes tokens until they have as many characters as it has without white space;
    where a token crosses a border, the next unit begins after it and counts from there.
    A unit without characters is empty.  A document's units are folded in order, because a
    border depends on all before it.
    """
    size = F.length(F.regexp_replace("text", r"\s+", "")).alias("n")
    us = units.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("unit_no", size))).alias("us"))
    ts = tokens.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "token"))), lambda t: t["token"]).alias("ts"))

    @F.pandas_udf("array<struct<unit_no:bigint,text:string>>")
    def join(us: pd.Series, ts: pd.Series) -> pd.Series:
        def one(unit_rows, words):
            out, at, words = [], 0, list(words) if words is not None else []
            for u in unit_rows:
                begin, n = at, 0
                while at < len(words) and n < u["n"]:
                    n += len(words[at])
                    at += 1
                out.append({"unit_no": u["unit_no"], "text": " ".join(words[begin:at]).strip()})
            return out

        return pd.Series([one(u, t) for u, t in zip(us, ts)])

    return us.join(ts, key, "left").select(key, F.inline(join("us", "ts")))


def phrase_matches(tokens: DataFrame, phrases: list[str], key: str) -> DataFrame:
    """(key, ord, stop, phrase): all places, overlapping ones included, where lower-case tokens (key, ord, token) spell one of the phrases; ord counts without gaps."""
    lexicon = [(p, p.split()) for p in dict.fromkeys(" ".join(p.lower().split()) for p in phrases) if p]
    if not lexicon:
        return tokens.where("false").select(key, "ord", F.col("ord").alias("stop"), F.lit("").alias("phrase"))
    firsts = sorted({ws[0] for _, ws in lexicon})
    w = Window.partitionBy(key).orderBy("ord")
    most = max(len(ws) for _, ws in lexicon)
    low = F.lower("token")
    ahead = tokens.withColumn("_w", F.array(low, *[F.lead(low, i).over(w) for i in range(1, most)])).where(low.isin(*firsts))
    table = tokens.sparkSession.createDataFrame(lexicon, "phrase string, words array<string>").withColumn("first", F.get("words", F.lit(0)))
    hit = ahead.withColumn("first", low).join(F.broadcast(table), "first").where(F.slice("_w", F.lit(1), F.size("words")) == F.col("words"))  # a literal list
    return hit.select(key, "ord", (F.col("ord") + F.size("words")).alias("stop"), "phrase")
