"""Queries on places of cues, anchors, vocabularies, signals and discourse graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.functions.lexicons import CUES
from logosmill.operators import alignment as A
from logosmill.operators import dialogue as D
from logosmill.operators import graphs as G
from logosmill.operators import scoring as C
from logosmill.operators import substrate as S
from logosmill.plans.dialogue_queries import _map
from logosmill.plans.text_queries import COMMON
from logosmill.session import table

ALL_CUES = [*CUES, *COMMON]
FAMILIES = ["contrast", "joint", "sequence", "elaboration", "cause", "adversative"]


def _windows(spark, d, size=200):
    docs = table(spark, d, "documents").where("text is not null")
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / size))
    w = docs.select("doc_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("w"))
    return w.select("doc_id", F.col("w").alias("segment_id"), (F.col("w") * size).alias("start_pos"), F.least(F.col("n"), F.col("w") * size + size).alias("stop_pos"))


def cue_units(spark, d):
    """Every cue with its place, label and the unit it begins in."""
    docs = table(spark, d, "documents")
    cues = S.cue_spans(docs, cues=ALL_CUES).select("doc_id", F.col("start_pos").alias("pos"), F.col("stop_pos").alias("end"), "category", "label", "phrase")
    out = S.points_in_spans(cues, S.sections(docs), "doc_id")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("stop_pos"), "category", "label", "phrase", F.concat(F.lit("u_"), F.col("section_no")).alias("unit_id"))


def source_prefixes(spark, d):
    """Each document's units and first 128 signals as one text."""
    docs = table(spark, d, "documents")
    units = S.sections(docs).join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").select(
        "doc_id", F.col("section_no").alias("ord"), F.concat(F.lit("u_"), F.col("section_no")).alias("unit_id"), F.lit("kind=paragraph").alias("header"),
        F.expr("substring(_t, cast(start_pos as int) + 1, cast(stop_pos - start_pos as int))").alias("text"))
    signals = cue_units(spark, d).select("doc_id", "unit_id", "start_pos", "stop_pos", F.col("category").alias("kind"), "label", F.col("phrase").alias("text"))
    return S.source_prefix(units, signals).select("doc_id", F.length("prefix").cast("bigint").alias("n_chars"), F.md5("prefix").alias("digest"))


def clipped_anchors(spark, d):
    """Sentences on windows of 200 characters, every third of which is transformed."""
    spans = S.simple_sentences(table(spark, d, "documents")).select("doc_id", F.col("sentence_no").alias("span_id"), "start_pos", "stop_pos")
    seg = _windows(spark, d).withColumn("transformed", F.col("segment_id") % 3 == 0).withColumn("anchor_start", F.col("start_pos") + 1000).withColumn("anchor_stop", F.col("stop_pos") + 1000 + F.when(F.col("segment_id") % 5 == 0, 1).otherwise(0))
    out = A.clipped_anchors(spans, seg, "doc_id")
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("span_id", "segment_id", "anchor_start", "anchor_stop")])


def unique_anchors(spark, d):
    """The languages and genres of each source, in order of their first document."""
    out = A.unique_anchors(table(spark, d, "documents").select("source", "doc_id", "lang", "genre"), ["source"], "doc_id")
    return out.select("source", F.col("place").cast("bigint").alias("place"), "lang", "genre")


def quoted_segments(spark, d):
    """All places of each document's beginning and of a short quotation, on windows of 200 characters."""
    docs = table(spark, d, "documents")
    quotes = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("opening").alias("quote_id"), F.substring("text", 1, 3).alias("quote")), F.struct(F.lit("pair").alias("quote_id"), F.lit("ee").alias("quote")))).alias("q")).select("doc_id", "q.*")
    out = A.quote_alignment(quotes, docs, _windows(spark, d), "doc_id")
    return out.select("doc_id", "quote_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("segment_id").cast("bigint").alias("segment_id"))


def supplied_candidates(spark, d):
    """Cues at supplied places of which every other one is off by one."""
    found = S.cue_spans(table(spark, d, "documents"), cues=CUES).select("doc_id", "start_pos", "stop_pos", "phrase", F.col("label").alias("curies"), F.lit("unique").alias("resolution"))
    supplied = found.select("doc_id", (F.col("start_pos") + F.col("doc_id") % 2).cast("bigint").alias("start_pos"), F.col("stop_pos").cast("bigint").alias("stop_pos"), "phrase")
    return A.resolved_candidates(supplied, found.withColumns({c: F.col(c).cast("bigint") for c in ("start_pos", "stop_pos")}), ["doc_id", "start_pos", "stop_pos", "phrase"])


def unmet_speakers(spark, d):
    items = table(spark, d, "inventory_items").dropDuplicates(["source_id", "item_id"])
    turns = items.where("classification = 'turn'").select("source_id", F.when(F.col("decision") == "primary", "resolved").otherwise("unresolved").alias("resolution"))
    return A.unmet_speakers(items, turns, "source_id")


def label_keys(spark, d):
    """Relation names in corpus spelling under the rules of vocabularies."""
    names = table(spark, d, "rst_nodes").where("relname is not null").select("relname").distinct()
    forms = names.select("relname", F.explode(F.array(*[F.concat(F.initcap("relname"), F.lit(s)) for s in ("", "-n", "-n-e", "-S", " ")])).alias("value"))
    return forms.select("value", *[A.observed_key(F.col("value"), F.lit(r)).alias(r) for r in ("exact_key", "case_insensitive_label", "rst_dt_corpus_label")])


def coarse_labels(spark, d):
    """Nodes by the family of their relation; those of no family have none."""
    label = F.when(F.col("kind") == "edu", F.concat("relname", F.lit("-e"))).otherwise(F.col("relname"))
    rows = table(spark, d, "rst_nodes").select(A.coarse_label(label, FAMILIES, {"cause": "contingency", "contrast": "adversative"}).alias("family"))
    return rows.groupBy("family").agg(F.count("*").alias("n"))


def observed_concepts(spark, d):
    vocabulary = spark.createDataFrame([(f, f"c:{i}", f.title(), "exact" if i % 2 else "broader") for i, f in enumerate(FAMILIES)], "key string, concept_id string, label string, relationship string")
    values = table(spark, d, "rst_nodes").where("relname is not null").select(F.initcap("relname").alias("value"), "kind")
    return A.observed_concepts(values, vocabulary, "case_insensitive_label").groupBy("value", "concept_id", "relationship").agg(F.count("*").alias("n"))


def role_numbers(spark, d):
    """The semantic roles of each source, numbered by first appearance."""
    items = table(spark, d, "inventory_items").select("source_id", "semantic_role", "line_start")
    return A.first_seen_ids(items.where("line_start is not null"), "source_id", "semantic_role", "line_start", "role_")


def boundary_order(spark, d):
    """Stated boundaries that begin before the one before them ends."""
    rows = table(spark, d, "rst_documents").groupBy("document_id").agg(F.min("sentence_boundaries").alias("b"))
    spans = rows.select("document_id", F.posexplode("b").alias("at", "s")).select("document_id", "at", (F.col("s.start_pos") - F.col("at") % 2).alias("start_pos"), F.col("s.end_pos").alias("stop_pos"))
    return A.order_violations(spans, "document_id", "at").select("document_id", F.col("at").cast("bigint").alias("place"))


def cue_times(spark, d):
    c = lambda e: F.expr(e)
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")).select(
        "l_orderkey", "l_linenumber", A.cue_interval(c("nullif(p % 3, 0)"), c("s % 60"), c("nullif(p % 60, 7)"), c("nullif(s % 1000, 1)")).alias("msecs"))


def figure_evidence(spark, d):
    """Sentences as evidence of figures, schemes by their number."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = S.simple_sentences(docs).join(docs, "doc_id").select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.expr("substring(text, cast(start_pos as int) + 1, cast(stop_pos - start_pos as int))").alias("q"))
    scheme = F.element_at(F.array(*map(F.lit, ("rhetorical_question", "anaphora", "metaphor"))), (F.col("sentence_no") % 3 + 1).cast("int"))
    return rows.select("doc_id", "sentence_no", A.figure_evidence(scheme, F.col("q")).alias("rule")).where("rule is not null")


def _signals(spark, d, side):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(f"case when (l_partkey + {side}) % 5 > 0 then cast(l_linenumber % 3 as string) end").alias("edge_id"),
        F.expr(f"case when (l_suppkey * {side}) % 2 = 0 then 'DM' else 'lexical' end").alias("signal_type"), F.expr("case when l_partkey % 2 = 0 then 'dm' else 'Word' end").alias("signal_subtype"),
        F.expr(f"case when l_partkey % 7 = {side} then array() else array(cast(l_linenumber as bigint), cast(l_suppkey % 4 + 10 as bigint)) end").cast("array<bigint>").alias("tokens"))
    return t


def signal_scores(spark, d):
    return C.signal_counts(_signals(spark, d, 1), _signals(spark, d, 2), ["doc_id"]).groupBy("criterion").agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "matched")])


def location_scores(spark, d):
    return C.location_counts(_signals(spark, d, 1), _signals(spark, d, 2), ["doc_id"]).groupBy("criterion").agg(*[F.sum(c).alias(c) for c in ("gold", "pred", "matched")])


def concept_scores(spark, d):
    """Lines as places: gold targets by part, predictions by supplier."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    gold = t.where("p % 3 > 0").select("l_orderkey", "l_linenumber", F.expr("nullif(p % 4, 0)").alias("target"))
    pred = t.where("s % 2 = 0").select("l_orderkey", "l_linenumber", F.expr("case when s % 10 = 0 then array() when s % 4 = 0 then array(p % 4) else array(s % 4, p % 4) end").cast("array<bigint>").alias("targets"))
    out = C.concept_metrics(gold, pred, ["l_orderkey", "l_linenumber"])
    return out.select(*[c for c in out.columns if not c.endswith(("precision", "recall"))], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "canonical_recall")])


def pistis_balance(spark, d):
    """Appeals of each customer's orders by kind."""
    kind = F.element_at(F.array(*map(F.lit, ("ethos", "pathos", "logos"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return D.type_counts(table(spark, d, "orders").select("o_custkey", kind.alias("pistis")), ["o_custkey"], "pistis", ["ethos", "pathos", "logos"])


def deliberation_gaps(spark, d):
    nodes, links = _map(spark, d)
    return D.deliberation_gaps(nodes, links.where("length(source) % 3 > 0"))


def _graphs(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    units = t.select("graph_id", F.concat(F.lit("e"), "i").alias("unit"), F.col("i").alias("ord"), (F.col("i") * 10 - F.col("p") % 3 * 4).alias("start_pos"), (F.col("i") * 10 + F.col("s") % 8).alias("stop_pos"))
    groups = t.where("i = 2").select("graph_id", F.lit("c1").alias("unit"), F.array(F.lit("e1"), F.when(F.col("p") % 5 == 0, "e99").otherwise("e2")).alias("members"))
    relations = t.where("i > 1").select("graph_id", F.concat(F.lit("r"), F.greatest(F.lit(2), F.col("i") - F.col("p") % 2)).alias("id"), F.concat(F.lit("e"), F.greatest(F.lit(1), F.col("i") - 1 - F.col("s") % 2)).alias("source"), F.concat(F.lit("e"), "i").alias("target"),
        F.when(F.col("p") % 3 == 0, "coordinating").otherwise("subordinating").alias("structure"))
    return units, groups, relations


def graph_violations(spark, d):
    units, groups, relations = _graphs(spark, d)
    back = relations.where("id = 'r3' and structure = 'coordinating'").select("graph_id", F.lit("r0").alias("id"), F.col("target").alias("source"), F.col("source").alias("target"), F.lit("subordinating").alias("structure"))
    return G.discourse_violations(units, groups, relations.unionByName(back))


def frontier_breaks(spark, d):
    """Lines that attach from outside the right frontier of their order."""
    units, groups, relations = _graphs(spark, d)
    u = units.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]).alias("units"))
    r = relations.groupBy("graph_id").agg(F.collect_list(F.struct("source", "target", (F.col("structure") == "subordinating").alias("subordinating"))).alias("relations"))
    c = groups.groupBy("graph_id").agg(F.collect_list(F.struct("unit", "members")).alias("complex"))
    return G.frontier_violations(u.join(r, "graph_id", "left").join(c, "graph_id", "left"))


def tree_roots(spark, d):
    """The root of every annotated tree, with its widest node where none is marked."""
    raw = table(spark, d, "rst_nodes").groupBy(F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in ("project", "user_name", "doc")]).alias("tree_id"), F.col("id").alias("node_id")).agg(
        F.min("kind").alias("kind"), F.min("parent").alias("parent"), F.min(F.col("right_edge") - F.col("left_edge")).alias("width"))
    edges = raw.where("trim(parent) not in ('', '0')").select("tree_id", F.col("node_id").alias("child_id"))
    return G.root_choice(raw.withColumn("units", F.col("width")), edges, "tree_id")


QUERIES = {f.__name__: f for f in (
    cue_units, source_prefixes, clipped_anchors, unique_anchors, quoted_segments, supplied_candidates, unmet_speakers, label_keys, coarse_labels, observed_concepts, role_numbers,
    boundary_order, cue_times, figure_evidence, signal_scores, location_scores, concept_scores, pistis_balance, deliberation_gaps, graph_violations, frontier_breaks, tree_roots)}


def _places(cues):
    """SQL for the places of cues: matches of one alternation, then the characters beside them."""
    pattern = S.cue_pattern([p for _, p, _ in cues])
    lexicon = ", ".join(f"('{c}', '{p}', '{label}')" for c, p, label in cues)
    low = "(CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END)"
    return f"""lex(category, phrase, label) AS (VALUES {lexicon}),
cp AS (SELECT doc_id, {low} AS t, list_transform(regexp_split_to_array({low}, '{pattern}'), lambda x: length(x)) AS g, regexp_extract_all({low}, '{pattern}') AS m FROM documents),
ce AS (SELECT doc_id, t, m[i] AS phrase, CAST(list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cp)),
cues AS (SELECT doc_id, start_pos, start_pos + length(phrase) AS stop_pos, category, label, phrase FROM ce JOIN lex USING (phrase)
  WHERE (start_pos = 0 OR NOT regexp_matches(substr(t, start_pos, 1), '[\\p{{L}}\\p{{N}}_]')) AND NOT regexp_matches(substr(t, start_pos + length(phrase) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""


_UNITS = r"""up AS (SELECT doc_id, text, string_split(regexp_replace(text, '(\n\s*\n)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
ue AS (SELECT doc_id, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM up)),
uo AS (SELECT doc_id, i, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(regexp_extract(x, '^\s*')) AS lead, regexp_replace(x, '^\s+|\s+$', '', 'g') AS core FROM ue),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS section_no, b + lead AS u0, b + lead + length(core) AS u1, core FROM uo WHERE length(core) > 0)"""
_IN_UNITS = "placed AS (SELECT c.*, 'u_' || section_no AS unit_id FROM cues c JOIN units u ON u.doc_id = c.doc_id AND u.u0 <= c.start_pos AND c.start_pos < u.u1)"
_LINES = "'- ' || unit_id || ' [' || category || ':' || label || '] ' || chr(39) || phrase || chr(39)"
_SENT = r"""sp AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
se AS (SELECT doc_id, i - 1 AS n, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sp)),
so AS (SELECT doc_id, n, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM se),
sent AS (SELECT doc_id, n, b AS s0, b + length(regexp_replace(x, '\s+$', '')) AS s1, regexp_replace(x, '\s+$', '') AS q FROM so WHERE length(regexp_replace(x, '\s+$', '')) > 0)"""
_WIN = "win AS (SELECT doc_id, w AS segment_id, w * 200 AS w0, least(length(text), w * 200 + 200) AS w1 FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(1, ceil(length(text) / 200.0)) AS BIGINT))) AS w FROM documents WHERE text IS NOT NULL))"
_LINE = "t AS (SELECT l_orderkey AS graph_id, l_linenumber AS i, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"
_RELATIONS = "r AS (SELECT graph_id, 'r' || greatest(2, i - p % 2) AS id, greatest(1, i - 1 - s % 2) AS a, i AS b, CASE WHEN p % 3 = 0 THEN 'coordinating' ELSE 'subordinating' END AS st FROM t WHERE i > 1)"
_FAMILY_OF = "map {'contrast': 'adversative', 'cause': 'contingency', 'joint': 'joint', 'sequence': 'sequence', 'elaboration': 'elaboration', 'adversative': 'adversative'}"


def _signal_sql(body):
    side = lambda n: f"""(SELECT l_orderkey AS d, CASE WHEN (l_partkey + {n}) % 5 > 0 THEN CAST(l_linenumber % 3 AS VARCHAR) END AS e, CASE WHEN (l_suppkey * {n}) % 2 = 0 THEN 'DM' ELSE 'lexical' END AS ty, CASE WHEN l_partkey % 2 = 0 THEN 'dm' ELSE 'Word' END AS st,
CASE WHEN l_partkey % 7 = {n} THEN [] ELSE [CAST(l_linenumber AS BIGINT), CAST(l_suppkey % 4 + 10 AS BIGINT)] END AS tk FROM lineitem)"""  # noqa: E731
    return f"WITH g AS {side(1)}, p AS {side(2)} {body}"


def _matched(kinds):
    """SQL that counts equal keys of both sides, for each (criterion, key columns, rows, matched at all)."""
    parts = []
    for criterion, columns, rows, counted in kinds:
        one = lambda t: f"(SELECT d, {columns}, count(*) AS n FROM {rows.format(t=t)} GROUP BY ALL)"  # noqa: B023, E731
        names = [c.split(" AS ")[-1] for c in columns.split(", ")]
        on = " AND ".join(f"coalesce(CAST(x.{c} AS VARCHAR), '') = coalesce(CAST(y.{c} AS VARCHAR), '')" for c in ["d", *names])
        parts.append(f"SELECT '{criterion}' AS criterion, sum(coalesce(x.n, 0)) AS gold, sum(coalesce(y.n, 0)) AS pred, sum(CASE WHEN {counted} THEN least(coalesce(x.n, 0), coalesce(y.n, 0)) ELSE 0 END) AS matched FROM {one('g')} x FULL JOIN {one('p')} y ON {on}")
    return "SELECT criterion, CAST(gold AS BIGINT) AS gold, CAST(pred AS BIGINT) AS pred, CAST(matched AS BIGINT) AS matched FROM (" + " UNION ALL ".join(parts) + ")"


ORACLES = {
    "cue_units": f"WITH {_places(ALL_CUES)}, {_UNITS}, {_IN_UNITS} SELECT doc_id, start_pos, stop_pos, category, label, phrase, unit_id FROM placed",
    "source_prefixes": f"""WITH {_places(ALL_CUES)}, {_UNITS}, {_IN_UNITS},
b AS (SELECT doc_id, string_agg('[u_' || section_no || ' | kind=paragraph]' || chr(10) || core, chr(10) || chr(10) ORDER BY section_no) AS b FROM units GROUP BY 1),
n AS (SELECT *, {_LINES} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos, stop_pos, category, {_LINES}) AS k FROM placed),
l AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS l FROM n WHERE k <= 128 GROUP BY 1),
x AS (SELECT doc_id, '<source_document>' || chr(10) || b || chr(10) || '</source_document>' || coalesce(chr(10) || '<linguistic_signals>' || chr(10) || l || chr(10) || '</linguistic_signals>', '') AS prefix FROM b LEFT JOIN l USING (doc_id))
SELECT doc_id, length(prefix) AS n_chars, md5(prefix) AS digest FROM x""",
    "clipped_anchors": f"""WITH {_SENT}, {_WIN}, s AS (SELECT *, w0 + 1000 AS a0, w1 + 1000 + CASE WHEN segment_id % 5 = 0 THEN 1 ELSE 0 END AS a1 FROM win),
j AS (SELECT *, segment_id % 3 <> 0 AND w1 - w0 = a1 - a0 AS same FROM sent JOIN s USING (doc_id) WHERE s0 < w1 AND w0 < s1)
SELECT doc_id, n AS span_id, segment_id, CAST(CASE WHEN same THEN a0 + greatest(0, s0 - w0) ELSE a0 END AS BIGINT) AS anchor_start, CAST(CASE WHEN same THEN a1 - greatest(0, w1 - s1) ELSE a1 END AS BIGINT) AS anchor_stop FROM j""",
    "unique_anchors": """WITH f AS (SELECT source, lang, genre, min(doc_id) AS o FROM documents GROUP BY ALL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY o) - 1 AS place, lang, genre FROM f""",
    "quoted_segments": f"""WITH {_WIN}, q AS (SELECT doc_id, text, 'opening' AS quote_id, substr(text, 1, 3) AS quote FROM documents UNION ALL SELECT doc_id, text, 'pair', 'ee' FROM documents),
f AS (SELECT doc_id, quote_id, length(quote) AS n, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(quote)) = quote)) AS p FROM q WHERE length(quote) > 0)
SELECT doc_id, quote_id, p AS start_pos, segment_id FROM f JOIN win USING (doc_id) WHERE p < w1 AND w0 < p + n""",
    "supplied_candidates": f"""WITH {_places(CUES)}, s AS (SELECT DISTINCT doc_id, start_pos + doc_id % 2 AS start_pos, stop_pos, phrase FROM cues)
SELECT s.*, c.label AS curies, CASE WHEN c.label IS NULL THEN 'unmapped' ELSE 'unique' END AS resolution FROM s LEFT JOIN cues c USING (doc_id, start_pos, stop_pos, phrase)""",
    "unmet_speakers": """WITH i AS (SELECT source_id, item_id, min(classification) AS k, min(decision) AS d FROM inventory_items GROUP BY 1, 2),
n AS (SELECT source_id, count(*) FILTER (k = 'turn') AS t, count(*) FILTER (k = 'turn' AND d IS DISTINCT FROM 'primary') AS u FROM i GROUP BY 1)
SELECT source_id, u AS unresolved, CASE WHEN t = 0 THEN 'no_turns' ELSE 'unresolved_turns' END AS detail FROM n WHERE t = 0 OR u > 0""",
    "label_keys": """WITH n AS (SELECT DISTINCT upper(relname[1]) || lower(relname[2:]) AS r FROM rst_nodes WHERE relname IS NOT NULL), f AS (SELECT r || x AS value FROM n, unnest(['', '-n', '-n-e', '-S', ' ']) u(x)),
s AS (SELECT value, lower(value) AS l, regexp_replace(lower(value), '-(?:n-e|s-e|e|n|s)$', '') AS c FROM f)
SELECT value, value AS exact_key, l AS case_insensitive_label, CASE WHEN value <> trim(value) THEN value WHEN l IN ('attribution-n', 'attribution-n-e') THEN 'attribution-negative' WHEN c = 'textualorganization' THEN 'textual-organization' ELSE c END AS rst_dt_corpus_label FROM s""",
    "coarse_labels": f"""WITH x AS (SELECT lower(trim(CASE WHEN kind = 'edu' THEN relname || '-e' ELSE relname END)) AS l FROM rst_nodes)
SELECT coalesce({_FAMILY_OF}[l], CASE WHEN length(l) > length(split_part(l, '-', 1)) + 1 THEN {_FAMILY_OF}[split_part(l, '-', 1)] END) AS family, count(*) AS n FROM x GROUP BY 1""",
    "observed_concepts": """WITH v(key, i) AS (VALUES ('contrast', 0), ('joint', 1), ('sequence', 2), ('elaboration', 3), ('cause', 4), ('adversative', 5)), x AS (SELECT upper(relname[1]) || lower(relname[2:]) AS value FROM rst_nodes WHERE relname IS NOT NULL)
SELECT value, 'c:' || i AS concept_id, CASE WHEN i IS NULL THEN 'unmapped' WHEN i % 2 = 1 THEN 'exact' ELSE 'broader' END AS relationship, count(*) AS n FROM x LEFT JOIN v ON key = lower(value) GROUP BY ALL""",
    "role_numbers": """WITH f AS (SELECT source_id, semantic_role, min(line_start) AS p FROM inventory_items WHERE semantic_role IS NOT NULL AND line_start IS NOT NULL GROUP BY 1, 2)
SELECT source_id, semantic_role, 'role_' || row_number() OVER (PARTITION BY source_id ORDER BY p, semantic_role) AS entity_id FROM f""",
    "boundary_order": """WITH r AS (SELECT document_id, min(sentence_boundaries) AS b FROM rst_documents GROUP BY 1), e AS (SELECT document_id, b, unnest(range(0, len(b))) AS k FROM r),
s AS (SELECT document_id, k, b[k + 1].start_pos - k % 2 AS s0, lag(b[k + 1].end_pos) OVER (PARTITION BY document_id ORDER BY k) AS before FROM e) SELECT document_id, k AS place FROM s WHERE s0 < before""",
    "cue_times": """WITH t AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CAST(((coalesce(nullif(p % 3, 0), 0) * 60 + s % 60) * 60 + nullif(p % 60, 7)) * 1000 + coalesce(nullif(s % 1000, 1), 0) AS BIGINT) AS msecs FROM t""",
    "figure_evidence": rf"""WITH {_SENT}, x AS (SELECT doc_id, n, q, n % 3 AS k, list_filter(regexp_split_to_array(lower(q), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '\p{{L}}')) AS ws FROM sent)
SELECT doc_id, n AS sentence_no, CASE WHEN k = 0 THEN 'question_mark' ELSE 'repeated_word' END AS rule FROM x WHERE (k = 0 AND NOT regexp_matches(q, '[?？]')) OR (k = 1 AND len(list_distinct(ws)) = len(ws))""",
    "signal_scores": _signal_sql(_matched([
        ("detection", "e", "{t}", "x.e IS NOT NULL"), ("type", "e, lower(ty) AS ty", "{t}", "x.e IS NOT NULL"), ("subtype", "e, lower(ty) AS ty, lower(st) AS st", "{t}", "x.e IS NOT NULL"),
        ("token", "e, k", "(SELECT d, e, unnest(list_distinct(tk)) AS k FROM {t})", "x.e IS NOT NULL")])),
    "location_scores": _signal_sql(_matched([
        ("location", "list_sort(tk) AS tk", "{t} WHERE len(tk) > 0", "true"), ("location_type", "list_sort(tk) AS tk, ty", "{t} WHERE len(tk) > 0", "true"),
        ("location_subtype", "list_sort(tk) AS tk, ty, st", "{t} WHERE len(tk) > 0", "true"), ("unanchored", "1 AS z", "{t} WHERE len(tk) = 0", "false")])),
    "concept_scores": """WITH t AS (SELECT l_orderkey AS a, l_linenumber AS b, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
x AS (SELECT p % 3 > 0 AS g, s % 2 = 0 AS q, CASE WHEN p % 3 > 0 THEN nullif(p % 4, 0) END AS y, CASE WHEN s % 10 = 0 THEN [] WHEN s % 4 = 0 THEN [p % 4] ELSE [s % 4, p % 4] END AS ts FROM t),
c AS (SELECT count(*) FILTER (q) AS predicted, count(*) FILTER (g) AS gold, count(*) FILTER (g AND q) AS correct, count(y) AS canonical, count(*) FILTER (g AND q AND list_contains(ts, y)) AS canonical_correct,
count(*) FILTER (q AND len(ts) > 1) AS ambiguous, count(*) FILTER (q AND NOT g) AS spurious, count(*) FILTER (q AND len(ts) = 0) AS unmapped FROM x)
SELECT *, round(correct / predicted, 6) AS precision, round(correct / gold, 6) AS recall, round(canonical_correct / canonical, 6) AS canonical_recall FROM c""",
    "pistis_balance": """WITH c AS (SELECT DISTINCT o_custkey FROM orders), k(pistis, i) AS (VALUES ('ethos', 0), ('pathos', 1), ('logos', 2))
SELECT c.o_custkey, pistis, count(o.o_orderkey) AS n FROM c CROSS JOIN k LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderkey % 3 = i GROUP BY 1, 2""",
    "graph_violations": f"""WITH {_LINE}, {_RELATIONS}, rr AS (SELECT * FROM r UNION ALL SELECT graph_id, 'r0', b, a, 'subordinating' FROM r WHERE id = 'r3' AND st = 'coordinating'),
known AS (SELECT graph_id, 'e' || i AS u FROM t UNION SELECT graph_id, 'c1' FROM t WHERE i = 2),
m AS (SELECT graph_id, unnest(['e1', CASE WHEN p % 5 = 0 THEN 'e99' ELSE 'e2' END]) AS u FROM t WHERE i = 2),
o AS (SELECT graph_id, i, i * 10 - p % 3 * 4 AS s0, lag(i * 10 + s % 8) OVER (PARTITION BY graph_id ORDER BY i) AS before FROM t)
SELECT graph_id, 'repeated_relation' AS rule, id AS detail FROM rr GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT graph_id, 'unknown_member', u FROM m ANTI JOIN known USING (graph_id, u)
UNION ALL SELECT DISTINCT graph_id, 'unknown_endpoint', u FROM (SELECT graph_id, 'e' || unnest([a, b]) AS u FROM rr) ANTI JOIN known USING (graph_id, u)
UNION ALL SELECT graph_id, 'overlapping_units', 'e' || i FROM o WHERE s0 < before
UNION ALL SELECT graph_id, 'both_structures', 'e' || a || ' e' || b FROM rr GROUP BY graph_id, a, b HAVING count(DISTINCT st) > 1
UNION ALL SELECT DISTINCT graph_id, 'relation_cycle', 'e' || src FROM (SELECT b.graph_id, unnest(range(least(b.a, b.b), greatest(b.a, b.b) + 1)) AS src, b.b AS lo, b.a AS hi FROM rr b WHERE b.id = 'r0') z
  WHERE EXISTS (SELECT 1 FROM walk w WHERE w.graph_id = z.graph_id AND w.a = z.lo AND w.b = z.src) AND EXISTS (SELECT 1 FROM walk w WHERE w.graph_id = z.graph_id AND w.a = z.src AND w.b = z.hi)""".replace(
        "WITH ", "WITH RECURSIVE ", 1).replace("known AS", "walk AS (SELECT graph_id, a, a AS b FROM rr UNION SELECT graph_id, b, b FROM rr UNION SELECT w.graph_id, w.a, r.b FROM walk w JOIN r ON r.graph_id = w.graph_id AND r.a = w.b),\nknown AS", 1),
    "tree_roots": """WITH n AS (SELECT coalesce(project, '') || '/' || coalesce(user_name, '') || '/' || coalesce(doc, '') AS tree_id, id AS node_id, min(kind) AS kind, min(parent) AS parent, min(right_edge - left_edge) AS w FROM rst_nodes GROUP BY 1, 2)
SELECT DISTINCT ON (tree_id) tree_id, node_id FROM n ORDER BY tree_id, coalesce(trim(parent) NOT IN ('', '0'), false), kind IS DISTINCT FROM 'root', coalesce(w, 0) DESC, node_id""",
    "frontier_breaks": f"""WITH RECURSIVE {_LINE}, {_RELATIONS}, c AS (SELECT graph_id, CASE WHEN p % 5 = 0 THEN 99 ELSE 2 END AS m FROM t WHERE i = 2),
up AS (SELECT r.graph_id, b AS x, a AS y, a AS done FROM r JOIN t ON t.graph_id = r.graph_id AND t.i = r.a WHERE st = 'subordinating'
  UNION SELECT c.graph_id, unnest([1, m]), -1, greatest(1, m) FROM c JOIN t x ON x.graph_id = c.graph_id AND x.i = 1 JOIN t y ON y.graph_id = c.graph_id AND y.i = m),
n AS (SELECT graph_id, i, lag(i) OVER (PARTITION BY graph_id ORDER BY i) AS h FROM t),
f AS (SELECT graph_id, i AS unit, h AS x FROM n WHERE h IS NOT NULL UNION SELECT f.graph_id, f.unit, up.y FROM f JOIN up ON up.graph_id = f.graph_id AND up.x = f.x AND up.done < f.unit)
SELECT n.graph_id, 'e' || n.i AS unit FROM n WHERE h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r JOIN f ON f.graph_id = r.graph_id AND f.x = r.a AND f.unit = r.b WHERE r.graph_id = n.graph_id AND r.b = n.i)""",
    "deliberation_gaps": f"""WITH own AS (SELECT o_custkey AS af_id, o_orderkey AS k, l_linenumber AS i, l_returnflag AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
nodes AS (SELECT DISTINCT o_custkey AS af_id, concat('i', o_custkey) AS node_id, 'issue' AS kind FROM orders UNION SELECT o_custkey, concat('p', o_orderkey), 'position' FROM orders UNION SELECT af_id, concat('a', k, '_', i), 'argument' FROM own),
links AS (SELECT o_custkey AS af_id, concat('p', o_orderkey) AS source, 'responds_to' AS relation, concat('i', o_custkey) AS target FROM orders
  UNION SELECT af_id, concat('a', k, '_', i), CASE WHEN f = 'R' THEN 'objects_to' ELSE 'supports' END, concat('p', k) FROM own),
k AS (SELECT * FROM links WHERE length(source) % 3 > 0),
touched AS (SELECT af_id, source AS node_id FROM k UNION SELECT af_id, target FROM k)
SELECT af_id AS map_id, 'issue_without_position' AS gap, node_id AS id FROM nodes n WHERE kind = 'issue' AND NOT EXISTS (SELECT 1 FROM k WHERE k.af_id = n.af_id AND k.target = n.node_id AND relation = 'responds_to')
UNION ALL SELECT af_id, 'position_without_argument', node_id FROM nodes n WHERE kind = 'position' AND NOT EXISTS (SELECT 1 FROM k WHERE k.af_id = n.af_id AND k.target = n.node_id AND relation IN ('supports', 'objects_to'))
UNION ALL SELECT af_id, 'isolated_node', node_id FROM nodes ANTI JOIN touched USING (af_id, node_id)""",
}
