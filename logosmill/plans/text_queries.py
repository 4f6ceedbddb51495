"""Queries on text, spans and prepared content, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.functions.lexicons import CUES, OPENING_MARKERS
from logosmill.operators import preparation as P
from logosmill.operators import substrate as S
from logosmill.session import broadcast_if_small, cut, table

COMMON = [("frequent_word", w, "function_word") for w in ("the", "of", "and", "to", "that", "in", "is", "der", "die", "la", "de")]
PRIMARY = ["title", "heading", "paragraph", "list_item", "turn"]


def cue_signals(spark, d):
    """Cues and frequent words per language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    found = S.cue_scan(docs, cues=[*CUES, *COMMON], keep=("lang",))
    return found.groupBy("lang", "category", "label").agg(F.count("*").alias("n"))


def cue_documents(spark, d):
    """Documents with a cue, by label."""
    return S.cue_scan(table(spark, d, "documents")).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def year_mentions(spark, d):
    """Offsets of years in all documents."""
    return S.occurrences(table(spark, d, "documents"), "[12][0-9]{3}").select("doc_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("found").alias("year"))


def sentence_spans(spark, d):
    out = S.simple_sentences(table(spark, d, "documents"))
    return out.select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("stop_pos").cast("bigint").alias("stop_pos"))


def token_counts(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.size(S.tokens(F.col("text"))).cast("bigint").alias("n_tokens"), S.token_estimate(F.col("text")).cast("bigint").alias("estimate"))


def overlapping_matches(spark, d):
    """Overlapping occurrences of a needle in benchmark items: count and last place."""
    return _needle(table(spark, d, "benchmark"), "item_id")


def document_needles(spark, d):
    """The same in documents."""
    return _needle(table(spark, d, "documents").where("text is not null"), "doc_id")


def _needle(rows, key):
    at = S.overlapping_occurrences(F.col("text"), "ee")
    return rows.select(key, at.alias("at")).select(
        key, F.size("at").cast("bigint").alias("n"), F.coalesce(F.get("at", F.size("at") - 1), F.lit(-1)).cast("bigint").alias("last_start"))


def quote_resolution(spark, d):
    """Quotations taken from documents, some of them altered."""
    docs = table(spark, d, "documents").where("text is not null")
    cut = F.substring("text", 5, 24)
    quote = (F.when(F.col("doc_id") % 4 == 0, cut).when(F.col("doc_id") % 4 == 1, F.translate(cut, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(F.col("doc_id") % 4 == 2, F.regexp_replace(cut, " ", "  ")).otherwise(F.concat(F.lit("[u_1] "), cut)))
    return docs.select("doc_id", S.quote_status(F.col("text"), quote, F.lit(1)).alias("status"))


def span_validation(spark, d):
    """Whether stated sentence boundaries hold their text."""
    rows = table(spark, d, "rst_documents").dropDuplicates(["document_id"]).select("document_id", "text", F.explode("sentence_boundaries").alias("s"))
    return rows.groupBy("document_id", S.span_check(F.col("text"), F.col("s")).alias("status")).agg(F.count("*").alias("n"))


def boundary_overlaps(spark, d):
    """Stated boundaries against windows of 200 characters."""
    rows = table(spark, d, "rst_documents").dropDuplicates(["document_id"])
    a = rows.select("document_id", F.explode("sentence_boundaries").alias("s")).select("document_id", F.col("s.start_pos").alias("start_pos"), F.col("s.end_pos").alias("stop_pos"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 200))
    b = rows.where("text is not null").select("document_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("w")).select(
        "document_id", (F.col("w") * 200).alias("start_pos"), (F.col("w") * 200 + 200).alias("stop_pos"))
    return S.overlapping_spans(a, b, "document_id").select(
        "document_id", F.col("a_start_pos").cast("bigint").alias("sentence_start"), F.col("b_start_pos").cast("bigint").alias("window_start"))


def containing_boundary(spark, d):
    """The stated boundary around every hundredth character."""
    rows = table(spark, d, "rst_documents").dropDuplicates(["document_id"])
    spans = rows.select("document_id", F.explode("sentence_boundaries").alias("s")).select("document_id", F.col("s.start_pos").alias("start_pos"), F.col("s.end_pos").alias("stop_pos"))
    points = rows.where("length(text) > 0").select("document_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(100))).alias("pos"))
    return S.points_in_spans(points, spans, "document_id").select("document_id", F.col("pos").cast("bigint").alias("pos"), F.col("start_pos").cast("bigint").alias("start_pos"))


def section_spans(spark, d):
    return S.sections(table(spark, d, "documents")).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("stop_pos").cast("bigint").alias("stop_pos"))


def speakers(spark, d):
    """Speaker turns of all documents: how many a participant has, by resolution."""
    turns = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\r?\n[ \t]*\r?\n")).alias("turn")).where(S.marked_turn(F.col("turn")))
    return turns.select("doc_id", S.speaker(F.col("turn")).alias("s")).groupBy("doc_id", F.col("s.name").alias("name"), F.col("s.participant").alias("participant"), F.col("s.resolution").alias("resolution")).agg(F.count("*").alias("turns"))


def normalised_lines(spark, d):
    """Line ends brought to one form."""
    t = F.regexp_replace("text", "\r\n?", "\n")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("n_chars"), (F.length("text") - F.length(t)).cast("bigint").alias("removed"))


def _segments(spark, d):
    return table(spark, d, "prepared_segments").groupBy("segment_key").agg(
        *[F.min(c).alias(c) for c in ("source_id", "segment_id", "kind", "text", "source_item_id", "requirement_id")], F.min("ord").cast("bigint").alias("ord"))


def assembled_ranges(spark, d):
    """Ranges of segments in their source's concatenated text."""
    w = _segments(spark, d).withColumn("ord", F.col("ord") * 1_000_000_000 + F.col("segment_key") % 1_000_000_000)
    return P.assembled(w, ["source_id"]).select("segment_key", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("stop_pos").cast("bigint").alias("stop_pos"))


def segment_dispositions(spark, d):
    rows = _segments(spark, d)
    return P.disposition(rows, ["source", "derived"], ["source_id"], "kind", "text", "segment_key", "segment_key").select("segment_key", "disposition", "duplicate_of")


def admitted_items(spark, d):
    """Items a requirement admits, per requirement and classification."""
    req = table(spark, d, "requirements").select("requirement_id", F.explode("admitted_classes").alias("classification"))
    items = table(spark, d, "inventory_items").select("source_id", "item_id", "classification").distinct()
    per = items.groupBy("classification").agg(F.count("*").alias("n"))
    return req.join(broadcast_if_small(per), "classification").select("requirement_id", "classification", "n")


def requirement_views(spark, d):
    """Segments whose item's class their requirement admits."""
    seg = _segments(spark, d).where("kind = 'source' and trim(text) <> ''")
    items = table(spark, d, "inventory_items").select("source_id", F.col("item_id").alias("source_item_id"), "classification").dropDuplicates(["source_id", "source_item_id"])
    req = table(spark, d, "requirements").select("requirement_id", "admitted_classes")
    out = seg.join(items, ["source_id", "source_item_id"]).join(broadcast_if_small(req), "requirement_id")
    return out.groupBy("requirement_id", F.when(F.array_contains("admitted_classes", F.col("classification")), "primary").otherwise("retained").alias("disposition")).agg(F.count("*").alias("n"))


def front_and_back_matter(spark, d):
    """Classes revised by where headings stand; the headings of these data end the body."""
    seg = _segments(spark, d).where("kind = 'source'").groupBy("source_id", F.col("source_item_id").alias("item_id")).agg(F.min(F.struct("ord", "text")).alias("t"))
    items = table(spark, d, "inventory_items").groupBy("source_id", "item_id").agg(F.min("classification").alias("classification"), F.min("line_start").alias("line_start"))
    rows = items.join(seg, ["source_id", "item_id"], "left").withColumn("heading", F.col("t.text"))
    out = P.front_back_matter(rows, ["source_id"], "line_start", "classification", "heading", back=("objections and replies", "ergebnis", "conclusion"), abstract="findings")
    return out.groupBy("source_id", "classification", "revised").agg(F.count("*").alias("n"))


def inventory_checks(spark, d):
    items = table(spark, d, "inventory_items").groupBy("source_id", "item_id").agg(
        F.min("parent_id").alias("parent_id"), F.min("child_ids").alias("child_ids"), F.min("duplicate_of").alias("duplicate_of"))
    return P.inventory_violations(items, "source_id", "item_id", "parent_id", "child_ids", "duplicate_of").distinct()


def coverage(spark, d):
    """Primary items and their characters per source."""
    seg = _segments(spark, d).where("kind = 'source'").groupBy("source_id").agg(F.countDistinct("source_item_id").alias("covered"), F.sum(F.length("text")).alias("characters"))
    total = table(spark, d, "inventory_items").groupBy("source_id").agg(F.countDistinct("item_id").alias("items"))
    return total.join(seg, "source_id", "left").select("source_id", "items", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"), F.coalesce("characters", F.lit(0)).cast("bigint").alias("characters"))


def item_steps(spark, d):
    items = table(spark, d, "inventory_items").groupBy("source_id", "item_id").agg(
        F.coalesce(F.min("parent_id"), F.lit("")).alias("parent_id"), F.min("classification").alias("classification"), F.min("line_start").alias("line_start"))
    return P.sibling_paths(items, "source_id", "item_id", "parent_id", "classification", "line_start").select("source_id", "item_id", "step")


def table_lines(spark, d):
    """Each order as a table: a header row, then a row for each line."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    one = F.lit(1)
    cell = lambda row, col, text, head: F.struct(row.alias("row"), F.lit(col).alias("col"), text.alias("text"), F.lit(head).alias("is_header"))
    body = lines.select("table_id", F.explode(F.array(cell(F.col("row"), 0, F.col("f"), False), cell(F.col("row"), 1, F.col("s"), False))).alias("c"))
    head = lines.select("table_id").distinct().select("table_id", F.explode(F.array(cell(F.lit(0), 0, F.lit("flag"), True), cell(F.lit(0), 1, F.lit("status"), True))).alias("c"))
    cells = body.unionByName(head).select("table_id", F.col("c.row").cast("int").alias("row"), F.col("c.col").alias("col"), one.alias("row_span"), one.alias("col_span"), F.col("c.is_header").alias("is_header"), F.col("c.text").alias("text"))
    return P.linearised(cells).select("table_id", "line")


def capacity_plan(spark, d):
    """Greedy units of 400 characters over the elementary units of every annotated tree."""
    n = table(spark, d, "rst_nodes").where("kind = 'edu' and contents is not null").groupBy("project", "user_name", "doc", "id").agg(F.min("left_edge").alias("e"), F.min("contents").alias("t"))
    rows = n.select("project", "user_name", "doc", (F.col("e") * 1000 + F.col("id").cast("int") % 1000).cast("bigint").alias("ord"), F.length("t").alias("demand"), F.when(F.col("t").rlike("[.!?]$"), 2).otherwise(1).alias("rank"))
    return P.planned(rows, ["project", "user_name", "doc"], 400).groupBy("project", "user_name", "doc").agg((F.max("unit") + 1).cast("bigint").alias("units"), F.count("*").alias("segments"))


def opening_markers(spark, d):
    """Clause-opening markers of each document's language, which its text decides where it is clear."""
    docs = cut(S.with_language(table(spark, d, "documents").select("doc_id", "text", "lang"), name="spoken"))
    out = S.opening_cues(docs, OPENING_MARKERS, lang="spoken")
    return out.groupBy("doc_id", "language", "cue", "relation").agg(F.count("*").alias("n"))


def section_shards(spark, d):
    """Blocks of documents in shards of 1,000 characters; every other block opens a section."""
    s = S.sections(table(spark, d, "documents")).select("doc_id", F.col("section_no").cast("bigint").alias("ord"), "start_pos", "stop_pos", F.floor(F.col("section_no") / 2).cast("string").alias("section"))
    return P.shards(s, ["doc_id"], 1000).select("doc_id", F.col("ord").alias("section_no"), "shard", "offset")


QUERIES = {f.__name__: f for f in (
    cue_signals, cue_documents, year_mentions, sentence_spans, token_counts, overlapping_matches, document_needles, quote_resolution, span_validation, boundary_overlaps,
    containing_boundary, section_spans, speakers, normalised_lines, assembled_ranges, segment_dispositions, admitted_items, requirement_views,
    front_and_back_matter, inventory_checks, coverage, item_steps, table_lines, capacity_plan, opening_markers, section_shards)}


def _cue_sql(cues, group):
    pattern = S.cue_pattern([p for _, p, _ in cues])
    lexicon = ", ".join(f"('{c}', '{p}', '{label}')" for c, p, label in cues)
    low = "(CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END)"
    return f"""WITH lex(category, phrase, label) AS (VALUES {lexicon}),
parts AS (SELECT doc_id, lang, regexp_split_to_array({low}, '{pattern}') AS p, regexp_extract_all({low}, '{pattern}') AS m FROM documents),
hits AS (SELECT doc_id, lang, m[i] AS phrase FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM parts)
  WHERE (i = 1 OR p[i] <> '') AND (i = len(m) OR p[i + 1] <> '') AND NOT regexp_matches(p[i], '[\\p{{L}}\\p{{N}}_]$') AND NOT regexp_matches(p[i + 1], '^[\\p{{L}}\\p{{N}}_]'))
SELECT {group}, count(*) AS n FROM hits JOIN lex USING (phrase) GROUP BY ALL"""


_SEG = "seg AS (SELECT segment_key, min(source_id) AS source_id, min(kind) AS kind, min(text) AS text, min(source_item_id) AS source_item_id, min(requirement_id) AS requirement_id, min(ord) AS ord FROM prepared_segments GROUP BY 1)"
_RST = "r AS (SELECT DISTINCT ON (document_id) document_id, text, sentence_boundaries FROM rst_documents)"
ORACLES = {
    "cue_signals": _cue_sql([*CUES, *COMMON], "lang, category, label"),
    "cue_documents": _cue_sql(CUES, "doc_id, label"),
    "year_mentions": """WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[12][0-9]{3}'), lambda x: length(x)) AS g, regexp_extract_all(text, '[12][0-9]{3}') AS m FROM documents)
SELECT doc_id, CAST(list_sum(g[1:i]) + 4 * (i - 1) AS BIGINT) AS start_pos, m[i] AS year FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p)""",
    "sentence_spans": r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
e AS (SELECT doc_id, i - 1 AS sentence_no, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)),
o AS (SELECT doc_id, sentence_no, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT doc_id, sentence_no, CAST(b AS BIGINT) AS start_pos, CAST(b + length(regexp_replace(x, '\s+$', '')) AS BIGINT) AS stop_pos FROM o WHERE length(regexp_replace(x, '\s+$', '')) > 0""",
    "token_counts": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS BIGINT) AS n_tokens, greatest(1, len(regexp_extract_all(text, '\S+'))) AS estimate FROM documents""",
    "overlapping_matches": """WITH p AS (SELECT item_id, list_filter(range(length(text)), lambda i: substring(text, i + 1, 2) = 'ee') AS places FROM benchmark)
SELECT item_id, CAST(len(places) AS BIGINT) AS n, coalesce(places[len(places)], -1) AS last_start FROM p""",
    "document_needles": """WITH p AS (SELECT doc_id, list_filter(range(length(text)), lambda i: substring(text, i + 1, 2) = 'ee') AS places FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(places) AS BIGINT) AS n, coalesce(places[len(places)], -1) AS last_start FROM p""",
    "quote_resolution": r"""WITH q AS (SELECT doc_id, text, substring(text, 5, 24) AS c FROM documents WHERE text IS NOT NULL AND instr(text, '\') = 0),
r AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN c WHEN 1 THEN translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN replace(c, ' ', '  ') ELSE '[u_1] ' || c END AS q FROM q)
SELECT doc_id, CASE WHEN contains(text, q) THEN 'resolved' WHEN starts_with(q, '[u_') THEN 'unit_header' WHEN contains(lower(text), lower(q)) THEN 'case_mismatch'
WHEN contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(q, '\s+', ' ', 'g'))) THEN 'whitespace_mismatch' ELSE 'absent' END AS status FROM r""",
    "span_validation": f"""WITH {_RST}, u AS (SELECT document_id, text AS t, unnest(sentence_boundaries) AS b FROM r),
c AS (SELECT document_id, t, b['start_pos'] AS s, b['end_pos'] AS e, b['text'] AS x FROM u), f AS (SELECT *, instr(t, x) AS f FROM c)
SELECT document_id, CASE WHEN substring(t, s + 1, e - s) = x THEN 'exact' WHEN f = 0 OR x = '' THEN 'none'
WHEN instr(substring(t, f + 1), x) = 0 THEN 'unique' ELSE 'multiple' END AS status, count(*) AS n FROM f GROUP BY ALL""",
    "boundary_overlaps": f"""WITH {_RST}, s AS (SELECT document_id, unnest(sentence_boundaries) AS s FROM r),
w AS (SELECT document_id, unnest(range(greatest(1, CAST(ceil(length(text) / 200) AS BIGINT)))) * 200 AS b FROM r WHERE text IS NOT NULL)
SELECT s.document_id, CAST(s.s.start_pos AS BIGINT) AS sentence_start, w.b AS window_start FROM s JOIN w USING (document_id) WHERE s.s.start_pos < w.b + 200 AND w.b < s.s.end_pos""",
    "containing_boundary": f"""WITH {_RST}, s AS (SELECT document_id, unnest(sentence_boundaries) AS s FROM r),
p AS (SELECT document_id, unnest(range(0, length(text), 100)) AS pos FROM r WHERE length(text) > 0)
SELECT document_id, pos, CAST(s.s.start_pos AS BIGINT) AS start_pos FROM p JOIN s USING (document_id) WHERE s.s.start_pos <= pos AND pos < s.s.end_pos""",
    "section_spans": r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(\n\s*\n)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
e AS (SELECT doc_id, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)),
o AS (SELECT doc_id, i, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(regexp_extract(x, '^\s*')) AS lead, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS core FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS section_no, CAST(b + lead AS BIGINT) AS start_pos, CAST(b + lead + core AS BIGINT) AS stop_pos FROM o WHERE core > 0""",
    "speakers": r"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n')) AS turn FROM documents),
m AS (SELECT doc_id, nullif(trim(regexp_extract(turn, '^\s*(?:\*\*)?([^:\n]+?)(?: \(participant ([\w.-]+)\))?:(?:\*\*)?\s+', 1)), '') AS name,
nullif(regexp_extract(turn, '^\s*(?:\*\*)?([^:\n]+?)(?: \(participant ([\w.-]+)\))?:(?:\*\*)?\s+', 2), '') AS given FROM t
WHERE regexp_matches(turn, '^\s*(?:SPEAKER[_ -]?[0-9]+|[A-Z][A-Z0-9 _-]{1,40}):\s+') OR regexp_matches(turn, '^\s*\*\*[^:\n]+?:\*\*\s+') OR regexp_matches(turn, '^\s*[^:\n]{1,60} \(participant [\w.-]+\):\s+')),
k AS (SELECT *, name IS NULL OR lower(name) IN ('unattributed', 'unknown', 'unidentified', '?') AS un FROM m)
SELECT doc_id, name, CASE WHEN NOT un THEN coalesce(given, 'label:' || sha256(name)) END AS participant, CASE WHEN un THEN 'unresolved' ELSE 'resolved' END AS resolution, count(*) AS turns FROM k GROUP BY ALL""",
    "normalised_lines": r"""SELECT doc_id, length(regexp_replace(text, '\r\n?', chr(10), 'g')) AS n_chars, length(text) - length(regexp_replace(text, '\r\n?', chr(10), 'g')) AS removed FROM documents""",
    "assembled_ranges": f"""WITH {_SEG} SELECT segment_key, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS start_pos, CAST(coalesce(sum(length(text)) OVER w, 0) + length(text) AS BIGINT) AS stop_pos
FROM seg WINDOW w AS (PARTITION BY source_id ORDER BY ord, segment_key % 1000000000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "segment_dispositions": f"""WITH {_SEG}, c AS (SELECT *, kind IN ('source', 'derived') AND trim(coalesce(text, '')) <> '' AS c FROM seg),
f AS (SELECT *, min(CASE WHEN c THEN segment_key END) OVER (PARTITION BY source_id, CASE WHEN c THEN text END) AS first FROM c)
SELECT segment_key, CASE WHEN NOT c THEN 'retained' WHEN first = segment_key THEN 'primary' ELSE 'duplicate' END AS disposition, CASE WHEN c AND first <> segment_key THEN first END AS duplicate_of FROM f""",
    "admitted_items": """WITH i AS (SELECT DISTINCT source_id, item_id, classification FROM inventory_items), q AS (SELECT requirement_id, unnest(admitted_classes) AS classification FROM requirements)
SELECT requirement_id, classification, count(*) AS n FROM q JOIN i USING (classification) GROUP BY 1, 2""",
    "requirement_views": f"""WITH {_SEG}, i AS (SELECT DISTINCT ON (source_id, item_id) source_id, item_id, classification FROM inventory_items)
SELECT s.requirement_id, CASE WHEN list_contains(admitted_classes, classification) THEN 'primary' ELSE 'retained' END AS disposition, count(*) AS n
FROM seg s JOIN i ON i.source_id = s.source_id AND i.item_id = s.source_item_id JOIN requirements q ON q.requirement_id = s.requirement_id WHERE kind = 'source' AND trim(text) <> '' GROUP BY ALL""",
    "front_and_back_matter": rf"""WITH {_SEG}, t AS (SELECT source_id, source_item_id AS item_id, min(ROW(ord, text)) AS t FROM seg WHERE kind = 'source' GROUP BY 1, 2),
i AS (SELECT source_id, item_id, min(classification) AS k, min(line_start) AS l FROM inventory_items GROUP BY 1, 2),
j AS (SELECT i.*, coalesce(t.t[2], '') AS h FROM i LEFT JOIN t USING (source_id, item_id)),
b AS (SELECT *, min(CASE WHEN k = 'heading' AND lower(trim(h)) = 'findings' THEN l END) OVER w AS a, min(CASE WHEN k IN ('title', 'heading') THEN l END) OVER w AS hd,
min(CASE WHEN k IN ('title', 'heading') AND regexp_replace(lower(trim(regexp_replace(h, '\s+', ' ', 'g'))), ':+$', '') IN ('objections and replies', 'ergebnis', 'conclusion') THEN l END) OVER w AS bk FROM j WINDOW w AS (PARTITION BY source_id))
SELECT source_id, k AS classification, CASE WHEN l >= bk THEN CASE WHEN k IN ('title', 'heading', 'paragraph', 'list_item') THEN 'navigation' ELSE k END
WHEN k IN ('paragraph', 'list_item') AND l > hd AND l < a THEN 'metadata' ELSE k END AS revised, count(*) AS n FROM b GROUP BY ALL""",
    "inventory_checks": """WITH i AS (SELECT source_id, item_id, min(parent_id) AS parent_id, min(child_ids) AS child_ids, min(duplicate_of) AS duplicate_of FROM inventory_items GROUP BY 1, 2),
up AS (SELECT source_id, parent_id AS p, item_id AS c FROM i WHERE trim(parent_id) <> ''), down AS (SELECT source_id, item_id AS p, unnest(child_ids) AS c FROM i)
SELECT DISTINCT * FROM (
SELECT source_id, c AS item_id, 'missing_parent' AS rule FROM up WHERE (source_id, p) NOT IN (SELECT source_id, item_id FROM i) UNION ALL
SELECT source_id, c, 'parent_not_reciprocal' FROM (SELECT * FROM up EXCEPT SELECT * FROM down) UNION ALL
SELECT source_id, p, 'child_not_reciprocal' FROM (SELECT * FROM down EXCEPT SELECT * FROM up) UNION ALL
SELECT source_id, item_id, 'missing_duplicate_target' FROM i WHERE duplicate_of IS NOT NULL AND (source_id, duplicate_of) NOT IN (SELECT source_id, item_id FROM i) UNION ALL
SELECT source_id, item_id, 'duplicate_of_duplicate' FROM i WHERE duplicate_of IS NOT NULL AND (source_id, duplicate_of) IN (SELECT source_id, item_id FROM i WHERE duplicate_of IS NOT NULL))""",
    "coverage": f"""WITH {_SEG}, a AS (SELECT source_id, count(DISTINCT item_id) AS items FROM inventory_items GROUP BY 1),
b AS (SELECT source_id, count(DISTINCT source_item_id) AS covered, sum(length(text)) AS characters FROM seg WHERE kind = 'source' GROUP BY 1)
SELECT source_id, items, coalesce(covered, 0) AS covered, CAST(coalesce(characters, 0) AS BIGINT) AS characters FROM a LEFT JOIN b USING (source_id)""",
    "item_steps": """WITH i AS (SELECT source_id, item_id, coalesce(min(parent_id), '') AS p, min(classification) AS k, min(line_start) AS l FROM inventory_items GROUP BY 1, 2)
SELECT source_id, item_id, concat(k, '[', row_number() OVER (PARTITION BY source_id, p, k ORDER BY l, item_id), ']') AS step FROM i""",
    "table_lines": """WITH l AS (SELECT l_orderkey AS t, l_linenumber AS r, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
SELECT t AS table_id, concat('[row=', r, ', column=0, row_span=1, column_span=1] flag: ', f) AS line FROM l UNION ALL SELECT t, concat('[row=', r, ', column=1, row_span=1, column_span=1] status: ', s) FROM l""",
    "section_shards": r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace(text, '(\n\s*\n)', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
e AS (SELECT doc_id, i, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)),
o AS (SELECT doc_id, i, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(regexp_extract(x, '^\s*')) AS lead, length(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS core FROM e),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, CAST(b + lead AS BIGINT) AS a, CAST(b + lead + core AS BIGINT) AS z FROM o WHERE core > 0),
r AS (SELECT doc_id, n, a AS begin_at, 0 AS shard FROM u WHERE n = 1 UNION ALL
SELECT u.doc_id, u.n, CASE WHEN u.z - r.begin_at > 1000 OR (u.n // 2 <> r.n // 2 AND u.z - r.begin_at >= 500) THEN u.a ELSE r.begin_at END, r.shard + CASE WHEN u.z - r.begin_at > 1000 OR (u.n // 2 <> r.n // 2 AND u.z - r.begin_at >= 500) THEN 1 ELSE 0 END
FROM r JOIN u ON u.doc_id = r.doc_id AND u.n = r.n + 1)
SELECT doc_id, n AS section_no, shard, begin_at AS "offset" FROM r""",
}
