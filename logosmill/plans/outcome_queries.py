"""Queries on outcomes, classes of elements, trees from tables, folds and stored forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from logosmill.operators import alignment as A
from logosmill.operators import annotations as N
from logosmill.operators import preparation as P
from logosmill.operators import substrate as S
from logosmill.operators import trees as T
from logosmill.operators import viewer as V
from logosmill.plans.scoring_queries import brackets
from logosmill.plans.structure_queries import _DOWN, _LINKS
from logosmill.plans.tree_queries import _nodes
from logosmill.session import table

TECHNIQUES = [("t0", "available", ["f0", "f1"], False), ("t1", "available", ["f1"], True), ("t2", "missing_model", ["f0"], False)]  # technique, state, formalisms, needs_structured


def request_outcomes(spark, d):
    """Every event as a request for a technique."""
    known = spark.createDataFrame(TECHNIQUES, "technique string, state string, formalisms array<string>, needs_structured boolean")
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("t"), e % 4).alias("technique"), (e % 3 == 0).alias("structured"), F.when(e % 5 > 0, F.concat(F.lit("f"), e % 2)).alias("formalism"))
    return N.dispatched(rows, known).select("event_id", "outcome", "reason")


def outcome_summaries(spark, d):
    """Lines of an order as outcomes."""
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = t.select("l_orderkey", F.concat(F.lit("t"), "l_linenumber").alias("technique"), F.when(F.col("p") % 3 > 0, "result").when(F.col("p") % 2 == 0, "failed").otherwise("unavailable").alias("kind"),
                    F.when(F.col("p") % 5 > 0, F.concat(F.lit("f"), F.col("p") % 4)).alias("formalism"), F.concat(F.lit("c"), F.col("p") % 7).alias("code"))
    return N.summary_lines(rows, "l_orderkey").select("l_orderkey", F.col("line_no").cast("bigint").alias("line_no"), "line")


def label_concepts(spark, d):
    """Relation names of annotated nodes, some with an ending, as concepts."""
    coarse = spark.createDataFrame([("contrast", "c:1"), ("joint", "c:2"), ("cause", "c:3")], "label string, concept string")
    aliases = spark.createDataFrame([("sequence", "joint"), ("Concession", "contrast"), ("lost", "nowhere")], "fine string, label string")
    categories = spark.createDataFrame([("attribution", "k:1"), ("elaboration", "k:2"), ("cause", "k:3")], "category string, concept string")
    rows = table(spark, d, "rst_nodes").where("relname is not null").select(F.when(F.col("kind") == "edu", F.concat(F.col("relname"), F.lit("-n"))).otherwise(F.col("relname")).alias("label"))
    return N.resolved_labels(rows, coarse, aliases, categories).groupBy("label", "concept", "by").agg(F.count("*").alias("n"))


def element_classes(spark, d):
    """Inventory items as elements whose tags, layers and ancestors come from their numbers."""
    tags = F.array(*map(F.lit, ("text", "heading", "ldiv", "fcel", "label", "picture", "key", "head", "page_footer", "unheard")))
    above = F.array(*[F.array(*map(F.lit, a)) for a in ((), ("table",), ("picture",), ("field_item",), ("head",), ("page_header", "group"))])
    layers = F.array(*map(F.lit, ("body", "notes", "furniture", "invisible")))
    items = table(spark, d, "inventory_items").groupBy("source_id", "item_id").agg(F.min("line_start").alias("n"), F.min("classification").alias("k"))
    n = F.coalesce("n", F.lit(0))
    at = lambda a, by, m: F.element_at(a, (F.floor(n / by) % m + 1).cast("int"))
    c = P.content_class(at(tags, 1, 10), at(above, 10, 6), at(layers, 60, 4), n % 11 == 0, F.col("k") == "turn")
    return items.select("source_id", "item_id", c.alias("class"))


def line_units(spark, d):
    return P.line_units(table(spark, d, "documents")).select("doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), "unit")


def document_folds(spark, d):
    return P.folds(table(spark, d, "documents").select("doc_id"), "doc_id", 5)


def tree_diagnostics(spark, d):
    return T.diagnostics(_nodes(spark, d)).select("tree_id", "edus", F.col("depth").cast("bigint").alias("depth"), "skew", "relations")


def multigraph_edges(spark, d):
    nodes = _nodes(spark, d)
    signals = nodes.where("relname <> 'span'").select("tree_id", F.concat(F.lit("e"), "id").alias("edge_id"), F.explode(F.when(F.length("contents") % 2 == 0, F.array(F.lit("dm"), F.lit("ref"))).otherwise(F.array(F.lit("lex")))).alias("signal_type"))
    return T.graph_edges(nodes, signals)


def target_rows(spark, d):
    gold = T.target_rows(brackets(spark, d)[0], "doc_id")
    return gold.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("i", "j", "nuc", "rel")])


def trees_of_tables(spark, d):
    """Orders' lines split in the middle, as trees."""
    rows = brackets(spark, d)[0].where("s < e").select("doc_id", "s", "e", F.floor((F.col("s") + F.col("e")) / 2).cast("int").alias("split"), F.concat(F.lit("r"), "rel").alias("label"))
    out = T.tree_of_table(rows, "doc_id")
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("node_id", "parent_id", "s", "e")], "side", "label")


def json_ld(spark, d):
    return T.json_ld(_nodes(spark, d))


def _relations(nodes):
    """Relations as declared by use: 'multinuc' where a multinuclear node's child has it."""
    kinds = nodes.select("tree_id", F.col("id").alias("parent"), F.col("kind").alias("pk"))
    used = nodes.where("relname is not null").join(kinds, ["tree_id", "parent"])
    return used.select("tree_id", "relname", F.when(F.col("pk") == "multinuc", "multinuc").otherwise("rst").alias("reltype")).distinct()


def node_facts(spark, d):
    nodes = _nodes(spark, d)
    return V.node_facts(nodes, _relations(nodes))


def default_relations(spark, d):
    return V.default_relations(_relations(_nodes(spark, d)))


def moved_nodes(spark, d):
    """Elementary units hung on their tree's root, and their relation renamed where they have one."""
    nodes = _nodes(spark, d)
    roots = nodes.where("parent is null").groupBy("tree_id").agg(F.min("id").alias("root"))
    edits = nodes.where("kind = 'edu' and parent is not null").join(roots, "tree_id").select("tree_id", "id", F.col("root").alias("parent"), F.when(F.length("id") == 2, "moved").alias("relname"))
    return V.with_parent(nodes, edits).select("tree_id", "id", "parent", "relname")


def pruned_trees(spark, d):
    """Trees without what hangs under their multinuclear nodes."""
    nodes = _nodes(spark, d)
    return V.without_subtrees(nodes, nodes.where("kind = 'multinuc'")).select("tree_id", "id")


def parser_actions(spark, d):
    out = T.build_actions(brackets(spark, d)[0].where("s <= e"), "doc_id")
    return out.select("doc_id", "action", *[F.col(c).cast("bigint").alias(c) for c in ("step", "s", "e")])


def stored_boundaries(spark, d):
    """The stated texts of boundaries that differ from their range of the document."""
    rows = table(spark, d, "rst_documents").groupBy("document_id").agg(F.min("text").alias("t"), F.min("sentence_boundaries").alias("b")).select("document_id", "t", F.posexplode("b").alias("i", "s"))
    kept = A.stored_text(F.col("s.text"), F.col("t"), F.col("s.start_pos"), F.col("s.end_pos"))
    return rows.select("document_id", F.col("i").cast("bigint").alias("place"), kept.alias("stored"))


def _words(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.filter(F.split("text", "[ \\n\\r\\t]+"), lambda x: x != "")).alias("ord", "token"))


def phrase_places(spark, d):
    out = A.phrase_matches(_words(spark, d), ["of the", "the", "in the", "of the the", "that the"], "doc_id")
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.col("stop").cast("bigint").alias("stop"), "phrase")


def realigned_sentences(spark, d):
    """Sentences of documents put together again from their words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = S.simple_sentences(docs).join(docs, "doc_id").select("doc_id", F.col("sentence_no").cast("bigint").alias("unit_no"), F.expr("substring(text, cast(start_pos as int) + 1, cast(stop_pos - start_pos as int))").alias("text"))
    return A.realigned(s, _words(spark, d), "doc_id")


def tree_paths(spark, d):
    """Ways between the first and the last child of every node."""
    nodes = _nodes(spark, d)
    pairs = nodes.where("parent is not null").groupBy("tree_id", "parent").agg(F.min("id").alias("source_id"), F.max("id").alias("target_id")).where("source_id <> target_id")
    return T.tree_paths(nodes, pairs)


QUERIES = {f.__name__: f for f in (
    request_outcomes, outcome_summaries, label_concepts, element_classes, line_units, document_folds, tree_diagnostics, multigraph_edges, target_rows, trees_of_tables, json_ld,
    node_facts, default_relations, moved_nodes, pruned_trees, parser_actions, stored_boundaries, phrase_places, realigned_sentences, tree_paths)}

_NODES = """n AS (SELECT concat_ws('/', coalesce(project, ''), coalesce(user_name, ''), coalesce(doc, '')) AS tree_id, id, min(CASE WHEN trim(parent) IN ('', '0') THEN NULL ELSE parent END) AS parent,
min(kind) AS kind, min(relname) AS relname, min(contents) AS contents FROM rst_nodes WHERE id IS NOT NULL GROUP BY 1, 2)"""
_GOLD = """o AS (SELECT l_orderkey AS doc_id, CAST(count(DISTINCT l_linenumber) AS INT) AS n FROM lineitem GROUP BY 1),
b AS (SELECT doc_id, 1 AS s, n AS e FROM o UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN s ELSE (s + e) // 2 + 1 END, CASE WHEN k = 0 THEN (s + e) // 2 ELSE e END FROM b, (VALUES (0), (1)) v(k) WHERE s < e),
g AS (SELECT DISTINCT doc_id, s, e, s * e % 3 AS nuc, (s + e) % 5 AS rel FROM b)"""
ORACLES = {
    "request_outcomes": """WITH c(technique, state, fs, needs) AS (VALUES ('t0', 'available', ['f0', 'f1'], false), ('t1', 'available', ['f1'], true), ('t2', 'missing_model', ['f0'], false)),
r AS (SELECT event_id, 't' || event_id % 4 AS technique, event_id % 3 = 0 AS given, CASE WHEN event_id % 5 > 0 THEN 'f' || event_id % 2 END AS f FROM events),
x AS (SELECT event_id, CASE WHEN state IS NULL THEN 'not_implemented' WHEN state <> 'available' THEN state WHEN needs AND NOT given THEN 'structured_input_required' WHEN NOT needs AND given THEN 'structured_input_refused'
WHEN f IS NOT NULL AND NOT list_contains(fs, f) THEN 'formalism_unsupported' END AS reason FROM r LEFT JOIN c USING (technique)) SELECT event_id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'unavailable' END AS outcome, reason FROM x""",
    "outcome_summaries": """WITH t AS (SELECT l_orderkey, l_linenumber AS i, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
x AS (SELECT l_orderkey, 't' || i AS t, CASE WHEN p % 3 > 0 THEN 't' || i || ': result; formalism=' || CASE WHEN p % 5 > 0 THEN 'f' || p % 4 ELSE '(none)' END WHEN p % 2 = 0 THEN 't' || i || ': failed; c' || p % 7 ELSE 't' || i || ': unavailable; c' || p % 7 END AS line, p % 3 > 0 AS ok FROM t)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, line) AS line_no, line FROM x
UNION ALL SELECT l_orderkey, 0, 'requested: ' || count(*) || '; status: ' || CASE WHEN bool_and(ok) THEN 'complete' WHEN bool_or(ok) THEN 'partial' ELSE 'unsuccessful' END FROM x GROUP BY 1""",
    "label_concepts": """WITH x AS (SELECT CASE WHEN kind = 'edu' THEN relname || '-n' ELSE relname END AS label FROM rst_nodes WHERE relname IS NOT NULL),
y AS (SELECT label, CASE lower(trim(label)) WHEN 'contrast' THEN 'c:1' WHEN 'joint' THEN 'c:2' WHEN 'cause' THEN 'c:3' END AS c1, CASE lower(trim(label)) WHEN 'sequence' THEN 'c:2' WHEN 'concession' THEN 'c:1' END AS c2,
CASE split_part(lower(trim(label)), '-', 1) WHEN 'attribution' THEN 'k:1' WHEN 'elaboration' THEN 'k:2' WHEN 'cause' THEN 'k:3' END AS c3 FROM x)
SELECT label, coalesce(c1, c2, c3) AS concept, CASE WHEN c1 IS NOT NULL THEN 'coarse' WHEN c2 IS NOT NULL THEN 'alias' WHEN c3 IS NOT NULL THEN 'category' END AS by, count(*) AS n FROM y GROUP BY ALL""",
    "element_classes": """WITH i AS (SELECT source_id, item_id, coalesce(min(line_start), 0) AS n, min(classification) AS k FROM inventory_items GROUP BY 1, 2),
e AS (SELECT *, ['text', 'heading', 'ldiv', 'fcel', 'label', 'picture', 'key', 'head', 'page_footer', 'unheard'][n % 10 + 1] AS tag, n // 10 % 6 AS up, ['body', 'notes', 'furniture', 'invisible'][n // 60 % 4 + 1] AS layer FROM i),
o AS (SELECT *, CASE WHEN k = 'turn' THEN 'turn' ELSE ['paragraph', 'heading', 'list_item', 'table_cell', 'metadata', 'picture', 'field', 'metadata', 'other', 'other'][n % 10 + 1] END AS own FROM e)
SELECT source_id, item_id, CASE WHEN tag = 'head' OR up = 4 THEN 'metadata' WHEN tag = 'page_footer' OR up = 5 THEN 'furniture' WHEN layer IN ('furniture', 'invisible') THEN layer WHEN n % 11 = 0 AND tag <> 'picture' THEN 'furniture'
WHEN up = 1 AND tag <> 'label' THEN 'table_cell' WHEN up = 2 AND own = 'paragraph' THEN 'picture_description' WHEN up = 3 AND tag <> 'label' THEN 'field' WHEN layer = 'notes' AND own = 'paragraph' THEN 'note' ELSE own END AS class FROM o""",
    "line_units": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS u FROM documents)
SELECT doc_id, i AS unit_no, u[i] AS unit FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM l)""",
    "document_folds": "SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM documents",
    "tree_diagnostics": f"""WITH RECURSIVE {_LINKS}, {_DOWN}, {_NODES}, dd AS (SELECT tree_id, max(depth) AS depth FROM down WHERE tree_table = 'rst_nodes' GROUP BY 1),
c AS (SELECT tree_id, count(*) FILTER (kind = 'edu') AS edus, count(DISTINCT CASE WHEN relname <> 'span' THEN parent END) AS relations FROM n GROUP BY 1)
SELECT tree_id, edus, coalesce(depth, 0) AS depth, round(coalesce(depth, 0) / greatest(1, ceil(log2(greatest(edus, 1)))), 2) AS skew, relations FROM c LEFT JOIN dd USING (tree_id)""",
    "multigraph_edges": f"""WITH {_NODES} SELECT tree_id, parent AS src, id AS dst, 'e' || id AS edge_id, relname AS relation, CASE WHEN relname <> 'span' THEN CASE WHEN length(contents) % 2 = 0 THEN 'dm,ref' ELSE 'lex' END END AS signals FROM n WHERE parent IS NOT NULL""",
    "target_rows": f"WITH RECURSIVE {_GOLD} SELECT doc_id, CAST(s - 1 AS BIGINT) AS i, CAST(e - 1 AS BIGINT) AS j, CAST(CASE WHEN s = e THEN -100 ELSE nuc END AS BIGINT) AS nuc, CAST(CASE WHEN s = e THEN -100 ELSE rel END AS BIGINT) AS rel FROM g",
    "trees_of_tables": f"""WITH RECURSIVE {_GOLD}, big AS (SELECT doc_id FROM o WHERE n > 1), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s - e, s) - 1 AS id FROM g JOIN big USING (doc_id)),
p AS (SELECT c.doc_id, c.id AS node_id, q.id AS parent_id, CASE WHEN q.id IS NULL THEN NULL WHEN c.s = q.s THEN 'left' ELSE 'right' END AS side, c.s, c.e, CASE WHEN c.s < c.e THEN 'r' || c.rel END AS label
  FROM x c LEFT JOIN x q ON q.doc_id = c.doc_id AND q.s < q.e AND ((q.s = c.s AND (q.s + q.e) // 2 = c.e) OR ((q.s + q.e) // 2 + 1 = c.s AND q.e = c.e)))
SELECT doc_id, node_id, parent_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, side, label FROM p""",
    "node_facts": f"""WITH {_NODES}, r AS (SELECT DISTINCT c.tree_id, c.relname, CASE WHEN p.kind = 'multinuc' THEN 'multinuc' ELSE 'rst' END AS ty FROM n c JOIN n p ON p.tree_id = c.tree_id AND p.id = c.parent WHERE c.relname IS NOT NULL),
q AS (SELECT tree_id, relname, min(ty) AS ty FROM r GROUP BY 1, 2), e AS (SELECT concat_ws('/', coalesce(project, ''), coalesce(user_name, ''), coalesce(doc, '')) AS tree_id, id, min(left_edge) AS l, min(right_edge) AS r FROM rst_nodes WHERE id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT n.tree_id, n.parent AS id, count(*) AS k, count(*) FILTER (q.ty = 'multinuc') AS m, min(e.l) AS f, max(e.r) AS g FROM n LEFT JOIN q USING (tree_id, relname) JOIN e ON e.tree_id = n.tree_id AND e.id = n.id WHERE n.parent IS NOT NULL GROUP BY 1, 2)
SELECT n.tree_id, n.id, n.kind, n.relname, q.ty AS reltype, coalesce(k, 0) AS children, coalesce(m, 0) AS multinuc_children, f AS first_child, g AS last_child FROM n LEFT JOIN q USING (tree_id, relname) LEFT JOIN b USING (tree_id, id)""",
    "default_relations": f"""WITH {_NODES}, r AS (SELECT c.tree_id, c.relname, CASE WHEN p.kind = 'multinuc' THEN 'multinuc' ELSE 'rst' END AS reltype FROM n c JOIN n p ON p.tree_id = c.tree_id AND p.id = c.parent WHERE c.relname IS NOT NULL)
SELECT tree_id, reltype, min(relname) AS relname FROM r GROUP BY 1, 2""",
    "moved_nodes": f"""WITH {_NODES}, t AS (SELECT tree_id, min(id) AS root FROM n WHERE parent IS NULL GROUP BY 1)
SELECT tree_id, id, CASE WHEN kind = 'edu' AND parent IS NOT NULL AND root IS NOT NULL THEN root ELSE parent END AS parent, CASE WHEN kind = 'edu' AND parent IS NOT NULL AND root IS NOT NULL AND length(id) = 2 THEN 'moved' ELSE relname END AS relname FROM n LEFT JOIN t USING (tree_id)""",
    "pruned_trees": f"""WITH RECURSIVE {_NODES}, gone AS (SELECT tree_id, id FROM n WHERE kind = 'multinuc' UNION SELECT n.tree_id, n.id FROM n JOIN gone ON gone.tree_id = n.tree_id AND gone.id = n.parent) SELECT tree_id, id FROM n ANTI JOIN gone USING (tree_id, id)""",
    "parser_actions": f"WITH RECURSIVE {_GOLD} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e, e - s) - 1 AS step, CASE WHEN s = e THEN 'shift' ELSE 'reduce' END AS action, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM g",
    "stored_boundaries": """WITH r AS (SELECT document_id, min(text) AS t, min(sentence_boundaries) AS b FROM rst_documents GROUP BY 1), e AS (SELECT document_id, t, b, unnest(range(0, len(b))) AS k FROM r)
SELECT document_id, k AS place, CASE WHEN NOT coalesce(b[k + 1].start_pos >= 0 AND b[k + 1].end_pos >= b[k + 1].start_pos AND b[k + 1].end_pos <= length(t) AND substr(t, b[k + 1].start_pos + 1, b[k + 1].end_pos - b[k + 1].start_pos) = b[k + 1].text, false) THEN b[k + 1].text END AS stored FROM e""",
    "phrase_places": r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \n\r\t]+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM documents), p(phrase) AS (VALUES ('of the'), ('the'), ('in the'), ('of the the'), ('that the')),
e AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w)
SELECT doc_id, i AS ord, i + len(string_split(phrase, ' ')) AS stop, phrase FROM e, p WHERE w[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' ')""",
    "tree_paths": f"""WITH {_NODES}, k AS (SELECT tree_id, parent, min(id) AS a, max(id) AS b FROM n WHERE parent IS NOT NULL GROUP BY 1, 2),
good AS (SELECT tree_id, id FROM d)
SELECT k.tree_id, a AS source_id, b AS target_id, '<' || coalesce(x.relname, '') || ' >' || coalesce(y.relname, '') AS path FROM k JOIN n x ON x.tree_id = k.tree_id AND x.id = a JOIN n y ON y.tree_id = k.tree_id AND y.id = b
JOIN n p ON p.tree_id = k.tree_id AND p.id = k.parent JOIN good g ON g.tree_id = k.tree_id AND g.id = a WHERE a <> b""".replace("WITH ", f"WITH RECURSIVE {_LINKS}, {_DOWN}, d AS (SELECT tree_id, id FROM down WHERE tree_table = 'rst_nodes'), ", 1),
}
