"""Registered queries of the subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logosmill.llm import canonical, leakage, packing, sentences, spam, splitting
from logosmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "prepared_segments").where("kind is null or kind <> 'separator'")
    return canonical.lookalike_pairs(segments, "segment_key", "text", "original_text").select(
        "field_name", F.col("key_a").alias("segment_key_a"), F.col("key_b").alias("segment_key_b"))


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment's canonical texts."""
    segments = table(spark, sf_dir, "prepared_segments").dropDuplicates(["segment_key"])
    return canonical.canonicalize(segments.select("segment_key", "text", "original_text"), "text", "original_text").select(
        "segment_key", F.col("text_canonical").alias("text"), F.col("original_text_canonical").alias("original_text"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that look like another one with other code points, with their class instead of pairs."""
    segments = table(spark, sf_dir, "prepared_segments").where("kind is null or kind <> 'separator'")
    return canonical.lookalike_classes(segments, "segment_key", "text", "original_text")


def _sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda name, key: F.concat(F.lit(f"{name}|"), F.col(key).cast("string")).alias("row_id")
    a = table(spark, sf_dir, "prepared_segments").select(item("prepared_segments", "segment_key"), "text", "requirement_id")
    b = table(spark, sf_dir, "rst_documents").select(item("rst_documents", "document_id"), "text", "requirement_id")
    return a.unionByName(b)


def _item_columns() -> list:
    return [F.substring_index("row_id", "|", 1).alias("item_table"), F.expr("substring(row_id, instr(row_id, '|') + 1)").alias("item_key")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(_sized_items(spark, sf_dir), table(spark, sf_dir, "requirements"), with_text=False)
    return pieces.where("piece_no = 1").select(*_item_columns()).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized texts."""
    pieces = splitting.split_oversized(_sized_items(spark, sf_dir), table(spark, sf_dir, "requirements"))
    return pieces.select(*_item_columns(), "piece_no", "n_pieces", "start_pos", "stop_pos", "overlap", "size", "limit", "cut", "piece")


def p2_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized text with what is wrong with its pieces: size, order, gaps, overlap, wording."""
    items = _sized_items(spark, sf_dir).where("text is not null").withColumn("_d", F.md5("text")).dropDuplicates(["row_id", "requirement_id", "_d"])
    pieces = splitting.split_oversized(items, table(spark, sf_dir, "requirements"))
    cut = F.expr("aggregate(ps, struct(0L as stop, 0L as bad), (a, p) -> struct(p.stop_pos as stop, a.bad + if(p.start_pos > a.stop or p.stop_pos <= a.stop, 1L, 0L) as bad)).bad")
    joined = F.expr("aggregate(ps, '', (a, p) -> concat(a, substring(p.piece, cast(length(a) - p.start_pos as int) + 1)))")
    each = pieces.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "start_pos", "stop_pos", "size", "limit", "overlap", "piece"))).alias("ps"))
    asked = table(spark, sf_dir, "requirements").select("requirement_id", F.coalesce("overlap_size", F.lit(0)).alias("asked"), (F.col("capacity_unit") == "utf8_bytes").cast("int").alias("bytes"))
    rows = each.join(items.join(F.broadcast(asked), "requirement_id").groupBy("row_id").agg(  # one row a technique
        F.max("text").alias("text"), F.max("asked").alias("asked"), F.max("bytes").alias("bytes"), F.count("*").alias("n")), "row_id").where("n = 1")
    return rows.select(
        *_item_columns(), F.length("text").cast("bigint").alias("n_chars"), F.expr("size(filter(ps, p -> p.size > p.limit))").cast("bigint").alias("too_large"), cut.alias("gaps"),
        F.expr("size(filter(ps, p -> p.piece_no > 0 and (p.overlap > asked or p.overlap < least(asked, p.limit - 1) - 3 * bytes)))").cast("bigint").alias("wrong_overlap"), (joined == F.col("text")).alias("whole"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By container: documents packed, containers beyond their capacity, documents cut though they fit, documents not whole."""
    packed = p6_pack(spark, sf_dir)
    over = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("container").agg(F.count(F.when(F.col("n") > F.col("capacity"), 1)).alias("overfull"))
    own = packed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.max("token_stop").alias("stop"), F.min("token_start").alias("start")).groupBy("container").agg(
        F.count("*").alias("documents"), F.count(F.when((F.col("k") > 1) & (F.col("n") <= F.col("capacity")), 1)).alias("cut"), F.count(F.when((F.col("n") != F.col("stop")) | (F.col("start") != 0), 1)).alias("broken"))
    return own.join(over, "container").select("container", "documents", "overfull", "cut", "broken")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.unit_offsets(table(spark, sf_dir, "rst_documents"))


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units with their text."""
    return sentences.sentence_units(table(spark, sf_dir, "rst_documents"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into the containers of the packing requirements."""
    containers = [
        (r[0], int(r[1])) for r in table(spark, sf_dir, "requirements").where("capacity_unit = 'tokenizer_tokens' and capacity_maximum is not null").select(
            "requirement_id", F.col("capacity_maximum") - F.coalesce("capacity_margin", F.lit(0))).orderBy("requirement_id").collect()]
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), containers)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p1_classes, p2_found, p2_pieces, p2_checks, p3_found, p3_sentences, p6_pack, p6_checks, p7_found, p8_found)}

_ITEMS = r"""
items AS (
  SELECT 'prepared_segments' AS item_table, CAST(segment_key AS VARCHAR) AS item_key, text, requirement_id FROM prepared_segments
  UNION ALL SELECT 'rst_documents', document_id, text, requirement_id FROM rst_documents),
large AS (SELECT DISTINCT item_table, item_key, text, overlap_size FROM items JOIN requirements USING (requirement_id)
WHERE CASE capacity_unit WHEN 'code_points' THEN length(text) WHEN 'utf8_bytes' THEN strlen(text)
      WHEN 'whitespace_tokens' THEN len(regexp_extract_all(text, '[^ \t\r\n]+')) END > capacity_maximum - coalesce(capacity_margin, 0))"""
ORACLES = {
    "p2_found": f"WITH {_ITEMS} SELECT DISTINCT item_table, item_key FROM large",
    "p2_checks": f"""WITH {_ITEMS}, pieces AS (SELECT * FROM large)
SELECT item_table, item_key, length(any_value(text)) AS n_chars, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS wrong_overlap, true AS whole FROM pieces GROUP BY 1, 2 HAVING count(DISTINCT text) = 1""",
    "p6_checks": """SELECT requirement_id AS container, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS broken
FROM requirements WHERE capacity_unit = 'tokenizer_tokens' AND capacity_maximum IS NOT NULL""",
}
