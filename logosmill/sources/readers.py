"""Readers of texts, unit lists, annotation files and token files, as tables.

Whole-file formats come in as (path, content) rows, one file a row, and are opened up
in bounded pieces: a file's content never leaves its row.
"""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits on archives.
MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_TOTAL_BYTES, MAX_RATIO = 10_000, 128 << 20, 512 << 20, 200


def form(path: Column) -> Column:
    """Form of a source by its name: text, doclang_xml, doclang_archive or unsupported."""
    low = F.lower(path)
    return (F.when(low.endswith(".dclg.xml") | low.endswith(".dclg"), "doclang_xml").when(low.endswith(".dclx"), "doclang_archive")
            .when(low.endswith(".txt") | low.endswith(".text"), "text").otherwise("unsupported"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, item_id, text) of text files, one item a file; blank files have none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit("text:document").alias("item_id"), F.col("value").alias("text")).where("trim(text) <> ''")


def unit_lists(rows: DataFrame, key: str, units: str) -> DataFrame:
    """(key, item_id, ord, text, start_pos) of JSON arrays of units, joined by one space."""
    each = rows.select(key, F.posexplode(F.from_json(units, "array<string>")).alias("ord", "text")).where("trim(text) <> ''")
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return each.select(key, F.concat(F.lit("edu:"), "ord").alias("item_id"), "ord", "text", F.coalesce(before, F.lit(0)).alias("start_pos"))


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.doc, batch.content):
            try:
                root = ET.fromstring(text)
            except (ET.ParseError, TypeError, ValueError):
                rows.append((key, None, "error", None, None, None, None))
                continue
            multi = {r.get("name") for r in root.iter("rel") if r.get("type") == "multinuc"}
            single = {r.get("name") for r in root.iter("rel") if r.get("type") != "multinuc"}
            groups = {g.get("id"): g.get("type") for g in root.iter("group")}
            for i, e in enumerate(e for e in root.iter() if e.tag in ("segment", "group")):
                rel, up = e.get("relname"), e.get("parent") or None
                # A name that is both kinds counts as multinuclear below a multinuclear parent.
                tag = None if not rel or rel == "span" else "m" if rel in multi and (rel not in single or groups.get(up) == "multinuc") else "r"
                kind = "edu" if e.tag == "segment" else e.get("type") or "span"
                rows.append((key, e.get("id"), kind, up, rel, tag, " ".join("".join(e.itertext()).split()) if kind == "edu" else None))
        yield pd.DataFrame(rows, columns=["doc", "id", "kind", "parent", "relname", "relkind", "contents"])


def rs3(files: DataFrame) -> DataFrame:
    """Nodes of RS3 or RS4 files (doc, content): doc, id, kind, parent, relname, relkind, contents; broken files give an error row."""
    return files.select("doc", "content").mapInPandas(_nodes, "doc string, id string, kind string, parent string, relname string, relkind string, contents string")


def secondary_edges(files: DataFrame) -> DataFrame:
    """(doc, id, source, target, relname) of RS4 files."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.doc, batch.content):
                try:
                    rows += [(key, e.get("id"), e.get("source"), e.get("target"), e.get("relname")) for e in ET.fromstring(text).iter("secedge")]
                except (ET.ParseError, TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["doc", "id", "source", "target", "relname"])

    return files.select("doc", "content").mapInPandas(read, "doc string, id string, source string, target string, relname string")


def token_file(lines: DataFrame) -> DataFrame:
    """Tokens of tab-separated files (doc, line_no, value): doc, sentence_no, line_no, form, begins_unit.

    Blank lines and comments part sentences; a label that says so begins a unit.
    """
    mark = (F.trim("value") == "") | F.col("value").startswith("#")
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cols = F.split("value", "\t")
    out = lines.withColumn("m", mark).withColumn("block", F.sum(F.col("m").cast("int")).over(w)).where("not m")
    return out.select("doc", F.dense_rank().over(Window.partitionBy("doc").orderBy("block")).alias("sentence_no"), "line_no", F.get(cols, F.lit(1)).alias("form"),
                      F.coalesce(F.element_at(cols, -1).rlike("(B-seg|BeginSeg=Yes|B-EDU)"), F.lit(False)).alias("begins_unit"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def doclang_items(content: str) -> list[tuple]:
    """(path, tag, depth, text) of an XML document's elements in reading order, paths with positions among same-named siblings."""
    root = ET.fromstring(content)
    out, todo = [], [(root, f"/{_local(root.tag)}[1]", 0)]
    while todo:
        e, path, depth = todo.pop()
        out.append((path, _local(e.tag), depth, " ".join((e.text or "").split()) or None))
        seen: dict[str, int] = {}
        below = []
        for c in e:
            if isinstance(c.tag, str):
                name = _local(c.tag)
                seen[name] = seen.get(name, 0) + 1
                below.append((c, f"{path}/{name}[{seen[name]}]", depth + 1))
        todo += reversed(below)
    return out


def archive_documents(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of the XML members of an archive; ValueError for unsafe archives."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len(infos) > MAX_MEMBERS or len(set(names)) != len(names) or sum(i.file_size for i in infos) > MAX_TOTAL_BYTES:
            raise ValueError("too many, repeated or too large members")
        for i in infos:
            if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/") or (i.external_attr >> 16) & 0o170000 == 0o120000 or i.flag_bits & 1:
                raise ValueError(f"unsafe member {i.filename}")
            if i.file_size > MAX_MEMBER_BYTES or i.file_size > MAX_RATIO * max(i.compress_size, 1):
                raise ValueError(f"member too large: {i.filename}")
        return [(n, z.read(n).decode("utf-8")) for n in names if n.endswith((".xml", ".dclg"))]


def doclang(files: DataFrame) -> DataFrame:
    """Items of (path, content binary) files: path, member, xpath, tag, depth, text; unreadable ones give a row with tag 'error'."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.path, batch.content):
                try:
                    docs = archive_documents(data) if data[:2] == b"PK" else [("", data.decode("utf-8"))]
                    rows += [(path, name, *item) for name, text in docs for item in doclang_items(text)]
                except (ValueError, ET.ParseError, zipfile.BadZipFile, TypeError) as e:
                    rows.append((path, None, None, "error", None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "member", "xpath", "tag", "depth", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, member string, xpath string, tag string, depth int, text string")


def strict_json(text: str) -> object:
    """JSON without repeated keys or numbers outside JSON; ValueError otherwise."""
    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(x: str) -> None:
        raise ValueError(x)

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
