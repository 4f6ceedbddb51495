"""Preparing content: admission, duplicates, running ranges, projections, inventory checks, planning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.operators.grouped import on_whole_groups


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, bucket: int = 1024) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, exclusive, in two levels.

    Rows are bucketed by ``order``; totals of buckets are summed up among buckets and
    each bucket's rows among themselves, so a group with a third of all rows is spread
    over many tasks.  ``order`` must be a number, unique within the group.
    """
    rows = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / bucket))
    totals = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(totals, [*keys, "_b"]).withColumn(
        name, F.col("_before") + F.col("_in")).drop("_v", "_b", "_in", "_before")


def assembled(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of segments in their concatenated text: start_pos and stop_pos beside each."""
    out = running_total(segments, keys, "ord", F.length("text").cast("bigint"), "start_pos")
    return out.withColumn("stop_pos", F.col("start_pos") + F.length("text"))


def disposition(items: DataFrame, primary: list[str], group: list[str], klass: str, text: str, order: str, item: str) -> DataFrame:
    """Adds ``disposition`` (primary, retained, duplicate) and ``duplicate_of``.

    Content of a primary class that isn't blank is primary, except that of several with
    the same text digest in a group the first counts and the others are its duplicates.
    """
    candidate = F.col(klass).isin(*primary) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    rows = items.withColumn("_c", candidate).withColumn("_d", F.when(F.col("_c"), F.md5(text)))
    first = rows.where("_c").groupBy(*group, "_d").agg(F.min(F.struct(F.col(order).alias("o"), F.col(item).alias("i"))).alias("_f"))
    out = rows.join(first, [*group, "_d"], "left")
    is_first = F.col("_f.i") == F.col(item)
    return out.withColumn("disposition", F.when(~F.col("_c"), "retained").when(is_first, "primary").otherwise("duplicate")).withColumn(
        "duplicate_of", F.when(F.col("_c") & ~is_first, F.col("_f.i"))).drop("_c", "_d", "_f")


def after_first(rows: DataFrame, keys: list[str], order: str, mark: Column, name: str) -> DataFrame:
    """Sticky flag: true from the first marked row of the group on.  No window is needed."""
    first = rows.where(mark).groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys, "left").withColumn(name, F.coalesce(F.col(order) >= F.col("_first"), F.lit(False))).drop("_first")


def front_back_matter(items: DataFrame, keys: list[str], order: str, klass: str, heading: str,
                      back: tuple[str, ...] = ("references", "bibliography", "works cited"), abstract: str = "abstract") -> DataFrame:
    """Adds ``revised``: metadata between the first heading and the abstract, navigation from the back matter on."""
    name = F.rtrim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(heading), F.lit("")), r"\s+", " "))), ":+$", ""))
    is_heading = F.col(klass).isin("title", "heading")
    bounds = items.groupBy(*keys).agg(
        F.min(F.when((F.col(klass) == "heading") & (F.lower(F.trim(heading)) == abstract), F.col(order))).alias("_abs"),
        F.min(F.when(is_heading, F.col(order))).alias("_head"),
        F.min(F.when(is_heading & name.isin(*back), F.col(order))).alias("_back"))
    out = items.join(bounds, keys)
    prose = F.col(klass).isin("paragraph", "list_item")
    return out.withColumn(
        "revised",
        F.when(F.col(order) >= F.col("_back"), F.when(is_heading | prose, "navigation").otherwise(F.col(klass)))
        .when(prose & (F.col(order) > F.col("_head")) & (F.col(order) < F.col("_abs")), "metadata").otherwise(F.col(klass)),
    ).drop("_abs", "_head", "_back")


def inventory_violations(items: DataFrame, group: str, item: str, parent: str, children: str, duplicate_of: str) -> DataFrame:
    """(group, item, rule): repeated ids, missing parents, links stated by one side, missing duplicate targets, chains of duplicates."""
    one = items.dropDuplicates([group, item])
    ids = one.select(group, item)
    blank = F.col(parent).isNull() | (F.trim(parent) == "")
    up = one.where(~blank).select(group, F.col(parent).alias("p"), F.col(item).alias("c"))
    down = one.select(group, F.col(item).alias("p"), F.explode(children).alias("c"))
    rule = lambda df, col, name: df.select(group, F.col(col).alias(item), F.lit(name).alias("rule"))
    known = lambda name: ids.withColumnRenamed(item, name)
    target = one.where(F.col(duplicate_of).isNotNull()).select(group, item, F.col(duplicate_of).alias("t"))
    parts = [
        rule(items.groupBy(group, item).count().where("count > 1"), item, "repeated_id"),
        rule(up.join(known("p"), [group, "p"], "left_anti"), "c", "missing_parent"),
        rule(up.join(down, [group, "p", "c"], "left_anti"), "c", "parent_not_reciprocal"),
        rule(down.join(up, [group, "p", "c"], "left_anti").select(group, "p").distinct(), "p", "child_not_reciprocal"),
        rule(target.join(known("t"), [group, "t"], "left_anti"), item, "missing_duplicate_target"),
        rule(target.join(target.select(group, F.col(item).alias("t")), [group, "t"], "left_semi"), item, "duplicate_of_duplicate"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sibling_paths(items: DataFrame, group: str, item: str, parent: str, name: str, order: str) -> DataFrame:
    """Adds ``step``: the element's name with its position among siblings of that name."""
    w = Window.partitionBy(group, parent, name).orderBy(order, item)
    return items.withColumn("step", F.concat(F.col(name), F.lit("["), F.row_number().over(w).cast("string"), F.lit("]")))


def linearised(cells: DataFrame) -> DataFrame:
    """Text of table cells with their headers.

    ``cells``: table_id, row, col, row_span, col_span, is_header, text.  Headers of a cell
    are the header cells above it that cover its column, from top to bottom.
    """
    body = cells.where("not is_header")
    heads = cells.where("is_header").select("table_id", F.col("row").alias("h_row"), F.col("text").alias("h_text"), F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    found = body.join(heads, ["table_id", "col"], "left").groupBy("table_id", "row", "col", "row_span", "col_span", "text").agg(
        F.sort_array(F.collect_list(F.when(F.col("h_row") < F.col("row"), F.struct("h_row", "h_text")))).alias("hs"))
    place = F.format_string("[row=%d, column=%d, row_span=%d, column_span=%d] ", "row", "col", "row_span", "col_span")
    head = F.array_join("hs.h_text", " / ")
    return found.select("table_id", "row", "col", F.concat(place, F.when(F.size("hs") > 0, F.concat(head, F.lit(": "))).otherwise(""), F.col("text")).alias("line"))


def planned(segments: DataFrame, keys: list[str], capacity: int, ranks: bool = True) -> DataFrame:
    """Greedy contiguous units under ``capacity``: adds ``unit`` to (keys, ord, demand, rank).

    When a segment doesn't fit, the unit is cut back to its boundary of the best rank,
    the latest on ties; a segment above the capacity is a unit of its own, flagged by
    ``oversized``.  A group is one document; Python because every cut depends on the last.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", ord bigint, unit int, oversized boolean"

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        demand, rank = pdf.demand.tolist(), pdf["rank"].tolist()
        unit, start, total, i = [0] * len(demand), 0, 0, 0
        number = 0
        while start < len(demand):
            total, i = 0, start
            while i < len(demand) and (i == start or total + demand[i] <= capacity):
                total += demand[i]
                i += 1
            if i < len(demand) and ranks and i - start > 1:
                best = max(range(start, i), key=lambda j: (rank[j], j))
                i = best + 1
            for j in range(start, i):
                unit[j] = number
            number, start = number + 1, i
        out = pdf[keys].astype(str).copy()
        out["ord"], out["unit"], out["oversized"] = pdf.ord, unit, [d > capacity for d in demand]
        return out

    return segments.select(*keys, "ord", "demand", "rank").groupBy(*keys).applyInPandas(plan, schema)


def shards(units: DataFrame, keys: list[str], max_chars: int) -> DataFrame:
    """Adds ``shard`` and ``offset`` to units (keys, ord, start_pos, stop_pos, section).

    A new shard begins where the span would exceed ``max_chars``, or where the section
    changes and the span has come to half of it.  One document's units are folded in
    order, as a shard's begin depends on the one before.
    """
    item = F.struct("ord", "start_pos", "stop_pos", "section")
    state = "struct<shard:int,begin:bigint,section:string,out:array<struct<ord:bigint,shard:int,offset:bigint>>>"
    none = F.lit(None)
    zero = F.struct(F.lit(-1).alias("shard"), none.cast("bigint").alias("begin"), none.cast("string").alias("section"), F.array().alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        span = x["stop_pos"] - acc["begin"]
        fresh = acc["begin"].isNull() | (span > max_chars) | (~x["section"].eqNullSafe(acc["section"]) & (span >= max_chars // 2))
        shard, begin = acc["shard"] + fresh.cast("int"), F.when(fresh, x["start_pos"]).otherwise(acc["begin"])
        row = F.struct(x["ord"].cast("bigint").alias("ord"), shard.alias("shard"), begin.cast("bigint").alias("offset"))
        return F.struct(shard.alias("shard"), begin.cast("bigint").alias("begin"), x["section"].cast("string").alias("section"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

    placed = units.groupBy(*keys).agg(F.aggregate(F.sort_array(F.collect_list(item)), zero, step, lambda a: a["out"]).alias("_x"))
    return units.join(placed.select(*keys, F.explode("_x").alias("_x")).select(*keys, F.col("_x.ord").alias("ord"), F.col("_x.shard").alias("shard"), F.col("_x.offset").alias("offset")), [*keys, "ord"])


# The class of an element by its tag; other tags are 'other'.
TAG_CLASSES = {
    "metadata": "head summary label thread layer location hours minutes seconds msecs", "title": "title", "heading": "heading chapter", "paragraph": "text footnote", "group": "list group track",
    "list_item": "ldiv", "table": "table tabular index", "table_cell": "ched rhed corn srow fcel ecel", "code": "code", "formula": "formula", "picture": "picture cover frame", "caption": "caption",
    "picture_description": "description", "field": "field_region field_heading field_item key value", "asset": "asset audio"}
LAYERS = {"furniture": "furniture", "background": "background", "invisible": "invisible"}  # fixed values: layers that decide the class
HEAD_TAGS = ["label", "thread", "layer", "location"]  # fixed values: parts of an element's head


def content_class(tag: Column, ancestors: Column, layer: Column, decorative: Column, is_turn: Column) -> Column:
    """The class of a document element from its tag, the tags above it, its layer, and whether it lies in a decorative picture or is a speaker's turn."""
    under = lambda *tags: F.arrays_overlap(F.coalesce(ancestors, F.array().cast("array<string>")), F.array(*map(F.lit, tags)))
    of_tag = F.create_map(*[F.lit(x) for name, tags in TAG_CLASSES.items() for t in tags.split() for x in (t, name)])
    own = F.coalesce(of_tag[tag], F.lit("other"))
    own = F.when(is_turn, "turn").otherwise(own)
    in_table = under("table", "tabular", "index") & ~tag.isin("table", "tabular", "index", *HEAD_TAGS)
    return (
        F.when(tag.isin("head", "custom") | under("head", "custom"), "metadata").when(tag.isin("page_header", "page_footer") | under("page_header", "page_footer"), "furniture")
        .when(layer.isin(*LAYERS), layer).when(decorative & (tag != "picture"), "furniture").when(in_table, "table_cell").when(under("picture") & (own == "paragraph"), "picture_description")
        .when(under("field_region", "field_item") & ~tag.isin(*HEAD_TAGS), "field").when((layer == "notes") & (own == "paragraph"), "note").otherwise(own))


def merged_cells(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, col, owner_row, owner_col, row_span, col_span, problem) of table cells (key, row, col, token).

    lcel continues the cell to the left, ucel the one above, xcel both where they are one
    and the same; other tokens begin a cell.  problem: 'no_owner' for a continuation of
    nothing, 'not_rectangular' for all cells of a merge that is no rectangle, else null.
    A table is worked on whole, row by row, as owners depend on earlier owners.
    """
    kind = cells.schema[key].dataType.simpleString()

    def merge(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for name, table in part.groupby(key, sort=False):
            owner: dict[tuple[int, int], tuple[int, int] | None] = {}
            for r, c, token in sorted(zip(table["row"], table["col"], table["token"].fillna(""))):
                left, above = owner.get((r, c - 1)), owner.get((r - 1, c))
                owner[r, c] = {"lcel": left, "ucel": above, "xcel": left if left == above else None}.get(token, (r, c))
            held: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for at, o in owner.items():
                if o is not None:
                    held.setdefault(o, []).append(at)
            rows = []
            for (r, c), o in owner.items():
                if o is None:
                    rows.append((name, r, c, None, None, None, None, "no_owner"))
                    continue
                high, wide = max(a for a, _ in held[o]) - o[0] + 1, max(b for _, b in held[o]) - o[1] + 1
                whole = len(held[o]) == high * wide and min(held[o]) == o and min(b for _, b in held[o]) == o[1]
                rows.append((name, r, c, *o, high, wide, None if whole else "not_rectangular"))
            yield pd.DataFrame(rows, columns=[key, "row", "col", "owner_row", "owner_col", "row_span", "col_span", "problem"]).astype({n: "Int32" for n in ("row", "col", "owner_row", "owner_col", "row_span", "col_span")})

    known = cells.where(F.col(key).isNotNull() & F.col("row").isNotNull() & F.col("col").isNotNull()).select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "token")
    return on_whole_groups(known, [key], merge, f"{key} {kind}, row int, col int, owner_row int, owner_col int, row_span int, col_span int, problem string")


def line_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_no, unit): one elementary unit a line that is not blank, trimmed, numbered from 1."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("i", "unit")).select(key, (F.col("i") + 1).alias("unit_no"), "unit")


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Adds ``fold``, 0 to k - 1, from the digest of the key; equal keys share a fold, a null key has none."""
    return rows.withColumn("fold", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % k))
