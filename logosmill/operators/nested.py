"""Nested document records to flat tables with interval labels.

A record's elements refer to each other by ``parent`` and ``children``, and the two
directions need not agree.  A depth-first walk over every stated link numbers entry
(``pre``) and exit (``post``) of each occurrence of an element.  The first visit is the
element's primary occurrence; a link to an element already visited becomes a leaf
occurrence of its own, so an element with two stated parents, or a loop of links, loses
nothing.  An occurrence's parent is then the occurrence one level up whose interval
contains its own, and the link table comes from that containment alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OCCURRENCES = (
    "record_id bigint, version bigint, pre int, post int, level int, self_ref string, is_primary boolean, "
    "stated_by string, collection string, label string, content_layer string, name string, text string, content string"
)
REFERENCE_KEYS = ("$ref", "cref")  # spellings of a reference
SEPARATE = {"parent", "children", "self_ref", "label", "content_layer", "name", "text"}


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


def _clean(x: object) -> str | None:
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else None


def _target(x: object) -> str | None:
    if isinstance(x, dict):
        x = next((x[k] for k in REFERENCE_KEYS if isinstance(x.get(k), str)), None)
    return x.strip() if isinstance(x, str) else None


_SPACE, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")


def loads_deep(text: str) -> object:
    """The value of JSON text of any depth, read with a stack; ValueError if it is not JSON."""
    skip = lambda at: _SPACE.match(text, at).end()
    holders: list[list] = []  # open arrays and objects: [container, key that waits for its value]
    at = skip(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            made: object = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                holders.append([made, None])
                if c == "{":
                    holders[-1][1], at = _key(text, at, skip)
                continue
            at += 1
        elif c == '"':
            made, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            made, at = json.loads(m[0]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        # The value is complete: it goes into what holds it, which may complete that in turn.
        while holders:
            holder, key = holders[-1]
            if isinstance(holder, dict):
                holder[key] = made
            else:
                holder.append(made)
            at = skip(at)
            if text[at : at + 1] == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    holders[-1][1], at = _key(text, at, skip)
                break
            if text[at : at + 1] != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no end at {at}")
            at += 1
            made = holders.pop()[0]
        else:
            if skip(at) != len(text):
                raise ValueError("more after the value")
            return made


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return key, skip(at + 1)


def dumps_deep(value: object) -> str:
    """JSON text of a value of any depth, keys sorted."""
    out: list[str] = []
    waiting: list[tuple[bool, object]] = [(False, value)]  # (is text already, what)
    while waiting:
        done, x = waiting.pop()
        if done or not isinstance(x, (dict, list)):
            out.append(x if done else json.dumps(x))
            continue
        parts: list[tuple[bool, object]] = [(True, "{" if isinstance(x, dict) else "[")]
        for i, v in enumerate(sorted(x.items()) if isinstance(x, dict) else x):
            parts.append((True, (", " if i else "") + (json.dumps(v[0]) + ": " if isinstance(x, dict) else "")))
            parts.append((False, v[1] if isinstance(x, dict) else v))
        waiting += reversed([*parts, (True, "}" if isinstance(x, dict) else "]")])
    return "".join(out)


def _content(rest: dict) -> str:
    try:
        return json.dumps(rest, sort_keys=True)
    except RecursionError:
        return dumps_deep(rest)


def _elements(payload: str) -> list[tuple[str, dict]] | None:
    """(collection, element) of everything that has a self_ref; None if it isn't JSON."""
    try:
        top = json.loads(payload, parse_constant=_refuse)
    except RecursionError:
        try:
            top = loads_deep(payload)
        except ValueError:
            return None
    except ValueError:
        return None
    if not isinstance(top, dict):
        return []
    return [
        (name, e)
        for name, value in top.items()
        for e in (value if isinstance(value, list) else [value])
        if isinstance(e, dict) and isinstance(e.get("self_ref"), str)
    ]


def occurrences_of(payload: str, content: bool) -> list[tuple]:
    """Occurrences of one record, in pre-order; none if the payload isn't JSON."""
    found = _elements(payload)
    if not found:
        return []
    element: dict[str, tuple[str, dict]] = {}
    for name, e in found:
        element.setdefault(e["self_ref"].strip(), (name, e))
    links: dict[str, dict[str, str]] = {ref: {} for ref in element}
    has_parent: set[str] = set()
    for _, e in found:
        me = e["self_ref"].strip()
        for child in e["children"] if isinstance(e.get("children"), list) else ():
            if (c := _target(child)) in element:
                links[me][c] = "children"
    for _, e in found:
        me, p = e["self_ref"].strip(), _target(e.get("parent"))
        if p in element:
            links[p][me] = "both" if links[p].get(me) in ("children", "both") else "parent"
    for kids in links.values():
        has_parent.update(kids)
    out: list[list] = []
    seen: set[str] = set()
    clock = 0

    def enter(ref: str, by: str | None, level: int) -> int:
        nonlocal clock
        first = ref not in seen
        seen.add(ref)
        out.append([clock, None, level, ref, first, by])
        clock += 1
        return len(out) - 1

    # Elements without a stated parent begin a tree, then what only loops reach.
    for start in [*(r for r in element if r not in has_parent), *(r for r in element if r in has_parent)]:
        if start in seen:
            continue
        stack = [(enter(start, None, 0), iter(links[start].items()))]
        while stack:
            at, kids = stack[-1]
            step = next(kids, None)
            if step is None:
                out[at][1] = clock
                clock += 1
                stack.pop()
                continue
            fresh = step[0] not in seen
            k = enter(step[0], step[1], out[at][2] + 1)
            stack.append((k, iter(links[step[0]].items()) if fresh else iter(())))
    rows = []
    for pre, post, level, ref, first, by in out:
        name, e = element[ref]
        more = (None,) * 5
        if content and first:
            rest = {k: v for k, v in e.items() if k not in SEPARATE}
            more = (*(_clean(e.get(k)) for k in ("label", "content_layer", "name", "text")), _content(rest))
        rows.append((pre, post, level, _clean(ref), first, by, _clean(name), *more))
    return rows


def occurrences(records: DataFrame, content: bool = True) -> DataFrame:
    """Interval-labelled occurrences of the elements of (record_id, payload) rows.

    ``version`` tells payloads of one record id apart; equal rows sent twice give one
    set of occurrences.  Null, cut-off and otherwise invalid payloads, and JSON that
    isn't an object, give no rows.  With ``content`` false only the structure is filled
    in.  Python is needed because the walk follows references of unknown depth.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        for batch in batches:
            for i in range(0, len(batch), 50):
                part = batch.iloc[i : i + 50]
                yield pd.DataFrame(
                    [(r, v, *row) for r, v, p in zip(part.record_id, part.version, part.payload) for row in occurrences_of(p, content)],
                    columns=names,
                )

    unique = records.where(F.col("payload").isNotNull() & F.col("record_id").isNotNull()).select("record_id", F.xxhash64("payload").alias("version"), "payload")
    return unique.dropDuplicates(["record_id", "version"]).mapInPandas(walk, OCCURRENCES)


def links_by_containment(occ: DataFrame) -> DataFrame:
    """Distinct (record_id, parent_ref, child_ref, stated_by) from the interval labels.

    In pre-order, the interval one level up that contains an occurrence is the last one
    that began before it, so a running window finds it in linear time.
    """
    key = ["record_id", "version", "level"]
    up = occ.where("is_primary").select(
        "record_id", "version", (F.col("level") + 1).alias("level"), "pre", F.struct("self_ref", "post").alias("up"),
        F.lit(None).cast("string").alias("child_ref"), F.lit(None).cast("int").alias("post"), F.lit(None).cast("string").alias("stated_by"))
    down = occ.where("level > 0").select(*key, "pre", F.lit(None).cast("struct<self_ref:string,post:int>").alias("up"), F.col("self_ref").alias("child_ref"), "post", "stated_by")
    last = F.last("up", ignorenulls=True).over(Window.partitionBy(*key).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = up.unionByName(down).withColumn("in", last).where("child_ref is not null and in.post > post")
    return found.groupBy("record_id", F.col("in.self_ref").alias("parent_ref"), "child_ref").agg(F.max("stated_by").alias("stated_by"))


def element_tables(occ: DataFrame) -> dict[str, DataFrame]:
    """One table per element type, each row with its interval labels and content."""
    keep = ["record_id", "version", "pre", "post", "level", "self_ref", "label", "content_layer", "name", "text", "content"]
    kinds = {"body": "body", "furniture": "furniture", "groups": "groups", "texts": "texts", "pictures": "pictures",
             "tables": "tables", "key_value_items": "key_value_items"}
    own = occ.where("is_primary")
    tables = {k: own.where(F.col("collection") == v).select(*keep) for k, v in kinds.items()}
    tables["other"] = own.where(~F.col("collection").isin(*kinds.values())).select("collection", *keep)
    return tables


def subtree(occ: DataFrame, record_id: int, self_ref: str) -> DataFrame:
    """Everything below one element, by interval containment."""
    top = occ.where((F.col("record_id") == record_id) & (F.col("self_ref") == self_ref) & F.col("is_primary")).select(
        "version", F.col("pre").alias("t_pre"), F.col("post").alias("t_post"))
    return occ.where(F.col("record_id") == record_id).join(top, "version").where("pre > t_pre and post < t_post").drop("t_pre", "t_post")
