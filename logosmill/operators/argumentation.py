"""Abstract argumentation frameworks: semantics, predicates, validation, compilers.

A framework is given by rows (af_id, arg, ord) and (af_id, src, dst).
:func:`extensions` gives its semantics whatever its size: up to 62 arguments, of which
at most 12 are open after the grounded extension, it becomes one row of bit masks and
all is expressions on longs inside the JVM; other frameworks go through
:func:`extensions_large`.  The functions on masks raise an error beyond their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small, cut

MASK_LIMIT = 62
OPEN_LIMIT = 12  # open arguments of which all subsets are tried
ARGUMENT_LIMIT, EXTENSION_LIMIT = 128, 4096  # fixed values: capacities of the exact kernel


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def violations(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """(af_id, rule, detail): repeated arguments, attacks with an unknown end, no arguments."""
    repeated = args.groupBy("af_id", "arg").count().where("count > 1").select("af_id", F.lit("duplicate_argument").alias("rule"), F.col("arg").alias("detail"))
    ends = attacks.select("af_id", F.explode(F.array("src", "dst")).alias("arg")).distinct()
    unknown = ends.join(args, ["af_id", "arg"], "left_anti").select("af_id", F.lit("unknown_endpoint").alias("rule"), F.col("arg").alias("detail"))
    empty = attacks.select("af_id").distinct().join(args, "af_id", "left_anti").select("af_id", F.lit("no_arguments").alias("rule"), F.lit(None).cast("string").alias("detail"))
    return repeated.unionByName(unknown).unionByName(empty)


def cleaned(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """Distinct attacks between known arguments."""
    known = args.select("af_id", "arg").distinct()
    a = attacks.select("af_id", "src", "dst").distinct()
    a = a.join(known.withColumnRenamed("arg", "src"), ["af_id", "src"], "left_semi")
    return a.join(known.withColumnRenamed("arg", "dst"), ["af_id", "dst"], "left_semi").select("af_id", "src", "dst")


def masks(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """(af_id, n, names, att): att[i] holds the attackers of argument i as bits, in order of ``ord``.

    A framework of more than MASK_LIMIT arguments is an error.
    """
    out = _masks(args, attacks)
    wrong = F.raise_error(F.format_string("framework %s has %s arguments: too many for masks, see extensions()", F.col("af_id").cast("string"), F.col("n").cast("string")))
    return out.withColumn("att", F.when(F.col("n") > MASK_LIMIT, wrong).otherwise(F.col("att")))


def _masks(args: DataFrame, attacks: DataFrame) -> DataFrame:
    numbered = args.select("af_id", "arg", "ord").groupBy("af_id", "arg").agg(F.min("ord").alias("ord")).withColumn("i", F.row_number().over(Window.partitionBy("af_id").orderBy("ord", "arg")) - 1)
    ids = numbered.select("af_id", "arg", "i")
    into = attacks.join(ids.select("af_id", F.col("arg").alias("src"), F.col("i").alias("s")), ["af_id", "src"]).groupBy(
        "af_id", F.col("dst").alias("arg")).agg(F.bit_or(_bit(F.col("s"))).alias("m"))
    rows = ids.join(into, ["af_id", "arg"], "left").groupBy("af_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "arg", F.coalesce("m", F.lit(0).cast("bigint")).alias("m")))).alias("r"))
    return rows.select("af_id", F.size("r").alias("n"), F.col("r.arg").alias("names"), F.col("r.m").alias("att"))


def _fold(n: Column, zero: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def attacked(s: Column, n: Column, att: Column) -> Column:
    """Bits of the arguments attacked by the set ``s``."""
    return _fold(n, _zero(), lambda acc, j: acc.bitwiseOR(F.when(F.get(att, j).bitwiseAND(s) != 0, _bit(j)).otherwise(_zero())))


def acceptable(s: Column, n: Column, att: Column) -> Column:
    """Bits of the arguments that ``s`` defends: every attacker is attacked by ``s``."""
    hit = attacked(s, n, att)
    # One-element transform: the attacked set is computed once per application.
    return F.element_at(F.transform(F.array(hit), lambda h: _fold(n, _zero(), lambda acc, i: acc.bitwiseOR(
        F.when(F.get(att, i).bitwiseAND(F.bitwise_not(h)) == 0, _bit(i)).otherwise(_zero())))), 1)


def grounded(frameworks: DataFrame) -> DataFrame:
    """Adds in_mask and out_mask of the grounded extension; n applications reach the fixpoint."""
    n, att = F.col("n"), F.col("att")
    least = F.aggregate(F.sequence(F.lit(1), n), _zero(), lambda s, _: acceptable(s, n, att))
    return frameworks.withColumn("in_mask", least).withColumn("out_mask", attacked(F.col("in_mask"), n, att))


def _with_open(frameworks: DataFrame) -> DataFrame:
    open_ids = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _bit(i).bitwiseAND(F.col("in_mask").bitwiseOR(F.col("out_mask"))) == 0)
    return grounded(frameworks).withColumn("open_ids", open_ids)


def complete(frameworks: DataFrame) -> DataFrame:
    """One row per complete extension (``ext`` mask): only what grounded leaves open is enumerated.

    More than 20 open arguments are an error; :func:`extensions` searches instead from 12 on.
    """
    n, att = F.col("n"), F.col("att")
    wrong = F.raise_error(F.format_string("framework %s leaves more than 20 arguments open, see extensions()", F.col("af_id").cast("string")))
    g = _with_open(frameworks) if "open_ids" not in frameworks.columns else frameworks
    g = g.withColumn("open_ids", F.when(F.size("open_ids") > 20, wrong).otherwise(F.col("open_ids")))
    sets = g.withColumn("pick", F.explode(F.sequence(_zero(), _bit(F.size("open_ids")) - 1)))
    spread = F.aggregate(
        F.sequence(F.lit(0), F.size("open_ids")), F.col("in_mask"),
        lambda acc, k: acc.bitwiseOR(F.when(F.col("pick").bitwiseAND(_bit(k)) != 0, _bit(F.get(F.col("open_ids"), k))).otherwise(_zero())))
    sets = sets.withColumn("ext", spread)
    ok = (attacked(F.col("ext"), n, att).bitwiseAND(F.col("ext")) == 0) & (acceptable(F.col("ext"), n, att) == F.col("ext"))
    return sets.where(ok).select("af_id", "n", "names", "att", "ext")


def preferred(completes: DataFrame) -> DataFrame:
    """Complete extensions that no other complete extension contains."""
    small, large = completes.alias("a"), completes.select("af_id", F.col("ext").alias("other")).alias("b")
    inside = (F.col("a.af_id") == F.col("b.af_id")) & (F.col("other") != F.col("ext")) & (F.col("other").bitwiseAND(F.col("ext")) == F.col("ext"))
    return small.join(large, inside, "left_anti")


def stable(completes: DataFrame) -> DataFrame:
    """Complete extensions that attack everything outside them."""
    everything = _bit(F.col("n")) - 1
    return completes.where(F.col("ext").bitwiseOR(attacked(F.col("ext"), F.col("n"), F.col("att"))) == everything)


def predicates(sets: DataFrame) -> DataFrame:
    """Adds conflict_free, admissible, is_complete and is_stable of the set ``s``."""
    n, att, s = F.col("n"), F.col("att"), F.col("s")
    hit, acc = attacked(s, n, att), acceptable(s, n, att)
    free = hit.bitwiseAND(s) == 0
    return sets.withColumn("conflict_free", free).withColumn("admissible", free & (acc.bitwiseAND(s) == s)).withColumn(
        "is_complete", free & (acc == s)).withColumn("is_stable", free & (hit.bitwiseOR(s) == _bit(n) - 1))


def named(mask: Column, names: str = "names") -> Column:
    """Members of a mask in argument order, as an array."""
    return F.filter(names, lambda _, i: _bit(i).bitwiseAND(mask) != 0)


def extensions(args: DataFrame, attacks: DataFrame, kinds: tuple[str, ...] = ("grounded", "complete", "preferred", "stable")) -> DataFrame:
    """(af_id, semantics, members) of frameworks of any size, each by the way that suits it.

    A framework over the capacities of the exact kernel gives one row with semantics
    'capacity_exceeded'; one without arguments gives none.
    """
    all_ = _masks(args, attacks)
    fits = cut(_with_open(all_.where(F.col("n") <= MASK_LIMIT)))
    easy = fits.where(F.size("open_ids") <= OPEN_LIMIT)
    hard = cut(args.groupBy("af_id").agg(F.countDistinct("arg").alias("n")).where(F.col("n") > MASK_LIMIT).select("af_id").unionByName(
        fits.where(F.size("open_ids") > OPEN_LIMIT).select("af_id")))
    rows = lambda df, kind, mask: df.select(F.col("af_id").cast("string").alias("af_id"), F.lit(kind).alias("semantics"), named(F.col(mask)).alias("members"))
    parts = []
    if "grounded" in kinds:
        parts.append(rows(easy, "grounded", "in_mask"))
    if set(kinds) - {"grounded"}:
        all_complete = complete(easy)
        found = {"complete": lambda: all_complete, "preferred": lambda: preferred(all_complete), "stable": lambda: stable(all_complete)}
        parts += [rows(make(), kind, "ext") for kind, make in found.items() if kind in kinds]
    if not hard.isEmpty():
        known = broadcast_if_small(hard)
        large = extensions_large(args.join(known, "af_id", "left_semi"), attacks.join(known, "af_id", "left_semi"))
        parts.append(large.where(F.col("semantics").isin(*kinds, "capacity_exceeded")))
    return reduce(DataFrame.unionByName, parts)


def extensions_large(args: DataFrame, attacks: DataFrame) -> DataFrame:
    """(af_id, semantics, members) by backtracking, for frameworks beyond the masks.

    Python because the search is a branching one over sets of up to 128 members.  A
    framework over the capacities gives one row with semantics 'capacity_exceeded'.
    """
    schema = "af_id string, semantics string, members array<string>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        af = str(pdf.af_id.iloc[0])
        names = list(dict.fromkeys(pdf[pdf.kind == "arg"].sort_values(["ord", "a"]).a))
        if len(names) > ARGUMENT_LIMIT:
            return pd.DataFrame([(af, "capacity_exceeded", [])], columns=["af_id", "semantics", "members"])
        at = {x: i for i, x in enumerate(names)}
        n, into, out = len(names), [0] * len(names), [0] * len(names)
        for s, d in pdf[pdf.kind == "att"][["a", "b"]].itertuples(index=False):
            if s in at and d in at:
                into[at[d]] |= 1 << at[s]
                out[at[s]] |= 1 << at[d]
        union = lambda s, of: sum_or(of[i] for i in range(n) if s >> i & 1)

        def sum_or(xs: Iterator[int]) -> int:
            r = 0
            for x in xs:
                r |= x
            return r

        def close(s: int) -> int:
            hit = union(s, out)
            return sum_or(1 << i for i in range(n) if into[i] & ~hit == 0)

        ground = 0
        while (g := close(ground)) != ground:
            ground = g
        found: set[int] = set()

        def search(chosen: int, barred: int) -> None:
            if len(found) > EXTENSION_LIMIT:
                return
            # What is defended must be in; what is attacked or attacks a member is out.
            while True:
                grown = chosen | close(chosen)
                gone = barred | union(grown, out) | sum_or(into[i] for i in range(n) if grown >> i & 1)
                if grown & gone:
                    return
                if (grown, gone) == (chosen, barred):
                    break
                chosen, barred = grown, gone
            if close(chosen) == chosen:
                found.add(chosen)
            rest = ~(chosen | barred) & ((1 << n) - 1)
            if rest:
                bit = rest & -rest
                search(chosen | bit, barred)
                search(chosen, barred | bit)

        search(ground, 0)
        if len(found) > EXTENSION_LIMIT:
            return pd.DataFrame([(af, "capacity_exceeded", [])], columns=["af_id", "semantics", "members"])
        order = sorted(found, key=lambda s: (s.bit_count(), [i for i in range(n) if s >> i & 1]))
        show = lambda s: [names[i] for i in range(n) if s >> i & 1]
        rows = [(af, "grounded", show(ground)), *((af, "complete", show(s)) for s in order if close(s) == s)]
        full = [s for s in order if close(s) == s]
        rows += [(af, "preferred", show(s)) for s in full if not any(s != t and s & t == s for t in full)]
        rows += [(af, "stable", show(s)) for s in full if s | union(s, out) == (1 << n) - 1]
        return pd.DataFrame(rows, columns=["af_id", "semantics", "members"])

    both = args.select("af_id", F.lit("arg").alias("kind"), F.col("arg").alias("a"), F.lit(None).cast("string").alias("b"), F.col("ord").cast("long").alias("ord")).unionByName(
        attacks.select("af_id", F.lit("att").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("long").alias("ord")))
    return both.groupBy("af_id").applyInPandas(solve, schema)


# --- frameworks from other structures ------------------------------------------------

def from_mining(nodes: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Argument units as arguments, conflicts as attacks."""
    args = nodes.select("af_id", F.col("node_id").alias("arg"), "ord")
    return args, cleaned(args, relations.where("relation_type = 'conflict'").select("af_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


def from_ibis(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions and arguments; objections attack; rivals on an issue attack each other, and their supporters attack the rival.

    Ends are matched with known nodes before pairs are formed, so the pairs themselves
    are shuffled once for being distinct and not again.
    """
    args = nodes.where("kind in ('position', 'argument')").select("af_id", F.col("node_id").alias("arg"), "ord")
    known = args.select("af_id", "arg").distinct()
    ends = lambda df, c: df.join(known.withColumnRenamed("arg", c), ["af_id", c], "left_semi")
    objects = ends(ends(links.where("relation = 'objects_to'").select("af_id", F.col("source").alias("src"), F.col("target").alias("dst")), "src"), "dst")
    positions = nodes.where("kind = 'position'").select("af_id", F.col("node_id").alias("p")).distinct()
    responds = links.where("relation = 'responds_to'").select("af_id", F.col("source").alias("p"), F.col("target").alias("issue")).distinct().join(positions, ["af_id", "p"], "left_semi")
    supports = ends(links.where("relation = 'supports'").select("af_id", F.col("source").alias("src"), F.col("target").alias("p")).distinct(), "src")
    attackers = responds.select("af_id", "issue", "p", F.col("p").alias("src")).unionByName(supports.join(responds, ["af_id", "p"]).select("af_id", "issue", "p", "src"))
    rivals = attackers.join(responds.select("af_id", "issue", F.col("p").alias("dst")), ["af_id", "issue"]).where("p <> dst").select("af_id", "src", "dst")
    return args, objects.select("af_id", "src", "dst").unionByName(rivals).distinct()


def from_toulmin(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layouts and their rebuttals: (af_id, ord, rebuttals array<string>) to layout_n and layout_n_rebuttal_k."""
    rows = layouts.withColumn("layout", F.concat(F.lit("layout_"), F.row_number().over(Window.partitionBy("af_id").orderBy("ord"))))
    rebuttals = rows.select("af_id", "layout", F.posexplode("rebuttals").alias("k", "r")).select(
        "af_id", "layout", F.concat("layout", F.lit("_rebuttal_"), F.col("k") + 1).alias("arg"), "k")
    args = rows.select("af_id", F.col("layout").alias("arg"), "ord").unionByName(rebuttals.select("af_id", "arg", F.col("k").cast("long").alias("ord")))
    return args, rebuttals.select("af_id", F.col("arg").alias("src"), F.col("layout").alias("dst"))


def from_walton(instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scheme instances and their pressed critical questions.

    ``instances``: af_id, ord, questions array<struct<index,status>>.  A pressed question attacks
    its instance; ids are scheme_n and scheme_n_cq_index.
    """
    rows = instances.withColumn("scheme", F.concat(F.lit("scheme_"), F.row_number().over(Window.partitionBy("af_id").orderBy("ord"))))
    asked = rows.select("af_id", "scheme", F.explode("questions").alias("q")).where("q.status in ('open', 'undercut', 'challenged', 'unanswered_challenge', 'refuted')").select(
        "af_id", "scheme", F.concat("scheme", F.lit("_cq_"), F.col("q.index")).alias("arg"), F.col("q.index").cast("long").alias("ord"))
    args = rows.select("af_id", F.col("scheme").alias("arg"), "ord").unionByName(asked.select("af_id", "arg", "ord"))
    return args, asked.select("af_id", F.col("arg").alias("src"), F.col("scheme").alias("dst"))
