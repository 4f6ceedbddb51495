"""From text to anchored spans: cues, sentences, tokens, quotes, speakers, span joins.

Offsets are 0-based, half-open code points.  Scans split each text at what they look
for; positions are running lengths of the parts, so everything stays in the JVM and
only short strings and integers are shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logosmill.functions.lexicons import CUES, UNATTRIBUTED

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
_WORD_EDGE = r"[\p{L}\p{N}_]"


def folded(text: Column) -> Column:
    """Lower case that keeps every offset: where a letter's lower case is longer, only ASCII is folded."""
    low = F.lower(text)
    ascii_only = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(low) == F.length(text), low).otherwise(ascii_only)


def cue_pattern(phrases: list[str]) -> str:
    """Pattern of which the leftmost longest phrase matches.

    A tree of shared beginnings, so that at most places in a text one character decides.
    """
    tree: dict = {}
    for p in set(phrases):
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(node: dict) -> str:
        ends = "" in node
        branches = [(" " if c == " " else re.escape(c)) + write(node[c]) for c in sorted(k for k in node if k)]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
        return body + "?" if ends else body

    return write(tree)


def _hits(text: Column, pattern: str) -> Column:
    """Matches with word boundaries, as array<struct<phrase, ...>>; a match without them hides shorter ones at its place."""
    low = F.replace(F.replace(folded(text), F.lit("\u0001"), F.lit(" ")), F.lit("\u0002"), F.lit(" "))
    parts = F.split(F.regexp_replace(low, f"({pattern})", "\u0001$1\u0002"), "\u0002", -1)

    def phrases(p: Column) -> Column:
        pairs = F.arrays_zip(F.transform(p, lambda x: F.struct(
            F.right(F.substring_index(x, "\u0001", 1), F.lit(1)).alias("before"), F.substring_index(x, "\u0001", -1).alias("phrase"),
            F.substring(x, 1, 2).alias("head"))).alias("x"), F.transform(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x: F.substring(x, 1, 2)).alias("after"))
        # A neighbouring match touches this one: its letters are no boundary.
        good = lambda y, i: (
            y["after"].isNotNull() & ~y["x"]["before"].rlike(_WORD_EDGE) & ~y["after"].rlike(f"^\u0001?{_WORD_EDGE}") & ((i == 0) | ~y["x"]["head"].startswith("\u0001")))
        return F.transform(F.filter(pairs, good), lambda y: F.struct(y["x"]["phrase"].alias("phrase")))

    # Bound to a lambda's argument, so that the text is scanned once.
    return F.element_at(F.transform(F.array(parts), phrases), 1)


def cue_scan(documents: DataFrame, key: str = "doc_id", text: str = "text", cues: list[tuple[str, str, str]] = CUES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, category, label, phrase) of every cue occurrence."""
    pattern = cue_pattern([p for _, p, _ in cues])
    spark = documents.sparkSession
    lexicon = spark.createDataFrame(cues, "category string, phrase string, label string")
    found = documents.select(key, *keep, F.explode(_hits(F.col(text), pattern)).alias("h")).select(key, *keep, F.col("h.phrase").alias("phrase"))
    return found.join(F.broadcast(lexicon), "phrase").select(key, *keep, "category", "label", "phrase")  # the lexicon is a literal list


def cue_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", cues: list[tuple[str, str, str]] = CUES) -> DataFrame:
    """(key, start_pos, stop_pos, category, label, phrase) of every cue occurrence, as :func:`cue_scan` finds them.

    Null keys and texts have none.  Only phrases, lengths and the characters beside them
    are shuffled.
    """
    pattern = cue_pattern([p for _, p, _ in cues])
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, folded(F.col(text)).alias("_low"))
    rows = rows.withColumn("_p", F.split("_low", pattern, -1)).where(F.size("_p") > 1)
    parts = F.transform("_p", lambda p: F.struct(F.length(p).alias("gap"), F.left(p, F.lit(1)).alias("first"), F.right(p, F.lit(1)).alias("last")))
    each = rows.select(key, F.posexplode(F.arrays_zip(
        parts.alias("p"), F.regexp_extract_all("_low", F.lit(f"({pattern})"), F.lit(1)).alias("phrase"), F.slice(parts, F.lit(2), F.size("_p")).alias("next"))).alias("i", "x"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("x.p.gap") + F.coalesce(F.length("x.phrase"), F.lit(0))).over(w)
    # A neighbouring match touches this one: its letters are no boundary.
    bounded = ~F.col("x.p.last").rlike(_WORD_EDGE) & ~F.col("x.next.first").rlike(_WORD_EDGE) & ((F.col("x.p.gap") > 0) | (F.col("i") == 0)) & (
        (F.col("x.next.gap") > 0) | F.col("last_one"))
    placed = each.withColumns({"stop_pos": stop, "last_one": F.lead(F.col("x.phrase")).over(Window.partitionBy(key).orderBy("i")).isNull()})
    found = placed.where(F.col("x.phrase").isNotNull() & bounded).select(key, (F.col("stop_pos") - F.length("x.phrase")).alias("start_pos"), "stop_pos", F.col("x.phrase").alias("phrase"))
    lexicon = documents.sparkSession.createDataFrame(cues, "category string, phrase string, label string")
    return found.join(F.broadcast(lexicon), "phrase").select(key, "start_pos", "stop_pos", "category", "label", "phrase")  # the lexicon is a literal list


def source_prefix(units: DataFrame, signals: DataFrame, key: str = "doc_id", most: int = 128) -> DataFrame:
    """(key, prefix): a document's units with their headers, then its first ``most`` signals by place and kind.

    ``units``: key, ord, unit_id, header (what stands after the id, or null), text.
    ``signals``: key, unit_id, start_pos, stop_pos, kind, label, text.
    """
    header = F.concat(F.lit("["), F.concat_ws(" | ", F.col("unit_id"), F.col("header")), F.lit("]"))
    blocks = units.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws("\n", header, F.col("text")).alias("b")))).alias("bs"))
    line = F.format_string("- %s [%s:%s] '%s'", F.coalesce("unit_id", F.lit("doc")), "kind", "label", "text")
    lines = signals.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("start_pos", "stop_pos", "kind", line.alias("l")))), 1, most).alias("ls"))
    body = F.concat(F.lit("<source_document>\n"), F.array_join("bs.b", "\n\n"), F.lit("\n</source_document>"))
    tail = F.when(F.size("ls") > 0, F.concat(F.lit("\n<linguistic_signals>\n"), F.array_join("ls.l", "\n"), F.lit("\n</linguistic_signals>"))).otherwise("")
    return blocks.join(lines, key, "left").select(key, F.concat(body, F.coalesce(tail, F.lit(""))).alias("prefix"))


def occurrences(documents: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, stop_pos, found) of the pattern's non-overlapping matches."""
    parts = F.split(F.col(text), pattern, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    each = documents.select(key, F.posexplode(F.arrays_zip(F.transform(parts, F.length).alias("gap"), found.alias("found"))).alias("i", "x")).select(
        key, "i", F.col("x.gap").alias("gap"), F.col("x.found").alias("found"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).over(w)
    return each.select(key, "found", stop.alias("stop_pos")).where("found is not null").select(
        key, (F.col("stop_pos") - F.length("found")).alias("start_pos"), "stop_pos", "found")


def overlapping_occurrences(text: Column, needle: str) -> Column:
    """0-based starts of all occurrences of ``needle``, overlapping ones included."""
    parts = F.split(text, f"(?={re.escape(needle)})", -1)
    # A part begins at each occurrence; only the first may begin without one.
    lengths = F.transform(parts, F.length)
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    zipped = F.arrays_zip(parts.alias("part"), ends.alias("at"))
    found = F.filter(zipped, lambda x, i: x["part"].isNotNull() & ((i > 0) | text.startswith(needle)))
    return F.transform(found, lambda x: x["at"])


def simple_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, start_pos, stop_pos) by one rule for all scripts: an end mark and white space."""
    parts = F.split(F.regexp_replace(F.col(text), r"([.!?]\s+)", "$1\u0001"), "\u0001")
    each = documents.select(key, F.posexplode(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.length(F.rtrim(F.regexp_replace(p, r"\s+$", ""))).alias("core")))).alias("sentence_no", "p"))
    before = F.sum("p.n").over(Window.partitionBy(key).orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("p.n")
    return each.select(key, "sentence_no", before.alias("start_pos"), (before + F.col("p.core")).alias("stop_pos")).where("stop_pos > start_pos")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_estimate(text: Column) -> Column:
    """White-space separated parts, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"\S+")))


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, bucket: int = 1024) -> DataFrame:
    """Rows of points (key, pos, ...) with the spans (key, start_pos, stop_pos, ...) that contain them.

    A point meets the spans that touch its bucket, so a document with very many of both
    joins bucket by bucket instead of all with all.
    """
    spread = spans.where("start_pos < stop_pos").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor((F.col("stop_pos") - 1) / bucket))))
    return points.withColumn("_b", F.floor(F.col("pos") / bucket)).join(spread, [key, "_b"]).where("start_pos <= pos and pos < stop_pos").drop("_b")


def overlapping_spans(a: DataFrame, b: DataFrame, key: str, bucket: int = 512) -> DataFrame:
    """Pairs of overlapping spans, a's columns prefixed a_, b's prefixed b_.

    Spans meet in the first bucket both touch, so a document with very many spans joins
    bucket by bucket instead of all with all.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col(key), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
        first, last = F.floor(F.col(f"{p}_start_pos") / bucket), F.floor((F.col(f"{p}_stop_pos") - 1) / bucket)
        return named.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))

    hit = spread(a, "a").join(spread(b, "b"), [key, "_b"]).where("a_start_pos < b_stop_pos and b_start_pos < a_stop_pos")
    return hit.where(F.col("_b") == F.floor(F.greatest("a_start_pos", "b_start_pos") / bucket)).drop("_b")


def span_check(text: Column, span: Column) -> Column:
    """'exact', or where the span's text really is: 'none', 'unique' or 'multiple'."""
    said, n = span["text"], F.length(span["text"])
    first = F.instr(text, said)
    rest = F.substring(text, first + 1, F.length(text))
    again = F.instr(rest, said)
    return (F.when(F.substring(text, span["start_pos"] + 1, span["end_pos"] - span["start_pos"]) == said, "exact")
            .when((first == 0) | (n == 0), "none").when(again == 0, "unique").otherwise("multiple"))


def quote_status(text: Column, quote: Column, occurrence: Column) -> Column:
    """What became of a quotation: resolved, or a hint at the mistake."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    # Counted literally; an empty quotation stands before every character.
    n = F.when(quote == "", F.length(text)).otherwise((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.nullif(F.length(quote), F.lit(0)))
    return (F.when(n >= occurrence, "resolved").when(n > 0, "too_few_occurrences")
            .when(quote.startswith("[u_"), "unit_header").when(F.instr(F.lower(text), F.lower(quote)) > 0, "case_mismatch")
            .when(F.instr(squeeze(text), squeeze(quote)) > 0, "whitespace_mismatch").otherwise("absent"))


def speaker(turn: Column) -> Column:
    """struct<name, participant, resolution> from an explicit label at the start of a turn."""
    label = r"^\s*(?:\*\*)?([^:\n]+?)(?: \(participant ([\w.-]+)\))?:(?:\*\*)?\s+"
    name = F.nullif(F.trim(F.regexp_extract(turn, label, 1)), F.lit(""))
    given = F.nullif(F.regexp_extract(turn, label, 2), F.lit(""))
    unknown = F.lower(name).isin(*UNATTRIBUTED)
    return F.struct(
        name.alias("name"),
        F.when(name.isNotNull() & ~unknown, F.coalesce(given, F.concat(F.lit("label:"), F.sha2(name, 256)))).alias("participant"),
        F.when(name.isNull() | unknown, "unresolved").otherwise("resolved").alias("resolution"))


def marked_turn(text: Column) -> Column:
    """Whether a paragraph opens with a speaker cue."""
    return text.rlike(r"^\s*(?:SPEAKER[_ -]?[0-9]+|[A-Z][A-Z0-9 _-]{1,40}):\s+") | text.rlike(r"^\s*\*\*[^:\n]+?:\*\*\s+") | text.rlike(r"^\s*[^:\n]{1,60} \(participant [\w.-]+\):\s+")


# Frequent words that the other languages of the list lack.
COMMON_WORDS = {
    "en": "the of and to is that it for with this are from not were which would have has they", "de": "der das und ist nicht mit für auf von zu den dem ein eine dass wird sich auch im",
    "fr": "le les du qui est une pas dans pour avec et aux ce sont cette", "es": "el los las una del por para con y se como más pero al",
    "ru": "и в не на что по как это для от из было были но если"}


def with_language(documents: DataFrame, text: str = "text", tag: str = "lang", name: str = "language") -> DataFrame:
    """Adds each document's language (two letters, 'und' if unknown), by its text where that is clear.

    The text counts if it has three words of evidence and twice as many as for the stated
    language; so it also corrects wrong tags.  A tag of a language that isn't told apart
    here stands, and so does any other tag if the text leaves doubt.
    """
    n = lambda pattern: F.regexp_count(F.col(text), F.lit(pattern))
    words = {k: n(f"(?iu)(?<!\\p{{L}})(?:{'|'.join(v.split())})(?!\\p{{L}})") for k, v in COMMON_WORDS.items()}
    counted = documents.withColumn("_c", F.struct(n("[\\u3040-\\u30ff]").alias("kana"), n("\\p{IsHan}").alias("han"), *[c.alias(k) for k, c in words.items()]))
    c = lambda k: F.coalesce(F.col(f"_c.{k}"), F.lit(0))
    japanese = c("kana") * 20 >= c("han") + c("kana")
    # Four characters of a script without spaces count as a word.
    found = {k: c(k).cast("double") for k in COMMON_WORDS} | {
        "ja": F.when(japanese, c("kana") + c("han")).otherwise(0) / 4, "zh": F.when(~japanese, c("han")).otherwise(0) / 4}
    scored = counted.withColumn("_n", F.array(*[F.struct(v.alias("n"), F.lit(k).alias("l")) for k, v in found.items()]))
    low = F.lower(F.trim(F.col(tag)))
    stated = F.when((low != "und") & (F.length(low) >= 2), F.substring(low, 1, 2))
    best = F.array_max("_n")
    own = F.filter("_n", lambda x: x["l"] == stated)
    sure = (best["n"] >= 3) & (stated.isNull() | (F.size(own) > 0) & (best["n"] >= 2 * F.get(own, 0)["n"]))
    return scored.withColumn(name, F.when(sure, best["l"]).otherwise(F.coalesce(stated, F.when(best["n"] > 0, best["l"]), F.lit("und")))).drop("_c", "_n")


def opening_cues(documents: DataFrame, rules: list[tuple[str, str, str]], key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(key, language, cue, relation, start_pos) of markers that open a clause: at the start of the text or after punctuation.

    ``rules``: (language, cue, relation).  The longest cue at a place counts.  With ``lang``,
    a document is scanned with its own language's rules only, by the first two letters.
    """
    spark = documents.sparkSession
    by: dict[str, list[str]] = {}
    for language, cue, _ in rules:
        by.setdefault(language, []).append(cue)
    parts = []
    for language, cues in by.items():
        cjk = any("\u4e00" <= c <= "\u9fff" for cue in cues for c in cue)
        end = "" if cjk else r"(?![\p{L}\p{N}_])"
        opener = r"(?:^|[;,.!?，。；、])\s*"
        own = documents if lang is None else documents.where(F.lower(F.substring(lang, 1, 2)) == language)
        low = own.select(key, folded(F.col(text)).alias("_low"))
        found = occurrences(low, f"{opener}(?:{cue_pattern([c.lower() for c in cues])}){end}", key, "_low")
        cue = F.regexp_replace("found", r"^[;,.!?，。；、]?\s*", "")
        parts.append(found.select(key, F.lit(language).alias("language"), cue.alias("cue"), (F.col("stop_pos") - F.length(cue)).alias("start_pos")))
    table = spark.createDataFrame([(a, b.lower(), c) for a, b, c in rules], "language string, cue string, relation string")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(table), ["language", "cue"]).select(key, "language", "cue", "relation", "start_pos")


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_no, start_pos, stop_pos) of blocks between blank lines, trimmed."""
    parts = F.split(F.regexp_replace(F.col(text), r"(\n\s*\n)", "$1\u0001"), "\u0001")
    sized = F.transform(parts, lambda p: F.struct(
        F.length(p).alias("n"), F.length(F.regexp_extract(p, r"^\s*", 0)).alias("lead"), F.length(F.regexp_replace(p, r"^\s+|\s+$", "")).alias("core")))
    each = documents.select(key, F.posexplode(sized).alias("i", "p"))
    before = F.sum("p.n").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("p.n")
    kept = each.withColumn("start_pos", before + F.col("p.lead")).where("p.core > 0")
    number = F.row_number().over(Window.partitionBy(key).orderBy("i"))
    return kept.select(key, number.alias("section_no"), "start_pos", (F.col("start_pos") + F.col("p.core")).alias("stop_pos"))
