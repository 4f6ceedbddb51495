"""One canonical form for texts that look the same.

Most characters are stable: they are their own canonical form and cannot compose with a
neighbour.  A quick-check class, built once per process from Unicode's own properties
and the fixed tables below, finds the unstable ones.  Only segments of unstable
characters, each with the stable character before it as boundary context, are
normalized, and the results are spliced into the otherwise untouched text.  Texts
without an unstable character never leave the JVM.

What is made one: canonical equivalents, full-width and other pure width or
presentation forms, ligatures, spaces of any width, line-end styles, invisible
characters, hyphens drawn alike, letters of other scripts drawn like Latin ones, white
space at the end of a line and around the text.  What stays distinct: letter case,
accents, raised and lowered digits, punctuation marks (also curly and straight quotes,
dashes of different length), emoji sequences, joiners that change the shape of the next
letter, and direction overrides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logosmill.session import broadcast_if_small, cut

# Letters of other scripts with the Latin letter they are drawn like.
LOOKALIKES = {
    "Cyrillic": ("а a с c ԁ d е e һ h і i ј j ӏ l о o р p ԛ q ѕ s ԝ w х x у y ѵ v "
                 "А A В B С C Е E Ԍ G Н H І I Ј J К K Ӏ I М M О O Р P Ԛ Q Ѕ S Т T Ѵ V Ԝ W Х X У Y Ү Y"),
    "Greek": "ο o ν v ρ p ϲ c ϳ j Α A Β B Ϲ C Ε E Η H Ι I Ϳ J Κ K Μ M Ν N Ο O Ρ P Τ T Χ X Υ Y Ζ Z",
    "Armenian": "օ o ո n ս u հ h ց g զ q յ j Օ O Տ S Ս U Լ L",
    "Cherokee": "Ꭺ A Ᏼ B Ꮯ C Ꭼ E Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z",
    "Latin": "ɡ g ɑ a",
}
# Characters with another one drawn alike.
DRAWN_ALIKE = {0x2010: "-", 0x2011: "-", 0x2028: "\n", 0x2029: "\n", 0x85: "\n", 0x0B: "\n", 0x0C: "\n", 0x09: " ", 0x2000: " ", 0x2001: " ", 0x1680: " "}
# Blocks whose compatibility forms differ from the plain ones in width or presentation only.
SAME_DRAWING = [
    (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x00A0, 0x00A0), (0x2000, 0x200A), (0x2024, 0x2026), (0x202F, 0x202F),
    (0x205F, 0x205F), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0x3000, 0x3000), (0x3131, 0x318E), (0xFB00, 0xFB4F), (0xFB50, 0xFDFB),
    (0xFE70, 0xFEFC), (0xFF01, 0xFFEE), (0x1D5A0, 0x1D5D3), (0x1D670, 0x1D6A3), (0x1D7E2, 0x1D7EB), (0x1D7F6, 0x1D7FF),
]
# Characters that draw nothing (default ignorable, direction marks, variation selectors).
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202C), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Ranges with characters that normalization can change (Hangul syllables and unified ideographs cannot change).
EXAMINED = [(0x00, 0x33FF), (0xA000, 0xABFF), (0xF900, 0xFFEF), (0x10000, 0x12FFF), (0x16A00, 0x16FFF), (0x1B000, 0x1F2FF), (0x2F800, 0x2FA1F), (0xE0000, 0xE0FFF)]

_PICTURE = "[©®‼⁉™ℹ←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff]"
_DRESS = "[\ufe0f⃣\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]"
_EMOJI = f"{_PICTURE}{_DRESS}+(?:\u200d{_PICTURE}{_DRESS}*)*|{_PICTURE}(?:\u200d{_PICTURE}{_DRESS}*)+"
_VIRAMA = "\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d\u0dca"
#: Joiners with a visible effect, kept by a stand-in: after a virama, and between Arabic letters.
_SHAPING = re.compile(f"(?<=[{_VIRAMA}])[\u200c\u200d](?=[\u0900-\u0dff])|(?<=[ؠ-ۿ])\u200c(?=[ؠ-ۿ])")
_STAND_IN = {"\u200c": "\ufdd0", "\u200d": "\ufdd1"}
_BACK = {ord(v): k for k, v in _STAND_IN.items()}
_LINE_END = re.compile(r" +(?=\n)")

#: JVM-side quick check: printable ASCII and line feeds need nothing but trimming; so does text in stable ideographs.
#: In Java "$" would also match before a final CR, U+0085 or U+2028.
STABLE_TEXT = r"^[\x20-\x7e\n、-〩一-鿿]*\z"


def _inside(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


@lru_cache(maxsize=1)
def _tables() -> tuple[re.Pattern, dict[int, str], dict[int, None]]:
    """The segment pattern, single-character folds, and the invisible characters."""
    folds: dict[int, str] = {}
    for pairs in LOOKALIKES.values():
        letters = pairs.split()
        folds.update((ord(a), b) for a, b in zip(letters[::2], letters[1::2]))
    gone = {cp: None for a, b in INVISIBLE for cp in range(a, b + 1)}
    unstable: list[int] = []
    for a, b in EXAMINED:
        for cp in range(a, b + 1):
            ch = chr(cp)
            if cp in gone or cp in folds:
                unstable.append(cp)
            elif cp in DRAWN_ALIKE:
                folds[cp] = DRAWN_ALIKE[cp]
                unstable.append(cp)
            elif _inside(cp, SAME_DRAWING):
                plain = unicodedata.normalize("NFKC", ch)
                if plain != ch:
                    folds[cp] = plain
                    unstable.append(cp)
            elif unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2:
                unstable.append(cp)
            elif (d := unicodedata.normalize("NFD", ch)) != ch and ord(d[0]) in folds:
                unstable.append(cp)  # an accented look-alike
    spans: list[list[int]] = []
    for cp in sorted(set(unstable)):
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    cls = "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in spans)
    return re.compile(f"({_EMOJI})|[^{cls}]?[{cls}]+", re.S), folds, gone


def _normal(segment: re.Match) -> str:
    if segment[1]:
        return segment[1]
    _, folds, gone = _tables()
    text = segment[0].translate(gone)
    # Decomposed first, so that an accented look-alike folds by its base letter.
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(folds)).translate(folds))


def canonical(text: str) -> str:
    """The canonical form of one text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\u200c" in text or "\u200d" in text:
        text = _SHAPING.sub(lambda m: _STAND_IN[m[0]], text)
        out = _tables()[0].sub(_normal, text).translate(_BACK)
    else:
        out = _tables()[0].sub(_normal, text)
    return _LINE_END.sub("", out).strip(" \n")


def canonical_column(text: Column) -> Column:
    """Canonical form of a string column; null stays null, an empty text empty."""

    @F.pandas_udf("string")
    def unstable(texts: pd.Series) -> pd.Series:
        return texts.map(canonical, na_action="ignore")

    trimmed = F.regexp_replace(F.regexp_replace(text, r" +(?=\n)", ""), r"^[ \n]+|[ \n]+\z", "")
    stable = text.rlike(STABLE_TEXT)
    return F.when(stable, trimmed).otherwise(unstable(F.when(~stable, text)))


def canonicalize(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``<column>_canonical`` beside each of ``columns``."""
    return df.withColumns({f"{c}_canonical": canonical_column(F.col(c)) for c in columns})


def _forms(df: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(field_name, k, form, raw, changed): digests of 128 bits stand for the texts, so what is shuffled is small whatever their length."""
    fields = canonicalize(df.select(key, *columns), *columns)
    values = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field_name"), F.col(c).alias("raw"), F.col(f"{c}_canonical").alias("form")) for c in columns]))
    long = fields.select(F.col(key).alias("k"), values.alias("v")).select("k", "v.*").where("raw is not null and k is not null")
    return cut(long.select(
        "field_name", "k", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("raw")).alias("raw"), (F.col("form") != F.col("raw")).alias("changed")))


def lookalike_pairs(df: DataFrame, key: str, *columns: str, hot: int = 10_000) -> DataFrame:
    """Pairs of rows whose values in a column look the same but differ in code points.

    Result: field_name, key_a < key_b, distinct.  Null values and null keys make no
    pairs, nor do equal values; rows sent twice count once.  Groups in which nothing
    was changed by normalization cannot hold two different texts and drop out before
    the join, which has changed texts on one side only.  A form with more than ``hot``
    rows is split: its rows go to as many parts as it has times that number, and each
    changed row to all of them.  :func:`lookalike_classes` has the same links without
    writing out pairs.
    """
    rows = _forms(df, key, columns)
    sizes = rows.groupBy("field_name", "form").agg(F.count("*").alias("n"), F.max("changed").alias("c")).where(f"n > {hot} and c")
    sizes = cut(sizes.select("field_name", "form", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if not sizes.isEmpty():
        rows = rows.join(broadcast_if_small(sizes), ["field_name", "form"], "left")
    else:
        rows = rows.withColumn("parts", F.lit(None).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    a = rows.where("changed").select("field_name", "form", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("k").alias("k1"), F.col("raw").alias("raw1"))
    b = rows.select("field_name", "form", F.pmod(F.xxhash64("k", "raw"), parts).cast("int").alias("part"), F.col("k").alias("k2"), F.col("raw").alias("raw2"), "changed")
    pairs = a.join(b, ["field_name", "form", "part"]).where("raw1 <> raw2 and k1 <> k2 and (not changed or k1 < k2)")
    return pairs.select("field_name", F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def lookalike_classes(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(field_name, key, class_id, variants, links) of rows that look like a row with other code points.

    class_id is the digest of the canonical form, variants the number of different texts
    of the class, links how many of its rows have another text than this one.
    """
    rows = _forms(df, key, columns).select("field_name", "k", "form", "raw").distinct()
    texts = rows.groupBy("field_name", "form", "raw").agg(F.count("*").alias("n"))
    classes = texts.groupBy("field_name", "form").agg(F.count("*").alias("variants"), F.sum("n").alias("total")).where("variants > 1")
    known = texts.join(classes, ["field_name", "form"]).select("field_name", "form", "raw", "variants", (F.col("total") - F.col("n")).alias("links"))
    return rows.join(known, ["field_name", "form", "raw"]).select("field_name", F.col("k").alias(key), F.lower(F.hex("form")).alias("class_id"), "variants", "links")
