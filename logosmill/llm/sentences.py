r"""Sentence units across languages and scripts, in SQL expressions and one Python fold.

Terminators that end nothing (in decimals, initials, abbreviations, list marks, and in
addresses, parentheses and quotations of any length) are masked by a private-use character, one for one, so
offsets hold.  What is left of terminators, by script, is followed by a cut mark;
splitting at the marks gives the pieces, and their running lengths the offsets.  Units
are cut out of the untouched original text, which restores what was masked.

Only the lengths of the pieces are shuffled, not the texts.
"""

from __future__ import annotations

import re
from unicodedata import category

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK, CUT = "\ue000", "\ue001"

# Abbreviations that open something; any word or number may follow.
OPENING = (
    "Mr Mrs Ms Dr Prof Sr Sra Srta Dra Gen Gov Sen Rep Rev Hon Lt Col Capt Sgt St Mt Messrs Mme Mlle Hr Fr Dipl Ing "
    "Fig Figs fig figs Nr nr Nos nos núm Núm art Art arts Arts Abs abs Bd pp Pp pág págs Pág Vol vol ch Ch chap sec Sec par "
    "éd ed Ed eds cf Cf vgl Vgl vs v e.g i.e viz ca Ca approx bzw ggf evtl inkl zzgl Ref ref tel Tel op cap Cap eq Eq App app Tab Sect Exh "
    "г-н г-жа ул рис Рис см См стр гл проф Проф акад тов табл напр ср Ср "
    "Βλ βλ σελ Σελ π.χ δηλ αρ Αρ κεφ "
    "د أ "
    "डॉ श्री सुश्री प्रो पं"
)
# Abbreviations that a number follows.
BEFORE_NUMBERS = "No no n N S p P с С № ст д Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
# Months written out after an ordinal.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"

_CLOSE = "[\\)\\]\\}\"'”’»›」』】〕）》〉\\*_]"
_CJK = "぀-ヿ㐀-鿿가-힯"
#: Letters of scripts without case, by which one cannot see whether a sentence goes on.
_CASELESS = "֐-ݏऀ-෿฀-໿ሀ-፿"
_BLANK = "[ \\t\\u00a0\\u2000-\\u200a\\u202f\\u3000]"
_GAP = f"{_BLANK}*(?:\\r?\\n)?{_BLANK}*"
_WHITE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_BEFORE_WORD = "(?:^|[^\\p{L}\\p{M}\\p{N}])"
#: A small letter that goes on, unlike one in a name such as e-voting or iPhone.
_SMALL = "(?!\\p{Ll}-\\p{L}|\\p{Ll}\\p{Lu})\\p{Ll}"
_LIST_MARK = "(?:\\p{N}{1,3}|\\p{N}{1,3}[." + MASK + "]\\p{N}{1,3}|\\p{N}{1,3}[." + MASK + "]\\p{N}{1,3}[." + MASK + "]\\p{N}{1,3}|[ivxlcIVXLC]{1,6}|\\p{L})"


def _words(words: str) -> str:
    return "(?:" + "|".join(w.replace(".", "[." + MASK + "]") for w in sorted(set(words.split()), key=len, reverse=True)) + ")"


def _steps() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The steps before and after the marks inside quotations and parentheses are masked.

    Patterns begin with the mark itself, so that what is looked for around it is only
    looked for there.
    """
    steps = [
        (f"[{MASK}{CUT}]", "�"),  # private-use characters that were there before
        # decimals, dates, versions, sections; then dotted words
        (r"[.!?·](?=\p{N})(?<=[\p{N}\p{L}][.!?·])", MASK),
        (r"\.(?=\p{L})(?<=\p{L}\.)(?!(?<=\p{Ll}{2}\.)\p{Lu}(?:\p{Ll}|\s|\.))", MASK),
        # initials
        (r"\.(?<=(?:^|[\s" + MASK + r"(\[“„«\"'-]|\p{Ll}{2}[.?!])\p{Lu}\.)(?=" + _GAP + r"[\p{L}\p{N},;:])", MASK),
        # abbreviations
        (f"\\.(?<={_BEFORE_WORD}{_words(OPENING)}\\.)(?={_GAP}[\\p{{L}}\\p{{N}}\\p{{S}}\\p{{Ps}}\\p{{Pi}}\"'„])", MASK),
        (f"\\.(?={_GAP}\\p{{N}})(?<={_BEFORE_WORD}{_words(BEFORE_NUMBERS)}\\.)", MASK),
        (f"\\.(?<={_BEFORE_WORD}\\p{{Ll}}{{1,2}}\\.)(?={_GAP}\\p{{Ll}}{{1,3}}[.{MASK}])", MASK),
        (f"\\.(?<=(?:^|[\\s(])\\p{{Ll}}\\.)(?={_GAP}\\p{{Lu}}[.{MASK}])", MASK),
        # list marks at the start of a line that doesn't go on with a sentence
        (r"\.(?=[ \t])(?<=(?:^|\n[ \t]{0,8}\r?\n|[.?!:…。।።፧][”»’\")]?[ \t]{0,4}\r?\n)[ \t>*|-]{0,8}(?:#{1,6} {1,3})?"
         + _LIST_MARK + r"\.)", MASK),
        # ordinals and dates in figures
        (r"\.(?=\s\p{N}{1,2}\.\s\p{N}{2,4}\b)(?<=" + _BEFORE_WORD + r"\p{N}{1,2}\.)", MASK),
        (r"\.(?=\s\p{N}{2,4}\b)(?<=" + _BEFORE_WORD + r"\p{N}{1,2}[." + MASK + r"]\s\p{N}{1,2}\.)", MASK),
        (r"\.(?=\s(?:" + "|".join(MONTHS.split()) + r")\b)(?<=" + _BEFORE_WORD + r"\p{N}{1,2}\.)", MASK),
    ]
    return steps, [
        (f"[？！?!](?={_CLOSE}+[{_CJK}])", MASK),
        (f"[。](?={_CLOSE}+と)", MASK),
        # a mark before a small letter, a comma or the like
        (f"[.?!\\u2026](?={_GAP}(?:{_SMALL}|[,;:%]))", MASK),
    ]


def mask_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) of all steps in order; a replacement is as long as its match."""
    return [step for part in _steps() for step in part]


#: What ends a unit, with the closing marks that belong to it, by script.
ENDINGS = [
    # scripts with spaces between words; the Greek question mark
    f"(?:[.?!\\u2026\\u061f\\u06d4]+|;(?<=\\p{{IsGreek}};))(?:[ \\u00a0\\u202f]?\\u00bb|{_CLOSE})*(?={_WHITE}|$)",
    # the same where the space is missing
    f"[.?!](?<=\\p{{Ll}}{{2}}[.?!])[.?!]*{_CLOSE}*(?=\\p{{Lu}}(?:\\p{{Ll}}|[\\s.{MASK}]))",
    # scripts without
    f"[\\u3002\\uff01\\uff1f\\uff61]+{_CLOSE}*",
    # dandas, Ethiopic full stops and question marks
    f"[\\u0964\\u0965\\u1362\\u1367\\u1368]+{_CLOSE}*",
    # a blank line
    f"{_BLANK}*\\r?\\n{_BLANK}*\\r?\\n{_WHITE}*",
    # a marked heading's line
    "(?<![^\\n])#{1,6} [^\\n]*\\n",
    # a space in Thai that isn't next to a digit
    f"[ \\u00a0](?<=[\\u0e00-\\u0e7f]{_CLOSE}?[ \\u00a0])[ \\u00a0]*(?=[^\\p{{N}}\\s])",
]


#: Opening marks by closing mark; the German closing mark is the English opening one.
_OPENING_OF = {"”": "“„", "»": "«", ")": "(", "）": "（", "」": "「"}
_MARKS = re.compile("[“”„«»()（）「」\"]")
_INSIDE, _INSIDE_STRAIGHT = ({ord(c): MASK for c in marks} for marks in (".?!;…؟", ".?!…؟"))
_GAP_RE = re.compile(_GAP)
_LIST_MARK_RE = re.compile("(?:^|\\n)[ \\t>*|-]{0,8}(?:[0-9]{1,3}|[ivxlcIVXLC]{1,6}|[^\\W\\d_])$")


def _goes_on(text: str, at: int, parenthesis: bool = False) -> bool:
    """Whether the sentence goes on at the end of a quotation or parenthesis."""
    at = _GAP_RE.match(text, at).end()
    c, rest = text[at:at + 1], text[at + 1:at + 3]
    if not c or c in ",;:،؛、，；：–—" or (parenthesis and c in ".?!;"):
        return bool(c)
    if c == "-":
        return rest[:1].isspace()
    if category(c) == "Ll":
        return not (rest[:1] == "-" and rest[1:].isalpha() or rest and category(rest[0]) == "Lu")
    return "֐" <= c <= "ݏ" or "ऀ" <= c <= "෿" or "฀" <= c <= "໿" or "ሀ" <= c <= "፿"


_ADDRESS = re.compile(r"(?:://|www\.|@)\S+")
_IN_ADDRESS = re.compile(r"[.?!;](?=[\w/=&#~%-])")


def mask_spans(text: str) -> str:
    """``text`` with the marks masked inside addresses, and inside quotations and parentheses after which the sentence goes on.

    These may be of any length and nested; a closing mark without an opening one closes
    nothing.  One pass, linear in the text.
    """
    if "://" in text or "www" in text or "@" in text:
        text = _ADDRESS.sub(lambda m: _IN_ADDRESS.sub(MASK, m[0]), text)
    stacks: dict[str, list[tuple[str, int]]] = {}
    spans: list[tuple[int, int, bool]] = []
    straight = None
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        before = text[at - 1] if at else " "
        if c == '"':
            if straight is not None and before in ".?!,…" + MASK and _goes_on(text, at + 1):
                spans.append((straight, at, True))
            opens = not before.isalnum() and before not in ".?!,…" + MASK and not text[at + 1:at + 2].isspace()
            straight = at if opens else None
            continue
        kind = "”" if c == "“" else c
        if c in "“”":
            stack = stacks.setdefault("”", [])
            closes = bool(stack) and (stack[-1][0] == "„" and not before.isspace() if c == "“" else stack[-1][0] == "“" or not before.isspace())
        else:
            closes = c in _OPENING_OF
            kind = c if closes else next(k for k, v in _OPENING_OF.items() if c in v)
            stack = stacks.setdefault(kind, [])
            if c == ")" and _LIST_MARK_RE.search(text, max(0, at - 16), at):
                continue
        if not closes:
            if c != "”":
                stack.append((c, at))
        elif stack:
            _, start = stack.pop()
            if _goes_on(text, at + 1, c in ")）"):
                spans.append((start, at, False))
    out, done = [], 0
    # The outermost come first; what lies in one that is masked needs nothing more.
    for start, end, is_straight in sorted(spans, key=lambda x: (x[0], -x[1])):
        if end > done:
            out += [text[done:start], text[max(done, start):end].translate(_INSIDE_STRAIGHT if is_straight else _INSIDE)]
            done = end
    return "".join(out) + text[done:] if out else text


def _masked_spans(text: Column) -> Column:
    @F.pandas_udf("string")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(mask_spans, na_action="ignore")

    return spans(text)


def _merged(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring steps as one pattern: a mark that one of them masks looks to the others as it did before.

    Only the list marks need a pass of their own, as a mark that is masked by then ends
    no sentence before them.
    """
    out: list[tuple[str, str]] = []
    for pattern, replacement in steps:
        alone = _LIST_MARK in pattern
        if out and not alone and _LIST_MARK not in out[-1][0]:
            out[-1] = (f"{out[-1][0]}|(?:{pattern})", replacement)
        else:
            out.append((pattern if alone else f"(?:{pattern})", replacement))
    return out


def masked(text: Column) -> Column:
    """``text`` with every terminator that ends nothing replaced by a placeholder."""
    (private, after_private), *before = _steps()[0]
    text = F.when(text.contains(MASK) | text.contains(CUT), F.regexp_replace(text, private, after_private)).otherwise(text)
    for pattern, replacement in _merged(before):
        text = F.regexp_replace(text, pattern, replacement)
    text = _masked_spans(text)
    for pattern, replacement in _merged(_steps()[1]):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def pieces(text: Column) -> Column:
    """Masked text split after each ending; the pieces together are as long as the text."""
    return F.split(F.regexp_replace(masked(text), "|".join(ENDINGS), "$0" + CUT), CUT)


def unit_offsets(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """Distinct (key, start_pos, end_pos) of all units, without white space around them.

    Offsets are 0-based, half-open code points of the original text.  A null key or text
    and a text of white space give no rows; rows sent twice give their units once; two
    texts under one key give the units of both.  The cost is linear in the text.
    """
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.xxhash64(text, F.length(text)).alias("h"), pieces(F.col(text)).alias("ps"))
    sized = rows.select("k", "h", F.transform("ps", lambda p: F.struct(
        F.length(p).alias("n"),
        F.length(F.regexp_extract(p, f"^{_WHITE}*", 0)).alias("lead"),
        F.length(F.regexp_replace(p, f"^{_WHITE}+|{_WHITE}+$", "")).alias("core"))).alias("ps"))
    once = sized.groupBy("k", "h").agg(F.first("ps").alias("ps"))
    each = once.select("k", "h", F.posexplode("ps").alias("at", "p"))
    before = F.coalesce(F.sum("p.n").over(Window.partitionBy("k", "h").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before + F.col("p.lead")).cast("int")
    units = each.select("k", start.alias("start_pos"), (start + F.col("p.core")).cast("int").alias("end_pos"), F.col("p.core").alias("c"))
    return units.where("c > 0").select(F.col("k").alias(key), "start_pos", "end_pos").distinct()


def sentence_units(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """:func:`unit_offsets` with each unit's text, cut out of the original."""
    texts = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).dropDuplicates([key])
    return unit_offsets(texts, key, "_t").join(texts, key).select(
        key, "start_pos", "end_pos", F.expr("substring(_t, start_pos + 1, end_pos - start_pos)").alias("unit"))
