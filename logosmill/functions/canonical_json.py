"""Canonical JSON text and its digest."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from logosmill.sources.readers import strict_json

SAFE = 2**53 - 1  # fixed value: integers that every reader keeps


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("not finite")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(abs(x)).partition("e")
    sign = "-" if x < 0 else ""
    if not power:
        return sign + digits
    e = int(power)
    whole, _, rest = digits.partition(".")
    if -6 <= e < 0:
        return sign + "0." + "0" * (-e - 1) + whole + rest
    return f"{sign}{digits}e{'+' if e > 0 else '-'}{abs(e)}"


def _string(x: str) -> str:
    if any("\ud800" <= c <= "\udfff" for c in x):
        raise ValueError("lone surrogate")
    return json.dumps(x, ensure_ascii=False)


def canonical(x: object) -> str:
    """Sorted keys by UTF-16 units, shortest numbers, no white space."""
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, int):
        if abs(x) > SAFE:
            raise ValueError("integer out of range")
        return str(x)
    if isinstance(x, float):
        return _number(x)
    if isinstance(x, str):
        return _string(x)
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    return "{" + ",".join(f"{_string(k)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"


def canonical_column(text: Column) -> Column:
    """Canonical form of JSON text; null for what isn't strict JSON.

    Null too for repeated keys, integers out of range, lone surrogates, and nesting beyond
    what the interpreter can follow (some hundred levels).
    """
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return canonical(strict_json(t))
            except (ValueError, TypeError, RecursionError):
                return None
        return s.map(one)

    return run(text)


def digest(x: object) -> str:
    return hashlib.sha256(canonical(x).encode()).hexdigest()


def pointer(document: object, path: str) -> object:
    """Value at a JSON pointer; KeyError if there is none."""
    for step in path.split("/")[1:] if path else []:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            if not step.isdigit() or (len(step) > 1 and step[0] == "0") or int(step) >= len(document):
                raise KeyError(step)
            document = document[int(step)]
        elif isinstance(document, dict):
            document = document[step]
        else:
            raise KeyError(step)
    return document
