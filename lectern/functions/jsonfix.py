"""Repair of JSON in model output."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = re.compile(r'"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\|[^"\\])*"?')
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\')
_OPEN = re.compile(r"[{\[]")


def fix_escapes(text: str | None) -> str | None:
    """Backslashes in strings that begin no valid escape are doubled."""
    if not text:
        return text
    double = lambda m: m[0] if len(m[0]) > 1 else "\\\\"
    return _STRING.sub(lambda m: _ESCAPE.sub(double, m[0]), text)


def find_json(text: str | None) -> str | None:
    """The body of a fenced block of three or more lines, else the first object or array that can be read anywhere."""
    if not text:
        return None
    whole = text.strip()
    if whole.startswith("```") and whole.endswith("```"):
        body = "\n".join(whole.splitlines()[1:-1]).strip()
        if len(whole.splitlines()) >= 3 and body:
            return body
    reader = json.JSONDecoder()
    for m in _OPEN.finditer(text):
        try:
            return json.dumps(reader.raw_decode(text, m.start())[0], ensure_ascii=False)
        except ValueError:
            pass
    return None


def recover(text: str | None) -> str | None:
    """The first of raw text, found JSON and their repaired forms that can be read, as compact JSON; null if none."""
    if not text:
        return None
    tries = [text]
    if (found := find_json(text)) and found != text:
        tries.append(found)
    tries += [fixed for t in list(tries) if (fixed := fix_escapes(t)) not in tries]
    for t in tries:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
    return None


def _arrow_udf(fn):
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(fn, na_action="ignore")

    return run


def fix_escapes_col(c: Column) -> Column:
    return _arrow_udf(fix_escapes)(c)


def find_json_col(c: Column) -> Column:
    return _arrow_udf(find_json)(c)


def recover_col(c: Column) -> Column:
    return _arrow_udf(recover)(c)


def validated(c: Column, schema: str) -> Column:
    """The struct that the recovered JSON gives under the schema; null if there is none."""
    return F.from_json(recover_col(c), schema)
