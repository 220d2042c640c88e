"""Canonical JSON: sorted keys, no spaces, text as it is. Spark's own JSON functions rewrite numbers, so Python does it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _or_none(text, function):
    try:
        return None if text is None else function(json.loads(text))
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON text; null if it isn't JSON."""

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _or_none(t, canonical))

    return make(text)


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form, in lower-case hexadecimal; null if it isn't JSON."""

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _or_none(t, lambda v: hashlib.sha256(canonical(v).encode()).hexdigest()))

    return make(text)


def unknown_fields(text: Column, known: set[str]) -> Column:
    """The canonical form of a JSON object without the known top-level keys."""
    kept = frozenset(known)

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _or_none(t, lambda v: canonical({k: x for k, x in v.items() if k not in kept}) if isinstance(v, dict) else "{}"))

    return make(text)


def _refuse(name: str):
    raise ValueError(name)


def last_keys(text: Column) -> Column:
    """JSON text that Spark's variants take: the text itself, or, where an object repeats a key, its canonical form, in which the
    last of equal keys counts; null if it isn't JSON. Python sees only what variants refuse."""
    strict = F.try_parse_json(text).isNotNull()

    @F.pandas_udf("string")
    def settle(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _or_none(t, lambda _: canonical(json.loads(t, parse_constant=_refuse))))

    return F.when(strict, text).otherwise(settle(F.when(~strict, text)))
