"""JSON of any depth: redaction and canonical form. Trees of unknown depth have no Spark expression, so texts go through Arrow batches."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _refuse(name: str) -> None:
    raise ValueError(name)


def _parsed(text: str | None) -> object:
    return json.loads(text, parse_constant=_refuse)


def _packed(value: object, sort: bool = False) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=sort, separators=(",", ":"))


def _blotted(value: object) -> object:
    if value is None:
        return None
    text = value if isinstance(value, str) else _packed(value, True)
    size = {"character_count": len(value)} if isinstance(value, str) else {}
    return {"redacted": True, **size, "sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}


def _without(value: object, keys: frozenset[str], texts_only: bool) -> object:
    if isinstance(value, list):
        return [_without(v, keys, texts_only) for v in value]
    if isinstance(value, dict):
        return {k: _blotted(v) if k in keys and (isinstance(v, str) or not texts_only) else _without(v, keys, texts_only) for k, v in value.items()}
    return value


def _each(texts: pd.Series, change) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return change(_parsed(text))
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def redacted_json(text: Column, keys: list[str], texts_only: bool = False) -> Column:
    """JSON text, compact, with what lies under these keys, at any depth, replaced by its SHA-256 and, for strings, their length.

    With texts_only, only strings are replaced and other values are looked into. A null under a key stays null. Text that is
    no JSON, or is nested too deep for Python's parser, becomes null, so that nothing leaks. Of a repeated key the last counts.
    """
    kept = frozenset(keys)

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: _packed(_without(v, kept, texts_only)))

    return work(text)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys at every depth and no blanks, the same for equal values. Null for what is no JSON."""

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: _packed(v, True))

    return work(text)


def _pruned(value: object, keys: frozenset[str]) -> object:
    if isinstance(value, list):
        return [_pruned(v, keys) for v in value]
    return {k: _pruned(v, keys) for k, v in value.items() if k not in keys} if isinstance(value, dict) else value


def pruned_json(text: Column, keys: list[str]) -> Column:
    """JSON text, compact, without the entries of these keys at any depth. Null for what is no JSON, as in redacted_json."""
    gone = frozenset(keys)

    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: _packed(_pruned(v, gone)))

    return work(text)


def best_line(text: Column, tokens: list[str]) -> Column:
    """(line, key): of the object's entries that are objects with a whole `line`, the one whose key has one of the tokens, then the least line, then key; null if there is none."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    first = lambda k: F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(k), t))
    found = F.transform(entries, lambda e: F.struct(F.when(first(e["key"]), 0).otherwise(1).alias("priority"), F.get_json_object(e["value"], "$.line").try_cast("long").alias("line"), e["key"].alias("key")))
    best = F.array_min(F.filter(found, lambda e: e["line"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["line"].alias("line"), best["key"].alias("key")))
