"""Predicates that decide what may be cited, kept or answered, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import text as T

#: Forms of credentials, long digit strings (student numbers) and control characters.
_SECRET = "(?i)(api[_-]?key|secret|password|token)[ \\t]*[:=]|sk-[A-Za-z0-9]{8,}|bearer [A-Za-z0-9._-]{8,}"
_LONG_NUMBER = "(?<![0-9])[0-9]{8,}(?![0-9])"
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def precise(source: Column) -> Column:
    """Whether a source (doc, page, clause, table, row, chunk_hash, char_start, char_end) can be found again exactly."""
    there = lambda c: F.coalesce(source[c] != "", F.lit(False))
    place = source["page"].isNotNull() | there("clause") | (there("table") & source["row"].isNotNull()) | (there("chunk_hash") & source["char_start"].isNotNull() & source["char_end"].isNotNull())
    return F.coalesce(T.strip(source["doc"]) != "", F.lit(False)) & place


def in_scope(x: Column, outside: list[str], anchors: list[str], intents: list[str] | None = None) -> Column:
    """No word of ``outside``, some anchor and, if asked for, some intent."""
    folded = F.lower(F.coalesce(x, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(folded, w))
    held = ~any_of(outside) & any_of(anchors)
    return held & any_of(intents) if intents else held


def unsafe(x: Column, longest: int) -> Column:
    """Why a text may not be stored (null: it may): empty, too_long, control, secret or identifier."""
    return F.when(T.strip(x) == "", "empty").when(F.length(x) > longest, "too_long").when(x.rlike(_CONTROL), "control").when(x.rlike(_SECRET), "secret").when(x.rlike(_LONG_NUMBER), "identifier")


def cites(answer: Column, doc: Column, places: Column) -> Column:
    """Whether an answer names the document and any of the forms of its place."""
    return F.contains(answer, doc) & F.exists(F.filter(places, lambda p: p.isNotNull()), lambda p: F.contains(answer, p))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted names; null stays null. Texts are escaped as JSON does."""
    parts = [_closed(F.concat(F.lit(f'"{name}":'), F.substring(F.to_json(F.struct(fields[name].alias("v"))), 6, 1 << 30))) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _closed(part: Column) -> Column:
    """A member without the brace that closed its own object; an empty object is null."""
    body = F.regexp_replace(part, "\\}$", "")
    return F.when(body.endswith(":"), F.concat(body, F.lit("null"))).otherwise(body)


def longest_held(x: Column, words: list[str]) -> Column:
    """The longest of ``words`` (the first of equal length) that the text holds."""
    ranked = sorted(words, key=lambda w: -len(w))
    return F.get(F.filter(F.array(*map(F.lit, ranked)), lambda w: F.contains(x, w)), F.lit(0))
