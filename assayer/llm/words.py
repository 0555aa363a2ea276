"""Words, lines and small helpers as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space besides the space itself: code points 9 to 13.
_BLANKS = "\t\n\x0b\x0c\r"
#: A word: what lies between runs of the space and code points 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def replace_each(text: Column, chars: str, by: str) -> Column:
    """Every character of ``chars`` replaced; a plain byte search for each, not a regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    spaced = replace_each(F.coalesce(text, F.lit("")), _BLANKS, " ")
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    """Number of words without making them; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(replace_each(F.coalesce(text, F.lit("")), " " + _BLANKS, "")).cast("long")


def ascii_count(text: Column, chars: str) -> Column:
    """How often the ASCII characters ``chars`` occur."""
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) - F.octet_length(replace_each(text, chars, ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, whatever the optimizer merges around it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of ``df``: it tells rows apart and doesn't depend on where they are."""
    parts = [F.to_json(F.struct(df[f"`{c}`"])) if "map<" in kind or kind == "variant" else df[f"`{c}`"] for c, kind in df.dtypes]
    return F.xxhash64(*parts)
