"""Text normalisation as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, as the inside of a character class.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space, separators and brackets that keys ignore.
NOISE = rf"[{SPACE}·•、,，。;；()（）\[\]【】\-—_/]+"
LINE_END = r"\r\n|[\x{0A}-\x{0D}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfkc(x: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it, so text goes through Arrow."""
    return F.pandas_udf(lambda s: s.str.normalize("NFKC"), "string")(x)


def strip(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def norm_key(x: Column) -> Column:
    """Lower case without noise characters; the key under which rules are found."""
    return F.regexp_replace(F.lower(x), NOISE, "")


def search_tokens(x: Column) -> Column:
    """Latin words, numbers, single CJK characters and CJK pairs; white space is dropped first, so it fuses words."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")

    def joined(han: Column) -> Column:
        pairs = F.zip_with(F.slice(han, 1, F.size(han) - 1), F.slice(han, 2, F.size(han) - 1), lambda a, b: F.concat(a, b))
        return F.concat(han, F.when(F.size(han) > 1, pairs).otherwise(none))

    def tokens(flat: Column) -> Column:
        han = F.when(flat.rlike("[\\x{4e00}-\\x{9fff}]"), bound(every(flat, "[\\x{4e00}-\\x{9fff}]"), joined)).otherwise(none)
        return F.concat(every(flat, "[a-z]+|\\p{Nd}+(?:\\.\\p{Nd}+)?"), han)

    return bound(F.lower(F.regexp_replace(x, f"[{SPACE}]+", "")), tokens)


def academic_year_of(day: Column, rollover: int = 9) -> Column:
    """First year of the academic year that a date lies in."""
    return F.year(day) - (F.month(day) < rollover).cast("int")


def year_span(first: Column) -> Column:
    """``2025`` as ``2025-2026``."""
    return F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))


def academic_year(x: Column) -> Column:
    """``2025`` or ``2025/2026`` -> ``2025-2026``; anything else stays, without outer white space."""
    text = strip(x)
    one = F.regexp_extract(text, "^(\\d{4})$", 1)
    two = F.regexp_replace(text, f"^(\\d{{4}})[{SPACE}]*[-~/至][{SPACE}]*(\\d{{4}})$", "$1-$2")
    return F.when(one != "", F.concat(one, F.lit("-"), (one.try_cast("int") + 1).cast("string"))).otherwise(two)


def first_number(x: Column) -> Column:
    """First signed number, thousands separators removed; null without one."""
    return F.regexp_extract(F.regexp_replace(x, ",", ""), "-?\\d+(?:\\.\\d+)?", 0).try_cast("double")


def csv_safe(x: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading quote."""
    return F.when(x.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def content_hash(x: Column) -> Column:
    """SHA-256 of the composed text's non-blank lines without outer white space."""
    lines = F.filter(F.transform(F.split(nfkc(F.coalesce(x, F.lit(""))), LINE_END, -1), strip), lambda s: s != "")
    return F.sha2(F.array_join(lines, "\n"), 256)


def score_candidates(x: Column, limit: int = 5) -> Column:
    """Distinct numbers in (0, 100] that stand as points, by four patterns in turn: before, or behind a verb, with or without the unit."""
    number = "(\\d+(?:\\.\\d+)?)"
    gap = f"[{SPACE}]*"
    found = F.concat(*[F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(1)) for p in (f"{number}{gap}分", f"加{gap}{number}{gap}分", f"计{gap}{number}{gap}分", f"加{gap}{number}")])
    values = F.filter(F.transform(found, lambda v: v.try_cast("double")), lambda v: (v > 0) & (v <= 100))
    return F.slice(F.array_distinct(values), 1, limit)


_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def chinese_number(x: Column) -> Column:
    """Up to a hundred, written out; null for anything else."""
    digits = F.create_map(*[F.lit(v) for pair in _DIGITS.items() for v in pair])
    left, right = F.substring_index(x, "十", 1), F.regexp_extract(x, "^[^十]*十(.*)$", 1)
    tens = F.when(left == "", 1).otherwise(F.coalesce(F.try_element_at(digits, left), F.lit(1)))
    ones = F.when(right == "", 0).otherwise(F.coalesce(F.try_element_at(digits, right), F.lit(0)))
    return F.when(x.isin("百", "一百"), 100).when(F.contains(x, F.lit("百")), None).when(F.contains(x, F.lit("十")), tens * 10 + ones).when(F.length(x) == 1, F.try_element_at(digits, x))


def points_in(x: Column) -> Column:
    """All numbers that stand before the unit of points, in digits or written out."""
    text = F.coalesce(x, F.lit(""))
    arabic = F.transform(F.regexp_extract_all(text, F.lit(f"(?<![\\d.])(\\d+(?:\\.\\d+)?)(?![\\d.])[{SPACE}]*分"), F.lit(1)), lambda v: v.try_cast("double"))
    written = F.transform(F.regexp_extract_all(text, F.lit(f"([零〇一二两三四五六七八九十百]+)[{SPACE}]*分"), F.lit(1)), lambda v: chinese_number(v).cast("double"))
    return F.array_distinct(F.filter(F.concat(arabic, written), lambda v: v.isNotNull()))


def parse_date(x: Column) -> Column:
    """A date with year, month and day parted by signs or their Chinese units; null if there is none such."""
    text = F.regexp_replace(F.regexp_replace(strip(x), "[年月/.]", "-"), "日", "")
    part = lambda k: F.regexp_extract(text, "^-*(\\d{4})-+(\\d{1,2})-+(\\d{1,2})-*$", k).try_cast("int")
    return F.try_make_timestamp(part(1), part(2), part(3), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def pseudonym(x: Column, key: bytes, size: int = 24) -> Column:
    """First hex digits of the HMAC-SHA-256, by two nested hashes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, x.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, size)


def model_tier(name: Column, vision: Column) -> Column:
    """vision, strong, light or unknown, by parts of a model's name."""
    lower = F.lower(name)
    return F.when(vision, "vision").when(lower.rlike("pro|reasoner|max"), "strong").when(lower.rlike("flash|chat|lite"), "light").otherwise("unknown")


def rewrite_query(x: Column, terms: list[tuple[str, list[str]]]) -> Column:
    """The text without outer white space, and each term behind it that is absent while one of its variants is there."""
    text = strip(x)
    folded = F.lower(text)
    added = [F.when(~F.contains(folded, F.lit(term.lower())) & F.exists(F.array(*[F.lit(v.lower()) for v in variants]), lambda v: F.contains(folded, v)), F.lit(term)) for term, variants in terms]
    return F.when(text == "", "").otherwise(F.concat_ws(" ", text, *added))


#: A signed number that no digit or point touches.
NUMBER = r"(?<![\d.])[-+]?\d+(?:\.\d+)?(?![\d.])"


def numbers_unsupported(answer: Column, allowed: Column) -> Column:
    """Numbers of an answer, as written and without repeats, that none of ``allowed`` (an array of texts) holds."""
    held = F.flatten(F.transform(allowed, lambda t: F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))))
    return F.array_except(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0)), held)


def redact(x: Column, names: Column, mark: str) -> Column:
    """Every identifier of ``names`` (an array) replaced."""
    return F.aggregate(F.filter(names, lambda n: n.isNotNull() & (n != "")), x, lambda t, n: F.replace(t, n, F.lit(mark)))


def in_order(text: Column, fragments: Column) -> Column:
    """Whether each fragment is found behind the one before it."""

    def behind(at: Column, f: Column) -> Column:
        found = F.position(f, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(f)).otherwise(0)

    return F.aggregate(fragments, F.lit(1), behind) > 0
