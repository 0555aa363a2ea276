"""Evidence: near hashes, duplicate decisions, field consistency, merged cells, corrections and certificate fields."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import levels as L
from assayer.functions import text as T

# The facts of a certificate, and the words for its team attribute.
FACTS = ["姓名", "赛事名称", "级别", "奖项/名次", "获奖日期", "颁发单位", "团队属性"]
TEAM, SINGLE = ["团队", "团体", "集体", "team", "true", "是"], ["个人", "individual", "false", "否"]
#: Facts that are equal or conflict; the event conflicts below 0.85, the issuer below 0.55.
DISCRETE = ("姓名", "级别", "奖项/名次", "获奖日期", "团队属性")
CUTOFFS = {"赛事名称": 0.85, "颁发单位": 0.55}
CRITICAL = ("姓名", "赛事名称", "获奖日期")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes; null unless both are such and equally long."""
    digit = lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1
    chars = lambda x: F.split(F.lower(x), "")
    bits = F.zip_with(chars(a), chars(b), lambda x, y: F.bit_count(digit(x).bitwiseXOR(digit(y))))
    good = a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$") & (F.length(a) == F.length(b))
    return F.when(good, F.aggregate(bits, F.lit(0), lambda s, x: s + x))


def near_pairs(rows: DataFrame, id_col: str, hash_col: str, radius: int = 3, bits: int = 64) -> DataFrame:
    """a < b and distance of all pairs of distinct hashes within ``radius``.

    Equal hashes are one node (their smallest id). By the pigeonhole principle
    a pair agrees on one of radius + 1 blocks of its bits and, once more, on
    one of radius + 1 parts of all other bits, so the join is by a block and a
    part together: hashes that share a common block don't all meet.
    """
    nodes = rows.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    masks = []
    for k in range(radius + 1):
        block = set(range(k * bits // (radius + 1), (k + 1) * bits // (radius + 1)))
        rest = [i for i in range(bits) if i not in block]
        for j in range(radius + 1):
            mask = sum(1 << i for i in block | set(rest[j :: radius + 1]))
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("h").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)]))
    keyed = nodes.select("id", "h", keys.alias("b")).select("id", "h", "b.k", "b.v")
    left, right = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "k", "v"), keyed.select(F.col("id").alias("b"), F.col("h").alias("hb"), "k", "v")
    near = left.join(right, ["k", "v"]).where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= radius))
    return near.select("a", "b", hamming(F.col("ha"), F.col("hb")).cast("long").alias("distance")).distinct()


def normal_fact(field: str, value: Column) -> Column:
    """A fact (a composed text or null) in the form in which facts are compared."""
    key = T.norm_key(value)
    if field == "级别":
        return F.coalesce(L.tier_of(F.regexp_replace(value, T.NOISE, "")), key)
    if field == "奖项/名次":
        return F.coalesce(L.prize_of(F.regexp_replace(value, T.NOISE, "")), key)
    if field == "获奖日期":
        part = lambda n: F.get(F.regexp_extract_all(value, F.lit("\\d+"), F.lit(0)), F.lit(n)).try_cast("int")
        y, m, d = part(0), part(1), part(2)
        day = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.when(value.isNotNull(), F.when(y.between(1900, 2100) & m.between(1, 12) & d.between(1, 31), day).otherwise(key))
    if field == "团队属性":
        return F.when(key.isin(TEAM), "团队").when(key.isin(SINGLE), "个人").otherwise(key)
    return key


def ratio(a: Column, b: Column) -> Column:
    """Likeness of two texts by their matching blocks (0 to 1)."""
    return F.pandas_udf(lambda x, y: x.combine(y, lambda s, t: SequenceMatcher(None, s or "", t or "").ratio()), "double")(a, b)


def compare_facts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` (two maps of facts) with ``facts``: array of field, similarity (4 places), exact and conflict of those that both sides have."""
    sides = {}
    for k, field in enumerate(FACTS):
        for side in (left, right):
            sides[f"__{side}{k}"] = normal_fact(field, F.nullif(T.strip(F.col(side)[field]), F.lit("")))
    rows = pairs.withColumns(sides)
    rows = rows.withColumns({f"__like{k}": ratio(F.col(f"__{left}{k}"), F.col(f"__{right}{k}")) for k, f in enumerate(FACTS) if f not in DISCRETE})

    def one(k: int, field: str) -> Column:
        a, b = F.col(f"__{left}{k}"), F.col(f"__{right}{k}")
        exact = (a != "") & (a == b)
        like = F.when(exact, 1.0).otherwise(F.lit(0.0) if field in DISCRETE else F.col(f"__like{k}"))
        made = F.struct(F.lit(field).alias("field"), F.round(like, 4).alias("similarity"), exact.alias("exact"), (like < CUTOFFS.get(field, 1.0)).alias("conflict"))
        return F.when(a.isNotNull() & b.isNotNull(), made)

    facts = F.array_compact(F.array(*[one(k, f) for k, f in enumerate(FACTS)]))
    return rows.select(*pairs.columns, facts.alias("facts"))


def duplicate_decision(same_file: Column, distance: Column, facts: Column, least_fields: int = 4) -> Column:
    """duplicate, suspected or distinct: the first of eight branches that holds.

    Equal files; a critical conflict vetoes all else; equal facts with identity;
    a near image whose facts don't disagree; facts alike with identity; an image
    within the wider radius; facts somewhat alike; none.
    """
    n = F.size(facts)
    alike = F.when(n > 0, F.round(F.aggregate(facts, F.lit(0.0), lambda s, f: s + f["similarity"]) / n, 4))
    vetoed = F.exists(facts, lambda f: f["conflict"] & f["field"].isin(*CRITICAL))
    all_equal = (n > 0) & F.forall(facts, lambda f: f["exact"])
    identity = F.size(F.filter(facts, lambda f: f["exact"] & f["field"].isin("姓名", "赛事名称"))) == 2
    enough = (n >= least_fields) & identity
    return (
        F.when(same_file, "duplicate").when(vetoed, "distinct").when(all_equal & enough, "duplicate").when((distance <= 2) & ((n == 0) | (alike >= 0.8)), "duplicate")
        .when(enough & (alike >= 0.98), "duplicate").when(distance <= 10, "suspected").when(enough & (alike >= 0.8), "suspected").otherwise("distinct")
    )


def consistency(rows: DataFrame, key: str, fields: list[tuple[str, Column, Column, Column, Column]]) -> DataFrame:
    """key, statuses, mismatched, insufficient and overall over (name, claim, evidence, and both normalised).

    A missing side is insufficient; equal as written is equal, equal when
    normalised is alike; a mismatch outranks what is insufficient.
    """

    def status(a: Column, b: Column, na: Column, nb: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), "insufficient").when(T.strip(a) == T.strip(b), "equal").when((na != "") & (na == nb), "alike").otherwise("mismatch")

    found = rows.select(key, F.array(*[F.struct(F.lit(n).alias("f"), status(a, b, na, nb).alias("s")) for n, a, b, na, nb in fields]).alias("f"))
    names = lambda s: F.array_join(F.transform(F.filter("f", lambda x: x["s"] == s), lambda x: x["f"]), ",")
    has = lambda s: F.exists("f", lambda x: x["s"] == s)
    return found.select(
        key, F.array_join(F.transform("f", lambda x: x["s"]), ",").alias("statuses"), names("mismatch").alias("mismatched"), names("insufficient").alias("insufficient"),
        F.when(has("mismatch"), "mismatch").when(has("insufficient"), "review").otherwise("pass").alias("overall"),
    )


def overlapping(merges: DataFrame) -> DataFrame:
    """sheet and both corners of merged ranges that overlap, found by the rows that they share."""
    numbered = merges.select("sheet", "r0", "c0", "r1", "c1", F.explode(F.sequence("r0", "r1")).alias("row"))
    other = numbered.select("sheet", "row", *[F.col(c).alias(f"other_{c}") for c in ("r0", "c0", "r1", "c1")])
    later = F.struct("other_r0", "other_c0", "other_r1", "other_c1") > F.struct("r0", "c0", "r1", "c1")
    clash = numbered.join(other, ["sheet", "row"]).where(later & (F.col("c0") <= F.col("other_c1")) & (F.col("other_c0") <= F.col("c1")))
    return clash.drop("row").distinct()


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (sheet, row, col, value): blanks inside a merged range take the value to their left, then the one above, in the range; nothing else changes.

    Overlapping ranges are an error. The range join is by sheet and by the rows
    that a range covers, once; cells outside all ranges go through it unchanged.
    """
    clash = overlapping(merges).first()
    if clash is not None:
        raise ValueError(f"merged ranges overlap: {clash.asDict()}")
    covered = merges.select("sheet", "r0", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row"))
    spans = covered.groupBy("sheet", "row").agg(F.collect_list(F.struct("r0", "c0", "c1")).alias("spans"))
    mine = F.get(F.filter(F.coalesce("spans", F.array().cast("array<struct<r0:bigint,c0:bigint,c1:bigint>>")), lambda s: F.col("col").between(s["c0"], s["c1"])), F.lit(0))
    placed = cells.join(spans, ["sheet", "row"], "left").select("sheet", "row", "col", "value", mine.alias("m"))
    till = lambda *p: Window.partitionBy("sheet", "m.r0", "m.c0", *p).orderBy("row", "col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outside = placed.where("m is null").select("sheet", "row", "col", "value")
    right = placed.where("m is not null").withColumn("value", F.last("value", ignorenulls=True).over(till("row")))
    down = right.withColumn("value", F.last("value", ignorenulls=True).over(till("col")))
    return down.select("sheet", "row", "col", "value").unionByName(outside)


def corrected(field: Column, value: Column) -> Column:
    """A person's correction in its normal form; null where it isn't allowed for its field (names and ids never are)."""
    clean = F.regexp_replace(value, T.NOISE, "")
    return (
        F.when(field.isin("姓名", "学号"), None).when(field == "获奖日期", T.parse_date(value).cast("string")).when(field == "级别", L.tier_of(clean))
        .when(field == "奖项/名次", L.prize_of(clean)).when(field == "团队属性", F.when(value.isin("团队", "团体", "集体"), "团队").when(value.isin("个人", "单人"), "个人")).otherwise(value)
    )


def certificate_values(lines: Column) -> Column:
    """Struct of event, issuer, day, tier and prize read from a certificate's (composed) lines by pattern."""
    text, flat = F.array_join(lines, "\n"), F.array_join(lines, "")
    signed = F.filter(F.transform(lines, T.strip), lambda s: s.rlike("(?:委员会|学校|学院|协会|中心|政府|教育厅|组委会)$"))
    day = F.regexp_extract(text, f"20\\d{{2}}[{T.SPACE}]*[年./-][{T.SPACE}]*\\d{{1,2}}[{T.SPACE}]*[月./-][{T.SPACE}]*\\d{{1,2}}[{T.SPACE}]*日?", 0)
    clean = F.regexp_replace(text, T.NOISE, "")
    return F.struct(
        F.nullif(F.regexp_extract(flat, "在(.{2,100}?)(?:中|上)荣获", 1), F.lit("")).alias("event"), F.try_element_at(signed, F.lit(-1)).alias("issuer"),
        T.parse_date(F.regexp_replace(day, f"[{T.SPACE}]+", "")).cast("string").alias("day"), L.tier_of(clean).alias("tier"), L.prize_of(clean).alias("prize"),
    )


def locate(lines: Column, needle: Column) -> Column:
    """Struct of the line numbers that hold ``needle`` and where it begins and ends in the joined text (null: nowhere)."""
    text = F.array_join(lines, "\n")
    at = F.when(needle != "", F.nullif(F.instr(text, needle), F.lit(0)) - 1)
    rows = F.filter(F.transform(lines, lambda s, i: F.when((needle != "") & F.contains(s, needle), i)), lambda i: i.isNotNull())
    return F.struct(rows.alias("lines"), at.alias("begin"), (at + F.length(needle)).alias("end"))


def field_confidence(signals: list[tuple[Column, float]], supported: Column) -> Column:
    """Weighted mean of the signals that are there (4 places); zero without support in the source."""
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals), F.lit(0.0))
    return F.when(supported, F.round(total / F.nullif(weight, F.lit(0.0)), 4)).otherwise(0.0)


def map_diff(a: Column, b: Column) -> Column:
    """Sorted names of the entries of two maps that differ (a missing one differs from any)."""
    both = F.map_zip_with(a, b, lambda k, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v)))
