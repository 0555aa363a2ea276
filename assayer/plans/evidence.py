"""Evidence, ingest and workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators import evidence as V
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_query("pair_dedup", """WITH n AS (SELECT h, min(id) AS id FROM (SELECT c_custkey AS id, (c_custkey % 40) * 4294967296 + c_custkey // 40 AS h FROM customer) GROUP BY h)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM n a JOIN n b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 1""")
def pair_dedup(spark, d):
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(key.alias("id"), ((key % 40) * 4294967296 + F.floor(key / 40)).alias("h"))
    return V.near_pairs(rows, "id", "h", radius=1)


def _pick(items, at):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items) + 1).cast("int"))


def _sql(items) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in items) + "]"


_AT = lambda items, at: f"({_sql(items)})[({at}) % {len(items)} + 1]"
#: A claim's and a certificate's values, and by hand their normal forms.
_TIERS = [("省级", "省赛", "省级", "省级"), ("国家级", "全国", "国家级", "国家级"), ("校级", "省级", "校级", "省级"), (None, "校级", None, "校级"), ("省级", " 省级 ", "省级", "省级")]
_TEAMS = [("团队", "集体", "团队", "团队"), ("个人", "individual", "个人", "个人"), ("团队", "个人", "团队", "个人"), ("个人", None, "个人", None)]
_YEARS = [("2024-2025", "2024年10月2日", "2024-2025", "2024-2025"), ("2024-2025", "2024/8/31", "2024-2025", "2023-2024"), ("2023-2024", "some day", "2023-2024", "")]


def _status(a: str, b: str, na: str, nb: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'insufficient' WHEN trim({a}, ' ') = trim({b}, ' ') THEN 'equal' WHEN {na} <> '' AND {na} = {nb} THEN 'alike' ELSE 'mismatch' END"


def _four(items, at: str) -> list[str]:
    return [_AT([row[k] for row in items], at) for k in range(4)]


@_query("consistency_fields", f"""WITH f AS (SELECT c_custkey, [{_status(*_four(_TIERS, 'c_custkey'))}, {_status(*_four(_TEAMS, 'c_custkey // 5'))}, {_status(*_four(_YEARS, 'c_custkey // 3'))}] AS s FROM customer)
SELECT c_custkey, array_to_string(s, ',') AS statuses, array_to_string(list_filter([CASE WHEN s[1] = 'mismatch' THEN 'tier' END, CASE WHEN s[2] = 'mismatch' THEN 'team' END, CASE WHEN s[3] = 'mismatch' THEN 'year' END], lambda x: x IS NOT NULL), ',') AS mismatched,
  array_to_string(list_filter([CASE WHEN s[1] = 'insufficient' THEN 'tier' END, CASE WHEN s[2] = 'insufficient' THEN 'team' END, CASE WHEN s[3] = 'insufficient' THEN 'year' END], lambda x: x IS NOT NULL), ',') AS insufficient,
  CASE WHEN list_contains(s, 'mismatch') THEN 'mismatch' WHEN list_contains(s, 'insufficient') THEN 'review' ELSE 'pass' END AS overall FROM f""")
def consistency_fields(spark, d):
    """Claims against certificates: tier, team and academic year, as written and in their normal form."""
    k = F.col("c_custkey")
    at = {"tier": k, "team": F.floor(k / 5), "year": F.floor(k / 3)}
    rows = table(spark, d, "customer").select(k, *[_pick([row[side] for row in items], at[name]).alias(f"{name}{side}") for name, items in (("tier", _TIERS), ("team", _TEAMS), ("year", _YEARS)) for side in (0, 1)])
    year = lambda c: F.when(c.rlike("^.{4}-.{4}$"), c).otherwise(F.coalesce(T.year_span(T.academic_year_of(T.parse_date(c))), F.lit("")))
    tier, team = lambda c: V.normal_fact("级别", c), lambda c: V.normal_fact("团队属性", c)
    return V.consistency(rows, "c_custkey", [(n, F.col(f"{n}0"), F.col(f"{n}1"), f(F.col(f"{n}0")), f(F.col(f"{n}1"))) for n, f in (("tier", tier), ("team", team), ("year", year))])


#: Pairs of facts (two events whose likeness is known by hand: 8 of 9 and 10 characters match, 16/19) and the answer for a distant, a near and an equal image.
_EVENTS = [("数学建模竞赛决赛", "数学建模竞赛决赛", 1.0), ("数学建模竞赛决赛队", "数学建模竞赛决赛", 0.9412), ("数学建模", "物理实验", 0.0), (None, "数学建模", None)]
_NAMES = [("张三", "张 三", 1.0), ("张三", "李四", 0.0), ("张三", None, None)]
_DAYS = [("2024-5-1", "2024年05月01日", 1.0), ("2024-5-1", "2024-5-2", 0.0), (None, None, None)]
_AWARDS = [("一等奖", "冠军", 1.0), ("一等奖", "二等奖", 0.0), (None, "一等奖", None)]
_VALUES = lambda items: "[" + ", ".join("NULL" if r[2] is None else f"{r[2]}::DOUBLE" for r in items) + "]"
_SIM = lambda items, at: f"({_VALUES(items)})[({at}) % {len(items)} + 1]"


@_query("duplicate_ladder", f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 23 = 0 AS same, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 24 END AS dist, {_SIM(_NAMES, 'p_partkey // 2')} AS n, {_SIM(_EVENTS, 'p_partkey // 3')} AS e, {_SIM(_DAYS, 'p_partkey // 7')} AS dd, {_SIM(_AWARDS, 'p_partkey // 11')} AS a, 1.0::DOUBLE AS t FROM part),
s AS (SELECT *, list_filter([n, e, a, dd, t], lambda x: x IS NOT NULL) AS f FROM p),
v AS (SELECT *, len(f) AS k, round(list_sum(f) / len(f), 4) AS alike, coalesce(n < 1, false) OR coalesce(e < 0.85, false) OR coalesce(dd < 1, false) AS veto, coalesce(n = 1 AND e = 1, false) AS identity FROM s)
SELECT id, CASE WHEN same THEN 'duplicate' WHEN veto THEN 'distinct' WHEN list_min(f) = 1 AND k >= 4 AND identity THEN 'duplicate' WHEN dist <= 2 AND alike >= 0.8 THEN 'duplicate' WHEN k >= 4 AND identity AND alike >= 0.98 THEN 'duplicate'
  WHEN dist <= 10 THEN 'suspected' WHEN k >= 4 AND identity AND alike >= 0.8 THEN 'suspected' ELSE 'distinct' END AS decision, dist::INTEGER AS distance, k::INTEGER AS fields, alike FROM v""")
def duplicate_ladder(spark, d):
    """The eight branches over made-up pairs: file, image distance and five facts."""
    k = F.col("p_partkey")
    of = lambda side: F.create_map(
        F.lit("姓名"), _pick([r[side] for r in _NAMES], F.floor(k / 2)), F.lit("赛事名称"), _pick([r[side] for r in _EVENTS], F.floor(k / 3)), F.lit("获奖日期"), _pick([r[side] for r in _DAYS], F.floor(k / 7)),
        F.lit("奖项/名次"), _pick([r[side] for r in _AWARDS], F.floor(k / 11)), F.lit("团队属性"), F.lit(["团队", "team"][side]),
    )
    left, right = F.lit("00ff00ff00ff00ff"), F.when(k % 5 == 0, "00ff00ff00ff00fe").when(k % 5 == 1, "00FF00FF00FF003C").when(k % 5 == 2, "ffff00ff00ffff00").when(k % 5 == 3, "zz").otherwise(None)
    pairs = table(spark, d, "part").select(k.alias("id"), (k % 23 == 0).alias("same"), V.hamming_hex(left, right).alias("distance"), of(0).alias("l"), of(1).alias("r"))
    judged = V.compare_facts(pairs, "l", "r")
    n = F.size("facts")
    alike = F.round(F.aggregate("facts", F.lit(0.0), lambda s, f: s + f["similarity"]) / n, 4)
    return judged.select("id", V.duplicate_decision(F.col("same"), F.col("distance"), F.col("facts")).alias("decision"), "distance", n.alias("fields"), alike.alias("alike"))


@_query("merge_fill", """WITH cells AS (SELECT o_custkey % 40 AS sheet, o_orderkey // 8 % 12 AS row, o_orderkey % 8 AS col, any_value(CASE WHEN o_orderkey % 3 = 0 THEN 'v' || (o_orderkey % 100)::VARCHAR END ORDER BY o_orderkey) AS value FROM orders GROUP BY 1, 2, 3),
m(r0, r1, c0, c1) AS (VALUES (0, 3, 0, 1), (5, 9, 2, 4)),
j AS (SELECT c.*, m.r0, m.c0 FROM cells c LEFT JOIN m ON c.row BETWEEN m.r0 AND m.r1 AND c.col BETWEEN m.c0 AND m.c1),
h AS (SELECT *, (SELECT arg_max(l.value, l.col) FROM j l WHERE l.sheet = j.sheet AND l.row = j.row AND l.r0 = j.r0 AND l.col <= j.col AND l.value IS NOT NULL) AS side FROM j),
v AS (SELECT *, (SELECT arg_max(u.side, u.row) FROM h u WHERE u.sheet = h.sheet AND u.col = h.col AND u.r0 = h.r0 AND u.row <= h.row AND u.side IS NOT NULL) AS above FROM h)
SELECT sheet, row, col, CASE WHEN r0 IS NULL THEN value ELSE above END AS value FROM v""")
def merge_fill(spark, d):
    """Blank cells of merged ranges, filled from the left and then from above; own values stay."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 100).cast("string")))
    grid = table(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("sheet"), (F.floor(k / 8) % 12).cast("long").alias("row"), (k % 8).alias("col"))
    cells = grid.agg(F.min(F.when(value.isNotNull(), F.struct(k.alias("k"), value.alias("v"))))["v"].alias("value"))
    merges = spark.createDataFrame([(s, *m) for s in range(40) for m in ((0, 3, 0, 1), (5, 9, 2, 4))], "sheet long, r0 long, r1 long, c0 long, c1 long")
    return V.fill_merges(cells, merges)


@_query("merge_overlaps", """WITH m AS (SELECT s_suppkey % 20 AS sheet, s_suppkey % 7 AS r0, s_suppkey % 7 + s_nationkey % 4 AS r1, s_nationkey % 9 AS c0, s_nationkey % 9 + s_suppkey % 3 AS c1 FROM supplier)
SELECT DISTINCT a.sheet, a.r0, a.c0::BIGINT AS c0, b.r0 AS other_r0, b.c0::BIGINT AS other_c0 FROM m a JOIN m b ON a.sheet = b.sheet AND (b.r0, b.c0, b.r1, b.c1) > (a.r0, a.c0, a.r1, a.c1) AND a.r0 <= b.r1 AND b.r0 <= a.r1 AND a.c0 <= b.c1 AND b.c0 <= a.c1""")
def merge_overlaps(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    merges = table(spark, d, "supplier").select((s % 20).alias("sheet"), (s % 7).alias("r0"), (s % 7 + n % 4).alias("r1"), (n % 9).alias("c0"), (n % 9 + s % 3).alias("c1"))
    return V.overlapping(merges).select("sheet", "r0", "c0", "other_r0", "other_c0").distinct()


_FIXES = [("获奖日期", "2024年5月6日", "2024-05-06"), ("获奖日期", "soon", None), ("级别", "省赛", "省级"), ("级别", "x", None), ("奖项/名次", "第二名", "二等奖"), ("团队属性", "集体", "团队"), ("团队属性", "we", None), ("姓名", "张三", None), ("备注", "as is", "as is")]


@_query("corrections", f"SELECT c_custkey, {_AT([f for f, _, _ in _FIXES], 'c_custkey')} AS field, {_AT([n for _, _, n in _FIXES], 'c_custkey')} AS value FROM customer")
def corrections(spark, d):
    """People's corrections in their normal form, or null where they aren't allowed."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k, _pick([f for f, _, _ in _FIXES], k).alias("field"), _pick([v for _, v, _ in _FIXES], k).alias("value"))
    return rows.select("c_custkey", "field", V.corrected(F.col("field"), F.col("value")).alias("value"))


@_query("certificates", """SELECT s_suppkey AS id, 'Cup ' || s_suppkey::VARCHAR AS event, CASE WHEN s_suppkey % 3 > 0 THEN '某某大学学院' END AS issuer, CASE WHEN s_suppkey % 4 > 0 THEN '2024-' || lpad((s_suppkey % 12 + 1)::VARCHAR, 2, '0') || '-07' END AS day,
  CASE WHEN s_suppkey % 3 = 0 THEN '省级' WHEN s_suppkey % 3 = 1 THEN '国家级' END AS tier, (['一等奖', '二等奖', '特等奖'])[s_suppkey % 3 + 1] AS prize,
  CASE WHEN s_suppkey % 3 > 0 THEN '1,3' ELSE '1' END AS found, 8 AS begin FROM supplier""")
def certificates(spark, d):
    """Event, issuer, day, tier and prize from the lines of a certificate, and where a text stands in them."""
    k = F.col("s_suppkey")
    lines = F.array(
        F.lit(" 荣誉证书 "), F.concat(F.lit("张三学院在Cup "), k.cast("string"), F.lit("中荣获")), F.concat(_pick(["省赛", "全国", ""], k), _pick(["冠军", "二等", "特别奖"], k)),
        F.when(k % 3 > 0, " 某某大学学院 ").otherwise("无"), F.when(k % 4 > 0, F.concat(F.lit("2024 年 "), (k % 12 + 1).cast("string"), F.lit(" 月 7 日"))).otherwise("2024"),
    )
    v, at = V.certificate_values(F.col("lines")), V.locate(F.col("lines"), F.lit("学院"))
    rows = table(spark, d, "supplier").select(k.alias("id"), lines.alias("lines")).select("id", v.alias("v"), at.alias("at"))
    return rows.select("id", "v.event", "v.issuer", "v.day", "v.tier", "v.prize", F.array_join(F.col("at.lines").cast("array<string>"), ",").alias("found"), (F.col("at.begin") - 1).alias("begin"))


@_query("field_confidence", """SELECT event_id, CASE WHEN user_id % 4 > 0 THEN round((value / 199.7::DOUBLE * 0.30::DOUBLE + (event_id % 2) * 0.25::DOUBLE + CASE WHEN event_id % 3 > 0 THEN 0.15::DOUBLE ELSE 0 END) / (0.30::DOUBLE + 0.25::DOUBLE + CASE WHEN event_id % 3 > 0 THEN 0.15::DOUBLE ELSE 0 END), 4) ELSE 0 END AS confidence FROM events""")
def field_confidence(spark, d):
    """Mean of the signals that are there, by weight; nothing counts without support in the source."""
    e = F.col("event_id")
    signals = [(F.col("value") / 199.7, 0.30), ((e % 2).cast("double"), 0.25), (F.when(e % 3 > 0, 1.0), 0.15)]
    return table(spark, d, "events").select("event_id", V.field_confidence(signals, F.col("user_id") % 4 > 0).alias("confidence"))


@_query("field_diff", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'O' THEN 'a' END, CASE WHEN o_custkey % 3 > 0 THEN 'b' END, 'c', 'd'], lambda x: x IS NOT NULL), ',') AS changed FROM orders""")
def field_diff(spark, d):
    """Names of the fields in which two versions of a record differ."""
    a = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.when(F.col("o_custkey") % 3 > 0, "x"), F.lit("c"), F.lit("1"))
    b = F.create_map(F.lit("a"), F.lit("O"), F.lit("b"), F.lit(None).cast("string"), F.lit("d"), F.lit("1"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(V.map_diff(a, b), ",").alias("changed"))


@_query("html_text_blocks", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')) AS text_md5 FROM pages""")
def html_text_blocks(spark, d):
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))
    return table(spark, d, "pages").select("page_id", F.md5(plain).alias("text_md5"))


@_query("idempotent_first", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def idempotent_first(spark, d):
    first = F.min(F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(first.alias("f")).select("user_id", "event_type", F.col("f.event_id").alias("event_id"))


@_query("unit_cost", "SELECT event_id, CASE WHEN value >= 5 THEN round((floor(value) * 2 + floor(value / 2) * 8) / 1000000.0::DOUBLE, 8) END AS cost FROM events")
def unit_cost(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v >= 5, F.round((F.floor(v) * 2 + F.floor(v / 2) * 8) / F.lit(1e6), 8)).alias("cost"))


@_query("events_windowed", """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1, 2""")
def events_windowed(spark, d):
    """Counts by tumbling day; ``assayer.streaming`` runs the same aggregation on a stream."""
    from assayer.streaming.windows import tumbling_counts

    return tumbling_counts(table(spark, d, "events"), "ts", "event_type", "1 day").select("event_type", F.col("start").alias("day"), "n")
