"""The gateway over drafts made up from parts, with a SQL twin that states every check by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import gateway as W
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: level as drafted, its canonical name, whether it is a known one; a quote; its canonical level; the points in it
_LEVELS = [("省二等奖", "省级二等奖", True), ("校级一等", "校级一等奖", True), ("level X", "levelX", False), ("全国亚军", "国家级二等奖", True), ("三好学生", "三好学生", True)]
_QUOTES = [("省级二等奖加8分", "省级二等奖", [8]), ("校级一等奖计 3 分", "校级一等奖", [3]), ("level X 得十二分", "levelX得十二分", [12]), ("获全国第二名加8.5分或9分", "国家级二等奖", [8.5, 9]), ("评为三好学生，不计分", "三好学生", [])]
_SCORES = ["8", "3", '"8"', "120", "8.5", "12", "0"]
_TAILS = ["", ', "cap": 20', ', "cap": 101, "team_factor": 0.5', ', "team_factor": 1.5', ', "extra": 1', ', "effective_date": "2024-10-01"', ', "effective_date": "2023-01-01"', ', "effective_date": "1 Oct"', ', "rank": "第一", "item_name": null', ', "synonyms": ["a"]', ', "cap": "x"']
_SOURCES = ["细则：{q}。", "第一条 {q}", "无关的文字"]


def _pick(items, at):
    return F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))


def _drafts(spark, d, shift=0):
    k = F.col("p_partkey")
    quote = _pick([q for q, _, _ in _QUOTES], k + F.floor(k / 50))
    scores = _pick(_SCORES, F.floor(k / 3) + F.lit(shift) * (k % 7 == 1).cast("int"))
    level = F.when(k % 31 == 0, F.lit("")).otherwise(_pick([a for a, _, _ in _LEVELS], k))
    payload = F.concat(F.lit('{"category": "c'), (k % 3).cast("string"), F.lit('", "level": "'), level, F.lit('", "evidence_quote": "'), quote, F.lit('", "score": '), scores, _pick(_TAILS, F.floor(k / 2)), F.lit("}"))
    source = F.replace(_pick(_SOURCES, F.floor(k / 4)), F.lit("{q}"), quote)
    return table(spark, d, "part").select(F.floor(k / 10).alias("batch"), (k % 10).alias("idx"), payload.alias("payload"), source.alias("source"), k.alias("k"))


def _second(spark, d):
    return _drafts(spark, d, 1).where("k % 7 <> 0").drop("k")


def _validated(spark, d):
    return W.validate(_drafts(spark, d).drop("k"), "2024-2025", _second(spark, d))


def _l(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


_AT = lambda items, at: f"({_l(items)})[({at}) % {len(items)} + 1]"
_ROWS = f"""parts AS (SELECT p_partkey AS k, p_partkey // 10 AS batch, p_partkey % 10 AS idx, p_partkey % 5 AS lv, (p_partkey + p_partkey // 50) % 5 AS qu, p_partkey % 31 = 0 AS nolevel, 'c' || (p_partkey % 3)::VARCHAR AS category,
  p_partkey // 3 AS sc, p_partkey // 2 % {len(_TAILS)} AS tail, p_partkey // 4 % 3 AS src FROM part),
levels(lv, canonical, known) AS (VALUES {', '.join(f"({i}, '{c}', {str(m).lower()})" for i, (_, c, m) in enumerate(_LEVELS))}),
quotes(qu, quote, qlevel, points) AS (VALUES {', '.join(f"({i}, '{q}', '{c}', {p}::DOUBLE[])" for i, (q, c, p) in enumerate(_QUOTES))}),
scores(s, text, value) AS (VALUES {', '.join(f"({i}, '{t}', {'NULL' if t[0] == chr(34) else t}::DOUBLE)" for i, t in enumerate(_SCORES))}),
first AS (SELECT p.*, canonical, known, quote, qlevel, points, value, sc % {len(_SCORES)} AS s, NOT nolevel AND value IS NOT NULL AND tail NOT IN (4, 10) AS ok, CASE tail WHEN 1 THEN 20 WHEN 2 THEN 101 END AS cap, CASE tail WHEN 2 THEN 0.5 WHEN 3 THEN 1.5 END AS factor, CASE WHEN tail = 8 THEN '第一' ELSE '' END AS rank
  FROM parts p JOIN levels USING (lv) JOIN quotes USING (qu) JOIN scores ON s = sc % {len(_SCORES)}),
second AS (SELECT f.batch, f.category, f.canonical, f.rank, x.value, f.cap, f.factor, NOT nolevel AND x.value IS NOT NULL AND tail NOT IN (4, 10) AS ok FROM first f JOIN scores x ON x.s = (f.sc + (f.k % 7 = 1)::INT) % {len(_SCORES)} WHERE f.k % 7 <> 0),
met AS (SELECT batch, category, canonical, rank, count(*) AS n, count(DISTINCT (value, cap, factor)) AS kinds, any_value(value) AS v2, any_value(cap) AS c2, any_value(factor) AS f2 FROM second WHERE ok GROUP BY ALL),
failed AS (SELECT DISTINCT batch FROM second WHERE NOT ok),
spread AS (SELECT batch, category, canonical, rank, count(DISTINCT value) AS scores FROM first WHERE ok GROUP BY ALL),
codes AS (SELECT f.batch, f.idx, f.ok, src < 2 AS there, CASE WHEN src = 0 THEN 3 WHEN src = 1 THEN 4 END AS start, CASE WHEN NOT f.ok THEN ['schema_error'] ELSE list_filter([
  CASE WHEN NOT list_contains(points, value) THEN 'score_not_in_quote' END, CASE WHEN NOT (contains(qlevel, f.canonical) OR contains(f.canonical, qlevel)) THEN 'level_not_in_quote' END, CASE WHEN src = 2 THEN 'quote_not_found' END,
  CASE WHEN value <= 0 OR value > 100 THEN 'score_out_of_range' END, CASE WHEN NOT known THEN 'invalid_level' END, CASE WHEN cap > 100 THEN 'invalid_cap' END, CASE WHEN factor > 1 THEN 'invalid_team_factor' END,
  CASE WHEN tail = 7 THEN 'invalid_effective_date' END, CASE WHEN tail = 6 THEN 'effective_date_out_of_year' END,
  CASE WHEN n IS NULL AND x.batch IS NOT NULL THEN 'secondary_schema_error' END, CASE WHEN n IS NULL AND x.batch IS NULL THEN 'secondary_missing' END, CASE WHEN n > 1 OR v2 <> value OR c2 IS DISTINCT FROM cap AND n IS NOT NULL OR f2 IS DISTINCT FROM factor AND n IS NOT NULL THEN 'secondary_mismatch' END,
  CASE WHEN scores > 1 THEN 'rule_conflict' END], lambda c: c IS NOT NULL) END AS codes
  FROM first f LEFT JOIN met m ON f.batch = m.batch AND f.category = m.category AND f.canonical = m.canonical AND f.rank = m.rank LEFT JOIN failed x ON f.batch = x.batch LEFT JOIN spread p ON f.batch = p.batch AND f.category = p.category AND f.canonical = p.canonical AND f.rank = p.rank),
validated AS (SELECT batch, idx, CASE WHEN len(codes) = 0 THEN 'accepted' WHEN list_has_any(codes, ['schema_error', 'score_not_in_quote', 'level_not_in_quote']) THEN 'rejected' ELSE 'review' END AS status, array_to_string(codes, ',') AS codes, CASE WHEN ok THEN start END AS char_start,
  CASE WHEN list_has_any(codes, ['score_not_in_quote', 'level_not_in_quote']) THEN 0.0::DOUBLE WHEN len(codes) > 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM codes)"""


@_query("gateway_drafts", f"WITH {_ROWS} SELECT batch, idx, status, codes, char_start, confidence FROM validated")
def gateway_drafts(spark, d):
    """Every draft with its issues in order, its status and where its quote stands."""
    return _validated(spark, d)


@_query("gateway_report", f"WITH {_ROWS} SELECT batch, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected, round(count(*) FILTER (status <> 'accepted') / count(*), 6) AS interception_rate, count(*) FILTER (status <> 'accepted') = 0 AS publishable FROM validated GROUP BY batch")
def gateway_report(spark, d):
    return W.report(_validated(spark, d))


@_query("gateway_issues", f"WITH {_ROWS}, c AS (SELECT unnest(string_split(codes, ',')) AS code FROM validated) SELECT code, CASE WHEN code = 'rule_conflict' THEN 'publication' ELSE 'validation' END AS stage, count(*) AS n FROM c WHERE code <> '' GROUP BY code")
def gateway_issues(spark, d):
    return W.reasons(_validated(spark, d))


@_query("gateway_detection", f"""WITH {_ROWS}, e AS (SELECT batch, idx, CASE WHEN k % 2 = 0 THEN 'schema' ELSE 'quote' END AS target, CASE WHEN k % 2 = 0 THEN 'schema_error' ELSE 'quote_not_found' END AS code FROM first WHERE tail = 4 OR src = 2)
SELECT target, count(*) AS cases, count(*) FILTER (list_contains(string_split(codes, ','), code)) AS detected, round(count(*) FILTER (list_contains(string_split(codes, ','), code)) / count(*), 6) AS rate, coalesce(string_agg(e.batch::VARCHAR || ':' || e.idx::VARCHAR, ',' ORDER BY e.batch::VARCHAR || ':' || e.idx::VARCHAR) FILTER (NOT list_contains(string_split(codes, ','), code)), '') AS missed
FROM e JOIN validated v ON e.batch = v.batch AND e.idx = v.idx GROUP BY target""")
def gateway_detection(spark, d):
    """Of drafts planted with a fault, how many are found with the code that names it."""
    k = F.col("k")
    planted = _drafts(spark, d).where((F.floor(k / 2) % len(_TAILS) == 4) | (F.floor(k / 4) % 3 == 2))
    expected = planted.select("batch", "idx", F.when(k % 2 == 0, "schema").otherwise("quote").alias("target"), F.when(k % 2 == 0, "schema_error").otherwise("quote_not_found").alias("code"))
    return W.detection(_validated(spark, d), expected)


@_query("line_rules", f"""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 7 AS a, s_suppkey % 4 AS b FROM supplier)
SELECT id, 1 AS line_no, '省级' || a::VARCHAR || '等奖 加 ' || b::VARCHAR || '.5分' AS quote, '省级' || a::VARCHAR || '等奖' AS level_text, (b + 0.5)::DOUBLE AS score FROM t WHERE a BETWEEN 1 AND 4
UNION ALL SELECT id, 3, '校赛二等 计5 分', '校赛二等', 5.0::DOUBLE FROM t WHERE b = 1""")
def line_rules(spark, d):
    """Rules read from lines by pattern."""
    k = F.col("s_suppkey")
    text = F.concat(F.lit("标题\n 省级"), (k % 7).cast("string"), F.lit("等奖 加 "), (k % 4).cast("string"), F.lit(".5分 \r\n没有分数的一等奖\n"), F.when(k % 4 == 1, "校赛二等 计5 分").otherwise("校赛二等 计500 分"))
    return W.line_rules(table(spark, d, "supplier").select(k.alias("id"), text.alias("text")), "id", "text")
