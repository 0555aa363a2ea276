"""Levels, years, numbers and keys: award texts made up from customers and orders, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import levels as L
from assayer.functions import text as T
from assayer.operators.lookup import rules_for
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_HEADS = ["", "校", "省部级", "全国", "2024年 市赛", "国际", "学院级（", "奇怪", "省 政府奖学金", "国家励志奖学金", "班"]
_TAILS = ["二等奖", "亚军金牌", "第四名", " 一 等 奖", "", "4等", "优胜奖", "软件著作权一项", "第二名三等", "特等・奖", "三好学生", "没有名次"]
_LIST = lambda items: "[" + ", ".join("'" + i + "'" for i in items) + "]"
_VALUES = lambda pairs: "(VALUES " + ", ".join(f"({k}, '{a}', '{n}')" for k, (a, n) in enumerate(pairs)) + ")"
_RAWS = f"raws AS (SELECT c_custkey AS id, ({_LIST(_HEADS)})[c_custkey % {len(_HEADS)} + 1] || ({_LIST(_TAILS)})[c_custkey // 3 % {len(_TAILS)} + 1] AS raw FROM customer)"
_NOISE = T.NOISE.replace("'", "''")


def _raws(spark, d):
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at % len(items) + 1).cast("int"))
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), F.concat(pick(_HEADS, key), pick(_TAILS, F.floor(key / 3))).alias("raw"))


def _held(column: str, pairs, name: str) -> str:
    return f"{name} AS (SELECT id, arg_min(n, (-length(a), k)) AS v FROM cleaned, {_VALUES(pairs)} t(k, a, n) WHERE contains({column}, a) GROUP BY id)"


_CLEANED = f"{_RAWS}, cleaned AS (SELECT id, raw, regexp_replace(translate(raw, '・（', '・('), '{_NOISE}', '', 'g') AS t FROM raws)"
_DIGIT = "translate({}, '一二三四', '1234') || '等奖'"
_PARTS = f"""{_CLEANED}, {_held('t', L.TIERS, 'tiers')}, {_held('t', L.PRIZES, 'prizes')},
specials AS (SELECT id, arg_min(s, k) AS s FROM cleaned, (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate(L.SPECIAL))}) x(k, s) WHERE contains(t, s) GROUP BY id),
parts AS (SELECT c.id, raw, t, i.v AS tier, s.s AS special,
  coalesce(p.v, CASE WHEN regexp_matches(t, '第[一二三四1-4]名') THEN {_DIGIT.format("regexp_extract(t, '第([一二三四1-4])名', 1)")}
    WHEN regexp_matches(t, '[一二三四1-4]等') THEN {_DIGIT.format("regexp_extract(t, '([一二三四1-4])等', 1)")} END) AS prize
  FROM cleaned c LEFT JOIN tiers i ON c.id = i.id LEFT JOIN prizes p ON c.id = p.id LEFT JOIN specials s ON c.id = s.id)"""


@_query("tier_prize", f"WITH {_PARTS} SELECT id, tier, prize FROM parts")
def tier_prize(spark, d):
    r = _raws(spark, d).select("id", L.cleaned(F.col("raw")).alias("t"))
    return r.select("id", L.tier_of(F.col("t")).alias("tier"), L.prize_of(F.col("t")).alias("prize"))


_LEVELS = f"""{_PARTS}, levels AS (SELECT id, raw, CASE WHEN t = '' THEN '' WHEN special IS NOT NULL THEN special WHEN tier IS NULL AND prize IS NULL THEN t ELSE coalesce(tier, '') || coalesce(prize, '') END AS canonical,
  CASE WHEN t = '' THEN NULL WHEN special IS NOT NULL THEN coalesce(tier, CASE WHEN contains(t, '国家') THEN '国家级' END) ELSE tier END AS tier,
  CASE WHEN special IS NULL AND t <> '' THEN prize END AS prize, t <> '' AND (special IS NOT NULL OR tier IS NOT NULL OR prize IS NOT NULL) AS matched,
  CASE WHEN t = '' THEN 'unchanged' WHEN special IS NOT NULL THEN 'special' WHEN tier IS NULL AND prize IS NULL THEN 'unchanged' ELSE 'alias' END AS rule FROM parts)"""


@_query("normalize_level", f"WITH {_LEVELS} SELECT id, canonical, tier, prize, matched, rule FROM levels")
def normalize_level(spark, d):
    r = _raws(spark, d).select("id", L.cleaned(F.col("raw")).alias("t"))
    return r.select("id", L.level_of(F.col("t")).alias("l")).select("id", "l.*")


@_query("level_extra_aliases", f"""WITH {_LEVELS}, extra AS (SELECT id, CASE WHEN contains(t, '奇怪没有名次') THEN '省级一等奖' WHEN contains(t, '奇怪') THEN '校级优秀奖' END AS target FROM cleaned)
SELECT l.id, coalesce(target, canonical) AS canonical, CASE WHEN target IS NOT NULL THEN 'alias' ELSE rule END AS rule FROM levels l JOIN extra e ON l.id = e.id""")
def level_extra_aliases(spark, d):
    """Injected aliases go before everything else, the longest first."""
    r = _raws(spark, d).select("id", L.cleaned(F.col("raw")).alias("t"))
    found = L.level_of(F.col("t"), [("奇怪", "校级优秀奖"), ("奇怪-没有名次", "省级一等奖")])
    return r.select("id", found.alias("l")).select("id", "l.canonical", "l.rule")


@_query("level_aliases", f"""WITH t AS (SELECT * FROM {_VALUES(L.TIERS)} x(k, a, n)), p AS (SELECT * FROM {_VALUES(L.PRIZES)} x(k, a, n)),
wanted AS (SELECT DISTINCT t.n || p.n AS level, t.n AS tn, p.n AS pn FROM t, p),
spelt AS (SELECT level, t.a || p.a AS alias FROM wanted JOIN t ON t.n = tn JOIN p ON p.n = pn UNION SELECT level, level FROM wanted)
SELECT level, string_agg(alias, ',' ORDER BY length(alias), alias) AS aliases FROM spelt GROUP BY level""")
def level_aliases(spark, d):
    tiers, prizes = sorted({n for _, n in L.TIERS}), sorted({n for _, n in L.PRIZES})
    levels = spark.createDataFrame([(t + p,) for t in tiers for p in prizes], "level string")
    return levels.select("level", F.array_join(L.level_aliases(F.col("level")), ",").alias("aliases"))


_TOPICS = ["学科竞赛奖", "学术", "志愿服务时长", "科技竞赛论文", " 其他 ", "", "荣誉", "社会 实践", "Sport"]


@_query("normalize_category", f"""WITH raws AS (SELECT c_custkey AS id, ({_LIST(_TOPICS)})[c_custkey % {len(_TOPICS)} + 1] AS raw FROM customer), cleaned AS (SELECT id, raw, regexp_replace(raw, '{_NOISE}', '', 'g') AS t FROM raws),
{_held('t', L.CATEGORIES, 'found')} SELECT c.id, coalesce(v, nullif(trim(raw, ' '), ''), '未分类') AS category FROM cleaned c LEFT JOIN found f ON c.id = f.id""")
def normalize_category(spark, d):
    key = F.col("c_custkey")
    r = table(spark, d, "customer").select(key.alias("id"), F.element_at(F.array(*map(F.lit, _TOPICS)), (key % len(_TOPICS) + 1).cast("int")).alias("raw"))
    return r.select("id", "raw", L.cleaned(F.col("raw")).alias("t")).select("id", L.category_of(F.col("raw"), F.col("t")).alias("category"))


_SPACED = "a b · C、(d)【e】　 f—g_h/ "


@_query("norm_key_unicode", f"SELECT s_suppkey AS id, regexp_replace(lower('{_SPACED}' || s_name), '{_NOISE}', '', 'g') AS key FROM supplier")
def norm_key_unicode(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.norm_key(F.concat(F.lit(_SPACED), "s_name")).alias("key"))


_QUOTES = ["省级一等奖加 8 分，二等奖6分", "计10.5分；另加 3", "加120分不计", "十五分或二十分", "一百分，百分", "无", "第3条 2.分 .5分 7分", "两分，加2分，零分", "二百三分"]


@_query("score_candidates", f"""WITH q AS (SELECT s_suppkey AS id, ({_LIST(_QUOTES)})[s_suppkey % {len(_QUOTES)} + 1] AS x FROM supplier),
found AS (SELECT id, x, list_concat(list_concat(regexp_extract_all(x, '(\\d+(?:\\.\\d+)?)\\s*分', 1), regexp_extract_all(x, '加\\s*(\\d+(?:\\.\\d+)?)\\s*分', 1)), list_concat(regexp_extract_all(x, '计\\s*(\\d+(?:\\.\\d+)?)\\s*分', 1), regexp_extract_all(x, '加\\s*(\\d+(?:\\.\\d+)?)', 1))) AS v FROM q),
flat AS (SELECT id, unnest(v)::DOUBLE AS v, generate_subscripts(v, 1) AS k FROM found),
firsts AS (SELECT id, v, min(k) AS k FROM flat WHERE v > 0 AND v <= 100 GROUP BY id, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM firsts)
SELECT q.id, coalesce(string_agg(v::VARCHAR, ',' ORDER BY r) FILTER (r <= 5), '') AS candidates FROM q LEFT JOIN ranked r ON q.id = r.id GROUP BY q.id""".replace("\\\\", "\\"))
def score_candidates(spark, d):
    key = F.col("s_suppkey")
    x = F.element_at(F.array(*map(F.lit, _QUOTES)), (key % len(_QUOTES) + 1).cast("int"))
    return table(spark, d, "supplier").select(key.alias("id"), F.array_join(T.score_candidates(x).cast("array<string>"), ",").alias("candidates"))


_POINTS = [[8.0, 6.0], [10.5], [120.0], [15.0, 20.0], [100.0, 100.0], [], [7.0], [2.0, 2.0, 0.0], []]  # by hand from the texts


@_query("points_in_text", f"""WITH h(k, v) AS (VALUES {', '.join(f"({k}, {'[' + ', '.join(f'{v}::DOUBLE' for v in vs) + ']::DOUBLE[]'})" for k, vs in enumerate(_POINTS))})
SELECT s_suppkey AS id, list_contains(v, (s_suppkey % 25)::DOUBLE) AS occurs, len(list_distinct(v))::INTEGER AS n FROM supplier JOIN h ON s_suppkey % {len(_QUOTES)} = k""")
def points_in_text(spark, d):
    """Whether a score stands in its quote, in digits or written out."""
    key = F.col("s_suppkey")
    points = T.points_in(F.element_at(F.array(*map(F.lit, _QUOTES)), (key % len(_QUOTES) + 1).cast("int")))
    return table(spark, d, "supplier").select(key.alias("id"), F.array_contains(points, (key % 25).cast("double")).alias("occurs"), F.size(points).alias("n"))


_DATES = ["{y}-{m}-{d}", "{y}年{m}月{d}日", "{y}/{m}/{d}", "{y}.{m}.{d}", "on {y}", "{y}-13-01", "{y}-02-30", " {y}-{m}-{d} "]


@_query("parse_dates", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders)
SELECT id, CASE WHEN k IN (0, 1, 2, 3, 7) THEN make_date(y, m, dd)::VARCHAR END AS day, CASE WHEN k IN (0, 1, 2, 3, 7) THEN (y - (m < 9)::INT)::VARCHAR || '-' || (y - (m < 9)::INT + 1)::VARCHAR END AS academic_year FROM o""")
def parse_dates(spark, d):
    day = F.col("o_orderdate")
    shown = F.element_at(F.array(*map(F.lit, _DATES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    for mark, part in (("{y}", F.year(day)), ("{m}", F.month(day)), ("{d}", F.day(day))):
        shown = F.replace(shown, F.lit(mark), part.cast("string"))
    found = T.parse_date(shown)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), found.cast("string").alias("day"), T.year_span(T.academic_year_of(found)).alias("academic_year"))


_KEY = b"public test key"
_HMAC = "substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(c_custkey::VARCHAR)))), 1, 24)".format(
    **{name: bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}
)


@_query("pseudonyms", f"SELECT c_custkey, {_HMAC} AS subject FROM customer")
def pseudonyms(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.pseudonym(F.col("c_custkey").cast("string"), _KEY).alias("subject"))


@_query("model_tiers", """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'vision' WHEN contains(lower(p_type || p_name), 'pro') OR contains(lower(p_type || p_name), 'max') OR contains(lower(p_type || p_name), 'reasoner') THEN 'strong'
 WHEN contains(lower(p_type || p_name), 'flash') OR contains(lower(p_type || p_name), 'chat') OR contains(lower(p_type || p_name), 'lite') THEN 'light' ELSE 'unknown' END AS tier FROM part""")
def model_tiers(spark, d):
    return table(spark, d, "part").select("p_partkey", T.model_tier(F.concat("p_type", "p_name"), F.col("p_size") == 1).alias("tier"))


@_query("answer_numbers", """WITH a AS (SELECT o_orderkey, 'total ' || (o_orderkey % 50)::VARCHAR || ' of ' || (o_custkey % 7)::VARCHAR || ', cap ' || (o_orderkey % 3)::VARCHAR || '.5 ok' AS answer, 'rule ' || (o_custkey % 50)::VARCHAR || ' and ' || (o_orderkey % 7)::VARCHAR AS clause FROM orders),
held AS (SELECT *, regexp_extract_all(answer, '[0-9.]+') AS said, regexp_extract_all(clause, '[0-9.]+') AS known FROM a)
SELECT o_orderkey, array_to_string(list_filter(said, lambda v, i: NOT list_contains(known, v) AND list_position(said, v) = i), ',') AS unsupported FROM held""")
def answer_numbers(spark, d):
    """Numbers of an answer that its cited clause doesn't hold."""
    s = lambda c: c.cast("string")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    answer = F.concat(F.lit("total "), s(o % 50), F.lit(" of "), s(c % 7), F.lit(", cap "), s(o % 3), F.lit(".5 ok"))
    clause = F.concat(F.lit("rule "), s(c % 50), F.lit(" and "), s(o % 7))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.numbers_unsupported(answer, F.array(clause)), ",").alias("unsupported"))


@_query("redacted", "SELECT c_custkey, replace(replace('see ' || c_name || ' and ' || c_custkey::VARCHAR || ' twice ' || c_name, c_name, '<student>'), c_custkey::VARCHAR, '<student>') AS shown FROM customer")
def redacted(spark, d):
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("see "), "c_name", F.lit(" and "), key, F.lit(" twice "), "c_name")
    return table(spark, d, "customer").select("c_custkey", T.redact(text, F.array("c_name", key, F.lit(None), F.lit("")), "<student>").alias("shown"))


@_query("fragments_in_order", """SELECT doc_id, strpos(text, 'the') > 0 AND strpos(substr(text, strpos(text, 'the') + 3), 'of') > 0 AND strpos(substr(substr(text, strpos(text, 'the') + 3), strpos(substr(text, strpos(text, 'the') + 3), 'of') + 2), 'the') > 0 AS ordered FROM documents""")
def fragments_in_order(spark, d):
    return table(spark, d, "documents").select("doc_id", T.in_order(F.col("text"), F.array(F.lit("the"), F.lit("of"), F.lit("the"))).alias("ordered"))


_TERMS = [("licence", ["license", "permission"]), ("of the", ["and the", "to the"]), ("Que", ["para", "del"])]


@_query("query_rewrite", """SELECT item_id, md5(concat_ws(' ', trim(text, ' '), CASE WHEN NOT contains(lower(text), 'licence') AND (contains(lower(text), 'license') OR contains(lower(text), 'permission')) THEN 'licence' END,
  CASE WHEN NOT contains(lower(text), 'of the') AND (contains(lower(text), 'and the') OR contains(lower(text), 'to the')) THEN 'of the' END,
  CASE WHEN NOT contains(lower(text), 'que') AND (contains(lower(text), 'para') OR contains(lower(text), 'del')) THEN 'Que' END)) AS query_md5 FROM benchmark""")
def query_rewrite(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(T.rewrite_query(F.col("text"), _TERMS)).alias("query_md5"))


_RULES = [("r1", "2024-2025", None, "省级二等奖", "第一", 6, 1), ("r2", "2024-2025", "MACHINERY", "省级二等奖", None, 7, 1), ("r3", "2023", None, "校级一等奖", None, 3, 0), ("r4", "2024-2025", None, "国家级一等奖", "第一", 12, 0), ("r5", "2024-2025", None, "省级二等奖", None, 5, 9)]
_RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _RULES) + ") r(rid, year, college, level, rank, score, priority)"


@_query("rule_lookup", f"""WITH {_LEVELS}, c AS (SELECT c_custkey AS id, c_mktsegment AS college, CASE WHEN c_custkey % 2 = 0 THEN '第一' END AS rank FROM customer),
hits AS (SELECT l.id, r.rid, r.score, row_number() OVER (PARTITION BY l.id ORDER BY r.priority DESC, r.score DESC, r.rid) AS k FROM levels l JOIN c ON l.id = c.id JOIN {_RULES_SQL}
  ON r.level = l.canonical AND r.year = '2024-2025' AND (r.college IS NULL OR r.college = c.college) AND (c.rank IS NULL OR r.rank = c.rank))
SELECT id, rid AS rule_id, score::BIGINT AS score, k::INTEGER AS position FROM hits""")
def rule_lookup(spark, d):
    """All rules of a level, year and college (null in the rule: any; null rank asked: any), in rule order."""
    rules = spark.createDataFrame(_RULES, "rid string, year string, college string, level string, rank string, score long, priority long")
    clean = _raws(spark, d).select("id", L.cleaned(F.col("raw")).alias("t"))
    asked = clean.select("id", L.level_of(F.col("t"))["canonical"].alias("level")).join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("college"), F.when(F.col("c_custkey") % 2 == 0, "第一").alias("rank")), "id"
    )
    found = rules_for(asked.withColumn("year", F.lit("2024-2025")), rules, "id", "rid")
    return found.select("id", F.col("rid").alias("rule_id"), "score", "position")
