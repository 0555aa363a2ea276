"""The full ledger over orders as claims of customers, with SQL twins written from the rules of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import ledger as G
from assayer.operators import backtest as B
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: rule_id, academic_year, college, category, level, synonyms, score, cap, team_factor_pct, grp, require_catalog, priority, exclusive_with, located
_RULES = [
    ("r01", "1996-1997", None, "1-URGENT", "省级一等奖", ["省一", "First"], 9, 8, 50, "g1", None, 1, ["g2"], True),
    ("r02", "1996", None, "1-URGENT", "省级二等奖", ["省二"], 6, None, 50, "g1", None, 1, None, True),
    ("r03", "1996-1997", None, "2-HIGH", "国家级一等奖", ["国一", "省一"], 12, 10, 80, "g2", "list A", 0, ["g3"], True),
    ("r04", "1996-1997", None, "2-HIGH", "校级一等奖", None, 3, None, 100, "g3", None, 0, None, False),
    ("r05", "1996-1997", None, "3-MEDIUM", "三好学生", ["good"], 4, 5, 0, "g4", None, 2, ["g4", "g9"], True),
    ("r06", "1995-1996", None, "4-NOT SPECIFIED", "校级二等奖", ["校 二"], 2, None, 100, "g5", None, 0, None, True),
    ("r07", "1996-1997", None, "3-MEDIUM", "优秀奖", None, 4, None, 100, "g4", None, 2, None, True),
    ("r08", "1996-1997", None, "5-LOW", "市级一等奖", ["市一"], 5, None, 50, "g6", None, 0, ["g5"], True),
]
_SCHEMA = "rule_id string, academic_year string, college string, category string, level string, synonyms array<string>, score long, cap long, team_factor_pct long, grp string, require_catalog string, priority long, exclusive_with array<string>, located boolean"
_LEVELS = ["省级一等奖", "省 一", "国家级一等奖", "国一", "校级一等奖", None, "三好学生", "good", "校二", "市级一等奖", "优秀奖", "nothing"]
_RAWS = [None, "省级二等奖", "none", "校级二等奖"]


def _claims(spark, d):
    pick = lambda items, at: F.element_at(F.array(*[F.lit(x) for x in items]), (at % len(items) + 1).cast("int"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        o.alias("claim_id"), c.alias("student_id"), F.when(o % 11 == 0, "1995").when(o % 13 > 0, "1996-1997").alias("academic_year"), F.lit(None).cast("string").alias("college"),
        F.col("o_orderpriority").alias("category_asked"), pick(_LEVELS, o + F.floor(o / 7)).alias("level_asked"), pick(_RAWS, o + c).alias("raw_level"),
        (F.col("o_orderstatus") == "P").alias("team"), (o % 3 > 0).alias("catalog_listed"),
    )


def _rules(spark):
    return spark.createDataFrame(_RULES, _SCHEMA)


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(map(_sql, v)) + "]" if isinstance(v, list) else str(v)


_NORM = r"regexp_replace(lower({}), '[\s　·•、,，。;；()（）\[\]【】\-—_/]+', '', 'g')"
_YEAR = "CASE WHEN length({0}) = 4 THEN {0} || '-' || ({0}::INT + 1)::VARCHAR ELSE {0} END"
_BASE = f"""rules(rule_id, rule_year, college, category, level, synonyms, points, cap, factor, grp, catalog, priority, excl, located) AS (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in _RULES)}),
claims AS (SELECT o_orderkey AS claim_id, o_custkey AS student_id, CASE WHEN o_orderkey % 11 = 0 THEN '1995' WHEN o_orderkey % 13 > 0 THEN '1996-1997' END AS year, o_orderpriority AS category,
  ({_sql(_LEVELS)})[(o_orderkey + o_orderkey // 7) % {len(_LEVELS)} + 1] AS level, ({_sql(_RAWS)})[(o_orderkey + o_custkey) % {len(_RAWS)} + 1] AS raw, o_orderstatus = 'P' AS team, o_orderkey % 3 > 0 AS listed FROM orders),
spellings AS (SELECT rule_id, level, priority, points, unnest(list_distinct(list_prepend(level, coalesce(synonyms, []::VARCHAR[])))) AS s FROM rules),
keys AS (SELECT {_NORM.format('s')} AS key, arg_min(rule_id, (-priority, -points, rule_id)) AS rule_id, arg_min(s = level, (-priority, -points, rule_id)) AS exact FROM spellings GROUP BY 1),
cats AS (SELECT {_NORM.format('category')} AS key, arg_min(rule_id, (-priority, -points, rule_id)) AS rule_id FROM rules GROUP BY 1),
hit AS (SELECT c.*, coalesce(k.rule_id, t.rule_id, g.rule_id) AS rid, CASE WHEN k.exact THEN 1.0::DOUBLE WHEN k.rule_id IS NOT NULL THEN 0.95::DOUBLE WHEN t.rule_id IS NOT NULL THEN 0.9::DOUBLE WHEN g.rule_id IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS conf
  FROM claims c LEFT JOIN keys k ON k.key = {_NORM.format('c.level')} LEFT JOIN keys t ON t.key = {_NORM.format('c.raw')} LEFT JOIN cats g ON g.key = {_NORM.format('c.category')}),
judged AS (SELECT h.*, r.*, CASE WHEN rid IS NULL THEN 'unmatched' WHEN year IS NOT NULL AND {_YEAR.format('year')} <> {_YEAR.format('rule_year')} THEN 'year' WHEN catalog IS NOT NULL AND NOT listed THEN 'catalog' WHEN conf < 0.8 THEN 'review' ELSE 'checked' END AS st,
  CASE WHEN team THEN points * factor ELSE points * 100 END AS whole FROM hit h LEFT JOIN rules r ON h.rid = r.rule_id),
lines AS (SELECT claim_id, student_id, rid AS rule_id, CASE WHEN st IN ('checked', 'review') THEN grp END AS grp, CASE WHEN st IN ('checked', 'review') THEN least(whole, coalesce(cap * 100, whole)) ELSE 0 END AS score,
  CASE WHEN st IN ('checked', 'review') THEN conf ELSE 0 END AS confidence, st, coalesce(points * 100, 0) AS raw_score, located, CASE WHEN st IN ('checked', 'review') THEN concat_ws(';', CASE WHEN conf = 0.9 THEN 'level from text' END, CASE WHEN conf = 0.6 THEN 'by category' END, CASE WHEN whole > cap * 100 THEN 'cap' END, CASE WHEN team AND factor <> 100 THEN 'team' END, CASE WHEN conf < 0.8 THEN 'review' END) WHEN st = 'unmatched' THEN 'no rule' ELSE st END AS note FROM judged),
best AS (SELECT *, CASE WHEN st = 'checked' THEN row_number() OVER (PARTITION BY student_id, grp, st = 'checked' ORDER BY score DESC, confidence DESC, rule_id, claim_id) END AS place FROM lines),
wins AS (SELECT student_id, max(CASE WHEN grp = 'g1' THEN score END) AS s1, max(CASE WHEN grp = 'g2' THEN score END) AS s2, max(CASE WHEN grp = 'g3' THEN score END) AS s3, max(CASE WHEN grp = 'g5' THEN score END) AS s5, max(CASE WHEN grp = 'g6' THEN score END) AS s6 FROM best WHERE place = 1 GROUP BY 1),
gone AS (
  SELECT student_id, 'g2' AS grp FROM wins WHERE s2 IS NOT NULL AND (s1 IS NOT NULL OR s3 IS NOT NULL) AND (coalesce(s1, 0) + coalesce(s3, 0) > s2 OR coalesce(s1, 0) + coalesce(s3, 0) = s2 AND (greatest(coalesce(s1, 0), coalesce(s3, 0)) = s2 AND s1 IS NOT NULL))
  UNION ALL SELECT student_id, 'g1' FROM wins WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND NOT (s1 + coalesce(s3, 0) > s2 OR s1 + coalesce(s3, 0) = s2 AND greatest(s1, coalesce(s3, 0)) = s2)
  UNION ALL SELECT student_id, 'g3' FROM wins WHERE s3 IS NOT NULL AND s2 IS NOT NULL AND NOT (coalesce(s1, 0) + s3 > s2 OR coalesce(s1, 0) + s3 = s2 AND greatest(coalesce(s1, 0), s3) = s2 AND s1 IS NOT NULL)
  UNION ALL SELECT student_id, CASE WHEN s5 >= s6 THEN 'g6' ELSE 'g5' END FROM wins WHERE s5 IS NOT NULL AND s6 IS NOT NULL),
final AS (SELECT b.*, coalesce(place = 1, false) AND g.grp IS NULL AS counted, concat_ws(';', nullif(note, ''), CASE WHEN place > 1 THEN 'beaten in group' END, CASE WHEN st = 'checked' AND g.grp IS NOT NULL THEN 'excluded group' END) AS reason
  FROM best b LEFT JOIN gone g ON b.student_id = g.student_id AND b.grp = g.grp)"""


def _decided(spark, d):
    rules = _rules(spark)
    return G.decide(G.lines(G.match(_claims(spark, d), rules)), rules)


@_query("claim_ledger", f"WITH {_BASE} SELECT claim_id, student_id, rule_id, grp, score::BIGINT AS score, confidence, CASE WHEN st IN ('year', 'catalog') THEN 'rejected' ELSE st END AS status, counted, reason FROM final")
def claim_ledger(spark, d):
    """One line for every claim: its rule, score, confidence, whether it counts and why."""
    return _decided(spark, d).select("claim_id", "student_id", "rule_id", "grp", "score", "confidence", "status", "counted", "reason")


_CAPS = "caps AS (SELECT grp, max(cap) * 100 AS cap FROM rules GROUP BY grp)"
_TOTALS = f"""{_BASE}, {_CAPS}, sums AS (SELECT student_id, f.grp, max(score) FILTER (counted) AS best, count(*) FILTER (st = 'checked') AS n, any_value(cap) AS cap FROM final f LEFT JOIN caps c ON f.grp = c.grp GROUP BY 1, 2),
totals AS (SELECT student_id, coalesce(sum(least(best, coalesce(cap, best))), 0)::BIGINT AS total, count(*) FILTER (n > 0) AS groups FROM sums GROUP BY 1),
ids AS (SELECT student_id, coalesce(string_agg(DISTINCT claim_id::VARCHAR, ',' ORDER BY claim_id::VARCHAR) FILTER (st IN ('unmatched', 'year', 'catalog')), '') AS unmatched, coalesce(string_agg(DISTINCT claim_id::VARCHAR, ',' ORDER BY claim_id::VARCHAR) FILTER (st = 'review'), '') AS review FROM final GROUP BY 1)"""


def _student_totals(spark, d):
    return G.totals(_decided(spark, d), _rules(spark))


@_query("student_totals", f"WITH {_TOTALS} SELECT t.student_id, total, groups, unmatched, review FROM totals t JOIN ids i ON t.student_id = i.student_id")
def student_totals(spark, d):
    ids = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",").alias(c)
    return _student_totals(spark, d).select("student_id", "total", "groups", ids("unmatched"), ids("review"))


@_query("ledger_gate", f"""WITH {_BASE}, faults AS (SELECT student_id, claim_id, confidence, CASE WHEN NOT located THEN 'source_locator' END AS fault FROM final WHERE counted),
found AS (SELECT student_id, min(confidence) AS least, coalesce(string_agg(claim_id::VARCHAR || ':' || fault, ',' ORDER BY claim_id::VARCHAR || ':' || fault) FILTER (fault IS NOT NULL), '') AS u FROM faults GROUP BY 1)
SELECT s.student_id, CASE WHEN least IS NULL OR u <> '' THEN 'refuse' WHEN least < 1 THEN 'manual_review' ELSE 'auto_score' END AS disposition, coalesce(u, 'counted_matches') AS unsupported FROM (SELECT DISTINCT student_id FROM claims) s LEFT JOIN found f ON s.student_id = f.student_id""")
def ledger_gate(spark, d):
    """May a student's total be given out: every counted line cites its rule precisely."""
    return G.gate(_decided(spark, d), _rules(spark))


@_query("routed", f"""WITH {_BASE} SELECT claim_id, CASE WHEN rid IS NULL THEN 'refuse' WHEN NOT located THEN 'refuse' WHEN conf >= 0.9 THEN 'auto_score' ELSE 'manual_review' END AS disposition, rid IS NOT NULL AND located AS matched FROM judged""")
def routed(spark, d):
    """Each claim alone: scored by itself, sent to a person, or refused for want of a rule that can be cited."""
    rules = _rules(spark)
    m = G.match(_claims(spark, d), rules).select("claim_id", F.col("rule")["rule_id"].alias("rule_id"), "how")
    known = m.join(rules.select("rule_id", "located"), "rule_id", "left")
    sure = F.col("how").isin("exact_level", "synonym", "raw_text")
    located = F.coalesce("located", F.lit(False))
    return known.select("claim_id", F.when(~located, "refuse").when(sure, "auto_score").otherwise("manual_review").alias("disposition"), located.alias("matched"))


_TRUTH = "truth AS (SELECT c_custkey AS student_id, (c_custkey % 40) * 100 + CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE 0 END AS expected FROM customer WHERE c_custkey % 4 <> 3)"


def _expected(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").where("c_custkey % 4 <> 3").select(c.alias("student_id"), ((c % 40) * 100 + F.when(c % 5 == 0, 30).otherwise(0)).alias("expected"))


@_query("backtest_students", f"""WITH {_TOTALS}, {_TRUTH} SELECT student_id, expected, coalesce(total, 0) AS actual, (coalesce(total, 0) - expected)::BIGINT AS delta, CASE WHEN expected IS NULL THEN 'extra_student' WHEN total IS NULL THEN 'missing_student' WHEN total = expected THEN 'exact' WHEN abs(total - expected) <= 50 THEN 'within' ELSE 'off' END AS band,
  CASE WHEN expected IS NULL THEN NULL WHEN total IS NULL THEN 'missing_student' WHEN abs(total - expected) <= 1 THEN NULL WHEN unmatched <> '' THEN 'unmatched_rule' WHEN review <> '' THEN 'manual_review' ELSE 'total_mismatch' END AS explained
FROM truth FULL JOIN (SELECT t.*, unmatched, review FROM totals t JOIN ids i ON t.student_id = i.student_id) USING (student_id)""")
def backtest_students(spark, d):
    return B.compare_students(_student_totals(spark, d), _expected(spark, d))


@_query("backtest_report", f"""WITH {_TOTALS}, {_TRUTH}, j AS (SELECT expected, coalesce(total, 0) AS actual, total IS NOT NULL AS found FROM truth LEFT JOIN totals USING (student_id))
SELECT count(*) AS students, count(*) FILTER (found) AS found, count(*) FILTER (actual = expected) AS exact, count(*) FILTER (abs(actual - expected) <= 50) AS within, round(avg(abs(actual - expected) / 100), 4) AS mean_error, (max(abs(actual - expected)) / 100)::DOUBLE AS max_error FROM j""")
def backtest_report(spark, d):
    return B.report(B.compare_students(_student_totals(spark, d), _expected(spark, d)))


@_query("backtest_items", f"""WITH {_BASE}, {_CAPS}, want AS (SELECT o_orderkey AS claim_id, o_custkey AS student_id, (o_orderkey % 9) * 100 AS expected, CASE WHEN o_orderkey % 2 = 0 THEN 'data' END AS attribution FROM orders WHERE o_orderkey % 10 < 7 UNION ALL SELECT -c_custkey, c_custkey, 100, NULL FROM customer WHERE c_custkey % 50 = 0),
got AS (SELECT f.*, CASE WHEN counted THEN least(score, coalesce(c.cap, score)) ELSE 0 END AS actual FROM final f LEFT JOIN caps c ON f.grp = c.grp)
SELECT coalesce(w.student_id, g.student_id) AS student_id, coalesce(w.claim_id, g.claim_id) AS claim_id, expected::BIGINT AS expected, coalesce(actual, 0)::BIGINT AS actual,
  CASE WHEN w.claim_id IS NULL THEN 'missing_reference_item' WHEN g.claim_id IS NULL THEN 'missing_claim' WHEN actual = expected THEN 'matched' WHEN st IN ('unmatched') THEN 'unmatched_rule' WHEN st = 'review' THEN 'manual_review' WHEN NOT counted THEN 'dedup_or_exclusive' ELSE 'score_mismatch' END AS kind, attribution
FROM want w FULL JOIN got g ON w.claim_id = g.claim_id AND w.student_id = g.student_id""")
def backtest_items(spark, d):
    return B.compare_items(_decided(spark, d), _wanted(spark, d), _rules(spark))


def _wanted(spark, d):
    o = F.col("o_orderkey")
    rows = table(spark, d, "orders").where("o_orderkey % 10 < 7").select(o.alias("claim_id"), F.col("o_custkey").alias("student_id"), (o % 9 * 100).alias("expected"), F.when(o % 2 == 0, "data").alias("attribution"))
    c = F.col("c_custkey")
    return rows.unionByName(table(spark, d, "customer").where("c_custkey % 50 = 0").select((-c).alias("claim_id"), c.alias("student_id"), F.lit(100).cast("long").alias("expected"), F.lit(None).cast("string").alias("attribution")))


@_query("error_distribution", "SELECT kind, coalesce(attribution, '未归因') AS attribution, count(*) AS n FROM (" + ORACLES["backtest_items"] + ") WHERE kind <> 'matched' GROUP BY 1, 2")
def error_distribution(spark, d):
    items = B.compare_items(_decided(spark, d), _wanted(spark, d), _rules(spark))
    return items.where("kind <> 'matched'").groupBy("kind", F.coalesce("attribution", F.lit("未归因")).alias("attribution")).agg(F.count(F.lit(1)).alias("n"))


@_query("item_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN trim(l_returnflag, ' ') = 'R' THEN 'R' WHEN l_linestatus = 'O' THEN 'row:' || l_linenumber::VARCHAR ELSE l_orderkey::VARCHAR END AS item_key FROM lineitem")
def item_keys(spark, d):
    rows = table(spark, d, "lineitem")
    key = B.item_key(F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).otherwise(" "), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")), F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", key.alias("item_key"))


@_query("college_scope", """WITH r(rid, nation, score) AS (VALUES ('r1', NULL, 10), ('r2', 3, 12), ('r3', 7, 9), ('r4', 3, 11)) SELECT s_suppkey, arg_min(rid, (-score, rid)) AS rule_id, count(*) AS fits FROM supplier JOIN r ON nation IS NULL OR nation = s_nationkey GROUP BY 1""")
def college_scope(spark, d):
    """The best rule for each scope; a rule without one fits every scope: each row is looked up under its scope and under the common key."""
    rules = spark.createDataFrame([("r1", None, 10), ("r2", 3, 12), ("r3", 7, 9), ("r4", 3, 11)], "rid string, nation int, score long")
    keyed = rules.select("rid", "score", F.coalesce(F.col("nation").cast("string"), F.lit("*")).alias("scope"))
    asked = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(F.col("s_nationkey").cast("string"), F.lit("*"))).alias("scope"))
    best = F.min(F.struct((-F.col("score")).alias("s"), "rid"))["rid"]
    return asked.join(keyed, "scope").groupBy("s_suppkey").agg(best.alias("rule_id"), F.count(F.lit(1)).alias("fits"))
