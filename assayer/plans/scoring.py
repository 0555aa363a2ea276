"""Scoring queries: orders stand for claims, customers for students."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions.text import norm_key
from assayer.operators.scoring import best_independent, capped, cascade, item_score, take_max
from assayer.session import table

#: group, team factor in percent, item cap, group cap (points; null: none).
_RULES = [("1-URGENT", 50, 300, 250), ("2-HIGH", 80, None, 200), ("3-MEDIUM", 0, 250, None), ("4-NOT SPECIFIED", 100, 120, 400), ("5-LOW", 50, None, None)]
_RULES_SQL = "(VALUES ('1-URGENT', 50, 300, 250), ('2-HIGH', 80, NULL, 200), ('3-MEDIUM', 0, 250, NULL), ('4-NOT SPECIFIED', 100, 120, 400), ('5-LOW', 50, NULL, NULL)) r(grp, factor_pct, item_cap, group_cap)"


def _rules(spark):
    return spark.createDataFrame(_RULES, "grp string, factor_pct long, item_cap long, group_cap long")


def _lines(spark, d):
    claims = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("grp"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("raw"), (F.col("o_orderstatus") == "P").alias("team"),
    )
    score = item_score(F.col("raw"), F.col("team"), F.col("factor_pct"), F.col("item_cap"))
    return claims.join(_rules(spark), "grp").select("claim_id", "student_id", "grp", score.alias("score"), "group_cap")


_LINES = f"""lines AS (
  SELECT o_orderkey AS claim_id, o_custkey AS student_id, grp, group_cap, least(CASE WHEN o_orderstatus = 'P' THEN raw * factor_pct ELSE raw * 100 END, coalesce(item_cap * 100, 1000000000)) AS score
  FROM (SELECT *, CAST(floor(o_totalprice / 1000) AS BIGINT) AS raw FROM orders) o JOIN {_RULES_SQL} ON o.o_orderpriority = r.grp)"""
_WINNERS = f"WITH {_LINES}, winners AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY student_id, grp ORDER BY score DESC, claim_id) = 1)"


def score_ledger(spark, d):
    lines = _lines(spark, d)
    winners = take_max(lines, ["student_id", "grp"], [F.desc("score"), F.asc("claim_id")])
    after = winners.withColumn("after", capped(F.col("score"), F.col("group_cap") * 100))
    totals = after.groupBy("student_id").agg(F.count(F.lit(1)).alias("groups_counted"), F.sum("after").alias("total_x100"))
    counts = lines.groupBy("student_id").agg(F.count(F.lit(1)).alias("claims"))
    return totals.join(counts, "student_id").select("student_id", "groups_counted", "claims", "total_x100")


def take_max_lines(spark, d):
    winners = take_max(_lines(spark, d), ["student_id", "grp"], [F.desc("score"), F.asc("claim_id")])
    return winners.select("student_id", "grp", "claim_id", "score")


def sum_mode(spark, d):
    return _lines(spark, d).groupBy("student_id", "grp").agg(F.sum("score").alias("score"))


def group_cap(spark, d):
    """The greatest cap of each group's rules; rules without one don't count, a group without any has none."""
    rules = table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.when((F.col("p_size") % 3 > 0) & (F.col("p_brand") != "Brand#11"), F.col("p_size")).cast("long").alias("cap"))
    return rules.groupBy("grp").agg(F.max("cap").alias("group_cap"))


_PART_RULES = [("r1", "ECONOMY", None, 5, 8), ("r2", "PROMO", None, 5, 6), ("r3", "promo", None, 7, 5), ("r4", None, "Brand#1", 1, 3), ("r5", None, "Brand#2", 1, 2), ("r6", "STANDARD", "Brand#3", 2, 4)]


def match_cascade(spark, d):
    rules = spark.createDataFrame(_PART_RULES, "id string, level string, category string, priority long, score long")
    rules = rules.select("id", norm_key(F.col("level")).alias("level_key"), F.col("category"), "priority", "score")
    claims = table(spark, d, "part").select(
        F.col("p_partkey").alias("claim_id"), norm_key(F.element_at(F.split("p_type", " "), 1)).alias("level"),
        norm_key(F.element_at(F.split("p_name", " "), 1)).alias("raw"), F.substring("p_brand", 1, 7).alias("category"),
    )
    found = cascade(claims, rules, [("level", "level_key", 1.0, "exact"), ("raw", "level_key", 0.9, "raw_text"), ("category", "category", 0.6, "category")])
    # below 0.8 a claim goes to review and isn't counted
    return found.select("claim_id", "rule_id", "rule_score", "confidence", "channel", (F.col("confidence") >= 0.8).alias("counted"))


_CASCADE = """WITH rules AS (SELECT id, lower(level) AS level_key, category, priority, score FROM (VALUES ('r1','ECONOMY',NULL,5,8),('r2','PROMO',NULL,5,6),('r3','promo',NULL,7,5),('r4',NULL,'Brand#1',1,3),('r5',NULL,'Brand#2',1,2),('r6','STANDARD','Brand#3',2,4)) v(id, level, category, priority, score)),
bylevel AS (SELECT * FROM rules WHERE level_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY level_key ORDER BY priority DESC, score DESC, id) = 1),
bycat AS (SELECT * FROM rules WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY priority DESC, score DESC, id) = 1),
claims AS (SELECT p_partkey AS claim_id, regexp_replace(lower(split_part(p_type, ' ', 1)), '[\\s\\-_/,;()]+', '', 'g') AS level, regexp_replace(lower(split_part(p_name, ' ', 1)), '[\\s\\-_/,;()]+', '', 'g') AS raw, substr(p_brand, 1, 7) AS category FROM part)
SELECT claim_id, coalesce(a.id, b.id, c.id) AS rule_id, coalesce(a.score, b.score, c.score)::BIGINT AS rule_score,
  CASE WHEN a.id IS NOT NULL THEN 1.0 WHEN b.id IS NOT NULL THEN 0.9 WHEN c.id IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN a.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'raw_text' WHEN c.id IS NOT NULL THEN 'category' ELSE 'none' END AS channel,
  (a.id IS NOT NULL OR b.id IS NOT NULL) AS counted
FROM claims LEFT JOIN bylevel a ON claims.level = a.level_key LEFT JOIN bylevel b ON claims.raw = b.level_key LEFT JOIN bycat c ON claims.category = c.category"""


def exclusive_groups(spark, d):
    names = ["urgent", "high", "medium", "low"]
    keys = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    lines = _lines(spark, d)
    wide = lines.groupBy("student_id").agg(*[F.coalesce(F.max(F.when(F.col("grp") == k, F.col("score"))), F.lit(0)).alias(n) for n, k in zip(names, keys, strict=True)])
    return best_independent(wide, "student_id", names, [(0, 1), (1, 2)]).select("student_id", F.col("total").alias("total_x100"))


_EXCLUSIVE = f"""WITH {_LINES}, wide AS (SELECT student_id, coalesce(max(score) FILTER (grp = '1-URGENT'), 0) AS u, coalesce(max(score) FILTER (grp = '2-HIGH'), 0) AS h,
  coalesce(max(score) FILTER (grp = '3-MEDIUM'), 0) AS m, coalesce(max(score) FILTER (grp = '5-LOW'), 0) AS l FROM lines GROUP BY student_id)
SELECT student_id, CAST(greatest(u + m, h) + l AS BIGINT) AS total_x100 FROM wide"""

QUERIES = {
    "score_ledger": score_ledger, "take_max": take_max_lines, "sum_mode": sum_mode, "group_cap": group_cap,
    "match_cascade": match_cascade, "exclusive_mask": exclusive_groups,
}
ORACLES = {
    "score_ledger": _WINNERS + """ SELECT w.student_id, count(*)::BIGINT AS groups_counted, any_value(n)::BIGINT AS claims, sum(least(score, coalesce(group_cap * 100, 1000000000)))::BIGINT AS total_x100
      FROM winners w JOIN (SELECT student_id, count(*) AS n FROM lines GROUP BY 1) c ON c.student_id = w.student_id GROUP BY w.student_id""",
    "take_max": _WINNERS + " SELECT student_id, grp, claim_id, score::BIGINT AS score FROM winners",
    "sum_mode": f"WITH {_LINES} SELECT student_id, grp, sum(score)::BIGINT AS score FROM lines GROUP BY 1, 2",
    "group_cap": "SELECT p_brand AS grp, (max(p_size) FILTER (p_size % 3 > 0 AND p_brand <> 'Brand#11'))::BIGINT AS group_cap FROM part GROUP BY p_brand",
    "match_cascade": _CASCADE,
    "exclusive_mask": _EXCLUSIVE,
}
