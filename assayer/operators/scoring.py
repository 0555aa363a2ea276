"""Rule matching and scoring: claims against rules, a ledger line for each claim.

Scores are points x 100 in whole numbers, so factors, caps and sums are exact.
Rules are looked up by key through ``top_rule``; the rule side is joined as
Catalyst sees fit (its size is known to the planner, and AQE splits skew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_rule(rules: DataFrame, key: str) -> DataFrame:
    """The first rule of each key by (priority desc, score desc, id)."""
    order = Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("score"), "id")
    return rules.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def capped(score: Column, cap: Column) -> Column:
    """``score``, at most ``cap`` where there is one."""
    return F.when(score > cap, cap).otherwise(score)


def item_score(raw: Column, team: Column, factor_pct: Column, cap: Column) -> Column:
    """Team factor first, then the rule's cap, in points x 100."""
    return capped(F.when(team, raw * factor_pct).otherwise(raw * 100), cap * 100)


def take_max(lines: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The winning line of each group; ties go by ``order``. One partial limit before the shuffle."""
    return lines.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__k = 1").drop("__k")


def cascade(claims: DataFrame, rules: DataFrame, steps: list[tuple[str, str, float, str]]) -> DataFrame:
    """First match wins: ``steps`` are (claim key, rule key, confidence, channel).

    Each step joins the top rule of its key; the first that hits gives rule_id,
    rule_score, confidence and channel. Claims are never multiplied.
    """
    out, hits = claims, []
    for k, (claim_key, rule_key, confidence, channel) in enumerate(steps):
        side = top_rule(rules.where(F.col(rule_key).isNotNull()), rule_key).select(
            F.col(rule_key).alias(f"__k{k}"),
            F.struct(F.col("id").alias("rule_id"), F.col("score").alias("rule_score"), F.lit(confidence).alias("confidence"), F.lit(channel).alias("channel")).alias(f"__h{k}"),
        )
        out = out.join(side, out[claim_key] == side[f"__k{k}"], "left").drop(f"__k{k}")
        hits.append(F.col(f"__h{k}"))
    none = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("bigint").alias("rule_score"), F.lit(0.0).alias("confidence"), F.lit("none").alias("channel"))
    out = out.withColumn("__hit", F.coalesce(*hits, none))
    return out.select(*claims.columns, "__hit.rule_id", "__hit.rule_score", "__hit.confidence", "__hit.channel")


def best_independent(scores: DataFrame, key: str, names: list[str], conflicts: list[tuple[int, int]]) -> DataFrame:
    """Exclusive groups: the conflict-free set with the highest sum, for each key.

    ``scores`` has a column of points for each name. All 2^n sets of the few
    names are an array in the row (n is small and fixed), so this is a projection.
    Ties: highest single score, then the lexicographically smallest names.
    """
    sets = []
    for mask in range(1 << len(names)):
        if any(mask >> a & 1 and mask >> b & 1 for a, b in conflicts):
            continue
        chosen = [n for k, n in enumerate(names) if mask >> k & 1]
        total = sum((F.col(n) for n in chosen), F.lit(0).cast("bigint"))
        top = F.greatest(F.lit(0).cast("bigint"), *[F.col(n) for n in chosen], F.lit(0).cast("bigint"))
        sets.append(F.struct((-total).alias("a"), (-top).alias("b"), F.lit(",".join(sorted(chosen))).alias("kept")))
    best = F.array_min(F.array(*sets))
    return scores.select(key, best["kept"].alias("kept"), (-best["a"]).alias("total"))
