"""Rule lookups by scope: year, college (null in a rule: any), level and rank (null asked: any)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rules_for(asked: DataFrame, rules: DataFrame, key: str, rule_key: str) -> DataFrame:
    """``key``, ``rule_key``, score and position (from 1) of every rule that fits a row of ``asked`` (key, year, college, level, rank).

    An equality join by year and level; null wildcards are tested on what it leaves.
    """
    r = rules.select("year", "level", F.col("college").alias("__college"), F.col("rank").alias("__rank"), rule_key, "score", "priority")
    fits = (F.col("__college").isNull() | (F.col("__college") == F.col("college"))) & (F.col("rank").isNull() | (F.col("__rank") == F.col("rank")))
    order = Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("score"), rule_key)
    return asked.join(r, ["year", "level"]).where(fits).select(key, rule_key, "score", F.row_number().over(order).alias("position"))
