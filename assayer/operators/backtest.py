"""Backtests: totals and items of a ledger against expectations (points x 100)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Totals off by at most this much are within tolerance.
WITHIN = 50


def item_key(explicit: Column, row: Column, claim_id: Column) -> Column:
    """A claim's stable name: its own key, else its row, else its id."""
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.concat(F.lit("row:"), row.cast("string")), claim_id.cast("string"))


def compare_students(totals: DataFrame, expected: DataFrame, tolerance: int = 1) -> DataFrame:
    """student_id, expected, actual, delta, band and explained of every student on either side."""
    both = expected.join(totals, "student_id", "full_outer")
    actual = F.coalesce("total", F.lit(0)).cast("long")
    off = F.abs(actual - F.col("expected"))
    band = F.when(F.col("expected").isNull(), "extra_student").when(F.col("total").isNull(), "missing_student").when(off == 0, "exact").when(off <= WITHIN, "within").otherwise("off")
    why = F.when(F.col("total").isNull(), "missing_student").when(off <= tolerance, None).when(F.size("unmatched") > 0, "unmatched_rule").when(F.size("review") > 0, "manual_review").otherwise("total_mismatch")
    return both.select("student_id", F.col("expected").cast("long").alias("expected"), actual.alias("actual"), (actual - F.col("expected")).cast("long").alias("delta"), band.alias("band"), F.when(F.col("expected").isNotNull(), why).alias("explained"))


def report(students: DataFrame) -> DataFrame:
    """students, found, exact, within, mean_error and max_error (points) over the expected ones."""
    known = students.where("expected is not null")
    off = F.abs("delta")
    return known.agg(
        F.count(F.lit(1)).alias("students"), F.count_if(F.col("band") != "missing_student").alias("found"), F.count_if(off == 0).alias("exact"), F.count_if(off <= WITHIN).alias("within"),
        F.round(F.avg(off / 100), 4).alias("mean_error"), (F.max(off) / 100).alias("max_error"),
    )


def compare_items(decided: DataFrame, wanted: DataFrame, rules: DataFrame) -> DataFrame:
    """student_id, claim_id, expected, actual (after the group's cap), kind and attribution of every item on either side."""
    caps = rules.groupBy("grp").agg((F.max("cap") * 100).alias("group_cap"))
    got = decided.join(caps, "grp", "left").select(
        "student_id", "claim_id", "status", "counted", F.when(F.col("counted"), F.least("score", F.coalesce("group_cap", "score"))).otherwise(0).cast("long").alias("got"), F.lit(True).alias("claimed")
    )
    both = wanted.withColumn("wanted", F.lit(True)).join(got, ["student_id", "claim_id"], "full_outer")
    kind = (
        F.when(F.col("wanted").isNull(), "missing_reference_item").when(F.col("claimed").isNull(), "missing_claim").when(F.col("got") == F.col("expected"), "matched")
        .when(F.col("status") == "unmatched", "unmatched_rule").when(F.col("status") == "review", "manual_review").when(~F.col("counted"), "dedup_or_exclusive").otherwise("score_mismatch")
    )
    return both.select("student_id", "claim_id", F.col("expected").cast("long").alias("expected"), F.coalesce("got", F.lit(0)).cast("long").alias("actual"), kind.alias("kind"), "attribution")
