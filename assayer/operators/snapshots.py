"""Snapshots, differences, event-sourced state and stitched islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(old: DataFrame, new: DataFrame, key: str, content: str, meta: str) -> DataFrame:
    """key and change: added, removed, changed, metadata_only or unchanged."""
    a = old.select(F.col(key), F.col(content).alias("__c0"), F.col(meta).alias("__m0"), F.lit(True).alias("__old"))
    b = new.select(F.col(key), F.col(content).alias("__c1"), F.col(meta).alias("__m1"), F.lit(True).alias("__new"))
    kind = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed")
        .when(~F.col("__c0").eqNullSafe(F.col("__c1")), "changed").when(~F.col("__m0").eqNullSafe(F.col("__m1")), "metadata_only").otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def latest(events: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The last event of each key; an aggregate, so it combines before the shuffle."""
    last = F.max(F.struct(*order, *[v for v in value if v not in order]))
    return events.groupBy(key).agg(last.alias("__e")).select(key, *[F.col("__e")[v].alias(v) for v in value])


def islands(rows: DataFrame, group: str, order: list[str], starts: Column) -> DataFrame:
    """``rows`` with ``island``: the number of rows up to this one in its group that start a new run."""
    return rows.withColumn("island", F.sum(starts.cast("int")).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def carry_forward(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` so far in the group."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
