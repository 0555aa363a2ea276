"""Audits, merges and queues over finished tables: each is an aggregate, an anti join or a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def audit(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """rows, repeated keys and the number of rows that fail each check, as one row."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    both = counts.unionByName(repeated, allowMissingColumns=True)  # two rows, each with its own numbers
    return both.agg(*[F.sum(c).alias(c) for c in ("rows", *checks, "repeated")])


def upsert(old: DataFrame, new: DataFrame, identity: list[str], key: str, at: str, content: list[str]) -> DataFrame:
    """One row for each identity: the oldest id is kept, the newest content wins, the other ids are listed as superseded."""
    every = old.select(key, *identity, at, *content).unionByName(new.select(key, *identity, at, *content))
    merged = every.groupBy(*identity).agg(
        F.min_by(key, F.struct(at, key)).alias(key), F.max_by(F.struct(*content), F.struct(at, key)).alias("c"), F.array_sort(F.collect_set(key)).alias("ids"), F.max(at).alias(at)
    )
    return merged.select(key, *identity, at, "c.*", F.array_except("ids", F.array(key)).alias("superseded"))


def orphans(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is there without being known."""
    return found.join(known.select(key), key, "left_anti")


def tasks(rows: DataFrame, key: str, producers: list[tuple[str, Column, Column]]) -> DataFrame:
    """key, kind, priority of review tasks: each producer is (kind, whether it asks for one, priority)."""
    asked = F.array_compact(F.array(*[F.when(wanted, F.struct(F.lit(kind).alias("kind"), priority.alias("priority"))) for kind, wanted, priority in producers]))
    return rows.select(key, F.explode(asked).alias("t")).select(key, "t.kind", "t.priority")


def chunks(pages: DataFrame, doc: str, page: str, text: str, is_header: Column) -> DataFrame:
    """doc, ordinal, text, header: the blocks of a document in order (parted by line ends), each with the last header before it; headers are no chunks."""
    lines = pages.select(doc, page, F.posexplode(F.split(F.col(text), "\n", -1)).alias("i", "line")).where(F.trim("line") != "")
    along = Window.partitionBy(doc).orderBy(page, "i")
    carried = lines.withColumn("header", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(along)).withColumn("is_header", is_header)
    kept = carried.where("not is_header")
    return kept.select(doc, (F.row_number().over(along) - 1).alias("ordinal"), F.col("line").alias("text"), "header")


def rank_then_drop(hits: DataFrame, by: str) -> DataFrame:
    """Ranks given before non-positive scores go, so the ranks kept are those of the full order."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where("score > 0")


def paired_rates(cases: DataFrame, limits: tuple[float, float, float] = (0.95, 0.98, 0.05)) -> DataFrame:
    """accuracy, refusal, false_refusal and passed over (should_answer, answered, right) cases."""
    ask = F.col("should_answer")
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6)
    found = cases.agg(rate(ask & F.col("answered") & F.col("right"), ask).alias("accuracy"), rate(~ask & ~F.col("answered"), ~ask).alias("refusal"), rate(ask & ~F.col("answered"), ask).alias("false_refusal"))
    passed = (F.col("accuracy") >= limits[0]) & (F.col("refusal") >= limits[1]) & (F.col("false_refusal") <= limits[2])
    return found.select("*", F.coalesce(passed, F.lit(False)).alias("passed"))


def roll_up(reports: DataFrame, by: str) -> DataFrame:
    """calls, tokens and coverage across reports: a ledger's total outranks the sum of the parts."""
    whole, parts = F.max(F.when(F.col("is_total"), F.col("tokens"))), F.sum(F.when(~F.col("is_total"), F.col("tokens")))
    return reports.groupBy(by).agg(F.sum(F.when(~F.col("is_total"), F.col("calls"))).alias("calls"), F.coalesce(whole, parts).alias("tokens"), whole.isNotNull().alias("from_ledger"))
