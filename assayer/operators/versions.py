"""Published snapshots and workflows as folds over append-only event logs.

Nothing is updated in place: a snapshot is a set of rows under the hash of its
content, the active one is what the last legal event points to, and a task's
state is the fold of its events in order. Folds are windows and aggregates by
key, so a million tasks are as parallel as their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_hash(rows: DataFrame, by: list[str], key: str, content: list[str]) -> DataFrame:
    """``by``, rows and hash: SHA-256 over the rows' own hashes in order of ``key``; other columns (times) don't count.

    Row hashes are 64 bytes each, so a snapshot of n rules needs 64 n bytes in one place, not its texts.
    """
    line = F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in content]), 256)
    hashed = rows.select(*by, key, line.alias("line"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda s: s["line"]), "")
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(together, 256).alias("hash"))


def publish(versions: DataFrame, series: str, at: str) -> DataFrame:
    """``versions`` (series, at, hash) with version_id, parent and event: published, or unchanged where the active content is the same.

    A version's parent is the one active before it; publishing what is active adds nothing.
    """
    along = Window.partitionBy(series).orderBy(at)
    before = F.lag("hash").over(along)
    fresh = before.isNull() | (before != F.col("hash"))
    marked = versions.withColumn("event", F.when(fresh, "published").otherwise("unchanged"))
    earlier = F.last(F.when(F.col("event") == "published", F.col("hash")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    name = lambda h: F.concat(F.lit("rv_"), F.substring(h, 1, 24))
    return marked.select(series, at, name(F.col("hash")).alias("version_id"), name(earlier).alias("parent"), "event")


def active(events: DataFrame, series: str, at: str) -> DataFrame:
    """``series`` and the version that is active: the last event's (a publication, or a rollback to an earlier one)."""
    return events.groupBy(series).agg(F.max_by("version_id", at).alias("version_id"), F.max_by("event", at).alias("event"))


def sync(old: DataFrame, new: DataFrame, series: str, key: str, content: str) -> DataFrame:
    """``series``, ``key`` and action for every entry on either side: added, deleted, rebuilt (content changed) or reused."""
    a, b = old.select(series, key, F.col(content).alias("was")), new.select(series, key, F.col(content).alias("now"))
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "reused").otherwise("rebuilt")
    return a.join(b, [series, key], "full_outer").select(series, key, action.alias("action"))


def index_key(doc: Column, content_hash: Column, model: Column) -> Column:
    """What an embedding depends on: document, content and model."""
    nul = F.lit("\u0000")
    return F.sha2(F.concat(doc, nul, content_hash, nul, model), 256)


def fold(events: DataFrame, key: str, order: list[str], start: str, moves: list[tuple[str, str, str]]) -> DataFrame:
    """Each event with the state before and after it, and whether it was legal, by the allowed ``moves`` (state, event, state).

    An illegal event changes nothing. The fold is over one key's few events, as
    an array in order; ``revision`` counts the legal ones.
    """
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "event"))).alias("log"))

    def after(state: Column, event: Column) -> Column:
        out = F.lit(None).cast("string")
        for a, e, b in moves:
            out = F.when((state == a) & (event == e), F.lit(b)).otherwise(out)
        return out

    def step(acc: Column, e: Column) -> Column:
        state = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["state"]).otherwise(F.lit(start))
        revision = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["revision"]).otherwise(0)
        to = after(state, e["event"])
        return F.concat(acc, F.array(F.struct(*[e[c].alias(c) for c in order], e["event"].alias("event"), state.alias("was"), F.coalesce(to, state).alias("state"), to.isNotNull().alias("legal"), (revision + to.isNotNull().cast("int")).alias("revision"))))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    shape = ",".join(f"`{c}`:{kinds[c]}" for c in order)
    empty = F.array().cast(f"array<struct<{shape},event:string,was:string,state:string,legal:boolean,revision:int>>")
    return listed.select(key, F.explode(F.aggregate("log", empty, step)).alias("s")).select(key, "s.*")


def generations(tasks: DataFrame, stable: list[str], order: list[str], closed: Column) -> DataFrame:
    """``tasks`` with generation, opened and reopened_from: a request while its task is open is that task; after it is closed a new generation begins.

    ``closed``: whether the task that a request opened or met was closed before the next request.
    """
    along = Window.partitionBy(*stable).orderBy(*order)
    opens = F.coalesce(F.lag(closed).over(along), F.lit(True))
    marked = tasks.withColumn("opened", opens)
    return marked.withColumn("generation", F.sum(F.col("opened").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))


def idempotent(requests: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """``requests`` with outcome: created, repeated (same key and content), conflict (same key, other content); without a key: created."""
    along = Window.partitionBy(key).orderBy(*order)
    first = F.first(content).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(along)
    return requests.withColumn("outcome", F.when(F.col(key).isNull() | (place == 1), "created").when(F.col(content) == first, "repeated").otherwise("conflict"))


def last_write(events: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last ``value`` written under each key."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("writes"))
