"""Snapshots, workflows and caches: orders and events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import versions as V
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_SNAP = """lines AS (SELECT o_custkey % 200 AS ruleset, year(o_orderdate) AS moment, o_orderkey AS id, sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, '~'))) AS line FROM orders),
versions AS (SELECT ruleset, moment, count(*) AS n_rows, sha256(string_agg(line, '' ORDER BY id)) AS hash FROM lines GROUP BY 1, 2)"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 200).alias("ruleset"), F.year("o_orderdate").alias("moment"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"))
    return V.snapshot_hash(rows, ["ruleset", "moment"], "id", ["status", "priority"])


@_query("ruleset_versions", f"WITH {_SNAP} SELECT ruleset, moment::INTEGER AS moment, n_rows AS rows, hash FROM versions")
def ruleset_versions(spark, d):
    return _versions(spark, d)


_PUB = f"""{_SNAP}, twice AS (SELECT ruleset, moment * 2 + n AS moment, hash FROM versions, (VALUES (0), (1)) x(n) WHERE n = 0 OR moment % 2 = 0),
named AS (SELECT ruleset, moment, hash, lag(hash) OVER (PARTITION BY ruleset ORDER BY moment) AS before FROM twice),
pub AS (SELECT ruleset, moment, hash, CASE WHEN before IS NULL OR before <> hash THEN 'published' ELSE 'unchanged' END AS event FROM named),
published AS (SELECT *, last_value(CASE WHEN event = 'published' THEN hash END IGNORE NULLS) OVER (PARTITION BY ruleset ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM pub)"""


def _published(spark, d):
    v = _versions(spark, d)
    again = v.select("ruleset", (F.col("moment") * 2).alias("moment"), "hash").unionByName(v.where("moment % 2 = 0").select("ruleset", (F.col("moment") * 2 + 1).alias("moment"), "hash"))
    return V.publish(again, "ruleset", "moment")


@_query("published_versions", f"WITH {_PUB} SELECT ruleset, moment::INTEGER AS moment, 'rv_' || substr(hash, 1, 24) AS version_id, 'rv_' || substr(parent, 1, 24) AS parent, event FROM published")
def published_versions(spark, d):
    """Every second year's rules are published twice: the second time nothing changes."""
    return _published(spark, d)


@_query("active_versions", f"""WITH {_PUB}, rolled AS (SELECT ruleset, 9999 AS moment, arg_min(hash, moment) AS hash, 'rolled_back' AS event FROM published WHERE ruleset % 4 = 0 AND event = 'published' GROUP BY 1), log AS (SELECT ruleset, moment, hash, event FROM published WHERE event = 'published' UNION ALL SELECT * FROM rolled)
SELECT ruleset, 'rv_' || substr(arg_max(hash, moment), 1, 24) AS version_id, arg_max(event, moment) AS event FROM log GROUP BY ruleset""")
def active_versions(spark, d):
    """The active version of each set; every fourth set was rolled back to its first one."""
    log = _published(spark, d).where("event = 'published'").select("ruleset", "moment", "version_id", "event")
    back = log.where("ruleset % 4 = 0").groupBy("ruleset").agg(F.min_by("version_id", "moment").alias("version_id"))
    return V.active(log.unionByName(back.select("ruleset", F.lit(9999).alias("moment"), "version_id", F.lit("rolled_back").alias("event"))), "ruleset", "moment")


_KEYED = """chunks AS (SELECT l_orderkey AS doc, l_linenumber AS part, l_returnflag || l_linestatus AS old, CASE WHEN l_partkey % 10 = 0 THEN 'new' ELSE l_returnflag || l_linestatus END AS now, l_suppkey FROM lineitem),
keys AS (SELECT doc, part, CASE WHEN l_suppkey % 9 > 0 THEN sha256(encode(doc::VARCHAR) || '\\x00'::BLOB || encode(old) || '\\x00'::BLOB || encode('m1')) END AS a, CASE WHEN l_suppkey % 11 > 0 THEN sha256(encode(doc::VARCHAR) || '\\x00'::BLOB || encode(now) || '\\x00'::BLOB || encode('m1')) END AS b FROM chunks)"""


@_query("manifest_sync", f"""WITH {_KEYED}, olds AS (SELECT doc, part, a FROM keys WHERE a IS NOT NULL), news AS (SELECT doc, part, b FROM keys WHERE b IS NOT NULL)
SELECT doc, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' WHEN a = b THEN 'reused' ELSE 'rebuilt' END AS action, count(*) AS n FROM olds FULL JOIN news USING (doc, part) GROUP BY 1, 2""")
def manifest_sync(spark, d):
    """What an index has to do for each document: chunks by (document, content, model) key against the manifest before."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("part"), F.concat("l_returnflag", "l_linestatus").alias("old"), "l_partkey", "l_suppkey")
    key = lambda c: V.index_key(F.col("doc").cast("string"), c, F.lit("m1")).alias("key")
    old = li.where("l_suppkey % 9 > 0").select("doc", "part", key(F.col("old")))
    new = li.where("l_suppkey % 11 > 0").select("doc", "part", key(F.when(F.col("l_partkey") % 10 == 0, "new").otherwise(F.col("old"))))
    return V.sync(old, new, "doc", "part", "key").groupBy("doc", "action").agg(F.count(F.lit(1)).alias("n"))


@_query("active_chunks", "SELECT o_orderkey AS doc, count(*) AS chunks FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber % 2 = o_orderkey % 2 WHERE o_orderstatus <> 'F' GROUP BY 1")
def active_chunks(spark, d):
    """Chunks of the current manifest of documents that aren't deleted."""
    docs = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 2).alias("manifest"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("long").alias("manifest"))
    return docs.join(chunks, ["doc", "manifest"]).groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"))


_REVIEW = [("pending", "started", "in_progress"), ("pending", "resolved", "resolved"), ("in_progress", "resolved", "resolved"), ("pending", "dismissed", "dismissed"), ("in_progress", "dismissed", "dismissed")]
_KINDS = ["started", "resolved", "dismissed", "started"]


def _task_events(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select((F.col("user_id") * 100 + F.floor(e / 150) % 100).alias("task"), "ts", "event_id", F.element_at(F.array(*map(F.lit, _KINDS)), (e % 4 + 1).cast("int")).alias("event"))


_EVENTS = "log AS (SELECT user_id * 100 + event_id // 150 % 100 AS task, ts, event_id, (['started', 'resolved', 'dismissed', 'started'])[event_id % 4 + 1] AS event FROM events)"


@_query("review_states", f"""WITH {_EVENTS}, closing AS (SELECT *, sum((event <> 'started')::INT) OVER w AS closings, sum((event = 'started')::INT) OVER w AS starts FROM log WINDOW w AS (PARTITION BY task ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT task, min((ts, event_id)) FILTER (event <> 'started') AS closed, min((ts, event_id)) FILTER (event = 'started') AS began, arg_min(event, (ts, event_id)) FILTER (event <> 'started') AS how FROM log GROUP BY task)
SELECT c.task, event_id, event, CASE WHEN closed IS NOT NULL AND (ts, event_id) > closed THEN false WHEN event = 'started' AND (ts, event_id) > began THEN false ELSE true END AS legal,
  CASE WHEN closed IS NOT NULL AND (ts, event_id) >= closed THEN how WHEN began IS NOT NULL AND (ts, event_id) >= began THEN 'in_progress' ELSE 'pending' END AS state FROM closing c JOIN ends e ON c.task = e.task""")
def review_states(spark, d):
    """Every event of every review task: whether it was a legal move, and the state after it."""
    return V.fold(_task_events(spark, d), "task", ["ts", "event_id"], "pending", _REVIEW).select("task", "event_id", "event", "legal", "state")


_BATCH = [("queued", "started", "running"), ("running", "resolved", "succeeded"), ("queued", "dismissed", "failed"), ("running", "dismissed", "failed")]


@_query("batch_states", f"""WITH RECURSIVE {_EVENTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) AS k FROM log),
walk AS (SELECT task, 0::BIGINT AS k, 'queued' AS state, 0 AS revision FROM (SELECT DISTINCT task FROM log)
 UNION ALL SELECT w.task, n.k, CASE WHEN w.state = 'queued' AND event = 'started' THEN 'running' WHEN w.state = 'running' AND event = 'resolved' THEN 'succeeded' WHEN w.state IN ('queued', 'running') AND event = 'dismissed' THEN 'failed' ELSE w.state END,
  revision + (w.state = 'queued' AND event = 'started' OR w.state = 'running' AND event = 'resolved' OR w.state IN ('queued', 'running') AND event = 'dismissed')::INT FROM walk w JOIN numbered n ON n.task = w.task AND n.k = w.k + 1)
SELECT task, arg_max(state, k) AS state, max(revision) AS revision FROM walk GROUP BY task""")
def batch_states(spark, d):
    """The state of every batch after all its events."""
    steps = V.fold(_task_events(spark, d), "task", ["ts", "event_id"], "queued", _BATCH)
    return steps.groupBy("task").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("revision").alias("revision"))


@_query("reopened_tasks", """WITH r AS (SELECT user_id, event_type, ts, event_id, coalesce(lag(value > 60) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), true) AS opened FROM events)
SELECT event_id, opened, sum(opened::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS generation FROM r""")
def reopened_tasks(spark, d):
    """Requests for reviews: a new generation only after the one before was closed (here: a value above 60)."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return V.generations(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("value") > 60).select("event_id", "opened", "generation")


@_query("idempotent_requests", """WITH r AS (SELECT event_id, CASE WHEN user_id % 10 > 0 THEN user_id * 10 + event_id % 5 END AS key, event_type AS content, ts FROM events),
f AS (SELECT key, arg_min(content, (ts, event_id)) AS c, min((ts, event_id)) AS t FROM r WHERE key IS NOT NULL GROUP BY key)
SELECT event_id, CASE WHEN r.key IS NULL OR (ts, event_id) = t THEN 'created' WHEN content = c THEN 'repeated' ELSE 'conflict' END AS outcome FROM r LEFT JOIN f ON r.key = f.key""")
def idempotent_requests(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 > 0, F.col("user_id") * 10 + F.col("event_id") % 5).alias("key"), F.col("event_type").alias("content"), "ts")
    return V.idempotent(e, "key", ["ts", "event_id"], "content").select("event_id", "outcome")


@_query("extraction_cache", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS writes FROM events GROUP BY 1, 2")
def extraction_cache(spark, d):
    """Last write by (chunk, model)."""
    return V.last_write(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@_query("tool_calls", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS place, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def tool_calls(spark, d):
    """A session's calls in insertion order, each with the one before."""
    from pyspark.sql.window import Window

    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(along).alias("place"), F.lag("event_id").over(along).alias("before"))


@_query("review_page", """SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC)::INTEGER AS position FROM events WHERE event_type = 'click' AND value > 10 QUALIFY position BETWEEN 41 AND 60""")
def review_page(spark, d):
    """The third page of twenty of the filtered queue, newest first (limit and offset are the feature)."""
    from pyspark.sql.window import Window

    page = table(spark, d, "events").where("event_type = 'click' and value > 10").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(60)
    return page.select("event_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).alias("position")).where("position > 40")
