"""Text, retrieval, metrics, cost, snapshot and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import text as T
from assayer.operators import metrics as M
from assayer.operators import snapshots as S
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_query("norm_text", r"SELECT doc_id, md5(regexp_replace(lower(text), '[\s　·•、,，。;；()（）\[\]【】\-—_/]+', '', 'g')) AS key_md5 FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_key(F.col("text"))).alias("key_md5"))


@_query("year_norm", """SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END)::INTEGER AS first_year,
  year(o_orderdate)::VARCHAR || '-' || (year(o_orderdate) + 1)::VARCHAR AS academic_year FROM orders""")
def year_norm(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", T.academic_year_of(day).alias("first_year"), T.academic_year(F.year(day).cast("string")).alias("academic_year"))


@_query("num_extract", r"SELECT event_id, try_cast(nullif(regexp_extract(props, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS first_number FROM events")
def num_extract(spark, d):
    return table(spark, d, "events").select("event_id", T.first_number(F.col("props")).alias("first_number"))


@_query("content_hash", r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@_query("tokenize", r"""SELECT doc_id, len(regexp_extract_all(lower(regexp_replace(text, '\s+', '', 'g')), '[a-z]+|\d+(?:\.\d+)?'))::INTEGER AS n_tokens FROM documents""")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.search_tokens(F.col("text"))).alias("n_tokens"))


@_query("wilson_rates", """WITH r AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, n::BIGINT AS n, round(greatest(0, (k/n + 1.959963984540054^2/(2*n) - 1.959963984540054*sqrt(k/n*(1-k/n)/n + 1.959963984540054^2/(4*n*n)))/(1+1.959963984540054^2/n)), 6) AS low,
 round(least(1, (k/n + 1.959963984540054^2/(2*n) + 1.959963984540054*sqrt(k/n*(1-k/n)/n + 1.959963984540054^2/(4*n*n)))/(1+1.959963984540054^2/n)), 6) AS high FROM r""")
def wilson_rates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "n", low.alias("low"), high.alias("high"))


@_query("confusion", """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 500) AS tn
  FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE, 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE, 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1 FROM c""")
def confusion(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return M.confusion(rows, ["lang"], F.col("quality") == 1, F.col("n_chars") > 500)


@_query("snapshot_diff", """WITH o AS (SELECT doc_id, sha256(text) AS h, source FROM documents), n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'new' ELSE h END AS h, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS source FROM o WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, h, source FROM o WHERE doc_id % 13 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h IS DISTINCT FROM n.h THEN 'changed' WHEN o.source IS DISTINCT FROM n.source THEN 'metadata_only' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source")
    new = old.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.lit("new")).otherwise(F.col("h")).alias("h"), F.when(F.col("doc_id") % 5 == 0, F.lit("moved")).otherwise(F.col("source")).alias("source"))
    added = old.where("doc_id % 13 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), "h", "source")
    return S.diff(old, new.unionByName(added), "doc_id", "h", "source")


@_query("dup_groups", "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def dup_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("h")


@_query("state_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id, event_type, ts, event_id FROM events) GROUP BY user_id".replace("max((ts, event_id)).event_id", "arg_max(event_id, (ts, event_id))"))
def state_latest(spark, d):
    return S.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@_query("stitch_islands", """SELECT user_id, event_id, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)""")
def stitch_islands(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    e = e.withColumn("prev", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return S.islands(e, "user_id", ["ts", "event_id"], F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.expr("INTERVAL 6 HOURS"))).select("user_id", "event_id", "island")


@_query("ffill_header", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations")
def ffill_header(spark, d):
    c = table(spark, d, "conversations")
    return S.carry_forward(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.md5("text")), "header").select("conv_id", "turn", "header")


@_query("review_queue", """SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id)::INTEGER AS position FROM events QUALIFY position <= 100""")
def review_queue(spark, d):
    """The first hundred reviews by priority; the limit is the feature."""
    e = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2).alias("p"))
    first = e.orderBy("p", "ts", "event_id").limit(100)
    return first.select("event_id", F.row_number().over(Window.orderBy("p", "ts", "event_id")).alias("position"))
