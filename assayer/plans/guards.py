"""Guards, audits, merges, chunks and queues, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import guards as D
from assayer.operators import audit as A
from assayer.plans.ledger import _BASE, _decided, _rules
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_query("precise_sources", """SELECT l_orderkey, l_linenumber, l_partkey % 9 > 0 AND (l_suppkey % 2 = 0 OR l_suppkey % 3 = 0 OR l_suppkey % 5 = 0 AND l_suppkey % 7 > 0 OR l_suppkey % 11 = 0 AND l_suppkey % 13 > 0) AS precise FROM lineitem""")
def precise_sources(spark, d):
    s = F.col("l_suppkey")
    source = F.struct(
        F.when(F.col("l_partkey") % 9 > 0, "book").otherwise(" ").alias("doc"), F.when(s % 2 == 0, F.col("l_linenumber")).alias("page"), F.when(s % 3 == 0, "c").otherwise("").alias("clause"), F.when(s % 5 == 0, "t").alias("table"), F.when(s % 7 > 0, s).alias("row"),
        F.when(s % 11 == 0, "h").alias("chunk_hash"), F.when(s % 13 > 0, 0).alias("char_start"), F.lit(5).alias("char_end"),
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.precise(source).alias("precise"))


@_query("queries_in_scope", """SELECT item_id, NOT (contains(lower(text), 'library') OR contains(lower(text), 'weather')) AND (contains(lower(text), 'the') OR contains(lower(text), 'para')) AS anchored,
  NOT (contains(lower(text), 'library') OR contains(lower(text), 'weather')) AND (contains(lower(text), 'the') OR contains(lower(text), 'para')) AND (contains(lower(text), 'for') OR contains(lower(text), 'que')) AS asked FROM benchmark""")
def queries_in_scope(spark, d):
    scope = lambda intents: D.in_scope(F.col("text"), ["library", "weather"], ["the", "para"], intents)
    return table(spark, d, "benchmark").select("item_id", scope(None).alias("anchored"), scope(["for", "que"]).alias("asked"))


@_query("unsafe_texts", r"""SELECT conv_id, turn, CASE WHEN trim(x, ' ') = '' THEN 'empty' WHEN length(x) > 900 THEN 'too_long' WHEN contains(x, chr(7)) THEN 'control' WHEN regexp_matches(x, '(?i)(api[_-]?key|secret|password|token)[ \t]*[:=]|sk-[A-Za-z0-9]{8,}|bearer [A-Za-z0-9._-]{8,}') THEN 'secret' WHEN regexp_matches(x, '(^|[^0-9])[0-9]{8,}([^0-9]|$)') THEN 'identifier' END AS reason
FROM (SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN text || chr(7) WHEN 2 THEN 'api_key: ' || text WHEN 3 THEN 'no 2023' || lpad((turn % 100)::VARCHAR, 5, '0') || ' ' || text ELSE text END AS x FROM conversations)""")
def unsafe_texts(spark, d):
    """Why a text may not be stored, if it may not."""
    c, t = F.col("conv_id") % 7, F.col("text")
    number = F.concat(F.lit("no 2023"), F.lpad((F.col("turn") % 100).cast("string"), 5, "0"), F.lit(" "), t)
    x = F.when(c == 0, " ").when(c == 1, F.concat(t, F.lit("\x07"))).when(c == 2, F.concat(F.lit("api_key: "), t)).when(c == 3, number).otherwise(t)
    return table(spark, d, "conversations").select("conv_id", "turn", D.unsafe(x, 900).alias("reason"))


@_query("cited_answers", "SELECT s_suppkey, s_suppkey % 3 > 0 AND (s_nationkey % 2 = 0 OR s_nationkey % 5 = 0) AS cited FROM supplier")
def cited_answers(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    answer = F.concat(F.lit("见 "), F.when(s % 3 > 0, "细则").otherwise("手册"), F.when(n % 2 == 0, " 第3页").otherwise(""), F.when(n % 5 == 0, " 第七条").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", D.cites(answer, F.lit("细则"), F.array(F.lit("第3页"), F.lit(None), F.lit("第七条"))).alias("cited"))


@_query("canonical_hashes", """SELECT p_partkey, sha256('{"a":' || CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || '"' ELSE 'null' END || ',"b":' || p_size::VARCHAR || ',"c":' || CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END || '}') AS hash FROM part""")
def canonical_hashes(spark, d):
    """A record's hash, whatever the order of its fields."""
    fields = {"c": F.col("p_size") % 3 == 0, "a": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "b": F.col("p_size")}
    return table(spark, d, "part").select("p_partkey", F.sha2(D.canonical_json(fields), 256).alias("hash"))


@_query("asked_claims", """WITH q AS (SELECT c_custkey, (['学科竞赛', '竞赛', '荣誉', '无'])[c_custkey % 4 + 1] || ' 2024 ' || (['省级二等奖', '校一等', '省赛'])[c_custkey // 4 % 3 + 1] AS x FROM customer)
SELECT c_custkey, CASE WHEN contains(x, '学科竞赛') THEN '学科竞赛' WHEN contains(x, '竞赛') THEN '竞赛' WHEN contains(x, '荣誉') THEN '荣誉' END AS category, regexp_extract(x, '20\\d{2}', 0) AS year FROM q""".replace("\\\\", "\\"))
def asked_claims(spark, d):
    """A claim read from a question without a model: the longest category it holds, and the year."""
    k = F.col("c_custkey")
    x = F.concat(F.element_at(F.array(*map(F.lit, ["学科竞赛", "竞赛", "荣誉", "无"])), (k % 4 + 1).cast("int")), F.lit(" 2024 "), F.element_at(F.array(*map(F.lit, ["省级二等奖", "校一等", "省赛"])), (F.floor(k / 4) % 3 + 1).cast("int")))
    return table(spark, d, "customer").select(k, D.longest_held(x, ["荣誉", "竞赛", "学科竞赛"]).alias("category"), F.regexp_extract(x, "20\\d{2}", 0).alias("year"))


@_query("answers", f"WITH {_BASE}, t AS (SELECT student_id, count(*) FILTER (counted) AS n, coalesce(sum(score) FILTER (counted), 0) AS total FROM final GROUP BY 1) SELECT student_id, 'counted ' || n::VARCHAR || ', ' || (total // 100)::VARCHAR || '.' || lpad((total % 100)::VARCHAR, 2, '0') || ' points' AS answer FROM t")
def answers(spark, d):
    """The same words for the same ledger."""
    total = F.coalesce(F.sum(F.when(F.col("counted"), F.col("score"))), F.lit(0))
    t = _decided(spark, d).groupBy("student_id").agg(F.count_if("counted").alias("n"), total.alias("total"))
    text = F.concat(F.lit("counted "), F.col("n").cast("string"), F.lit(", "), F.floor(F.col("total") / 100).cast("string"), F.lit("."), F.lpad((F.col("total") % 100).cast("string"), 2, "0"), F.lit(" points"))
    return t.select("student_id", text.alias("answer"))


@_query("ledger_invariants", f"WITH {_BASE} SELECT count(*) AS rows, count(*) FILTER (counted AND rule_id IS NULL) AS no_rule, count(*) FILTER (counted AND score > raw_score) AS above_raw, count(*) FILTER (reason = '' AND NOT counted) AS unexplained, 0::BIGINT AS repeated FROM final")
def ledger_invariants(spark, d):
    """What must hold of every ledger: rules behind counted lines, no score above its rule's, a reason for what doesn't count."""
    counted = F.col("counted")
    rows = _decided(spark, d)
    return A.audit(rows, ["claim_id"], {"no_rule": ~counted | F.col("rule_id").isNotNull(), "above_raw": ~counted | (F.col("score") <= F.col("raw_score")), "unexplained": counted | (F.col("reason") != "")})


@_query("data_audit", "SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)) AS language, count(*) FILTER (text IS NULL OR trim(text, ' ') = '') AS empty, count(*) FILTER (n_chars <> length(text)) AS length, (SELECT count(*) FROM (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated FROM documents")
def data_audit(spark, d):
    rows = table(spark, d, "documents").withColumn("h", F.md5("text"))
    return A.audit(rows, ["h"], {"language": F.col("lang").isin("en", "de", "fr", "es"), "empty": F.trim("text") != "", "length": F.col("n_chars") == F.length("text")})


@_query("published_merge", """WITH e AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS moment FROM part)
SELECT arg_min(id, (moment, id)) AS id, brand, kind, arg_max(size, (moment, id)) AS size, count(DISTINCT id) - 1 AS superseded FROM e GROUP BY brand, kind""")
def published_merge(spark, d):
    """Rules published again under other ids: one row for each identity."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    old, new = p.where("id % 3 > 0").withColumn("at", F.lit(1)), p.where("id % 3 = 0").withColumn("at", F.lit(2))
    return A.upsert(old, new, ["brand", "kind"], "id", "at", ["size"]).select("id", "brand", "kind", "size", F.size("superseded").cast("long").alias("superseded"))


@_query("orphan_collections", "SELECT DISTINCT l_orderkey % 5000 AS collection FROM lineitem WHERE l_orderkey % 5000 NOT IN (SELECT o_custkey FROM orders)")
def orphan_collections(spark, d):
    found = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5000).alias("collection")).distinct()
    return A.orphans(found, table(spark, d, "orders").select(F.col("o_custkey").alias("collection")).distinct(), "collection")


@_query("review_tasks", """SELECT event_id, kind, priority FROM (SELECT event_id, unnest([CASE WHEN value < 10 THEN {'kind': 'duplicate', 'priority': CASE WHEN value < 3 THEN 'critical' ELSE 'high' END} END, CASE WHEN event_id % 6 = 0 THEN {'kind': 'consistency', 'priority': 'high'} END, CASE WHEN user_id % 9 = 0 THEN {'kind': 'low_confidence', 'priority': 'normal'} END]) AS t FROM events) s(event_id, t), (SELECT 1), LATERAL (SELECT t.kind AS kind, t.priority AS priority) WHERE t IS NOT NULL""")
def review_tasks(spark, d):
    """Tasks from three producers: duplicate decisions, inconsistencies and low confidence."""
    v = F.col("value")
    return A.tasks(table(spark, d, "events"), "event_id", [("duplicate", v < 10, F.when(v < 3, "critical").otherwise("high")), ("consistency", F.col("event_id") % 6 == 0, F.lit("high")), ("low_confidence", F.col("user_id") % 9 == 0, F.lit("normal"))])


@_query("document_chunks", """WITH l AS (SELECT conv_id, turn, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT conv_id, turn, string_split(role || chr(10) || text, chr(10)) AS s FROM conversations)), f AS (SELECT *, i = 0 AS head FROM l WHERE trim(line, ' ') <> ''),
c AS (SELECT *, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, i ROWS UNBOUNDED PRECEDING) AS header FROM f)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1)::INTEGER AS ordinal, md5(line) AS text_md5, header FROM c WHERE NOT head""")
def document_chunks(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\n"), "text").alias("text"))
    return A.chunks(pages, "conv_id", "turn", "text", F.col("i") == 0).select("conv_id", "ordinal", F.md5("text").alias("text_md5"), "header")


@_query("ranked_then_dropped", "SELECT vec_id AS id, label AS query, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE embedding[1] > 0")
def ranked_then_dropped(spark, d):
    hits = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("query"), F.col("embedding")[0].alias("score"))
    return A.rank_then_drop(hits, "query").select("id", "query", "rank")


@_query("paired_rates", """SELECT round(count(*) FILTER (event_id % 3 > 0 AND value > 2 AND user_id > 3) / count(*) FILTER (event_id % 3 > 0), 6) AS accuracy, round(count(*) FILTER (event_id % 3 = 0 AND value <= 2) / count(*) FILTER (event_id % 3 = 0), 6) AS refusal, round(count(*) FILTER (event_id % 3 > 0 AND value <= 2) / count(*) FILTER (event_id % 3 > 0), 6) AS false_refusal, false AS passed FROM events""")
def paired_rates(spark, d):
    return A.paired_rates(table(spark, d, "events").select((F.col("event_id") % 3 > 0).alias("should_answer"), (F.col("value") > 2).alias("answered"), (F.col("user_id") > 3).alias("right")))


@_query("cost_roll_up", """SELECT user_id, sum(CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END)::BIGINT AS calls, coalesce(max(event_id) FILTER (event_id % 5 = 0), sum(event_id) FILTER (event_id % 5 > 0))::BIGINT AS tokens, count(*) FILTER (event_id % 5 = 0) > 0 AS from_ledger FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 5 > 0) > 0""")
def cost_roll_up(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 5 == 0).alias("is_total"), F.lit(1).alias("calls"), F.col("event_id").alias("tokens"))
    return A.roll_up(rows, "user_id").where("calls is not null")


@_query("latest_corrections", "SELECT o_orderkey, coalesce(arg_max(l_comment, k), o_orderstatus) AS value, count(k) AS corrections FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag || '!' AS l_comment, (l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40) ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus")
def latest_corrections(spark, d):
    """Values as the last person left them; a correction is a record, not a validation."""
    fixes = table(spark, d, "lineitem").where("l_linestatus = 'O' and l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by(F.concat("l_returnflag", F.lit("!")), F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("fix"), F.count(F.lit(1)).alias("n"))
    return table(spark, d, "orders").join(fixes, "o_orderkey", "left").select("o_orderkey", F.coalesce("fix", "o_orderstatus").alias("value"), F.coalesce("n", F.lit(0)).alias("corrections"))


@_query("grouped_claims", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS claims, array_to_string(list_distinct(list(o_orderpriority ORDER BY o_orderkey)), ',') <> '' AS any_kind, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def grouped_claims(spark, d):
    """Each student's claims in order and the kinds among them, first occurrences kept."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    kinds = F.array_distinct(F.transform("l", lambda s: s["o_orderpriority"]))
    return lists.select("o_custkey", F.array_join(F.transform("l", lambda s: s["o_orderkey"].cast("string")), ",").alias("claims"), (F.array_join(kinds, ",") != "").alias("any_kind"), F.size(kinds).cast("long").alias("kinds"))


@_query("rules_by_id", f"WITH {_BASE} SELECT w.id, r.level, r.points::BIGINT AS score FROM (SELECT 'r0' || (c_custkey % 12)::VARCHAR AS id, c_custkey FROM customer) w LEFT JOIN rules r ON r.rule_id = w.id")
def rules_by_id(spark, d):
    """Lookups by id; an unknown one finds nothing and is no error."""
    wanted = table(spark, d, "customer").select(F.concat(F.lit("r0"), (F.col("c_custkey") % 12).cast("string")).alias("id"))
    return wanted.join(_rules(spark).select(F.col("rule_id").alias("id"), "level", "score"), "id", "left")
