"""Cost reports, audits and evaluation: events and parts as logs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import metrics as M
from assayer.plans.ledger import _decided
from assayer.sources import tables as S
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_SHAPES = ['{"usage_metadata": {"input_tokens": %a, "output_tokens": %b, "total_tokens": %c}}', '{"response_metadata": {"token_usage": {"prompt_tokens": %a, "completion_tokens": %b}}}', '{"usage": {"prompt_tokens": %a, "completion_tokens": %b, "total_tokens": %c}}', '{"usage": "none", "text": "x"}', '{"usage_metadata": {"input_tokens": "%a"}}']


@_query("token_usage", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN user_id END AS input_tokens, CASE WHEN event_id % 5 IN (0, 1, 2) THEN event_id % 97 END AS output_tokens, CASE WHEN event_id % 5 IN (0, 2) THEN user_id + event_id % 97 END AS total_tokens,
  (['usage_metadata', 'response_metadata', 'mapping', 'missing', 'missing'])[event_id % 5 + 1] AS source FROM events""")
def token_usage(spark, d):
    """Tokens as three shapes of responses report them; nothing is estimated."""
    e, u = F.col("event_id"), F.col("user_id")
    body = F.element_at(F.array(*map(F.lit, _SHAPES)), (e % 5 + 1).cast("int"))
    for mark, value in (("%a", u), ("%b", e % 97), ("%c", u + e % 97)):
        body = F.replace(body, F.lit(mark), value.cast("string"))
    return M.token_usage(table(spark, d, "events").select("event_id", body.alias("body")), "body").select("event_id", "input_tokens", "output_tokens", "total_tokens", "source")


_COSTS = """e AS (SELECT event_type AS model, CASE WHEN user_id % 3 = 0 THEN 'rule_extraction' WHEN user_id % 3 = 1 THEN 'rule_extraction_secondary' ELSE 'answer' END AS purpose, CASE WHEN user_id % 7 > 0 THEN user_id END AS subject, CASE WHEN event_id % 4 > 0 THEN event_id % 50 END AS material,
  event_type <> 'view' AS external, event_type = 'view' AS hit, CASE WHEN event_type = 'view' THEN 'cache_hit' WHEN value < 5 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 9 > 0 THEN CAST(floor(value) AS BIGINT) END AS tokens_in, CASE WHEN event_id % 9 > 0 THEN event_id % 13 END AS tokens_out,
  CASE WHEN user_id % 5 > 0 OR event_type = 'purchase' THEN (event_id % 1000 + 1)::DOUBLE / 1024 END AS cost, event_type IN ('purchase', 'click') AS strong FROM events)"""
_REPORT = """count(*) AS requests, count(*) FILTER (external) AS external_calls, count(*) FILTER (external AND status = 'error') AS failures, count(*) FILTER (hit) AS cache_hits, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate,
  round(count(*) FILTER (external AND status = 'ok' AND tokens_in IS NOT NULL) / nullif(count(*) FILTER (external AND status = 'ok'), 0), 6) AS usage_coverage, coalesce(sum(tokens_in) FILTER (external AND status = 'ok'), 0)::BIGINT AS input_tokens, coalesce(sum(tokens_out) FILTER (external AND status = 'ok'), 0)::BIGINT AS output_tokens,
  CASE WHEN count(*) FILTER (external AND status = 'ok') > 0 AND count(*) FILTER (external AND status = 'ok' AND cost IS NULL) = 0 THEN round(sum(cost) FILTER (external AND status = 'ok'), 8) END AS cost, count(DISTINCT material) AS materials, count(DISTINCT subject) AS subjects,
  round(count(*) FILTER (external AND status = 'ok' AND strong) / nullif(count(*) FILTER (external AND status = 'ok'), 0), 6) AS strong_ratio, round(count(*) FILTER (external AND status = 'ok' AND purpose = 'rule_extraction_secondary') / nullif(count(*) FILTER (external AND status = 'ok' AND starts_with(purpose, 'rule_extraction')), 0), 6) AS secondary_ratio"""


def _costs(spark, d):
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return table(spark, d, "events").select(
        kind.alias("model"), F.when(u % 3 == 0, "rule_extraction").when(u % 3 == 1, "rule_extraction_secondary").otherwise("answer").alias("purpose"), F.when(u % 7 > 0, u).alias("subject"), F.when(e % 4 > 0, e % 50).alias("material"),
        (kind != "view").alias("external"), (kind == "view").alias("cache_hit"), F.when(kind == "view", "cache_hit").when(F.col("value") < 5, "error").otherwise("ok").alias("status"),
        F.when(e % 9 > 0, F.floor("value").cast("long")).alias("tokens_in"), F.when(e % 9 > 0, e % 13).alias("tokens_out"), F.when((u % 5 > 0) | (kind == "purchase"), (e % 1000 + 1).cast("double") / 1024).alias("cost"), kind.isin("purchase", "click").alias("strong"),
    )


@_query("cost_report", f"WITH {_COSTS} SELECT {_REPORT} FROM e")
def cost_report(spark, d):
    return M.cost_report(_costs(spark, d), [])


@_query("cost_buckets", f"WITH {_COSTS} SELECT 'model' AS bucket, model AS key, {_REPORT} FROM e GROUP BY model UNION ALL SELECT 'purpose', purpose, {_REPORT} FROM e GROUP BY purpose")
def cost_buckets(spark, d):
    """The report for each model and for each purpose; money only where every call has its price."""
    costs = _costs(spark, d)
    of = lambda c: M.cost_report(costs, [c]).select(F.lit(c).alias("bucket"), F.col(c).alias("key"), "*").drop(c)
    return of("model").unionByName(of("purpose"))


@_query("field_scores", """WITH r AS (SELECT p_partkey AS id, p_brand AS w1, CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_brand END END AS g1, CASE WHEN p_size % 3 > 0 THEN p_type END AS w2, CASE WHEN p_size % 4 > 0 THEN p_type END AS g2 FROM part),
f AS (SELECT id, 'brand' AS field, w1 AS w, g1 AS g FROM r UNION ALL SELECT id, 'type', w2, g2 FROM r), c AS (SELECT coalesce(field, 'micro') AS field, count(*) FILTER (w = g) AS tp, count(*) FILTER (g IS NOT NULL AND w IS DISTINCT FROM g) AS fp, count(*) FILTER (w IS NOT NULL AND w IS DISTINCT FROM g) AS fn FROM f GROUP BY GROUPING SETS ((field), ()))
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE, 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE, 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1 FROM c""")
def field_scores(spark, d):
    """Right, wrong and missed values of each field and over all fields."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        k.alias("id"), F.col("p_brand").alias("w1"), F.when(k % 7 > 0, F.when(k % 5 == 0, "x").otherwise(F.col("p_brand"))).alias("g1"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("w2"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("g2")
    )
    return M.field_scores(rows, {"brand": ("w1", "g1"), "type": ("w2", "g2")})


@_query("exact_rows", """SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 > 0 AND p_partkey % 5 > 0) AS exact, round(count(*) FILTER (p_partkey % 7 > 0 AND p_partkey % 5 > 0) / count(*), 6) AS rate FROM part WHERE p_partkey % 3 > 0""")
def exact_rows(spark, d):
    """Gold and predicted rows aligned by id: how many agree in full; both sides must have the same number of rows."""
    gold = table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    k = F.col("id")
    predicted = gold.select("id", F.when(k % 7 > 0, F.col("p_brand")).alias("p_brand"), F.when(k % 5 > 0, F.col("p_type")).alias("p_type"))
    return M.exact_rows(gold, predicted, "id", ["p_brand", "p_type"])


@_query("correction_audit", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS corrected, round(count(*) FILTER (value > 50) / count(*), 6) AS rate, count(DISTINCT user_id) FILTER (value > 50) AS reasons FROM events GROUP BY event_type")
def correction_audit(spark, d):
    fixed = F.col("value") > 50
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(fixed).alias("corrected"), F.round(F.try_divide(F.count_if(fixed), F.count(F.lit(1))), 6).alias("rate"), F.count_distinct(F.when(fixed, F.col("user_id"))).alias("reasons"))


@_query("user_trials", """WITH r AS (SELECT event_type AS task, user_id, value, event_id % 4 > 0 AS done, round(value, 2) AS secs FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY secs) AS k, count(*) OVER (PARTITION BY task) AS n FROM r),
c AS (SELECT task, count(DISTINCT user_id) AS people, count(*)::DOUBLE AS n, count(*) FILTER (done)::DOUBLE AS s, max(secs) FILTER (k = ceil(0.5 * n)) AS p50, max(secs) FILTER (k = ceil(0.9 * n)) AS p90, max(secs) FILTER (k = CAST(floor((n - 1) * 0.9 + 0.999999) AS BIGINT) + 1) AS p90_upper FROM o GROUP BY task)
SELECT task, people, n::BIGINT AS n, round(s / n, 6) AS success, round(greatest(0, (s/n + 1.959963984540054^2/(2*n) - 1.959963984540054*sqrt(s/n*(1-s/n)/n + 1.959963984540054^2/(4*n*n)))/(1+1.959963984540054^2/n)), 6) AS low,
 round(least(1, (s/n + 1.959963984540054^2/(2*n) + 1.959963984540054*sqrt(s/n*(1-s/n)/n + 1.959963984540054^2/(4*n*n)))/(1+1.959963984540054^2/n)), 6) AS high, p50, p90, p90_upper FROM c""")
def user_trials(spark, d):
    """People, success with its interval and durations for each task; both definitions of a percentile."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), "user_id", (F.col("event_id") % 4 > 0).alias("done"), F.round("value", 2).alias("secs"))
    n = F.count(F.lit(1))
    rates = rows.groupBy("task").agg(F.count_distinct("user_id").alias("people"), n.alias("n"), F.count_if("done").alias("s"))
    low, high = M.wilson(F.col("s"), F.col("n"))
    places = {"p50": lambda n: F.ceil(n * 0.5), "p90": lambda n: F.ceil(n * 0.9), "p90_upper": lambda n: F.floor((n - 1) * 0.9 + 0.999999) + 1}
    return rates.join(M.order_statistics(rows, "task", "secs", places), "task").select("task", "people", "n", F.round(F.col("s") / F.col("n"), 6).alias("success"), low.alias("low"), high.alias("high"), "p50", "p90", "p90_upper")


@_query("percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, d):
    """Exact order statistics without holding a group's values in one place."""
    rows = table(spark, d, "events").select("event_type", "value")
    return M.order_statistics(rows, "event_type", "value", {"p50": lambda n: F.ceil(n * 0.5), "p95": lambda n: F.ceil(n * 0.95)})


@_query("scenario_rates", "SELECT lang AS scenario, count(*) AS cases, count(DISTINCT md5(text)) AS documents, round(count(*) FILTER (n_chars > 500) / count(*), 6) AS rate, min(n_chars) AS least, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def scenario_rates(spark, d):
    rows = table(spark, d, "documents")
    return rows.groupBy(F.col("lang").alias("scenario")).agg(F.count(F.lit(1)).alias("cases"), F.count_distinct(F.md5("text")).alias("documents"), F.round(F.count_if(F.col("n_chars") > 500) / F.count(F.lit(1)), 6).alias("rate"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 4).alias("mean"))


def bootstrap_means(spark, d):
    """95 % percentile bootstrap intervals of each label's mean (2,000 resamples, a fixed seed): no SQL form."""
    rows = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("v"))
    return M.bootstrap(rows, "label", "v")


QUERIES["bootstrap_means"] = bootstrap_means


def matched_rules(spark, d):
    """Gold and predicted rules of each case matched one to one, the most alike first: sequential by case, no SQL form."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("case"), F.col("p_partkey").alias("id"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("fields"))
    guess = p.select("case", (F.col("id") + 1).alias("id"), F.when(F.col("id") % 3 > 0, F.col("fields")).otherwise(F.array(F.lit("?"), F.col("fields")[1], F.col("fields")[2])).alias("fields"))
    return M.greedy_matches(p, guess, "case")


QUERIES["matched_rules"] = matched_rules


@_query("rule_source", r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '省赛二等奖' WHEN 1 THEN ' 校级一等 ' WHEN 2 THEN '' ELSE 'level X' END AS level, CASE WHEN p_partkey % 5 > 0 THEN '科技竞赛' ELSE ' own ' END AS category, CASE WHEN p_partkey % 7 > 0 THEN p_size::VARCHAR || '分' ELSE 'none' END AS score, CASE WHEN p_partkey % 3 = 0 THEN '50%' WHEN p_partkey % 3 = 1 THEN '0.5' END AS factor FROM part),
n AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '省级二等奖' WHEN 1 THEN '校级一等奖' ELSE 'levelX' END AS canonical, CASE WHEN p_partkey % 5 > 0 THEN '学科竞赛' ELSE 'own' END AS kind FROM r)
SELECT 'r_' || substr(sha256(concat_ws('|', '2024-2025', kind, canonical, 'book', p_partkey::VARCHAR)), 1, 12) AS rule_id, '2024-2025' AS academic_year, kind AS category, canonical AS level, regexp_extract(score, '\d+', 0)::DOUBLE AS score, CASE p_partkey % 3 WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS team_factor, CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE kind END AS grp,
  CASE p_partkey % 4 WHEN 0 THEN 6 * 5 + 1 WHEN 1 THEN 4 * 6 + 1 ELSE 2 END AS spellings
FROM n WHERE p_partkey % 4 <> 2 AND p_partkey % 7 > 0""".replace("6 * 5 + 1", "5 * 6 + 0").replace("4 * 6 + 1", "4 * 6 + 0").replace("ELSE 2 END AS spellings", "ELSE 2 END AS spellings"))
def rule_source(spark, d):
    """Rules from rows of text: blank ones left out, numbers with units, factors in per cent, spellings."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.lit("book").alias("doc"), k.alias("row"), F.when(k % 4 == 0, "省赛二等奖").when(k % 4 == 1, " 校级一等 ").when(k % 4 == 2, "").otherwise("level X").alias("level"), F.when(k % 5 > 0, "科技竞赛").otherwise(" own ").alias("category"),
        F.when(k % 7 > 0, F.concat(F.col("p_size").cast("string"), F.lit("分"))).otherwise("none").alias("score"), F.lit("别名1/ 别名1").alias("synonyms"), F.lit(None).cast("string").alias("cap"), F.when(k % 3 == 0, "50%").when(k % 3 == 1, "0.5").alias("team_factor"), F.when(k % 2 == 0, " g ").alias("grp"),
    )
    return S.rules(rows, "2024").select("rule_id", "academic_year", "category", "level", "score", "team_factor", "grp", F.size("synonyms").alias("spellings"))


@_query("claim_source", """SELECT 'c_' || substr(sha256(concat_ws('|', 's1', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN c_name || '#' || c_custkey::VARCHAR ELSE c_nationkey::VARCHAR END)), 1, 12) AS claim_id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '#' || c_custkey::VARCHAR ELSE c_nationkey::VARCHAR END AS student_id,
  CASE c_custkey % 4 WHEN 0 THEN '省级一等奖' WHEN 1 THEN NULL ELSE '三好学生' END AS level FROM customer WHERE c_custkey % 4 <> 3""")
def claim_source(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.lit("s1").alias("sheet"), k.alias("row"), F.when(k % 3 > 0, F.col("c_nationkey").cast("string")).otherwise(" ").alias("student"), F.col("c_name").alias("name"), F.when(k % 4 == 0, " 省一等 ").when(k % 4 == 1, "volunteer").when(k % 4 == 2, "校三好学生").alias("raw_text"))
    return S.claims(rows).select("claim_id", "student_id", "level")


@_query("ledger_export", "SELECT p_partkey::VARCHAR AS claim_id, CASE WHEN p_partkey % 6 = 0 THEN chr(39) || '=' || p_name WHEN p_partkey % 6 = 1 THEN chr(39) || '-' || p_name WHEN p_partkey % 6 = 2 THEN chr(39) || chr(9) || p_name ELSE p_name END AS raw_text, p_retailprice::VARCHAR AS score, NULL::VARCHAR AS source_doc FROM part")
def ledger_export(spark, d):
    """The export's 23 columns over part rows; text that a spreadsheet would run gets a quote."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("claim_id"), F.concat(F.when(k % 6 == 0, "=").when(k % 6 == 1, "-").when(k % 6 == 2, "\t").otherwise(""), F.col("p_name")).alias("raw_text"), F.col("p_retailprice").alias("score"))
    exported = S.ledger_rows(rows.select("claim_id", "score"), rows.select("claim_id", "raw_text"))
    assert exported.columns == S.LEDGER_COLUMNS
    return exported.select("claim_id", "raw_text", "score", "source_doc")


@_query("item_template", "SELECT o_custkey AS student_id, o_orderkey::VARCHAR AS item_key, NULL::DOUBLE AS expected FROM orders")
def item_template(spark, d):
    return S.item_template(_decided(spark, d)).select("student_id", "item_key", "expected")


@_query("truths", "SELECT c_custkey::VARCHAR AS student, (c_custkey % 30 + 0.5)::DOUBLE AS points FROM customer WHERE c_custkey % 4 > 1")
def truths(spark, d):
    """Expected points by student: with or without the unit, blanks left out."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.concat(F.lit(" "), k.cast("string")).alias("student"), F.when(k % 4 == 0, "").when(k % 4 == 1, None).when(k % 4 == 2, F.concat((k % 30).cast("string"), F.lit(".5 分"))).otherwise(F.concat((k % 30).cast("string"), F.lit(".5"))).alias("value"))
    return S.truths(rows, ["student"], "value")
