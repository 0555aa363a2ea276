"""Search queries: benchmark passages against documents, every fiftieth vector against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.operators import retrieval as R
from assayer.session import materialize, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_TOKENS = r"regexp_extract_all(lower(regexp_replace(text, '\s+', '', 'g')), '[a-z]+|\d+(?:\.\d+)?')"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}]+')"
_BM25 = """docs AS (SELECT doc_id AS id, {tokens} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
posts AS (SELECT id, len(t) AS dl, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM docs) GROUP BY id, t, term),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
terms AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({tokens}) AS term FROM benchmark) GROUP BY 1, 2),
hits AS (SELECT query, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM terms JOIN idf USING (term) JOIN posts USING (term), stats GROUP BY query, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM hits WHERE score > 0),
plain AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, sum(tf)::DOUBLE AS score FROM terms JOIN posts USING (term) GROUP BY query, id))"""
_FETCH = 15  # three times the five that are asked for


def _words(c):
    return F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}]+"), F.lit(0))


def _bm25(spark, d, tokens, k):
    text = F.col("text")
    return R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", tokens(text), tokens(text), k)


@_query("bm25_topk", f"WITH {_BM25.format(tokens=_TOKENS)} SELECT query, id, round(score, 4) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark, d):
    """By the search tokens of rules: runs of letters after white space is dropped, numbers, CJK characters and pairs."""
    return _bm25(spark, d, T.search_tokens, 10).select("query", "id", F.round("score", 4).alias("score"), "rank")


@_query("bm25_words", f"WITH {_BM25.format(tokens=_WORDS)} SELECT query, id, round(score, 4) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def bm25_words(spark, d):
    """By words of letters of any script."""
    return _bm25(spark, d, _words, 10).select("query", "id", F.round("score", 4).alias("score"), "rank")


_FUSED = f"""{_BM25.format(tokens=_WORDS)}, every AS (SELECT query, id, rank, 'bm25' AS channel, 1.0::DOUBLE AS w FROM ranked WHERE rank <= {_FETCH} UNION ALL SELECT query, id, rank, 'plain', 0.5::DOUBLE FROM plain WHERE rank <= {_FETCH}),
fused AS (SELECT query, id, round(sum(w / (60 + rank)), 12) AS score, max(CASE WHEN channel = 'bm25' THEN rank END)::INTEGER AS bm25_rank, max(CASE WHEN channel = 'plain' THEN rank END)::INTEGER AS plain_rank FROM every GROUP BY query, id),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM fused QUALIFY rank <= 5)"""


def _fused(spark, d):
    docs, queries, text = table(spark, d, "documents"), table(spark, d, "benchmark"), F.col("text")
    plain = R.overlap(docs, queries, "doc_id", "item_id", _words(text), _words(text), _FETCH)
    return R.rank_fusion({"bm25": _bm25(spark, d, _words, _FETCH), "plain": plain}, 5, weights={"plain": 0.5})


@_query("rrf_fuse", f"WITH {_FUSED} SELECT query, id, score, rank, bm25_rank, plain_rank FROM best")
def rrf_fuse(spark, d):
    ranks = F.col("component_ranks")
    return _fused(spark, d).select("query", "id", "score", "rank", ranks["bm25"].alias("bm25_rank"), ranks["plain"].alias("plain_rank"))


@_query("citation_gate", f"""WITH {_FUSED}, long AS (SELECT DISTINCT query, term FROM terms WHERE length(term) >= 2), common AS (SELECT b.query, b.id, b.rank, bm25_rank, plain_rank, count(l.term) AS overlap FROM best b LEFT JOIN posts p ON p.id = b.id LEFT JOIN long l ON l.query = b.query AND l.term = p.term GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM common WHERE id % 4 > 0 AND (bm25_rank IS NOT NULL AND plain_rank IS NOT NULL AND overlap > 0 OR bm25_rank IS NOT NULL AND plain_rank IS NULL AND overlap >= 2))
SELECT b.query, CASE WHEN count(g.id) = 0 THEN 'refuse' ELSE 'manual_review' END AS disposition, coalesce(string_agg(g.id::VARCHAR, ',' ORDER BY g.place), '') AS ids FROM (SELECT DISTINCT query FROM best) b LEFT JOIN good g ON b.query = g.query AND g.place <= 3 GROUP BY b.query""")
def citation_gate(spark, d):
    """Which of the fused hits may be cited: a precise place (here three of four documents), enough common words."""
    hits = materialize(_fused(spark, d), "hits")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _words(F.col("text")).alias("t")).join(hits.select("id").distinct(), "id", "left_semi")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.filter(F.array_distinct(_words(F.col("text"))), lambda w: F.length(w) >= 2).alias("q"))
    rows = hits.join(docs, "id").join(asked, "query").select("query", "id", "rank", "component_ranks", (F.col("id") % 4 > 0).alias("located"), F.size(F.array_intersect("q", "t")).alias("overlap"), F.lit(False).alias("topics"))
    return R.citations(rows, ("bm25", "plain"), 3).select("query", "disposition", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@_query("eligible_hits", f"""WITH {_BM25.format(tokens=_WORDS)} SELECT query, r.id, r.rank::INTEGER AS rank FROM ranked r JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang FROM documents) m ON r.id = m.id
 WHERE r.rank <= 20 AND (query % 3 = 0 OR m.lang IS NULL OR m.lang = CASE WHEN query % 3 = 1 THEN 'en' ELSE 'de' END)""")
def eligible_hits(spark, d):
    """Hits whose language agrees with the asked one, where both are known."""
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("lang"))
    asked = F.when(F.col("query") % 3 == 1, "en").when(F.col("query") % 3 == 2, "de")
    return _bm25(spark, d, _words, 20).join(own, "id").where(R.eligible(F.col("lang"), asked)).select("query", "id", "rank")


_VEC = """sims AS (SELECT q.vec_id AS query, e.vec_id AS id, q.label AS ql, e.label AS el, round(1 / (1 + list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sims)"""


def _nearest(spark, d, k):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.vectors(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding"), k)


@_query("vector_topk", f"WITH {_VEC} SELECT query, id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def vector_topk(spark, d):
    return _nearest(spark, d, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


def _labelled(spark, d, k):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    same = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    hits = _nearest(spark, d, k).join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("el")), "id")
    return hits.withColumn("relevant", F.col("ql") == F.col("el")).join(same.withColumnRenamed("label", "ql"), "ql")


_METRICS = f"""{_VEC}, rel AS (SELECT query, count(*) FILTER (ql = el) AS n FROM sims GROUP BY query), metrics AS (
SELECT query, max(CASE WHEN ql = el AND rank <= 5 THEN 1 ELSE 0 END)::INTEGER AS hit5, round(coalesce(1.0::DOUBLE / min(rank) FILTER (ql = el AND rank <= 10), 0), 9) AS rr10,
  round(coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (ql = el AND rank <= 10), 0) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg10
FROM ranked JOIN rel USING (query) GROUP BY query)"""


@_query("rank_metrics", f"WITH {_METRICS} SELECT * FROM metrics")
def rank_metrics(spark, d):
    return R.rank_metrics(_labelled(spark, d, 10))


@_query("ablation", f"""WITH {_METRICS}, m AS (SELECT avg(hit5) AS a, avg(rr10) AS b, avg(ndcg10) AS c FROM metrics), v AS (SELECT * FROM (SELECT 1 AS k, 'hit5' AS metric, a AS v FROM m UNION ALL SELECT 2, 'rr10', b FROM m UNION ALL SELECT 3, 'ndcg10', c FROM m))
SELECT metric, round(v, 6) AS mean, round(v - lag(v) OVER (ORDER BY k), 6) AS change FROM v""")
def ablation(spark, d):
    """Mean of each metric over all queries and its change against the one before (three constant rows)."""
    from pyspark.sql.window import Window

    names = ["hit5", "rr10", "ndcg10"]
    means = R.rank_metrics(_labelled(spark, d, 10)).agg(*[F.avg(n).alias(n) for n in names])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("metric"), F.col(n).alias("v")) for k, n in enumerate(names)])).alias("r")).select("r.*")
    return rows.select("metric", F.round("v", 6).alias("mean"), F.round(F.col("v") - F.lag("v").over(Window.orderBy("k")), 6).alias("change"))


@_query("rerank_fuse", """WITH e AS (SELECT label AS query, vec_id AS id, round(100 + list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) AS a, round(list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) AS judge FROM embeddings),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY a DESC, id) AS base FROM e QUALIFY base <= 20), c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY judge DESC, base, id) AS ce FROM b)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(4.0::DOUBLE / (60 + base) + 1.0::DOUBLE / (60 + ce), 12) DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 10""")
def rerank_fuse(spark, d):
    """A first order by one half of each vector, judged again by the other half."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    e = table(spark, d, "embeddings").select(
        F.col("label").alias("query"), F.col("vec_id").alias("id"), F.round(100 + total(F.slice("embedding", 1, 32)), 6).alias("score"), F.round(total(F.slice("embedding", 33, 32)), 6).alias("judge")
    )
    return R.rerank(R.top_k(e, 20), e.select("query", "id", "judge"), 10).select("query", "id", "rank")


def hash_embeddings(spark, d):
    """Feature-hashed vectors of all benchmark texts (BLAKE2b has no SQL form: tested by definition)."""
    return table(spark, d, "benchmark").select("item_id", R.hash_embedding(T.search_tokens(F.col("text")), 64).alias("embedding"))


QUERIES["hash_embeddings"] = hash_embeddings
