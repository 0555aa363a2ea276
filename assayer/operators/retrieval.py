"""Text and vector search of a stated query set against all rows, rank fusion, citation checks and ranking metrics.

Queries are taken in blocks of at most ``QUERY_BLOCK`` rows, so what is sent to
every task has a proven bound; within a block each task scores its own rows
with numpy and keeps the k best of each query, so only (tasks x queries x k)
rows are shuffled. Nothing is joined by term or paired, and no group meets in
one task; scores of a stop word's postings stay where the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions.text import bound
from assayer.session import materialize

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_BLOCK = 4096
#: Scores of at most so many (row, query) pairs are held at once.
CELLS = 1 << 21
_HITS = "query long, id long, score double"


def best_of(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, score of the k best positive scores in each column of ``scores``, ties by id."""
    out: list[tuple] = []
    for q in range(scores.shape[1]):
        column = scores[:, q]
        at = np.flatnonzero(column > 0)
        if len(at) > k:
            least = np.partition(column[at], len(at) - k)[len(at) - k]
            at = at[column[at] >= least]
        at = at[np.lexsort((ids[at], -column[at]))][:k]
        out.append((np.full(len(at), queries[q]), ids[at], column[at]))
    return tuple(np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def top_k(hits: DataFrame, k: int, by: str = "query") -> DataFrame:
    """The k best positive scores of each query by (score desc, id), ranked from 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return hits.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """The queries in blocks, ordered by the first column; never more than one block at a time."""
    rows: list = []
    for row in queries.select(*columns).orderBy(columns[0]).toLocalIterator():
        rows.append(row.asDict(recursive=True))
        if len(rows) == QUERY_BLOCK:
            yield pa.Table.from_pylist(rows)
            rows = []
    if rows:
        yield pa.Table.from_pylist(rows)


def search(rows: DataFrame, queries: DataFrame, columns: list[str], score: Callable[[pa.Table], Callable[[pa.RecordBatch], np.ndarray]], k: int) -> DataFrame:
    """query, id, score, rank: the k best ``rows`` (first column: id) of every query.

    ``score`` makes, from a block of queries, a function from a batch of rows to
    a (rows x queries) matrix of scores.
    """
    found = None
    for block in blocks(queries, columns):
        names = np.array(block.column(0).to_pylist(), np.int64)

        def run(batches: Iterator[pa.RecordBatch], block=block, names=names) -> Iterator[pa.RecordBatch]:
            judge = score(block)
            step = max(1, CELLS // max(1, len(names)))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(best_of(judge(part), ids, names, k), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "score"])

        hits = top_k(rows.mapInArrow(run, _HITS), k)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else rows.sparkSession.createDataFrame([], f"{_HITS}, rank int")


def term_counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch (id, array of tokens): lengths, then row, term and frequency of what it holds of ``terms``."""
    tokens = batch.column(1)
    size = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = pc.index_in(tokens.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    held = at >= 0
    cells, tf = np.unique(row[held] * len(terms) + at[held], return_counts=True)
    return size, cells // len(terms), cells % len(terms), tf


class TermIndex:
    """The terms of a block of queries, and for each term the queries that hold it with their weights."""

    def __init__(self, queries: list[list[tuple[str, float]]]) -> None:
        terms = sorted({t for ts in queries for t, _ in ts})
        place = {t: i for i, t in enumerate(terms)}
        pairs = sorted((place[t], q, w) for q, ts in enumerate(queries) for t, w in ts)
        of_term, self.query, self.weight = (np.array(c) for c in zip(*pairs, strict=True))
        self.first = np.searchsorted(of_term, np.arange(len(terms) + 1))
        self.table, self.width = pa.array(terms, pa.string()), len(queries)

    def spread(self, rows: int, row: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
        """(rows x queries) sums of a part for each (row, term), times the term's weight in each query."""
        many = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cells = np.repeat(row, many) * self.width + self.query[at]
        return np.bincount(cells, np.repeat(part, many) * self.weight[at], minlength=rows * self.width).reshape(rows, self.width)


def statistics(docs: DataFrame, tokens: Column) -> tuple[int, float, DataFrame]:
    """Documents, mean length, and (term, df): one pass; lengths ride on a row without a term."""
    none = F.array(F.lit(None).cast("string"))
    each = bound(tokens, lambda t: F.transform(F.concat(F.array_distinct(t), none), lambda x: F.struct(x.alias("term"), F.when(x.isNull(), F.size(t)).alias("dl"))))
    counts = docs.select(F.explode(each).alias("e")).select("e.*").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length"))
    counts = materialize(counts, "terms")
    total = counts.where("term is null").select("df", "length").first()
    n, length = (total["df"], total["length"]) if total else (0, 0)
    return n, (length / n if n and length else 1.0), counts.where("term is not null").select("term", "df")


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, query_col: str, doc_tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """query, id, score (9 places), rank by Okapi BM25.

    Inverse document frequencies below zero become epsilon times the mean over
    all terms of the corpus, as in the public Okapi implementation.
    """
    n, mean_length, counts = statistics(docs, doc_tokens)
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean_idf = counts.agg(F.avg(raw)).first()[0] or 0.0
    asked = queries.select(F.col(query_col).alias("query"), F.explode(query_tokens).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = asked.join(counts, "term").select("query", "term", (F.col("qtf") * F.when(raw < 0, EPSILON * mean_idf).otherwise(raw)).alias("w"))
    packed = weighed.groupBy("query").agg(F.collect_list(F.struct("term", "w")).alias("terms"))

    def score(block: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray]:
        index = TermIndex([[(t["term"], t["w"]) for t in ts] for ts in block.column("terms").to_pylist()])

        def judge(batch: pa.RecordBatch) -> np.ndarray:
            length, row, term, tf = term_counts(batch, index.table)
            return np.round(index.spread(batch.num_rows, row, term, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean_length))), 9)

        return judge

    return search(docs.select(F.col(id_col).cast("long").alias("id"), doc_tokens.alias("t")), packed, ["query", "terms"], score, k)


def overlap(docs: DataFrame, queries: DataFrame, id_col: str, query_col: str, doc_tokens: Column, query_tokens: Column, k: int) -> DataFrame:
    """query, id, score, rank by how often a document holds the query's distinct terms."""
    packed = queries.select(F.col(query_col).alias("query"), F.array_distinct(query_tokens).alias("terms")).where("size(terms) > 0")

    def score(block: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray]:
        index = TermIndex([[(t, 1.0) for t in ts] for ts in block.column("terms").to_pylist()])

        def judge(batch: pa.RecordBatch) -> np.ndarray:
            _, row, term, tf = term_counts(batch, index.table)
            return index.spread(batch.num_rows, row, term, tf.astype(np.float64))

        return judge

    return search(docs.select(F.col(id_col).cast("long").alias("id"), doc_tokens.alias("t")), packed, ["query", "terms"], score, k)


def vectors(rows: DataFrame, queries: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """query, id, score, rank of (id, vector) rows by 1 / (1 + squared distance), 9 places."""

    def score(block: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray]:
        names = np.array(block.column(0).to_pylist(), np.int64)
        asked = np.array(block.column(1).to_pylist(), np.float64)

        def judge(batch: pa.RecordBatch) -> np.ndarray:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            out = np.empty((len(values), len(asked)))
            for q, one in enumerate(asked):  # differences, not the expanded square: no cancellation
                out[:, q] = ((values - one) ** 2).sum(axis=1)
            out = np.round(1.0 / (1.0 + out), 9)
            if skip_self:
                out[batch.column(0).to_numpy()[:, None] == names[None, :]] = 0.0
            return out

        return judge

    return search(rows, queries, queries.columns, score, k)


def hash_embedding(tokens: Column, dimensions: int = 256) -> Column:
    """Unit vectors of signed feature hashes: a token's slot and sign are parts of its 64-bit BLAKE2b."""

    def embed(lists):
        import pandas as pd

        def one(items):
            out = np.zeros(dimensions)
            for token in items if items is not None else []:
                digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
                out[int.from_bytes(digest[:4], "big") % dimensions] += 1.0 if digest[4] & 1 else -1.0
            norm = float(np.sqrt((out**2).sum()))
            return (out / norm if norm else out).tolist()

        return pd.Series([one(items) for items in lists])

    return F.pandas_udf(embed, "array<double>")(tokens)


def eligible(own: Column, asked: Column) -> Column:
    """Metadata must agree only where both sides have it."""
    return own.isNull() | asked.isNull() | (own == asked)


def rank_fusion(channels: dict[str, DataFrame], k: int, rrf_k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query, id, score, rank and a map of the channels' own ranks: weighted reciprocal ranks, the k best."""
    weights = weights or {}
    parts = [hits.select("query", "id", "rank", F.lit(name).alias("channel"), F.lit(float(weights.get(name, 1.0))).alias("w")) for name, hits in channels.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fused = every.groupBy("query", "id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 12).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("component_ranks"))
    return top_k(fused, k)


def rerank(base: DataFrame, judged: DataFrame, k: int, weight: float = 4.0, rrf_k: int = 60) -> DataFrame:
    """query, id, score, rank: ``base`` (query, id, rank) fused with the order of a second judge's scores (query, id, judge)."""
    order = Window.partitionBy("query").orderBy(F.desc("judge"), "base", "id")
    both = base.select("query", "id", F.col("rank").alias("base")).join(judged, ["query", "id"]).withColumn("ce", F.row_number().over(order))
    fused = both.select("query", "id", F.round(weight / (rrf_k + F.col("base")) + 1.0 / (rrf_k + F.col("ce")), 12).alias("score"))
    return top_k(fused, k)


def citations(hits: DataFrame, both: tuple[str, str], most: int = 5) -> DataFrame:
    """query, disposition and ids: hits that may be cited for their query, for a person to confirm.

    ``hits`` (query, id, rank, component_ranks, located, overlap, topics): both
    channels and one common token or topic, or the first channel alone and two
    common tokens; none: refuse.
    """
    ranks = F.col("component_ranks")
    dual = F.map_contains_key(ranks, both[0]) & F.map_contains_key(ranks, both[1]) & ((F.col("overlap") > 0) | F.col("topics"))
    lexical = (F.size(ranks) == 1) & F.map_contains_key(ranks, both[0]) & (F.col("overlap") >= 2)
    good = hits.where(F.col("located") & (dual | lexical)).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= most)
    cited = good.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids"))
    every = hits.select("query").distinct().join(cited, "query", "left")
    return every.select("query", F.when(F.col("ids").isNull(), "refuse").otherwise("manual_review").alias("disposition"), F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def rank_metrics(hits: DataFrame, k: int = 10) -> DataFrame:
    """query, hit5, rr10, ndcg10 of ranked hits with a boolean ``relevant`` and ``n_relevant``."""
    rel = F.col("relevant") & (F.col("rank") <= k)
    gain = F.sum(F.when(rel, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.max("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return hits.groupBy("query").agg(
        F.max((F.col("relevant") & (F.col("rank") <= 5)).cast("int")).alias("hit5"),
        F.round(F.coalesce(F.lit(1.0) / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)), 9).alias("rr10"),
        F.round(gain / ideal, 9).alias("ndcg10"),
    )
