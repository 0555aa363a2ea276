"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

Every document gets base counts (words, symbols, repeated lines, words in
repeated 3-word windows) and a score: the mean, over its n-grams, of
log p(n-gram | trusted target) - log p(n-gram | raw corpus). The n-grams are
the single tokens and the pairs of neighbouring tokens of the whole text (the
last token is paired with the end), hashed (XXH64) into a fixed number of
buckets; a token is a run of letters, marks and digits or a run of other
characters, so symbols count wherever in a word they are glued. The raw side
counts every n-gram of every document, the target side those of all documents
labelled good. Both multinomials get the same mass for each bucket, one n-gram
of the target (``log((t + 1) / (r * T / R + 1))``), so what is seldom seen
speaks for neither side, however large the raw side is. The mean makes scores
of short and long texts comparable, and each document is compared with one
fixed threshold, in whole numbers (the ratios are rounded to 2^-20), so reruns
agree to the bit.

The bucket table has a fixed size, so it can be sent to every task as a
literal. Only built-in functions are used: counting joins labels to texts,
which are smaller than their arrays of bucket numbers, scoring is a projection.
Rows without an id find no label and are counted without the join.

Defined results: a null text has no words and fails the base rules; a null id
is scored but matches no label; a document labelled both ways counts as good if
any row says so; without a good label at all every score is zero; a score equal
to the threshold keeps; repeated rows count as often as they occur; texts of any
length are read whole (a task holds the tokens of one text); an empty table
gives an empty table. Columns of the input that are named like a result are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.words import ascii_count, let, unused, word_chars, words_of
from assayer.session import table

BUCKETS = 1 << 15
SCALE = 1 << 20
#: Nats for each n-gram. Documents of the trusted side score about 0, those with symbols at every word about -1.
THRESHOLD = -0.6
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


#: A run of letters, marks and digits, or of anything else but white space.
TOKEN = "[\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def buckets_of(text: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of every token and of every pair of neighbours (the last one's is the end)."""
    single = lambda t: _bucket(buckets, t)
    return let(tokens_of(text), lambda w: F.concat(F.transform(w, single), F.transform(w, lambda t, i: _bucket(buckets, F.lit(2), t, F.get(w, i + 1)))))


def ratio_sum(text: Column, lookup: Column, buckets: int) -> Column:
    """Struct of ``sum`` (of the scaled ratios of all n-grams) and ``grams`` (their number)."""
    each = lambda w: F.transform(w, lambda t, i: F.get(lookup, _bucket(buckets, t)) + F.get(lookup, _bucket(buckets, F.lit(2), t, F.get(w, i + 1))))
    total = lambda w: F.aggregate(each(w), F.lit(0).cast("long"), lambda s, x: s + x)
    return let(tokens_of(text), lambda w: F.struct(total(w).alias("sum"), (2 * F.size(w)).cast("long").alias("grams")))


@dataclass(frozen=True)
class RatioModel:
    """Scaled log ratios by bucket, and the threshold on their mean."""

    ratios: tuple[int, ...]
    threshold: float = THRESHOLD

    def lookup(self) -> Column:
        """The table as one array literal (parsed once, when the plan is optimized)."""
        return F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<bigint>")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> RatioModel:
    """Count both multinomials over all of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("good")).distinct()
    texts = docs.select("doc_id", "text")
    named = texts.where("doc_id is not null").join(good.hint("merge"), "doc_id", "left")  # labels grow with the corpus: one plan for every size
    counts = (
        named.unionByName(texts.where("doc_id is null").withColumn("good", F.lit(False)))
        .select(F.explode(buckets_of(F.col("text"), buckets)).alias("bucket"), F.coalesce("good", F.lit(False)).alias("good"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.toLocalIterator():  # at most one row for each bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return RatioModel(ratios(raw, target), threshold)


def ratios(raw: list[int], target: list[int]) -> tuple[int, ...]:
    """Scaled log ratio of each bucket; zeros without a target."""
    if not sum(target):
        return (0,) * len(raw)
    share = sum(target) / sum(raw)
    return tuple(round(SCALE * (math.log(t + 1) - math.log(r * share + 1))) for r, t in zip(raw, target, strict=True))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more (``words`` must be bound by ``let``)."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            placed,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def judge(docs: DataFrame, model: RatioModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, the mean ratio ``score`` and kept."""
    text = docs[text_col]
    names = [c for c in docs.columns if c not in RESULT_COLUMNS or c == text_col]
    lookup = model.lookup()
    # one value holds all that needs the words: a filter on it that the optimizer
    # moves down then carries one expression, not one for each use of the words
    counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            repeated_words(w).alias("again"),
            ratio_sum(text, lookup, len(model.ratios)).alias("ratio"),
        ),
    )
    limit = F.lit(math.floor(model.threshold * SCALE)).cast("long")
    held = unused(docs.columns, "__verdict")

    def verdict(c: Column) -> Column:
        failed = (c["n"] < MIN_WORDS) | (100 * c["again"] > MAX_REPEAT_PERCENT * c["n"])
        total, grams = c["ratio"]["sum"], c["ratio"]["grams"]
        score = F.when(grams > 0, total / grams / SCALE).otherwise(0.0)
        return F.struct(
            c["n"].alias("n_words"), c["again"].alias("n_repeat_words"), failed.alias("base_failed"),
            score.alias("score"), (~failed & (total >= limit * grams)).alias("kept"),
        )

    judged = docs.select(
        *[docs[c] for c in names],
        word_chars(text).alias("word_chars"),
        ascii_count(text, SYMBOLS).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        let(counts, verdict).alias(held),
    )
    v = F.col(held)
    return judged.select(
        *names, v["n_words"].alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", v["n_repeat_words"].alias("n_repeat_words"),
        v["base_failed"].alias("base_failed"), v["score"].alias("score"), v["kept"].alias("kept"),
    )


RESULT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text", "score")


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
