"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``MAX_COPIES`` that make each source
give its target number of words, the one closest to "each document once" in
relative entropy is an exponential tilt: rate = min(MAX_COPIES, exp(lambda_s * x)),
x being the document's words over its source's mean. lambda solves the convex
dual, one equation for each source, by Newton's method kept inside a shrinking
bracket. All sources step together: an iteration is one aggregation over
(source, size, number of documents) cells, whose number is bounded by sources
times distinct sizes however many documents share them, and the iterates stay
in tables. Sums are whole numbers (fixed point), so neither the order of a
shuffle nor a lost executor changes a bit of the result.

Rates become whole copies by systematic rounding along falling size, then
small documents take up what is left of the target as far as whole copies can:
what remains is less than the smallest document that still has room. Documents
of one cell are ordered by a hash of the id, dealt by a hash of the whole row to
``SALTS`` parts of the cell, so a third of all rows in one source, of one size or
with one id is no single task's work.

Targets: source k in code-point order (null last) has weight WEIGHTS[k mod 3];
the sources share ``share`` times all words; a target stops at MAX_COPIES times
its source's words and the excess is shared again by weight until none is above
(the fixed point: min(cap, level * weight)). The only single-task step sorts
one row for each source.

Defined results: a null text has size 0, is taken once at rate 1 and adds no
words; a null source is a source of its own; null or repeated ids are separate
rows, and equal rows may differ in copies; a corpus without words has targets
0; rows that are equal in every column are interchangeable; texts count by their
words, however long; an empty table gives an empty table; input columns named
like a result are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.words import row_hash, word_count
from assayer.session import discard, materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SALTS = 256
#: Fixed point of sums and rates.
_ONE = 1 << 20
_TOLERANCE = 1e-7
#: Newton inside a halving bracket needs about a dozen steps; beyond this many something is wrong, and ``solve`` raises.
_MAX_STEPS = 200


def _source_key(col: Column) -> Column:
    """Null sources compare and group like any other: a text that no source has."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), col))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """sk, source_size, target for ``sources`` (sk, source_size): capped shares by weight."""
    order = Window.orderBy(F.col("sk") == "", "sk")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", (MAX_COPIES * F.col("source_size")).cast("long"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "sk")
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / behind)
    # the sources are filled up in order of cap / weight; the first that its level doesn't fill sets the level of all
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sk", "level"))).over(everything)
    return levels.withColumn("common", level["level"]).select(
        "sk", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double"))).alias("target")
    )


def _rate(lam: Column, x: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(lam * x))


def _fixed_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(F.round(value * _ONE).cast("decimal(38,0)")).cast("double") / _ONE


def solve(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """sk, source_size, target, mean, lam: the tilt of each source.

    ``cells``: sk, size, n. ``sources``: sk, source_size, target, mean, least_size.
    """
    positive = cells.where("size > 0")
    x_least = F.col("least_size") / F.col("mean")
    up = F.col("target") > F.col("source_size")
    state = sources.where("source_size > 0").select(
        "sk", "source_size", "target", "mean", F.lit(0.0).alias("lam"),
        F.when(up, F.lit(0.0)).otherwise(-F.log(F.col("source_size") / F.col("target")) / x_least).alias("lo"),
        F.when(up, F.log(F.lit(float(MAX_COPIES))) / x_least).otherwise(F.lit(0.0)).alias("hi"),
        F.lit(1.0).alias("error"),
    )
    state = materialize(state, "tilt")
    x = F.col("size") / F.col("mean")
    rate, words = _rate(F.col("lam"), x), F.col("n") * F.col("size")
    names = ("sk", "source_size", "target", "mean", "lam", "lo", "hi")
    for _ in range(_MAX_STEPS):
        sums = (
            positive.join(state, "sk")
            .groupBy(*names)
            .agg(_fixed_sum(words * rate).alias("got"), _fixed_sum(F.when(rate < MAX_COPIES, words * x * rate).otherwise(0.0)).alias("slope"), F.count(F.lit(1)).alias("terms"))
        )
        off = F.col("got") - F.col("target")
        narrowed = sums.select(
            "sk", "source_size", "target", "mean", "lam", off.alias("off"), "slope", "terms",
            F.when(off < 0, F.col("lam")).otherwise(F.col("lo")).alias("lo"), F.when(off > 0, F.col("lam")).otherwise(F.col("hi")).alias("hi"),
        )
        newton = F.col("lam") - F.col("off") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = F.coalesce((newton >= F.col("lo")) & (newton <= F.col("hi")), F.lit(False))
        slack = _TOLERANCE * F.col("target") + F.col("terms") / _ONE  # each term of a sum is rounded
        done = F.abs("off") <= slack
        step = F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = materialize(narrowed.select("sk", "source_size", "target", "mean", step.alias("lam"), "lo", "hi", (F.abs("off") / slack).alias("error")), "tilt")
        discard(state)
        state = after
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= 1:
            return state.select("sk", "source_size", "target", "mean", "lam")
    raise RuntimeError(f"entropy balancing is still off by {worst} tolerances after {_MAX_STEPS} steps")


def _round_copies(cells: DataFrame, tilts: DataFrame) -> DataFrame:
    """sk, size, n, copies: whole copies for each cell, near the target in words."""
    joined = cells.join(tilts.select("sk", "target", "mean", "lam"), "sk", "left")
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"))).otherwise(1.0)
    wanted = joined.withColumn("q", F.round(F.col("n") * rate * _ONE).cast("long"))
    falling = Window.partitionBy("sk").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.sum("q").over(falling)
    half = _ONE // 2
    copies = F.floor((through + half) / _ONE) - F.floor((through - F.col("q") + half) / _ONE)
    rounded = wanted.withColumn("copies", copies.cast("long"))
    source = Window.partitionBy("sk")
    left = F.round(F.coalesce("target", F.lit(0.0))).cast("long") - F.sum(F.col("copies") * F.col("size")).over(source)
    rounded = rounded.withColumn("left", left)
    room = F.when(F.col("left") > 0, MAX_COPIES * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    rounded = rounded.withColumn("room", F.when(F.col("size") > 0, room).otherwise(0))
    rising = Window.partitionBy("sk").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(F.col("room") * F.col("size")).over(rising) - F.col("room") * F.col("size")
    fit = F.floor((F.abs("left") - before) / F.nullif(F.col("size"), F.lit(0)))
    change = F.greatest(F.lit(0), F.least(F.col("room"), F.coalesce(fit, F.lit(0)))) * F.signum("left")
    return rounded.withColumn("change", change.cast("long")).select("sk", "size", "n", (F.col("copies") + F.col("change")).alias("copies"))


def mix(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies * size).

    Rows are shuffled once, by cell; what decides their copies is a table of cells.
    """
    names = [c for c in docs.columns if c not in RESULT_COLUMNS or c in (id_col, source_col)]
    keyed = docs.select(  # the caller's columns in one struct, so that no name of theirs meets one of the plan's
        F.struct(*[docs[f"`{c}`"] for c in names]).alias("doc"), docs[id_col].alias("id"), size.cast("long").alias("size"), _source_key(docs[source_col]).alias("sk"), row_hash(docs).alias("row"),
    ).withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    parts = materialize(keyed.groupBy("sk", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "parts")
    cells = materialize(parts.groupBy("sk", "size").agg(F.sum("n").alias("n")), "cells")
    sources = cells.groupBy("sk").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size")
    )
    targets = materialize(
        source_targets(sources.select("sk", "source_size"), weights, share)
        .join(sources.select("sk", "docs", "least_size"), "sk")
        .withColumn("mean", F.col("source_size") / F.col("docs")),
        "targets",
    )
    rounded = _round_copies(cells, solve(cells, targets))
    plan = parts.select("sk", "size", "salt", F.col("n").alias("part")).join(rounded, ["sk", "size"]).join(targets.select("sk", "source_size", "target"), "sk")
    extra = F.col("copies") % F.col("n")
    along = Window.partitionBy("sk", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.sum("part").over(along)
    share_of = lambda count: F.floor(count * extra / F.col("n"))
    plan = materialize(
        plan.select(
            "sk", "size", "salt", "source_size", "target", F.expr("copies div n").alias("base"),
            (share_of(through) - share_of(through - F.col("part"))).cast("long").alias("extra"),
        ),
        "copies",
    )
    rank = F.row_number().over(Window.partitionBy("sk", "size", "salt").orderBy(F.xxhash64(F.lit(1), "id"), "id", "row"))
    copies = (F.col("base") + (F.col("rank") <= F.col("extra")).cast("int")).cast("long")
    return (
        keyed.withColumn("rank", rank)
        .join(plan, ["sk", "size", "salt"])
        .select("doc.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )


RESULT_COLUMNS = ("size", "source_size", "target", "copies", "taken")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    sized = materialize(docs, "sized")
    return mix(sized, sized["words"]).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
