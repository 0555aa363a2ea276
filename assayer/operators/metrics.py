"""Rates with confidence intervals, confusion counts, percentiles, cost reports."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.session import materialize

Z = 1.959963984540054
#: Up to so many choices of places are looked up one by one when rules are matched.
SUBSETS = 64


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson score interval, clamped to [0, 1]; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    middle, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    return F.round(F.greatest(F.lit(0.0), (middle - spread) / scale), 6), F.round(F.least(F.lit(1.0), (middle + spread) / scale), 6)


def confusion(rows: DataFrame, by: list[str], truth: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 for each group; zero where undefined."""
    counts = rows.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")
    )
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp = F.col("tp")
    return counts.select(
        "*", ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1")
    )


def cost_report(events: DataFrame, by: list[str]) -> DataFrame:
    """Requests, calls, failures, hits, tokens, money, materials, subjects and ratios (null without a denominator).

    ``events``: model, purpose, subject, material, external, cache_hit, status,
    tokens_in, tokens_out, cost, strong. Money is there only if every
    successful call has its price.
    """
    n, ok = F.count(F.lit(1)), F.col("external") & (F.col("status") == "ok")
    good = F.count_if(ok)
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    secondary = ok & (F.col("purpose") == "rule_extraction_secondary")
    return events.groupBy(*by).agg(
        n.alias("requests"), F.count_if("external").alias("external_calls"), F.count_if(F.col("external") & (F.col("status") == "error")).alias("failures"), F.count_if("cache_hit").alias("cache_hits"), share(F.count_if("cache_hit"), n).alias("hit_rate"),
        share(F.count_if(ok & F.col("tokens_in").isNotNull()), good).alias("usage_coverage"), total("tokens_in").alias("input_tokens"), total("tokens_out").alias("output_tokens"),
        F.when((good > 0) & (F.count_if(ok & F.col("cost").isNull()) == 0), F.round(F.sum(F.when(ok, F.col("cost"))), 8)).alias("cost"), F.count_distinct("material").alias("materials"), F.count_distinct("subject").alias("subjects"),
        share(F.count_if(ok & F.col("strong")), good).alias("strong_ratio"), share(F.count_if(secondary), F.count_if(ok & F.col("purpose").startswith("rule_extraction"))).alias("secondary_ratio"),
    )


def token_usage(rows: DataFrame, body: str) -> DataFrame:
    """``rows`` with input_tokens, output_tokens, total_tokens and source: the first of three shapes of response that reports any; never a guess."""
    v = F.try_parse_json(body)

    def whole(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        number = F.try_variant_get(v, path, "double")
        return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when((number >= 0) & (number == F.floor(number)), number.cast("long")))

    def shape(at: str, *names: str) -> Column:
        first, second, third = (F.coalesce(*[whole(f"$.{at}.{n}") for n in name.split("|")]) for name in names)
        return F.when(first.isNotNull() | second.isNotNull() | third.isNotNull(), F.struct(first.alias("i"), second.alias("o"), third.alias("t"), F.lit({"usage_metadata": "usage_metadata", "usage": "mapping"}.get(at, "response_metadata")).alias("s")))

    both = ("prompt_tokens|input_tokens", "completion_tokens|output_tokens", "total_tokens")
    found = F.coalesce(shape("usage_metadata", "input_tokens", "output_tokens", "total_tokens"), shape("response_metadata.token_usage", *both), shape("usage", *both))
    held = rows.withColumn("__usage", found)
    u = F.col("__usage")
    return held.select(*rows.columns, u["i"].alias("input_tokens"), u["o"].alias("output_tokens"), u["t"].alias("total_tokens"), F.coalesce(u["s"], F.lit("missing")).alias("source"))


def field_scores(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """field (and ``micro`` over all), tp, fp, fn, precision, recall, f1 of (wanted, got) pairs; null is absent."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(w).alias("w"), F.col(g).alias("g")) for f, (w, g) in fields.items()]))
    flat = rows.select(pairs.alias("p")).select("p.*")
    same = F.coalesce(F.col("w") == F.col("g"), F.lit(False))
    counts = flat.rollup("field").agg(F.count_if(same).alias("tp"), F.count_if(F.col("g").isNotNull() & ~same).alias("fp"), F.count_if(F.col("w").isNotNull() & ~same).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(F.coalesce("field", F.lit("micro")).alias("field"), "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def exact_rows(gold: DataFrame, predicted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """n, exact and rate of rows that agree in every field, aligned by ``key``; another number of rows, or an unknown key, is an error."""
    guess = predicted.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__got"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    both = gold.withColumn("__want", F.lit(True)).join(guess, key, "full_outer")
    lost = F.count_if(F.col("__want").isNull() | F.col("__got").isNull())
    checked = F.when(lost > 0, F.raise_error(F.lit("gold and predicted rows don't align"))).otherwise(F.count_if(same))
    return both.agg(F.count(F.lit(1)).alias("n"), checked.cast("long").alias("exact")).select("n", "exact", F.round(F.col("exact") / F.col("n"), 6).alias("rate"))


def order_statistics(rows: DataFrame, by: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at given places (from 1, as a function of the group's size) of each group's order.

    Equal values are counted first; running counts come from a range partition:
    each part's totals are summed, so no group's values meet in one task.
    """
    counts = materialize(rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "values")
    sizes = counts.groupBy(by, "part").agg(F.sum("c").alias("held"))
    ahead = Window.partitionBy(by).orderBy("part")
    starts = sizes.select(by, "part", (F.sum("held").over(ahead) - F.col("held")).alias("start"), F.sum("held").over(Window.partitionBy(by)).alias("n"))
    inside = Window.partitionBy(by, "part").orderBy(value)
    placed = counts.join(starts, [by, "part"]).withColumn("through", F.col("start") + F.sum("c").over(inside))
    at = lambda f: (F.col("through") - F.col("c") < f(F.col("n"))) & (f(F.col("n")) <= F.col("through"))
    return placed.groupBy(by).agg(*[F.max(F.when(at(f), F.col(value))).alias(name) for name, f in places.items()])


def bootstrap(rows: DataFrame, by: str, value: str, resamples: int = 2000, seed: int = 20250912) -> DataFrame:
    """``by``, mean, low and high: percentile bootstrap of each group's mean.

    Resampling n values with replacement is a multinomial over its distinct
    values, so a group is its counts; each resample draws from the group's own
    seeded generator, in order of value. A group's distinct values are one task's.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(value)
        v, c = pdf[value].to_numpy(float), pdf["c"].to_numpy()
        n = int(c.sum())
        means = np.sort(np.random.default_rng(seed).multinomial(n, c / n, resamples) @ v / n)
        low, high = means[int(np.ceil(0.025 * resamples)) - 1], means[int(np.ceil(0.975 * resamples)) - 1]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [round(float(c @ v / n), 6)], "low": [round(float(low), 6)], "high": [round(float(high), 6)]})

    return counts.groupBy(by).applyInPandas(one, f"`{by}` {rows.schema[by].dataType.simpleString()}, mean double, low double, high double")


def greedy_matches(gold: DataFrame, predicted: DataFrame, case: str) -> DataFrame:
    """case, gold id, predicted id and agreement of rules (case, id, fields) matched one to one inside each case.

    Pairs with the highest share of the gold rule's fields that are equal go
    first (ties: smallest ids, null last); pairs without a common field, null
    fields and null cases never match; of rows with one id the best matches. The
    sequential step of a case holds its rules and never lists their pairs (``_match``).
    """
    sides = [d.where(F.col(case).isNotNull()).select(case, F.col("id").alias(n), F.col("fields").alias(f"{n}_fields")) for d, n in ((gold, "g"), (predicted, "p"))]
    kinds = {f.name: f.dataType.simpleString() for side in sides for f in side.schema.fields}

    def one(left, right):
        import pyarrow as pa

        g, p, agreement = _match(*(side[n].combine_chunks() for side, n in ((left, "g"), (left, "g_fields"), (right, "p"), (right, "p_fields"))), subsets)
        return pa.table({case: left[case].take(pa.array([0] * len(g), pa.int64())), "g": g, "p": p, "agreement": agreement})

    subsets = SUBSETS
    left, right = (side.groupBy(case) for side in sides)
    return left.cogroup(right).applyInArrow(one, f"`{case}` {kinds[case]}, g {kinds['g']}, p {kinds['p']}, agreement double")


def _coded(ids, fields, codes, width: int):
    """Distinct ids in order, and in that order the rows' places among them, their numbers of fields and their fields' codes (-1: none)."""
    import numpy as np
    import pyarrow.compute as pc

    order = pc.sort_indices(ids).to_numpy()
    sorted_ids = ids.take(order)
    coded = sorted_ids.dictionary_encode(null_encoding="encode")
    size = pc.fill_null(pc.list_value_length(fields), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    table = np.full((len(size), width), -1, np.int64)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = codes
    return coded.dictionary, coded.indices.to_numpy(), size[order], table[order]


def _keyed(left, right, places: tuple[int, ...]):
    """One number for each combination of codes at ``places`` on both sides, the same for equal ones; -1 where one is missing."""
    import numpy as np

    both = np.concatenate([left, right])
    key = np.zeros(len(both), np.int64)
    for at in places:
        key = np.unique(key * (both[:, at].max(initial=0) + 2) + both[:, at] + 1, return_inverse=True)[1]
    key[(both[:, list(places)] < 0).any(axis=1)] = -1
    return key[: len(left)], key[len(left) :]


def _match(g_ids, g_fields, p_ids, p_fields, subsets: int = SUBSETS):
    """Gold ids, predicted ids and agreements of one case, level by level of agreement.

    When a level's turn comes, no free pair agrees more. So gold rules are taken
    in order, and each takes the first free predicted rule that equals it at
    some s places, s being the level's. The predicted rules are held in order by
    their values at every s places, and what has been taken is stepped over
    once. Where more than ``subsets`` choices of s among k places exist, k - s + 1
    blocks of places are used, one of which must be equal throughout, and what
    they find is compared.
    """
    from math import comb

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = pa.concat_arrays([pc.list_flatten(g_fields), pc.list_flatten(p_fields)]).dictionary_encode()
    codes = pc.fill_null(flat.indices, -1).to_numpy(zero_copy_only=False)
    cut = len(pc.list_flatten(g_fields))
    width = max([0, *(pc.max(pc.list_value_length(f)).as_py() or 0 for f in (g_fields, p_fields))])
    g_names, g_at, g_size, g_codes = _coded(g_ids, g_fields, codes[:cut], width)
    p_names, p_at, _, p_codes = _coded(p_ids, p_fields, codes[cut:], width)
    g_free, p_free = np.ones(len(g_names), bool), np.ones(len(p_names), bool)
    found: list[tuple[int, int, float]] = []
    levels: dict[int, dict[int, int]] = {}
    for k in np.unique(g_size[g_size > 0]).tolist():
        for s in range(1, k + 1):
            levels.setdefault((2_000_000 * s + k) // (2 * k), {})[k] = s  # the agreement in millionths, rounded
    for level, parts in sorted(levels.items(), reverse=True):
        rows = np.flatnonzero(g_free[g_at] & np.isin(g_size, list(parts)))
        others = np.flatnonzero(p_free[p_at])
        if not len(rows) or not len(others):
            continue
        ways = []
        for k, s in parts.items():
            sure = comb(k, s) <= subsets
            for places in combinations(range(k), s) if sure else [tuple(range(b, k, k - s + 1)) for b in range(k - s + 1)]:
                asked, held = _keyed(g_codes[rows], p_codes[others], places)
                asked[g_size[rows] != k] = -1
                order = np.argsort(held, kind="stable")
                starts = np.searchsorted(held[order], np.arange(max(asked.max(initial=-1), held.max(initial=-1)) + 2))
                if (asked >= 0).any():
                    ways.append((asked.tolist(), starts[:-1].tolist(), starts[1:].tolist(), others[order].tolist(), 0 if sure else s, k))
        g_of, p_of, taken_g, taken_p = g_at[rows].tolist(), p_at.tolist(), set(), set()
        for i, g in enumerate(g_of):
            if g in taken_g:
                continue
            best = len(p_at)
            for asked, head, end, order, least, k in ways:
                key = asked[i]
                if key < 0:
                    continue
                at, stop = head[key], end[key]
                while at < stop and p_of[order[at]] in taken_p:
                    at += 1
                head[key] = at
                if least:
                    own = g_codes[rows[i], :k]
                    while at < stop and order[at] < best and (p_of[order[at]] in taken_p or np.count_nonzero((p_codes[order[at], :k] == own) & (own >= 0)) < least):
                        at += 1
                if at < stop and order[at] < best:
                    best = order[at]
            if best < len(p_at):
                taken_g.add(g)
                taken_p.add(p_of[best])
                found.append((g, p_of[best], level / 1e6))
        g_free[list(taken_g)] = False
        p_free[list(taken_p)] = False
    g, p, agreement = ([row[c] for row in found] for c in range(3))
    return g_names.take(pa.array(g, pa.int64())), p_names.take(pa.array(p, pa.int64())), pa.array(agreement, pa.float64())
