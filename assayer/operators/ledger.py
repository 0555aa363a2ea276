"""The scoring ledger: one explained line for every claim, and totals for every student.

Steps, each a projection, a join or a window: match by a cascade of keys, gate
by year and catalog, score (factor, then the rule's cap), hold back what needs
review, keep the best line of each group, drop groups that exclude each other
(``exclusive``), cap the groups, and add up. Points are whole numbers x 100.

A claim (claim_id, student_id, academic_year, college, category, level,
raw_level, team, catalog_listed) keeps one line whatever happens to it; ``level``
and ``raw_level`` are normalised keys or null. A rule (rule_id, academic_year,
college, category, level, synonyms, score, cap, team_factor_pct, grp,
require_catalog, priority, exclusive_with) with a null college fits any college.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions.text import academic_year, norm_key

REVIEW_BELOW = 0.8
GUESS = 0.6


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, exact and the first rule of each key (priority, score, id): levels and their synonyms, normalised."""
    spelt = F.array_distinct(F.concat(F.array("level"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    every = rules.select("*", F.explode(spelt).alias("spelling")).withColumn("key", norm_key(F.col("spelling")))
    order = Window.partitionBy("key").orderBy(F.desc("priority"), F.desc("score"), "rule_id")
    return every.withColumn("k", F.row_number().over(order)).where("k = 1").select("key", (F.col("spelling") == F.col("level")).alias("exact"), rule_struct())


def rule_struct() -> Column:
    return F.struct("rule_id", F.col("academic_year").alias("rule_year"), "category", "level", "score", "cap", "team_factor_pct", "grp", "require_catalog").alias("rule")


def match(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """``claims`` with rule, confidence and channel: by level or synonym (1 or 0.95), else by the level read from the raw text (0.9), else by category (0.6)."""
    keys = rule_keys(rules)
    by_level = keys.select(F.col("key").alias("k1"), F.col("exact").alias("exact1"), F.col("rule").alias("rule1"))
    by_text = keys.select(F.col("key").alias("k2"), F.col("rule").alias("rule2"))
    order = Window.partitionBy("key").orderBy(F.desc("priority"), F.desc("score"), "rule_id")
    by_category = rules.withColumn("key", norm_key(F.col("category"))).withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("key").alias("k3"), rule_struct().alias("rule3"))
    joined = (
        claims.join(by_level, norm_key(F.col("level_asked")) == F.col("k1"), "left")
        .join(by_text, norm_key(F.col("raw_level")) == F.col("k2"), "left")
        .join(by_category, norm_key(F.col("category_asked")) == F.col("k3"), "left")
    )
    confidence = F.when(F.col("k1").isNotNull(), F.when(F.col("exact1"), 1.0).otherwise(0.95)).when(F.col("k2").isNotNull(), 0.9).when(F.col("k3").isNotNull(), GUESS).otherwise(0.0)
    how = F.when(F.col("k1").isNotNull(), F.when(F.col("exact1"), "exact_level").otherwise("synonym")).when(F.col("k2").isNotNull(), "raw_text").when(F.col("k3").isNotNull(), "category_fallback").otherwise("none")
    return joined.select(*claims.columns, F.coalesce("rule1", "rule2", "rule3").alias("rule"), confidence.alias("confidence"), how.alias("how"))


def lines(matched: DataFrame) -> DataFrame:
    """claim_id, student_id, rule_id, grp, how, score, raw_score, capped, confidence, counted, status and reason of every claim, before groups."""
    rule = F.col("rule")
    unmatched = rule.isNull()
    wrong_year = F.col("academic_year").isNotNull() & (academic_year(F.col("academic_year")) != academic_year(rule["rule_year"]))
    unlisted = rule["require_catalog"].isNotNull() & ~F.col("catalog_listed")
    rejected = F.coalesce(wrong_year, F.lit(False)) | F.coalesce(unlisted, F.lit(False))
    raw = F.when(F.col("team"), rule["score"] * rule["team_factor_pct"]).otherwise(rule["score"] * 100)
    capped = F.coalesce(raw > rule["cap"] * 100, F.lit(False))
    review = F.col("confidence") < REVIEW_BELOW
    status = F.when(unmatched, "unmatched").when(rejected, "rejected").when(review, "review").otherwise("checked")
    reason = F.when(unmatched, "no rule").when(F.coalesce(wrong_year, F.lit(False)), "year").when(rejected, "catalog").otherwise(
        F.concat_ws(";", F.when(F.col("how") == "raw_text", "level from text"), F.when(F.col("how") == "category_fallback", "by category"), F.when(capped, "cap"), F.when(F.col("team") & (rule["team_factor_pct"] != 100), "team"), F.when(review, "review"))
    )
    out = unmatched | rejected
    return matched.select(
        "claim_id", "student_id", rule["rule_id"].alias("rule_id"), F.when(~out, rule["grp"]).alias("grp"), "how",
        F.when(out, 0).when(capped, rule["cap"] * 100).otherwise(raw).cast("long").alias("score"), F.coalesce(rule["score"] * 100, F.lit(0)).cast("long").alias("raw_score"),
        (capped & ~out).alias("capped"), F.when(out, 0.0).otherwise(F.col("confidence")).alias("confidence"), (status == "checked").alias("counted"), status.alias("status"), reason.alias("reason"),
    )


def decide(every: DataFrame, rules: DataFrame) -> DataFrame:
    """``every`` with the final counted and reason: the best of each group by (score, confidence, rule, claim), without excluded groups."""
    order = Window.partitionBy("student_id", "grp", "counted").orderBy(F.desc("score"), F.desc("confidence"), "rule_id", "claim_id")
    ranked = every.withColumn("place", F.when(F.col("counted"), F.row_number().over(order)))
    winners = ranked.where("place = 1").select("student_id", "grp", "score")
    dropped = exclusive(winners, conflicts(rules)).withColumn("dropped", F.lit(True))
    joined = ranked.join(dropped, ["student_id", "grp"], "left")
    lost = F.col("place") > 1
    notes = F.concat_ws(";", F.nullif("reason", F.lit("")), F.when(lost, "beaten in group"), F.when(F.col("counted") & F.col("dropped"), "excluded group"))
    return joined.select(*[c for c in every.columns if c not in ("counted", "reason")], (F.coalesce(F.col("place") == 1, F.lit(False)) & F.col("dropped").isNull()).alias("counted"), notes.alias("reason"))


def conflicts(rules: DataFrame) -> DataFrame:
    """a, b (both ways) of groups that some rule declares exclusive."""
    pairs = rules.select(F.col("grp").alias("a"), F.explode("exclusive_with").alias("b")).where("a <> b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def exclusive(winners: DataFrame, pairs: DataFrame) -> DataFrame:
    """student_id, grp of the winners that go: outside the best conflict-free set of the groups that conflict.

    Groups without a conflict never matter. A set is compared by its sum, its
    highest score, and its names; since groups of separate components add up
    independently, the best set of all conflicting groups is the union of the
    best sets of the components, up to ties, which go by the same order. All
    2^n sets of a student's n conflicting groups are an array in one row.
    """
    held = winners.select("student_id", F.col("grp").alias("b")).join(pairs, "b").join(winners.select("student_id", F.col("grp").alias("a"), "score"), ["student_id", "a"])
    nodes = held.groupBy("student_id", F.col("a").alias("grp"), "score").agg(F.sort_array(F.collect_set("b")).alias("against"))
    component = components(nodes)
    by_component = component.groupBy("student_id", "component").agg(F.sort_array(F.collect_list(F.struct("grp", "score", "against"))).alias("g"))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("g")).cast("int") - 1)
    chosen = lambda m: F.filter("g", lambda x, i: F.getbit(m, i) == 1)
    names = lambda c: F.transform(c, lambda x: x["grp"])
    sets = F.filter(F.transform(masks, chosen), lambda c: ~F.exists(c, lambda x: F.arrays_overlap(x["against"], names(c))))
    key = lambda c: F.struct((-F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["score"])).alias("total"), (-F.array_max(F.transform(c, lambda x: x["score"]))).alias("top"), names(c).alias("names"))
    best = F.array_min(F.transform(sets, key))["names"]
    return by_component.select("student_id", F.explode(F.array_except(names(F.col("g")), best)).alias("grp"))


def components(nodes: DataFrame) -> DataFrame:
    """``nodes`` (student_id, grp, against) with the smallest group reachable; one row of few groups for each student."""
    start = nodes.groupBy("student_id").agg(F.collect_list(F.struct("grp", "against")).alias("all"))
    label = lambda state: F.transform(state, lambda s: F.struct(s["grp"].alias("grp"), s["against"].alias("against"), F.array_min(F.transform(F.filter(state, lambda o: (o["grp"] == s["grp"]) | F.array_contains(s["against"], o["grp"])), lambda o: o["label"])).alias("label")))
    first = F.transform("all", lambda s: F.struct(s["grp"].alias("grp"), s["against"].alias("against"), s["grp"].alias("label")))
    spread = F.aggregate("all", first, lambda state, _: label(state))  # as many rounds as there are groups
    found = start.select("student_id", F.explode(spread).alias("s")).select("student_id", F.col("s.grp").alias("grp"), F.col("s.label").alias("component"))
    return nodes.join(found, ["student_id", "grp"])


def totals(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """student_id, total, groups, unmatched and review (sorted claim ids): the groups' best lines, capped by group."""
    caps = rules.groupBy("grp").agg((F.max("cap") * 100).alias("group_cap"))
    sums = decided.groupBy("student_id", "grp").agg(F.max(F.when(F.col("counted"), F.col("score"))).alias("best"), F.count_if(F.col("status") == "checked").alias("n"))
    after = sums.join(caps, "grp", "left").select("student_id", "n", F.least("best", F.coalesce("group_cap", "best")).alias("after"))
    by_student = after.groupBy("student_id").agg(F.coalesce(F.sum("after"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 0).alias("groups"))
    ids = lambda *s: F.array_sort(F.collect_set(F.when(F.col("status").isin(*s), F.col("claim_id"))))
    lists = decided.groupBy("student_id").agg(ids("unmatched", "rejected").alias("unmatched"), ids("review").alias("review"))
    return by_student.join(lists, "student_id")


def gate(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """student_id, disposition, unsupported: whether every counted line has its rule, score and a precise place to cite."""
    known = rules.select(F.col("rule_id"), (F.col("score") * 100).alias("rule_score"), F.col("located"), F.lit(True).alias("known"))
    checked = decided.where("counted").join(known, "rule_id", "left")
    fault = F.when(F.col("known").isNull(), "rule_id").when(~F.col("located"), "source_locator").when(F.col("raw_score") != F.col("rule_score"), "raw_score")
    found = checked.groupBy("student_id").agg(F.array_sort(F.collect_set(F.when(fault.isNotNull(), F.concat(F.col("claim_id").cast("string"), F.lit(":"), fault)))).alias("unsupported"), F.min("confidence").alias("least"))
    every = decided.select("student_id").distinct().join(found, "student_id", "left")
    return every.select(
        "student_id", F.when(F.col("least").isNull() | (F.size("unsupported") > 0), "refuse").when(F.col("least") < 1, "manual_review").otherwise("auto_score").alias("disposition"),
        F.when(F.col("least").isNull(), "counted_matches").otherwise(F.array_join("unsupported", ",")).alias("unsupported"),
    )
