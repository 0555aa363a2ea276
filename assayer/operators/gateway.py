"""The validation gateway for extracted rule drafts: five layers of checks, then conflicts before publication.

A draft is (batch, idx, payload, source): a JSON object and the text it was
drawn from. Layer 1 is a strict schema (no extra fields, no numbers as text),
2 asks that score and level stand in the quote, 3 finds the quote in the
source, 4 checks bounds, 5 compares with a second extraction by an equality
join on the draft's key. Checks are column expressions, so a batch is one
projection, one join and one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import levels as L
from assayer.functions import text as T

TEXTS, NUMBERS = ("category", "level", "evidence_quote"), ("score",)
OPTIONAL_TEXTS, OPTIONAL_NUMBERS, LISTS = ("clause", "rank", "item_name", "effective_date"), ("cap", "team_factor"), ("synonyms",)
FIELDS = (*TEXTS, *NUMBERS, *OPTIONAL_TEXTS, *OPTIONAL_NUMBERS, *LISTS)


def parsed(drafts: DataFrame) -> DataFrame:
    """``drafts`` with one column for each field (null where the payload fails layer 1) and ``schema_ok``."""
    v = F.try_parse_json("payload")
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit("MISSING"))
    number = lambda f: kind(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    empty = lambda f: kind(f).isin("MISSING", "VOID")
    tests = [F.size(F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, FIELDS)))) == 0]
    tests += [(kind(f) == "STRING") & (T.strip(F.try_variant_get(v, f"$.{f}", "string")) != "") for f in ("category", "level")] + [kind("evidence_quote") == "STRING", number("score")]
    tests += [empty(f) | (kind(f) == "STRING") for f in OPTIONAL_TEXTS] + [empty(f) | number(f) for f in OPTIONAL_NUMBERS] + [(kind("synonyms") == "MISSING") | kind("synonyms").startswith("ARRAY<STRING") | (kind("synonyms") == "ARRAY<VOID>")]
    ok = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        ok = ok & F.coalesce(test, F.lit(False))
    values = {f: T.strip(F.try_variant_get(v, f"$.{f}", "string")) for f in (*TEXTS, *OPTIONAL_TEXTS)} | {f: F.try_variant_get(v, f"$.{f}", "double") for f in (*NUMBERS, *OPTIONAL_NUMBERS)}
    held = drafts.withColumn("schema_ok", ok)
    rows = held.select("*", *[F.when(F.col("schema_ok"), value).alias(f) for f, value in values.items()])
    composed = rows.withColumns({"level_clean": L.cleaned(F.col("level")), "quote_clean": L.cleaned(F.col("evidence_quote"))})
    found = L.level_of(F.col("level_clean"))
    return composed.withColumns({"canonical": found["canonical"], "known_level": found["matched"], "quote_level": L.level_of(F.col("quote_clean"))["canonical"]})


def issues(rows: DataFrame, year: str) -> DataFrame:
    """``rows`` with ``found`` (layers 1 to 4 as an array of layer and code, in order) and char_start of the quote."""
    quote, level = F.col("evidence_quote"), F.col("canonical")
    flat = lambda c: F.regexp_replace(c, f"[{T.SPACE}]+", "")
    level_there = F.contains(flat(quote), flat(F.col("level"))) | (level != "") & (F.col("quote_level") != "") & (F.contains(F.col("quote_level"), level) | F.contains(level, F.col("quote_level")))
    start = F.when(quote != "", F.instr(F.col("source"), quote) - 1).otherwise(-1)
    day = F.expr("try_to_date(effective_date, 'yyyy-MM-dd')")
    first = int(year[:4])
    code = lambda layer, name, bad: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("code")))
    checks = [
        code(2, "score_not_in_quote", ~F.array_contains(T.points_in(quote), F.col("score"))), code(2, "level_not_in_quote", ~level_there), code(3, "quote_not_found", start < 0),
        code(4, "score_out_of_range", ~((F.col("score") > 0) & (F.col("score") <= 100))), code(4, "invalid_level", ~F.col("known_level")), code(4, "invalid_cap", ~F.col("cap").between(0, 100)),
        code(4, "invalid_team_factor", ~F.col("team_factor").between(0, 1)), code(4, "invalid_effective_date", (F.col("effective_date") != "") & day.isNull()),
        code(4, "effective_date_out_of_year", ~day.between(F.lit(f"{first}-09-01").cast("date"), F.lit(f"{first + 1}-08-31").cast("date"))),
    ]
    bad = F.array(F.struct(F.lit(1).alias("layer"), F.lit("schema_error").alias("code")))
    return rows.select("*", F.when(F.col("schema_ok"), F.array_compact(F.array(*checks))).otherwise(bad).alias("found"), F.when(F.col("schema_ok") & (start >= 0), start).alias("char_start"))


KEY = ("batch", "category", "canonical", "rank_key", "item_key")


def _keyed(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.struct("score", "cap", "team_factor", "clause", "rank", "item_name")
    return rows.withColumns({"rank_key": blank("rank"), "item_key": blank("item_name"), "signature": F.when(F.col("schema_ok"), F.to_json(content, {"ignoreNullFields": "false"}))})


def validate(drafts: DataFrame, year: str, second: DataFrame | None = None) -> DataFrame:
    """batch, idx, status, codes (in order), char_start and confidence of every draft."""
    rows = _keyed(issues(parsed(drafts), year))
    later = F.array().cast("array<struct<layer:int,code:string>>")
    more = lambda layer, name, bad: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("code")))).otherwise(later)
    if second is not None:
        other = _keyed(parsed(second))
        failed = other.where("not schema_ok").select("batch").distinct().withColumn("failed", F.lit(True))
        met = other.where("schema_ok").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("signature").alias("other"))
        rows = rows.join(met, list(KEY), "left").join(failed, "batch", "left")
        missing = F.col("schema_ok") & F.col("n").isNull()
        rows = rows.withColumn(
            "found",
            F.concat("found", more(5, "secondary_schema_error", missing & F.col("failed")), more(5, "secondary_missing", missing & F.col("failed").isNull()), more(5, "secondary_mismatch", F.col("schema_ok") & ((F.col("n") > 1) | (F.col("other") != F.col("signature"))))),
        )
    alike = Window.partitionBy(*KEY)
    conflict = F.col("schema_ok") & (F.min("score").over(alike) != F.max("score").over(alike))
    found = F.concat("found", more(6, "rule_conflict", conflict))
    done = rows.withColumn("found", found)
    layer = lambda *k: F.exists("found", lambda i: i["layer"].isin(*k))
    return done.select(
        "batch", "idx", F.when(F.size("found") == 0, "accepted").when(layer(1, 2), "rejected").otherwise("review").alias("status"),
        F.array_join(F.transform("found", lambda i: i["code"]), ",").alias("codes"), "char_start",
        F.when(layer(2), 0.0).when(F.size("found") > 0, 0.5).otherwise(1.0).alias("confidence"),
    )


def report(validated: DataFrame) -> DataFrame:
    """total, accepted, review, rejected, interception_rate and publishable of each batch."""
    n = F.count(F.lit(1))
    of = lambda s: F.count_if(F.col("status") == s)
    return validated.groupBy("batch").agg(
        n.alias("total"), of("accepted").alias("accepted"), of("review").alias("review"), of("rejected").alias("rejected"),
        F.round(F.count_if(F.col("status") != "accepted") / n, 6).alias("interception_rate"), (F.count_if(F.col("status") != "accepted") == 0).alias("publishable"),
    )


def reasons(validated: DataFrame) -> DataFrame:
    """code, stage and n: how often each issue stands."""
    codes = validated.select(F.explode(F.split("codes", ",")).alias("code")).where("code <> ''")
    return codes.groupBy("code", F.when(F.col("code") == "rule_conflict", "publication").otherwise("validation").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def detection(validated: DataFrame, expected: DataFrame) -> DataFrame:
    """target, cases, detected, rate and the missed ones of negative cases (batch, idx, target, code)."""
    both = expected.join(validated, ["batch", "idx"], "left")
    hit = F.coalesce(F.array_contains(F.split("codes", ","), F.col("code")), F.lit(False))
    missed = F.array_join(F.array_sort(F.collect_list(F.when(~hit, F.concat_ws(":", F.col("batch").cast("string"), F.col("idx").cast("string"))))), ",")
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("cases"), F.count_if(hit).alias("detected"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("rate"), missed.alias("missed"))


def line_rules(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, quote, level_text and score of each line that names a level and points: rules by pattern."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), T.LINE_END, -1)).alias("line_no", "quote"))
    level = F.regexp_extract("quote", "((?:国家|国际|省|市|校|院|班)[级部赛]*[特一二三四1-4]等奖?)", 1)
    score = F.regexp_extract("quote", f"(\\d+(?:\\.\\d+)?)[{T.SPACE}]*分", 1).try_cast("double")
    return lines.select(key, "line_no", T.strip(F.col("quote")).alias("quote"), level.alias("level_text"), score.alias("score")).where("level_text <> '' and score > 0 and score <= 100")
