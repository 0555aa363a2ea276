"""Rules, claims and expectations from rows of text, and the exports of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import levels as L
from assayer.functions import text as T

# Words for yes, and the columns of the ledger export in order.
YES = ["1", "true", "yes", "y", "是", "已裁决", "√"]
LEDGER_COLUMNS = [
    "batch_id", "rule_version_id", "rule_content_hash", "student_id", "student_name", "student_total", "claim_id", "category", "raw_text", "level", "claim_status", "rule_id",
    "matched_key", "raw_score", "score", "counted", "needs_review", "channel", "reason", "source_doc", "source_page", "source_table", "source_row",
]


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(T.strip(x)).isin(YES), F.lit(False))


def points(x: Column) -> Column:
    """A number with or without its unit; null for anything else."""
    return F.nullif(F.replace(T.strip(x), F.lit("分"), F.lit("")), F.lit("")).try_cast("double")


def rules(rows: DataFrame, year: str) -> DataFrame:
    """rule_id, academic_year, category, level, synonyms, score, cap, team_factor and grp from (doc, row, category, level, score, synonyms, cap, team_factor, grp).

    Rows without a level, category or score are left out; a factor of 10 and
    more is a percentage; the group is the category unless named; synonyms are
    the level as written, those listed, and all spellings of the level.
    """
    filled = rows.where((T.strip(F.coalesce("level", F.lit(""))) != "") & (T.strip(F.coalesce("category", F.lit(""))) != "")).withColumn("points", T.first_number(F.col("score"))).where("points is not null")
    composed = filled.withColumns({"level_clean": L.cleaned(F.col("level")), "category_clean": L.cleaned(F.col("category"))})
    named = composed.withColumns({"canonical": L.level_of(F.col("level_clean"))["canonical"], "kind": L.category_of(F.col("category"), F.col("category_clean"))})
    listed = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), "[/、,，;；|]"), T.strip), lambda s: s != "")
    every = lambda canonical: F.concat(F.array(T.strip(F.col("level"))), listed, L.level_aliases(canonical))
    spelt = T.bound(F.col("canonical"), lambda c: F.array_sort(F.array_distinct(F.filter(every(c), lambda s: (s != "") & (s != c)))))
    factor = F.coalesce(T.first_number(F.col("team_factor")), F.lit(1.0))
    year_key = T.academic_year(F.lit(year))
    name = F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws("|", year_key, "kind", "canonical", "doc", F.col("row").cast("string")), 256), 1, 12))
    # spellings first: inside a lambda a name would mean the result's column of that name
    return named.withColumn("spelt", spelt).select(
        name.alias("rule_id"), year_key.alias("academic_year"), F.col("kind").alias("category"), F.col("canonical").alias("level"), F.col("spelt").alias("synonyms"), F.col("points").alias("score"),
        T.first_number(F.col("cap")).alias("cap"), F.when(factor >= 10, factor / 100).when(factor == 0, 1.0).otherwise(factor).alias("team_factor"), F.coalesce(F.nullif(T.strip(F.col("grp")), F.lit("")), F.col("kind")).alias("grp"),
    )


def claims(rows: DataFrame) -> DataFrame:
    """claim_id, student_id and level from (sheet, row, student, name, raw_text): ids depend on the place in the sheet only; a missing student is named by name and row."""
    student = F.coalesce(F.nullif(T.strip(F.col("student")), F.lit("")), F.concat_ws("#", F.coalesce("name", F.lit("")), F.col("row").cast("string")))
    known = rows.where(T.strip(F.coalesce("raw_text", F.lit(""))) != "").withColumn("student_id", student).withColumn("clean", L.cleaned(F.col("raw_text")))
    found = L.level_of(F.col("clean"))
    name = F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("|", "sheet", F.col("row").cast("string"), "student_id"), 256), 1, 12))
    return known.select(name.alias("claim_id"), "student_id", F.when(found["matched"], found["canonical"]).alias("level"), T.strip(F.col("raw_text")).alias("raw_text"))


def truths(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key`` and points of the rows that have any; a repeated key is an error."""
    known = rows.select(*[T.strip(F.col(k)).alias(k) for k in key], points(F.col(value)).alias("points")).where("points is not null")
    twice = known.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(*key).limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {[twice[0][k] for k in key]}")
    return known


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names without a byte-order mark and white space."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a damaged line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def ledger_rows(decided: DataFrame, context: DataFrame, key: str = "claim_id") -> DataFrame:
    """The 23 columns of the export as safe text, in order; columns that neither side has are empty."""
    rows = decided.join(context, key, "left")
    have = set(rows.columns)
    kinds = dict(rows.dtypes)
    safe = lambda c: T.csv_safe(F.col(c)) if kinds[c] == "string" else F.col(c).cast("string")
    return rows.select(*[(safe(c) if c in have else F.lit(None).cast("string")).alias(c) for c in LEDGER_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV parts that each begin with a byte-order mark and the header, as spreadsheets expect."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "\ufeff" + first).select("\ufeff" + first, *rest).write.csv(path, header=True, escape='"', quoteAll=False)


def item_template(decided: DataFrame) -> DataFrame:
    """student_id, claim_id and empty columns for a person to fill in."""
    empty = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    return decided.select("student_id", F.col("claim_id").cast("string").alias("item_key"), empty("expected", "double"), empty("adjudicated", "boolean"), empty("attribution"), empty("note"))
