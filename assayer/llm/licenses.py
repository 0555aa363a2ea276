"""License scans: Dice coefficient over word bigrams, with size bounds.

A passage is a line, a sentence of a line with several, a paragraph of several
lines (paragraphs are parted by blank lines), or a window of several consecutive
paragraphs. Texts are normalised to runs of ``[a-z0-9]`` after lower-casing A-Z;
a passage is the set of its word bigrams, and is compared with templates by
2 * shared / (size + size). A coefficient of at least ``threshold`` is possible
only for sizes within a factor (2 - threshold) / threshold of each other, so a
passage outside the bounds of every template makes no bigrams at all, windows
reach only as far as the largest bound has words, and a (passage, template) pair
outside its own bounds is dropped before it is counted. A text without any of
the bigrams of which such a coefficient calls for one (``telling_bigrams``, an
exact bound) is passed over, and so is a window without one.

What passes is exploded to bigrams and joined to the templates' bigrams, which
are a constant of this package (a few thousand rows, so the broadcast has a
proven bound). Almost all bigrams find nothing there and end in the same stage;
only shared ones are shuffled, by passage, after a partial count; paragraphs are
shuffled, by text, only of texts that hold a telling bigram and several
paragraphs. Only built-in functions are used.

Result: one row for each passage that reaches the threshold with some template:
the best one (ties: smallest template number). ``passage_no`` counts lines or
paragraphs from 0, ``part`` is the sentence in its line or the number of
paragraphs of a window. Overlapping windows of one template are one finding, the
best of them (ties: fewer paragraphs, then the first); a window of one paragraph
is no finding of its own, that is the paragraph's or line's. Equal passages of a
document are separate rows. Defined results: null and blank texts have no
passage; texts of any length are read whole; a null id is kept as null; repeated
rows give repeated rows; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.license_texts import TEMPLATES
from assayer.llm.words import let
from assayer.session import materialize, table

THRESHOLD = 0.8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised_words(text: Column) -> Column:
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, "[^a-z0-9]+"), "")


def bigrams(words: Column) -> Column:
    """The set of adjacent pairs."""
    return F.array_distinct(
        F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def templates(spark: SparkSession, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, license, size, bigrams."""
    rows = [(k, name, text) for k, (name, text) in enumerate(texts)]
    found = spark.createDataFrame(rows, "template int, license string, text string")
    grams = bigrams(normalised_words(F.col("text")))
    return found.select("template", "license", grams.alias("grams")).select("template", "license", F.size("grams").alias("size"), "grams")


_BLANK = "\n[\\x20\\x09-\\x0D]*\n"


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, scope, passage_no, part, words: the lines, sentences of lines with several, and paragraphs of several lines."""
    text = F.coalesce(docs[text_col], F.lit(""))
    one = lambda scope, no, part, passage: F.struct(F.lit(scope).alias("scope"), no.alias("no"), part.alias("part"), passage.alias("passage"))
    zero = F.lit(0)
    parted = lambda line: F.split(F.regexp_replace(line, "([.!?;])[ \t]+", "$1\u0001"), "\u0001", -1)
    sentences = lambda line, no: let(parted(line), lambda s: F.when(F.size(s) > 1, F.transform(s, lambda x, k: one("sentence", no, k, x))).otherwise(F.array()))
    by_line = lambda line, no: F.concat(F.array(one("line", no, zero, line)), sentences(line, no))
    paragraphs = F.filter(F.transform(F.split(text, _BLANK, -1), lambda x, i: one("paragraph", i, zero, x)), lambda p: F.instr(F.trim(p["passage"]), "\n") > 0)
    every = F.concat(F.flatten(F.transform(F.split(text, "\n", -1), by_line)), paragraphs)
    found = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), every.alias("every")).select("row", "id", F.explode("every").alias("p"))
    return found.select("row", "id", "p.scope", F.col("p.no").alias("passage_no"), "p.part", normalised_words(F.col("p.passage")).alias("words"))


def windows(docs: DataFrame, most_words: int, telling: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, scope, passage_no, part, words: runs of paragraphs of at most ``most_words`` words that hold a telling bigram, in texts of several."""
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = F.filter(F.transform(F.split(text, _BLANK, -1), lambda x, i: F.struct(i.alias("no"), x.alias("text"))), lambda p: p["text"].rlike("[A-Za-z0-9]"))
    several = docs.where(text.rlike(_BLANK)).select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), parts.alias("parts")).where("size(parts) > 1")
    rows = several.select("row", "id", F.explode("parts").alias("p")).select("row", "id", "p.no", "p.text", normalised_words(F.col("p.text")).alias("words"))
    along = Window.partitionBy("row").orderBy("no")
    placed = rows.select(
        "row", "id", "no", "words", (F.sum(F.size("words")).over(along) - F.size("words")).alias("at"),
        telling(F.concat_ws(" ", "text", F.lead("text").over(along))).alias("told"),  # a bigram may lie over the border
    )
    ahead = Window.partitionBy("row").orderBy("at").rangeBetween(Window.currentRow, most_words)
    runs = placed.select("row", "id", "no", F.collect_list(F.struct("no", "words", "told")).over(ahead).alias("next")).where("exists(next, p -> p.told)")
    wide = runs.select("row", "id", "no", F.explode(F.transform(F.sequence(F.lit(1), F.size("next")), lambda n: F.slice("next", 1, n))).alias("run")).where("exists(run, p -> p.told)")
    joined = wide.select("row", "id", F.lit("paragraphs").alias("scope"), F.col("no").alias("passage_no"), F.size("run").alias("part"), F.flatten(F.transform("run", lambda p: p["words"])).alias("words"))
    return joined.where(F.size("words") <= most_words)


def telling_bigrams(texts: list[tuple[str, str]], threshold: float) -> list[tuple[str, str]]:
    """Bigrams of which every text that reaches the threshold with some template holds at least one.

    The sizes allowed leave threshold / (2 - threshold) of a template's bigrams
    as the least that must be shared, so of any larger rest one is shared. For
    each template that rest is taken by the longest word in a bigram, longest first.
    """
    found: set[tuple[str, str]] = set()
    for _, text in texts:
        grams = sorted(_grams(text), key=lambda g: (-max(map(len, g)), g))
        least = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        found |= set(grams[: len(grams) - least + 1])
    return sorted(found)


def may_match(text: Column, texts: list[tuple[str, str]], threshold: float) -> Column:
    """False only for texts that hold none of the telling bigrams: first a byte search for their longer words, then the bigrams themselves."""
    grams = telling_bigrams(texts, threshold)
    words = {max(g, key=len) for g in grams}
    words = sorted(w for w in words if not any(v != w and v in w for v in words))  # a word that holds another one adds nothing
    some = let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))
    each = "|".join(f"{a}[^A-Za-z0-9]+{b}" for a, b in grams)
    return some & text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{each})(?![A-Za-z0-9])")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """id, scope, passage_no, part, license, template, shared, size, dice of the passages that match."""
    known = templates(docs.sparkSession, texts)
    telling = lambda text: may_match(text, texts, threshold)
    # texts that may match are few; they are looked for once and read twice
    docs = materialize(docs.where(telling(docs[text_col])).select(docs[id_col].alias("id"), docs[text_col].alias("text")), "licensed")
    sizes = [len(_grams(text)) for _, text in texts]
    ratio = (2 - threshold) / threshold
    low, high = min(sizes) / ratio, max(sizes) * ratio
    key = ["row", "id", "scope", "passage_no", "part"]
    every = passages(docs, "id", "text").unionByName(windows(docs, math.floor(high) + 1, telling, "id", "text"))
    found = every.where(F.size("words") > low).select(*key, bigrams(F.col("words")).alias("grams"))
    found = found.select("*", F.size("grams").alias("size")).where(F.col("size").between(low, high))
    grams = known.select("template", "license", F.col("size").alias("template_size"), F.explode("grams").alias("gram"))
    pairs = (
        found.select(*key, "size", F.explode("grams").alias("gram"))
        .join(F.broadcast(grams), "gram")
        .where((F.col("size") * ratio >= F.col("template_size")) & (F.col("template_size") * ratio >= F.col("size")))
        .groupBy(*key, "size", "template", "license", "template_size")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    dice = 2 * F.col("shared") / (F.col("size") + F.col("template_size"))
    best = (
        pairs.select("*", dice.alias("dice"))
        .where(F.col("dice") >= threshold)
        .groupBy(*key, "size")
        .agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license", "shared")).alias("b"))
        .select(*key, "size", "b.license", (-F.col("b.t")).alias("template"), "b.shared", "b.dice")
    )
    # windows of one template that overlap are one run of windows; the best of a run is its finding
    alike = Window.partitionBy("row", "scope", "template")
    before = F.max(F.col("passage_no") + F.col("part")).over(alike.orderBy("passage_no", "part").rowsBetween(Window.unboundedPreceding, -1))
    runs = best.where("scope = 'paragraphs'").withColumn("new", (before.isNull() | (F.col("passage_no") >= before)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(alike.orderBy("passage_no", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.row_number().over(Window.partitionBy("row", "scope", "template", "run").orderBy(F.desc("dice"), "part", "passage_no"))
    spread = runs.withColumn("first", first).where("first = 1 and part > 1").drop("new", "run", "first")
    columns = ["id", "scope", "passage_no", "part", "license", "template", "shared", F.col("size").cast("long").alias("size"), "dice"]
    return best.where("scope <> 'paragraphs'").unionByName(spread).select(*columns)


def _grams(text: str) -> set[tuple[str, str]]:
    import re

    words = re.findall("[a-z0-9]+", text.lower())
    return set(zip(words, words[1:], strict=False))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document that is a licence text or notice."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return found.select(F.col("id").alias("doc_id"), "scope", whole("passage_no"), whole("part"), "license", whole("template"), "shared", "size", "dice")


def _oracle() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    normal = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH templates AS (
  SELECT template, license, len(g) AS template_size, g FROM (
    SELECT template, license, {grams.format(w="w")} AS g FROM (
      SELECT template, license, {normal.format(t="t")} AS w FROM (VALUES {quoted}) v(template, license, t)))),
template_grams AS (SELECT template, license, template_size, unnest(g) AS gram FROM templates),
bounds AS (SELECT floor(max(template_size) * {2 - THRESHOLD} / {THRESHOLD})::BIGINT + 1 AS most FROM templates),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT n, doc_id, 'line' AS scope, unnest(range(len(l))) AS passage_no, 0 AS part, unnest(l) AS passage
  FROM (SELECT n, doc_id, string_split(text, chr(10)) AS l FROM docs)),
sentences AS (SELECT n, doc_id, 'sentence' AS scope, passage_no, unnest(range(len(s))) AS part, unnest(s) AS passage
  FROM (SELECT *, string_split(regexp_replace(passage, '([.!?;])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM lines) WHERE len(s) > 1),
paragraphs AS (SELECT n, doc_id, 'paragraph' AS scope, unnest(range(len(l))) AS passage_no, 0 AS part, unnest(l) AS passage
  FROM (SELECT n, doc_id, string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n') AS l FROM docs)),
passages AS (
  SELECT n, doc_id, scope, passage_no, part, {normal.format(t="passage")} AS w FROM (
    SELECT * FROM lines UNION ALL SELECT * FROM sentences UNION ALL
    SELECT * FROM paragraphs WHERE contains(trim(passage, ' '), chr(10)))),
numbered AS (
  SELECT n, doc_id, passage_no, w, sum(len(w)) OVER (PARTITION BY n ORDER BY passage_no) AS through, row_number() OVER (PARTITION BY n ORDER BY passage_no) AS k
  FROM (SELECT n, doc_id, passage_no, {normal.format(t="passage")} AS w FROM paragraphs) WHERE len(w) > 0),
spans AS (
  SELECT a.n, a.doc_id, a.passage_no, b.k - a.k + 1 AS part, a.k AS ka, b.k AS kb FROM numbered a JOIN numbered b
    ON a.n = b.n AND b.k >= a.k AND b.through - a.through + len(a.w) <= (SELECT most FROM bounds)
  WHERE a.n IN (SELECT n FROM numbered GROUP BY n HAVING count(*) > 1)),
spreads AS (
  SELECT s.n, s.doc_id, 'paragraphs' AS scope, s.passage_no, s.part, flatten(list(p.w ORDER BY p.k)) AS w
  FROM spans s JOIN numbered p ON p.n = s.n AND p.k BETWEEN s.ka AND s.kb GROUP BY ALL),
sets AS (
  SELECT n, doc_id, scope, passage_no, part, len(g) AS size, g FROM (
    SELECT n, doc_id, scope, passage_no, part, {grams.format(w="w")} AS g FROM (SELECT * FROM passages UNION ALL SELECT * FROM spreads))
  WHERE len(g) BETWEEN 1 AND 1000),
pairs AS (
  SELECT s.n, s.doc_id, s.scope, s.passage_no, s.part, s.size, t.template, t.license, t.template_size, count(*) AS shared
  FROM (SELECT n, doc_id, scope, passage_no, part, size, unnest(g) AS gram FROM sets) s JOIN template_grams t ON s.gram = t.gram
  GROUP BY ALL),
scored AS (SELECT *, 2 * shared / (size + template_size)::DOUBLE AS dice FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, scope, passage_no, part ORDER BY dice DESC, template) AS k
  FROM scored WHERE dice >= {THRESHOLD}),
best AS (SELECT * FROM ranked WHERE k = 1),
marked AS (
  SELECT *, coalesce(passage_no >= max(passage_no + part) OVER (PARTITION BY n, template ORDER BY passage_no, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new
  FROM best WHERE scope = 'paragraphs'),
runs AS (SELECT *, sum(new) OVER (PARTITION BY n, template ORDER BY passage_no, part) AS run FROM marked),
chosen AS (SELECT *, row_number() OVER (PARTITION BY n, template, run ORDER BY dice DESC, part, passage_no) AS first FROM runs),
findings AS (
  SELECT doc_id, scope, passage_no, part, license, template, shared, size, dice FROM best WHERE scope <> 'paragraphs' UNION ALL
  SELECT doc_id, scope, passage_no, part, license, template, shared, size, dice FROM chosen WHERE first = 1 AND part > 1)
SELECT doc_id, scope, passage_no::BIGINT AS passage_no, part::BIGINT AS part, license, template::BIGINT AS template, shared::BIGINT AS shared, size::BIGINT AS size, dice
FROM findings"""


QUERIES = {"op3_licenses": op3_licenses}
ORACLES = {"op3_licenses": _oracle()}
