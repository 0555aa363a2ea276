"""Documents as rows: headers and columns of grids, reading order of blocks, tables over pages, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.functions import text as T


def is_number(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("double").isNotNull()


def header_rows(cells: DataFrame, scan: int = 10, least_fill: float = 0.5) -> DataFrame:
    """sheet and the row (of the first ``scan``) that looks most like a header: filled, and text; the first of equals, else row 0.

    ``cells``: sheet, row (from 0), col, value; blanks are null. Two aggregates, no order but the last pick.
    """
    wide = cells.groupBy("sheet").agg(F.count_distinct("col").alias("width"))
    rows = cells.where(F.col("row") < scan).groupBy("sheet", "row").agg(F.count("value").alias("filled"), F.count_if(F.col("value").isNotNull() & ~is_number(F.col("value"))).alias("texts"))
    fill = F.col("filled") / F.col("width")
    scored = rows.join(wide, "sheet").where("filled > 0").where(fill >= least_fill).select("sheet", "row", (fill + F.col("texts") / F.col("filled")).alias("score"))
    best = scored.groupBy("sheet").agg(F.min_by("row", F.struct((-F.col("score")).alias("s"), "row")).alias("header"))
    return wide.select("sheet").join(best, "sheet", "left").select("sheet", F.coalesce("header", F.lit(0)).cast("long").alias("header"))


def clean_header(x: Column) -> Column:
    """Without white space and a closing remark in brackets."""
    flat = F.regexp_replace(F.coalesce(x, F.lit("")), f"[{T.SPACE}]+", "")
    return F.regexp_replace(flat, "[（(].*?[)）]$", "")


def unique_names(headers: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``headers`` with ``column``: repeats are numbered from 1, empty ones are called col."""
    base = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("col"))
    place = F.row_number().over(Window.partitionBy(by, "base").orderBy(order)) - 1
    return headers.withColumn("base", base).withColumn("column", F.when(place == 0, F.col("base")).otherwise(F.concat_ws("_", "base", place.cast("string")))).drop("base")


def resolve_column(names: Column, wanted: list[str]) -> Column:
    """The first of ``names`` (cleaned headers in order) that a candidate fits: equal, then part of one another, then alike in characters (0.6 of the shorter)."""
    chars = lambda x: F.array_distinct(F.split(x, ""))

    def by(candidate: str) -> Column:
        c = F.lit(candidate)
        shared = lambda n: F.size(F.array_intersect(chars(n), chars(c))) / F.least(F.length(n), F.length(c))
        scored = F.transform(F.filter(names, lambda n: n != ""), lambda n, i: F.struct((-shared(n)).alias("s"), i.alias("i"), n.alias("n")))
        alike = F.array_min(F.filter(scored, lambda s: s["s"] <= -0.6))["n"]
        first = lambda test: F.get(F.filter(names, test), F.lit(0))
        return F.coalesce(first(lambda n: n == c), first(lambda n: (n != "") & (F.contains(n, c) | F.contains(c, n))), alike)

    return F.coalesce(*[by(w) for w in wanted])


def body(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells below each sheet's header with their column's name; rows without any value are left out."""
    known = cells.join(headers, "sheet")
    names = unique_names(known.where(F.col("row") == F.col("header")).select("sheet", "col", clean_header(F.col("value")).alias("name")), "sheet", "col", "name").select("sheet", "col", "column")
    below = known.where(F.col("row") > F.col("header")).withColumn("any", F.count("value").over(Window.partitionBy("sheet", "row")))
    return below.where("any > 0").join(names, ["sheet", "col"]).select("sheet", "row", "col", "column", "value")


def reading_order(blocks: DataFrame, page: str = "page") -> DataFrame:
    """``blocks`` (page, block, x0, y0, x1, y1, width) with position (from 0) and two_columns.

    Two columns are recognised by at least two prose blocks on either side of
    the middle that stand beside one another; between blocks that span the page
    the left column comes before the right one. Else by top, then left. One
    task's share is a page.
    """
    half, margin = F.col("width") / 2, F.col("width") * 0.06
    wide = F.col("x1") - F.col("x0")
    prose = wide.between(F.col("width") * 0.20, F.col("width") * 0.58)
    side = F.when(prose & (F.col("x1") <= half + margin), "left").when(prose & (F.col("x0") >= half - margin), "right").otherwise("span")
    marked = blocks.withColumn("side", side)
    span = F.array_sort(F.collect_list(F.when(F.col("side") == "span", F.struct("y0", "x0"))))
    of = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("y0", "y1")))
    pages = marked.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w"), of("left").alias("lefts"), of("right").alias("rights"), span.alias("spans"))
    beside = F.exists("lefts", lambda a: F.exists("rights", lambda b: F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) > 2))
    two = (F.col("w") > 0) & (F.col("n") >= 4) & (F.size("lefts") >= 2) & (F.size("rights") >= 2) & beside
    known = marked.join(pages.select(page, two.alias("two_columns"), "spans"), page)
    middle = (F.col("y0") + F.col("y1")) / 2
    section = F.when(F.col("side") == "span", F.size(F.filter("spans", lambda s: F.struct(s["y0"], s["x0"]) < F.struct("y0", "x0")))).otherwise(F.size(F.filter("spans", lambda s: s["y0"] <= middle)))
    rank = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    order = [F.when(F.col("two_columns"), section).otherwise(0), F.when(F.col("two_columns"), rank).otherwise(0), "y0", "x0", "block"]
    return known.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1).drop("side", "spans")


def compact(x: Column) -> Column:
    """A table cell without white space and outer separators."""
    return F.regexp_replace(F.regexp_replace(x, f"[{T.SPACE}]+", ""), "^[|：:，,；;]+|[|：:，,；;]+$", "")


def header_likeness(a: Column, b: Column) -> Column:
    """Share of positions of two rows whose (compact) cells are equal or part of one another."""
    width = F.greatest(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x != "") & (y != "") & ((x == y) | F.contains(y, x) | F.contains(x, y)), F.lit(False)).cast("int"))
    return F.when(width > 0, F.aggregate(same, F.lit(0), lambda s, v: s + v) / width).otherwise(0.0)


def stitch_tables(fragments: DataFrame, doc: str = "doc") -> DataFrame:
    """``fragments`` (doc, page, idx, last_on_page, columns, header, at_bottom, at_top, marker) with table, continued and reason.

    A fragment continues the table before it when that is the last one of the
    page before, this is the first of its page, both have the same number (over
    one) of columns, and a header is repeated, both stand at the page's edge, or
    a marker says so. ``header`` is the first row with two cells. The header of
    a table is that of its first fragment, so likeness is carried forward.
    """
    along = Window.partitionBy(doc).orderBy("page", "idx")
    before = lambda c: F.lag(c).over(along)
    may = (before("page") == F.col("page") - 1) & (F.col("idx") == 0) & before("last_on_page") & (before("columns") == F.col("columns")) & (F.col("columns") > 1)
    rows = fragments.withColumn("may", F.coalesce(may, F.lit(False)))
    edge = before("at_bottom") & F.col("at_top")
    first = F.last(F.when(~F.col("may"), F.col("header")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    like = header_likeness(first, F.col("header")) >= 0.6
    reason = F.concat_ws(",", F.when(F.coalesce(like, F.lit(False)), "repeated_header"), F.when(F.coalesce(edge, F.lit(False)), "page_edge"), F.when(F.col("marker"), "marker"))
    judged = rows.withColumn("reason", F.when(F.col("may"), reason).otherwise("")).withColumn("continued", F.col("reason") != "")
    return judged.withColumn("table", F.sum((~F.col("continued")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))


def clauses(pages: DataFrame, doc: str, page: str, blocks: str, least: int = 8) -> DataFrame:
    """clause_id (``doc#pN#bI``) and text of every block of at least ``least`` characters."""
    rows = pages.select(F.col(doc).cast("string").alias("d"), F.col(page).cast("string").alias("p"), F.posexplode(blocks).alias("i", "t")).select("d", "p", "i", T.strip(F.col("t")).alias("text"))
    return rows.where(F.length("text") >= least).select(F.concat("d", F.lit("#p"), "p", F.lit("#b"), F.col("i").cast("string")).alias("clause_id"), "text")


def page_kinds(pages: DataFrame, doc: str, text: str, least: int = 20) -> DataFrame:
    """doc, pages, scanned and kind: text, scanned, or mixed, by pages with hardly any text."""
    bare = F.length(T.strip(F.coalesce(F.col(text), F.lit("")))) < least
    found = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(bare).alias("scanned"))
    return found.select(doc, "pages", "scanned", F.when(F.col("scanned") == 0, "text").when(F.col("scanned") == F.col("pages"), "scanned").otherwise("mixed").alias("kind"))
