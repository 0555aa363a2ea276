"""Grids from orders, blocks and fragments from parts and line items, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import layout as G
from assayer.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


_GRID = """cells AS (SELECT p_partkey // 20 AS sheet, p_partkey % 20 // 4 AS row, p_partkey % 4 AS col, CASE WHEN p_size % 6 = 0 THEN NULL WHEN (p_partkey // 20) % 3 + 1 = p_partkey % 20 // 4 THEN (['类 别', '等级（注）', '分值', '分值'])[p_partkey % 4 + 1] WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS value FROM part),
wide AS (SELECT sheet, count(DISTINCT col) AS w FROM cells GROUP BY 1), fill AS (SELECT sheet, row, count(value) AS f, count(*) FILTER (value IS NOT NULL AND try_cast(replace(value, ',', '') AS DOUBLE) IS NULL) AS t FROM cells WHERE row < 10 GROUP BY 1, 2),
heads AS (SELECT wide.sheet, coalesce(arg_min(row, (-(f / w + t / f), row)) FILTER (f > 0 AND f / w >= 0.5), 0)::BIGINT AS header FROM wide JOIN fill ON wide.sheet = fill.sheet GROUP BY 1)"""


def _grid(spark, d):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ["类 别", "等级（注）", "分值", "分值"])), (k % 4 + 1).cast("int"))
    value = F.when(F.col("p_size") % 6 == 0, None).when(F.floor(k / 20) % 3 + 1 == F.floor(k % 20 / 4), head).when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(F.floor(k / 20).alias("sheet"), F.floor(k % 20 / 4).alias("row"), (k % 4).alias("col"), value.alias("value"))


@_query("header_rows", f"WITH {_GRID} SELECT sheet, header FROM heads")
def header_rows(spark, d):
    return G.header_rows(_grid(spark, d))


@_query("sheet_body", f"""WITH {_GRID}, k AS (SELECT c.*, header FROM cells c JOIN heads h ON c.sheet = h.sheet),
names AS (SELECT sheet, col, CASE WHEN n = '' THEN 'col' ELSE n END AS base FROM (SELECT sheet, col, regexp_replace(regexp_replace(coalesce(value, ''), '\\s+', '', 'g'), '[（(].*?[)）]$', '') AS n FROM k WHERE row = header)),
named AS (SELECT sheet, col, base || CASE WHEN row_number() OVER (PARTITION BY sheet, base ORDER BY col) > 1 THEN '_' || (row_number() OVER (PARTITION BY sheet, base ORDER BY col) - 1)::VARCHAR ELSE '' END AS "column" FROM names),
full_rows AS (SELECT sheet, row FROM cells GROUP BY 1, 2 HAVING count(value) > 0)
SELECT k.sheet, k.row, k.col, n."column", k.value FROM k JOIN named n ON k.sheet = n.sheet AND k.col = n.col JOIN full_rows f ON k.sheet = f.sheet AND k.row = f.row WHERE k.row > header""".replace("\\\\", "\\"))
def sheet_body(spark, d):
    """The cells below each sheet's header, by cleaned and numbered column names."""
    cells = _grid(spark, d)
    return G.body(cells, G.header_rows(cells))


_HEADS = [["项目类别", "获奖等级", "加分分值"], ["类别", "等级名称", "x"], ["学号", "姓名", "加分"], ["", "级别", "分 值"]]
_FOUND = [("项目类别", "获奖等级", "加分分值"), ("类别", "等级名称", None), (None, None, "加分"), (None, "级别", "分 值")]  # by hand


@_query("resolved_columns", "SELECT s_suppkey, " + ", ".join(f"([{', '.join('NULL' if f[k] is None else chr(39) + f[k] + chr(39) for f in _FOUND)}])[s_suppkey % 4 + 1] AS {name}" for k, name in enumerate(("category", "level", "score"))) + " FROM supplier")
def resolved_columns(spark, d):
    """Columns found by candidate names: equal, part of one another, or alike in characters."""
    k = F.col("s_suppkey")
    names = F.element_at(F.array(*[F.array(*map(F.lit, h)) for h in _HEADS]), (k % 4 + 1).cast("int"))
    find = lambda *w: G.resolve_column(F.col("n"), list(w))
    return table(spark, d, "supplier").select(k, names.alias("n")).select("s_suppkey", find("类别").alias("category"), find("等级", "级别").alias("level"), find("分值", "加分").alias("score"))


_BLOCKS = """b AS (SELECT l_orderkey AS page, l_partkey * 100 + l_linenumber AS block, CASE WHEN l_suppkey % 5 = 0 THEN 50 WHEN l_suppkey % 2 = 0 THEN 60 ELSE 320 END AS x0, l_partkey % 90 * 9 + l_linenumber AS y0, CASE WHEN l_suppkey % 5 = 0 THEN 550 WHEN l_suppkey % 2 = 0 THEN 290 ELSE 560 END AS x1, l_partkey % 90 * 9 + l_linenumber + l_partkey % 60 AS y1, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE 600 END AS width FROM lineitem WHERE l_orderkey % 2 = 0),
m AS (SELECT *, CASE WHEN x1 - x0 BETWEEN width * 0.2 AND width * 0.58 THEN CASE WHEN x1 <= width / 2 + width * 0.06 THEN 0 WHEN x0 >= width / 2 - width * 0.06 THEN 1 ELSE 2 END ELSE 2 END AS side FROM b),
two AS (SELECT DISTINCT l.page FROM m l JOIN m r ON l.page = r.page AND l.side = 0 AND r.side = 1 AND least(l.y1, r.y1) - greatest(l.y0, r.y0) > 2 JOIN (SELECT page FROM m GROUP BY page HAVING count(*) >= 4 AND count(*) FILTER (side = 0) >= 2 AND count(*) FILTER (side = 1) >= 2 AND max(width) > 0) g ON g.page = l.page),
s AS (SELECT m.page, m.block, m.side, m.y0, m.x0, t.page IS NOT NULL AS two_columns, count(o.block) FILTER (CASE WHEN m.side = 2 THEN (o.y0, o.x0) < (m.y0, m.x0) ELSE o.y0 <= (m.y0 + m.y1) / 2 END) AS section FROM m LEFT JOIN two t ON m.page = t.page LEFT JOIN m o ON o.page = m.page AND o.side = 2 GROUP BY ALL)"""


@_query("reading_order", f"""WITH {_BLOCKS} SELECT page, block, two_columns, (row_number() OVER (PARTITION BY page ORDER BY CASE WHEN two_columns THEN section ELSE 0 END, CASE WHEN two_columns THEN side ELSE 0 END, y0, x0, block) - 1)::INTEGER AS position FROM s""")
def reading_order(spark, d):
    """Blocks in the order in which a page is read, one or two columns."""
    li = table(spark, d, "lineitem").where("l_orderkey % 2 = 0")
    five, even, p = F.col("l_suppkey") % 5 == 0, F.col("l_suppkey") % 2 == 0, F.col("l_partkey")
    y0 = p % 90 * 9 + F.col("l_linenumber")
    blocks = li.select(
        F.col("l_orderkey").alias("page"), (p * 100 + F.col("l_linenumber")).alias("block"), F.when(five, 50).when(even, 60).otherwise(320).alias("x0"), y0.alias("y0"),
        F.when(five, 550).when(even, 290).otherwise(560).alias("x1"), (y0 + p % 60).alias("y1"), F.when(F.col("l_orderkey") % 9 == 0, 0).otherwise(600).alias("width"),
    ).distinct()
    return G.reading_order(blocks).select("page", "block", "two_columns", "position")


_ROWS = [["项目", "等级", "分值"], ["项目：", "等 级", "加分值"], ["张三", "8", "x"], ["项目", "名称", "a"]]
_COMPACT = [["项目", "等级", "分值"], ["项目", "等级", "加分值"], ["张三", "8", "x"], ["项目", "名称", "a"]]
#: Likeness of each header to each other one, by hand.
_LIKE = [[3, 3, 0, 1], [3, 3, 0, 1], [0, 0, 3, 0], [1, 1, 0, 3]]


@_query("stitched_tables", f"""WITH RECURSIVE f AS (SELECT s_suppkey // 10 AS doc, s_suppkey % 10 // 2 AS page, s_suppkey % 2 AS idx, s_suppkey % 2 = 1 OR s_nationkey % 3 = 0 AS last_on_page, 2 + s_nationkey % 2 AS columns, s_nationkey % 4 AS h, s_nationkey % 5 = 0 AS at_bottom, s_nationkey % 4 < 2 AS at_top, s_nationkey % 11 = 0 AS marker, row_number() OVER (PARTITION BY s_suppkey // 10 ORDER BY s_suppkey) AS k FROM supplier),
j AS (SELECT b.*, coalesce(a.page = b.page - 1 AND b.idx = 0 AND a.last_on_page AND a.columns = b.columns AND b.columns > 1, false) AS may, coalesce(a.at_bottom, false) AS was FROM f b LEFT JOIN f a ON a.doc = b.doc AND a.k = b.k - 1),
w AS (SELECT doc, k, h AS first_h, ''::VARCHAR AS reason, 1::BIGINT AS tab FROM j WHERE k = 1 UNION ALL
 SELECT j.doc, j.k, CASE WHEN j.may THEN w.first_h ELSE j.h END, CASE WHEN j.may THEN concat_ws(',', CASE WHEN ({_LIKE})[w.first_h + 1][j.h + 1] >= 2 THEN 'repeated_header' END, CASE WHEN j.was AND j.at_top THEN 'page_edge' END, CASE WHEN j.marker THEN 'marker' END) ELSE '' END,
  w.tab + (NOT j.may OR NOT (({_LIKE})[w.first_h + 1][j.h + 1] >= 2 OR j.was AND j.at_top OR j.marker))::INT FROM w JOIN j ON j.doc = w.doc AND j.k = w.k + 1)
SELECT j.doc, j.page, j.idx, w.reason, w.tab AS "table" FROM w JOIN j ON j.doc = w.doc AND j.k = w.k""")
def stitched_tables(spark, d):
    """Which table of its document each fragment belongs to, and why it continues one."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    header = F.element_at(F.array(*[F.transform(F.array(*map(F.lit, r)), G.compact) for r in _ROWS]), (n % 4 + 1).cast("int"))
    rows = table(spark, d, "supplier").select(
        F.floor(s / 10).alias("doc"), F.floor(s % 10 / 2).alias("page"), (s % 2).alias("idx"), ((s % 2 == 1) | (n % 3 == 0)).alias("last_on_page"), (2 + n % 2).alias("columns"), header.alias("header"), (n % 5 == 0).alias("at_bottom"), (n % 4 < 2).alias("at_top"), (n % 11 == 0).alias("marker"),
    )
    return G.stitch_tables(rows).select("doc", "page", "idx", "reason", "table")


@_query("clauses", """WITH c AS (SELECT conv_id, turn, unnest(range(len(b))) AS i, unnest(b) AS t FROM (SELECT conv_id, turn, string_split(text, '. ') AS b FROM conversations))
SELECT conv_id::VARCHAR || '#p' || turn::VARCHAR || '#b' || i::VARCHAR AS clause_id, md5(trim(t, ' ' || chr(10) || chr(9) || chr(13))) AS text_md5 FROM c WHERE length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) >= 8""")
def clauses(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "[.] ", -1).alias("blocks"))
    return G.clauses(pages, "conv_id", "turn", "blocks").select("clause_id", F.md5("text").alias("text_md5"))


@_query("page_kinds", "SELECT conv_id, count(*) AS pages, count(*) FILTER (b) AS scanned, CASE WHEN count(*) FILTER (b) = 0 THEN 'text' WHEN count(*) FILTER (b) = count(*) THEN 'scanned' ELSE 'mixed' END AS kind FROM (SELECT conv_id, length(trim(CASE WHEN turn % 3 = 0 THEN substr(text, 1, 15) ELSE text END, ' ')) < 20 AS b FROM conversations) GROUP BY conv_id")
def page_kinds(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 15)).otherwise(F.col("text")).alias("text"))
    return G.page_kinds(pages, "conv_id", "text")
