"""Spreadsheets and word-processor files as rows: zipped XML read in Arrow batches, one file per row of ``binaryFile``."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CELLS = "path string, sheet string, kind string, row long, col long, row_end long, col_end long, value string"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node.iter() if _local(x.tag) == name]


def _place(ref: str) -> tuple[int, int]:
    """Row and column (from 1) of a reference such as ``AB12``."""
    letters, digits = re.fullmatch("([A-Z]+)([0-9]+)", ref.replace("$", "")).groups()
    col = 0
    for c in letters:
        col = 26 * col + ord(c) - 64
    return int(digits), col


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in _children(item, "t")) for item in root if _local(item.tag) == "si"]


def workbook_rows(path: str, data: bytes) -> Iterator[tuple]:
    """(path, sheet, kind, row, col, row_end, col_end, value): each cell, blanks inside the used area too, and each merged range."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = _shared(book)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _children(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if _local(k) == "id" and k != "sheetId")]
            root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            found: dict[tuple[int, int], str | None] = {}
            for cell in _children(root, "c"):
                kind, text = cell.get("t"), "".join(v.text or "" for v in _children(cell, "v")) or "".join(v.text or "" for v in _children(cell, "t"))
                value = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text) if kind == "b" else text
                found[_place(cell.get("r"))] = value if value and value.strip() else None
            merges = [m.get("ref").split(":") for m in _children(root, "mergeCell")]
            ends = list(found) + [_place(ref) for refs in merges for ref in refs]
            name = sheet.get("name")
            for row in range(1, max((r for r, _ in ends), default=0) + 1):
                for col in range(1, max((c for _, c in ends), default=0) + 1):
                    yield path, name, "cell", row, col, row, col, found.get((row, col))
            for refs in merges:
                (r0, c0), (r1, c1) = _place(refs[0]), _place(refs[-1])
                yield path, name, "merge", r0, c0, r1, c1, None


def document_rows(path: str, data: bytes) -> Iterator[tuple]:
    """(path, "", kind, block, row, ...): paragraphs and table cells of a word-processor file in document order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        body = next(x for x in ElementTree.fromstring(book.read("word/document.xml")) if _local(x.tag) == "body")
    text = lambda node: "".join(t.text or "" for t in _children(node, "t")).strip()
    for block, node in enumerate(body):
        if _local(node.tag) == "p" and text(node):
            yield path, "", "paragraph", block, 0, block, 0, text(node)
        elif _local(node.tag) == "tbl":
            for r, row in enumerate(x for x in node if _local(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                    yield path, "", "table", block, r, block, c, text(cell)


def _read(spark: SparkSession, path: str, reader) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CELLS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = list(zip(*reader(name, content.as_py()), strict=True)) or [[]] * 8
                kinds = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(run, _CELLS)


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """cells (path, sheet, row, col, value) and merged ranges (path, sheet, r0, c0, r1, c1), all counted from 1."""
    rows = _read(spark, path, workbook_rows)
    cells = rows.where("kind = 'cell'").select("path", "sheet", "row", "col", "value")
    merges = rows.where("kind = 'merge'").select("path", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row_end").alias("r1"), F.col("col_end").alias("c1"))
    return cells, merges


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (paragraph or table), block, row, col, text in document order."""
    return _read(spark, path, document_rows).select("path", "kind", F.col("row").alias("block"), F.col("col").alias("row"), F.col("col_end").alias("col"), F.col("value").alias("text"))
