"""Media columns: PNG files in binary columns, and cosine-transform hashes of them.

``encode_png`` lays bytes out as 8-bit RGB rows of 64 pixels and writes
signature, IHDR, IDAT and IEND chunks, each with its CRC-32; ``decode_png``
tests signature, chunk order and checksums, inflates (zlib tests Adler-32) and
undoes the row filters with numpy. Filters None, Sub and Up are undone for all
rows of a run at once; Average and Paeth depend on their left neighbour, so
they go pixel by pixel (the encoder doesn't use them). The hash shrinks the
grey image to 32 x 32 by area means, takes the 8 x 8 lowest frequencies of its
two-dimensional cosine transform and sets a bit for each one above the median.

Each image is worked on alone with the same operations, so equal texts give
equal values, whatever batch they are in. Defined results: a null or empty text
is one row of spaces; a damaged file raises ``ValueError`` naming the fault;
texts of any length are one image (a task holds one image); repeated rows stay
repeated, nulls in other columns are kept, an empty table gives an empty table;
input columns named like a result are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.words import unused
from assayer.session import table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
ROW = 3 * WIDTH
LEVEL = 6


def padded(raw: bytes, unit: int = ROW) -> bytes:
    """``raw`` with spaces up to a positive multiple of ``unit``."""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = LEVEL) -> bytes:
    """Whole rows of RGB samples as a PNG; each row takes the filter (None, Sub, Up) with the least sum of sizes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    forms = np.stack([rows, sub, up])
    cost = np.minimum(forms, 256 - forms.astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = forms[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray, pixel: int) -> np.ndarray:
    """Rows of samples from rows that begin with their filter's number."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    subs = np.flatnonzero(kinds == 1)
    if len(subs):
        out[subs] = np.cumsum(out[subs].reshape(len(subs), -1, pixel), axis=1, dtype=np.uint8).reshape(len(subs), -1)
    if (kinds >= 3).any():
        for y, kind in enumerate(kinds.tolist()):
            above = out[y - 1].tolist() if y else [0] * out.shape[1]
            if kind == 2:
                out[y] += np.array(above, np.uint8)
            elif kind >= 3:
                row = out[y].tolist()
                for x in range(len(row)):
                    left, corner = (row[x - pixel], above[x - pixel]) if x >= pixel else (0, 0)
                    row[x] = (row[x] + ((left + above[x]) // 2 if kind == 3 else _paeth(left, above[x], corner))) & 255
                out[y] = row
        return out
    ups = kinds == 2
    starts = np.flatnonzero(ups & ~np.r_[False, ups[:-1]])
    ends = np.flatnonzero(ups & ~np.r_[ups[1:], False]) + 1
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # a run of Up rows adds to the row before it
        a = max(a - 1, 0)
        out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
    return out


def decode_png(data: bytes) -> tuple[int, int, np.ndarray]:
    """width, height and rows of 8-bit RGB samples; raises ``ValueError`` on any fault."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if (header is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if header is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, *form = header
    if form != [8, 2, 0, 0, 0]:
        raise ValueError("only 8-bit RGB without interlace")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as fault:
        raise ValueError(str(fault)) from fault
    if len(raw) != height * (3 * width + 1):
        raise ValueError("wrong number of samples")
    return width, height, unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), 3)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_SIDE, _LOW = 32, 8
_BASIS = _cosines(_SIDE, _LOW)


def _shrink(grey: np.ndarray, side: int) -> np.ndarray:
    """Area means along the first axis."""
    n = len(grey)
    edges = np.arange(side + 1) * n / side
    sums = np.vstack([np.zeros((1, grey.shape[1])), np.cumsum(grey, axis=0)])
    low = np.minimum(edges.astype(np.int64), n)
    part = (edges - low)[:, None]
    at = sums[low] + part * (sums[np.minimum(low + 1, n)] - sums[low])
    return np.diff(at, axis=0) * (side / n)


def cosine_hash(rows: np.ndarray) -> bytes:
    """Eight bytes: one bit for each low frequency above their median."""
    grey = rows.reshape(len(rows), -1, 3).astype(np.int64) @ np.array([299, 587, 114])
    small = _shrink(_shrink(grey.astype(np.float64), _SIDE).T, _SIDE).T / 1000
    low = np.einsum("ky,yx,lx->kl", _BASIS, small, _BASIS, optimize=False).round(6)
    return np.packbits(low.ravel() > np.median(low)).tobytes()


def media_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with media (the PNG of the padded text) and media_hash, both binary, and n_bytes, in place of the text."""
    rest = [c for c in df.columns if c not in ("media", "media_hash", "n_bytes", text_col)]
    raw_col = unused(rest, "raw")
    source = df.select(*[df[f"`{c}`"] for c in rest], F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias(raw_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                files, hashes, sizes = [], [], []
                for raw in part.column(raw_col):
                    data = raw.as_py()
                    payload = padded(data)
                    files.append(encode_png(payload))
                    hashes.append(cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, ROW)))
                    sizes.append(len(data))
                kept = [part.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(hashes, pa.binary())], names=[*rest, "n_bytes", "media", "media_hash"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return source.mapInArrow(run, f"{fields}, n_bytes long, media binary, media_hash binary")


def read_back(df: DataFrame) -> DataFrame:
    """Digests of what the ``media`` column holds, decoded: doc_id, n_bytes, payload_*, media_*, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media"):
                file = data.as_py()
                _, _, samples = decode_png(file)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(samples).hex()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=_NAMES)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media_columns(docs).select("doc_id", "n_bytes", "media")
    return read_back(stored)


QUERIES = {"op7_media": op7_media}
ORACLES: dict[str, str] = {}
