"""Near-duplicate documents: SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; two texts are linked when their fingerprints differ
in at most ``radius`` bits. Candidate pairs come from covering masks
(R. Pagh, *Locality-sensitive hashing without false negatives*): every bit i
gets a non-zero code of radius + 1 bits, and the table of a non-zero vector v
compares the bits whose code has an odd product with v. The codes of at most
``radius`` differing bits span a space that some v is orthogonal to, so that
table compares none of the differing bits: every pair within the radius meets
in some table.

Nothing is capped. Equal fingerprints are one node, so copies never form pairs.
A bucket gives a spanning forest of its links rather than all of them, which
has the same components. A bucket with more than ``bucket_limit`` distinct
fingerprints is dealt out again: the bits it doesn't compare are cut into
radius + 1 blocks, a pair within the radius agrees on one of them, and each
block makes a finer bucket. After a few such levels so few bits are left that
a bucket is small by construction.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; a null id takes part, and a component's id is the smallest id that
is not null (null if there is none); repeated rows give repeated rows; texts of
any length are read whole (a task holds one text); an empty table gives an empty
table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import near_copies
from assayer.llm.components import star_components
from assayer.llm.words import row_hash, unused
from assayer.session import materialize

BITS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 16
#: Buckets up to this many fingerprints compare all their pairs at once.
_SMALL = 8


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over shingles of ``width`` words; zero without a word."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        h = np.fromiter((digest(s, 42) for s in part), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed long) and text_hash of every row, in one pass and without a shuffle."""
    source = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(raw.as_py()) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(fps, pa.int64()), batch.column("text_hash")],
                names=["id", "fp", "text_hash"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long, text_hash long")


def covering_masks(radius: int) -> list[int]:
    """One mask (as a signed long) for each non-zero vector of radius + 1 bits."""
    codes = (1 << (radius + 1)) - 1
    of_bit = [(i * 7) % codes + 1 for i in range(BITS)]
    masks = []
    for v in range(1, codes + 1):
        mask = sum(1 << i for i, code in enumerate(of_bit) if (code & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` widened by each of radius + 1 blocks of the bits that it leaves out."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    blocks = [free[k :: radius + 1] for k in range(radius + 1)]
    widened = [(mask % (1 << 64)) | sum(1 << i for i in block) for block in blocks]
    return [m - (1 << 64) if m >> 63 else m for m in widened]


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges that span the graph of ``fps`` (uint64, distinct) linked within the radius."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                left += [int(at)] * len(found)
                right += found.tolist()
                frontier += list(found)
                rest = rest[~near]
    return left, right


def _link(batches: Iterator[pa.RecordBatch], radius: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (mask, bucket, fp) sorted by bucket -> edges (mask 0) and rows of finer buckets."""
    out: dict[str, list] = {}

    def clear() -> None:
        out.update(mask=[], bucket=[], fp=[], other=[])

    def add(mask, bucket, fp, other) -> None:
        out["mask"].append(mask)
        out["bucket"].append(bucket)
        out["fp"].append(fp)
        out["other"].append(other)

    def emit() -> pa.RecordBatch:
        cols = [np.concatenate([np.zeros(0, np.int64), *out[k]]) for k in ("mask", "bucket", "fp", "other")]
        clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["mask", "bucket", "fp", "other"])

    def edges(a: np.ndarray, b: np.ndarray) -> None:
        zero = np.zeros(len(a), np.int64)
        add(zero, zero, np.minimum(a, b), np.maximum(a, b))

    def finer(mask: int, fps: np.ndarray) -> None:
        for wide in finer_masks(int(mask), radius):
            n = np.full(len(fps), wide, np.int64)
            add(n, fps & np.int64(wide), fps, np.zeros(len(fps), np.int64))

    def large(mask: int, fps: np.ndarray) -> None:
        if limit is not None and len(fps) > limit:
            finer(mask, fps)
        else:
            a, b = forest(fps.view(np.uint64), radius)
            edges(np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64))

    def whole(mask: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= _SMALL, sizes)
        for step in range(1, _SMALL):
            same = (group[step:] == group[:-step]) & small[step:]
            a, b = fp[:-step][same], fp[step:][same]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            edges(a[near], b[near])
        for k in np.flatnonzero(sizes > _SMALL):
            at = slice(starts[k], starts[k] + sizes[k])
            large(mask[starts[k]], fp[at])

    clear()
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    spilling = False  # the last bucket passed the limit: its rows go straight to finer ones
    for batch in batches:
        now = [np.concatenate([h, batch.column(k).to_numpy()]) for h, k in zip(held, ("mask", "bucket", "fp"), strict=True)]
        mask, bucket, fp = now
        if not len(fp):
            continue
        last = np.flatnonzero((mask != mask[-1]) | (bucket != bucket[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # where the unfinished bucket begins
        begin = 0
        if spilling:
            first = np.flatnonzero((mask != spilled[0]) | (bucket != spilled[1]))
            begin = int(first[0]) if len(first) else len(fp)
            finer(spilled[0], fp[:begin])
            spilling = begin == len(fp)
        if not spilling:
            if cut > begin:
                whole(mask[begin:cut], bucket[begin:cut], fp[begin:cut])
            cut = max(cut, begin)
            if limit is not None and len(fp) - cut > limit:
                spilled, spilling = (int(mask[-1]), int(bucket[-1])), True
                finer(spilled[0], fp[cut:])
        held = [np.zeros(0, np.int64)] * 3 if spilling else [c[cut:] for c in now]
        yield emit()
    if len(held[2]):
        whole(*held)
    yield emit()


def links(nodes: DataFrame, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Edges (a, b) among the distinct ``fp`` of ``nodes`` that span every component.

    The masks, not the data, bound how often a fingerprint is repeated: 2^(radius+1) - 1.
    """
    masks = covering_masks(radius)
    fp = F.col("fp")
    table = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), fp.bitwiseAND(F.lit(m)).alias("bucket")) for m in masks]))
    rows = nodes.select("fp", table.alias("t")).select("t.mask", "t.bucket", "fp")
    found = None
    free = BITS - min(m.bit_count() if m >= 0 else BITS - (~m).bit_count() for m in masks)
    level_limit: int | None = bucket_limit
    while True:
        if 1 << free <= bucket_limit:  # too few bits left for a larger bucket
            level_limit = None
        limit = level_limit
        step = materialize(
            rows.repartition("mask", "bucket")
            .sortWithinPartitions("mask", "bucket", "fp")
            .mapInArrow(lambda it, limit=limit: _link(it, radius, limit), "mask long, bucket long, fp long, other long"),
            "links",
        )
        edges = step.where("mask = 0").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        found = edges if found is None else found.unionByName(edges)
        rows = step.where("mask <> 0").select("mask", "bucket", "fp")
        if limit is None or rows.isEmpty():
            return found.distinct()
        free -= free // (radius + 1)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, bucket_limit: int = 4096
) -> DataFrame:
    """id, fp, text_hash, root (a fingerprint that names the component) and component_id of every row."""
    docs = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    groups = docs.groupBy("fp").agg(F.min("id").alias("first_id"))
    stars = star_components(links(groups.select("fp"), radius, bucket_limit))
    linked = stars.join(groups, stars.node == groups.fp).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "root").select("fp", "root", "component_id")
    named = groups.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    # both sides of the last join come from tables, so a fingerprint with many rows is split, not dealt to one task
    return docs.join(materialize(named, "components"), "fp").select("id", "fp", "text_hash", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, one for each group of near copies (``near_copies``): its smallest id (null last, then by hash), once.

    Rows equal in every column are one; of rows with one id the hash of all columns decides, so reruns agree.
    """
    # plain equality of three columns, so the join's shuffle and order serve the removal of repeats too
    key = none, id_, hash_ = [unused(df.columns, name) for name in ("__none", "__id", "__hash")]
    keys = [df[id_col].isNull().alias(none), F.coalesce(df[id_col].cast("string"), F.lit("")).alias(id_), row_hash(df).alias(hash_)]
    texts = df.select(*keys, df[id_col].alias("id"), F.coalesce(df[text_col].cast("binary"), F.lit(b"")).alias("raw"))
    kept = near_copies.keep_one(texts, key, "raw", [none, "id", hash_])
    return df.select("*", *keys).join(kept, key, "left_semi").dropDuplicates(key).select(*[f"`{c}`" for c in df.columns])


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from assayer.session import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id")
    )


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
