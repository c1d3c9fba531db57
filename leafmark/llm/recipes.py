"""Exact duplicates by content-defined chunk recipes.

Texts are normalised (each run of white space is one space) and cut where a rolling hash of the last 32 bytes
says so, hence at the same places in equal passages of any two texts. A chunk's 64-bit hash becomes a verified
identifier: all chunk contents are grouped once by (hash, content), and where one hash has several contents,
each content gets an ordinal of its own. A document's recipe is its ordered list of identifiers; equal recipes
are equal texts. After the one pass over chunk contents only recipes move, never texts.

Defined results: a null text is an empty one; all empty texts are equal. The row with the smallest id stays,
null ids last; of rows equal in id and text one stays. An empty table gives an empty one. Other columns, also
such that share names with columns used here, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import IS_SPACE, keep_rows, slices, stored, table_of, text_bytes, text_keys

MIN_BYTES, MEAN_BITS, MAX_BYTES = 256, 10, 16384
GEAR = table_of(7).astype(np.uint32)
RECIPES = "doc_id long, _k1 long, _k2 long, text_sha256 string, hashes array<long>"


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with each run of white space replaced by one space."""
    space = IS_SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = space[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = ~(space & again)
    moved = np.concatenate(([0], np.cumsum(keep)))
    return np.where(space, np.uint8(32), data)[keep], moved[offsets]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the high bits of the rolling hash of the last 32 bytes are 0."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text the bounds of its chunks. Chunks are longer than the hash's window, so a bound depends
    on bytes of its own text alone."""
    points = cut_points(data).tolist() if len(data) else []
    at = 0
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        bounds = [start]
        while end - bounds[-1] > MIN_BYTES:
            low, high = bounds[-1] + MIN_BYTES, min(end, bounds[-1] + MAX_BYTES)
            while at < len(points) and points[at] < low:
                at += 1
            bounds.append(points[at] if at < len(points) and points[at] <= high else high)
        if bounds[-1] < end:
            bounds.append(end)
        yield bounds


def chunked(batch: pa.RecordBatch, hash_bits: int):
    """For each row: normalised bytes, chunk bounds and signed chunk hashes."""
    offsets, data = text_bytes(batch.column(batch.schema.get_field_index("text")))
    data, offsets = normalise(data, offsets)
    view, shift = memoryview(np.ascontiguousarray(data)), 64 - hash_bits
    for (start, end), bounds in zip(zip(offsets[:-1], offsets[1:], strict=True), chunk_bounds(data, offsets), strict=True):
        codes = [(xxhash.xxh64_intdigest(view[a:b]) >> shift) - (1 << 63 if not shift else 0) for a, b in zip(bounds, bounds[1:])]
        yield view[start:end], [view[a:b] for a, b in zip(bounds, bounds[1:])], codes


def _recipe_rows(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shas, codes = [], []
                for whole, _, hashes in chunked(part, hash_bits):
                    shas.append(hashlib.sha256(whole).hexdigest())
                    codes.append(hashes)
                columns = [part.column(i) for i in range(3)] + [pa.array(shas, pa.string()), pa.array(codes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_k1", "_k2", "text_sha256", "hashes"])

    return run


def _content_rows(hash_bits: int):
    """Each task passes a chunk content on once per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = {(h, bytes(c)) for _, contents, hashes in chunked(part, hash_bits) for h, c in zip(hashes, contents)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary())], ["hash", "content"]
                )

    return run


def _placed_rows(hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys = list(zip(*[part.column(i).to_pylist() for i in range(3)]))
                rows = [(*key, at, h, bytes(c)) for key, (_, contents, hashes) in zip(keys, chunked(part, hash_bits)) for at, (h, c) in enumerate(zip(hashes, contents))]
                names = ["doc_id", "_k1", "_k2", "at", "hash", "content"]
                types = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """``(doc_id, _k1, _k2, text_sha256, recipe)`` for every row; the recipe lists verified identifiers.

    ``hash_bits`` below 64 is for tests: hashes then collide, and the ordinals have to tell contents apart.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(F.col(text_col)), F.col(text_col).alias("text"))
    listed = stored(source.mapInArrow(_recipe_rows(hash_bits), RECIPES), "recipes")
    contents = source.select("text").mapInArrow(_content_rows(hash_bits), "hash long, content binary")
    distinct = contents.groupBy("hash", "content").agg(F.count(F.lit(1)).alias("n"))
    several = stored(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"), "collisions")
    if several.isEmpty():
        return listed.withColumn("recipe", F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(1).alias("ordinal")))).drop("hashes")
    # Hashes collide: pieces get ordinals by content, and the lists of all documents are put together anew.
    named = distinct.join(several, "hash").groupBy("hash").agg(F.sort_array(F.collect_set(F.sha2("content", 256))).alias("names"))
    placed = source.mapInArrow(_placed_rows(hash_bits), "doc_id long, _k1 long, _k2 long, at long, hash long, content binary")
    ordinal = F.coalesce(F.array_position("names", F.sha2("content", 256)), F.lit(1)).cast("int")
    pieces = placed.dropDuplicates(["doc_id", "_k1", "_k2", "at"]).join(named, "hash", "left")
    lists = pieces.groupBy("doc_id", "_k1", "_k2").agg(
        F.sort_array(F.collect_list(F.struct("at", "hash", ordinal.alias("ordinal")))).alias("_list")
    )
    back = listed.alias("l").join(
        lists.alias("r"),
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._k1") == F.col("r._k1")) & (F.col("l._k2") == F.col("r._k2")),
        "left",
    )
    plain = F.transform("_list", lambda x: F.struct(x["hash"].alias("hash"), x["ordinal"].alias("ordinal")))
    empty = F.transform("hashes", lambda h: F.struct(h.alias("hash"), F.lit(1).alias("ordinal")))
    return back.select("l.doc_id", "l._k1", "l._k2", "text_sha256", F.coalesce(plain, empty).alias("recipe"))


def _groups(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id of their own, and one row per recipe."""
    rows = stored(listed.withColumn("_row", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row", "_k1", "_k2")).alias("first")
    return rows, stored(rows.groupBy("recipe").agg(first, F.count(F.lit(1)).alias("group_size")), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows, groups = _groups(recipes(docs, id_col, text_col, hash_bits))
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    rows, groups = _groups(recipes(docs, id_col, text_col))
    first = groups.select(F.col("first.doc_id").alias(id_col), F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2"))
    repeated = rows.groupBy("doc_id", "_k1", "_k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    repeated = stored(repeated.withColumnRenamed("doc_id", "_id"), "repeated")
    if repeated.isEmpty():
        return keep_rows(docs, stored(first.withColumn("copies", F.lit(1).cast("long")), "kept"), id_col, text_col)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("l._k1") == F.col("r._k1")) & (F.col("l._k2") == F.col("r._k2"))
    kept = first.alias("l").join(repeated.alias("r"), same, "left").select(
        id_col, "l._k1", "l._k2", F.coalesce("copies", F.lit(1)).alias("copies")
    )
    return keep_rows(docs, stored(kept, "kept"), id_col, text_col)
