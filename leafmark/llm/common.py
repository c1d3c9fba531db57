"""Shared pieces of the operators: stored tables, text as bytes, exact row selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.session import scratch_path

#: ``[\x20\x09-\x0D]``, the white space of every contract
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: texts are handled in slices of about this many bytes, which bounds a worker's memory
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: short lineage, and no recomputation when executors go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    full = F.coalesce(text, F.lit(""))
    return [F.xxhash64(full).alias("_k1"), F.xxhash64(F.lit("second"), full).alias("_k2")]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at row bounds, so that a slice holds about ``limit`` bytes of ``column``, one row at least.
    A column is given by name or, where names may repeat, by position."""
    if not batch.num_rows:
        return
    offsets, _ = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string array; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table_of(seed: int, size: int = 256) -> np.ndarray:
    """Random-looking 64-bit values by rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by ``(id_col, _k1, _k2, copies)``; of ``copies`` equal rows one.

    Rows with equal id and text are interchangeable only if their other columns agree; one of them stays.
    """
    left = keyed(docs, id_col, text_col).alias("l")
    right = kept.select(F.col(id_col).alias("r_id"), F.col("_k1").alias("r_k1"), F.col("_k2").alias("r_k2"), F.col("copies").alias("_copies"))
    on = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_k1") == F.col("r_k1")) & (F.col("_k2") == F.col("r_k2"))
    if kept.where("copies > 1").isEmpty():
        return left.join(right, on, "left_semi").select("_doc.*")
    joined = left.join(right, on)
    once = joined.where("_copies = 1").select("_doc.*")
    return once.unionByName(joined.where("_copies > 1").dropDuplicates(["r_id", "r_k1", "r_k2"]).select("_doc.*"))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Each row whole, as ``_doc``, beside ``_id, _k1, _k2`` and ``more``: no name in ``docs`` can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, F.col(f"`{id_col}`").alias("_id"), *text_keys(F.col(f"`{text_col}`")), *more)
