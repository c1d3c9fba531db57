"""Import bookkeeping: content hashes, first copies, import status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.operators.joins import hot_key_join


def first_copies(rows: DataFrame, hash_col: str, order_col: str) -> DataFrame:
    """One row per hash: the whole first row by ``order_col`` and the number of copies.

    Copies collapse before the shuffle, so a text that makes up a third of the input costs one row
    per map task. Pass narrow rows: everything in them travels with the minimum.
    """
    others = [c for c in rows.columns if c not in (hash_col, order_col)]
    first = F.min(F.struct(order_col, *others)).alias("_first")
    return rows.groupBy(hash_col).agg(first, F.count(F.lit(1)).alias("copies")).select(
        hash_col, *[F.col(f"_first.{c}").alias(c) for c in (order_col, *others)], "copies"
    )


def import_status(rows: DataFrame, hash_col: str, order_col: str, library: DataFrame | None = None) -> DataFrame:
    """``imported`` for the first row of a hash the library does not hold, else ``duplicate``.

    ``library`` has ``(hash_col, order_col)`` of documents imported earlier; they win.
    """
    narrow = rows.select(hash_col, order_col)
    firsts = narrow.groupBy(hash_col).agg(
        F.min(order_col).alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    if library is not None:
        held = library.groupBy(hash_col).agg(F.min(order_col).alias("held_id"))
        firsts = firsts.join(held, hash_col, "left").select(
            hash_col, F.coalesce("held_id", "first_id").alias("first_id"), "copies"
        )
    return hot_key_join(narrow, firsts, hash_col, "copies").select(
        order_col,
        hash_col,
        F.when(F.col("first_id") == F.col(order_col), "imported").otherwise("duplicate").alias("status"),
        F.when(F.col("first_id") != F.col(order_col), F.col("first_id")).alias("duplicate_of"),
    )
