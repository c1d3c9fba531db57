"""Joins whose strategy follows measured sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1000


def _weight(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, arrays and structs by their length as JSON, others 8."""
    parts, nested = [F.lit(8 * len(df.columns))], []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            nested.append(F.col(f"`{field.name}`"))
    if nested:
        parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(*nested))), F.lit(0)))
    return reduce(lambda a, b: a + b, [p.cast("long") for p in parts])


def fits(small: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of a stored side stay under ``limit`` and its measured bytes under ``most``."""
    rows, size = small.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(_weight(small))).first()
    return rows <= limit and (size or 0) <= most


def sized_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES
) -> DataFrame:
    """Join against a stored side that is broadcast only if its counted rows stay under ``limit`` and its measured
    bytes under ``most``.

    Above either both sides are shuffled and adaptive execution splits hot partitions.
    """
    return big.join(F.broadcast(small) if fits(small, limit, most) else small, on, how)


def hot_key_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """Join a left side with skewed keys to a right side with one row per key.

    ``right[weight]`` counts the left rows of each key. Keys that hold at least 1/1000 of the left
    rows - at most 1000 of them, whatever the data - are resolved by a broadcast join. The other rows
    are shuffled by key; rows already resolved get a key of their own there, so they spread out.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    payload = [c for c in right.columns if c != key]
    values = F.struct(*payload)
    hot = right.where(F.col(weight) * HOT_SHARE >= total).select(key, values.alias("_hot"))
    rest = right.select(F.concat(F.lit("k:"), F.col(key)).alias("_key"), values.alias("_cold"))
    staged = left.join(F.broadcast(hot), key, "left").withColumn(
        "_key",
        F.when(F.col("_hot").isNull(), F.concat(F.lit("k:"), F.col(key))).otherwise(
            F.concat(F.lit("r:"), F.xxhash64(*left.columns).cast("string"))
        ),
    )
    found = F.coalesce("_hot", "_cold")
    joined = staged.join(rest, "_key", "left")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*left.columns, *[found[c].alias(c) for c in payload])
