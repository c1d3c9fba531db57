"""Running totals and successors inside groups that may hold any share of the rows.

A window over a whole group would put a group of a third of all rows into one task. Values are therefore cut into
spans; a window holds one span, and what crosses spans is found among the spans themselves.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN_BITS = 12
#: a span below all others, for null
LOWEST = -(1 << 52)


def running(rows: DataFrame, keys: list[str], at: str, order: list[Column], fold: str = "sum", **values: Column) -> DataFrame:
    """``rows`` with each of ``values`` folded (``sum`` or ``bit_xor``) over the rows of the same ``keys`` up to this one.

    Rows stand by ``at`` (an integer, null first), then by ``order``. A window holds ``2**SPAN_BITS`` values of
    ``at``; totals of spans are folded in a second step.
    """
    folds = {"sum": F.sum, "bit_xor": F.bit_xor}[fold]
    joined = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}[fold]
    span = F.coalesce(F.shiftright(F.col(at).cast("long"), SPAN_BITS), F.lit(LOWEST)).alias("_span")
    cut = rows.select("*", span, *[v.alias(f"_{n}") for n, v in values.items()])
    inside = W.partitionBy(*keys, "_span").orderBy(F.asc_nulls_first(at), *order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_span").agg(*[folds(f"_{n}").alias(f"_{n}") for n in values])
    carried = totals.select(*keys, "_span", *[F.coalesce(folds(f"_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values])
    local = cut.select(*rows.columns, "_span", *[folds(f"_{n}").over(inside).alias(f"_l_{n}") for n in values])
    return local.join(carried, [*keys, "_span"]).select(*rows.columns, *[joined(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values])


def following(rows: DataFrame, keys: list[str], at: str, name: str = "following", levels: int = 3) -> DataFrame:
    """``rows`` with the next greater value of ``at`` among the rows of the same ``keys``, null for the greatest.

    ``keys`` and ``at`` (a long) name a row and are not null. Spans follow the range and number of the values, so
    that one holds about ``2**SPAN_BITS`` rows of evenly spread values; the last level is one window a group.
    """
    if levels == 1:
        return rows.withColumn(name, F.lead(at).over(W.partitionBy(*keys, F.lit(0)).orderBy(at)))
    low, high, count = rows.agg(F.min(at), F.max(at), F.count(at)).first()
    low, width = low or 0, max(1, (((high or 0) - (low or 0) + 1) << SPAN_BITS) // max(1, count))
    offset = F.col(at).cast("decimal(20,0)") - F.lit(Decimal(low))
    cut = rows.withColumn("_span", F.call_function("div", offset, F.lit(Decimal(width))))
    inside = W.partitionBy(*keys, "_span").orderBy(at)
    local = cut.select("*", F.lead(at).over(inside).alias("_near"))
    heads = cut.groupBy(*keys, "_span").agg(F.min(at).alias("_head"))
    after = following(heads, keys, "_span", "_after", levels - 1)
    ahead = after.select(*keys, F.col("_span").alias("_s"), F.col("_after").alias("_span")).where("_span is not null")
    far = ahead.join(heads, [*keys, "_span"]).select(*keys, F.col("_s").alias("_span"), F.col("_head").alias("_far"))
    return local.join(far, [*keys, "_span"], "left").select(*rows.columns, F.coalesce("_near", "_far").alias(name))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
