"""Running maximum over long, possibly skewed, ordered groups.

As-of lookups ("latest outline node up to this page", "next node of at most this level") are running
maxima. A window over the whole group would put a document that holds a third of the pages into one
task, so positions are cut into spans: each span is scanned on its own, span totals - one row per
span - are scanned at the level above, and the two are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN_BITS = 16


def running_max(
    points: DataFrame,
    entries: DataFrame,
    keys: list[str],
    pos: str,
    values: list[str],
    inclusive: bool = True,
    span_bits: int = SPAN_BITS,
) -> DataFrame:
    """For every distinct point ``(keys, pos)``: the maximum of each value over the entries of the
    same keys at positions up to (``inclusive``) or strictly before the point."""
    span = F.shiftright(F.col(pos).cast("long"), span_bits)
    at_pos = entries.groupBy(*keys, pos).agg(*[F.max(v).alias(v) for v in values])
    at_pos = at_pos.withColumn("_span", span)
    asked = points.select(*keys, pos).distinct().withColumn("_span", span)

    local = _scan(asked, at_pos, [*keys, "_span"], pos, values, inclusive)
    totals = at_pos.groupBy(*keys, "_span").agg(*[F.max(v).alias(v) for v in values])
    carry = _scan(asked.select(*keys, "_span").distinct(), totals, keys, "_span", values, False)
    carry = carry.select(*keys, "_span", *[F.col(v).alias(f"_c_{v}") for v in values])
    return local.join(carry, [*keys, "_span"], "left").select(
        *keys, pos, *[F.greatest(v, f"_c_{v}").alias(v) for v in values]
    )


def _scan(points, entries, keys, pos, values, inclusive):
    entry_side, point_side = (0, 1) if inclusive else (1, 0)
    cols = list(dict.fromkeys([*keys, pos]))
    types = {f.name: f.dataType for f in entries.schema.fields}
    both = entries.select(*cols, F.lit(entry_side).alias("_side"), *values).unionByName(
        points.select(*cols, F.lit(point_side).alias("_side"), *[F.lit(None).cast(types[v]).alias(v) for v in values])
    )
    w = W.partitionBy(*keys).orderBy(pos, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        both.select(*cols, "_side", *[F.max(v).over(w).alias(v) for v in values])
        .where(F.col("_side") == point_side)
        .drop("_side")
    )


def running_fold(
    rows: DataFrame, keys: list[str], pos: str, order: list[str], span_bits: int = SPAN_BITS, **values: tuple
) -> DataFrame:
    """``rows`` with running values over the rows of the same keys before each row, its own left out.

    ``values`` maps a name to ``(fold, column, start)``; ``fold`` is "sum" or "max" and ``start`` stands for no rows.
    Rows are ordered by ``pos`` (a long), then by ``order``. As above, a window holds one span of ``pos`` at most,
    and the totals of spans are folded one level up.
    """
    folds = {"sum": F.sum, "max": F.max}
    joined = {"sum": lambda a, b: a + b, "max": F.greatest}
    cut = rows.withColumns({"_span": F.shiftright(F.col(pos).cast("long"), span_bits), **{f"_{n}": c for n, (_, c, _) in values.items()}})
    inside = W.partitionBy(*keys, "_span").orderBy(pos, *order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_span").agg(*[folds[f](f"_{n}").alias(f"_{n}") for n, (f, _, _) in values.items()])
    carried = totals.select(*keys, "_span", *[folds[f](f"_{n}").over(before).alias(f"_c_{n}") for n, (f, _, _) in values.items()])
    local = cut.select(*rows.columns, "_span", *[folds[f](f"_{n}").over(inside).alias(f"_l_{n}") for n, (f, _, _) in values.items()])
    both = {n: joined[f](F.coalesce(f"_l_{n}", F.lit(s)), F.coalesce(f"_c_{n}", F.lit(s))) for n, (f, _, s) in values.items()}
    return local.join(carried, [*keys, "_span"]).select(*rows.columns, *[c.alias(n) for n, c in both.items()])
