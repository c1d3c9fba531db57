"""Weighted reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rules as R


def fuse(lists: DataFrame, k: int = R.RRF_K) -> DataFrame:
    """``(query_id, weight, chunk_id, rank)`` rows of all lists to one score and best rank per chunk."""
    return lists.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min("rank").alias("rank")
    )
