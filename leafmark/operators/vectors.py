"""Exact cosine search and the vector index build."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.session import write_table

QUERY_BLOCK = 2048


def top_cosine(
    queries: DataFrame, vectors: DataFrame, limit: int = R.VECTOR_LIMIT, block: int = QUERY_BLOCK
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the ``limit`` nearest of ``vectors(chunk_id, vector)`` to
    each of ``queries(query_id, vector)``, by exact cosine; vectors of another length do not take part
    and a zero vector scores -1.

    Up to about ``block`` query vectors travel to the tasks as one matrix, and each task passes on its
    own best ``limit`` per query. More queries are answered block by block, one pass over the vectors
    and one stored result each, so neither driver nor task ever holds more than a block.
    """
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return _rank(_pass(queries, vectors, limit), limit)
    stored = write_table(queries, "query_vectors")
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    done = [write_table(_pass(stored.where(number == n), vectors, limit), "near") for n in range(blocks)]
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return _rank(result, limit)


def _rank(near: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _pass(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    rows = queries.select("query_id", "vector").collect()
    by_dims: dict[int, tuple[list, np.ndarray]] = {}
    for dims in {len(r.vector) for r in rows}:
        chosen = [r for r in rows if len(r.vector) == dims]
        by_dims[dims] = ([r.query_id for r in chosen], _unit(np.array([r.vector for r in chosen])))
    shared = queries.sparkSession.sparkContext.broadcast(by_dims)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for batch in batches:
            found = [f for f in _batch_hits(batch, shared.value, limit)]
            if found:
                merged = pd.concat(found if best is None else [best, *found])
                merged = merged.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
                best = merged.groupby("query_id", sort=False).head(limit)
        if best is not None:
            yield best

    query_type = queries.schema["query_id"].dataType.simpleString()
    chunk_type = vectors.schema["chunk_id"].dataType.simpleString()
    return vectors.select("chunk_id", "vector").mapInPandas(
        nearest, f"query_id {query_type}, chunk_id {chunk_type}, score double"
    )


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros become NaN and are scored -1 later."""
    matrix = matrix.astype(np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.full_like(matrix, np.nan), where=norms > 0)


def _batch_hits(batch: pd.DataFrame, by_dims: dict, limit: int) -> Iterator[pd.DataFrame]:
    batch = batch.sort_values("chunk_id", kind="stable")
    dims = batch["vector"].map(len)
    for size, (ids, matrix) in by_dims.items():
        part = batch[dims == size]
        if not len(part) or not size:
            continue
        unit = _unit(np.stack(part["vector"].to_numpy()))
        scores = np.round(np.nan_to_num(matrix @ unit.T, nan=-1.0), 9)
        keys = part["chunk_id"].to_numpy()
        for query_id, row in zip(ids, scores):
            cut = np.partition(row, -limit)[-limit] if len(row) > limit else -np.inf
            near = np.flatnonzero(row >= cut)
            near = near[np.argsort(-row[near], kind="stable")[:limit]]
            yield pd.DataFrame({"query_id": query_id, "chunk_id": keys[near], "score": row[near]})
