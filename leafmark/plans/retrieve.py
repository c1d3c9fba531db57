"""Questions to cited pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.functions.query import analyze, variant_terms
from leafmark.operators import rerank
from leafmark.operators.fusion import fuse
from leafmark.operators.indexing import SearchIndex
from leafmark.operators.joins import sized_join
from leafmark.operators.lexical import in_scope, search
from leafmark.operators.vectors import top_cosine
from leafmark.session import fan_out, write_table

ANALYSIS = [
    "question", "normalized", "chip_models", "identifiers", "peripherals", "keywords", "intent", "aspects",
]
CHUNK = ["document_id", "document_title", "page_number", "printed_page", "heading", "sections", "text"]


@dataclass(frozen=True)
class Retrieval:
    analysis: DataFrame
    hits: DataFrame
    citations: DataFrame


def fused_hits(
    index: SearchIndex,
    analysis: DataFrame,
    scope: list[str] | None = None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
    depth: int | None = R.LEXICAL_LIMIT,
    vector_depth: int = R.VECTOR_LIMIT,
    term_limit: int | None = R.TERM_LIMIT,
    rare_share: float | None = R.RARE_SHARE,
) -> DataFrame:
    """Fused lexical and (optionally) vector lists, joined with their chunk rows.

    ``vectors`` is ``(query_id, vector)`` and ``(chunk_id, document_id, vector)``.
    """
    found = search(index, variant_terms(analysis), analysis.select("query_id", "keywords"), depth, scope, term_limit, rare_share)
    lists = found.lists.select("query_id", "weight", "chunk_id", "rank")
    chunks = found.chunks.select("chunk_id", *CHUNK)
    if vectors:
        asked, stored = vectors
        near = write_table(top_cosine(asked, in_scope(stored, scope), vector_depth), "near_chunks")
        lists = lists.unionByName(
            near.select("query_id", F.lit(R.VECTOR_WEIGHT).alias("weight"), "chunk_id", "rank")
        )
        extra = near.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti")
        chunks = chunks.unionByName(
            sized_join(index.chunks.select("chunk_id", *CHUNK), write_table(extra, "vector_chunks"), ["chunk_id"])
        )
    return fuse(lists).join(chunks, "chunk_id")


def retrieve(
    index: SearchIndex,
    questions: DataFrame,
    limit: int | None = R.FINAL_LIMIT,
    document_ids: list[str] | None = None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
    *,
    depth: int | None = R.LEXICAL_LIMIT,
    vector_depth: int = R.VECTOR_LIMIT,
    term_limit: int | None = R.TERM_LIMIT,
    rare_share: float | None = R.RARE_SHARE,
    per_document: int | None = R.PER_DOCUMENT,
    floor: float | None = R.SCORE_FLOOR,
    inventory_limit: int | None = R.INVENTORY_LIMIT,
) -> Retrieval:
    """Citations ``S1..`` for every ``(query_id, question)``.

    The defaults are the ranking's definition. Each cut can be raised, or switched off with ``None``:
    ``limit`` sources, ``depth`` of a lexical list, ``term_limit`` and ``rare_share`` of a query's terms
    (see ``select_terms``), ``per_document``, ``floor`` and ``inventory_limit`` (see ``select_diverse``).
    ``vector_depth`` is the length of the vector list.
    """
    analysis = write_table(analyze(fan_out(questions, "query_id")), "analysis")
    hits = fused_hits(index, analysis, document_ids, vectors, depth, vector_depth, term_limit, rare_share)
    most = analysis.agg(F.max(F.size("aspects"))).first()[0] or 0
    ranked = rerank.scored(
        fan_out(hits, "query_id").join(analysis.select("query_id", *ANALYSIS), "query_id")
    )
    chosen = rerank.select_diverse(
        ranked.select(
            "query_id", "chunk_id", *[c for c in CHUNK if c != "sections"], "score", "rank",
            "aspect_heading", "aspect_any", "inventory",
        ),
        most,
        limit,
        per_document,
        floor,
        inventory_limit,
    )
    return Retrieval(analysis, ranked, citations(chosen))


def citations(chosen: DataFrame) -> DataFrame:
    return chosen.select(
        "query_id",
        F.concat(F.lit("S"), F.col("source_no")).alias("source_id"),
        "source_no",
        "document_id",
        "document_title",
        "chunk_id",
        "page_number",
        "printed_page",
        "heading",
        X.excerpt(F.col("text")).alias("excerpt"),
        "score",
    )


def retrieval_warnings(
    questions: DataFrame, cited: DataFrame, has_vectors: bool, vector_error: str | None = None
) -> DataFrame:
    """``(query_id, warnings)``: why an answer may be thin."""
    general = (
        F.lit(R.MSG_VECTORS_FAILED + vector_error)
        if vector_error
        else F.lit(None).cast("string")
        if has_vectors
        else F.lit(R.MSG_NO_VECTORS)
    )
    hit = cited.select("query_id").distinct().withColumn("hit", F.lit(True))
    return questions.join(hit, "query_id", "left").select(
        "query_id",
        F.filter(
            F.array(general, F.when(F.col("hit").isNull(), F.lit(R.MSG_NO_HITS))), lambda m: m.isNotNull()
        ).alias("warnings"),
    )
