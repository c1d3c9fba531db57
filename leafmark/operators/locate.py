"""Which page does a transcribed text come from? Inverse-frequency overlap, for many texts at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.operators.indexing import SearchIndex
from leafmark.operators.joins import sized_join
from leafmark.operators.lexical import document_frequency, in_scope, scoped_total
from leafmark.operators.products import page_scores
from leafmark.session import write_table

PAGE = ["document_id", "page_number"]


def transcript_terms(transcripts: DataFrame, limit: int | None = R.LOCATE_TERM_LIMIT) -> DataFrame:
    """``(query_id, terms)``: the first ``limit`` terms of each normalised transcript, or all."""
    terms = X.search_terms(X.ocr_text(F.col("question")))
    return transcripts.select("query_id", (terms if limit is None else F.slice(terms, 1, limit)).alias("terms"))


def term_weights(
    index: SearchIndex,
    terms: DataFrame,
    scope: list[str] | None,
    least_terms: int = R.LOCATE_LEAST_TERMS,
    rare_share: float | None = R.LOCATE_RARE_SHARE,
) -> DataFrame:
    """``(query_id, term, weight)`` of terms found in at most ``max(4, rare_share)`` of the chunks, or in
    any; transcripts with fewer than ``least_terms`` terms have none."""
    total = scoped_total(index, scope)
    exploded = terms.where(F.size("terms") >= least_terms).select("query_id", F.explode("terms").alias("term"))
    distinct = write_table(exploded.select("term").distinct(), "locate_terms")
    rarity = F.log(1 + F.lit(float(total)) / (1 + F.col("df")))
    usable = document_frequency(index, distinct, scope).where(F.col("df") > 0)
    if rare_share is not None:
        usable = usable.where(F.col("df") <= max(4, math.floor(total * rare_share + 1e-9)))
    return exploded.join(usable.select("term", (rarity * rarity).alias("weight")), "term")


def rank_pages(
    index: SearchIndex,
    transcripts: DataFrame,
    scope: list[str] | None = None,
    limit: int = R.FINAL_LIMIT,
    *,
    term_limit: int | None = R.LOCATE_TERM_LIMIT,
    least_terms: int = R.LOCATE_LEAST_TERMS,
    rare_share: float | None = R.LOCATE_RARE_SHARE,
) -> DataFrame:
    """Best ``limit`` pages per transcript with the chunk that shows most of its terms.

    A page scores the weight of the terms any of its chunks holds, over the weight of all usable terms.
    If fewer pages share a term, pages with score 0 follow in page order. The other parameters are the
    ranking's definition; see ``transcript_terms`` and ``term_weights``.
    """
    terms = transcript_terms(transcripts, term_limit)
    weights = write_table(term_weights(index, terms, scope, least_terms, rare_share), "locate_weights")
    chunks = in_scope(index.chunks, scope)
    # exact terms, not pieces of them; only what may be among the best of a query leaves a task
    matched = write_table(page_scores(weights, chunks.select(*PAGE, "tokens"), PAGE, limit), "matched_pages")
    # fewer than ``limit`` matched pages: the rest is found among the first ``2 * limit`` pages of all
    asked = weights.select("query_id").distinct()
    short = asked.join(matched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = short.where(F.coalesce("n", F.lit(0)) < limit).select("query_id")
    first = chunks.select(*PAGE).distinct().orderBy(*PAGE).limit(2 * limit).collect()
    if first:
        pages = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in PAGE]) for r in first])
        empty = short.select("query_id", F.inline(pages)).join(matched.select("query_id", *PAGE), ["query_id", *PAGE], "left_anti")
        matched = matched.unionByName(empty.withColumn("matched", F.lit(0.0)))
    whole = weights.groupBy("query_id").agg(
        F.sum("weight").alias("whole"), F.collect_list("term").alias("usable")
    )
    w = W.partitionBy("query_id").orderBy(F.desc("score"), *PAGE)
    ranked = (
        matched.join(whole.drop("usable"), "query_id")
        .withColumn("score", F.round(F.col("matched") / F.col("whole"), 9))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .select("query_id", *PAGE, "score", "rank")
    )
    best_pages = write_table(ranked, "best_pages")
    shown = sized_join(
        chunks.select(*PAGE, "document_title", "printed_page", "heading", "chunk_index", "text", "tokens"),
        best_pages,
        PAGE,
    ).join(whole.select("query_id", "usable"), "query_id")
    shared = F.size(F.array_intersect("tokens", "usable"))
    return (
        shown.groupBy("query_id", "rank", *PAGE, "score")
        .agg(
            F.max_by(
                F.struct("document_title", "printed_page", "heading", "chunk_index", "text"),
                F.struct(shared, -F.col("chunk_index")),
            ).alias("best")
        )
        .select(
            "query_id", "rank", *PAGE, "score",
            "best.document_title", "best.printed_page", "best.heading", "best.chunk_index",
            X.excerpt(F.col("best.text"), 260).alias("excerpt"),
        )
    )


def match_result(
    transcripts: DataFrame,
    candidates: DataFrame,
    *,
    term_limit: int | None = R.LOCATE_TERM_LIMIT,
    least_terms: int = R.LOCATE_LEAST_TERMS,
) -> DataFrame:
    """One row per transcript: confidence, decision and warnings."""
    best = candidates.groupBy("query_id").agg(
        F.max("score").alias("confidence"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up"),
        F.count(F.lit(1)).alias("n"),
    )
    text = F.col("question")
    few = F.size("terms") < least_terms
    rows = (
        transcripts.join(transcript_terms(transcripts, term_limit), "query_id")
        .join(best, "query_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("confidence", F.when(text.isNull() | few, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
    )
    warning = (
        F.when(text.isNull() | (text == ""), F.array(F.lit(R.MSG_NO_TEXT)))
        .when(few, F.array(F.lit(R.MSG_FEW_TERMS)))
        .when(F.col("n") == 0, F.array(F.lit(R.MSG_NO_PAGE)))
        .otherwise(
            F.filter(
                F.array(
                    F.when(F.col("confidence") < 0.3, F.lit(R.MSG_LOW_CONFIDENCE)),
                    F.when(
                        (F.col("n") > 1) & (F.col("confidence") - F.col("runner_up") < 0.05),
                        F.lit(R.MSG_CLOSE_SCORES),
                    ),
                ),
                lambda m: m.isNotNull(),
            )
        )
    )
    return rows.select(
        "query_id",
        (F.col("confidence") >= 0.25).alias("matched"),
        "confidence",
        F.col("n").cast("long").alias("candidates"),
        warning.alias("warnings"),
    )
