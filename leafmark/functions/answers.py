"""Citations, prompts and answer events as expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X


def parse_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources an answer cites, in order of first mention; unknown labels are dropped.

    ``answers`` is (answer_id, query_id, answer), ``sources`` is (query_id, source_id, ...).
    """
    labels = answers.select(
        "answer_id", "query_id", F.posexplode(X.cited_labels(F.col("answer"))).alias("position", "source_id")
    )
    return labels.join(sources, ["query_id", "source_id"])


def cite(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with their citation labels; uncited ones get the first four sources appended.

    Adds ``labels``, ``fallback`` and the completed, normalised ``answer``.
    """
    known = sources.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_no", "source_id"))).alias("known")
    )
    joined = answers.join(known, "query_id", "left").withColumn(
        "known_ids", F.coalesce(F.col("known.source_id"), F.array().cast("array<string>"))
    )
    cited = F.array_intersect(X.cited_labels(F.col("answer")), F.col("known_ids"))
    rows = joined.withColumn("cited", cited).withColumn(
        "fallback", (F.size("cited") == 0) & (F.size("known_ids") > 0)
    )
    labels = F.when(F.col("fallback"), F.slice("known_ids", 1, 4)).otherwise(F.col("cited"))
    marks = F.array_join(F.transform(labels, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " ")
    completed = F.when(
        F.col("fallback"), F.concat("answer", F.lit("\n\n" + R.FALLBACK_LABEL), marks)
    ).otherwise(F.col("answer"))
    return rows.select(
        "answer_id",
        "query_id",
        labels.alias("labels"),
        "fallback",
        X.normalize_answer(completed).alias("answer"),
    )


def source_block() -> Column:
    """Evidence text of one citation row."""
    c = F.col
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), c("source_id"), F.lit("] 文档："), c("document_title")),
        F.concat(
            F.lit("PDF 页码："),
            c("page_number"),
            F.coalesce(F.concat(F.lit("，印刷页码："), X.non_empty(c("printed_page"))), F.lit("")),
        ),
        F.concat(F.lit("章节："), X.non_empty(c("heading"))),
        F.concat(F.lit("原文："), c("excerpt")),
    )


def prompts(analysis: DataFrame, citations: DataFrame) -> DataFrame:
    """``(query_id, system, user)`` messages for the answering model."""
    blocks = (
        citations.select("query_id", "source_no", source_block().alias("block"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("source_no", "block"))).alias("blocks"))
    )
    label = F.create_map(*[F.lit(x) for pair in R.INTENT_LABELS.items() for x in pair])[F.col("intent")]
    topics = F.coalesce(X.non_empty(F.array_join("keywords", "、")), F.col("normalized"))
    evidence = F.when(F.size("blocks") > 0, F.array_join("blocks.block", "\n"))
    user = F.concat_ws(
        "\n",
        F.concat(F.lit(R.PROMPT_QUESTION), "question"),
        F.concat(F.lit(R.PROMPT_CONCEPTS), topics),
        F.concat(F.lit(R.PROMPT_INTENT), label),
        F.lit(""),
        F.lit(R.PROMPT_EVIDENCE),
        evidence,
        F.lit(""),
        F.lit(R.PROMPT_CLOSING),
    )
    return analysis.join(blocks, "query_id", "left").select(
        "query_id", F.lit(R.PROMPT_SYSTEM).alias("system"), user.alias("user")
    )


def retrieval_only_answer(warnings: Column) -> Column:
    """Answer text when no chat model is configured."""
    notes = F.when(F.size(warnings) > 0, F.concat(F.lit("\n\n"), F.array_join(warnings, "\n")))
    return F.concat(F.lit(R.MSG_NO_CHAT), F.coalesce(notes, F.lit("")))
