"""Retrieval quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators.indexing import SearchIndex
from leafmark.operators.joins import sized_join
from leafmark.operators.keywords import containing
from leafmark.session import write_table

# wording that marks a title as not worth asking about (fixed values)
SKIPPED_TITLES = "目录|相关文档|参考文献|版本|(?i)[.]png|[.]jpg|[.]xlsx|[.]pdf"
NON_TECHNICAL = "一路走来|前言|致谢|索引|术语|词汇|关于本|声明|修订|勘误|设计提示|提示和技巧"


def outline_questions(sections: DataFrame, page_counts: DataFrame) -> DataFrame:
    """One question per technical outline title, with the page range that answers it."""
    topic = X.strip(F.regexp_replace("title", r"^\s*[0-9]+(\.[0-9]+)*\s*", ""))
    return (
        sections.where((F.length("title") >= 5) & ~F.col("title").rlike(SKIPPED_TITLES))
        .withColumn("topic", topic)
        .where((F.length("topic") >= 4) & ~F.col("topic").rlike(NON_TECHNICAL))
        .join(page_counts, "document_id")
        .select(
            "document_id",
            "seq",
            F.concat("topic", F.lit(" 怎么配置")).alias("question"),
            F.col("page_number").alias("page_from"),
            F.greatest("page_number", F.least("end_page", "last_page")).alias("page_to"),
        )
    )


def containing_pages(index: SearchIndex, passages: DataFrame, pages: DataFrame) -> DataFrame:
    """``(query_id, document_id, page_number)`` of every page whose text contains ``(query_id, question)``.

    Candidates are the pages that hold the rarest term of the passage without its first and last word, which
    may be parts of longer words in the page. Passages without such a term are looked for in all pages, all of them
    in one walk over each page.
    """
    inner = F.regexp_replace("question", r"^\s*\S+\s|\s\S+\s*$", " ")
    terms = write_table(passages.select("query_id", F.explode(X.search_terms(inner)).alias("term")).where(F.size(X.subtokens(F.col("term"))) == 1), "inner_terms")
    known = terms.join(index.frequency_of(terms), "term")
    rarest = write_table(known.groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("least")).select("query_id", "least.term"), "rarest")
    held = index.found_in(rarest.withColumnRenamed("term", "piece"))
    near = write_table(held.select("query_id", "document_id", "page_number").distinct(), "near_pages")
    whole = sized_join(pages, near, ["document_id", "page_number"]).join(passages, "query_id")
    found = whole.where(F.contains("text", F.col("question"))).select("query_id", "document_id", "page_number")
    bare = write_table(passages.join(rarest, "query_id", "left_anti").where(F.length("question") > 0).select("query_id", F.col("question").alias("keyword")), "bare_passages")
    if bare.isEmpty():
        return found
    walked = containing(pages.select("document_id", "page_number", "text"), "text", bare.select("keyword")).drop("text")
    return found.unionByName(walked.join(bare, "keyword").select(found.columns))


def page_match_rate(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of the transcripts with a true page: how often is one the best match, or among the candidates?"""
    key = ["query_id", "document_id", "page_number"]
    best = truth.join(candidates.select(*key, "rank"), key, "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("top1"),
        F.count("rank").alias("in_candidates"),
    )


def hit_rate(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Share of cases ``(suite, query_id, document_id, page_from, page_to)`` with a cited page in range,
    among all sources and as the first source."""
    inside = citations.select(
        "query_id", "source_no", F.col("document_id").alias("_doc"), "page_number"
    )
    matched = (
        cases.join(inside, "query_id", "left")
        .groupBy("suite", "query_id")
        .agg(
            F.coalesce(
                F.min(
                    F.when(
                        (F.col("document_id") == F.col("_doc"))
                        & F.col("page_number").between(F.col("page_from"), F.col("page_to")),
                        F.col("source_no"),
                    )
                ),
                F.lit(0),
            ).alias("first_hit")
        )
    )
    return matched.groupBy("suite").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("first_hit") > 0).alias("hits"),
        F.count_if(F.col("first_hit") == 1).alias("top1"),
        F.round(F.avg((F.col("first_hit") > 0).cast("double")), 6).alias("hit_rate"),
    )
