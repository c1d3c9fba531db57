"""Library reads, deletes and reports over document, page, outline and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators.joins import sized_join


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "pdf", 0).when(kind == "xlsx", 1).otherwise(2)


def index_coverage(kind: Column, chunk_count: Column) -> Column:
    return F.when(chunk_count == 0, "none").when(kind == "image", "metadata").otherwise("content")


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with chunk count and coverage; pdf, xlsx, others, oldest first."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    return (
        documents.join(counts, "document_id", "left")
        .select(
            *documents.columns,
            count.alias("indexed_chunk_count"),
            index_coverage(F.col("kind"), count).alias("index_coverage"),
        )
        .orderBy(kind_rank(F.col("kind")), "created_at", "document_id")
    )


def find_by_hash(documents: DataFrame, sha256: str) -> DataFrame:
    return documents.where(F.col("sha256") == sha256).limit(1)


def name_filter(documents: DataFrame, needle: str) -> DataFrame:
    """Documents whose title and file name contain the trimmed, lower-cased text."""
    name = F.lower(F.concat_ws(" ", "title", "original_filename"))
    return documents.where(F.contains(name, F.lower(X.strip(F.lit(needle)))))


def toc(outline: DataFrame, document_id: str) -> DataFrame:
    return outline.where(F.col("document_id") == document_id).orderBy("page_number", "level", "seq")


def prune_selection(selected: DataFrame, documents: DataFrame) -> DataFrame:
    return selected.join(documents.select("document_id"), "document_id", "left_semi")


def delete_cascade(tables: dict[str, DataFrame], removed: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """What stays of every table once the documents in the stored table ``removed(document_id)`` are
    gone. A table without the key hangs on chunks and follows them by ``chunk_id``."""
    gone = removed.select(key).distinct()
    kept = {n: sized_join(t, gone, [key], "left_anti") for n, t in tables.items() if key in t.columns}
    if any(key not in t.columns for t in tables.values()):
        lost = sized_join(tables["chunks"], gone, [key], "left_semi").select("chunk_id")
        for name, t in tables.items():
            if key not in t.columns:
                kept[name] = t.join(lost, "chunk_id", "left_anti")
    return kept


def coverage_report(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Extraction quality per document: a page with fewer than 20 characters counts as empty."""
    chars = F.length(X.compact(F.col("text")))
    nodes = outline.groupBy("document_id").agg(F.count(F.lit(1)).alias("outline_nodes"))
    per_doc = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(chars < 20).alias("empty_pages"),
        F.sum(chars).alias("chars"),
    )
    return per_doc.join(nodes, "document_id", "left").select(
        "document_id",
        "pages",
        "empty_pages",
        F.round((F.col("pages") - F.col("empty_pages")) / F.col("pages") * 100, 2).alias("coverage"),
        F.round(F.col("chars") / F.col("pages")).cast("long").alias("avg_chars_per_page"),
        F.coalesce("outline_nodes", F.lit(0)).cast("long").alias("outline_nodes"),
    )


def total_pages(documents: DataFrame) -> DataFrame:
    return documents.agg(F.sum("page_count").alias("total_pages"))
