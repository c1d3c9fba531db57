"""Outline (table of contents) operators: headings, open sections, parents, section ends.

An outline is ``(document_id, seq, title, level, page_number)``; ``seq`` is the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators.keywords import containing
from leafmark.operators.running import running_max
from leafmark.session import write_table

OPEN_END = 9007199254740991


def outline_levels(outline: DataFrame) -> list[int]:
    """The nesting depths in use; their number is the depth of the outline, not its size."""
    return sorted(r[0] for r in outline.select("level").distinct().collect())


def page_context(pages: DataFrame, outline: DataFrame, levels: list[int]) -> DataFrame:
    """Per page: its heading and the sections open on it.

    The heading is the node with the greatest (page, level, seq) up to the page. The sections of level
    L open on page x are the level-L nodes on the last page up to x that has a node of level <= L.
    """
    named = outline.withColumn("title_key", X.fold(F.col("title")))
    on_page = named.groupBy("document_id", "page_number").agg(
        F.max(F.struct("page_number", "level", "seq", "title")).alias("heading"),
        F.min("level").alias("top"),
        F.collect_set(F.struct("level", "title_key")).alias("nodes"),
    )
    entries = on_page.select(
        "document_id",
        "page_number",
        "heading",
        *[
            F.when(
                F.col("top") <= level,
                F.struct(
                    F.col("page_number").alias("from"),
                    F.array_sort(
                        F.transform(
                            F.filter("nodes", lambda n: n["level"] == level), lambda n: n["title_key"]
                        )
                    ).alias("titles"),
                ),
            ).alias(f"open_{level}")
            for level in levels
        ],
    )
    opens = [f"open_{level}" for level in levels]
    found = running_max(pages, entries, ["document_id"], "page_number", ["heading", *opens])
    return found.select(
        "document_id",
        "page_number",
        F.col("heading.title").alias("heading"),
        F.filter(F.array(*opens), lambda s: s.isNotNull() & (F.size(s["titles"]) > 0)).alias("sections")
        if opens
        else F.array().cast("array<struct<from:bigint,titles:array<string>>>").alias("sections"),
    )


def toc_parents(outline: DataFrame, levels: list[int]) -> DataFrame:
    """Parent = the latest earlier node of at most the level above, if it has exactly that level."""
    entries = outline.select(
        "document_id",
        "seq",
        *[
            F.when(F.col("level") <= level, F.struct("seq", "level")).alias(f"last_{level}")
            for level in levels
        ],
    )
    names = [f"last_{level}" for level in levels]
    prior = running_max(outline, entries, ["document_id"], "seq", names, inclusive=False)
    parent = F.lit(None).cast("long")
    for level in levels:
        parent = F.when(
            (F.col("level") == level + 1) & (F.col(f"last_{level}.level") == level),
            F.col(f"last_{level}.seq"),
        ).otherwise(parent)
    return outline.join(prior, ["document_id", "seq"]).select(
        *outline.columns, parent.alias("parent_seq")
    )


def toc_sections(outline: DataFrame, levels: list[int]) -> DataFrame:
    """Adds the last page of each section: one before the next page with a node of the same or a
    higher rank, open-ended otherwise. "Next" is a running maximum over negated pages."""
    mirrored = outline.withColumn("_back", -F.col("page_number"))
    entries = mirrored.select(
        "document_id",
        "_back",
        *[F.when(F.col("level") <= level, F.col("_back")).alias(f"next_{level}") for level in levels],
    )
    names = [f"next_{level}" for level in levels]
    following = running_max(mirrored, entries, ["document_id"], "_back", names, inclusive=False)
    nxt = F.lit(None).cast("long")
    for level in levels:
        nxt = F.when(F.col("level") == level, -F.col(f"next_{level}")).otherwise(nxt)
    return mirrored.join(following, ["document_id", "_back"]).select(
        *outline.columns, F.coalesce(nxt - 1, F.lit(OPEN_END)).alias("end_page")
    )


def section_matches(sections: DataFrame, keywords: DataFrame) -> DataFrame:
    """Sections whose title contains a keyword, for ``(query_id, keyword)`` rows.

    All keywords together walk once over each title (:mod:`leafmark.operators.keywords`); what is joined afterwards
    are hits, by keyword.
    """
    asked = keywords.select("query_id", X.fold(F.col("keyword")).alias("keyword")).where(F.length("keyword") >= 2)
    asked = write_table(asked.distinct(), "asked_keywords")
    titles = sections.select("document_id", "seq", "page_number", "end_page", X.fold(F.col("title")).alias("title_key"))
    hits = containing(titles, "title_key", asked.select("keyword")).drop("title_key")
    return (
        hits.join(asked, "keyword")
        .select("query_id", "document_id", "seq", F.col("page_number").alias("from_page"), F.col("end_page").alias("to_page"))
        .distinct()
    )


def section_boost(sections: Column, page_number: Column, keywords: Column) -> Column:
    """0.55 on the first page of a matching section, 0.18 inside it, over the open sections of a page."""

    def named(s: Column) -> Column:
        return F.exists(
            s["titles"],
            lambda t: F.exists(keywords, lambda k: (F.length(k) >= 2) & F.contains(t, k)),
        )

    return (
        F.when(F.exists(sections, lambda s: (s["from"] == page_number) & named(s)), F.lit(0.55))
        .when(F.exists(sections, lambda s: (s["from"] < page_number) & named(s)), F.lit(0.18))
        .otherwise(F.lit(0.0))
    )
