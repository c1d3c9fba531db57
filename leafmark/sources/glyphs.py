"""Positioned text runs to page text: lines from the top down, runs from left to right.

Extracting runs from PDF bytes is the job of an injected reader (see ``files``); this is what happens
to its rows ``(*page keys, run_no, str, x, y)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as X


def joined_runs(runs: Column) -> Column:
    """Concatenate runs; a blank goes between two runs only where two Latin words would touch."""

    def spaced(all_runs: Column, run: Column, i: Column) -> Column:
        before = F.get(all_runs, i - 1)
        touching = F.right(before, F.lit(1)).rlike("[A-Za-z0-9)]") & F.left(run, F.lit(1)).rlike("[A-Za-z0-9(]")
        return F.when(touching, F.concat(F.lit(" "), run)).otherwise(run)

    return X.let(runs, lambda r: F.array_join(F.transform(r, lambda run, i: spaced(r, run, i)), ""))


def lines(runs: DataFrame, page: list[str]) -> DataFrame:
    """One row per text line; runs whose rounded ``y`` agrees share a line."""
    placed = runs.where(F.col("str") != "").withColumn("line_y", F.floor(F.col("y") * 10 + 0.5) / 10)
    return (
        placed.groupBy(*page, "line_y")
        .agg(F.array_sort(F.collect_list(F.struct("x", "run_no", "str"))).alias("runs"))
        .select(*page, "line_y", X.strip(joined_runs(F.col("runs.str"))).alias("line"))
        .where(F.col("line") != "")
    )


def page_texts(runs: DataFrame, page: list[str]) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("line_y")).alias("down"), "line")))
    text = F.array_join(F.transform(order, lambda s: s["line"]), "\n")
    return lines(runs, page).groupBy(*page).agg(X.normalize_page_text(text).alias("text"))


def glyphs_of(pages: DataFrame) -> DataFrame:
    """Runs of given page texts: one line per text line, one run per word."""
    by_line = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return by_line.select(
        "doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("run_no", "str")
    ).select(
        "doc_id",
        "run_no",
        "str",
        (F.col("run_no") * 7.25).alias("x"),
        (F.lit(100000.0) - F.col("line_no") * 12.5 + F.pmod("run_no", F.lit(3)) * 0.01).alias("y"),
    )
