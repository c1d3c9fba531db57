"""Files to document, page and outline rows.

``binaryFile`` brings path and bytes; workbooks and images are read here, PDF bytes go to an injected
reader, a ``mapInPandas`` function that turns ``(path, content)`` into glyph rows (see ``glyphs``), and
its outline comes from another one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.operators.joins import sized_join
from leafmark.session import write_table
from leafmark.sources import glyphs, workbook

SUPPORTED = [".pdf", ".xlsx", ".png", ".jpg", ".jpeg"]
GLYPHS = "path string, page_number long, run_no int, str string, x double, y double, width double, height double, error string"
OUTLINE = "path string, place array<int>, title string, page_number long"
NO_READER = "没有可用的 PDF 读取器。"


@dataclass(frozen=True)
class Extracted:
    """``documents`` with status, ``pages`` and ``outline`` keyed by document_id (the path)."""

    documents: DataFrame
    pages: DataFrame
    outline: DataFrame


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def describe(files: DataFrame) -> DataFrame:
    """Name, title, kind and hash of every file, and an error for unsupported types."""
    name = F.regexp_extract("path", r"([^/\\]+)\z", 1)
    ext = X.extension(F.col("path"))
    return files.select(
        F.col("path").alias("document_id"),
        F.sha2("content", 256).alias("sha256"),
        name.alias("original_filename"),
        X.title_from_filename(name).alias("title"),
        X.kind_from_extension(ext).alias("kind"),
        F.when(
            ~ext.isin(SUPPORTED),
            F.concat(F.lit(R.MSG_UNSUPPORTED), F.coalesce(X.non_empty(ext), F.lit("未知"))),
        ).alias("error_message"),
    )


def big_endian(content: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("long")


def image_info(files: DataFrame) -> DataFrame:
    ext = X.extension(F.col("path"))
    png = (ext == ".png") & (F.length("content") >= 24)
    return files.where(ext.isin(".png", ".jpg", ".jpeg")).select(
        F.col("path").alias("document_id"),
        F.regexp_extract("path", r"([^/\\]+)\z", 1).alias("title"),
        F.when(png, big_endian(F.col("content"), 17)).alias("width"),
        F.when(png, big_endian(F.col("content"), 21)).alias("height"),
        F.when(png, "image/png")
        .when(ext.isin(".jpg", ".jpeg"), "image/jpeg")
        .otherwise("application/octet-stream")
        .alias("mime_type"),
    )


def extract(files: DataFrame, pdf_glyphs: Callable | None = None, pdf_outline: Callable | None = None) -> Extracted:
    """Pages and outline of all files. A file that cannot be read fails alone: its document has an error.

    ``pdf_glyphs`` and ``pdf_outline`` are ``mapInPandas`` functions of ``(path, content)`` to ``GLYPHS`` and
    to ``OUTLINE`` rows; a glyph row with an ``error`` fails its file. Without a glyph reader PDF files fail.
    Pages have a width and a height where the reader or the image tells them.
    """
    ext = X.extension(F.col("path"))
    info = image_info(files)
    images = info.select(
        "document_id", F.lit(1).cast("long").alias("page_number"), F.lit("1").alias("printed_page"), F.col("title").alias("text"),
        F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
    )
    cells = write_table(workbook.read_cells(files.where(ext == ".xlsx")), "cells")
    none = F.lit(None).cast("double")
    sheets = workbook.sheet_texts(cells).select(
        F.col("path").alias("document_id"),
        F.col("sheet_no").cast("long").alias("page_number"),
        F.col("sheet_no").cast("string").alias("printed_page"),
        "text", none.alias("width"), none.alias("height"),
    )
    errors = cells.where("error is not null").select("path", "error")
    pages = images.unionByName(sheets)
    outline = workbook.sheet_outline(cells.where("error is null")).unionByName(
        images.select(
            "document_id", F.lit(1).cast("long").alias("seq"), F.col("text").alias("title"), F.lit(1).alias("level"), "page_number"
        )
    )
    pdfs = files.where(ext == ".pdf")
    if pdf_glyphs is not None:
        runs = write_table(pdfs.mapInPandas(pdf_glyphs, GLYPHS), "glyphs")
        errors = errors.unionByName(runs.where("error is not null").select("path", "error"))
        good = runs.where("error is null and page_number is not null")
        texts = glyphs.page_texts(good, ["path", "page_number"])
        sizes = good.groupBy("path", "page_number").agg(F.max("width").alias("width"), F.max("height").alias("height"))
        pages = pages.unionByName(
            texts.join(sizes, ["path", "page_number"]).select(
                F.col("path").alias("document_id"),
                "page_number",
                X.printed_page(F.col("text"), F.col("page_number")).alias("printed_page"),
                "text", "width", "height",
            )
        )
    else:
        errors = errors.unionByName(pdfs.select("path", F.lit(NO_READER).alias("error")))
    if pdf_outline is not None:
        outline = outline.unionByName(flatten_outline(pdfs.mapInPandas(pdf_outline, OUTLINE)))
    errors = errors.groupBy("path").agg(F.min("error").alias("reason"))
    docs = describe(files).join(errors.withColumnRenamed("path", "document_id"), "document_id", "left")
    docs = docs.withColumn("error_message", F.coalesce("error_message", "reason")).drop("reason")
    failed = write_table(docs.where("error_message is not null").select("document_id"), "failed")
    return Extracted(
        docs, sized_join(pages, failed, ["document_id"], "left_anti"), sized_join(outline, failed, ["document_id"], "left_anti")
    )


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """Nested outline nodes to rows ``(document_id, seq, title, level, page_number)`` in reading order.

    ``nodes`` has ``(path, place, title, page_number)``; ``place`` is the node's position among its siblings
    at each depth, from the root down, so its length is the level. Blank titles and nodes without a page are
    left out. Nodes are numbered per document by that order; the numbers leave gaps where nodes were left out.
    """
    title = X.strip(F.col("title"))
    order = W.partitionBy("path").orderBy("place")
    return (
        nodes.withColumn("seq", F.row_number().over(order).cast("long") - 1)
        .where((title != "") & (F.col("page_number") >= 1) & (F.size("place") >= 1))
        .select(F.col("path").alias("document_id"), "seq", title.alias("title"), F.size("place").alias("level"), "page_number")
    )


MANIFEST = "title string, sourcePath string, kind string"


def _hadoop_path(spark: SparkSession, path: str):
    """The path with its scheme filled in, and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop), system


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Seed list; a ``.local.json`` neighbour wins, relative paths start at the manifest's folder."""
    local = path[: -len(".json")] + ".local.json" if path.lower().endswith(".json") else path
    chosen, system = _hadoop_path(spark, local)
    if not system.exists(chosen):
        chosen, _ = _hadoop_path(spark, path)
    folder = chosen.getParent().toString().removeprefix("file:")
    items = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(chosen.toString())
    valid = F.col("title").isNotNull() & F.col("sourcePath").isNotNull() & F.coalesce(
        F.col("kind").isin("pdf", "xlsx", "image"), F.lit(False)
    )
    checked = F.when(valid, F.col("sourcePath")).otherwise(F.raise_error(F.lit("种子资料清单格式无效。")))
    absolute = F.when(checked.startswith("/") | checked.contains("://"), checked).otherwise(F.concat(F.lit(folder + "/"), checked))
    return items.select("title", absolute.alias("source_path"), "kind")


def asset_path(spark: SparkSession, root: str, stored_path: str) -> str:
    """Path of a stored file in any file system; it must stay under the library root."""
    base, _ = _hadoop_path(spark, root)
    full, _ = _hadoop_path(spark, stored_path if stored_path.startswith("/") or "://" in stored_path else f"{base}/{stored_path}")
    # "." and ".." are resolved by hand: remote paths keep them
    parts: list[str] = []
    for part in full.toUri().getPath().split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    top = [p for p in base.toUri().getPath().split("/") if p]
    same_store = (full.toUri().getScheme(), full.toUri().getAuthority()) == (base.toUri().getScheme(), base.toUri().getAuthority())
    if parts[: len(top)] != top or not same_store:
        raise ValueError("资料路径超出知识库目录。")
    return f"{base}/{'/'.join(parts[len(top):])}".rstrip("/")


def read_asset(spark: SparkSession, root: str, stored_path: str) -> DataFrame:
    """``(path, content)`` of a stored file."""
    return scan(spark, asset_path(spark, root, stored_path))
