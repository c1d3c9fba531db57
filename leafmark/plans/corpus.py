"""The given tables seen as a library.

``source`` is the document, each ``documents`` row one of its pages (page number = doc_id + 1). Equal
texts are imported once. Five of seven pages carry an outline node named after their first sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.operators.dedup import first_copies
from leafmark.operators.indexing import SearchIndex, build_index, chunk_rows, tokenized
from leafmark.operators.outline import outline_levels, page_context
from leafmark.session import spread, write_table

# Sentences appended to pages and questions in the *_cjk queries (fixed values): the given texts hold
# neither CJK nor underscores, which half of the rules are about.
NOTES = [
    "PA9 可以用作 USART1_TX，复用推挽输出。",
    "独立看门狗 IWDG_PR 与 IWDG_RLR 决定溢出时间。",
    "4.3 低功耗模式 PWR_CR 停止模式与待机模式",
    "ADC_SMPR1 采样时间 ADC_CR2 ADON 转换 校准",
    "目录 第 12 页 .... 1 .... 2 .... 3",
    "串口波特率寄存器 USART_BRR USART1_TX2",
    "定时器功能比较 7个定时器 3个通用16位定时器",
    "GPIOX_CRL 端口配置低寄存器 MODE CNF 位域",
    "外部中断 EXTI_RTSR 边沿触发 NVIC_IPR 优先级",
    "CAN 总线过滤器 CAN_FMR 筛选器 页 3/20",
    "AFIO_MAPR 重映射 USART1_REMAP RCC_APB2ENR 时钟使能",
]
QUESTION_NOTES = [
    "PA9 怎么配置成 USART1_TX",
    "低功耗模式有哪几种",
    "独立看门狗的溢出时间怎么算",
    "ADC 采样时间 SMPR 设置",
    "CAN 总线过滤器怎么设置",
    "GPIO 推挽输出和开漏输出有什么区别",
    "STM32F103C8T6 有几个定时器",
    "SysTick 系统节拍定时器 外部中断 优先级",
    "USART_BRR 串口 波特率 寄存器 地址",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noted(text: Column, key: Column, notes: list[str], before: bool = False) -> Column:
    note = F.array(*[F.lit(n) for n in notes])[F.pmod(key, F.lit(len(notes))).cast("int")]
    return F.concat_ws(" ", note, text) if before else F.concat_ws("\n", text, note)


def raw_pages(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    """``(doc_id, document_id, document_title, page_number, sha256, text)``, copies included."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("document_id"),
        F.col("source").alias("document_title"),
        (F.col("doc_id") + 1).alias("page_number"),
        F.sha2("text", 256).alias("sha256"),
        (noted(text, F.col("doc_id"), NOTES) if annotated else text).alias("text"),
    )


def node_title(text: Column) -> Column:
    return X.strip(F.regexp_extract(text, rf"^{R.WS}*([^.\n]+)", 1))


def node_level(doc_id: Column) -> Column:
    m = F.pmod(doc_id, F.lit(7))
    return F.when(m == 0, 1).when(m <= 2, 2).when(m <= 4, 3).cast("int")


def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and outline fields of the first copy of each text - no texts, so it stays narrow."""
    narrow = raw_pages(spark, sf_dir).select(
        "sha256", "doc_id", "document_id", "page_number", node_title(F.col("text")).alias("title")
    )
    return first_copies(narrow, "sha256", "doc_id")


def outline_of(kept: DataFrame) -> DataFrame:
    return kept.select(
        "document_id",
        F.col("doc_id").alias("seq"),
        "title",
        node_level(F.col("doc_id")).alias("level"),
        "page_number",
    ).where(F.col("level").isNotNull() & (F.col("title") != ""))


_STORED: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, key: tuple, build):
    """Stored tables are reused within a session as long as the input tables are the same ones: the key holds
    the size and the time of change of each, not the names of their files."""
    key = (spark.sparkContext.applicationId, *_stamp(spark, sf_dir), *key)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    out: list = [sf_dir]
    for name in ("documents", "benchmark", "embeddings", "conversations"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path):
            out += [system.getContentSummary(path).getLength(), system.getFileStatus(path).getModificationTime()]
    return tuple(out)


def library_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Stored page context (kept pages with heading and open sections) and outline, with its levels."""

    def build():
        kept = write_table(kept_pages(spark, sf_dir), "kept_pages")
        outline = write_table(outline_of(kept), "outline")
        levels = outline_levels(outline)
        return write_table(page_context(kept, outline, levels), "page_context"), outline, levels

    return once(spark, sf_dir, ("base",), build)


def contextual_pages(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    """Kept pages with text, heading, open sections and printed page.

    The join that attaches the page context also drops the copies: texts are shuffled at most once.
    """
    context, _, _ = library_base(spark, sf_dir)
    pages = spread(raw_pages(spark, sf_dir, annotated), "page_number")
    return pages.join(context, ["document_id", "page_number"]).select(
        "document_id",
        "document_title",
        "page_number",
        X.printed_page(F.col("text"), F.col("page_number")).alias("printed_page"),
        "heading",
        "sections",
        "text",
    )


def chunks_of(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    """Tokenised chunks that are read once: those of the index if this session has it, else not stored, so that a
    reader of texts or keys pays for no tokens."""
    stored = _STORED.get((spark.sparkContext.applicationId, *_stamp(spark, sf_dir), "index", annotated))
    return stored.chunks if stored else tokenized(chunk_rows(contextual_pages(spark, sf_dir, annotated)))


def index_of(spark: SparkSession, sf_dir: str, annotated: bool = False) -> SearchIndex:
    def build():
        _, outline, levels = library_base(spark, sf_dir)
        return build_index(contextual_pages(spark, sf_dir, annotated), outline, levels)

    return once(spark, sf_dir, ("index", annotated), build)


def questions_of(spark: SparkSession, sf_dir: str, annotated: bool = False) -> DataFrame:
    """One question per benchmark passage, the whole passage."""
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        (noted(text, F.col("item_id"), QUESTION_NOTES, before=True) if annotated else text).alias("question"),
    )
