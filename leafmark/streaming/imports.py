"""Growing libraries and running answers as streams."""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from leafmark.operators.joins import sized_join
from leafmark.session import write_table
from leafmark.sources.store import Library
from leafmark.streaming.events import EVENT_IN, MESSAGE_OUT, stream_frames, stream_messages, use_state_store

PAGE_FEED = (
    "document_id string, title string, kind string, sha256 string, page_number long, printed_page string, text string, "
    "page_count long"
)


class Assembly:
    """Pages that wait for the rest of their document, between the micro-batches of one stream.

    After each micro-batch the pages of unfinished documents are written to a folder of that batch; the next one
    reads them and nothing older. A document is whole when it has as many pages as ``page_count`` says. Without a
    ``page_count`` it is imported with what has come, and imported again with all its pages when more of them come.
    """

    def __init__(self, library: Library, checkpoint: str):
        self.library, self.spark = library, library.spark
        self.name = checkpoint
        self.folder = f"{library.root}/assembly/{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def waiting(self, number: int) -> DataFrame:
        """Pages that micro-batch ``number`` left behind."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={number}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], PAGE_FEED)
        return self.spark.read.schema(PAGE_FEED).parquet(path.toString())

    def take(self, batch: DataFrame, number: int, force: bool = False) -> None:
        """Import what is whole with this micro-batch. A batch that is run again does the same; ``force`` takes
        unfinished documents as they are."""
        pages = write_table(self.waiting(number - 1).unionByName(batch).dropDuplicates(["document_id", "page_number"]), "gathered")
        counts = pages.groupBy("document_id").agg(
            F.count(F.lit(1)).alias("held"), F.max("page_count").alias("whole"), *[F.first(c, True).alias(c) for c in ("sha256", "title", "kind")]
        )
        ready = F.lit(force) | F.col("whole").isNull() | (F.col("held") >= F.col("whole"))
        counts = write_table(counts.withColumn("ready", ready), "documents")
        left = sized_join(pages, counts.where(~F.col("ready")).select("document_id"), ["document_id"], "left_semi")
        left.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        done = counts.where("ready")
        if done.isEmpty():
            return
        documents = done.select("document_id", "sha256", "title", "kind", F.col("title").alias("original_filename"))
        new = sized_join(pages, done.select("document_id"), ["document_id"], "left_semi").select("document_id", "page_number", "printed_page", "text")
        # pages that came after their document was imported, its length unknown
        grown = sized_join(self.library.table("documents").select("document_id", "sha256"), done.where("whole is null").select("document_id", "sha256"), ["document_id", "sha256"], "left_semi")
        grown = write_table(grown.select("document_id"), "grown")
        before = sized_join(self.library.table("pages"), grown, ["document_id"], "left_semi").select(new.columns)
        more = new.join(before, ["document_id", "page_number"], "left_anti").join(grown, "document_id", "left_semi").select("document_id").distinct()
        more = write_table(more, "more")
        kept = before.join(new, ["document_id", "page_number"], "left_anti").join(more, "document_id", "left_semi")
        whole = write_table(new.unionByName(kept.select(new.columns)), "whole_pages")
        self.library.import_documents(documents, whole, self.library._empty("toc_nodes").drop("attempt"), import_id=f"{self.name}#{number}", grown=more)


def follow_pages(spark: SparkSession, folder: str, library: Library, checkpoint: str, files_per_batch: int | None = None):
    """Import page files as they arrive: each micro-batch is one import of the documents that are whole with it
    (:class:`Assembly`), named after the checkpoint and the batch, so that a batch that is run again changes nothing;
    copies of documents imported before or within the batch are dropped. Returns the started query."""
    reader = spark.readStream.schema(PAGE_FEED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.json(folder)
        .writeStream.foreachBatch(Assembly(library, checkpoint).take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch of the streams of a session did, as rows for the driver's user; add it with
    ``spark.streams.addListener``. The newest ``most`` rows are kept."""

    def __init__(self, most: int = 10_000):
        self.rows: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.id), event.name, None, "started", 0, 0.0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seconds = (p.durationMs or {}).get("triggerExecution", 0) / 1000
        self.rows.append((str(p.id), p.name, p.batchId, "batch", p.numInputRows, seconds))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.id), None, None, "failed" if event.exception else "ended", 0, 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query_id string, name string, batch long, event string, input_rows long, seconds double")


def follow_answers(spark: SparkSession, folder: str, sink: str, checkpoint: str, quiet_ms: int | None = None, files_per_batch: int | None = None):
    """Deltas of answer streams whose pieces arrive as JSON files ``(stream_id, seq, piece)``; a null piece ends
    its stream. The query takes what is there and stops; with ``quiet_ms`` it goes on, and streams that are cut off
    end once they have been quiet for so long."""
    use_state_store(spark)
    reader = spark.readStream.schema("stream_id string, seq long, piece string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (
        stream_frames(reader.json(folder), quiet_ms)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if quiet_ms is None else writer.trigger(processingTime="1 second")).start()


def follow_messages(spark: SparkSession, folder: str, sink: str, checkpoint: str, files_per_batch: int | None = None):
    """Messages folded from events that arrive as JSON files (``EVENT_IN``). Each micro-batch writes the messages it
    changed to a folder of its own under ``sink``, so that a batch run again writes the same; :func:`latest_messages`
    reads the state."""
    use_state_store(spark)
    reader = spark.readStream.schema(EVENT_IN)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        stream_messages(reader.json(folder))
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_messages(spark: SparkSession, sink: str) -> DataFrame:
    """Every message as the last micro-batch that changed it left it."""
    rows = spark.read.schema(f"{MESSAGE_OUT}, batch long").parquet(sink)
    said = F.struct("content", "status", "citations", "error")
    return rows.groupBy("message_id").agg(F.max_by(said, "batch").alias("m")).select("message_id", "m.*")
