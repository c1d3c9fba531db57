"""Answer events: server-sent frames to deltas, deltas and replacements to messages.

Both have a batch form over stored rows and a streaming form with the same results: frames keep the unfinished frame
of every stream as state and are flushed by an end marker or after a quiet time; messages keep what their events have
said so far and are rewritten whenever an event changes them. Rows may come in any order and any split.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmark.functions import rules as R
from leafmark.operators.running import running_fold

DELTA = "$.choices[0].delta.content"
DONE = "[DONE]"


def parse_frames(pieces: DataFrame) -> DataFrame:
    """``(stream_id, seq, piece)`` to ``(stream_id, frame_no, line_no, delta)`` - one stream is one answer.

    Frames end at a blank line. Once a piece has completed a frame that says [DONE], later pieces are ignored; a last
    frame without a blank line counts unless the stream was done.

    No stream is put together: a piece is cut where it lies. A blank line may be split between pieces, so a piece
    needs to know whether an odd number of line ends stands right before it, and how many frames end before it. Both
    are running values over spans of pieces. Only the parts of one frame meet.
    """
    rows = pieces.where("piece is not null").select("stream_id", F.col("seq").cast("long").alias("seq"), "piece")
    body = F.length(F.rtrim("piece", F.lit("\n")))
    placed = running_fold(rows, ["stream_id"], "seq", [], start=("sum", F.length("piece").cast("long"), 0))
    solid = F.when(body > 0, F.col("start") + body)
    placed = running_fold(placed, ["stream_id"], "seq", [], text_end=("max", solid, 0))
    odd = (F.col("start") - F.col("text_end")) % 2 == 1
    # the line end before the piece is put in front of it to find the cuts, and taken off again
    parts = F.split(F.concat(F.when(odd, "\n").otherwise(""), "piece"), "\n\n")
    own = F.transform(parts, lambda p, i: F.when(odd & (i == 0), F.substr(p, F.lit(2))).otherwise(p))
    cut = placed.select("stream_id", "seq", own.alias("parts"))
    counted = running_fold(cut, ["stream_id"], "seq", [], first=("sum", (F.size("parts") - 1).cast("long"), 0))
    split = counted.select("stream_id", "seq", "first", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    frames = split.groupBy("stream_id", (F.col("first") + F.col("k")).alias("frame_no")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("seq", "part")))["part"], "").alias("frame"),
        F.max(F.when(F.col("k") < F.col("n") - 1, F.col("seq"))).alias("closed"),
    )
    lines = frames.select("stream_id", "frame_no", "closed", F.posexplode(F.split("frame", r"\r?\n")).alias("line_no", "line"))
    data = lines.where(F.col("line").startswith("data:")).withColumn(
        "data", F.regexp_replace(F.substring("line", 6, 1 << 30), rf"^{R.WS}+", "")
    )
    done = data.where((F.col("data") == DONE) & F.col("closed").isNotNull()).groupBy("stream_id").agg(F.min("closed").alias("done"))
    return (
        data.join(done, "stream_id", "left")
        .where(F.col("done").isNull() | (F.col("closed") <= F.col("done")))
        .select("stream_id", "frame_no", "line_no", F.get_json_object("data", DELTA).alias("delta"))
        .where(F.col("delta").isNotNull() & (F.col("delta") != ""))
    )


FRAME_OUT = "stream_id string, frame_no long, line_no int, delta string"
FRAME_FIELDS = ("buffer", "done", "next_seq", "frame_no", "due")
#: Groups of streams that are handed to Python together, and streams of a group that share an entry of its state.
GROUPS, PAGE = 1024, 32


def _deltas(frame: str) -> tuple[list[tuple[int, str]], bool]:
    """``(line number, text)`` of a frame's deltas, and whether it says [DONE]."""
    found, done = [], False
    for n, line in enumerate(frame.replace("\r\n", "\n").split("\n")):
        if not line.startswith("data:"):
            continue
        data = line[5:].lstrip(R.WS_CHARS)
        if data == DONE:
            done = True
            continue
        try:
            delta = json.loads(data)["choices"][0]["delta"]["content"]
        except (ValueError, LookupError, TypeError):
            continue
        if isinstance(delta, str) and delta:
            found.append((n, delta))
    return found, done


class Pages:
    """What is known of the streams of one group, kept as JSON in pages of about ``PAGE`` streams.

    A call to the state costs far more than a stream's few lines do. Only the pages of the streams asked for are read
    and written; when the pages are full their number doubles, so that a page stays small in any number of streams.
    """

    def __init__(self, size, pages, streams):
        self.size, self.pages = size, pages
        self.number, self.count = size.get() or (1, 0)
        self.known: dict = {}
        self.read = {self._page(s) for s in streams}
        self._load(self.read)
        self.before = len(self.known)

    def _page(self, stream) -> int:
        return zlib.crc32((stream or "").encode()) % self.number

    def _load(self, pages) -> None:
        for page in pages:
            found = self.pages.getValue((page,))
            for stream, state, seqs, early in [] if found is None else json.loads(found[0]):
                self.known[stream] = dict(zip(FRAME_FIELDS, state, strict=True)), dict(zip(seqs, early, strict=True))

    def get(self, stream) -> tuple[dict, dict]:
        """What is known of a stream, and its early pieces."""
        return self.known.get(stream) or (dict(zip(FRAME_FIELDS, ("", False, 0, 0, None), strict=True)), {})

    def put(self, stream, state: dict, early: dict) -> None:
        self.known[stream] = state, early

    def write(self) -> None:
        new = len(self.known) - self.before
        count = self.count + new
        if count > PAGE * self.number:
            self._load(set(range(self.number)) - self.read)
            while count > PAGE * self.number:
                self.number *= 2
            self.read = set(range(self.number))
        rows: dict = {page: [] for page in self.read}
        for stream, (state, early) in self.known.items():
            rows[self._page(stream)].append([stream, [state[f] for f in FRAME_FIELDS], [*early], [*early.values()]])
        for page, held in rows.items():
            self.pages.updateValue((page,), (json.dumps(held, ensure_ascii=False),))
        if new:
            self.size.update((self.number, count))


class Frames(StatefulProcessor):
    """Frames of the streams of one group. ``seq`` counts from 0; pieces that come early wait in state for those
    before them. A null piece marks the end of its stream; with ``quiet_ms``, a stream that is quiet for so long is
    over as well, whatever is missing. What was left then is read as a last frame, and pieces that come later are
    ignored."""

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "pages long, streams long")
        self.pages = handle.getMapState("frames", "page long", "streams string")
        self.due = handle.getMapState("due", "at long", "stream_ids array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came: dict = {}
        for batch in rows:
            for stream, seq, piece in zip(batch["stream_id"], batch["seq"], batch["piece"], strict=True):
                if not pd.isna(seq):
                    came.setdefault(stream, {})[int(seq)] = None if pd.isna(piece) else piece
        due = None if self.quiet_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        streams, waiting, out = Pages(self.size, self.pages, came), [], []
        for stream, pieces in came.items():
            state, early = streams.get(stream)
            if state["next_seq"] < 0:
                continue
            found: list[tuple] = []
            left = early | {seq: p for seq, p in pieces.items() if seq >= state["next_seq"]}
            while state["next_seq"] in left:
                piece = left.pop(state["next_seq"])
                if piece is None:
                    self._flush(state, found)
                    break
                self._push(state, piece, found)
                state["next_seq"] += 1
            out += [(stream, *r) for r in found]
            if state["next_seq"] < 0:
                streams.put(stream, state, {})
            else:
                streams.put(stream, state | {"due": due}, left | {seq: p for seq, p in early.items() if seq in left})
                waiting.append(stream)
        streams.write()
        if due is not None and waiting:
            self.due.updateValue((due,), ([*self._due(due), *waiting],))
            self.handle.registerTimer(due)
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Ends those of the timer's streams that have been quiet since it was set."""
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        asked = self._due(at)
        streams = Pages(self.size, self.pages, asked)
        for stream in asked:
            state, early = streams.get(stream)
            if state["next_seq"] < 0 or state["due"] != at:
                continue
            found: list[tuple] = []
            for seq in sorted(early):
                if early[seq] is not None:
                    self._push(state, early[seq], found)
            self._flush(state, found)
            streams.put(stream, state, {})
            out += [(stream, *r) for r in found]
        streams.write()
        self.due.removeKey((at,))
        if out:
            yield self._rows(out)

    def close(self) -> None:
        pass

    def _due(self, at: int) -> list:
        found = self.due.getValue((at,))
        return [] if found is None else found[0]

    @staticmethod
    def _push(state: dict, piece: str, out: list) -> None:
        if state["done"]:
            return
        *frames, state["buffer"] = (state["buffer"] + piece).split("\n\n")
        for frame in frames:
            found, ended = _deltas(frame)
            state["done"] = state["done"] or ended
            out += [(state["frame_no"], n, d) for n, d in found]
            state["frame_no"] += 1

    @staticmethod
    def _flush(state: dict, out: list) -> None:
        """The rest as a last frame. A negative ``next_seq`` marks a stream that is over."""
        if not state["done"]:
            out += [(state["frame_no"], n, d) for n, d in _deltas(state["buffer"])[0]]
        state["buffer"], state["next_seq"] = "", -1

    @staticmethod
    def _rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["stream_id", "frame_no", "line_no", "delta"])


def stream_frames(pieces: DataFrame, quiet_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """Streaming form of ``parse_frames`` over ``(stream_id string, seq long, piece string)``: the deltas of every
    frame once it is complete. Needs the RocksDB state store (:func:`use_state_store`). With ``quiet_ms`` the state
    has timers, and the query needs a trigger that goes on. Streams are dealt to ``groups`` groups by their hash: a
    group's pieces of one micro-batch are in memory together."""
    return pieces.withColumn("group", F.pmod(F.xxhash64("stream_id"), F.lit(groups))).groupBy("group").transformWithStateInPandas(
        statefulProcessor=Frames(quiet_ms),
        outputStructType=FRAME_OUT,
        outputMode="Append",
        timeMode="None" if quiet_ms is None else "ProcessingTime",
    )


def use_state_store(spark) -> None:
    """Keyed state with timers is kept in RocksDB, for this session's streams. Its stores share one cache in each
    executor, as caches of their own would grow with the number of partitions; settings made before stay."""
    store = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{store}.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, value in (("boundedMemoryUsage", "true"), ("maxMemoryUsageMB", "256")):
        if spark.conf.get(f"{store}.rocksdb.{name}", None) is None:
            spark.conf.set(f"{store}.rocksdb.{name}", value)


UNKNOWN_ERROR = "未知错误"


def fold_events(events: DataFrame, part_size: int = 1000) -> DataFrame:
    """``(message_id, seq, type, delta, content, citations, error)`` to one row per message.

    Deltas append, a replacement overwrites, completion and errors set the status. Deltas before the
    last replacement are dropped first; the rest is joined in runs of ``part_size`` and then as a whole.
    """
    is_type = lambda *t: F.col("type").isin(*t)
    heads = events.groupBy("message_id").agg(
        F.max(F.when(is_type("replace"), F.struct("seq", "content"))).alias("replaced"),
        F.max(F.when(is_type("sources", "complete"), F.struct("seq", "citations"))).alias("cited"),
        F.max(F.when(is_type("complete", "error"), F.struct("seq", "type", "error"))).alias("ended"),
    )
    deltas = events.where(is_type("delta")).select("message_id", "seq", "delta")
    kept = deltas.join(heads.select("message_id", F.col("replaced.seq").alias("since")), "message_id").where(
        F.col("since").isNull() | (F.col("seq") > F.col("since"))
    )
    runs = (
        kept.groupBy("message_id", F.floor(F.col("seq") / part_size).alias("run"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "delta")))["delta"], "").alias("part"))
        .groupBy("message_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("run", "part")))["part"], "").alias("tail"))
    )
    said = F.concat(F.coalesce("replaced.content", F.lit("")), F.coalesce("tail", F.lit("")))
    reason = F.coalesce("ended.error", F.lit(UNKNOWN_ERROR))
    broken = F.when(
        said != "", F.concat(said, F.lit("\n\n[回答中断："), reason, F.lit("]"))
    ).otherwise(F.concat(F.lit("回答失败："), reason))
    return heads.join(runs, "message_id", "left").select(
        "message_id",
        F.when(F.col("ended.type") == "error", broken).otherwise(said).alias("content"),
        F.coalesce("ended.type", F.lit("streaming")).alias("status"),
        F.col("cited.citations").alias("citations"),
        F.col("ended.error").alias("error"),
    )


MESSAGE_OUT = "message_id string, content string, status string, citations string, error string"
EVENT_IN = "message_id string, seq long, type string, delta string, content string, citations string, error string"
HEAD_STATE = (
    "replaced_seq long, replaced string, cited_seq long, citations string, ended_seq long, ended string, error string"
)
#: what a message is before its first event
NO_HEAD = (-1, "", -1, None, -1, None, None)


class Messages(StatefulProcessor):
    """One message. A state machine over the events' own numbers, so that late events find their place: the last
    replacement with the deltas after it, the last citations and the last end. A replacement drops what it
    overwrites from state; what an earlier replacement says later on changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD_STATE)
        self.deltas = handle.getMapState("deltas", "seq long", "delta string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        replaced_seq, replaced, cited_seq, citations, ended_seq, ended, error = self.head.get() if self.head.exists() else NO_HEAD
        stored = {k[0]: v[0] for k, v in self.deltas.iterator()} if self.deltas.exists() else {}
        said = dict(stored)
        for batch in rows:
            plain = batch.astype(object).where(batch.notna(), None)
            for e in plain.itertuples(index=False):
                if e.type == "delta":
                    said[int(e.seq)] = e.delta or ""
                elif e.type == "replace" and e.seq > replaced_seq:
                    replaced_seq, replaced = int(e.seq), e.content or ""
                if e.type in ("sources", "complete") and e.seq > cited_seq:
                    cited_seq, citations = int(e.seq), e.citations
                if e.type in ("complete", "error") and e.seq > ended_seq:
                    ended_seq, ended, error = int(e.seq), e.type, e.error
        kept = {s: d for s, d in said.items() if s > replaced_seq}
        for seq in stored.keys() - kept.keys():
            self.deltas.removeKey((seq,))
        for seq in kept.keys() - stored.keys():
            self.deltas.updateValue((seq,), (kept[seq],))
        self.head.update((replaced_seq, replaced, cited_seq, citations, ended_seq, ended, error))
        content = replaced + "".join(kept[s] for s in sorted(kept))
        if ended == "error":
            reason = error if error is not None else UNKNOWN_ERROR
            content = f"{content}\n\n[回答中断：{reason}]" if content else f"回答失败：{reason}"
        row = (str(key[0]), content, ended or "streaming", citations, error)
        yield pd.DataFrame([row], columns=["message_id", "content", "status", "citations", "error"])

    def close(self) -> None:
        pass


def stream_messages(events: DataFrame) -> DataFrame:
    """Streaming form of ``fold_events`` over ``EVENT_IN`` rows in any order: a message's row as it is after each
    micro-batch that brought events of it, in update mode. Needs the RocksDB state store."""
    return events.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=Messages(), outputStructType=MESSAGE_OUT, outputMode="Update", timeMode="None"
    )
