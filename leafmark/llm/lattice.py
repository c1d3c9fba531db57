"""Language-model scores of whole texts: the probability of a text over all its segmentations into subwords.

The vocabulary is an existing one of subword pieces; a word starts with the piece mark. Pieces' weights start from
the scores in the vocabulary's file (its ranks, read as a Zipf law) and are learned from the training texts by
expectation maximisation over all segmentations of all training words. A text's probability is the product over
its words of the sum over all segmentations of the product of their pieces' probabilities, times the probability
of the end. Since pieces never cross a word's start, the forward recursion runs in log space over one word at a
time, for all words of one length at once. A character outside the vocabulary is spelled by its byte pieces.

Beside it stands the base score: words by add-one counts of the training texts.

Words are counted over all texts (first in the tasks, then by word), the pieces' weights go through the driver -
as many numbers as the vocabulary has pieces - and every distinct word is scored once. The HEAD most frequent
words are sent to all tasks; documents' other words find their scores by a join on the word.

Defined results: a null text is an empty one: one token, the end. Rows with a null id are not learned from and
count as held out. Without training rows the base is log10(1 / 1) a token and the pieces keep their first weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import mix, stored

HEAD = 131_072
ROUNDS = 2
MARK = "▁"
U = np.uint64
STEP = U(0x9E3779B97F4A7C15 | 1)
LEAST = -np.inf
SMOOTHING = 0.1
AT_ONCE = 50_000


@dataclass
class Pieces:
    """Subword pieces with log probabilities; ``spelled`` has the ids of the byte pieces, the last id is the end."""

    texts: list[str]
    spelled: list[int]
    logp: np.ndarray
    longest: int = 0
    codes: np.ndarray = field(default=None)
    order: np.ndarray = field(default=None)
    sieve: np.ndarray = field(default=None)

    def __post_init__(self):
        with np.errstate(over="ignore"):
            codes = np.array([_code(t) for t in self.texts], np.uint64)
        self.longest = max(map(len, self.texts))
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[codes >> U(44)] = True


def _code(text: str) -> np.uint64:
    h = U(0)
    for c in text:
        h = h * STEP + mix(np.array([ord(c)], np.uint64) + U(1))[0]
    return h


def load(path: str) -> Pieces:
    """Pieces of a sentencepiece file; their scores are negative ranks, read as a Zipf law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    score = np.array([model.get_score(i) for i in normal])
    weight = np.concatenate((1.0 / (100.0 - score + score.max()), np.full(257, 1e-7)))
    texts = [model.id_to_piece(i) for i in normal]
    return Pieces(texts, list(range(len(texts), len(texts) + 256)), np.log(weight / weight.sum()))


def _edges(pieces: Pieces, words: list[str]) -> list[np.ndarray]:
    """For equally long words: by length of the piece, the ids of the pieces that start at each position, or -1."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).astype(np.uint64)
    letters, h, out = mix(points + U(1)), None, []
    for n in range(1, min(pieces.longest, size) + 1):
        h = letters if h is None else h[:, :-1] * STEP + letters[:, n - 1 :]
        ids = np.full(h.shape, -1, np.int32)
        hit = np.nonzero(pieces.sieve[h >> U(44)])
        at = np.minimum(np.searchsorted(pieces.codes, h[hit]), len(pieces.codes) - 1)
        ids[hit] = np.where(pieces.codes[at] == h[hit], pieces.order[at], -1)
        out.append(ids)
    return out


def _weights(pieces: Pieces, words: list[str], edges: list[np.ndarray]) -> list[np.ndarray]:
    """Log weights of the edges; characters that are no pieces weigh as much as their bytes."""
    out = [np.where(ids >= 0, pieces.logp[ids], LEAST) for ids in edges]
    for i, k in zip(*np.nonzero(edges[0] < 0)):
        out[0][i, k] = sum(pieces.logp[pieces.spelled[b]] for b in words[i][k].encode("utf-8", "surrogatepass"))
    return out


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(terms - safe).sum(axis=0))


def forward(weights: list[np.ndarray], n: int, size: int) -> np.ndarray:
    alpha = np.full((size + 1, n), LEAST)
    alpha[0] = 0.0
    for j in range(1, size + 1):
        alpha[j] = _log_sum(np.stack([alpha[j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)]))
    return alpha


def _by_length(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        step = max(1, min(most, 2_000_000 // max(1, int(lengths[group[0]]))))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            yield part, [words[k] for k in part]


def word_logs(pieces: Pieces, words: list[str]) -> np.ndarray:
    """Log probability of each word, over all its segmentations."""
    out = np.zeros(len(words))
    with np.errstate(over="ignore"):
        for at, part in _by_length([MARK + w for w in words]):
            size = len(part[0])
            out[at] = forward(_weights(pieces, part, _edges(pieces, part)), len(part), size)[size]
    return out


def expected_pieces(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in all segmentations of the words."""
    total = np.zeros(len(pieces.logp))
    with np.errstate(over="ignore"):
        for at, part in _by_length([MARK + w for w in words]):
            size, edges = len(part[0]), _edges(pieces, part)
            weights, often = _weights(pieces, part, edges), counts[at]
            alpha = forward(weights, len(part), size)
            beta = forward([w[:, ::-1] for w in weights], len(part), size)[::-1]
            for k, (ids, w) in enumerate(zip(edges, weights, strict=True), 1):
                share = np.exp(alpha[: size - k + 1].T + w + beta[k:].T - alpha[size][:, None]) * often[:, None]
                real = ids >= 0
                total += np.bincount(ids[real], share[real], len(total))
                if k == 1:
                    for i, j in zip(*np.nonzero(~real)):
                        for b in part[i][j].encode("utf-8", "surrogatepass"):
                            total[pieces.spelled[b]] += share[i, j]
    return total


def tokens_of(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know A-Z and the six white-space bytes only."""
    return text.lower().split() if text else []


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n)`` over training texts; words of other texts count 0. The empty word stands for the end."""
    learned: Counter = Counter()
    others: set[bytes] = set()

    def flush():
        others.difference_update(learned)
        words = [*learned, *others]
        counts = np.concatenate((np.fromiter(learned.values(), np.int64, len(learned)), np.zeros(len(others), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], ["word", "n"])
        learned.clear()
        others.clear()

    for batch in batches:
        for held_out, text in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
            if held_out:
                others.update(tokens_of(text))
            else:
                learned.update(tokens_of(text))
                learned[b""] += 1
        if len(learned) + len(others) > 400_000:
            yield from flush()
    yield from flush()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    words: list[bytes] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy(zero_copy_only=False))
        if len(words) >= AT_ONCE:
            yield words, np.concatenate(counts)
            words, counts = [], []
    if words:
        yield words, np.concatenate(counts)


def _expected_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        total = np.zeros(len(pieces.logp))
        for words, counts in _gathered(batches):
            total += expected_pieces(pieces, [w.decode() for w in words], counts.astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    return run


def _lexicon_rows(shared, denominator: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for words, counts in _gathered(batches):
            logs = word_logs(pieces, [w.decode() for w in words]) / math.log(10)
            logs = np.where([not w for w in words], pieces.logp[-1] / math.log(10), logs)
            base = np.log10((counts + 1) / denominator)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts), pa.array(base), pa.array(logs)], ["word", "n", "base", "log"])

    return run


def _document_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text in _binary(batch.column(2)):
                bag = Counter(tokens_of(text))
                bag[b""] = 1
                known, base, score, rest, often = 0, 0.0, 0.0, [], []
                for word, n in bag.items():
                    if (found := head.get(word)) is None:
                        rest.append(word)
                        often.append(n)
                    else:
                        known += n if found[0] else 0
                        base += n * found[1]
                        score += n * found[2]
                for kept, value in zip(out, (sum(bag.values()), known, base, score, rest, often), strict=True):
                    kept.append(value)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base", "log", "rest", "often"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))


def train(words: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Re-estimate the pieces from ``words(word, n)``; one number a piece goes through the driver in each round."""
    context = words.sparkSession.sparkContext
    ends = words.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0] or 0
    learned = words.where((F.col("n") > 0) & (F.octet_length("word") > 0))
    for _ in range(rounds if ends else 0):
        rows = learned.mapInArrow(_expected_rows(context.broadcast(pieces)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        total = np.full(len(pieces.logp), SMOOTHING)
        for r in rows.collect():
            total[r["piece"]] += r["n"]
        total[-1] += ends
        pieces = Pieces(pieces.texts, pieces.spelled, np.log(total / total.sum()))
    return pieces


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    words = source.select("held_out", "text").mapInArrow(_count_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pieces = context.broadcast(train(words, load(path)))
    lexicon = stored(words.mapInArrow(_lexicon_rows(pieces, float(n + v + 1)), "word binary, n long, base double, log double"), "lexicon")
    often = lexicon.orderBy(F.desc("n"), "word").limit(head).collect()  # ``head`` rows at most
    top = {bytes(r["word"]): (r["n"], r["base"], r["log"]) for r in often}
    if b"" not in top:  # no training row: the end has not been counted
        top[b""] = (0, math.log10(1 / (n + v + 1)), float(pieces.value.logp[-1]) / math.log(10))
    rows = source.mapInArrow(
        _document_rows(context.broadcast(top)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, rest array<binary>, often array<long>",
    )
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "documents")
    pair = F.explode(F.arrays_zip("rest", "often")).alias("pair")
    tail = rows.select("_row", pair).select("_row", F.col("pair.rest").alias("word"), F.col("pair.often").alias("often"))
    tail = tail.join(lexicon.where(F.octet_length("word") > 0), "word").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("t_known"),
        F.sum(F.col("often") * F.col("base")).alias("t_base"),
        F.sum(F.col("often") * F.col("log")).alias("t_log"),
    )
    zero = F.lit(0)
    return rows.drop("rest", "often").join(tail, "_row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("t_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", zero)).alias("base_score"),
        (F.col("log") + F.coalesce("t_log", zero)).alias("score"),
    )
