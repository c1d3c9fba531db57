"""Language identification by words first, then ever shorter character n-grams.

Learned from all training rows: how often each word occurs in each language, and, from those counts, how often
each character n-gram of the words (with their ends marked) does. A word whose share of all training words is at
least 1/KNOWN is known - by pigeonhole there are at most KNOWN of them - and scores the logarithm of its smoothed
frequency in each language. For any other word each position scores the longest n-gram there that is known in
the same sense, down to single characters, so rare and unseen words go by their letters. A document's language
is the one with the greatest sum; ties go to the language first by code point.

The tables sent to the tasks hold at most KNOWN words and KNOWN n-grams of each length, whatever the input.

Defined results: a null text, or one without letters, is ``und`` with score 0; a model learned from no rows says
``und`` for everything. Null languages are not learned from. Other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import mix, slices, stored

WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 4
KNOWN = 50_000
#: words of a text that count in full; more evidence than this does not make the score more certain
EVIDENCE = 20
UNDETERMINED = "und"
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, list[float]]
    grams: dict[str, list[float]]
    unseen: list[float]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. ``WORDS`` takes number signs for letters, so runs with one are cut at them."""
    words = WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in ([word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split())]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language, summed over a task as long as it holds few distinct ones."""
    counts: dict[str, Counter] = {}

    def flush():
        for lang, found in counts.items():
            names = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"]
            )
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        if sum(map(len, counts.values())) > 300_000:
            yield from flush()
    yield from flush()


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of the words, weighted by the words' counts, summed over a task as long as they are few."""
    counts: dict[str, dict[str, int]] = {}

    def flush():
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"]
            )
        counts.clear()

    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = counts.setdefault(lang, {})
            for gram in grams_of(word):
                found[gram] = found.get(gram, 0) + n
        if sum(map(len, counts.values())) > 500_000:
            yield from flush()
    yield from flush()


def grams_of(word: str) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(marked) - n + 1)]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", known: int = KNOWN) -> Model:
    """Fit on all ``rows`` with a language."""
    labelled = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = stored(labelled.mapInArrow(_count_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grams = words.mapInArrow(_gram_rows, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams.withColumn("length", F.length("gram")), "grams")
    totals = {(0, r["lang"]): r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    totals |= {(r["length"], r["lang"]): r["n"] for r in grams.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for _, lang in totals})

    def frequent(table: DataFrame, key: str, length: int) -> dict[str, list[float]]:
        sums = [totals.get((length, lang), 0) for lang in languages]
        least = max(1, math.ceil(sum(sums) / known))
        often = table.groupBy(key).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
        found: dict[str, list[float]] = {}
        kinds = max(1, often.count())
        for r in table.join(often.select(key), key).select(key, "lang", "n").collect():  # at most ``known`` keys
            found.setdefault(r[key], [0.0] * len(languages))[languages.index(r["lang"])] = float(r["n"])
        return {k: [math.log((n + 0.5) / (s + 0.5 * kinds)) for n, s in zip(v, sums, strict=True)] for k, v in found.items()}

    table = {}
    for length in range(1, LONGEST + 1):
        table |= frequent(grams.where(F.col("length") == length), "gram", length)
    unseen = [math.log(0.5 / (totals.get((1, lang), 0) + 1)) for lang in languages]
    return Model(languages, frequent(words, "word", 0), table, unseen)


class Scorer:
    """Holds the scores of the words met so far; they start anew when there are many."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        if not model.languages:
            return
        grams = sorted(model.grams)
        codes = np.array([_code(g) for g in grams], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[codes >> np.uint64(44)] = True
        self.gram_scores = np.array([model.unseen, *(model.grams[grams[i]] for i in order)]).reshape(-1, len(model.languages))
        self.reset()

    def reset(self) -> None:
        self.rows = {w: i for i, w in enumerate(self.model.words)}
        self.matrix = np.array(list(self.model.words.values())).reshape(-1, len(self.model.languages))

    def unknown(self, words: list[str]) -> np.ndarray:
        """Scores of words by the longest known n-gram at each position but the last, the end mark's."""
        text = "".join([f"_{w}_" for w in words])
        sizes = np.array([len(w) + 2 for w in words])
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(text))  # characters up to the end of the word
        with np.errstate(over="ignore"):
            letters = mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
            place, h = np.zeros(len(text), np.int64), None
            for n in range(1, LONGEST + 1):
                h = letters if h is None else h[:-1] * STEP + letters[n - 1 :]
                if not len(h):
                    break
                at = np.flatnonzero(self.sieve[h >> np.uint64(44)] & (left[: len(h)] >= n))
                found = np.minimum(np.searchsorted(self.codes, h[at]), max(len(self.codes) - 1, 0))
                same = self.codes[found] == h[at] if len(self.codes) else np.zeros(0, bool)
                place[at[same]] = found[same] + 1
        scores = self.gram_scores[place]
        scores[ends - 1] = 0.0
        return np.add.reduceat(scores, ends - sizes, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words])
        every = list(chain.from_iterable(words))
        if not every:
            return [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.rows) > self.most:
            self.reset()
        fresh = list(set(every).difference(self.rows))
        if fresh:
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.matrix = np.concatenate((self.matrix, self.unknown(fresh)))
        at = np.fromiter(map(self.rows.__getitem__, every), np.int64, len(every))
        some = np.flatnonzero(counts)
        sums = np.add.reduceat(self.matrix[at], np.concatenate(([0], np.cumsum(counts[some])[:-1])), axis=0)
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(some)), best]
        odds = np.exp((sums - top[:, None]) * (np.minimum(counts[some], EVIDENCE) / counts[some])[:, None])
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i, k, p in zip(some.tolist(), best.tolist(), (1 / odds.sum(axis=1)).tolist(), strict=True):
            out[i] = self.model.languages[k], p
        return out


def _code(gram: str) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in gram:
            h = h * STEP + mix(np.array([ord(c)], np.uint64) + np.uint64(1))[0]
    return h


def _predict_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                found = scorer.predict(part.column(part.num_columns - 1).to_pylist())
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [*part.schema.names[:-1], "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, ``lang_pred`` and ``score``; kept columns of these names give way."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "lang_pred string", "score double"])
    return source.mapInArrow(_predict_rows(docs.sparkSession.sparkContext.broadcast(model)), schema)


def training(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 3, is not 1; null ids are left out."""
    return docs.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def reject_undetermined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows whose text has a language, by a model learned from the rows themselves; columns unchanged."""
    model = learn(training(docs, id_col), text_col, lang_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                yield part.filter(pa.array([lang != UNDETERMINED for lang, _ in scorer.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
