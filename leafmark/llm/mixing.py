"""Mixing sources to target weights by balanced sampling with the cube method.

Sources weigh 5, 2, 1, repeating, in code point order with null last. They share 150 % of all words by weight;
no source gets more than twice its words, and what it would get beyond is shared anew by weight among those
below. A source with rate r = target / size takes each document floor(r) times and once more with probability
r - floor(r) - the inclusion probability.

Cube method. The probabilities of a block of documents move along a direction in the null-space of the balance
constraints - sum of words and number of documents, so a direction over three documents is the cross product of
(size, size, size) and (1, 1, 1) - until one of the three is 0 or 1; then the next document takes its place. All
blocks of a source, a thousand documents each, move at once and leave two undecided documents each,
three if their sizes are equal; those form the blocks of the next round, until one block is left for each source.
Its last documents - ten of all sizes that were kept back, and what its own flight leaves - are rounded such that
the words come nearest to the target. So every total is kept exactly up to that landing problem of 13 documents at
most, whatever the size of the source, and a source with a third of all rows is just more blocks.

Defined results: a null or empty text has size 0 and counts as a document with no words. Rows with equal ids are
documents of their own. Null sources are one source. An empty table gives an empty one. The same rows give the
same mix again, in whatever order they are read: the random steps follow hashes of source, block and size order.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import WORD, keyed, stored, text_keys

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
BLOCK = 1000
#: documents of a source's last block that only the landing decides
SPARE = 10
SURE = 1e-9


def fill_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Targets of the sources: ``share`` of all by weight, ``cap`` times their size at most, the excess shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), dict.fromkeys(order, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= cap * sizes[s]]
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Move the probabilities until at most three are neither 0 nor 1; sums of words and of documents stay."""
    p = list(chances)
    waiting = iter([i for i in range(len(p)) if SURE < p[i] < 1 - SURE])
    held = list(itertools.islice(waiting, 3))
    while len(held) == 3:
        a, b, c = held
        u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
        if not any(u):  # equal sizes: any direction with sum 0
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(held, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(held, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            q = p[i] + step * v
            p[i] = 0.0 if q < SURE else 1.0 if q > 1 - SURE else q
        held = [i for i in held if 0 < p[i] < 1]
        held += itertools.islice(waiting, 3 - len(held))
    return p


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """Round the last few, nearest to their expected words, then to their expected number."""
    if not sizes:
        return []
    options = (np.arange(1 << len(sizes))[:, None] >> np.arange(len(sizes)) & 1).astype(float)
    words = np.abs(options @ np.array(sizes) - np.dot(sizes, chances)).round(6)
    number = np.abs(options.sum(axis=1) - sum(chances))
    return options[np.lexsort((number, words))[0]].tolist()


def _decide():
    def run(block: pd.DataFrame) -> pd.DataFrame:
        last = block["blocks"].iloc[0] == 1  # of this source, however many blocks others have
        block = block.sort_values(["size", "_k1", "_k2", "doc_id"], ascending=[False, True, True, True], na_position="last")
        rng = random.Random(f"{block['source_no'].iloc[0]}/{block['block'].iloc[0]}/{len(block)}")
        sizes, chances = block["size"].astype(float).tolist(), block["chance"].tolist()
        open_ = [i for i, p in enumerate(chances) if SURE < p < 1 - SURE]
        # the last block of a source keeps a few documents of all sizes for the landing
        spare = set(open_[:: max(1, -(-len(open_) // SPARE))]) if last else set()
        moving = [i for i in open_ if i not in spare]
        for i, p in zip(moving, flight([sizes[i] for i in moving], [chances[i] for i in moving], rng), strict=True):
            chances[i] = p
        if last:
            rest = [i for i in open_ if SURE < chances[i] < 1 - SURE]
            for i, x in zip(rest, landing([sizes[i] for i in rest], [chances[i] for i in rest]), strict=True):
                chances[i] = x
        return block.assign(chance=chances)

    return run


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(F.col(text_col)), F.col(source_col).alias("source"), size.alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """``doc_id, _k1, _k2, source, size, source_size, target, times`` for every row; ``times`` is how often it is taken."""
    spark = docs.sparkSession
    rows = measured(docs, id_col, text_col, source_col)
    rows = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count(F.lit(1)).alias("documents")).collect()  # one row a source
    if not by_source:
        return rows.select("doc_id", "_k1", "_k2", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("times"))
    target = fill_targets({r["source"]: r["size"] for r in by_source})
    plan = []
    for number, r in enumerate(sorted(by_source, key=lambda r: (r["source"] is None, r["source"] or ""))):
        rate = target[r["source"]] / r["size"] if r["size"] else 0.0
        base = min(int(rate + SURE), int(CAP))
        plan.append((r["source"], number, r["size"], target[r["source"]], base, max(0.0, rate - base), -(-r["documents"] // block)))
    sources = spark.createDataFrame(plan, "s string, source_no int, source_size long, target double, base int, chance double, blocks long")
    spread = F.pmod(F.xxhash64("_k1", "_k2", "doc_id"), F.col("blocks"))
    state = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", spread)
    # copies of one row are one unit: so many are taken for certain, and one more with the chance that is left
    expected = F.col("copies") * F.col("chance")
    state = state.withColumn("sure", F.floor(expected + F.lit(SURE)).cast("long")).withColumn("chance", F.greatest(expected - F.col("sure"), F.lit(0.0)))
    most, decided = max(x[6] for x in plan), []
    while True:
        moved = stored(state.groupBy("source_no", "block").applyInPandas(_decide(), state.schema), "flight")
        open_ = (F.col("chance") > SURE) & (F.col("chance") < 1 - SURE) & (F.col("blocks") > 1)
        decided.append(moved.where(~open_))
        if most == 1:
            break
        # a block leaves two documents, three if their sizes are equal, so the next round has a fraction of the blocks
        fewer = lambda n: -(-n * 3 // block)
        most = fewer(most)
        left = moved.where(open_).withColumn("blocks", F.ceil(F.col("blocks") * 3 / block).cast("long"))
        state = left.withColumn("block", F.pmod(F.col("block"), F.col("blocks"))).select(state.columns)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    extra = F.col("sure") + F.round("chance").cast("long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    named = ("doc_id", "_k1", "_k2", "source", "size", "source_size", "target")
    return out.select(*named, "base", extra.alias("extra"), each).select(*named, F.when(F.col("copy") <= F.col("extra"), F.col("base") + 1).otherwise(F.col("base")).alias("times"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, each as often as it is taken; columns unchanged."""
    taken = mix(docs, id_col, text_col, source_col)
    # equal rows are interchangeable, so their decisions are summed and dealt out again
    sums = taken.groupBy("doc_id", "_k1", "_k2", "source").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_copies"))
    named = stored(sums.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "_k1", "_k2", "_times", "_copies"), "taken")
    left = keyed(docs, id_col, text_col, F.col(f"`{source_col}`").alias("_in")).alias("l")
    on = F.col("l._id").eqNullSafe(F.col("r._id")) & F.col("_in").eqNullSafe(F.col("_source"))
    on = on & (F.col("l._k1") == F.col("r._k1")) & (F.col("l._k2") == F.col("r._k2"))
    chosen = named.where("_times > 0")
    joined = left.join(chosen.alias("r"), on).select("_doc", "_times", "_copies", "_source", "r._id", "r._k1", "r._k2")
    once = joined.where("_copies = 1").select("_doc", "_times")
    if not chosen.where("_copies > 1").isEmpty():
        each = joined.where("_copies > 1").dropDuplicates(["_id", "_source", "_k1", "_k2"])
        once = once.unionByName(each.select("_doc", "_times"))
    return once.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_doc.*")
