"""Ranked lexical search over an index that is grouped by length.

A term's part in a score is ``w * ((10**9 * tf) div (1000 * tf + 12 * m))``: beside the term it depends on ``tf`` and
the document's normaliser ``m`` alone. Documents of equal ``m`` form a stratum, cut into cells of bounded text by a
hash of the id; a cell holds, for each term and tf, the documents as their places in the cell, so that an impact is
computed once for each tf of a cell. The greatest tf of each term in a cell gives a bound on every score there.

A search visits cells in the order of their bounds: the first ``FIRST`` cells of each item are scored, the 20th best
score found so far is what a cell's bound must reach to be visited at all, and no item's cell above it is left out.
Queries are sent to the tasks in blocks of ``PAIRS`` (item, term) pairs at most; the index never leaves its tasks.

Defined results: rows that agree in id and text are one document, rows without an id none at all; null and empty texts
have no terms; rows of one item id are one item; an item without terms, or none of whose terms occurs, has no rows;
equal scores stand by ascending id. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.llm.common import slices, stored
from leafmark.operators.joins import sized_join

#: what stands between terms, and terms
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 20
#: a cell holds so many documents and about so many term occurrences, one document at least
CELL_DOCS, CELL_TERMS = 4096, 1 << 21
#: cells of an item that are scored to learn what the others must reach
FIRST = 4
#: (item, term) pairs in a block of queries
PAIRS = 200_000
#: hits that are summed at once
HITS = 1 << 20
#: row of a cell that lists its documents; no term is empty
IDS = ""
INDEX = "m long, cell long, term string, tf long, docs array<long>"


@dataclass
class Index:
    """Postings of all documents, stored; ``n`` documents with terms, ``total`` terms in them."""

    postings: DataFrame
    n: int
    total: int


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def normaliser(n: Column, docs: int, total: int) -> Column:
    """``100 - 25 + ((25 * n * docs) div total)``; decimals hold the product, and div is exact."""
    product = n.cast("decimal(18,0)") * F.lit(Decimal(25 * docs))
    return F.lit(75).cast("long") + F.call_function("div", product, F.lit(Decimal(max(1, total))))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``, rows without an id left out, rows that repeat id and text once."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("doc_id is not null")
    keys = rows.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    repeated = keys.groupBy("doc_id", "k", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def _inverted(table: pa.Table) -> pa.Table:
    """Postings of one cell: one row a term and tf, and one row of all ids in ascending order."""
    m, cell = table.column("m")[0].as_py(), table.column("cell")[0].as_py()
    table = table.sort_by("doc_id")
    ids = table.column("doc_id").combine_chunks()
    words = pc.split_pattern_regex(pc.ascii_lower(table.column("text").combine_chunks().cast(pa.large_string())), BETWEEN)
    place = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    flat = words.flatten().dictionary_encode()
    code, names = np.asarray(flat.indices).astype(np.int64), flat.dictionary
    empty = pc.index(names, "").as_py() if len(names) else -1
    place, code = place[code != empty], code[code != empty]
    pair, tf = np.unique(code * len(words) + place, return_counts=True)
    code, place = pair // max(1, len(words)), pair % max(1, len(words))
    order = np.lexsort((place, -tf, code))
    code, place, tf = code[order], place[order], tf[order]
    new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])]) if len(code) else np.zeros(0, np.int64)
    rows = len(new) + 1
    offsets = np.r_[0, len(ids) + np.r_[new, len(place)]].astype(np.int64)
    values = np.r_[np.asarray(ids), place].astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(pa.list_(pa.int64()))
    term = pa.concat_arrays([pa.array([IDS], pa.large_string()), names.cast(pa.large_string()).take(pa.array(code[new]))]).cast(pa.string())
    same = [np.full(rows, x, np.int64) for x in (m, cell)]
    return pa.table({"m": same[0], "cell": same[1], "term": term, "tf": np.r_[0, tf[new]].astype(np.int64), "docs": lists})


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the number of its terms."""
    for batch in batches:
        for part in slices(batch, "text"):
            n = pc.count_substring_regex(part.column("text"), TERM).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, "n"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index all of ``docs``: one pass counts, one shuffles each text to its cell, where it is inverted.

    A stratum that holds any share of all rows is cut into as many cells as its size asks for.
    """
    counted = documents(docs, id_col, text_col).mapInArrow(_counting, "doc_id long, text string, n long").where("n > 0")
    lengths = stored(counted.groupBy("n").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    n, total = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    m = normaliser(F.col("n"), n, total).alias("m")
    by_docs, by_terms = F.sum("docs") / CELL_DOCS, F.sum(F.col("n") * F.col("docs")) / CELL_TERMS
    strata = stored(lengths.groupBy(m).agg(F.ceil(F.greatest(by_docs, by_terms)).cast("long").alias("cells")), "strata")
    placed = counted.select("doc_id", "text", m)
    dealt = sized_join(placed, strata, ["m"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.col("cells")))
    cells = dealt.select("m", "cell", "doc_id", "text").groupBy("m", "cell")
    return Index(stored(cells.applyInArrow(_inverted, INDEX), "postings"), n, total)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term, times)``."""
    each = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.explode(terms(F.col(f"`{text_col}`"))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def weighted(found: Index, wanted: DataFrame) -> DataFrame:
    """``wanted(item_id, term, times)`` with the weight of the term times its repeats; terms of no document go."""
    held = sized_join(found.postings, wanted.select("term").distinct(), ["term"], "left_semi")
    df = held.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    w = F.floor(1000 * F.log((2.0 * F.lit(found.n) + 2) / (2.0 * F.col("df") + 1)))
    return wanted.join(df, "term").select("item_id", "term", (w * F.col("times")).cast("long").alias("weight"))


class Block:
    """A block of queries as arrays: ``terms`` in order, and for each the items that ask for it with their weights."""

    def __init__(self, rows: list[tuple]):
        self.items = sorted({i for i, _, _ in rows}, key=lambda i: (i is None, i))
        place = {i: k for k, i in enumerate(self.items)}
        self.terms = sorted({t for _, t, _ in rows})
        at = {t: k for k, t in enumerate(self.terms)}
        code, item, weight = (np.array(x, np.int64) for x in zip(*[(at[t], place[i], w) for i, t, w in rows], strict=True))
        order = np.argsort(code, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.terms) + 1))


class Cell:
    """The postings of a cell that a block of queries asks for, impacts computed once for each tf."""

    def __init__(self, table: pa.Table, block: Block):
        self.m, self.cell = table.column("m")[0].as_py(), table.column("cell")[0].as_py()
        term = table.column("term").combine_chunks()
        docs = table.column("docs").combine_chunks()
        is_ids = np.asarray(pc.equal(term, IDS))
        self.ids = np.asarray(docs.filter(pa.array(is_ids)).flatten())
        keep = pa.array(~is_ids)
        code = pc.index_in(term.filter(keep), pa.array(block.terms, pa.string()))
        known = np.asarray(pc.is_valid(code))
        lists = docs.filter(keep).filter(pa.array(known))
        self.code = np.asarray(code.drop_null()).astype(np.int64)
        tf = np.asarray(table.column("tf").combine_chunks().filter(keep)).astype(np.int64)[known]
        each, at = np.unique(tf, return_inverse=True)
        self.impact = ((10**9 * each) // (1000 * each + 12 * self.m))[at]
        self.length = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.places = np.asarray(lists.flatten())
        self.block = block

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of ``rows`` beside each (item, weight) that asks for its term: row, place in the block's lists."""
        low, high = self.block.starts[self.code[rows]], self.block.starts[self.code[rows] + 1]
        return np.repeat(rows, high - low), _ranges(low, high - low)

    def bounds(self) -> np.ndarray:
        """For each item, no score in this cell is above: every term at its greatest tf. Items without a term: 0."""
        best = np.zeros(len(self.block.terms), np.int64)
        np.maximum.at(best, self.code, self.impact)
        out = np.zeros(len(self.block.items), np.int64)
        of = np.repeat(np.arange(len(best)), np.diff(self.block.starts))
        np.add.at(out, self.block.item, self.block.weight * best[of])
        return out

    def best(self, items: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, scores) of the ``k`` best documents of each of ``items``, with all scores at least ``least``."""
        rows, at = self.pairs(np.arange(len(self.code)))
        asked = np.full(len(self.block.items), -1)
        asked[items] = np.arange(len(items))
        mine = asked[self.block.item[at]]
        order = np.argsort(mine, kind="stable")[np.count_nonzero(mine < 0) :]
        rows, at, mine = rows[order], at[order], mine[order]
        hits = np.cumsum(self.length[rows])
        edges = np.searchsorted(mine, np.arange(len(items) + 1))
        first = 0
        while first < len(items):
            done = hits[edges[first] - 1] if edges[first] else 0
            last = first + 1
            while last < len(items) and hits[edges[last + 1] - 1] - done <= HITS and (last - first) * len(self.ids) <= HITS:
                last += 1
            part = slice(edges[first], edges[last])
            r, size = rows[part], self.length[rows[part]]
            scores = np.zeros((last - first) * len(self.ids), np.int64)
            value = self.block.weight[at[part]] * self.impact[r]
            to = np.repeat((mine[part] - first) * len(self.ids), size) + self.places[_ranges(self.start[r], size)]
            np.add.at(scores, to, np.repeat(value, size))
            for n, row in enumerate(scores.reshape(last - first, -1), first):
                low = max(1, least[items[n]], int(np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else 1)
                there = np.flatnonzero(row >= low)
                there = there[np.argsort(-row[there], kind="stable")][:k]
                if len(there):
                    yield int(items[n]), there, row[there]
            first = last


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _rows(columns: dict, types: dict) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate(v) if len(v) else [], t) for (c, t), v in zip(types.items(), columns.values(), strict=True)})


HIT = {"item": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
VISIT = {"item": pa.int64(), "m": pa.int64(), "cell": pa.int64(), "bound": pa.int64()}


def _bounding(block: Block):
    def bound(table: pa.Table) -> pa.Table:
        cell = Cell(table, block)
        bounds = cell.bounds()
        items = np.flatnonzero(bounds)
        same = [np.full(len(items), x, np.int64) for x in (cell.m, cell.cell)]
        return _rows({"item": [items], "m": [same[0]], "cell": [same[1]], "bound": [bounds[items]]}, VISIT)

    return bound


def _scoring(block: Block, least: np.ndarray, k: int):
    def score(table: pa.Table) -> pa.Table:
        cell = Cell(table, block)
        bounds = cell.bounds()
        items = np.flatnonzero((bounds > 0) & (bounds >= least))
        out: dict[str, list] = {c: [] for c in HIT}
        for item, there, scores in cell.best(items, least, k):
            out["item"].append(np.full(len(there), item))
            out["doc_id"].append(cell.ids[there])
            out["score"].append(scores)
        return _rows(out, HIT)

    return score


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(found: Index, rows: list[tuple], k: int, first: int) -> DataFrame:
    spark = found.postings.sparkSession
    block = Block(rows)
    names = spark.createDataFrame([(t,) for t in [*block.terms, IDS]], "term string")
    asked = found.postings.join(F.broadcast(names), "term", "left_semi")
    bounds = asked.groupBy("m", "cell").applyInArrow(_bounding(block), "item long, m long, cell long, bound long")
    order = W.partitionBy("item").orderBy(F.desc("bound"), "m", "cell")
    seeds = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= first).select("m", "cell").distinct()
    seeds = stored(seeds, "seeds")
    least = np.zeros(len(block.items), np.int64)
    seen = sized_join(asked, seeds, ["m", "cell"], "left_semi").groupBy("m", "cell")
    tried = _top(seen.applyInArrow(_scoring(block, least, k), "item long, doc_id long, score long"), k)
    for r in tried.where(F.col("rank") == k).select("item", "score").collect():
        least[r.item] = r.score
    hits = asked.groupBy("m", "cell").applyInArrow(_scoring(block, least, k), "item long, doc_id long, score long")
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(block.items)], "item long, item_id long")
    return _top(hits, k).join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(found: Index, items: DataFrame, k: int = TOP, first: int = FIRST, pairs: int = PAIRS) -> DataFrame:
    """The ``k`` best documents of each item: ``(item_id, rank, doc_id, score)``."""
    wanted = stored(weighted(found, item_terms(items)), "wanted")
    count = wanted.count()
    spark = wanted.sparkSession
    if not count:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    parts, out = -(-count // pairs), None
    for part in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        if rows:
            part_hits = _search(found, [tuple(r) for r in rows], k, first)
            out = part_hits if out is None else out.unionByName(part_hits)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs``, search for all ``items``."""
    return search(index(docs), items, k)
