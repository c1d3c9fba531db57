"""Near duplicates by BagMinHash signatures over multisets of word shingles.

A text is the multiset of its runs of five words (words are runs of other characters than white space, A-Z
lower-cased; a text of one to four words is one shingle). Similarity of two multisets is the sum of the lesser
counts over the sum of the greater ones.

Signature. Every shingle has Poisson processes of points (time, level) over dyadic ranges of weights (0,1],
(1,2], (2,4], (4,8] ...; each point belongs to one of the signature's components. A text with count w sees the
points at levels up to w, and a component keeps the earliest point seen, so that two texts agree in a component
with a probability equal to their similarity. Points are made in order of time, and a process stops as soon as
it is later than all components, which for all but the shortest texts is after one or two points a shingle.

Bands of five components give the candidates; with 20 bands a pair of similarity 0.8 shares a band with
probability 0.9996. Texts with the same multiset are one node, so copies cost nothing. In every bucket the
member that shares most buckets with others is the hub. All members are compared with the hub, exactly and on
whole texts. The middle of a star is the hub as most members have it. A member that isn't linked to the hub can only
be linked to another member of the star (a) if both have enough common shingles that exceed the middle's count, or
(b) if what both share with the middle suffices. Members for which (b) is open are first compared with a few members
nearest to the middle; who is in one class by then needs no more comparison. The other pairs, and no others, are found
by joins on the rarest shingles of (a) and on size bins, and compared. Members of several common stars meet in one of
them, that of the heaviest hub. So a group of thousands of near copies costs a few comparisons each, not one for each
pair, and no link that changes a class is lost.

Defined results: a null text is an empty one; texts without words are copies of each other. Rows with null ids
take part; the class is named by its least id, null only if all its ids are. Empty tables give empty results;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.llm.common import IS_SPACE, keep_rows, mix, slices, stored, table_of, text_bytes, text_keys
from leafmark.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: members near the middle of a star that those not linked to its hub are compared with first
CENTRES = 8
#: bits of the map of wanted keys, 2 MB at any size of input
SLOTS, SLOTS_A_ROW = 1 << 24, 1 << 15
U = np.uint64
BYTES = table_of(11)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
P = 0x9E3779B97F4A7C15 | 1
SIGNATURES = "doc_id long, _k1 long, _k2 long, n long, f1 long, f2 long, bands array<long>"


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * U(step)
        step = step * step % 2**64
        size += more
    return out


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _CACHE["up"], _CACHE["down"] = _powers(P, size), _powers(pow(P, -1, 2**64), size)
    return _CACHE["up"], _CACHE["down"]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the texts' bounds in them."""
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    space = IS_SPACE[data]
    inside = ~space
    starts = inside.copy()
    starts[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[LOWER[data]] * down[: len(data)], dtype=np.uint64)))
    words = mix((sums[e] - sums[s]) * up[e - 1] + (e - s).astype(np.uint64))
    bounds = np.searchsorted(s, offsets)
    counts = np.diff(bounds)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        part = words[k:] if k else words
        rolled[: len(part)] = rolled[: len(part)] * U(P) + part
    rolled = mix(rolled)
    full = np.maximum(counts - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(texts), counts)
    keep = np.arange(len(words)) - bounds[:-1][owner] < full[owner]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):  # one shingle of all words
        code = U(counts[i])
        for w in words[bounds[i] : bounds[i + 1]]:
            code = mix(code * U(P) + w)
        keep[bounds[i]] = True
        rolled[bounds[i]] = code
        full[i] = 1
    return rolled[keep], np.concatenate(([0], np.cumsum(full)))


def bags(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, code and count of each distinct shingle of each text, ordered."""
    codes = codes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        codes[a:b].sort()
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(codes):
        return owner, codes, np.zeros(0, np.int64)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], codes[at], np.diff(np.append(at, len(codes)))


def signatures(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """The earliest times, ``texts`` x ``size``; inf where a text has no shingle."""
    best = np.full(texts * size, np.inf)
    limit = np.full(texts, np.inf)
    top = int(weight.max()).bit_length() if len(weight) else 0
    live_owner, live_code, live_weight, low, span = [], [], [], [], []
    for k in range(top + 1):  # ranges (0,1], (1,2], (2,4], ...
        floor = 0 if k == 0 else 1 << (k - 1)
        inside = weight > floor
        if not inside.any():
            break
        live_owner.append(owner[inside])
        live_code.append(mix(code[inside] + U(k) * U(0xD1B54A32D192ED03)))
        live_weight.append(weight[inside])
        low.append(np.full(inside.sum(), floor))
        span.append(np.full(inside.sum(), max(1, floor)))
    if not live_owner:
        return best.reshape(texts, size)
    o, c, w, f, n = (np.concatenate(x) for x in (live_owner, live_code, live_weight, low, span))
    t, j = np.zeros(len(o)), 0
    while len(o):
        j += 1
        r = mix(c + U(j) * U(0x8CB92BA72F3D8DD7))
        t = t - np.log(((r >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / n
        live = t <= limit[o]
        if not live.all():
            o, c, w, f, n, t, r = (x[live] for x in (o, c, w, f, n, t, r))
        q = mix(r + U(0x632BE59BD9B4E019))
        place = (q >> U(32)) % U(size)
        level = f + 1 + ((q & U(0xFFFFFFFF)) % n.astype(np.uint64)).astype(np.int64)
        seen = level <= w
        np.minimum.at(best, o[seen] * size + place[seen].astype(np.int64), t[seen])
        some = np.unique(o)
        limit[some] = best.reshape(texts, size)[some].max(axis=1)
    return best.reshape(texts, size)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = BANDS * ROWS
    for batch in batches:
        for part in slices(batch, "text"):
            with np.errstate(over="ignore"):
                codes, bounds = shingles(*text_bytes(part.column(3))[::-1])
                owner, code, weight = bags(codes, bounds)
                texts = part.num_rows
                times = signatures(owner, code, weight, texts, size).view(np.uint64)
                rolled = np.zeros((texts, BANDS), np.uint64)
                for r in range(ROWS):
                    rolled = mix(rolled * U(P) + times.reshape(texts, BANDS, ROWS)[:, :, r])
                rolled = mix(rolled + np.arange(BANDS, dtype=np.uint64) * U(P))
                prints = []
                for seed in (3, 5):
                    each = mix(mix(code + U(seed)) + weight.astype(np.uint64) * U(P))
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
                    at = np.searchsorted(owner, np.arange(texts + 1))
                    prints.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
            n = np.diff(bounds)
            ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(rolled[n > 0].ravel().view(np.int64)))
            columns = [part.column(0), part.column(1), part.column(2), pa.array(n), *prints, bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_k1", "_k2", "n", "f1", "f2", "bands"])


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    codes, bounds = shingles(data, np.array([0, len(data)]))
    _, code, weight = bags(codes, bounds)
    return code, weight


def _beyond(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[int, np.ndarray]:
    """How many occurrences the bags (x, m) and (y, n) share, and (code, occurrence) hashes of those that only y has."""
    at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
    held = np.minimum(np.where(x[at] == y, m[at], 0) if len(x) else np.zeros(len(y), np.int64), n)
    extra = n - held
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    return int(held.sum()), mix(np.repeat(y, extra) + (np.repeat(held, extra) + step).astype(np.uint64) * U(P)).view(np.int64)


def _compare_rows(differences: bool):
    """Overlap and sizes of each pair; with ``differences`` also what only the second and only the first text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part in slices(batch, "b_text"):
                a_ids, a_texts, b_texts = part.column(0).to_pylist(), part.column(2), part.column(3)
                out: tuple[list, ...] = ([], [], [], [], [])
                with np.errstate(over="ignore"):
                    for i in range(part.num_rows):
                        if last[0] != a_ids[i]:
                            last = (a_ids[i], _bag(a_texts[i].as_py() or ""))
                        (x, m), (y, n) = last[1], _bag(b_texts[i].as_py() or "")
                        shared, extra = _beyond(x, m, y, n)
                        missing = _beyond(y, n, x, m)[1] if differences else None
                        for kept, value in zip(out, (int(m.sum()), int(n.sum()), shared, extra if differences else None, missing), strict=True):
                            kept.append(value)
                arrays = [part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.list_(pa.int64())) for x in out[3:])]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "a_n", "b_n", "shared", "extra", "missing"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, differences: bool = False) -> DataFrame:
    """``pairs(a, b)`` with sizes, overlap and link flag; ``texts(node, text)``."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"
    )
    rows = both.select("a", "b", "a_text", "b_text").mapInArrow(
        _compare_rows(differences), "a string, b string, a_n long, b_n long, shared long, extra array<long>, missing array<long>"
    )
    return rows.withColumn("linked", _alike(F.col("shared"), F.col("a_n"), F.col("b_n")))


def _alike(shared, a_n, b_n):
    """shared / (a_n + b_n - shared) >= 4/5 in whole numbers."""
    return shared * 9 >= (a_n + b_n) * 4


def _perhaps(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, is not in ``wanted``: a join with ``wanted`` follows, and
    what it would drop is not shuffled. The wanted keys travel as a map of bits, whose size is fixed."""
    part, at = (F.floor(F.pmod(key, F.lit(SLOTS)) / SLOTS_A_ROW), F.pmod(key, F.lit(SLOTS_A_ROW)))
    bits = wanted.select(part.alias("_part"), at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_part", part).withColumn("_at", at).join(F.broadcast(bits), "_part")
    return placed.where(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2 == 1).drop("_part", "_at", "_bits")


def _node():
    return F.concat(F.lpad(F.hex("f1"), 16, "0"), F.lpad(F.hex("f2"), 16, "0"))


def _middle(star: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members of the stars in which links can be missing, seen from the middle of their star.

    The middle is the hub without the occurrences that most members lack and with those that most add, so what the hub
    alone has or lacks is no difference of the others. ``held`` counts the occurrences of a member that are in the
    middle, ``extra`` lists the others. A member's top is the heaviest hub of its stars.
    """
    tops = star.select("a", "b").join(hubs, "a").groupBy("b").agg(F.max(F.struct("weight", "a")).alias("top")).select("b", F.col("top.a").alias("top"))
    sizes = star.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.min("linked").alias("all_linked"), F.min("b_n").alias("least_n"))
    some = stored(star.join(sizes.where("size > 1 and not all_linked").drop("all_linked"), "a").join(tops, "b"), "open_stars")
    nothing = F.array().cast("array<bigint>")

    def most(column: str) -> DataFrame:
        """What more than half of a star's members have: twice as many as a member has on average, at most."""
        held = some.select("a", "size", F.explode(column).alias("code")).groupBy("a", "code").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        return held.where("n * 2 > size").groupBy("a").agg(F.collect_list("code").alias(f"most_{column}"))

    given = F.array_except(F.coalesce("most_missing", nothing), "missing")
    more = F.array_except("extra", F.coalesce("most_extra", nothing))
    seen = some.join(most("extra"), "a", "left").join(most("missing"), "a", "left").withColumn("given", given).withColumn("more", more)
    held = F.col("shared") - F.size("given") + F.size("extra") - F.size("more")
    return stored(seen.select("a", "b", "top", "b_n", "linked", "least_n", held.alias("held"), F.concat("more", "given").alias("extra")), "members")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    label = labels.select(F.col("node").alias("b"), "component")
    return members.join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b")


def _central_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members that are not linked to the hub, each with up to ``CENTRES`` members that lie nearest to the middle."""
    placed = _labelled(members.drop("extra"), labels)
    near = placed.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(CENTRES)).alias("part")).agg(F.max(F.struct("held", "b", "b_n", "component")).alias("y"))
    loose = placed.where(~F.col("linked")).select("a", F.col("b").alias("x"), "component", "held", "b_n")
    pairs = loose.join(near.select("a", "y"), "a").where(
        (F.col("x") != F.col("y.b")) & (F.col("component") != F.col("y.component")) & _alike(F.least("held", "y.held"), F.col("b_n"), F.col("y.b_n"))
    )
    return _distinct_pairs(pairs.select("x", F.col("y.b").alias("y")))


def _member_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of members of one star, one of them not linked to the hub, that can be links at all.

    What two members share is at most the lesser ``held`` and what both have in ``extra``. Members with the same top
    meet in the star of that one only, members of one component not at all.
    """
    placed = stored(_labelled(members, labels), "placed_members")
    here = lambda x, y: (F.col(x) != F.col(y)) | (F.col(x) == F.col("a"))
    # (a) common extras; only those that a star's members of several components have
    codes = placed.select("a", "b", "top", "component", "linked", "b_n", "held", "least_n", F.explode("extra").alias("code"))
    wanted = stored(
        codes.groupBy("a", "code").agg(
            F.count(F.lit(1)).alias("holders"), F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min("linked").alias("all_linked"), F.min("top").alias("low"), F.max("top").alias("high"),
        ).where("lo <> hi and not all_linked and (low <> high or low = a)").select("a", "code", "holders"),
        "wanted",
    )
    # A member needs so many common extras at least with any other. Of the rarest all but so many, and one more, one is
    # common then: for both, as the order is the same.
    bag = W.partitionBy("a", "b")
    need = F.expr("greatest(1, (4 * (b_n + greatest((4 * b_n + 4) div 5, least_n)) + 8) div 9 - held)")
    rare = stored(
        codes.join(wanted, ["a", "code"])
        .withColumn("common", F.count(F.lit(1)).over(bag))
        .withColumn("place", F.row_number().over(bag.orderBy("holders", "code")))
        .where(F.col("place") <= F.col("common") - need + 1),
        "rare",
    )
    one = rare.where(~F.col("linked")).select(
        "a", "code", F.col("b").alias("x"), F.col("component").alias("x_component"), F.col("top").alias("x_top"),
        F.col("held").alias("x_held"), F.col("b_n").alias("x_n"), F.col("common").alias("x_common"),
    )
    by_code = one.join(rare.select("a", "code", F.col("b").alias("y"), "component", "top", "held", "b_n", "common"), ["a", "code"]).where(
        (F.col("x") != F.col("y")) & (F.col("x_component") != F.col("component")) & here("x_top", "top")
        & _alike(F.least("x_held", "held") + F.least("x_common", "common"), F.col("x_n"), F.col("b_n"))
    )
    # (b) sizes: 9 * least(held) >= 4 * (n + n'); bins of a fortieth of a doubling
    bin_of = lambda n: F.floor(F.log2(n) * 40)
    most = F.floor((F.col("held") * 9 - F.col("b_n") * 4) / 4)
    ranged = placed.where(~F.col("linked") & (most >= 1) & (most * 5 >= F.col("b_n") * 4)).select(
        "a", F.col("b").alias("x"), F.col("component").alias("x_component"), F.col("top").alias("x_top"), F.col("held").alias("x_held"), F.col("b_n").alias("x_n"),
        F.explode(F.sequence(bin_of(F.greatest(F.ceil(F.col("b_n") * 0.8), F.lit(1))), bin_of(most))).alias("bin"),
    )
    others = placed.where("b_n > 0").select("a", F.col("b").alias("y"), "component", "top", "held", "b_n", bin_of(F.col("b_n")).alias("bin"))
    by_size = ranged.join(others, ["a", "bin"]).where(
        (F.col("x") != F.col("y")) & (F.col("x_component") != F.col("component")) & here("x_top", "top")
        & _alike(F.least("x_held", "held"), F.col("x_n"), F.col("b_n"))
    )
    return _distinct_pairs(by_code.select("x", "y").unionByName(by_size.select("x", "y")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per document with its node, and ``(node, component)`` of the nodes that have links."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(F.col(text_col)), F.col(text_col).alias("text"))
    rows = stored(source.mapInArrow(_signature_rows, SIGNATURES).withColumn("node", _node()), "signatures")
    nodes = stored(
        rows.where("n > 0").groupBy("node").agg(F.min(F.struct("_k1", "_k2", F.col("doc_id").isNull().alias("none"), "doc_id", "n", "bands")).alias("one")),
        "nodes",
    )
    member = nodes.select("node", F.col("one.n").alias("n"), F.explode("one.bands").alias("bucket"))
    sizes = stored(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    held = stored(_perhaps(member, sizes, "bucket").join(sizes, "bucket"), "members")
    weight = held.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = stored(held.join(weight, "node").select("bucket", "node", "n", "weight"), "weighed")
    hubs = stored(weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("hub")), "hubs")
    star = weighed.join(hubs, "bucket").where(F.col("hub.node") != F.col("node"))
    pairs = stored(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b"), "pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    named = stored(nodes.join(needed, "node").select("node", F.col("one.doc_id").alias("doc_id"), F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2")), "named")
    on = F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s._k1") == F.col("w._k1")) & (F.col("s._k2") == F.col("w._k2"))
    texts = stored(_perhaps(source, named, "_k1").alias("s").join(named.alias("w"), on).dropDuplicates(["node"]).select("node", "text"), "texts")
    first = stored(_compared(pairs, texts, differences=True), "star")
    links = first.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = stored(components(links), "components")
    members = _middle(first, hubs.select(F.col("hub.node").alias("a"), F.col("hub.weight").alias("weight")).distinct())
    for step, candidates in (("central", _central_pairs), ("more", _member_pairs)):
        second = _compared(stored(candidates(members, labels), f"{step}_pairs"), texts).where("linked")
        second = stored(second.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{step}_links")
        if not second.isEmpty():
            links = links.unionByName(second)
            labels = stored(components(links), "components")
    return rows, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id`` (least id of its class), ``class_size, kept`` (one per class), ``n_shingles``."""
    placed, classes = _placed(docs, id_col, text_col)
    return placed.join(classes, "class").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("_row") == F.col("first._row")).alias("kept"), F.col("n").alias("n_shingles")
    )


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows, labels = near_classes(docs, id_col, text_col)
    placed = rows.select("doc_id", "_k1", "_k2", "n", "node").join(labels, "node", "left").select(
        "doc_id", "_k1", "_k2", "n", F.coalesce("component", "node").alias("class"), F.monotonically_increasing_id().alias("_row")
    )
    placed = stored(placed, "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_k1", "_k2", "_row")).alias("first")
    return placed, stored(placed.groupBy("class").agg(first, F.count(F.lit(1)).alias("class_size")), "classes")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns unchanged."""
    placed, classes = _placed(docs, id_col, text_col)
    first = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2"))
    counts = placed.groupBy("doc_id", "_k1", "_k2").agg(F.count(F.lit(1)).alias("copies"))
    repeated = stored(counts.where("copies > 1"), "repeated")
    kept = first.withColumn("copies", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._k1") == F.col("r._k1")) & (F.col("l._k2") == F.col("r._k2"))
        kept = first.alias("l").join(repeated.alias("r"), on, "left").select("l.doc_id", "l._k1", "l._k2", F.coalesce("copies", F.lit(1)).alias("copies"))
    return keep_rows(docs, stored(kept.withColumnRenamed("doc_id", id_col), "kept"), id_col, text_col)


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that a pair of that similarity shares a band."""
    return 1 - math.exp(bands * math.log1p(-(similarity**rows)))
