"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a multiplicity. Every node has a list of its nearest nodes found so far.

Start: nodes are sorted by the signs of random projections, in several orders; each meets those next to it. The
sort is by ranges of (order, signs, projection), so a third of all vectors in one spot is cut into many ranges.
Descend: whoever is in the list of a node, or has the node in its own, meets the others there: neighbours of
neighbours. Lists keep the best, until a round changes less than ``CHANGED`` of their entries.
Saturated lists: a list full of links may have left out some. A link is left out only if both lists are full, so
all nodes with full lists, of whatever component, meet each other in blocks; only the counts of links and the
components they join leave the tasks. Blocks hold nodes of one component next to each other in an order. The angle
between two centres and the radii tell of most pairs of blocks that all or none of their members are links.
Audit: for a fixed number of nodes with full lists and of others, chosen by hash, the links are counted against all
vectors. If the mean share found of a node's links is less than ``target`` in either group, more orders are added
and the descent goes on; after a few such passes all nodes meet each other in blocks, which is exact.

Links are the pairs found with a cosine of at least the threshold, in double precision. Pairs of blocks that centres
and radii leave open cost a product each, the square of their number at worst; nothing is emitted per pair.

Defined results: vectors that are null, empty, zero, hold null or non-finite numbers, or whose length is not the
commonest one (the longest of several), link with nothing: no links, a component of their own. Equal rows are
vectors of their own and link with each other. Null ids take part; a component's id is the least one that isn't
null. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.llm.common import stored
from leafmark.llm.components import components

THRESHOLD = 0.9
LIST = 12
ORDERS, NEXT = 12, 8
AUDITED, TARGET = 1024, 0.95
#: the descent of a pass ends with a round that changes less than this share of all list entries
CHANGED = 0.01
#: passes of more orders each; if the audit still misses its target then, all nodes are compared with each other
PASSES = 3
BLOCK = 512
#: angles are taken as equal within this, many times the rounding error of an arc cosine
SLACK = 1e-6
EDGE = "u long, v long, cos double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projection(orders: range, bits: int, size: int) -> np.ndarray:
    """One set of ``bits`` random directions an order, always the same."""
    return np.concatenate([np.random.default_rng(1000 + k).standard_normal((size, bits)) for k in orders], axis=1)


def _order_rows(orders: range, bits: int, size: int):
    """Each vector once an order: its signs as one number, its first projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _projection(orders, bits, size)
        for batch in batches:
            if not batch.num_rows:
                continue
            p = (_matrix(batch.column(1)) @ directions).reshape(batch.num_rows, len(orders), bits)
            signs = (p > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
            for k, order in enumerate(orders):
                columns = [pa.array(np.full(batch.num_rows, order, np.int32)), pa.array(signs[:, k]), pa.array(p[:, k].sum(axis=1)), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, ["order", "signs", "place", *batch.schema.names])

    return run


def _adjacent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best few of those next to each vector in the order."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        order, node, x = batch.column(0).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4))
        if held is not None:
            order, node, x = np.concatenate((held[0], order)), np.concatenate((held[1], node)), np.concatenate((held[2], x))
        near = np.full((len(node), 2 * NEXT), -2.0)
        other = np.zeros((len(node), 2 * NEXT), np.int64)
        for step in range(1, min(NEXT, len(node) - 1) + 1):
            cos = np.where(order[:-step] == order[step:], np.einsum("ij,ij->i", x[:-step], x[step:]), -2.0)
            near[:-step, step - 1], other[:-step, step - 1] = cos, node[step:]
            near[step:, NEXT + step - 1], other[step:, NEXT + step - 1] = cos, node[:-step]
        best = np.argsort(-near, axis=1)[:, :4]
        cos = np.take_along_axis(near, best, axis=1)
        u, v, good = np.repeat(node, 4), np.take_along_axis(other, best, axis=1).ravel(), cos.ravel() > -2
        yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good]), pa.array(cos.ravel()[good])], ["u", "v", "cos"])
        held = order[-NEXT:], node[-NEXT:], x[-NEXT:]


def _meeting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, guest, worst, vector) in order of hosts: guests of one host meet. A pair is passed on if it is
    better than the worst in the list of one of the two."""
    held: list[pa.RecordBatch] = []

    def meet(rows: pa.Table):
        hosts, guests, worst = (rows.column(i).to_numpy() for i in range(3))
        x = _matrix(rows.column(3).combine_chunks())
        ends = np.flatnonzero(np.append(np.diff(hosts) != 0, True)) + 1
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts
        for size in np.unique(sizes):
            if size < 2:
                continue
            first = starts[sizes == size]
            a, b = np.triu_indices(size, 1)
            for some in np.array_split(first, -(-len(first) * size // 8192)):
                at = some[:, None] + np.arange(size)
                cos = (x[at] @ x[at].transpose(0, 2, 1))[:, a, b]
                i, j = at[:, a], at[:, b]
                good = (guests[i] != guests[j]) & ((cos > worst[i]) | (cos > worst[j]))
                yield pa.RecordBatch.from_arrays([pa.array(guests[i][good]), pa.array(guests[j][good]), pa.array(cos[good])], ["u", "v", "cos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hosts = batch.column(0).to_numpy()
        cut = int(np.searchsorted(hosts, hosts[-1]))  # the last host's guests may go on in the next batch
        if cut:
            yield from meet(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from meet(pa.Table.from_batches(held))


def _best(edges: DataFrame, size: int = LIST) -> DataFrame:
    """Lists: the ``size`` best of each node, ties by node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))
    once = both.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return once.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def _start(nodes: DataFrame, orders: range, bits: int, size: int) -> DataFrame:
    vector = nodes.schema["vector"].dataType.simpleString()
    placed = nodes.select("node", "vector").mapInArrow(_order_rows(orders, bits, size), f"order int, signs long, place double, node long, vector {vector}")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(tasks, "order", "signs", "place", "node").sortWithinPartitions("order", "signs", "place", "node")
    return ranged.mapInArrow(_adjacent_rows, EDGE)


def _descend(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: the pairs that meet at a common neighbour."""
    worst = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= LIST, F.min("cos")).otherwise(F.lit(-2.0)).alias("worst"))
    forward = lists.select(F.col("u").alias("host"), F.col("v").alias("guest"), "cos")
    back = lists.select(F.col("v").alias("host"), F.col("u").alias("guest"), "cos")
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc("cos"), "guest"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= LIST)
    meeting = forward.select("host", "guest").unionByName(back.select("host", "guest")).distinct()
    known = nodes.join(worst, nodes["node"] == worst["u"]).select(F.col("node").alias("guest"), "worst", "vector")
    rows = meeting.join(known, "guest").select("host", "guest", "worst", "vector")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "host").sortWithinPartitions("host").mapInArrow(_meeting_rows, EDGE)


BLOCKS = "block long, cut long, component long, n long, m long, centre array<double>, radius double, node array<long>, label array<long>, copies array<long>, vector array<double>"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (cut, label, node, copies, vector) as blocks, one row each: of one ``cut``, ``BLOCK`` nodes at most."""
    number, held = TaskContext.get().partitionId() << 33, None

    def blocks(rows: pa.Table, starts: np.ndarray, end: int):
        nonlocal number
        rows = rows.slice(0, end).combine_chunks()
        cut, label, node, copies = (rows.column(i).to_numpy() for i in range(4))
        x = _matrix(rows.column(4).combine_chunks())
        sizes = np.diff(np.append(starts, end))
        centre = np.add.reduceat(x, starts)
        length = np.linalg.norm(centre, axis=1, keepdims=True)
        centre = np.where(length > 1e-6, centre / np.maximum(length, 1e-6), x[starts])
        near = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(centre, sizes, axis=0)), starts)
        same = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
        ends = np.append(starts, end).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (node, label, copies)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(number + np.arange(len(starts))), pa.array(cut[starts]), pa.array(np.where(same, label[starts], -1)),
                pa.array(np.add.reduceat(copies, starts)), pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays((np.arange(len(starts) + 1) * x.shape[1]).astype(np.int32), pa.array(centre.ravel())),
                pa.array(np.arccos(np.clip(near, -1, 1))), *lists, pa.ListArray.from_arrays(ends * x.shape[1], pa.array(x.ravel())),
            ],
            ["block", "cut", "component", "n", "m", "centre", "radius", "node", "label", "copies", "vector"],
        )
        number += len(starts)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cut = rows.column(0).to_numpy()
        runs = np.append(np.flatnonzero(np.append(True, np.diff(cut) != 0)), len(cut))
        starts = np.concatenate([np.arange(i, j, BLOCK) for i, j in zip(runs[:-1], runs[1:])])
        if len(starts) > 1:
            yield from blocks(rows, starts[:-1], int(starts[-1]))
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield from blocks(held, np.zeros(1, np.int64), held.num_rows)


def _bound_rows(shared, threshold: float):
    """For each block: ``(lo, hi)`` of the pairs that only products can tell, and with ``hi`` null the rows ``n`` and
    nodes ``m`` of the blocks whose members are all links of all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, component, often, sizes, centre, radius = shared.value
        limit = math.acos(threshold)
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for some in np.array_split(mine, -(-len(mine) * len(block) // 4_000_000)) if len(mine) else []:
                angle = np.arccos(np.clip(centre[some] @ centre.T, -1, 1))
                reach = radius[some][:, None] + radius
                alike = (component[some][:, None] == component) & (component >= 0) & (some[:, None] != np.arange(len(block)))
                sure = alike & (angle + reach < limit - SLACK)
                i, j = np.nonzero(~sure & (angle - reach <= limit + SLACK) & (some[:, None] <= np.arange(len(block))))
                zero = np.zeros(len(i), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block[some[i]]), pa.array(block[j]), pa.array(zero), pa.array(zero)], ["lo", "hi", "n", "m"])
                yield pa.RecordBatch.from_arrays([pa.array(block[some]), pa.nulls(len(some), pa.int64()), pa.array(sure @ often), pa.array(sure @ sizes)], ["lo", "hi", "n", "m"])

    return run


def _product_rows(threshold: float):
    """Two blocks, or one with itself: ``(node, n, m)`` of their members, and ``(u, v)`` of components that a link joins."""

    def run(rows: pa.Table) -> pa.Table:
        sides = []
        for k in (0, rows.num_rows - 1):
            node, label, copies, flat = (rows.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("node", "label", "copies", "vector"))
            sides.append((node, label, copies, flat.reshape(len(node), -1)))
        (a, p, f, x), (b, q, g, y) = sides
        linked = x @ y.T >= threshold
        if rows.num_rows == 1:
            np.fill_diagonal(linked, False)
            node, n, m = a, linked @ g, linked.sum(axis=1)
        else:
            node, n, m = np.append(a, b), np.append(linked @ g, f @ linked), np.append(linked.sum(axis=1), linked.sum(axis=0))
        i, j = np.nonzero(linked & (p[:, None] != q))
        joined = np.unique(np.stack((p[i], q[j])), axis=1)
        none, nothing = pa.nulls(joined.shape[1], pa.int64()), pa.nulls(len(node), pa.int64())
        whole = lambda v, rest: pa.concat_arrays([pa.array(v.astype(np.int64)), rest])
        both = [pa.concat_arrays([nothing, pa.array(v)]) for v in joined]
        return pa.table([whole(node, none), whole(n, none), whole(m, none), *both], ["node", "n", "m", "u", "v"])

    return run


def _among(members: DataFrame, nodes: DataFrame, threshold: float, bits: int, size: int) -> tuple[DataFrame, DataFrame]:
    """``(node, n, m)``, the links - rows and nodes - that ``members(node, label, cut)`` have among themselves, and
    ``(u, v)``, the labels that such links join. Blocks whose centres and radii leave no doubt are not multiplied."""
    spark = nodes.sparkSession
    vector = nodes.schema["vector"].dataType.simpleString()
    given = members.join(nodes, "node").select("node", "vector", "cut", "label", "copies")
    placed = given.mapInArrow(_order_rows(range(1), bits, size), f"order int, signs long, place double, node long, vector {vector}, cut long, label long, copies long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(tasks, "cut", "signs", "place", "node").sortWithinPartitions("cut", "signs", "place", "node")
    blocks = stored(ranged.select("cut", "label", "node", "copies", "vector").mapInArrow(_block_rows, BLOCKS), "blocks")
    facts = blocks.select("block", "component", "n", "m", "radius", "centre").toArrow().combine_chunks()  # one row a block
    radius = facts.column("radius").to_numpy()
    centre = facts.column("centre").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(radius), -1) if len(radius) else np.zeros((0, size))
    shared = spark.sparkContext.broadcast((*(facts.column(c).to_numpy() for c in ("block", "component", "n", "m")), centre, radius))
    pairs = stored(spark.range(len(radius)).mapInArrow(_bound_rows(shared, threshold), "lo long, hi long, n long, m long"), "pairs")
    held = blocks.select("block", "node", "label", "copies", "vector")
    sure = pairs.where("hi is null and m > 0").select(F.col("lo").alias("block"), "n", "m").join(blocks.select("block", "node"), "block")
    sure = sure.select(F.explode("node").alias("node"), "n", "m")
    sides = pairs.where("hi is not null").select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block")).join(held, "block")
    told = stored(sides.groupBy("lo", "hi").applyInArrow(_product_rows(threshold), "node long, n long, m long, u long, v long"), "products")
    counts = told.where("node is not null").select("node", "n", "m").unionByName(sure)
    return counts, told.where("node is null").select("u", "v").distinct()


def _links(lists: DataFrame, nodes: DataFrame, threshold: float, bits: int, size: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(node, n, m, full)`` with the links to other nodes' rows and to other nodes and whether the node's list is full
    of links, and ``(node, component)`` of nodes with links. With ``every``, all nodes are compared with each other."""
    found = stored(_best(lists.where(F.col("cos") >= threshold), 2**31 - 1), "links")
    labels = stored(components(found.select("u", "v")), "components")
    # a link found is in the list of either node unless both are full, so only links among full ones can be cut off
    full = lists.where(F.col("cos") >= threshold).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LIST)
    full = stored(full.select(F.col("u").alias("node")), "full")
    if every:
        labels = stored(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
        members = labels.select("node", F.col("component").alias("label"), F.lit(0).cast("long").alias("cut"))
    else:
        members = labels.join(full, "node").select("node", F.col("component").alias("label"), F.col("component").alias("cut"))
    counts, joined = _among(members, nodes, threshold, bits, size)
    if not every:
        one, two = (full.select(F.col("node").alias(c), F.lit(True).alias(f"full_{c}")) for c in ("u", "v"))
        cut = found.join(one, "u", "left").join(two, "v", "left").where("full_u is null or full_v is null")
        listed = cut.join(nodes.select(F.col("node").alias("v"), "copies"), "v").select(F.col("u").alias("node"), F.col("copies").alias("n"), F.lit(1).cast("long").alias("m"))
        counts = counts.unionByName(listed)
    counts = counts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    counts = counts.join(full.withColumn("full", F.lit(True)), "node", "left").select("node", "n", "m", F.coalesce("full", F.lit(False)).alias("full"))
    if not joined.isEmpty():
        top = components(joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = stored(labels.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "joined")
    return stored(counts, "counts"), labels


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """The share of a node's links to other nodes that was found, each node with links counting alike and each link
    once: the mean over ``audited`` nodes with full lists and that over as many others, whichever is less. Nodes are
    chosen by hash; a mean over none is 1."""
    spark = nodes.sparkSession
    asked = nodes.select("node", "vector").join(counts.select("node", "m", "full"), "node", "left")
    asked = asked.select("node", "vector", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("full", F.lit(False)).alias("full"))
    some = [r for full in (F.col("full"), ~F.col("full")) for r in asked.where(full).orderBy(F.xxhash64("node"), "node").limit(audited).collect()]  # bounded
    ids = np.array([r["node"] for r in some])
    x = np.array([r["vector"] for r in some], np.float64)
    shared = spark.sparkContext.broadcast((ids, x / np.linalg.norm(x, axis=1, keepdims=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, y = shared.value
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                total += ((y @ _matrix(batch.column(1)).T >= threshold) & (asked[:, None] != node)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(total)], ["node", "true"])

    rows = nodes.select("node", "vector").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true")).collect()
    true = {r["node"]: r["true"] for r in rows}
    shares = [[min(r["m"], true[r["node"]]) / true[r["node"]] for r in some if r["full"] == full and true[r["node"]]] for full in (True, False)]
    return min((sum(x) / len(x) for x in shares if x), default=1.0)


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``, and the audited ``recall``."""
    v = F.col(vector_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stored(table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("vector")), "vectors")
    lengths = rows.where("vector is not null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    rows = rows.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")))
    same = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    bits, orders, recall = max(4, math.ceil(math.log2(max(n, 2) / 16))), range(0, ORDERS), 0.0
    lists = None
    for _ in range(PASSES if n else 0):
        found = _start(nodes, orders, bits, size)
        lists = stored(_best(found if lists is None else found.unionByName(lists)), "lists")
        changed = 1.0
        while changed >= CHANGED:
            before, lists = lists, stored(_best(lists.unionByName(_descend(lists, nodes))), "lists")
            changed = lists.join(before.select("u", "v"), ["u", "v"], "left_anti").count() / max(1, lists.count())
        counts, labels = _links(lists, nodes, threshold, bits, size)
        recall = audit(nodes, counts, threshold)
        if recall >= target:
            break
        orders = range(orders.stop, 2 * orders.stop)
    else:
        if n:
            counts, labels = _links(lists, nodes, threshold, bits, size, every=True)
            recall = 1.0
    alone = F.col("vec_id").alias("component_id")
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    named = nodes.drop("vector").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named.join(counts, "node", "left").select("node", "component", "least", "copies", F.coalesce("n", F.lit(0)).alias("n")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = stored(named.join(least, "component").join(nodes.select("node", "vector"), "node").select("vector", "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links")), "facts")
    linked = rows.where("vector is not null").join(facts, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), alone)
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", kept.alias("kept"), F.lit(recall).alias("recall"))
