"""Prefix trie of conversations, its subtree totals read off an Euler tour.

Nodes are distinct beginnings of conversations. A node is named by its least member and its depth, which is unique:
a conversation has one beginning of each length. Beginnings are compared by 128 bits, the exclusive or of digests of
(position, turn), so that they are running folds, and no text is shuffled.

Each node has an enter and an exit arc. The arc after an enter arc is the enter arc of the first child or else the
node's own exit arc; the arc after an exit arc is the enter arc of the next sibling or else the exit arc of the
parent. The list of arcs is ranked by contraction: in each round the arcs whose random priority is below those of both
neighbours are spliced out, about a third, and their weights go to the arc before them; what is left, ``LAST`` arcs
at most, is walked by one task, and the rounds are then undone, each arc standing right after what its predecessor
had gathered. Prefix sums at a node's two arcs differ by the total of its subtree.

Defined results: turns stand by ``turn``, null first, equal ones by the digest of their content; null role and text
are empty; rows without ``conv_id`` belong to no conversation and are left out; an empty table gives no node. Further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import stored
from leafmark.llm.order import following, running, union

#: so many arcs at most are ranked by walking
LAST = 8192
#: member ids of a node are joined to text in pieces of so many consecutive ids
PIECE_BITS = 12
SUMS = ["rank", "leaves", "saved"]


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv, depth, k1, k2, size)``: every turn with its position from 1, a digest, and the bytes of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit("second"), role, text).alias("k2"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return running(turns, ["conv"], "turn", [F.col("k1"), F.col("k2")], depth=F.lit(1)).drop("turn")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.max("depth").alias("turns"))


def grafted(turns: DataFrame) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of c - c%5, then its own after its first h; h = crc32(c) % 9."""
    convs = lengths(turns)
    h = (F.crc32(F.col("conv").cast("string")) % 9).alias("h")
    plan = convs.select("conv", h, (F.col("conv") - F.col("conv") % 5).alias("donor"))
    donors = convs.select(F.col("conv").alias("donor"), F.col("turns").alias("has"))
    plan = plan.join(donors, "donor", "left").select("conv", "h", "donor", F.least(F.coalesce("has", F.lit(0)), "h").alias("taken"))
    own = turns.join(plan, "conv").where("depth > h").withColumn("depth", F.col("taken") + F.col("depth") - F.col("h"))
    given = turns.withColumnRenamed("conv", "donor").where("depth <= 8")
    lent = plan.join(given, "donor").where("depth <= h")
    return own.select(turns.columns).unionByName(lent.select(turns.columns))


def nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(conv, depth, parent, n_convs, size)`` and ends ``(conv, depth, member)``, one for each conversation.

    ``convs(conv)`` names all conversations, those without turns too. A beginning that many share is counted by
    partial sums; the joins by parent and by member are on keys of unlike weight, which adaptive execution splits.
    """
    tagged = turns.select("conv", "depth", "size", *[F.xxhash64("depth", k).alias(f"h{k[1]}") for k in ("k1", "k2")])
    keyed = stored(running(tagged, ["conv"], "depth", [], "bit_xor", p1=F.col("h1"), p2=F.col("h2")), "beginnings")
    grouped = keyed.groupBy("depth", "p1", "p2").agg(
        F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("size").alias("size"),
        F.min(F.col("p1").bitwiseXOR(F.col("h1"))).alias("q1"),
        F.min(F.col("p2").bitwiseXOR(F.col("h2"))).alias("q2"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("conv is not null")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n_convs", zero.alias("size"), zero.alias("q1"), zero.alias("q2"))
    made = stored(grouped.unionByName(root), "nodes")
    above = made.select(F.col("conv").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    tree = made.join(above, ["depth", "q1", "q2"], "left")
    last = keyed.join(lengths(turns).withColumnRenamed("turns", "depth"), ["conv", "depth"]).select(F.col("conv").alias("member"), "depth", "p1", "p2")
    bare = convs.join(turns.select("conv").distinct(), "conv", "left_anti").select(F.col("conv").alias("member"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"))
    ends = last.unionByName(bare).join(made.select("conv", "depth", "p1", "p2"), ["depth", "p1", "p2"])
    return stored(tree.select("conv", "depth", "parent", "n_convs", "size"), "tree"), ends.select("conv", "depth", "member")


def arcs(tree: DataFrame) -> DataFrame:
    """The tour as a list: arc ``(a, b)``, b = 2 depth for enter and 2 depth + 1 for exit, and the next arc ``(na, nb)``.

    Each arc weighs one step; an enter arc also weighs one leaf if its node has no child, and the node's savings.
    """
    below = tree.where("depth > 0")
    children = below.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.min("conv").alias("first"))
    siblings = following(below.select("conv", "depth", "parent"), ["parent", "depth"], "conv", "sibling").select("conv", "depth", "sibling")
    at = tree.join(children, ["conv", "depth"], "left").join(siblings, ["conv", "depth"], "left")
    leaf, down = F.col("first").isNull(), F.col("depth") * 2
    enter = at.select(
        F.col("conv").alias("a"),
        down.alias("b"),
        F.coalesce("first", "conv").alias("na"),
        F.when(leaf, down + 1).otherwise(down + 2).alias("nb"),
        F.lit(1).cast("long").alias("rank"),
        leaf.cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    leave = at.select(
        F.col("conv").alias("a"),
        (down + 1).alias("b"),
        F.coalesce("sibling", "parent").alias("na"),
        F.when(F.col("sibling").isNotNull(), down).when(F.col("parent").isNotNull(), down - 1).alias("nb"),
        F.lit(1).cast("long").alias("rank"),
        zero.alias("leaves"),
        zero.alias("saved"),
    )
    return enter.unionByName(leave)


def _merged(rows: DataFrame, *parts: Column) -> DataFrame:
    return rows.groupBy("a", "b").agg(*parts)


def _priority(a: str, b: str, turn: int) -> Column:
    return F.xxhash64(a, b, F.lit(turn))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums, each arc's own weight excluded, of a list that is all in this task."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    of = {(r["a"], r["b"]): r for r in rows}
    at, out = next(r for r in rows if r["pa"] is None), []
    total = dict.fromkeys(SUMS, 0)
    while at:
        out.append({"a": at["a"], "b": at["b"], **total})
        total = {s: total[s] + at[s] for s in SUMS}
        at = of.get((at["na"], at["nb"]))
    yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.int64()) for c in ("a", "b", *SUMS)]))


def ranked(chain: DataFrame, last: int = LAST) -> DataFrame:
    """``(a, b)`` of every arc of one linked list with the sums of ``SUMS`` over all arcs before it."""
    back = chain.where("na is not null").select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    both = chain.unionByName(back, allowMissingColumns=True)
    links, rounds = stored(_merged(both, *[F.max(c).alias(c) for c in ("pa", "pb", "na", "nb", *SUMS)]), "arcs"), []
    while links.count() > last:
        turn = len(rounds)
        own = _priority("a", "b", turn)
        out = F.col("pa").isNotNull() & (own < _priority("pa", "pb", turn)) & (F.col("na").isNull() | (own < _priority("na", "nb", turn)))
        flagged = links.withColumn("_out", out)
        gone = flagged.where("_out")
        to_prev = gone.select(
            F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("a").alias("xa"), F.col("b").alias("xb"),
            F.col("na").alias("xna"), F.col("nb").alias("xnb"), *[F.col(s).alias(f"x_{s}") for s in SUMS],
        )
        to_next = gone.where("na is not null").select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("pa").alias("npa"), F.col("pb").alias("npb"))
        kept = flagged.where("not _out").drop("_out")
        sent = kept.unionByName(to_prev, allowMissingColumns=True).unionByName(to_next, allowMissingColumns=True)
        names = [c for c in sent.columns if c not in ("a", "b")]
        state = stored(_merged(sent, *[F.max(c).alias(c) for c in names]), "round")
        rounds.append(state)
        cut = F.col("xa").isNotNull()
        links = state.select(
            "a", "b", F.coalesce("npa", "pa").alias("pa"), F.coalesce("npb", "pb").alias("pb"),
            F.when(cut, F.col("xna")).otherwise(F.col("na")).alias("na"), F.when(cut, F.col("xnb")).otherwise(F.col("nb")).alias("nb"),
            *[(F.col(s) + F.coalesce(f"x_{s}", F.lit(0))).alias(s) for s in SUMS],
        )
    schema = "a long, b long, " + ", ".join(f"{s} long" for s in SUMS)
    parts = [stored(links.select("a", "b", "pa", "na", "nb", *SUMS).coalesce(1).mapInArrow(_walk, schema), "walked")]
    for state in reversed(rounds):
        spliced = state.where("xa is not null").select("a", "b", "xa", "xb", *[F.col(s).alias(f"_{s}") for s in SUMS])
        found = spliced.join(union(parts), ["a", "b"])
        parts.append(stored(found.select(F.col("xa").alias("a"), F.col("xb").alias("b"), *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS]), "ranked"))
    return union(parts)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each node; a node's pieces come in order, one after the other."""
    node, hasher, out = None, None, []
    for batch in batches:
        for conv, depth, piece in zip(*[batch.column(c).to_pylist() for c in ("conv", "depth", "piece")], strict=True):
            if (conv, depth) == node:
                hasher.update(b"," + piece.encode())
                continue
            if node:
                out.append((*node, hasher.hexdigest()))
            node, hasher = (conv, depth), hashlib.sha256(piece.encode())
            if len(out) >= 4096:
                yield _hash_batch(out)
                out = []
    if node:
        out.append((*node, hasher.hexdigest()))
    if out:
        yield _hash_batch(out)


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True)
    return pa.record_batch({"conv": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": pa.array(digest, pa.string())})


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(conv, depth, ends_sha256)`` of the nodes at which conversations end.

    The ids of one node are joined in pieces of bounded size wherever they lie; the node's task streams the pieces
    through one hasher and never holds them together.
    """
    pieces = ends.groupBy("conv", "depth", F.shiftright("member", PIECE_BITS).alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("piece")
    )
    laid = pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "at")
    return laid.select("conv", "depth", "piece").mapInArrow(_hashes, "conv long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, last: int = LAST) -> DataFrame:
    """One row a node of the trie of ``turns(conv, depth, k1, k2, size)``; ``convs(conv)`` names all conversations."""
    tree, ends = nodes(turns, convs)
    if tree.isEmpty():
        at = tree.select("conv", "depth", *[F.lit(0).cast("long").alias(c) for c in ("enter_at", "exit_at", "n_leaves", "saved_tokens")])
    else:
        down = (F.col("b") % 2) == 0
        at = ranked(stored(arcs(tree), "tour"), last).groupBy(F.col("a").alias("conv"), F.shiftright("b", 1).alias("depth")).agg(
            F.max(F.when(down, F.col("rank"))).alias("enter_at"),
            F.max(F.when(~down, F.col("rank"))).alias("exit_at"),
            *[F.sum(F.when(down, -F.col(s)).otherwise(F.col(s))).alias(n) for s, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))],
        )
    counted = tree.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = tree.join(at, ["conv", "depth"]).join(counted, ["conv", "depth"], "left").join(end_hashes(ends), ["conv", "depth"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "enter_at",
        "exit_at",
    )


def prefix_trie(conversations: DataFrame, last: int = LAST) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` as they are."""
    turns = stored(sequences(conversations), "turns")
    return trie(turns, turns.select("conv").distinct(), last)


def grafted_trie(conversations: DataFrame, last: int = LAST) -> DataFrame:
    """The trie of ``conversations`` rebuilt on shared beginnings (:func:`grafted`)."""
    turns = stored(sequences(conversations), "turns")
    return trie(stored(grafted(turns), "grafted"), turns.select("conv").distinct(), last)
