"""Prefix trie, syncmer fingerprints and stratified search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from leafmark.llm import order, prefix_trie, strata, syncmers

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# --- helpers -------------------------------------------------------------------------------------------------------


def test_running_and_following_cross_spans(spark):
    rng = random.Random(1)
    values = sorted({rng.randrange(-50_000, 50_000) for _ in range(900)})
    rows = [(rng.randrange(3), v) for v in values]
    df = spark.createDataFrame(rows, "g long, v long")
    by = defaultdict(list)
    for g, v in rows:
        by[g].append(v)
    after = {(g, a): b for g, vs in by.items() for a, b in zip(vs, [*vs[1:], None], strict=True)}
    for levels in (1, 2, 3):
        assert {(r.g, r.v): r.n for r in order.following(df, ["g"], "v", "n", levels).collect()} == after
    counts = {(r.g, r.v): (r.n, r.x) for r in order.running(df, ["g"], "v", [], n=F.lit(1), x=F.col("v")).collect()}
    assert counts == {(g, v): (k + 1, sum(vs[: k + 1])) for g, vs in by.items() for k, v in enumerate(vs)}
    folded = {(r.g, r.v): r.x for r in order.running(df, ["g"], "v", [], "bit_xor", x=F.col("v")).collect()}
    for g, vs in by.items():
        at = 0
        for v in vs:
            at ^= v
            assert folded[g, v] == at


def test_following_of_no_rows_and_far_values(spark):
    assert order.following(spark.createDataFrame([], "g long, v long"), ["g"], "v").collect() == []
    far = spark.createDataFrame([(1, -(2**63)), (1, 2**63 - 1), (1, 0)], "g long, v long")
    assert {r.v: r.following for r in order.following(far, ["g"], "v").collect()} == {-(2**63): 0, 0: 2**63 - 1, 2**63 - 1: None}


# --- prefix trie ---------------------------------------------------------------------------------------------------


def plain_trie(sequences: dict[int, list]) -> dict:
    members = defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)

    out = {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below = [out[k] for k in children[key]]
        ends = ",".join(str(c) for c in sorted(members[key]) if len(sequences[c]) == len(key))
        out[key] = (
            min(members[key]),
            len(key),
            min(members[key[:-1]]) if key else None,
            len(members[key]),
            len(below),
            sum(b[5] for b in below) if below else 1,
            own + sum(b[6] for b in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def plain_sequences(rows: list[tuple]) -> dict[int, list]:
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in by.items()}


def plain_grafted(own: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + seq[h:]
    return out


def trie_rows(df) -> list:
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def conversations(seed: int, n: int, ids) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(ids, n):
        turns = rng.choice([None, 0]), *range(1, rng.randrange(1, 9))
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "ää", "", None, "long " * 40])) for t in turns]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("last", [2, 40, prefix_trie.LAST])
def test_trie_equals_plain_trie(spark, last):
    rows = conversations(last, 60, range(-100, 400))
    df = spark.createDataFrame(rows, TURNS)
    own = plain_sequences(rows)
    assert trie_rows(prefix_trie.grafted_trie(df, last)) == plain_trie(plain_grafted(own))
    assert trie_rows(prefix_trie.prefix_trie(df, last)) == plain_trie(own)


def test_trie_of_copies_long_conversations_and_extra_columns(spark):
    copies = [(c, t, "user", f"same {t}") for c in range(9000, 9300) for t in range(4)]
    long = [(7, t, "user", f"turn {t % 3}") for t in range(9000)]
    rows = [*copies, *long, (None, 1, "user", "nobody's")]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("k1", F.lit(2))
    got = prefix_trie.prefix_trie(df, 500)
    assert trie_rows(got.where("conv_id <> 7 or depth = 0")) == [r for r in plain_trie(plain_sequences(rows)) if r[0] != 7 or r[1] == 0]
    deep = got.where("conv_id = 7").agg(F.max("depth"), F.min("n_leaves"), F.count("*")).first()
    assert tuple(deep) == (9000, 1, 9001)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.grafted_trie(empty).collect() == []
    alone = spark.createDataFrame([(5, None, None, None)], TURNS)
    assert trie_rows(prefix_trie.prefix_trie(alone)) == plain_trie({5: [("", "")]})


# --- syncmers ------------------------------------------------------------------------------------------------------


def signed(data: bytes) -> int:
    x = xxhash.xxh64(data, seed=42).intdigest()
    return x - (1 << 64) if x >> 63 else x


def plain_anchors(text: str) -> list[int]:
    s, inner, k = syncmers.S, syncmers.INNER, syncmers.K
    h = [signed(text[i : i + s].encode("utf-32-be")) for i in range(len(text) - s + 1)]
    out = []
    for i in range(len(text) - k + 1):
        w = h[i : i + inner]
        if w[0] < min(w[1:]) or w[-1] < min(w[:-1]):
            out.append(i << 32 | signed(text[i : i + k].encode("utf-32-be")) & 0xFFFFFFFF)
    return out or [signed(text.encode()) & 0xFFFFFFFF]


def plain_links(marks: list[int]) -> set:
    pairs = zip(marks, [*marks[1:], None], strict=True)
    low = 0xFFFFFFFF
    return {(a & low, None if b is None else (b & low, (b >> 32) - (a >> 32))) for a, b in pairs}


def plain_likeness(a: list[int], b: list[int]) -> float:
    x, y = plain_links(a), plain_links(b)
    return 2 * len(x & y) / (len(x) + len(y))


def plain_fingerprints(rows: list[tuple[int, str]]) -> dict:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        q = len(text) // 3
        edited = text[: len(text) - q] + after[:q]
        a, b, c = plain_anchors(text), plain_anchors(edited), plain_anchors(after)
        show = [" ".join(f"{x:x}" for x in m) for m in (a, b)]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out[i] = (len(text), digest, *show, pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c)))
    return out


def syncmer_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢😀") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 7, 30, 80, 300]))) for _ in range(40)]
    return [*texts, texts[4], "", "x", "z" * 500, "ab" * 300, " ".join(rng.choice(words) for _ in range(4000)), "k" * syncmers.K]


def test_fingerprints_equal_plain_ones(spark):
    texts = syncmer_texts(3)
    ids = random.Random(5).sample(range(-10_000, 10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = syncmers.fingerprints(spark.createDataFrame(rows, DOCS).repartition(5))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == plain_fingerprints(rows)


@pytest.mark.parametrize("spread", [1, 10**12])
def test_next_document_across_windows(spark, spread, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS", 2)
    monkeypatch.setattr(syncmers, "KNOTS", 4)
    ids = [n * n * n * spread for n in range(150)]
    df = spark.createDataFrame([(i, f"document {i}") for i in ids], DOCS)
    got = {r.id: r.next_text for r in syncmers.neighbours(df).collect()}
    assert got == {i: f"document {j}" for i, j in zip(ids, [ids[-1], *ids[:-1]], strict=True)}


def test_fingerprints_of_nulls_repeats_and_nothing(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, "b"), (None, "b"), (2, "c" * 50)]
    df = spark.createDataFrame(rows, DOCS).withColumn("span", F.lit(0)).withColumn("key", F.lit(0)).withColumn("k1", F.lit(""))
    got = syncmers.fingerprints(df).collect()
    assert len(got) == 6 and all(0 <= r.near_next <= 1 and r.fingerprint for r in got)
    assert len({r.fingerprint for r in got}) == 4
    assert syncmers.fingerprints(df.where("false")).collect() == []
    one = syncmers.fingerprints(spark.createDataFrame([(3, "abcdef")], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1


# --- stratified search ---------------------------------------------------------------------------------------------


def plain_terms(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(strata.TERM, low)


def plain_search(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    tfs = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, total = len(tfs), sum(n for *_, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    w = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for t, d in df.items()}
    wanted = defaultdict(list)
    for i, text in items:
        wanted[i] += plain_terms(text)
    out = []
    for item, asked in wanted.items():
        scores = []
        for i, c, n in tfs:
            m = 75 + 25 * n * n_docs // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_plain_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(strata, "CELL_DOCS", 7)
    monkeypatch.setattr(strata, "HITS", 50)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(2000)] + ["É漢", "Straße", "KK"]
    docs = [(i, "--".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 20, 20, 200])))) for i in range(-150, 150)]
    docs += [(1000 + i, "same old words w1 w2 w3") for i in range(40)] + [(2000, None), (None, "w1 w1")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))) for i in range(30)]
    items += [(100, None), (101, "neverseen"), (102, "W1 w1 SAME Old"), (103, "é漢 Straße kK")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = strata.index(d)
    for k, first, pairs in ((20, 4, strata.PAIRS), (3, 1, 60)):
        got = strata.search(found, i, k, first, pairs).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_search(docs, items, k)


def test_search_of_repeats_clashes_and_nothing(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a c"), (2, "a"), (3, "zz")]
    df = spark.createDataFrame(rows, DOCS).withColumn("m", F.lit(0)).withColumn("term", F.lit("t")).withColumn("cell", F.lit(1))
    items = spark.createDataFrame([(9, "a"), (9, "c")], "item_id long, text string").withColumn("times", F.lit(5))
    got = [tuple(r) for r in strata.ranked(df, items).orderBy("rank").collect()]
    assert got == plain_search(rows[1:], [(9, "a c")], 20)
    assert strata.ranked(df.where("false"), items).collect() == []
    assert strata.ranked(df, items.where("false")).collect() == []
