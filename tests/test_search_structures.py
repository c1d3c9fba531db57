"""Block bounds, positions, exact terms and the keyword automaton against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmark.operators import blockmax, indexing, keywords, lexical
from leafmark.plans import evaluate
from leafmark.session import write_table

CHUNKS = "chunk_id string, document_id string, page_number long, document_title string, heading string, text string"


def library(spark, seed=5, n=120):
    rng = random.Random(seed)
    vocabulary = ["GPIO", "USART1_TX", "USART1", "TX", "A_A_B", "A", "A_A", "模式", "mode", "x_", "_", "clock", "ADC", "TX_USART1"]
    rows = [(f"c{i:03}", f"d{i % 4}", i // 3, "T", None, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 14)))) for i in range(n)]
    chunks = write_table(indexing.tokenized(spark.createDataFrame(rows, CHUNKS)), "chunks")
    return indexing.index_chunks(chunks, None, [])


def test_postings_hold_positions_and_exact_terms(spark):
    index = library(spark)
    held = {(r.chunk_id, r.term): r for r in index.postings.collect()}
    seen = 0
    for c in index.chunks.collect():
        for term in {*c.subs, *c.tokens}:
            r = held[c.chunk_id, term]
            assert list(r.positions) == [i for i, s in enumerate(c.subs) if s == term] and r.tf == len(r.positions)
            assert r.exact == (term in c.tokens) and (r.document_id, r.page_number, r.length) == (c.document_id, c.page_number, len(c.subs))
            seen += 1
    assert seen == len(held)
    counts = Counter(s for c in index.chunks.collect() for s in set(c.subs))
    assert {r.term: r.df for r in index.term_stats.collect()} == counts


def test_phrases_are_pieces_side_by_side(spark):
    index = library(spark)
    terms = write_table(spark.createDataFrame([(t,) for t in ("USART1_TX", "A_A_B", "A_A", "TX_USART1", "GPIO", "B_A", "NO_TX")], "term string"), "terms")
    got = {(r.term, r.chunk_id): r.tf for r in lexical.term_occurrences(index, terms).collect()}
    want = {}
    for c in index.chunks.collect():
        for (term,) in terms.collect():
            parts = term.split("_")
            tf = sum(list(c.subs[i : i + len(parts)]) == parts for i in range(len(c.subs)))
            want |= {(term, c.chunk_id): tf} if tf else {}
    assert got == want and len({t for t, _ in got}) >= 4


@pytest.mark.parametrize("depth", [1, 5, 1000])
def test_shard_stops_early_and_misses_nothing(depth):
    rng = random.Random(depth)
    n, terms = 3000, [f"t{i}" for i in range(30)]
    rows = []
    for c in range(n):
        for t in rng.sample(range(30), 3) + ([0] if c < 40 else []):
            rows.append((f"c{c:05}", terms[t], rng.choice([1, 1, 2, 9 if c < 60 else 2]), rng.randrange(3, 90)))
    rows = list({(c, t): (c, t, f, k) for c, t, f, k in rows}.values())
    length = {c: k for c, _, _, k in rows}
    rows = [(c, t, f, length[c]) for c, t, f, _ in rows]
    table = pa.table(dict(zip(("chunk_id", "term", "tf", "length"), map(list, zip(*rows)))))
    shard = blockmax.Shard(table, terms, 1.2, 0.75, 40.0)
    read_all = held_all = 0
    for _ in range(10):
        asked = rng.sample(range(30), 6)
        idf = [rng.random() * 3 + 0.01 for _ in asked]
        scores = Counter()
        for c, t, f, k in rows:
            if int(t[1:]) in asked:
                scores[c] += idf[asked.index(int(t[1:]))] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * k / 40.0))
        places, found, read, held = shard.best(np.array(asked), np.array(idf), depth)
        got = {shard.names[int(p)].as_py(): s for p, s in zip(places, found)}
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:depth]
        assert {c for c, _ in best} <= got.keys() and all(got[c] == pytest.approx(s) for c, s in best)
        assert held == sum(int(t[1:]) in asked for _, t, _, _ in rows)
        read_all, held_all = read_all + read, held_all + held
    # terms spread as evenly as these leave few blocks out; what stands together leaves most out
    assert read_all < held_all if depth < 10 else read_all <= held_all


def test_blocks_without_the_rare_term_are_not_read():
    rows = [(f"c{c:05}", "common", 1, 30) for c in range(4000)] + [(f"c{c:05}", "rare", 3, 30) for c in range(100, 116)]
    table = pa.table(dict(zip(("chunk_id", "term", "tf", "length"), map(list, zip(*rows)))))
    shard = blockmax.Shard(table, ["common", "rare"], 1.2, 0.75, 30.0)
    places, _, read, held = shard.best(np.array([0, 1]), np.array([0.1, 5.0]), 10)
    assert {shard.names[int(p)].as_py() for p in places} == {f"c{c:05}" for c in range(100, 116)}
    assert held == 4016 and read < 200


def test_block_bounds_give_the_same_lists_as_all_postings(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 2)
    index = library(spark, 8, 300)
    rng = random.Random(2)
    asked = [(s, t, 0.1 + rng.random()) for s in range(25) for t in rng.sample(["GPIO", "USART1_TX", "TX", "A", "MODE", "CLOCK", "ADC"], 3)]
    sets = write_table(spark.createDataFrame(asked, "set_id long, term string, idf double"), "sets")
    full = lexical.bm25_candidates(index, sets, None, None)
    for scope in (None, ["d1", "d2"]):
        full = lexical.bm25_candidates(index, sets, scope, None)
        want = sorted(tuple(r) for r in full.where("place <= 7").select("set_id", "chunk_id", F.round("bm25", 6), "place").collect())
        got = lexical.bm25_candidates(index, sets, scope, 7)
        assert sorted(tuple(r) for r in got.select("set_id", "chunk_id", F.round("bm25", 6), "place").collect()) == want
    counts = lexical.block_max(index, sets, None, 2).where("chunk_id is null").agg(F.sum("postings_read"), F.sum("postings")).first()
    assert 0 < counts[0] < counts[1]
    # many blocks of sets
    small = blockmax.best_chunks(write_table(lexical.term_occurrences(index, sets.select("term").distinct()), "occ"), sets, 7, 300, 1.2, 0.75, index.avg_length, pairs=20)
    assert small.select("set_id").distinct().count() == 25


def test_automaton_finds_every_keyword(spark):
    rng = random.Random(6)
    words = list({"".join(rng.choice("ab漢 ") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    texts = ["".join(rng.choice("ab漢 c") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [""]
    of = keywords.Automaton(words)
    for text in texts:
        assert {words[k] for k in of.find(text)} == {w for w in words if w in text}
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "n long, t string")
    asked = spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "keyword string")
    want = sorted((n, t, w) for n, t in enumerate(texts) for w in words if w in t)
    for chars in (1 << 20, 30):
        assert sorted(tuple(r) for r in keywords.containing(df, "t", asked, chars).collect()) == want
    assert keywords.containing(df, "t", asked.where("false")).collect() == []


def test_truth_holds_passages_of_any_kind(spark):
    index = library(spark)
    pages = index.chunks.groupBy("document_id", "page_number").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    asked = ["GPIO", "USART1_TX", "x_", "TX", "mode GPIO", "模式", "nowhere", "", "clock ADC mode", "USART1_TX A_A_B", "C"]
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    got = sorted(tuple(r) for r in evaluate.containing_pages(index, passages, pages).collect())
    want = sorted((q, p.document_id, p.page_number) for p in pages.collect() for q, text in enumerate(asked) if text and text in p.text)
    assert got == want and len({q for q, *_ in got}) >= 7
