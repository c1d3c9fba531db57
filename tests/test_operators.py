import math
import random
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from leafmark.functions import query as Q
from leafmark.operators import lexical, locate, outline, rerank
from leafmark.operators.dedup import import_status
from leafmark.operators.fusion import fuse
from leafmark.operators.indexing import build_index
from leafmark.operators.joins import hot_key_join
from leafmark.operators.running import running_max
from leafmark.operators.vectors import top_cosine
from leafmark.plans.retrieve import retrieve
from leafmark.session import write_table


def test_running_max_crosses_spans(spark):
    rng = random.Random(3)
    entries = [(rng.choice("ab"), rng.randrange(4000), rng.randrange(10**6)) for _ in range(300)]
    points = [(rng.choice("abc"), rng.randrange(4000)) for _ in range(400)]
    e = spark.createDataFrame(entries, "k string, pos long, v long")
    p = spark.createDataFrame(points, "k string, pos long")
    for inclusive in (True, False):
        found = {(r.k, r.pos): r.v for r in running_max(p, e, ["k"], "pos", ["v"], inclusive, span_bits=4).collect()}
        for k, x in set(points):
            want = [v for kk, y, v in entries if kk == k and (y < x or inclusive and y == x)]
            assert found[k, x] == (max(want) if want else None)


def nodes(rng, docs=2, n=60):
    out = []
    for d in range(docs):
        for seq in range(n):
            out.append((f"d{d}", seq, rng.choice(["GPIO 模式", "ADC 采样", "电源", "USART"]) + str(seq % 7), rng.randint(1, 4), rng.randint(1, 40)))
    return out


def test_outline_operators_match_brute_force(spark):
    rows = nodes(random.Random(5))
    toc = spark.createDataFrame(rows, "document_id string, seq long, title string, level int, page_number long")
    levels = outline.outline_levels(toc)

    parents = {(r.document_id, r.seq): r.parent_seq for r in outline.toc_parents(toc, levels).collect()}
    last = {}
    for d, seq, _, level, _ in rows:
        seen = last.setdefault(d, {})
        assert parents[d, seq] == seen.get(level - 1)
        seen[level] = seq
        for deeper in [x for x in seen if x > level]:
            del seen[deeper]

    ends = {(r.document_id, r.seq): r.end_page for r in outline.toc_sections(toc, levels).collect()}
    for d, seq, _, level, page in rows:
        later = [p for dd, _, _, l, p in rows if dd == d and p > page and l <= level]
        assert ends[d, seq] == (min(later) - 1 if later else outline.OPEN_END)

    pages = spark.createDataFrame([(f"d{d}", p) for d in range(3) for p in range(1, 45)], "document_id string, page_number long")
    context = outline.page_context(pages, toc, levels)
    words = ["ADC", "模式"]
    boosted = context.select("document_id", "page_number", "heading", outline.section_boost(F.col("sections"), F.col("page_number"), F.array(*map(F.lit, words))).alias("b"))
    for r in boosted.collect():
        before = [n for n in rows if n[0] == r.document_id and n[4] <= r.page_number]
        best = max(before, key=lambda n: (n[4], n[3], n[1]), default=None)
        assert r.heading == (best[2] if best else None)
        want = 0.0
        for d, seq, title, _, page in rows:
            if d == r.document_id and any(w in title for w in words):
                if page == r.page_number:
                    want = max(want, 0.55)
                elif page < r.page_number <= ends[d, seq]:
                    want = max(want, 0.18)
        assert r.b == want

    sections = write_table(outline.toc_sections(toc, levels), "sections")
    asked = spark.createDataFrame([(1, "ADC"), (1, "模式"), (2, "USART3"), (2, "X")], "query_id long, keyword string")
    found = {(r.query_id, r.document_id, r.seq) for r in outline.section_matches(sections, asked).collect()}
    assert found == {(q, d, s) for q, ws in ((1, words), (2, ["USART3"])) for d, s, t, _, _ in rows if any(w in t for w in ws)}


def test_import_status_with_a_hot_hash(spark):
    rows = [(("same" if i % 3 else f"h{i}"), i) for i in range(900)]
    df = spark.createDataFrame(rows, "sha256 string, doc_id long")
    library = spark.createDataFrame([("h3", 10_000)], "sha256 string, doc_id long")
    found = {r.doc_id: (r.status, r.duplicate_of) for r in import_status(df, "sha256", "doc_id", library).collect()}
    assert len(found) == 900
    assert found[1] == ("imported", None) and found[2] == ("duplicate", 1) and found[3] == ("duplicate", 10_000)
    assert sum(s == "imported" for s, _ in found.values()) == 300


def test_hot_key_join_resolves_both_kinds_of_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(6000)], "k string, i long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    rows = hot_key_join(left, write_table(right, "right"), "k", "n").collect()
    assert len(rows) == 11000
    assert all(r.top == (4999 if r.k == "hot" else r.i) for r in rows)


def test_fusion_prefers_shared_hits(spark):
    lists = spark.createDataFrame(
        [(1, 1.0, "shared", 1), (1, 1.0, "lexical", 2), (1, 1.15, "shared", 1), (1, 1.15, "vector", 2)],
        "query_id long, weight double, chunk_id string, rank int",
    )
    rows = {r.chunk_id: r.rrf for r in fuse(lists).collect()}
    assert max(rows, key=rows.get) == "shared" and abs(rows["shared"] - (1 / 61 + 1.15 / 61)) < 1e-12


def test_cosine_is_exact_over_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8)).astype("float32")
    base[100:200] = base[0]
    base[5] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(999, [1.0])], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(q, [float(x) for x in base[q]]) for q in range(12)], "query_id long, vector array<float>")
    for block in (2048, 4):
        found = {}
        for r in top_cosine(queries, vectors.repartition(5), 20, block).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
        for q in range(12):
            scores = []
            for i, v in enumerate(base.astype("float64")):
                a, b = base[q].astype("float64"), v
                norm = math.sqrt(a @ a) * math.sqrt(b @ b)
                scores.append((round(a @ b / norm, 9) if norm else -1.0, i))
            want = sorted(scores, key=lambda s: (-s[0], s[1]))[:20]
            assert [c for _, c, _ in sorted(found[q])] == [i for _, i in want]


MANUAL = [
    ("ref", "STM32 参考手册", 120, "PA9 可以用作 USART1_TX，USART1_REMAP 由 AFIO_MAPR 配置。GPIOA 端口使用 GPIOX_CRL。"),
    ("ref", "STM32 参考手册", 121, "USART_CR1 寄存器 UE TE 位。波特率由 USART_BRR 决定。"),
    ("ref", "STM32 参考手册", 3, "目录 1 .... 2 .... 3 .... 4 PA9 USART1_TX"),
    ("pin", "引脚定义", 1, "PA9 USART1_TX TIM1_CH2 默认复用功能"),
    ("gen", "一般说明", 7, "通用配置说明，如何设置外设。怎么使用串口。"),
    ("gen", "一般说明", 8, "4.3 低功耗模式 停止模式 待机模式 PWR_CR"),
]


def manual_index(spark):
    pages = spark.createDataFrame(
        [(d, t, p, str(p), f"第{p}节 {x[:4]}", [], x) for d, t, p, x in MANUAL],
        "document_id string, document_title string, page_number long, printed_page string, heading string, "
        "sections array<struct<from:bigint,titles:array<string>>>, text string",
    )
    return build_index(pages, None, [])


def test_bm25_matches_sqlite_full_text(spark):
    index = manual_index(spark)
    chunks = index.chunks.select("chunk_id", "tokens").collect()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, t, tokenize='unicode61')")
    db.executemany("insert into f values (?, ?)", [(c.chunk_id, " ".join(c.tokens)) for c in chunks])
    terms = ["USART1_TX", "PA9", "低功", "配置", "TX", "GPIOX_CRL", "寄存"]
    looked = spark.createDataFrame([(1, 0, 1.0, terms)], "query_id long, variant_no int, weight double, terms array<string>")
    sets = lexical.term_sets(index, looked, None)
    picked = {p.term for p in sets.first().picked}
    set_terms = lexical.set_term_rows(lexical.numbered_sets(sets))
    mine = {r.chunk_id: r.bm25 for r in lexical.bm25_candidates(index, set_terms, None, 100).collect()}
    match = " OR ".join(f'"{t}"' for t in picked)
    theirs = dict(db.execute("select id, -bm25(f, 0.0, 1.0) from f where f match ?", (match,)))
    assert mine.keys() == theirs.keys()
    assert all(abs(mine[k] - theirs[k]) < 1e-6 for k in mine)


def test_retrieve_ranks_exact_identifiers_first(spark):
    index = manual_index(spark)
    asked = spark.createDataFrame([(1, "PA9 怎么配置成 USART1_TX")], "query_id long, question string")
    rows = sorted(retrieve(index, asked).citations.collect(), key=lambda r: r.source_no)
    assert rows[0].chunk_id == "ref:120:0" and rows[0].source_id == "S1"
    assert not any(r.document_id == "gen" for r in rows)
    scoped = retrieve(index, asked, document_ids=["pin"]).citations.collect()
    assert {r.document_id for r in scoped} == {"pin"}
    assert retrieve(index, asked, document_ids=["missing"]).citations.count() == 0


def plain_selection(hits, aspects, limit=8):
    hits = sorted(hits, key=lambda h: (-h["score"], h["rank"], h["chunk_id"]))
    top, pages, docs, out = hits[0]["score"], set(), {}, []

    def add(h, free=False):
        page = h["document_id"], h["page_number"]
        if page in pages or (not free and docs.get(page[0], 0) >= 6):
            return
        pages.add(page)
        docs[page[0]] = docs.get(page[0], 0) + 1
        out.append(h)

    for n in range(aspects):
        open_ = [h for h in hits if (h["document_id"], h["page_number"]) not in pages and h["aspect_any"][n]]
        open_.sort(key=lambda h: -h["aspect_heading"][n])
        if open_ and open_[0]["score"] >= top * 0.15:
            add(open_[0], True)
    for h in hits:
        if len(out) >= limit:
            break
        if h["score"] >= (top * 0.38 if top > 1.6 else 0):
            add(h)
    return {h["chunk_id"] for h in sorted(out, key=lambda h: (-h["score"], h["rank"], h["chunk_id"]))[:8]}


def test_diverse_selection_matches_the_greedy_rule(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(25):
        aspects = q % 6
        hits = []
        for i in range(40):
            any_ = [rng.random() < 0.3 for _ in range(aspects)]
            hits.append(
                dict(
                    query_id=q, chunk_id=f"c{i:02}", document_id=f"d{rng.choice([0, 0, 0, 1, 2])}", page_number=rng.randrange(14),
                    score=round(rng.uniform(-0.2, 3 if q % 2 else 1.2), 2), rank=rng.randrange(1, 9),
                    aspect_any=any_, aspect_heading=[a and rng.random() < 0.4 for a in any_], inventory=False,
                )
            )
        rows += hits
        want[q] = plain_selection(hits, aspects)
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, document_id string, page_number long, score double, rank int, aspect_any array<boolean>, aspect_heading array<boolean>, inventory boolean")
    found = {}
    for r in rerank.select_diverse(df, 5).collect():
        found.setdefault(r.query_id, set()).add(r.chunk_id)
    assert found == want


def test_locate_names_the_source_page(spark):
    index = manual_index(spark)
    shots = spark.createDataFrame([(1, "低 功 耗 模 式 停 止 模 式 PWR_CR"), (2, "x")], "query_id long, question string")
    pages = write_table(locate.rank_pages(index, shots), "pages")
    best = pages.where("query_id = 1 and rank = 1").first()
    assert (best.document_id, best.page_number) == ("gen", 8)
    result = {r.query_id: r for r in locate.match_result(shots, pages).collect()}
    assert result[1].matched and not result[2].matched and len(result[2].warnings) == 1


def test_concept_terms_reach_the_variants(spark):
    asked = spark.createDataFrame([(1, "独立看门狗的溢出时间怎么算")], "query_id long, question string")
    (row,) = Q.analyze(asked).collect()
    assert any("IWDG_PR" in v.query for v in row.variants)
