"""Work that must not grow faster than its input: what is shuffled, stored and carried."""

import json
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from leafmark.functions import text as X
from leafmark.operators import blockmax, indexing, lexical, products
from leafmark.plans import corpus
from leafmark.plans.catalog import QUERIES
from leafmark.session import write_table
from leafmark.streaming import events, imports


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_read_off_the_chunks(spark, sf_dir):
    index = corpus.index_of(spark, sf_dir)
    assert all(word not in plan_of(index.postings) for word in ("Repartition", "Sort", "Aggregate", "Join"))
    asked = spark.createDataFrame([("THE",), ("NO_SUCH_TERM",)], "term string")
    whole = {r.term: r.df for r in index.term_stats.collect()}
    assert {r.term: r.df for r in index.frequency_of(asked).collect()} == {t: n for t, n in whole.items() if t == "THE"}


def test_places_are_looked_up_for_pieces_asked_for_only(spark, monkeypatch):
    from test_search_structures import library

    index = library(spark)
    asked = write_table(spark.createDataFrame([("USART1_TX",), ("A_A",), ("GPIO",), ("NO",)], "term string"), "asked")
    found = lexical.term_occurrences(index, asked)
    # no array of postings is made of a chunk's pieces
    assert "transform(array_distinct(subs" in plan_of(index.postings) and "transform(array_distinct(subs" not in plan_of(found)
    # what is found once for a chunk stands below the explode of its pieces
    plan = plan_of(index.found_in(asked.withColumnRenamed("term", "piece")))
    assert plan.index("Generate explode") < plan.index("array_sort(subs")
    rows = lambda df: sorted(tuple(r) for r in df.select("term", "chunk_id", "document_id", "length", "tf").collect())
    small = rows(found)
    monkeypatch.setattr(indexing, "fits", lambda _: False)
    assert small == rows(lexical.term_occurrences(index, asked)) and len({r[0] for r in small}) == 3


def test_readers_of_chunk_texts_pay_for_no_tokens(spark, sf_dir):
    context, _, _ = corpus.library_base(spark, sf_dir)
    rows = indexing.tokenized(indexing.chunk_rows(corpus.contextual_pages(spark, sf_dir)))
    plan = plan_of(rows.select("document_id", "page_number", "chunk_index", "text"))
    assert "regexp_extract_all" not in plan and "regexp_extract_all" in plan_of(rows.select("tokens"))


def test_every_hit_is_made_without_a_shuffle(spark):
    from test_search_structures import library

    index = library(spark)
    variants = [(1, 0, 1.0, ["USART1_TX", "GPIO", "A_A"]), (1, 1, 0.5, ["GPIO", "MODE"]), (2, 0, 1.0, ["A", "_", "CLOCK", "X_"])]
    looked = write_table(spark.createDataFrame(variants, "query_id long, variant_no int, weight double, terms array<string>"), "looked")
    keywords = spark.createDataFrame([(1, ["GPIO", "MODE"]), (2, ["CLOCK"])], "query_id long, keywords array<string>")
    every = lexical.search(index, looked, keywords, limit=None, term_limit=None, rare_share=None)
    deep = lexical.search(index, looked, keywords, limit=1000, term_limit=None, rare_share=None)
    rows = lambda found: sorted((r.query_id, r.variant_no, r.chunk_id, round(r.score, 6), r.rank) for r in found.lists.collect())
    assert rows(every) == rows(deep) and len(rows(every)) > 100
    assert every.hits.where("first").count() == every.hits.select("query_id", "chunk_id").distinct().count()
    plan = plan_of(every.hits)
    assert "Aggregate" not in plan and "Repartition" not in plan


def test_pages_of_equal_score_stay_in_page_order(spark):
    weights = spark.createDataFrame([(1, "A", 1.0), (1, "B", 0.5), (2, "B", 2.0)], "query_id long, term string, weight double")
    rows = [("d", n, ["A", "B"] if n == 700 else ["A"] if n % 2 else ["C", "A"]) for n in range(1500)] + [("d", 9, ["B"])]
    chunks = spark.createDataFrame(rows, "document_id string, page_number long, tokens array<string>").repartition(3)
    found = products.page_scores(weights, chunks, ["document_id", "page_number"], 3).collect()
    best = lambda q: [(r.page_number, r.matched) for r in sorted((r for r in found if r.query_id == q), key=lambda r: (-r.matched, r.page_number))[:3]]
    assert best(1) == [(9, 1.5), (700, 1.5), (0, 1.0)] and best(2) == [(9, 2.0), (700, 2.0)]
    assert len(found) < 60


def test_tokens_are_read_without_classes_of_ranges(spark, sf_dir):
    texts = ["a B c_ 1 22 ŉx ſt ß straße ﬁn é１ 模 模式 x", "", "K\u212a \u0131i\u0307", "plain words, 7 of them; z", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").withColumn("folded", X.fold(F.col("t")))
    got = rows.select("n", X.search_terms(F.col("t")).alias("terms"), F.regexp_extract_all("folded", F.lit("[A-Z0-9_]{2,}|[0-9]"), F.lit(0)).alias("words")).collect()
    for r in got:
        assert (r.terms is None and r.words is None) or [t for t in r.terms if t.isascii()] == list(dict.fromkeys(r.words))
    plan = plan_of(indexing.tokenized(indexing.chunk_rows(corpus.contextual_pages(spark, sf_dir))).select("tokens"))
    assert "[A-Z0-9_]" not in plan and r"[^\x00-\x7F]" not in plan


def test_best_chunks_are_found_without_a_shuffle(spark, monkeypatch):
    from test_search_structures import library

    index = library(spark, 8, 300)
    terms = ["GPIO", "USART1_TX", "TX", "A", "MODE", "CLOCK", "X_", "A_A_B", "_", "NO"]
    sets = write_table(spark.createDataFrame([(n % 4, t, 0.1 + n) for n, t in enumerate(terms)], "set_id long, term string, idf double"), "sets")
    rows = lambda df: sorted((r.set_id, r.chunk_id, round(r.bm25, 6), r.place) for r in df.collect())
    for scope in (None, ["d1", "d2"], [f"d{n}" for n in range(2, 200)]):
        whole = rows(lexical.bm25_candidates(index, sets, scope, None).where("place <= 9"))
        for shard in (20_000, 7):
            monkeypatch.setattr(blockmax, "SHARD", shard)
            assert rows(lexical.bm25_candidates(index, sets, scope, 9)) == whole
        # more sets than travel at once: their postings are stored and dealt out
        with monkeypatch.context() as m:
            m.setattr(lexical, "PAIRS", 3)
            assert rows(lexical.bm25_candidates(index, sets, scope, 9)) == whole
    stored = []
    monkeypatch.setattr(blockmax, "write_table", lambda df, name: stored.append(df) or write_table(df, name))
    lexical.block_max(index, sets, None, 9)
    assert all(word not in plan_of(stored[0]) for word in ("Repartition", "Sort", "Aggregate", "Join", "Generate"))


def test_frequencies_are_counted_where_the_chunks_are(spark, monkeypatch):
    from test_search_structures import library

    index = library(spark)
    terms = write_table(spark.createDataFrame([(t,) for t in ("GPIO", "USART1_TX", "A_A", "X_", "_", "NO", "A_A_B")], "term string"), "terms")
    rows = lambda scope: sorted(tuple(r) for r in lexical.document_frequency(index, terms, scope).collect())
    scopes = (None, ["d1", "d2"], [f"d{n}" for n in range(2, 200)], ["none"])
    small = [rows(s) for s in scopes]
    plan = plan_of(lexical.document_frequency(index, terms, ["d1"]))
    assert "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(lexical, "fits", lambda _: False)
    assert [rows(s) for s in scopes] == small and len(small[0]) == 5 and lexical.document_frequency(index, terms.where("false")).collect() == []


class Cells:
    """A keyed state in memory that counts how often it is called."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.getMapState(name, None, schema)

    def getMapState(self, name, key, value):  # noqa: N802
        return Cell(self, name)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Cell:
    def __init__(self, cells, name):
        self.cells, self.name = cells, name

    def getValue(self, key):  # noqa: N802
        self.cells.calls += 1
        return self.cells.kept.get((self.name, key))

    def updateValue(self, key, value):  # noqa: N802
        self.cells.calls += 1
        self.cells.kept[self.name, key] = value

    def removeKey(self, key):  # noqa: N802
        del self.cells.kept[self.name, key]

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


def pushed(frames, rows, at=0):
    batch = pd.DataFrame(rows, columns=["stream_id", "seq", "piece"])
    return [tuple(r) for df in frames.handleInputRows((0,), iter([batch[:7], batch[7:]]), Now(at)) for r in df.itertuples(index=False)]


def test_streams_share_the_calls_to_their_state():
    from test_sources_streaming import cut, frame, plain_frames

    texts = [frame(f"{n} A") + "data: [DONE]\n\n" + frame("late") if n % 3 else frame("ſ€😀") + frame("B").rstrip("\n") for n in range(900)]
    streams = {None if n == 5 else f"s{n}": cut(text, 9 + n % 20) for n, text in enumerate(texts)}
    want = sorted(((s, *r) for s, pieces in streams.items() for r in plain_frames(pieces)), key=str)
    rows = [(s, i, p) for s, pieces in streams.items() for i, p in enumerate([*pieces, None])]
    random.Random(7).shuffle(rows)
    cells, found = Cells(), []
    frames = events.Frames()
    frames.init(cells)
    # streams that come a few at a time, so that pages grow in number; then pieces of all
    first = [n for n in range(0, 700, 100)]
    for some in [*(rows[a : a + 100] for a in first), rows[700 : len(rows) // 2], rows[len(rows) // 2 :]]:
        before = cells.calls
        found += pushed(frames, some)
        assert cells.calls - before < 40 + len({s for s, _, _ in some}) // 4
    assert sorted(found, key=str) == want
    pages = [json.loads(v[0]) for (name, _), v in cells.kept.items() if name == "frames"]
    assert len(pages) == 32 and max(map(len, pages)) < 3 * events.PAGE and sum(map(len, pages)) == 900
    # streams that are over take nothing more
    assert pushed(frames, rows[:500]) == []


def test_quiet_streams_of_a_group_end_one_by_one():
    from test_sources_streaming import frame

    cells, frames = Cells(), events.Frames(1000)
    frames.init(cells)
    ended = lambda at: [tuple(r) for df in frames.handleExpiredTimer((0,), Now(at), Now(at)) for r in df.itertuples(index=False)]
    a, b = frame("A").rstrip("\n"), frame("B").rstrip("\n")
    assert pushed(frames, [("a", 0, a[:9]), ("b", 1, b[9:]), ("b", 0, b[:9]), ("c", 0, a + "\n\n"), ("c", 1, None), ("d", 2, b)]) == [("c", 0, 0, "A")]
    assert pushed(frames, [("a", 1, a[9:]), ("c", 2, a)], 500) == [] and cells.timers == {1000, 1500}
    assert sorted(ended(1000)) == [("b", 0, 0, "B"), ("d", 0, 0, "B")]
    assert pushed(frames, [("b", 2, "\n\n" + b)], 1200) == [] and cells.timers == {1000, 1500}
    assert ended(1500) == [("a", 0, 0, "A")] and not any(name == "due" for name, _ in cells.kept)


def test_state_holds_fewer_entries_than_streams(spark):
    from test_sources_streaming import PIECES, frame

    folder = tempfile.mkdtemp(prefix="leafmark-test-")
    rows = [(f"s{n}", i, p) for n in range(3000) for i, p in enumerate([frame(f"{n}")[:20], frame(f"{n}")[20:], None])]
    random.Random(3).shuffle(rows)
    for n in range(2):
        spark.createDataFrame(rows[n::2], PIECES).coalesce(1).write.mode("append").json(f"{folder}/in", ignoreNullFields=False)
    query = imports.follow_answers(spark, f"{folder}/in", f"{folder}/out", f"{folder}/ck", files_per_batch=1)
    query.awaitTermination(200)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
    assert sorted(spark.read.parquet(f"{folder}/out").toPandas()["delta"]) == sorted(map(str, range(3000)))
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) < 3000


def test_a_feed_is_written_by_all_cores(spark, sf_dir, monkeypatch):
    feeds, follow = [], imports.follow_answers
    monkeypatch.setattr(imports, "follow_answers", lambda spark, folder, *a, **k: feeds.append((folder, k["files_per_batch"])) or follow(spark, folder, *a, **k))
    assert QUERIES["sse_stream"](spark, sf_dir).count() == QUERIES["sse_parse"](spark, sf_dir).count()
    (folder, each), = feeds
    files = len(spark.read.schema("piece string").json(folder).inputFiles())
    assert files >= spark.sparkContext.defaultParallelism and -(-files // each) == 4
