"""Some named queries against their SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from leafmark.plans.catalog import QUERIES
from oracle.sql import ORACLES

TABLES = "documents embeddings pages benchmark labels conversations lineitem".split()
NAMES = ["library_list", "doc_dedup", "toc_parents", "toc_sections", "search_terms_cjk", "bm25_phrase", "retrieve_citations_cjk", "page_match_top8", "vector_topk", "sse_parse"]
NAMES += ["sse_stream", "chat_event_stream", "workbook_formats", "import_stages", "embedding_progress", "section_match", "bm25_topk"]


def rows(columns, data):
    def plain(v):
        return f"{v:.6f}" if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert rows(sorted(names), [r.asDict() for r in df.collect()]) == rows(sorted(names), want)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()
