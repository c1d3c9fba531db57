"""Headline timings; prints one JSON line.

``index_build`` covers deduplication, outline context, chunking, tokenising and the inverted index; the
queries after it run on the stored index, as they would in use.
"""

from __future__ import annotations

import json
import os
import time

from leafmark.plans import catalog, corpus
from leafmark.session import get_session

HEADLINE = [
    "chunk_pages",
    "search_terms",
    "bm25_topk",
    "lexical_blend",
    "vector_topk",
    "retrieve_citations",
    "page_match_top8",
    "toc_sections",
    "section_match",
    "doc_dedup",
    "coverage_report",
    "conversation_list",
    "sse_parse",
    "pdf_lines",
]
#: run a second time, code compiled and tables read
WARM = ["bm25_topk", "lexical_blend", "vector_topk", "retrieve_citations", "page_match_top8", "section_match"]
#: beside the headline: with vectors, and with identifiers and CJK (which builds an index of its own)
MORE = ["retrieve_hybrid", "retrieve_citations_cjk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, go) -> None:
        start = time.perf_counter()
        go()
        seconds[name] = round(time.perf_counter() - start, 3)

    def run(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timed("index_build", lambda: corpus.index_of(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: run(name))
    cold, seconds = seconds, {}
    for name in [*WARM, *MORE]:  # the first run of MORE is cold, its second one isn't measured
        timed(name, lambda: run(name))
    warm, seconds = seconds, cold
    chunks = corpus.index_of(spark, sf_dir).total
    print(
        json.dumps(
            {
                "metric": "leafmark_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "warm": {n: warm[n] for n in WARM},
                "more": {n: warm[n] for n in MORE},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "chunks": chunks,
                "index_chunks_per_sec": round(chunks / seconds["index_build"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
