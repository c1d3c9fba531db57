"""BM25 search for a whole table of queries at once.

Queries whose selected terms are equal share one candidate list, whichever question or variant they
come from: the unit of index work is the term set, not the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.operators.blockmax import PAIRS, best_chunks, best_of_chunks
from leafmark.operators.indexing import SearchIndex
from leafmark.operators.joins import fits, sized_join
from leafmark.operators.products import blocks_of, chunk_counts, hit_arrays
from leafmark.session import fan_out, write_table


#: documents of a scope that go into the plan as literals
SCOPE_LITERALS = 100


def in_scope(df: DataFrame, scope: list[str] | None) -> DataFrame:
    """No or an empty list of documents means no filter. A long list becomes a semi-join."""
    if not scope:
        return df
    if len(scope) <= SCOPE_LITERALS:
        return df.where(F.col("document_id").isin(scope))
    listed = df.sparkSession.createDataFrame([(d,) for d in dict.fromkeys(scope)], df.select("document_id").schema)
    return df.join(listed, "document_id", "left_semi")


def with_scope(df: DataFrame, scope: list[str] | None) -> DataFrame:
    """Adds ``within``: whether a row's document is in the scope."""
    if not scope:
        return df.withColumn("within", F.lit(True))
    if len(scope) <= SCOPE_LITERALS:
        return df.withColumn("within", F.coalesce(F.col("document_id").isin(scope), F.lit(False)))
    listed = in_scope(df.select("document_id").distinct(), scope).withColumn("within", F.lit(True))
    return df.join(listed, "document_id", "left").withColumn("within", F.coalesce("within", F.lit(False)))


def scoped_total(index: SearchIndex, scope: list[str] | None) -> int:
    return in_scope(index.chunks, scope).count() if scope else index.total


def term_occurrences(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """Adds ``(chunk_id, document_id, length, tf)`` to a stored table with a ``term`` column.

    A term the index splits (``USART1_TX``) is a phrase: its pieces must stand side by side, which their
    positions tell. They are looked up after the chunks that hold a piece asked for are found.
    """
    pieces = X.subtokens(F.col("term"))
    single = terms.where(F.size(pieces) == 1).withColumn("piece", pieces[0])
    found = index.found_in(single).select(*terms.columns, "chunk_id", "document_id", "length", "tf")

    phrases = terms.where(F.size(pieces) > 1)
    if phrases.isEmpty():
        return found
    listed = phrases.select("term").distinct()
    wanted = listed.select("term", F.size(pieces).alias("width"), F.posexplode(pieces).alias("k", "piece"))
    met = (
        index.found_in(wanted, positions=True)
        .groupBy("term", "chunk_id")
        .agg(
            F.first("document_id").alias("document_id"),
            F.first("length").alias("length"),
            F.first("width").alias("width"),
            # where the phrase would have to start for each piece to stand where it does
            F.collect_list(F.transform("positions", lambda p: p - F.col("k"))).alias("starts"),
        )
        .where(F.size("starts") == F.col("width"))
    )
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    side_by_side = met.select("term", "chunk_id", "document_id", "length", F.size(common).alias("tf")).where(F.col("tf") > 0)
    return found.unionByName(sized_join(side_by_side, phrases, ["term"]).select(*found.columns))


def document_frequency(index: SearchIndex, terms: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(term, df_all, df)``: chunks with the term in the library and in the scope, for stored ``terms(term)``. They
    travel to the chunks unless they are too many."""
    if fits(terms):
        parts = {t: tuple(p) for t, p in terms.select("term", X.subtokens(F.col("term"))).collect()}
        return chunk_counts(with_scope(index.chunks, scope), parts)
    plain = terms.where(F.size(X.subtokens(F.col("term"))) == 1)
    complex_ = terms.where(F.size(X.subtokens(F.col("term"))) > 1)
    if scope:
        found = term_occurrences(index, terms)
        within = in_scope(found.select("document_id").distinct(), scope).withColumn("within", F.lit(True))
        return (
            found.join(within, "document_id", "left")
            .groupBy("term")
            .agg(F.count(F.lit(1)).alias("df_all"), F.count("within").alias("df"))
        )
    pieces = plain.select("term", X.subtokens(F.col("term"))[0].alias("piece"))
    known = index.frequency_of(pieces.select(F.col("piece").alias("term"))).withColumnRenamed("term", "piece")
    counts = known.join(pieces, "piece").select("term", F.col("df").alias("df_all"), "df")
    if complex_.isEmpty():
        return counts
    stored = write_table(complex_, "phrase_terms")
    return counts.unionByName(
        term_occurrences(index, stored)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df_all"), F.count(F.lit(1)).alias("df"))
    )


def idf(total: int, df: Column) -> Column:
    value = F.log((F.lit(float(total)) - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(R.BM25_IDF_FLOOR))


def select_terms(
    looked_up: DataFrame,
    frequency: DataFrame,
    total: int,
    keys: list[str],
    limit: int | None = R.TERM_LIMIT,
    rare_share: float | None = R.RARE_SHARE,
) -> DataFrame:
    """Rare terms of each query: in at most ``max(3, rare_share)`` of the chunks, or all known terms if
    none is that rare; the ``limit`` rarest, ties in query order. ``looked_up`` has ``(*keys, pos, term)``.
    ``None`` for either switches it off: every known term is used."""
    w = W.partitionBy(*keys)
    known = looked_up.join(frequency.where(F.col("df") > 0), "term")
    if rare_share is not None:
        cap = max(3, math.floor(total * rare_share + 1e-9))
        known = (
            known.withColumn("rare", F.col("df") <= cap)
            .withColumn("any_rare", F.max("rare").over(w))
            .where(F.col("rare") | ~F.col("any_rare"))
            .drop("rare", "any_rare")
        )
    placed = known.withColumn("place", F.row_number().over(w.orderBy("df", "pos")))
    return placed if limit is None else placed.where(F.col("place") <= limit)


@dataclass(frozen=True)
class LexicalHits:
    """``lists``: (query_id, set_id, weight, chunk_id, score, rank), the ranked list of each term set;
    ``chunks``: the chunk rows these lists refer to. Without a limit, ``hits`` has what the lists are made of, not
    ranked: (query_id, set_id, chunk_id, text, bm25, covered, first), ``first`` once for a question's chunk."""

    lists: DataFrame
    chunks: DataFrame
    hits: DataFrame | None = None


def bm25_candidates(
    index: SearchIndex, set_terms: DataFrame, scope: list[str] | None, depth: int | None
) -> DataFrame:
    """Best ``depth`` chunks of each term set ``(set_id, term, idf)``, or all with any of its terms.

    With a ``depth``, each shard passes on its best chunks of every set (see ``blockmax``); the product of sets and
    chunks is never shuffled, and postings only if the sets are too many to travel to the chunks.
    """
    if depth is not None:
        best = block_max(index, set_terms, scope, depth).where(F.col("chunk_id").isNotNull())
        scored = best.select("set_id", "chunk_id", F.round("bm25", 9).alias("bm25"))
        w = W.partitionBy("set_id").orderBy(F.desc("bm25"), "chunk_id")
        return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= depth)
    occ = in_scope(term_occurrences(index, set_terms), scope)
    norm = R.BM25_K1 * (1 - R.BM25_B + R.BM25_B * F.col("length") / F.lit(index.avg_length))
    part = F.col("idf") * F.col("tf") * (R.BM25_K1 + 1) / (F.col("tf") + norm)
    scored = (
        occ.groupBy("set_id", "chunk_id")
        .agg(F.round(F.sum(part), 9).alias("bm25"))
    )
    w = W.partitionBy("set_id").orderBy(F.desc("bm25"), "chunk_id")
    return scored.withColumn("place", F.row_number().over(w))


def block_max(index: SearchIndex, set_terms: DataFrame, scope: list[str] | None, depth: int) -> DataFrame:
    """Best chunks of each shard with the postings read; ``blockmax.FOUND``."""
    if set_terms.count() <= PAIRS:
        return best_of_chunks(in_scope(index.chunks, scope), set_terms, depth, R.BM25_K1, R.BM25_B, index.avg_length)
    asked = write_table(set_terms.select("term").distinct(), "asked_terms")
    occurring = write_table(in_scope(term_occurrences(index, asked), scope), "asked_postings")
    return best_chunks(occurring, set_terms, depth, index.total, R.BM25_K1, R.BM25_B, index.avg_length)


def term_sets(
    index: SearchIndex,
    looked_up: DataFrame,
    scope: list[str] | None,
    term_limit: int | None = R.TERM_LIMIT,
    rare_share: float | None = R.RARE_SHARE,
) -> DataFrame:
    """``(query_id, variant_no, weight, set_key, terms, idfs)`` from ``(query_id, variant_no, weight,
    terms)``; ``terms`` are the selected ones in sorted order."""
    exploded = looked_up.select("query_id", "variant_no", "weight", F.posexplode("terms").alias("pos", "term"))
    distinct = write_table(exploded.select("term").distinct(), "query_terms")
    frequency = document_frequency(index, distinct, scope)
    chosen = select_terms(
        exploded, frequency, scoped_total(index, scope), ["query_id", "variant_no", "weight"], term_limit, rare_share
    )
    return (
        chosen.withColumn("idf", idf(index.total, F.col("df_all")))
        .groupBy("query_id", "variant_no", "weight")
        .agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("picked"))
        .select(
            "query_id",
            "variant_no",
            "weight",
            F.sha2(F.array_join("picked.term", " "), 256).alias("set_key"),
            "picked",
        )
    )


def numbered_sets(sets: DataFrame) -> DataFrame:
    """Stored ``(set_id, set_key, picked)``: the distinct term sets with a short number for the joins."""
    distinct = sets.groupBy("set_key").agg(F.first("picked").alias("picked"))
    return write_table(distinct.withColumn("set_id", F.monotonically_increasing_id()), "numbered_sets")


def set_term_rows(per_set: DataFrame) -> DataFrame:
    return write_table(per_set.select("set_id", F.inline("picked")), "set_terms")


def phrase_ratio(text: Column, keywords: Column) -> Column:
    kept = F.filter(keywords, lambda k: F.length(k) >= 2)
    body = F.upper(X.compact(text))
    hits = X.let(body, lambda b: F.size(F.filter(kept, lambda k: F.contains(b, k))))
    return F.when(F.size(kept) > 0, hits / F.size(kept)).otherwise(F.lit(0.0))


def section_ratio(text: Column, keywords: Column) -> Column:
    """Share of keywords that follow a section number in the raw text. The pattern is only built for
    keywords the text contains."""
    kept = F.filter(keywords, lambda k: F.length(k) >= 2)
    hits = F.size(
        F.filter(
            kept,
            lambda k: F.contains(text, k) & F.rlike(text, F.concat(F.lit(rf"[0-9]{R.WS}*"), k)),
        )
    )
    return F.when(F.size(kept) > 0, hits / F.size(kept)).otherwise(F.lit(0.0))


def every_hit(index: SearchIndex, wanted: DataFrame, scope: list[str] | None) -> DataFrame:
    """``LexicalHits.hits`` for stored ``wanted(query_id, set_id, picked)``: every chunk with a term of a set. The
    product of sets and chunks is made and read inside a task, never shuffled or stored."""
    spark, kinds, found = wanted.sparkSession, {f.name: f.dataType.simpleString() for f in wanted.schema.fields}, None
    rows = wanted.select("query_id", "set_id", "picked.term", F.transform("picked.term", X.subtokens), "picked.idf")
    for block in blocks_of(rows, "query_id"):
        block.sort(key=lambda r: (r[0], r[1]))
        numbers = spark.createDataFrame([(n, r[0], r[1]) for n, r in enumerate(block)], f"list_no int, query_id {kinds['query_id']}, set_id long")
        lists = [(n, *r[:1], *r[2:]) for n, r in enumerate(block)]
        arrays = hit_arrays(in_scope(index.chunks, scope), lists, R.BM25_K1, R.BM25_B, index.avg_length)
        part = arrays.select("chunk_id", "text", F.inline("hits")).join(F.broadcast(numbers), "list_no").drop("list_no")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"chunk_id string, text string, bm25 double, covered int, first boolean, query_id {kinds['query_id']}, set_id long")
    return found.withColumn("bm25", F.round("bm25", 9))


def _every_list(index, sets, per_set, keywords, scope) -> LexicalHits:
    info = sets.groupBy("query_id", "set_key").agg(F.sum("weight").alias("weight"), F.min("variant_no").alias("variant_no"))
    wanted = write_table(info.join(per_set, "set_key").drop("set_key"), "wanted_sets")
    hits = every_hit(index, wanted, scope)
    best = hits.groupBy("set_id").agg(F.max("bm25").alias("best"))
    about = wanted.select("query_id", "set_id", "weight", "variant_no", F.size("picked").alias("chosen"))
    rows = hits.join(F.broadcast(about), ["query_id", "set_id"]).join(F.broadcast(best), "set_id").join(keywords, "query_id")
    score = (
        0.35 * F.col("bm25") / F.greatest("best", F.lit(R.EPSILON))
        + 0.25 * F.col("covered") / F.col("chosen")
        + 0.2 * phrase_ratio(F.col("text"), F.col("keywords"))
        + 0.2 * section_ratio(F.col("text"), F.col("keywords"))
    )
    scored = rows.select("query_id", "set_id", "variant_no", "weight", "chunk_id", "bm25", F.round(score, 9).alias("score"))
    w = W.partitionBy("query_id", "set_id").orderBy(F.desc("score"), F.desc("bm25"), "chunk_id")
    lists = scored.withColumn("rank", F.row_number().over(w)).select("query_id", "set_id", "variant_no", "weight", "chunk_id", "score", "rank")
    return LexicalHits(lists, in_scope(index.chunks, scope).drop("subs", "length"), hits)


def search(
    index: SearchIndex,
    looked_up: DataFrame,
    keywords: DataFrame,
    limit: int | None = R.LEXICAL_LIMIT,
    scope: list[str] | None = None,
    term_limit: int | None = R.TERM_LIMIT,
    rare_share: float | None = R.RARE_SHARE,
) -> LexicalHits:
    """Ranked lists for every variant in ``looked_up``; ``keywords`` is ``(query_id, keywords)``.

    Score = 0.35 BM25 (relative to the best candidate) + 0.25 term coverage + 0.2 keyword phrases
    + 0.2 numbered section titles. Variants of one question with the same term set are one list with
    the sum of their weights. Without a ``limit`` a list holds every chunk with one of its terms; for
    ``term_limit`` and ``rare_share`` see ``select_terms``.
    """
    sets = write_table(term_sets(index, looked_up, scope, term_limit, rare_share), "term_sets")
    depth = None if limit is None else max(limit * 4, 120)
    per_set = numbered_sets(sets)
    if depth is None:
        return _every_list(index, sets, per_set, keywords, scope)
    candidates = write_table(
        bm25_candidates(index, set_term_rows(per_set), scope, depth), "candidates"
    )
    chunks = write_table(
        sized_join(index.chunks, candidates.select("chunk_id").distinct(), ["chunk_id"], "left_semi")
        .drop("subs", "length"),
        "hit_chunks",
    )
    wanted = (
        sets.groupBy("query_id", "set_key")
        .agg(F.sum("weight").alias("weight"), F.min("variant_no").alias("variant_no"))
        .join(per_set.select("set_key", "set_id"), "set_key")
        .drop("set_key")
    )

    best = candidates.groupBy("set_id").agg(F.max("bm25").alias("best"))
    covered = (
        fan_out(candidates, "chunk_id")
        .join(chunks.select("chunk_id", "tokens"), "chunk_id")
        .join(per_set.select("set_id", F.col("picked.term").alias("chosen")), "set_id")
        .join(best, "set_id")
        .select(
            "set_id",
            "chunk_id",
            "place",
            "bm25",
            (F.size(F.array_intersect("chosen", "tokens")) / F.size("chosen")).alias("coverage"),
            "best",
        )
    )
    per_list = wanted.join(covered, "set_id")
    pairs = wanted.select("query_id", "set_id").join(candidates.select("set_id", "chunk_id"), "set_id")
    worded = (
        fan_out(pairs.select("query_id", "chunk_id").distinct(), "query_id", "chunk_id")
        .join(keywords, "query_id")
        .join(chunks.select("chunk_id", "text"), "chunk_id")
        .select(
            "query_id",
            "chunk_id",
            phrase_ratio(F.col("text"), F.col("keywords")).alias("phrase"),
            section_ratio(F.col("text"), F.col("keywords")).alias("section"),
        )
    )
    score = (
        0.35 * F.col("bm25") / F.greatest("best", F.lit(R.EPSILON))
        + 0.25 * F.col("coverage")
        + 0.2 * F.col("phrase")
        + 0.2 * F.col("section")
    )
    w = W.partitionBy("query_id", "set_id").orderBy(F.desc("score"), "place")
    lists = (
        per_list.join(worded, ["query_id", "chunk_id"])
        .withColumn("score", F.round(score, 9))
        .withColumn("rank", F.row_number().over(w))
        .where(F.lit(True) if limit is None else F.col("rank") <= limit)
        .select("query_id", "set_id", "variant_no", "weight", "chunk_id", "score", "rank")
    )
    return LexicalHits(lists, chunks)
