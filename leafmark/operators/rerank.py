"""Rule scores, filters and the diverse final selection, over hits joined with their analysed query.

Every window here is partitioned by query and sees at most the hits of its ranked lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X
from leafmark.operators.outline import section_boost

C = F.col


def with_haystacks(hits: DataFrame) -> DataFrame:
    """Upper-cased fields the rules look at; a missing heading counts as empty."""
    upper = hits.select(
        "*",
        F.upper("document_title").alias("u_title"),
        F.upper(F.coalesce("heading", F.lit(""))).alias("u_heading"),
        F.upper("text").alias("u_text"),
        X.compact(C("normalized")).alias("asked"),
        F.array_except("identifiers", "chip_models").alias("specific"),
        (F.regexp_count("text", F.lit(R.DOT_LEADER)) >= 3).alias("dotted"),
    )
    return upper.select(
        "*",
        F.concat_ws("\n", "u_heading", "u_text").alias("u_body"),
        F.concat_ws("\n", "u_title", "u_heading", "u_text").alias("u_all"),
        X.compact(C("u_text")).alias("u_compact"),
        (C("u_heading").rlike(R.NAVIGATION) | C("dotted")).alias("navigation"),
    )


def _any(column: str, pattern: str) -> str:
    return f"{column} rlike r'{pattern}'"


def structural_boost() -> Column:
    return F.expr(
        """
        0.035D * size(filter(identifiers, v -> contains(u_all, v)))
        + 0.02D * size(filter(peripherals, v -> contains(u_all, v)))
        + 0.02D * size(filter(chip_models, v -> contains(u_all, v)))
        + if(heading is not null and exists(identifiers, v -> contains(heading, v)), 0.04D, 0D)
        """
    )


def aspect_boost() -> Column:
    return F.expr(
        """
        aggregate(aspects, 0D, (acc, a) -> acc
            + least(0.45D, 0.32D * size(filter(a.keywords, k -> contains(u_heading, upper(k)))))
            + least(0.24D, 0.06D * size(filter(a.keywords, k -> contains(u_body, upper(k))))))
        """
    )


def hit_score() -> Column:
    """What the wording of the hit adds for this query."""
    inventory = X.string_array(R.INVENTORY)
    return F.expr(
        f"""
        aggregate(specific, 0D, (acc, v) -> acc
            + case when contains(u_heading, v) then 0.65D when contains(u_text, v) then 0.45D else 0D end)
        + aggregate(filter(keywords, k -> length(k) >= 2), 0D, (acc, k) -> acc
            + case when contains(u_heading, upper(k)) then 0.45D
                   when length(k) >= 4 and contains(u_text, upper(k)) then 0.12D else 0D end)
        + if(size(filter(specific, v -> contains(u_text, v))) >= 2, 0.55D, 0D)
        + 0.08D * size(filter(peripherals, v -> contains(u_text, v) or contains(u_heading, v)))
        + 0.04D * size(filter(chip_models, v -> contains(u_text, v) or contains(u_title, v)))
        + if({_any("u_title", R.TITLE_REFERENCE)}
             and (intent in ('configure', 'register') or size(peripherals) > 0), 0.28D, 0D)
        + if({_any("u_title", R.TITLE_PINS)}
             and (intent = 'pin' or exists(specific, v -> v rlike '^P[A-G][0-9]')), 0.2D, 0D)
        + if({_any("u_title", R.TITLE_FIRMWARE)} and {_any("question", R.FIRMWARE_WORDS)}, 0.12D, 0D)
        + if({_any("u_title", R.TITLE_DATASHEET)} and {_any("question", R.QUANTITY)}
             and {_any("question", R.INVENTORY_WORDS)},
             least(0.9D, 0.35D * size(filter({inventory}, p -> contains(u_body, p)))), 0D)
        + if(length(asked) >= 4 and contains(u_compact, asked), 0.35D, 0D)
        + if({_any("u_heading", R.NAVIGATION)}, -0.45D, 0D)
        + if(dotted, -0.8D, 0D)
        """
    )


def pool(hits: DataFrame) -> DataFrame:
    """Drop navigation pages if at least three others remain; then keep only hits that name one of
    the identifiers, if any does."""
    w = W.partitionBy("query_id")
    kept = (
        hits.withColumn("_others", F.count_if(~C("navigation")).over(w))
        .where((C("_others") < 3) | ~C("navigation"))
        .withColumn("exact", F.exists("specific", lambda v: F.contains(C("u_all"), v)))
    )
    return kept.withColumn("_any_exact", F.max("exact").over(w)).where(
        C("exact") | ~C("_any_exact")
    ).drop("_others", "_any_exact")


def scored(hits: DataFrame) -> DataFrame:
    """``hits`` carries rrf and rank, chunk columns and query analysis."""
    rich = with_haystacks(hits)
    first = (
        C("rrf")
        + structural_boost()
        + aspect_boost()
        + section_boost(C("sections"), C("page_number"), C("keywords"))
    )
    ranked = pool(rich).withColumn("score", F.round(first + hit_score() + 1 / (20 + C("rank")), 9))
    return ranked.select(
        "*",
        F.expr("transform(aspects, a -> exists(a.keywords, k -> contains(u_heading, upper(k))))").alias("aspect_heading"),
        F.expr("transform(aspects, a -> exists(a.keywords, k -> contains(u_body, upper(k))))").alias("aspect_any"),
        F.exists("aspects", lambda a: a["id"] == R.TIMER_INVENTORY).alias("inventory"),
    )


def select_diverse(
    hits: DataFrame,
    max_aspects: int,
    limit: int | None = R.FINAL_LIMIT,
    per_document: int | None = R.PER_DOCUMENT,
    floor: float | None = R.SCORE_FLOOR,
    inventory_limit: int | None = R.INVENTORY_LIMIT,
) -> DataFrame:
    """One hit per aspect, then the best hits: one per page, ``per_document`` of a document, ``limit`` in
    all, or ``inventory_limit`` for a question about the inventory of timers. Where the best score is above
    1.6, hits below ``floor`` times that are left out. ``None`` switches a cut off.

    ``hits`` has (query_id, chunk_id, document_id, page_number, score, rank, aspect_heading,
    aspect_any, inventory). ``max_aspects`` is the largest number of aspects of any query (five by
    the rules); each adds one windowed pick over rows that are already partitioned by query.
    """
    everything = 2**31 - 1
    allowed = F.lit(everything if limit is None else limit)
    if inventory_limit is not None:
        allowed = F.when(C("inventory"), F.least(allowed, F.lit(inventory_limit))).otherwise(allowed)
    least = F.lit(0.0) if floor is None else F.when(C("_top") > 1.6, C("_top") * floor).otherwise(F.lit(0.0))
    in_document = everything if per_document is None else per_document
    w = W.partitionBy("query_id")
    order = [F.desc("score"), "rank", "chunk_id"]
    page = W.partitionBy("query_id", "document_id", "page_number")
    rows = hits.withColumn("_top", F.max("score").over(w)).withColumn("_taken", F.lit(False)).withColumn(
        "_seen", F.lit(False)
    )
    for n in range(max_aspects):
        open_ = ~C("_seen") & F.coalesce(F.get("aspect_any", F.lit(n)), F.lit(False))
        best = F.row_number().over(
            w.orderBy(F.desc(open_), F.desc(F.get("aspect_heading", F.lit(n))), *order)
        )
        rows = (
            rows.withColumn("_pick", open_ & (best == 1) & (C("score") >= C("_top") * 0.15))
            .withColumn("_taken", C("_taken") | C("_pick"))
            .withColumn("_seen", C("_seen") | F.max("_pick").over(page))
        )
    rows = (
        rows.withColumn("_aspects", F.count_if("_taken").over(w))
        .withColumn("_doc_aspects", F.count_if("_taken").over(W.partitionBy("query_id", "document_id")))
        .withColumn(
            "_free",
            ~C("_seen") & ((C("score") >= least) if floor is not None else F.lit(True)),
        )
        .where(C("_taken") | C("_free"))
        .withColumn("_in_page", F.row_number().over(page.orderBy(F.desc("_taken"), *order)))
        .where(C("_taken") | (C("_in_page") == 1))
        .withColumn(
            "_in_doc",
            F.row_number().over(
                W.partitionBy("query_id", "document_id", "_taken").orderBy(*order)
            ),
        )
        .where(C("_taken") | (C("_in_doc") + C("_doc_aspects") <= in_document))
        .withColumn("_place", F.row_number().over(W.partitionBy("query_id", "_taken").orderBy(*order)))
        .where(C("_taken") | (C("_place") + C("_aspects") <= allowed))
        .withColumn("source_no", F.row_number().over(w.orderBy(*order)))
        .where(C("source_no") <= (everything if limit is None else limit))
    )
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])
