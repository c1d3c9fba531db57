"""Document fingerprints from closed syncmers, DataFrame functions only.

A k-mer of ``K`` code points is an anchor if, of the hashes of its ``K - S + 1`` inner substrings of ``S`` code points,
the first or the last is below all others. Whether it is depends on its own ``K`` code points alone, so that an edit
changes only the anchors it touches, and the anchors of a text put together from parts are those of the parts beside
those of the seams: the edited text is fingerprinted this way, without being scanned. About two k-mers in
``K - S + 1`` are anchors.

A fingerprint lists the anchors in order, each as its position (code points) and 32 bits of its hash, in hexadecimal
digits. Likeness compares positions: an anchor agrees if the anchor after it and the distance between the two agree
as well; the likeness of two fingerprints is twice the number of agreeing anchors by the number of both, repeats
counting once. A text without an anchor (shorter than ``K``, or of one repeated character) has its own hash in place
of one.

Work goes by blocks of ``BLOCK`` code points, so that a very long text needs no long arrays of hashes.

Defined results: null texts are empty; rows without an id stand last; rows of equal id stand by the hash of their text;
repeated rows follow each other; a single document is its own next one; an empty table gives an empty result. Columns
of the input beside id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmark.llm.order import following

#: inner substrings are S code points long, a k-mer holds 2**STEPS + 1 of them
S, STEPS = 8, 5
INNER = (1 << STEPS) + 1
K = S + INNER - 1
BLOCK = 4096
#: documents whose order is settled in one window, and parts of the range of ids whose spread is measured
ROWS, KNOTS = 256, 64
#: rows without an id are dealt to so many windows
NULL_BITS = 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _least(hashes: Column, body: Callable[[Column], Column], step: int = 0) -> Column:
    """``body`` of the least of the ``2**STEPS`` hashes from each place on, by doubling."""
    if step == STEPS:
        return body(hashes)
    shifted = F.slice(hashes, (1 << step) + 1, F.greatest(F.size(hashes) - (1 << step), F.lit(0)))
    return _let(F.zip_with(hashes, shifted, lambda a, b: F.least(a, b)), lambda m: _least(m, body, step + 1))


def _code_points(wide: Column) -> Column:
    return F.shiftright(F.length(wide), 2)


def _part(wide: Column, start: Column, size: Column | int) -> Column:
    """``size`` code points from ``start`` (from 0) of a text in four bytes a code point."""
    return F.substring(wide, start * 4 + 1, (F.lit(size) if isinstance(size, int) else size) * 4)


def _block(part: Column, start: Column) -> Column:
    """Anchors of one block of at least ``K`` code points, as position << 32 | hash."""
    inner = F.transform(F.sequence(F.lit(0), _code_points(part) - S), lambda i: F.xxhash64(_part(part, i, S)))

    def closed(h: Column, least: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - INNER)
        return F.filter(places, lambda i: (F.get(h, i) < F.get(least, i + 1)) | (F.get(h, i + (INNER - 1)) < F.get(least, i)))

    found = _let(inner, lambda h: _least(h, lambda least: closed(h, least)))
    return F.transform(found, lambda i: _packed((start + i).cast("long"), F.xxhash64(_part(part, i, K))))


def _packed(position: Column, code: Column) -> Column:
    return F.shiftleft(position, 32).bitwiseOR(code.bitwiseAND(F.lit(0xFFFFFFFF)))


def anchors(wide: Column, start: Column | int = 0) -> Column:
    """Anchors of a text in UTF-32, positions counted from ``start``; an empty array if there are none."""
    start = F.lit(start) if isinstance(start, int) else start
    blocks = F.sequence(F.lit(0), F.floor((_code_points(wide) - K) / BLOCK).cast("int"))
    each = F.transform(blocks, lambda j: _let(_part(wide, j * BLOCK, BLOCK + K - 1), lambda p: _block(p, start + j * BLOCK)))
    return F.when(_code_points(wide) >= K, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def whole(found: Column, text: Column) -> Column:
    """The anchors, or one for the whole text where there are none."""
    return F.when(F.size(found) > 0, found).otherwise(F.array(_packed(F.lit(0).cast("long"), F.xxhash64(text))))


def fingerprint(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda a: F.lower(F.hex(a))), " ")


def features(marks: Column) -> Column:
    """One number for each anchor: its hash, the hash of the anchor after it, and the distance."""

    def linked(a: Column, i: Column) -> Column:
        after, low = F.get(marks, i + 1), F.lit(0xFFFFFFFF)
        return F.xxhash64(a.bitwiseAND(low), after.bitwiseAND(low), F.shiftright(after, 32) - F.shiftright(a, 32))

    return F.array_distinct(F.transform(marks, linked))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of features, 0 to 1."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def _spans(rows: DataFrame) -> Column:
    """Number of the window in which a row's order is settled; windows stand by descending id, rows without id last.

    The windows follow the spread of the ids as ``KNOTS`` approximate quantiles tell it, evenly between two of them.
    """
    low, high, count, marks = rows.agg(
        F.min("id"), F.max("id"), F.count("id"), F.percentile_approx("id", [i / KNOTS for i in range(1, KNOTS)])
    ).first()
    each = max(1, -(-count // (KNOTS * ROWS)))
    nulls = F.lit(1).cast("long") + F.shiftrightunsigned("k1", 64 - NULL_BITS)
    if low is None:
        return nulls
    knots = sorted({low, *marks, high})
    widths = [max(1.0, (float(b) - float(a)) / each) for a, b in zip(knots, [*knots[1:], knots[-1] + 1], strict=True)]
    ids = F.col("id").cast("double")
    at = F.size(F.filter(F.array(*[F.lit(k) for k in knots]), lambda x: x <= F.col("id"))) - 1
    lows, wides = F.array(*[F.lit(float(k)) for k in knots]), F.array(*[F.lit(w) for w in widths])
    cell = F.least(F.floor((ids - F.get(lows, at)) / F.get(wides, at)), F.lit(each - 1))
    return F.coalesce(-(at * each + cell), nulls)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, marks, next_text, next_marks)``: each document with the next one by descending id, the last with
    the first. ``marks`` are the anchors of the text.

    Every text is shuffled once, to the window of its id. The first document of each window is the next one of the
    last of the window before: these few travel in a second, small shuffle.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    keyed = rows.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text")
    span = _spans(keyed.drop("text"))
    heads = keyed.select(span.alias("span"), F.struct(F.coalesce("id", F.lit(0)).alias("i"), "k1", "k2").alias("key"))
    heads = following(heads.groupBy("span").agg(F.max("key").alias("key")), [], "span", "ahead")
    first = heads.agg(F.min("span")).first()[0]
    before = heads.select(F.coalesce("ahead", F.lit(first)).alias("home"), F.col("span").alias("guest_of"))
    asked = heads.select(F.col("span").alias("home"), "key").join(before, "home")
    laid = keyed.withColumn("span", F.coalesce(span, F.lit(0).cast("long"))).repartition("span")
    is_head = F.struct(F.coalesce("id", F.lit(0)).alias("i"), "k1", "k2") >= F.col("key")
    guests = laid.join(asked, (F.col("span") == F.col("home")) & is_head).groupBy("guest_of").agg(F.first("text").alias("guest_text"))
    guests = guests.select("guest_of", F.struct(F.col("guest_text").alias("text"), anchors(_wide("guest_text")).alias("marks")).alias("guest"))
    order = W.partitionBy("span").orderBy(F.desc_nulls_last("id"), F.desc("k1"), F.desc("k2"))
    inside = laid.withColumn("marks", anchors(_wide("text"))).withColumn("near", F.lead(F.struct("text", "marks")).over(order))
    both = inside.join(guests, F.col("span") == F.col("guest_of"), "left").withColumn("next", F.coalesce("near", "guest"))
    return both.select("id", "text", "marks", F.col("next.text").alias("next_text"), F.col("next.marks").alias("next_marks"))


def _wide(text: str) -> Column:
    """Four bytes a code point, so that a part is found without walking the text."""
    return F.encode(F.col(text), "UTF-32")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last third is taken from the next document."""
    pairs = neighbours(docs, id_col, text_col)
    n, q = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    cut = pairs.select("*", n.alias("n"), (n - q).alias("own"), F.least(q, F.char_length("next_text")).alias("taken"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("own")), F.substring("next_text", F.lit(1), F.col("taken")))
    cut = cut.withColumn("edited", edited)
    position = lambda a: F.shiftright(a, 32)
    seam = F.greatest(F.col("own") - (K - 1), F.lit(0))
    around = F.substring("edited", seam + 1, F.col("own") - seam + F.least(F.col("taken"), F.lit(K - 1)))
    kept = F.filter("marks", lambda a: position(a) + K <= F.col("own"))
    seam_marks = anchors(F.encode(around, "UTF-32"), seam)
    moved = F.transform(
        F.filter("next_marks", lambda a: position(a) + K <= F.col("taken")), lambda a: a + F.shiftleft(F.col("own").cast("long"), 32)
    )
    marked = cut.select(
        "id",
        "n",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        whole(F.col("marks"), F.col("text")).alias("marks"),
        whole(F.concat(kept, seam_marks, moved), F.col("edited")).alias("edited_marks"),
        whole(F.col("next_marks"), F.col("next_text")).alias("next_marks"),
    )
    linked = marked.select(
        "*", features(F.col("marks")).alias("f"), features(F.col("edited_marks")).alias("f_edited"), features(F.col("next_marks")).alias("f_next")
    )
    return linked.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("f_edited")).alias("near_edited"),
        likeness(F.col("f"), F.col("f_next")).alias("near_next"),
    )
