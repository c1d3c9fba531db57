"""Text expressions. All of them are Spark columns; none needs a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import rules as R


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (inside higher-order functions)."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(R.WS_CHARS))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{R.WS}+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, f"{R.WS}+", "")


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def join_present(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[non_empty(p) for p in parts])


def nfkc(text: Column) -> Column:
    """Unicode NFKC through the ICU library Spark ships; ASCII text is returned as it is."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) != F.length(text), composed).otherwise(text)


def fold(text: Column) -> Column:
    return F.upper(nfkc(text))


def search_terms(text: Column) -> Column:
    """Distinct terms in first-seen order: identifiers and words, then CJK bigrams.

    A word of one letter is dropped, a single digit is kept; a CJK run of one character stands for
    itself.
    """
    return folded_terms(fold(text))


def folded_terms(folded: Column) -> Column:
    """``search_terms`` of folded text; it is used several times, so let it be a column."""
    # folded text has no a to z, so \w is R.WORD, which is looked up at half the cost of a class of ranges
    words = F.regexp_extract_all(folded, F.lit(r"\w{2,}|[0-9]"), F.lit(0))
    pairs = F.regexp_extract_all(
        folded,
        F.lit(rf"(?=((?<!{R.CJK}){R.CJK}(?!{R.CJK})|{R.CJK}{{2}}))"),
        F.lit(1),
    )
    return F.array_distinct(F.when(folded.rlike(R.CJK), F.concat(words, pairs)).otherwise(words))


def subtokens(term: Column) -> Column:
    """The pieces under which the full-text index stores a search term."""
    return F.filter(F.split(term, R.SUBTOKEN_SPLIT), lambda x: x != "")


def strings(values: list[str]) -> Column:
    """A literal array, parsed in one go."""
    return F.expr(string_array(values))


def string_array(values: list[str]) -> str:
    quoted = ", ".join(f"r'{v}'" for v in values)
    return f"cast(array({quoted}) as array<string>)"


def blank_out(text: Column, words: list[str]) -> Column:
    """Replace the words by blanks, one after the other."""
    return F.aggregate(strings(words), text, lambda t, w: F.replace(t, w, F.lit(" ")))


def strip_stopwords(text: Column) -> Column:
    return squeeze(blank_out(text, R.STOPWORDS))


def query_keywords(question: Column) -> Column:
    text = blank_out(strip_stopwords(fold(question)), R.META_WORDS)
    per_clause = F.transform(
        F.split(text, R.CLAUSE),
        lambda s: F.concat(
            F.regexp_extract_all(s, F.lit(rf"{R.WORD}{{2,}}"), F.lit(0)),
            F.regexp_extract_all(s, F.lit(rf"{R.CJK}{{2,}}"), F.lit(0)),
        ),
    )
    return F.array_distinct(F.flatten(per_clause))


def bounded_matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` between ASCII word boundaries."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"), F.lit(0)
    )


def entity_tokens(text: Column) -> Column:
    return F.array_distinct(bounded_matches(fold(text), R.ENTITY))


def _holds_any(text: Column, marks: list[str]) -> Column:
    found = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(text, F.lit(mark))
    return found


def normalize_page_text(text: Column) -> Column:
    cleaned = text
    for pattern, new in [(r"\x00", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]:
        cleaned = F.regexp_replace(cleaned, pattern, new)
    # a text in which no pattern can begin to match is not walked by them
    marks = ["\x00", " \n", "\t\n", "\n\n\n", "  ", "\t\t", " \t", "\t "]
    return strip(F.when(_holds_any(text, marks), cleaned).otherwise(text))


def printed_page(text: Column, fallback: Column) -> Column:
    found = [
        (rf"页{R.WS}*([0-9]+){R.WS}*/{R.WS}*[0-9]+", ["页", "/"]),
        (rf"([0-9]+){R.WS}*/{R.WS}*[0-9]+", ["/"]),
        (rf"(?:第{R.WS}*)?([0-9]+){R.WS}*页", ["页"]),
    ]
    return F.coalesce(
        # a text without the pattern's fixed characters is not walked by it
        *[F.when(_holds_all(text, marks), non_empty(F.regexp_extract(text, p, 1))) for p, marks in found], fallback.cast("string")
    )


def _holds_all(text: Column, marks: list[str]) -> Column:
    found = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found & F.contains(text, F.lit(mark))
    return found


def _part(wide: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (from 0) of a text in four bytes a character: no walk from the front."""
    return F.decode(F.substring(wide, start * 4 + 1, size * 4), "UTF-32")


def chunk_texts(
    text: Column,
    max_chars: int = R.CHUNK_CHARS,
    overlap: int = R.CHUNK_OVERLAP,
    min_chars: int = R.CHUNK_MIN,
) -> Column:
    """Overlapping chunks of one normalised page, as an array of strings.

    A chunk ends after the last sentence mark (or blank before a CJK character) between ``min_chars`` and
    ``max_chars``, or at ``max_chars``; the next one starts ``overlap`` before it, at a character that is no blank.
    The fold's state is where the next chunk starts, and the bounds of those found. A step looks at ``max_chars``
    characters in place, so the work grows with the length of the page.
    """
    width = max_chars - min_chars + 1
    break_mark = rf"(?s)^.{{0,{max(width - 1, 0)}}}(?:[\n。！？；.!?;]| (?={R.CJK}))"
    # the bounds found so far are numbers, added outside of ``let``: what a fold or ``let`` returns is copied
    packed = lambda t: F.array(F.shiftleft(t["start"].cast("long"), 32).bitwiseOR(t["end"].cast("long")))

    def last_mark(wide: Column, start: Column) -> Column:
        if width <= 0:
            return F.lit(0)
        return F.length(F.regexp_extract(_part(wide, start + min_chars, F.lit(width + 1)), break_mark, 0))

    def cut(wide: Column, n: Column, start: Column) -> Column:
        mark = last_mark(wide, start)
        end = F.when(n - start <= max_chars, n).otherwise(
            let(mark, lambda m: F.when(m > 0, F.least(start + min_chars + m, n)).otherwise(start + max_chars))
        )
        after = lambda e: F.when(e >= n, n).otherwise(F.greatest(start + 1, e - overlap))
        return let(end, lambda e: F.struct(after(e).alias("at"), start.alias("start"), e.alias("end")))

    def step(wide: Column, n: Column, at: Column) -> Column:
        # blanks before a chunk: a run longer than the part looked at takes steps of its own; most chunks begin without
        blanks = lambda size: let(_part(wide, at, size), lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(R.WS_CHARS))))
        blank = F.when(at == 0, F.lit(0)).otherwise(let(blanks(F.lit(4)), lambda k: F.when(k < 4, k).otherwise(blanks(F.lit(max_chars)))))
        skipped = lambda k: F.struct((at + k).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        return let(blank, lambda k: F.when((k >= max_chars) | (at + k >= n), skipped(k)).otherwise(cut(wide, n, at + k)))

    def chunks(wide: Column) -> Column:
        n = F.shiftright(F.length(wide), 2)
        stride = max(1, min(min_chars + 1, max_chars) - overlap)
        steps = F.ceil(n / stride).cast("int") + F.ceil(n / max_chars).cast("int")
        nothing = F.struct(*[F.lit(0).alias(c) for c in ("at", "start", "end")])
        walked = F.aggregate(
            F.sequence(F.lit(0), steps),
            F.struct(nothing.alias("last"), F.array().cast("array<bigint>").alias("found")),
            lambda acc, _: F.when(acc["last"]["at"] >= n, acc).otherwise(
                F.struct(step(wide, n, acc["last"]["at"]).alias("last"), F.concat(acc["found"], packed(acc["last"])).alias("found"))
            ),
            lambda acc: F.concat(acc["found"], packed(acc["last"])),
        )
        start, end = lambda b: F.shiftright(b, 32).cast("int"), lambda b: b.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.transform(walked, lambda b: strip(_part(wide, start(b), end(b) - start(b))))

    return F.filter(let(F.encode(text, "UTF-32"), chunks), lambda p: p != "")


def excerpt(text: Column, limit: int = 420) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def ocr_text(text: Column) -> Column:
    joined = F.regexp_replace(nfkc(text), rf"(?<={R.CJK}){R.WS}+(?={R.CJK})", "")
    return F.upper(squeeze(F.regexp_replace(joined, R.OCR_PUNCTUATION, " ")))


def normalize_answer(answer: Column) -> Column:
    for pattern, new in [
        (r"\r\n?", "\n"),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""),
        (r"<｜[^｜>]+｜>", ""),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ]:
        answer = F.regexp_replace(answer, pattern, new)
    return strip(answer)


def conversation_title(question: Column) -> Column:
    return F.coalesce(non_empty(F.substring(squeeze(question), 1, 48)), F.lit(R.DEFAULT_TITLE))


def redact(message: Column, *secrets: Column) -> Column:
    for secret in secrets:
        message = F.when(
            secret.isNull() | (secret == ""), message
        ).otherwise(F.replace(message, secret, F.lit("[REDACTED]")))
    return message


def cited_labels(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def link_citations(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\[(S[0-9]+)\]", "[$1](#citation-$1)")


def excerpt_matches(left: Column, right: Column) -> Column:
    a, b = compact(left), compact(right)
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))


def endpoint(base: Column, path: str) -> Column:
    root = F.regexp_replace(strip(base), r"/+\z", "")
    tail = F.lit("/" + path)
    return F.when(F.endswith(root, tail), root).otherwise(F.concat(root, tail))


def title_from_filename(name: Column) -> Column:
    return F.coalesce(non_empty(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")), name)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]*)\z", 1))


def kind_from_extension(ext: Column) -> Column:
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".xlsx", ".xls"), "xlsx").otherwise("image")


def supported_models(message: Column) -> Column:
    listed = F.regexp_extract(
        message,
        r"(?i)supported API model names are\s+(.+?)(?:,\s*but you passed|\s+but you passed|\.)",
        1,
    )
    return F.array_distinct(
        F.filter(F.transform(F.split(listed, "[,，]"), strip), lambda m: m != "")
    )


def preferred_model(models: Column, purpose: str) -> Column:
    embedding = "(?i)embedding|embed"
    other = "(?i)embedding|embed|whisper|tts|image|moderation"
    wanted = (
        F.filter(models, lambda m: m.rlike(embedding))
        if purpose == "embedding"
        else F.filter(models, lambda m: ~m.rlike(other))
    )
    return F.coalesce(F.get(wanted, F.lit(0)), F.get(models, F.lit(0)))


def eval_question(title: Column) -> Column:
    return F.concat(
        strip(F.regexp_replace(title, rf"^[0-9]+(?:\.[0-9]+)*{R.WS}*", "")), F.lit(" 怎么配置")
    )
