"""Personal data in whole texts, also in disguise, with offsets into the source text.

Plain identifiers are found in the text as it is (the base). Then the text passes through transducers, each a list
of edits with their source spans:

1. homoglyphs: look-alike letters, digits of any script, full-width forms, special dots, dashes and spaces become
   ASCII, one character each; zero-width characters go; O, o, l and I between digits become 0 and 1;
2. disguised signs: ``[at]``, ``(dot)``, ``{@}``, ``<.>`` with the space around them, the word ``dot`` between
   words, and ``at`` if a ``dot`` in words or brackets follows the next word;
3. spelled digits: zero .. nine next to another one, a number or a dot become digits, without the space between
   two of them; ``plus`` before a digit becomes ``+``.

The same patterns run over the normalised text. A match that contains an edit is mapped back, unless it cuts or
lies in a base span of its kind (one that extends base spans is added beside them): a copied character maps to itself, a replaced one to the whole span it stands for.

Patterns are matched in linear time: an address is looked for from its sign and extended to the left; chains of
numbers are taken whole and cut in fours.

Defined results: a null text is an empty one and has no spans. Every row is judged by itself; ids and other
columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alike letters and their Latin forms.
LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈαοντυρκιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjhdqwABEKMHOPCTYXISJaovtupkiABEZHIKMNOPTYX", strict=True))
SIGNS = {
    **dict.fromkeys("\u2024\u3002\uff61\u00b7\ufe52", "."),
    "\ufe6b": "@",
    **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2212\ufe63", "-"),
    **dict.fromkeys("\u207a\ufe62\u2795", "+"),
    **dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " "),
}
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}

UNHIDE = re.compile(f"[{HIDDEN}]")
LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI]+(?=[0-9])")
BRACKETED = re.compile(r"[\[({<]\s*(at|dot|@|\.)\s*[\])}>]\s*", re.I)
DOT_NEXT = r"(?=[A-Za-z0-9-]+(?:\s+dot\s|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]|\.[A-Za-z0-9-]+\s+dot\s))"
AT_WORD = re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+{DOT_NEXT}", re.I)
DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
#: what spelled digits may stand next to: each other, numbers, a plus before them, dots between them
SPOKEN = re.compile(rf"\b({'|'.join(SPELLED)}|plus|dot)\b|[0-9]+|[\[({{<]\s*(?:dot|\.)\s*[\])}}>]|\.", re.I)
GAP = re.compile(r"[\s-]{0,3}")


class _Homoglyphs(dict):
    """One character for each; digits of all scripts and full-width forms by rule."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        to = LOOKALIKES.get(c) or SIGNS.get(c)
        if to is None and code > 127:
            if 0xFF01 <= code <= 0xFF5E:
                to = chr(code - 0xFEE0)
            elif unicodedata.category(c) == "Nd":
                to = str(unicodedata.decimal(c))
            elif 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x24FF:
                plain = unicodedata.normalize("NFKC", c)
                to = plain if len(plain) == 1 and plain.isascii() else None
        self[code] = ord(to) if to else code
        return self[code]


HOMOGLYPHS = _Homoglyphs()


def emails(text: str) -> list[Span]:
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            end = m.end()
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                out.append((start, start + size))
            start += size + 1
    return out


def luhn(digits: str) -> bool:
    double = "0246813579"
    return sum(int(d) if i % 2 == 0 else int(double[int(d)]) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def edits_of(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with look-alikes replaced (same length), and the edits that change lengths, in order."""
    hidden: list[tuple[int, int, str]] = []
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
        hidden = [(m.start(), m.end(), "") for m in UNHIDE.finditer(text)]
    text = LETTER_DIGIT.sub(lambda m: "".join("0" if c in "Oo" else "1" for c in m.group()), text)
    low = text.lower()
    found: list[tuple[int, int, str]] = []
    if any(c in text for c in "[({<"):
        found += bracketed(text)
    if "dot" in low:
        found += [(m.start(), m.end(), "@") for m in AT_WORD.finditer(text)]
        found += [(m.start(), m.end(), ".") for m in DOT_WORD.finditer(text)]
    if any(w in low for w in SPELLED) or "plus" in low:
        found += spoken_digits(text)
    edits, end, at = [], 0, 0
    for s, e, to in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end:
            while at < len(hidden) and hidden[at][0] < s:
                edits.append(hidden[at])
                at += 1
            while at < len(hidden) and hidden[at][0] < e:  # goes with what it is hidden in
                at += 1
            edits.append((s, e, to))
            end = e
    return text, edits + hidden[at:]


def bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits for an at or dot in brackets with the blanks around it, found from the bracket to both sides."""
    out, end = [], 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > end and text[start - 1].isspace():
            start -= 1
        end = m.end()
        out.append((start, end, "@" if m.group(1).lower() in ("at", "@") else "."))
    return out


def spoken_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits for spelled digits next to others, numbers or dots, and for a plus before any of them. The space
    between two spelled digits, and after a plus, goes."""
    out = []
    joined = False
    tokens = SPOKEN.finditer(text)
    token = next(tokens, None)
    while token is not None:
        after = next(tokens, None)
        word, start, end = (token.group(1) or "").lower(), token.start(), token.end()
        follows = after is not None and GAP.fullmatch(text, end, after.start()) is not None
        said = after is not None and (after.group(1) or "").lower() in SPELLED
        if word in SPELLED and (follows or joined):
            out.append((start, after.start() if follows and said else end, SPELLED[word]))
        elif word == "plus" and follows and (said or after.group()[0].isdigit()):
            out.append((start, after.start(), "+"))
        joined = follows
        token = after
    return out


def deobfuscated(text: str) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """The normalised text, the starts of its segments, and each segment's source start, source end, and kind
    (0: copied, 1: replaced)."""
    same, edits = edits_of(text)
    pieces, starts, sources, at, size = [], [], [], 0, 0
    for s, e, to in [*edits, (len(same), len(same), "")]:
        if s > at:
            pieces.append(same[at:s])
            starts.append(size)
            sources.append((at, s, 0))
            size += s - at
        if to:
            pieces.append(to)
            starts.append(size)
            sources.append((s, e, 1))
            size += len(to)
        at = e
    return "".join(pieces), starts, sources


def source_span(span: Span, starts: list[int], sources: list[tuple[int, int, int]]) -> Span:
    """Map a span of the normalised text back."""
    i, j = bisect_right(starts, span[0]) - 1, bisect_right(starts, span[1] - 1) - 1
    (a, _, a_kind), (b, b_end, b_kind) = sources[i], sources[j]
    return (a if a_kind else a + span[0] - starts[i]), (b_end if b_kind else b + span[1] - starts[j])


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans by kind."""
    text = text or ""
    base = {kind: finder(text) for kind, finder in FINDERS.items()}
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    normal, starts, sources = deobfuscated(text)
    if normal == text:
        return base, added
    for kind, finder in FINDERS.items():
        taken = base[kind]
        begins = [s for s, _ in taken]
        for span in finder(normal):
            s, e = source_span(span, starts, sources)
            if text[s:e] == normal[span[0] : span[1]]:
                continue
            k = bisect_right(begins, s)
            inside = k > 0 and taken[k - 1][1] > s and (taken[k - 1][0] < s or taken[k - 1] == (s, e) or taken[k - 1][1] > e)
            if not inside and not (k < len(taken) and taken[k][0] < e < taken[k][1]):
                added[kind].append((s, e))
    return base, added


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind in KINDS for s, e in sorted(spans[kind]))


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            base, more = find(text.as_py())
            out.append([
                {"kind": kind, "start": s, "end": e, "added": new}
                for kind in KINDS
                for s, e, new in sorted([(*x, False) for x in base[kind]] + [(*x, True) for x in more[kind]])
            ])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, SPAN_TYPE)], [*batch.schema.names[:-1], "spans"])


def personal_data(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, and ``spans``: kind, start, end (code points, end exclusive), added.
    A kept column of that name gives way."""
    keep = [c for c in keep if c.lower() != "spans"]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*kept, "spans array<struct<kind: string, start: bigint, end: bigint, added: boolean>>"])
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(_span_rows, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of all spans by kind, digest of the base spans, all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind, new: F.size(F.filter("spans", lambda x: (x["kind"] == kind) & (x["added"] if new else F.lit(True)))).cast("long")
    base = F.filter("spans", lambda x: ~x["added"])
    return found.select(
        "doc_id", *[count(k, False).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        *[count(k, True).alias(f"n_{k}_added") for k in KINDS],
    )
