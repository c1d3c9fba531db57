"""BPE encoding and decoding by speculation and verification.

A text is normalised (NFC, each run of white space one space, lower case) and split into words; a word's bytes are
written in the vocabulary's byte alphabet with an end mark on the last. A word is encoded as follows.

Speculate: greedy longest match from the left proposes tokens.
Verify: merging by rank yields a sequence of tokens if and only if it yields every two adjacent ones of it when
they stand alone, that is, if no merge across their border comes before the merges that built them. All adjacent
pairs of all proposals of a slice are tested at once with numpy: per pair, go back through the merges of both
tokens from the last one on and see whether a merge across the border would have come first. Results are kept.
Merge: only words with a failing pair go through the merges one by one, lowest rank first.

Words repeat, so each task keeps the ids of the words it has met (the store starts anew when it is large).
Tokens are decoded as the vocabulary's file says: without a decoder their strings are joined by single spaces.

Defined results: a null text is an empty one and has no tokens; texts with the strings of special tokens get the
special ids there. Rows and other columns do not influence each other.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import slices

MOST_WORDS = 500_000
NEVER = 1 << 40
UNMERGED = (NEVER, -1)
#: words of more bytes are merged with a heap
LONG = 100


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(shifted.get(b, b)) for b in range(256)]


@dataclass
class Vocabulary:
    ids: dict[str, int]
    tokens: list[str]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> rank, merged id
    special: dict[str, int]
    pattern: str
    end: str
    longest: int = 0
    born: np.ndarray = field(default=None)  # rank of the merge that makes a token, -1 for single letters
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    keys: np.ndarray = field(default=None)
    ranks: np.ndarray = field(default=None)

    def __post_init__(self):
        n = len(self.tokens)
        self.longest = max(len(t) for t in self.ids)
        self.born, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for (a, b), (rank, made) in self.merges.items():
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, a, b
        keys = np.array([a * n + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of byte-level BPE with an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in [*ids.items(), *special.items()]:
        tokens[i] = t
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a], ids[b]] = rank, ids[a + b]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return Vocabulary({t: i for t, i in ids.items() if i not in special.values()}, tokens, merges, special, pattern, spec["model"]["end_of_word_suffix"] or "")


#: these split like the vocabulary's pattern: PLAIN where no character is a number but the decimal digits, LATIN where
#: moreover no letter lies beyond U+00FF (lower case)
PLAIN = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
LATIN = re.compile("[a-zªµºß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zªµºß-öø-ÿ0-9\\s]+")
# Fixed value: the pattern that PLAIN stands for.
PLAIN_FOR = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def normalised(text: str) -> str:
    """Composed and in lower case. White space separates words and is no part of any, so its runs may stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self.words: dict[str | tuple[str], tuple[int, str, str]] = {}
        self.fits: dict[int, bool] = {}
        self.general = regex.compile(vocabulary.pattern)
        self.kinds: dict[str, int] = {}
        v, letters = vocabulary, self.letters
        self.single = [v.ids[c] for c in letters]
        self.last = [v.ids[c + v.end] for c in letters]
        self.inner = max(len(t) for t in v.ids if not (v.end and t.endswith(v.end)))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def split(self, text: str) -> list[str]:
        text = normalised(text)
        if self.v.pattern != PLAIN_FOR:
            return self.general.findall(text)
        seen = set(text)
        for c in seen.difference(self.kinds):
            kind = unicodedata.category(c)
            odd = kind in ("Nl", "No") or "\x1c" <= c <= "\x1f" or (kind[0] == "C" and c >= "\x80" and not c.isspace())
            self.kinds[c] = 2 if odd else 1 if c > "\xff" and kind[0] in "LN" else 0
        kind = max(map(self.kinds.__getitem__, seen), default=0)
        return (LATIN if kind == 0 else PLAIN if kind == 1 else self.general).findall(text)

    def pieces(self, text: str | None) -> list[str | tuple[str]]:
        """Words and special tokens in order; a special token is a tuple, which no text can look like."""
        if not text:
            return []
        if not any(special in text for special in self.v.special):
            return self.split(text)
        out: list[str | tuple[str]] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.split(text[at : m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + self.split(text[at:])

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the end mark goes with the last letter."""
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        find, end, out, at, n = self.v.ids.get, self.v.end, [], 0, len(letters)
        while (found := find(letters[at:] + end) if n - at <= self.v.longest else None) is None:
            for stop in range(min(n - 1, at + self.inner), at, -1):
                if (found := find(letters[at:stop])) is not None:
                    break
            else:
                return []
            out.append(found)
            at = stop
        out.append(found)
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For pairs (key = left * size + right): would merging keep the border between the two tokens?

        Undo the merges of both tokens from the latest on. As long as the latest is undone, the two parts at the
        border are there together between the ranks of what made them and of what used them; a merge of the two
        with a rank in that time would have crossed the border. In a tie the left one is merged first.
        """
        v, n = self.v, len(self.v.tokens)
        a, b = pairs // n, pairs % n
        used_a = np.full(len(a), NEVER, np.int64)  # the rank at which the part was used up by its own token
        used_b = used_a.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = np.minimum(np.searchsorted(v.keys, x * n + y), len(v.keys) - 1)
            hit = v.keys[at] == x * n + y
            rank = np.where(hit, v.ranks[at], np.int64(NEVER))
            # A merge across the border is made if it comes before the next use of either part. Merges of one rank go
            # from the left, so the left part's own use comes first in a tie, and the right part's comes later.
            crossed = hit & (rank < used_a[live]) & (rank <= used_b[live])
            good[live[crossed]] = False
            born_x, born_y = v.born[x], v.born[y]
            go = ~crossed & (np.maximum(born_x, born_y) >= 0)
            live, x, y, born_x, born_y = live[go], x[go], y[go], born_x[go], born_y[go]
            # undo the later one; in a tie the right one, which was made later
            undo_x = born_x > born_y
            used_a[live[undo_x]] = born_x[undo_x]
            a[live[undo_x]] = v.right[x[undo_x]]
            used_b[live[~undo_x]] = born_y[~undo_x]
            b[live[~undo_x]] = v.left[y[~undo_x]]
        return good

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first and leftmost of equals."""
        data, merges = word.encode(), self.v.merges
        ids = [self.single[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if len(ids) > LONG:
            return self.merge_long(ids)
        ranks = [merges.get(p, UNMERGED)[0] for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [merges[ids[i], ids[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), UNMERGED)[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), UNMERGED)[0]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words, by linked parts and a heap."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.v.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.v.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.v.merges[pair][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (ids[left], ids[right]) in self.v.merges:
                    pair = ids[left], ids[right]
                    heapq.heappush(heap, (self.v.merges[pair][0], left, pair))
        return [i for i in ids if i >= 0]

    def learn(self, words: set[str | tuple[str]]) -> None:
        """Encode words that are not known yet."""
        fresh = [w for w in words if w not in self.words]
        if not fresh:
            return
        n = len(self.v.tokens)
        proposals = [[self.v.special[w[0]]] if isinstance(w, tuple) else self.propose(w) for w in fresh]
        wanted = {a * n + b for tokens in proposals for a, b in zip(tokens, tokens[1:])}
        wanted = [k for k in wanted if k not in self.fits]
        if wanted:
            if len(self.fits) > MOST_WORDS * 4:
                self.fits = {}
                wanted = list({a * n + b for tokens in proposals for a, b in zip(tokens, tokens[1:])})
            self.fits.update(zip(wanted, self.compatible(np.array(wanted, np.int64)).tolist(), strict=True))
        for word, tokens in zip(fresh, proposals, strict=True):
            if not tokens or not all(self.fits[a * n + b] for a, b in zip(tokens, tokens[1:])):
                tokens = self.merge(word)
            self.words[word] = len(tokens), " ".join(map(str, tokens)), " ".join(self.v.tokens[t] for t in tokens)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, ids joined by spaces, decoded text."""
        pieces = [self.pieces(t) for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words = {}
        self.learn(set().union(*pieces))
        known = self.words.__getitem__
        for words in pieces:
            sizes, ids, tokens = zip(*map(known, words)) if words else ((), (), ())
            yield sum(sizes), " ".join(ids), " ".join(tokens)


def ids_of(encoder: Encoder, text: str | None) -> list[int]:
    return [int(i) for _, ids, _ in encoder.encode([text]) for i in ids.split()]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """A worker's tasks share what they have learned about words."""
    vocabulary = shared.value
    if id(vocabulary) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(vocabulary)] = Encoder(vocabulary)
    return _ENCODERS[id(vocabulary)]


def _encode_rows(shared, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                rows = list(encoder.encode(part.column(part.num_columns - 1).to_pylist()))
                head = [part.column(i) for i in range(part.num_columns - 1)]
                names = part.schema.names[:-1]
                count = pa.array([x[0] for x in rows], pa.int64())
                if digest:
                    tail = [count, pa.array([sha(x[1]) for x in rows]), pa.array([sha(x[2]) for x in rows])]
                    yield pa.RecordBatch.from_arrays([*head, *tail], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = [np.fromstring(x[1], np.int32, sep=" ") if x[1] else np.zeros(0, np.int32) for x in rows]
                    tail = [count, pa.array(ids, pa.list_(pa.int32())), pa.array([x[2] for x in rows], pa.string())]
                    yield pa.RecordBatch.from_arrays([*head, *tail], [*names, "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", digest: bool = False) -> DataFrame:
    """The ``keep`` columns of every row with ``n_tokens, ids, decoded``, or with digests of the latter two.
    A kept column of such a name gives way to the new one."""
    tail = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digest else ["n_tokens long", "ids array<int>", "decoded string"]
    keep = [c for c in keep if c.lower() not in [t.split()[0] for t in tail]]
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return source.mapInArrow(_encode_rows(vocabulary, digest), ", ".join([*kept, *tail]))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return " ".join(vocabulary.tokens[i] for i in ids)
