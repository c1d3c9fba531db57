"""Many keywords in many texts: one automaton finds all of them in a single walk over each text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: characters of keywords in one automaton, which is sent to the tasks; more keywords take more passes
AUTOMATON_CHARS = 1 << 20


class Automaton:
    """Aho-Corasick: a trie of the keywords, a link from each node to its longest proper suffix in the trie, and a
    link to the nearest such suffix that is a keyword."""

    def __init__(self, keywords: list[str]):
        self.keywords = keywords
        self.edges: list[dict[str, int]] = [{}]
        self.word = [-1]
        for number, keyword in enumerate(keywords):
            node = 0
            for c in keyword:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    self.word.append(-1)
                node = self.edges[node][c]
            self.word[node] = number
        self.suffix = [0] * len(self.edges)
        self.ends = [0] * len(self.edges)
        waiting = deque(self.edges[0].values())
        while waiting:
            node = waiting.popleft()
            for c, child in self.edges[node].items():
                at = self.suffix[node]
                while at and c not in self.edges[at]:
                    at = self.suffix[at]
                self.suffix[child] = self.edges[at].get(c, 0)
                waiting.append(child)
            behind = self.suffix[node]
            self.ends[node] = behind if self.word[behind] >= 0 else self.ends[behind]

    def find(self, text: str) -> set[int]:
        """Numbers of the keywords that the text contains."""
        found, node = set(), 0
        for c in text:
            while node and c not in self.edges[node]:
                node = self.suffix[node]
            node = self.edges[node].get(c, 0)
            at = node if self.word[node] >= 0 else self.ends[node]
            while at and self.word[at] not in found:
                found.add(self.word[at])
                at = self.ends[at]
        return found


def containing(texts: DataFrame, text_col: str, keywords: DataFrame, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows of ``texts`` beside each ``keyword`` of ``keywords(keyword)`` that ``text_col`` contains, once each.

    Keywords are taken in parts of about ``chars`` characters, so that an automaton has a bounded size; each part
    walks once over the texts, and only hits are shuffled afterwards. Empty keywords and null texts find nothing.
    """
    distinct = keywords.select("keyword").where(F.length("keyword") > 0).distinct()
    total = distinct.agg(F.sum(F.length("keyword"))).first()[0] or 0
    parts, out = max(1, -(-total // chars)), None
    place = texts.columns.index(text_col)
    names = [*texts.columns, "keyword"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), "keyword string"])
    for part in range(parts):
        rows = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part)
        automaton = texts.sparkSession.sparkContext.broadcast(Automaton(sorted(r.keyword for r in rows.collect())))

        def scan(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            of = automaton.value
            for batch in batches:
                hits = [(n, k) for n, text in enumerate(batch.column(place).to_pylist()) if text for k in sorted(of.find(text))]
                taken = batch.take(pa.array([n for n, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([of.keywords[k] for _, k in hits], pa.string())], names)

        hits = texts.mapInArrow(scan, schema)
        out = hits if out is None else out.unionByName(hits)
    return out
