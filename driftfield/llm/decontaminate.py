"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of eight benchmark words (an item of fewer words is one window of its own). The text is a
sequence of words, and the search looks at blocks of two: a shift table tells how far the window's end can move when
its last block is seen, blocks that occur in no pattern skip nearly a whole window; where the shift is zero, the bucket
of that suffix block holds the few patterns to compare directly. Shorter windows (an item of one word has no block of
two) are searched by the same tables with their own lengths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import arrow_mapped, byte_sizes, slices, worker_tool

WINDOW, BLOCK = 8, 2
#: Words on the UTF-8 bytes of a text: digits, a-z (after lower-casing A-Z) and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Pattern bytes up to which the benchmark is sent to every executor; a larger one is searched in parts, one after the other.
PART_BYTES = 64 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


class WuManber:
    """Patterns of one length ``m``: tuples of words, each with the items that hold it."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m, self.block = m, min(BLOCK, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.bucket.setdefault(pattern[-self.block :], {})[pattern] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence."""
        m, n, shift, default, bucket = self.m, len(words), self.shift.get, self.default, self.bucket
        end, block = m, self.block
        if block == 1:
            for i, w in enumerate(words):
                if (found := bucket.get((w,))) is not None:
                    yield i, found[(w,)]
            return
        while end <= n:
            s = shift((words[end - 2], words[end - 1]), default)
            if s:
                end += s
                continue
            window = tuple(words[end - m : end])
            items = bucket[window[-block:]].get(window)
            if items is not None:
                yield end - m, items
            end += 1


class Patterns:
    """All windows of the benchmark, one searcher for each window length."""

    def __init__(self, items: list[tuple[int, bytes | None]]):
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            m = min(WINDOW, len(words))
            for i in range(len(words) - m + 1) if m else ():
                holders = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
                if not holders or holders[-1] != number:
                    holders.append(number)
        self.ids = [i for i, _ in items]
        self.searchers = [WuManber(m, p) for m, p in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, bool]:
        """Spans of words inside occurrences, ids of items that occur, and whether a window of full length does."""
        spans, items, full = [], set(), False
        for searcher in self.searchers:
            for at, holders in searcher.search(words):
                spans.append((at, at + searcher.m))
                items.update(holders)
                full |= searcher.m == WINDOW
        return spans, {self.ids[i] for i in items if self.ids[i] is not None}, full


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, bytes | None]]]:
    """The items in lists of about ``PART_BYTES``, read one partition at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`").cast("binary")).toLocalIterator():
        part.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += 8 * len(part[-1][1] or b"")
        if size > PART_BYTES:
            yield part
            part, size = [], 0
    yield part


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (disjoint spans of words inside occurrences, as from, to, from, to ...),
    ``n_hit`` (words in them), ``items`` (ids of items with occurring windows, sorted as strings) and ``full`` (a window
    of eight words occurs).

    Null and empty texts have no words and no hits, as have all texts where the benchmark is empty; items without words
    match nothing; items with the same id count once; one without an id hits words but is not named. One row for every input row; input columns named like a made one
    are replaced. The benchmark is the side that is sent around: its size is checked, and what goes beyond
    ``PART_BYTES`` is searched in further passes that add to the spans and items found so far.
    """
    made = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("full", T.BooleanType())]
    names, out, done = [m.name for m in made[1:]], docs, False
    for part in _parts(benchmark, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))

        def make(columns: list[pa.Array], sent=sent) -> Iterator[tuple[int, int, list[pa.Array]]]:
            key, items = sent.value
            patterns = worker_tool(f"patterns-{key}", lambda: Patterns(items))
            for a, b in slices(byte_sizes(columns[0]), 4 << 20):
                rows = []
                for x, old, known, whole in zip(*[c.slice(a, b - a).to_pylist() for c in columns]):
                    words = words_of(x)
                    spans, found, full = patterns.hits(words)
                    spans = united(spans + list(zip(old[::2], old[1::2])) if old else spans)
                    rows.append((len(words), [i for s in spans for i in s], sorted({*map(str, found), *(known or ())}), full or bool(whole)))
                yield a, b, [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()))]

        # What was found so far goes in under other names, as columns called like the made ones are replaced.
        given = out.select(*[c for c in out.columns if not (done and c in names)], *[(F.col(n) if done else F.lit(None).cast(m.dataType)).alias(f"__so_far_{n}") for n, m in zip(names, made[1:])])
        out = arrow_mapped(given, [text, *[f"__so_far_{n}" for n in names]], made, make).drop(*[f"__so_far_{n}" for n in names])
        done = True
    spans = F.col("hit_spans")
    return out.withColumn("n_hit", F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x))
