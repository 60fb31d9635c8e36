"""Benchmark decontamination by Wu-Manber multi-pattern search.

A test item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window).  Words are
runs of digits, a-z and non-ASCII characters after lower-casing A-Z; a document is searched as its words joined
by single blanks, with a blank at either end, so that a window matches whole words only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import as_bytes, bounded_batches

WINDOW = 13
SHARE = 20  # a document is contaminated when 1 in SHARE of its words or more is hit
BLOCK = 6  # bytes whose shift is looked up
TABLE_BYTES = 32 << 20  # item text per search table; more items are searched in several passes

_WORDS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_WORDS).split()


class WuManber:
    """Finds patterns in a text while reading a small part of it.

    The last ``block`` bytes of a search window tell how far the window may move: the distance from the
    block's last place in any pattern to that pattern's end, or past the block altogether.  At distance zero the
    bucket of that block names the patterns that may begin here, and these are compared directly.
    """

    def __init__(self, patterns: Iterable[bytes], block: int = BLOCK):
        patterns = list(patterns)
        self.length = min(map(len, patterns))
        self.block = min(block, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for at in range(self.far):
                part = p[at : at + self.block]
                self.shift[part] = min(self.shift.get(part, self.far), self.far - 1 - at)
            self.bucket[p[self.far - 1 : self.length]][p[: self.length]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(offset, pattern) of every occurrence, by ascending offset."""
        shift, block, far, length = self.shift.get, self.block, self.far, self.length
        at, last = far - 1, len(text) - block
        while at <= last:
            part = text[at : at + block]
            move = shift(part, far)
            if move:
                at += move
                continue
            start = at - far + 1
            for p in self.bucket[part].get(text[start : start + length], ()):
                if text.startswith(p, start):
                    yield start, p
            at += 1


class Scanner:
    """Search tables of a set of items, one per window length so that short items do not spoil the skips."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW, block: int = BLOCK):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        self.size: dict[bytes, int] = {}
        by_size = defaultdict(set)
        for name, text in items:
            found = words(text)
            size = min(window, len(found))
            for at in range(len(found) - size + 1 if size else 0):
                pattern = b" " + b" ".join(found[at : at + size]) + b" "
                by_size[size].add(pattern)
                self.size[pattern] = size
                self.items[pattern].add(name)
        self.tables = [WuManber(p, block) for p in by_size.values()]

    def scan(self, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words, hit stretches [first, last) of word positions, names of the items met."""
        found = words(text)
        joined = b" " + b" ".join(found) + b" "
        spans, names = [], set()
        for table in self.tables:
            seen, word = 0, -1
            for start, pattern in table.find(joined):
                word += joined.count(b" ", seen, start + 1)
                seen = start + 1
                spans.append([word, word + self.size[pattern]])
                names |= self.items[pattern]
        return len(found), merged(spans), names - {None}


def merged(spans: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


_HITS = pa.struct([
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])
_HITS_DDL = (
    "struct<n_words: bigint, n_hit: bigint, spans: array<struct<first: bigint, last: bigint>>, items: array<string>>"
)


def _search(items: list[tuple[str | None, bytes]], window: int, block: int, text: Column, before: Column) -> Column:
    """Hits of one table, joined with those of the tables before it."""
    held: list[Scanner] = []

    @F.arrow_udf(_HITS_DDL)
    def search(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        if not held:
            held.append(Scanner(items, window, block))
        out = []
        for t, e in zip(as_bytes(texts), earlier.to_pylist(), strict=True):
            n, spans, names = held[0].scan(t)
            if e:
                spans = merged([*spans, *([s["first"], s["last"]] for s in e["spans"])])
                names = names.union(e["items"])
            hit = sum(b - a for a, b in spans)
            spans = [{"first": a, "last": b} for a, b in spans]
            out.append({"n_words": n, "n_hit": hit, "spans": spans, "items": sorted(names)})
        return pa.array(out, _HITS)

    return search(text, before)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, name: str = "hits", text: str = "text",
    window: int = WINDOW, block: int = BLOCK, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, spans of word positions [first, last), items met.

    The item table is sent to the tasks in parts of about ``table_bytes`` of text, so what a task holds is
    bounded whatever the number of items; the parts run one after the other over the same rows, without a
    shuffle.  A null text or item text has no words, an item without words finds nothing, an item without id
    marks words but is not listed.  Repeated items and repeated rows count on their own.
    """
    part_rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    part_rows = part_rows.where("words IS NOT NULL").distinct()
    total = part_rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = total // table_bytes + 1
    key = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    out = bounded_batches(docs).withColumn(name, F.lit(None).cast(_HITS_DDL))
    for part in range(parts):
        items = [(r.item, r.words.encode()) for r in part_rows.where(key == part).collect()]
        out = out.withColumn(name, _search(items, window, block, F.col(text), F.col(name)))
    return out


def contaminated(hits: str = "hits", share: int = SHARE) -> Column:
    n_hit, n_words = F.col(f"{hits}.n_hit"), F.col(f"{hits}.n_words")
    return (n_hit > 0) & (n_hit * share >= n_words)


def items_digest(hits: str = "hits") -> Column:
    """SHA-256 of the item ids met, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.col(f"{hits}.items"), ",").cast("binary"), 256)
