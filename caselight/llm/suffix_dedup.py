"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when it lies in a ``MIN_BYTES``-byte string that also starts in a document with a smaller doc_id.
In suffix order that is the longest-previous-factor rule: from a suffix, the nearest positions before and
behind it that belong to a smaller document give its longest earlier match, and the suffix counts when that
match has ``MIN_BYTES`` bytes or more.

The suffixes of the whole corpus are never brought to one place, and most never leave their document:

1. Each window of ``MIN_BYTES`` bytes names the least hashed ``GRAM``-gram in it as its anchor.  Equal windows
   name equal anchors, so suffixes only have to be compared inside the bucket of their anchor.  The windows of
   one anchor form a span; a document has about one span per 18 bytes.
2. Spans are combined map-side and again after one shuffle by anchor: of equal spans (two 64-bit hashes) one
   keeps the smallest doc_id and the others are repeats as a whole.  What stays open are the different spans
   of one anchor.
3. Only those fetch their bytes.  A bucket sorts its suffixes, and previous and next smaller positions in
   that order decide each of them.

An anchor that is met in very many different contexts would make one large bucket.  Such anchors are found on
a sample, which only decides how work is dealt out: their windows are keyed one by one by a hash of all their
bytes, where combining map-side leaves no bucket to speak of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import as_bytes, bounded_batches, stage, text_tag

MIN_BYTES = 50
GRAM = 16
HOT_SPANS = 1_000  # different spans of one anchor above which its windows are keyed singly
HOT_SAMPLE = 0.05  # share of documents that the search for such anchors reads
HOT_LIST = 100_000  # anchors that list may hold (0.8 MB); the most frequent go first

BLOCK = 1 << 17  # window starts that are hashed together
FLUSH_SPANS = 400_000  # spans that a task combines at a time
BUCKET_SPANS = 8_000  # spans whose suffixes are sorted together

_POS_BITS = 20
_POS = np.uint64((1 << _POS_BITS) - 1)
_BASE = 0x5851F42D4C957F2D  # odd, so that it can be inverted modulo 2**64
_SPAN_BITS, _LO_BITS = 6, 31


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Rolling hashes of byte blocks: hash(i, j) = sum of letter * base**(position - i)."""

    def __init__(self, min_bytes: int, gram: int):
        if not gram < min_bytes <= gram + (1 << _SPAN_BITS) - 1:
            raise ValueError("min_bytes must exceed gram by 1 to 62")
        self.min_bytes, self.gram = min_bytes, gram
        size = 2 * BLOCK + 4 * min_bytes
        self.letter = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.power = np.cumprod(np.full(size, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))

    def between(self, total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (total[hi] - total[lo]) * self.inverse[lo]

    def spans(self, buf: np.ndarray, offset: np.ndarray, length: np.ndarray, hot: np.ndarray):
        """Anchor hash, span hash, first start and number of starts of every span; buf holds pieces."""
        n, k, m = len(buf), self.gram, self.min_bytes
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[buf] * self.power[:n], out=total[1:])
        gram = (total[k:] - total[:-k]) * self.inverse[: n - k + 1]
        mixed = _mix(gram)
        beyond = np.zeros(len(gram) + 1, np.uint64)
        np.cumsum(mixed, out=beyond[1:])
        low = (mixed & ~_POS) | np.arange(len(gram), dtype=np.uint64)
        width, reach = m - k + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = width - reach
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        edge = np.zeros(len(low) + 1, np.int32)
        np.add.at(edge, offset, 1)
        np.add.at(edge, offset + length - m + 1, -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]))
        anchor = (low[start] & _POS).astype(np.int64)
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
        head = np.concatenate([[0], cut])
        lo, many = start[head], np.diff(np.concatenate([head, [len(start)]]))
        name = gram[anchor[head]]
        if len(hot):
            near = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
            if near.any():
                single = _starts(lo[near], many[near])
                lo = np.concatenate([lo[~near], single])
                many = np.concatenate([many[~near], np.ones(len(single), many.dtype)])
                whole = self.between(total, single, single + m)
                name = np.concatenate([name[~near], _mix(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5))])
        end = lo + many + m - 1
        return name, self.between(total, lo, end) ^ _mix(beyond[end - k + 1] - beyond[lo]), lo, many


def _starts(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All starts of spans, one after the other."""
    ends = np.cumsum(many)
    return np.repeat(lo - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(ids, tags, texts, min_bytes: int):
    """(id, tag, base, bytes): texts cut so that each piece holds at most BLOCK starts."""
    for doc, tag, text in zip(ids, tags, texts, strict=True):
        if doc is None or text is None or len(text) < min_bytes:
            continue
        starts = len(text) - min_bytes + 1
        for base in range(0, starts, BLOCK):
            yield doc, tag, base, text[base : min(base + BLOCK, starts) + min_bytes - 1]


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _span_rows(hasher: _Hasher, hot: np.ndarray, batches: Iterator[pa.RecordBatch]):
    """Arrays (name, digest, doc, tag, lo, many) per block."""
    for batch in batches:
        texts = as_bytes(batch.column(2))
        todo, size = [], 0
        pieces = _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, hasher.min_bytes)
        for piece in chain(pieces, [None]):
            if piece is not None:
                todo.append(piece)
                size += len(piece[3])
            if todo and (piece is None or size >= BLOCK):
                length = np.array([len(p[3]) for p in todo])
                offset = np.cumsum(length) - length
                buf = np.frombuffer(b"".join(p[3] for p in todo), np.uint8)
                name, digest, lo, many = hasher.spans(buf, offset, length, hot)
                at = np.searchsorted(offset, lo, "right") - 1
                doc, tag, base = (np.array(x, np.int64)[at] for x in list(zip(*todo, strict=True))[:3])
                yield name.view(np.int64), digest.view(np.int64), doc, tag, lo - offset[at] + base, many
                todo, size = [], 0


def _merge_runs(doc, tag, lo, many):
    """Join runs of starts that follow each other in one document (input in document order)."""
    if not len(doc):
        return doc, tag, lo, many
    new = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] != lo[:-1] + many[:-1])
    head = np.flatnonzero(np.concatenate([[True], new]))
    return doc[head], tag[head], lo[head], np.add.reduceat(many, head)


def _combined(rows: list[tuple]) -> pa.RecordBatch:
    """Map-side combining: of equal spans only those of the smallest document travel; the rest are repeats."""
    name, digest, doc, tag, lo, many = (np.concatenate(x) for x in zip(*rows, strict=True))
    rows.clear()
    order = np.argsort(_mix(name.view(np.uint64)) ^ digest.view(np.uint64))
    n, d = name[order], digest[order]
    head = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1])]))
    least = np.minimum.reduceat(doc[order], head)
    first = np.empty(len(doc), np.int64)
    first[order] = np.repeat(least, np.diff(np.concatenate([head, [len(doc)]])))
    stay = doc == first
    by_place = np.lexsort((lo[~stay], tag[~stay], doc[~stay]))
    runs = _merge_runs(*(x[~stay][by_place] for x in (doc, tag, lo, many)))
    spread = _mix((runs[0] * 0x10001 + runs[2]).astype(np.uint64)).view(np.int64)
    place = lo | (many << _LO_BITS) | (tag << (_LO_BITS + _SPAN_BITS))
    done = ~(runs[2] | (runs[1] << (_LO_BITS + _SPAN_BITS)))  # negative: a run, its length in place of a digest
    arrays = [
        np.concatenate([name[stay], spread]),
        np.concatenate([digest[stay], runs[3]]),
        np.concatenate([doc[stay], runs[0]]),
        np.concatenate([place[stay], done]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["name", "digest", "doc", "place"])


def _map_spans(min_bytes: int, gram: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for block in _span_rows(_Hasher(min_bytes, gram), hot, batches):
            rows.append(block)
            size += len(block[0])
            if size >= FLUSH_SPANS:
                yield _combined(rows)
                size = 0
        if rows:
            yield _combined(rows)
        pa.default_memory_pool().release_unused()

    return run


def _map_names(min_bytes: int, gram: int):
    """Anchors with their span hashes only, for the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, digest, *_ in _span_rows(_Hasher(min_bytes, gram), np.empty(0, np.uint64), batches):
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(digest)], ["name", "digest"])

    return run


_OPEN = "name long, doc long, tag long, lo long, many long"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (name, digest, doc): repeats as runs (null name), different spans of one anchor as open."""

    def decide(rows: list[np.ndarray]) -> pa.RecordBatch:
        name, digest, doc, place = rows
        run = place < 0
        lo = np.where(run, ~place, place) & ((1 << _LO_BITS) - 1)
        tag = np.where(run, ~place, place) >> (_LO_BITS + _SPAN_BITS)
        many = np.where(run, digest, (place >> _LO_BITS) & ((1 << _SPAN_BITS) - 1))
        new_name = np.concatenate([[True], name[1:] != name[:-1]])
        new = new_name | np.concatenate([[True], digest[1:] != digest[:-1]])
        head = np.flatnonzero(new)
        first = doc[head][np.cumsum(new) - 1]
        bucket = np.cumsum(new_name) - 1
        top = np.flatnonzero(new_name)
        kinds = np.add.reduceat(new.astype(np.int64), top)
        differ = (np.maximum.reduceat(doc, top) > np.minimum.reduceat(doc, top)) & (kinds > 1)
        repeat = run | (doc > first)
        keep = repeat | differ[bucket]
        named = pa.array(name[keep], mask=repeat[keep])
        rest = [pa.array(x[keep]) for x in (doc, tag, lo, many)]
        return pa.RecordBatch.from_arrays([named, *rest], ["name", "doc", "tag", "lo", "many"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = _columns(batch, "name", "digest", "doc", "place")
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        tail = np.searchsorted(rows[0], rows[0][-1], "left")
        if tail:
            yield decide([x[:tail] for x in rows])
        held = [x[tail:] for x in rows]
    if held is not None:
        yield decide(held)


def _fetch(min_bytes: int):
    """Bytes of open spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, tag, text, spans in zip(docs, tags, as_bytes(batch.column(2)), batch.column(3).to_pylist()):
                for s in spans:
                    lo, many = s["lo"], s["many"]
                    out.append((s["name"], doc, tag, lo, many, text[lo : lo + many + min_bytes - 1]))
            if out:
                kinds = [*[pa.int64()] * 5, pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["name", "doc", "tag", "lo", "many", "bytes"])

    return run


def previous_factors(name, doc, window: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix fills its window.

    ``window`` holds the first bytes of each suffix.  Suffixes are put in order within their bucket, equal
    windows by document.  The longest earlier match of a suffix lies at its previous or its next smaller
    position, that is the nearest one of a smaller document.  Within a run of equal windows documents ascend,
    so the previous smaller position of a suffix is in the run exactly when the run's head has a smaller
    document, and the next smaller one lies behind the run, where the common prefix is shorter than a window.
    """
    words = -(-window.shape[1] // 8)
    padded = np.zeros((len(window), words * 8), np.uint8)
    padded[:, : window.shape[1]] = window
    key = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *key.T[::-1], name))
    same = (name[order][1:] == name[order][:-1]) & (key[order][1:] == key[order][:-1]).all(axis=1)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    smallest = doc[order][head]
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > np.repeat(smallest, np.diff(np.concatenate([head, [len(doc)]])))
    return out


def _factors(min_bytes: int):
    """Rows sorted by name, whole buckets at a time: runs of starts whose previous factor is long enough."""

    def decide(rows: list[pa.Table]) -> pa.RecordBatch:
        data = pa.concat_tables(rows).combine_chunks()
        name, doc, tag, lo, many = (data[c].to_numpy() for c in ("name", "doc", "tag", "lo", "many"))
        raw = data["bytes"].to_pylist()
        length = np.array([len(x) for x in raw])
        offset = np.cumsum(length) - length
        buf = np.frombuffer(b"".join(raw), np.uint8)
        start = _starts(offset, many)
        windows = np.lib.stride_tricks.sliding_window_view(buf, min_bytes)[start]
        of = np.repeat(np.arange(len(many)), many)
        hit = previous_factors(name[of], doc[of], windows)
        at = of[hit]
        place = lo[at] + start[hit] - offset[at]
        order = np.lexsort((place, tag[at], doc[at]))
        runs = _merge_runs(doc[at][order], tag[at][order], place[order], np.ones(len(at), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in runs], ["doc", "tag", "lo", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(len(t) for t in held) >= BUCKET_SPANS:
                rows = pa.concat_tables(held).combine_chunks()
                name = rows["name"].to_numpy()
                tail = int(np.searchsorted(name, name[-1], "left"))
                held = [rows.slice(tail)]
                if tail:
                    yield decide([rows.slice(0, tail)])
        if held:
            yield decide(held)

    return run


def _cover(text: bytes, runs: list[dict], min_bytes: int) -> list[tuple[int, int]]:
    """Maximal covered stretches of a text."""
    out: list[tuple[int, int]] = []
    for lo, many in sorted((r["lo"], r["many"]) for r in runs):
        hi = min(lo + many + min_bytes - 1, len(text))
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_RESULT = {
    "n_bytes": pa.int64(),
    "n_removed": pa.int64(),
    "n_spans": pa.int64(),
    "kept_sha256": pa.string(),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
    "kept": pa.binary(),
}


def _apply(min_bytes: int, keep: list[str], columns: list[str]):
    """Cut the runs out of each text; ``keep`` are input columns passed on, ``columns`` those of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            texts = as_bytes(batch.column(batch.schema.get_field_index("__text")))
            for text, runs in zip(texts, batch.column(batch.schema.get_field_index("__runs")).to_pylist()):
                text = text or b""
                spans = _cover(text, runs or [], min_bytes)
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                row = (
                    len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                    [{"first": a, "last": b} for a, b in spans], kept,
                )
                for c, v in zip(_RESULT, row, strict=True):
                    if c in out:
                        out[c].append(v)
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(out[c], _RESULT[c]) for c in columns]
            yield pa.RecordBatch.from_arrays([*passed, *made], [*keep, *columns])

    return run


def hot_anchors(
    docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, hot_spans: int = HOT_SPANS,
    sample: float = HOT_SAMPLE, most: int = HOT_LIST,
) -> np.ndarray:
    """Anchors met in about ``hot_spans`` different spans or more, by a sample of documents."""
    seen = docs.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(10_000)) < int(sample * 10_000))
    names = seen.mapInArrow(_map_names(min_bytes, gram), "name long, digest long")
    counts = names.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") >= max(2, hot_spans * sample)).orderBy(F.desc("n"), "name").limit(most)
    return np.sort(np.array([r[0] for r in hot.select("name").collect()], np.int64).view(np.uint64))


def repeated_runs(
    docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, hot_spans: int = HOT_SPANS,
    sample: float = HOT_SAMPLE,
) -> DataFrame:
    """``(doc, tag, lo, many)``: runs of starts whose window also starts in a smaller document.

    ``docs`` holds (doc, tag, text); tag keeps rows of one doc id but different text apart.
    """
    hot = hot_anchors(docs, min_bytes, gram, hot_spans, sample)
    spans = docs.mapInArrow(_map_spans(min_bytes, gram, hot), "name long, digest long, doc long, place long")
    sorted_spans = spans.repartition(F.col("name")).sortWithinPartitions("name", "digest", "doc")
    found = stage(sorted_spans.mapInArrow(_classes, _OPEN), "spans")
    per_doc = (
        found.where("name IS NOT NULL")
        .groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("name", "lo", "many")).alias("spans"))
    )
    fetched = docs.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "spans")
    texts = fetched.mapInArrow(_fetch(min_bytes), f"{_OPEN}, bytes binary")
    buckets = texts.repartition(F.col("name")).sortWithinPartitions("name")
    runs = buckets.mapInArrow(_factors(min_bytes), "doc long, tag long, lo long, many long")
    return stage(found.where("name IS NULL").select("doc", "tag", "lo", "many").unionByName(runs), "runs")


def remove_repeats(
    docs: DataFrame,
    columns: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"),
    keep: tuple[str, ...] = ("doc_id",),
    min_bytes: int = MIN_BYTES,
    gram: int = GRAM,
    hot_spans: int = HOT_SPANS,
    sample: float = HOT_SAMPLE,
) -> DataFrame:
    """Every document with its repeated bytes cut out: the ``keep`` columns of ``docs`` and the named results.

    ``spans`` are the maximal removed byte stretches [first, last) with the original offsets, ``kept`` the
    remaining bytes.  A null text is empty.  Texts shorter than ``min_bytes`` stay.  Rows that share a doc_id
    are not earlier than each other; rows without doc_id keep all their bytes and make nothing else go.
    """
    narrow = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), text_tag().alias("tag"), "text")
    runs = repeated_runs(narrow, min_bytes, gram, hot_spans, sample)
    per_doc = runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "many")).alias("__runs"))
    wide = docs.select(
        *keep, F.col("doc_id").cast("long").alias("__doc"), text_tag().alias("__tag"), F.col("text").alias("__text")
    )
    at = [F.col("__doc") == F.col("doc"), F.col("__tag") == F.col("tag")]
    joined = wide.join(per_doc, at, "left").select(*keep, "__text", "__runs")
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string",
             "spans": "array<struct<first: bigint, last: bigint>>", "kept": "binary"}
    fields = [f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, *[f"{c} {kinds[c]}" for c in columns]])
    return joined.mapInArrow(_apply(min_bytes, list(keep), list(columns)), schema)
