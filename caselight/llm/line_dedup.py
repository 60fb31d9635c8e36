"""Removal of repeated lines and sentences by global hashing.

Lines, and the sentences of ``SENTENCE_WORDS`` words or more within them, are normalised (A-Z lower-cased, blanks
collapsed and trimmed) and hashed.  Of each digest the unit of the smallest doc_id stays, in that document the first
one; all others go, wherever they stand, so a passage that stands within longer lines goes but for the sentences it
shares with its surroundings.  Lines without a visible character are no units and stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import as_bytes, bounded_batches, stage, text_tag


SENTENCE_WORDS = 5
_SENTENCE = re.compile(rb"[^.!?]*[.!?]+[ \t\r\x0b\x0c]*|[^.!?]+")

Unit = tuple[int, int, bytes | None]


def units(text: bytes | None) -> list[tuple[Unit, list[Unit]]]:
    """(first, last, digest) of each line and of its sentences, when it has several.

    ``last`` of a line and of its last sentence is behind the line feed; blank lines and short sentences have no digest.
    """
    out, at = [], 0
    for line in (text or b"").split(b"\n"):
        end = min(at + len(line) + 1, len(text or b""))
        words = line.lower().split()
        own = (at, end, xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
        inner: list[Unit] = []
        pieces = _SENTENCE.findall(line)
        if len(pieces) > 1:
            for piece in pieces:
                words = piece.lower().split()
                many = len(words) >= SENTENCE_WORDS
                inner.append((at, at + len(piece), xxhash.xxh3_128_digest(b" ".join(words)) if many else None))
                at += len(piece)
            inner[-1] = (inner[-1][0], end, inner[-1][2])
        out.append((own, inner))
        at = end
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, doc, tag): the different units of each document."""
    for batch in batches:
        found: list[bytes] = []
        many = []
        for text in as_bytes(batch.column(2)):
            own = {d for line, inner in units(text) for _, _, d in (line, *inner) if d}
            found += own
            many.append(len(own))
        halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
        doc, tag = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), many) for i in (0, 1))
        cols = [pa.array(np.ascontiguousarray(c)) for c in (halves[:, 0], halves[:, 1], doc, tag)]
        yield pa.RecordBatch.from_arrays(cols, ["hi", "lo", "doc", "tag"])


_RESULT = {
    "n_lines": pa.int64(), "n_removed": pa.int64(), "bytes_removed": pa.int64(), "kept_sha256": pa.string(),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), "kept": pa.string(),
}
_DDL = {
    "n_lines": "long", "n_removed": "long", "bytes_removed": "long", "kept_sha256": "string",
    "spans": "array<struct<first: bigint, last: bigint>>", "kept": "string",
}


def _cut(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for text, gone in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                seen = {g["hi"].to_bytes(8, "big", signed=True) + g["lo"].to_bytes(8, "big", signed=True) for g in gone or ()}
                spans, kept, lines = [], [], units(text)
                for line, inner in lines:
                    whole_goes = line[2] and line[2] in seen
                    seen.add(line[2])
                    if whole_goes:
                        spans.append({"first": line[0], "last": line[1]})
                    elif not inner and text:
                        kept.append(text[line[0] : line[1]])
                    for first, last, digest in inner:
                        if not whole_goes and digest and digest in seen:
                            spans.append({"first": first, "last": last})
                        elif not whole_goes:
                            kept.append(text[first:last])
                        seen.add(digest)
                body = b"".join(kept)
                removed = len(text or b"") - len(body)
                row = (len(lines) if text else 0, len(spans), removed, hashlib.sha256(body).hexdigest(), spans, body.decode())
                for c, v in zip(_RESULT, row, strict=True):
                    if c in out:
                        out[c].append(v)
            made = [pa.array(out[c], _RESULT[c]) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *columns])

    return run


def remove_repeated_lines(docs: DataFrame, columns: tuple[str, ...] = tuple(_DDL)) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, bytes_removed, kept_sha256, removed spans (byte offsets), kept text.

    ``n_removed`` counts lines and, in lines that stay, sentences.

    Null and empty texts have no lines.  Documents of the same doc_id are not earlier than each other; rows
    without doc_id lose only their own inner repeats and make nothing else go.
    """
    narrow = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc"), text_tag().alias("tag"), "text")
    lines = narrow.where("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _digests, "hi long, lo long, doc long, tag long"
    )
    first = lines.groupBy("hi", "lo").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = stage(first.where("first < last").select("hi", "lo", "first"), "lines")
    later = lines.join(repeated, ["hi", "lo"]).where("doc > first")
    gone = stage(later.groupBy("doc", "tag").agg(F.collect_list(F.struct("hi", "lo")).alias("gone")), "gone")
    wide = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"), text_tag().alias("tag"))
    joined = wide.join(gone, ["doc", "tag"], "left").select("doc_id", "text", "gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut(list(columns)), ", ".join([f"doc_id {kind}", *[f"{c} {_DDL[c]}" for c in columns]]))
