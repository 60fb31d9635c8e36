"""WARC files of web pages and their fixity audit by Merkle trees.

Records are hashed, ranges of offsets in a file are hashed over their records, and nodes over up to ``FAN``
children, up to one root a file and one root a replica.  An audit compares the roots of two replicas and goes
down only where they differ, so what is compared record by record are the damaged ranges alone.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight.llm.common import bounded_batches, stage

PAGES_PER_FILE = 1_000
PART_BYTES = 32 << 20  # a file is stored in parts whose records begin within so many bytes of it
RANGE_BYTES = 1 << 16
FAN = 16
END = "\r\n\r\n"
FIRST = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"
ROWS = 8_192  # digests of an Arrow batch


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a resource record without the line ends behind it; blanks in the URL are escaped."""
    body = F.coalesce(html, F.lit(""))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "%20")
    name = F.md5(F.concat_ws("|", page_id.cast("string"), uri).cast("binary"))
    head = [
        F.lit(FIRST), name,
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    ]
    return F.concat(*head, body)


def file_of(page_id: Column, per_file: int = PAGES_PER_FILE) -> Column:
    """Pages without id have a file of their own."""
    return F.coalesce(F.floor(page_id.cast("long") / per_file), F.lit(-1)).cast("long")


def _records(pages: DataFrame, per_file: int) -> DataFrame:
    made = record(F.col("page_id"), F.col("url"), F.col("html")).alias("value")
    return pages.select(file_of(F.col("page_id"), per_file).alias("file"), "page_id", made)


def _placed(pages: DataFrame, per_file: int) -> DataFrame:
    """``(file, page_id, value, offset)``: records where they stand in their file, ordered by page_id and value.

    In two steps: bytes per page_id and first digits of the record's name, by which records of one page_id are
    ordered, give where such a group begins; rows are ordered within their group alone.  So pages without id, or
    of one id, are dealt to many tasks by their URLs.
    """
    group = ("file", "id", "no_id", "digits")
    size = (F.octet_length("value") + len(END)).cast("long")
    rows = _records(pages, per_file).select(
        "file", "page_id", "value", F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("id"),
        F.col("page_id").isNull().alias("no_id"), F.substring("value", len(FIRST) + 1, 3).alias("digits"),
    )
    bytes_of = rows.groupBy(*group).agg(F.sum(size).alias("bytes"))
    earlier = (Window.unboundedPreceding, -1)
    along = Window.partitionBy("file").orderBy(F.desc("no_id"), "id", "digits").rowsBetween(*earlier)
    begin = bytes_of.select(*group, F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("begin"))
    within = Window.partitionBy(*group).orderBy("value").rowsBetween(*earlier)
    offset = F.col("begin") + F.coalesce(F.sum(size).over(within), F.lit(0))
    return rows.join(begin, list(group)).select("file", "page_id", "value", offset.cast("long").alias("offset"))


def write_warc(
    pages: DataFrame, folder: str, per_file: int = PAGES_PER_FILE, part_bytes: int = PART_BYTES
) -> None:
    """Gzipped WARC files under ``folder``/file=N/start=OFFSET/, records by page_id; repeated rows are repeated records.

    A file of any length is written in parts, each by one task, that hold ``part_bytes`` and a record at most.
    """
    part = F.floor(F.col("offset") / part_bytes)
    rows = _placed(pages, per_file).withColumn("part", part)
    rows = rows.withColumn("start", F.min("offset").over(Window.partitionBy("file", "part")))
    rows = rows.sortWithinPartitions("file", "start", "offset")
    out = rows.select("file", "start", "value").write.partitionBy("file", "start")
    out.option("lineSep", END).option("compression", "gzip").text(folder)


def parse(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the unpacked file, record) of a WARC file; a record cut off at the end is returned as it is.

    It is unpacked as a stream, a record at a time.
    """
    raw = io.BytesIO(content)
    with gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw as stream:
        at = 0
        while True:
            head = bytearray()
            while not head.endswith(b"\r\n\r\n") and (line := stream.readline()):
                head += line
            if not head:
                return
            length = 0
            for line in bytes(head).split(b"\r\n"):
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length":
                    length = int(value)
            whole = head.endswith(b"\r\n\r\n")
            yield at, bytes(head) + (stream.read(length) if whole else b"")
            at += len(head) + length + len(stream.read(4))


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start, content in zip(*(batch.column(i) for i in range(3)), strict=True):
            file, start = file.as_py(), start.as_py()
            found = ((file, start + at, hashlib.sha256(rec).hexdigest()) for at, rec in parse(content.as_py()))
            while rows := list(itertools.islice(found, ROWS)):
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["file", "offset", "digest"])


def digests_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, offset, digest)`` of every record in the files that :func:`write_warc` wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return bounded_batches(files).select(F.col("file").cast("long"), F.col("start").cast("long"), "content").mapInArrow(
        _hash_files, "file long, offset long, digest string"
    )


def digests_of_pages(pages: DataFrame, per_file: int = PAGES_PER_FILE, damaged: Column | None = None) -> DataFrame:
    """What the records of these pages hash to and where they are; in ``damaged`` ones the first byte is wrong."""
    value = F.col("value")
    if damaged is not None:
        value = F.when(F.coalesce(damaged, F.lit(False)), F.overlay(value, F.lit("!"), 1, 1)).otherwise(value)
    digest = F.sha2(value.cast("binary"), 256).alias("digest")
    return _placed(pages, per_file).select("file", "offset", digest, "page_id")


def _join(child: Column, digest: Column) -> Column:
    """Hash over the children of a node in order."""
    rows = F.array_sort(F.collect_list(F.struct(child.alias("k"), digest.alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["k"].cast("string"), r["h"])), ",").cast("binary"), 256)


def tree(records: DataFrame, depth: int, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> list[DataFrame]:
    """Levels (file, node, digest): ranges first, then ``depth`` levels of ``fan`` children each, one node at last."""
    leaf = records.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("node"))
    levels = [stage(leaf.agg(_join(F.col("offset"), F.col("digest")).alias("digest")), "leaves")]
    for _ in range(depth):
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fan).alias("up"))
        up = up.agg(_join(F.col("node"), F.col("digest")).alias("digest"))
        levels.append(stage(up.withColumnRenamed("up", "node"), "nodes"))
    return levels


def root(level: DataFrame, fan: int = FAN) -> str | None:
    """Root of a replica over the roots of its files, combined ``fan`` at a time; None without records."""
    level = level.select(F.col("file").alias("node"), "digest")
    while level.where("node <> 0").limit(1).count():
        up = level.groupBy(F.expr(f"CASE WHEN node < 0 THEN -1 - (-1 - node) div {fan} ELSE node div {fan} END").alias("up"))
        level = stage(up.agg(_join(F.col("node"), F.col("digest")).alias("digest")).withColumnRenamed("up", "node"), "roots")
        if not level.where("node NOT IN (0, -1)").limit(1).count():
            break
    found = level.orderBy("node").limit(2).collect()
    return hashlib.sha256(",".join(r.digest for r in found).encode()).hexdigest() if found else None


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """``(file, offset, status, primary_digest, replica_digest)`` of records that differ, none for equal replicas.

    Status: changed, missing (not in the replica) or extra.  Both sides hold (file, offset, digest); repeated
    rows of a record count once.
    """
    sides = [stage(x.select("file", "offset", "digest").distinct(), "records") for x in (primary, replica)]
    top = max((x.agg(F.max("offset")).first()[0] or 0) // range_bytes for x in sides)
    depth = 1
    while fan**depth <= top:
        depth += 1
    left, right = (tree(x, depth, range_bytes, fan) for x in sides)

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("digest", "x").join(b.withColumnRenamed("digest", "y"), ["file", "node"], "full")
        return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file", "node")

    if root(left[-1]) == root(right[-1]):
        bad = left[0].select("file", "node").where(F.lit(False))
    else:
        bad = stage(differing(left[-1], right[-1]), "bad")
        for a, b in zip(left[-2::-1], right[-2::-1], strict=True):
            above = bad.select("file", F.col("node").alias("up"))
            near = [x.withColumn("up", F.floor(F.col("node") / fan)).join(above, ["file", "up"], "left_semi") for x in (a, b)]
            bad = stage(differing(*near), "bad")
    spot = [
        x.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["file", "node"], "left_semi")
        for x in sides
    ]
    a = spot[0].select("file", "offset", F.col("digest").alias("primary_digest"))
    b = spot[1].select("file", "offset", F.col("digest").alias("replica_digest"))
    both = a.join(b, ["file", "offset"], "full")
    status = (
        F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra").otherwise("changed")
    )
    wrong = ~F.col("primary_digest").eqNullSafe(F.col("replica_digest"))
    return both.where(wrong).select("file", "offset", status.alias("status"), "primary_digest", "replica_digest")
