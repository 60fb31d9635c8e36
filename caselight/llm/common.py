"""Shared pieces of the training-data operators.

Conventions that hold for every operator here: input columns other than those named are ignored or
passed on unchanged; an input column that carries the name of an output column is replaced; rows without an id
are left alone (they match nothing and are kept); empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.session import materialize

# Spark removes a statement's shuffle files when it ends, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session cut by bytes, as texts may be of any length.

    A batch is held by the JVM, by the Python worker and there once more as objects.
    """
    df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, freeing the shuffle files behind it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, tag)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def drop_stage(df: DataFrame) -> None:
    """Delete the folder of a staged table that no later statement reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_tag(text: str = "text") -> Column:
    """26 bits of the text's hash: keeps rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 26) - 1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
