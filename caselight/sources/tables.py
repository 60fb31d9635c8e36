"""Reading, writing and maintaining parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.sources.schemas import COLUMN_COMMENTS, SCHEMAS


def read_table(
    spark: SparkSession, folder: str, name: str, text_dates: bool = False, fmt: str = "parquet"
) -> DataFrame:
    """One table of the model, stored as ``<folder>/<name>.<fmt>``, under its declared schema.

    ``text_dates`` reads files whose dates and timestamps are ISO text.  A
    format that keeps its own schema (such as delta, where its jar is present)
    is cast to the declared one as well.
    """
    path = f"{folder}/{name}.{fmt}"
    if text_dates or fmt != "parquet":
        df = typed(spark.read.format(fmt).load(path), SCHEMAS[name])
    else:
        df = spark.read.schema(SCHEMAS[name]).parquet(path)
    return with_comments(df, COLUMN_COMMENTS.get(name, {}))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("errorifexists").partitionBy(*partition_by).save(path)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace data and schema of a table that ``df`` does not read."""
    df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").save(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a stored table by rows derived from it.

    The new rows are complete beside the table before it is swapped, so a
    failed job leaves the old table as it was.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.next-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    here, new, backup = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, old))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here) and not fs.rename(here, backup):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, here):
        fs.rename(backup, here)
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(backup, True)
    spark.catalog.refreshByPath(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, comment: str = "") -> None:
    """Lay a fact table out by its join key.

    Tables bucketed alike on ``doc_id`` or ``call_id`` join without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    if comment:
        text = comment.replace("\\", "\\\\").replace("'", "\\'")
        df.sparkSession.sql(f"COMMENT ON TABLE {table} IS '{text}'")


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Create an empty typed table unless one is there."""
    if not table_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add NULL columns that are not there yet."""
    have = set(df.columns)
    return df.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in have}
    )


def append_missing(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks."""
    fresh = source.join(target.select(*key).distinct(), list(key), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A handful of literal rows, built in the plan without Python workers."""
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def seed_dim(existing: DataFrame, rows: Sequence[tuple], key: str) -> DataFrame:
    """Add literal rows of a dimension, only for missing keys."""
    seed = literal_rows(existing.sparkSession, rows, existing.schema)
    return append_missing(existing, seed, [key])


def update_where(df: DataFrame, cond: Column, new: Mapping[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE: every expression sees the old row."""
    return df.withColumns(
        {
            name: F.when(cond, expr).otherwise(F.col(name)) if name in df.columns else F.when(cond, expr)
            for name, expr in new.items()
        }
    )


def merge_update(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str],
    new: Mapping[str, Column],
    when: Column | None = None,
) -> DataFrame:
    """MERGE ... WHEN MATCHED [AND when] THEN UPDATE.

    ``new`` and ``when`` refer to target columns as ``t.x`` and to source
    columns as ``s.x``.  Source rows are folded per key on the exchange the
    join needs anyway; a target row met by two source rows raises, as MERGE
    does.
    """
    key = list(key)
    values = [c for c in source.columns if c not in key]
    folded = source.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.any_value(c).alias(c) for c in values]
    )
    matched = F.col("s._rows").isNotNull()
    single = F.when(F.col("s._rows") == 1, True).otherwise(
        F.raise_error(F.lit("merge source has several rows for one key")).cast("boolean")
    )
    cond = matched & single if when is None else matched & F.coalesce(when, F.lit(False)) & single
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    joined = target.alias("t").join(folded.alias("s"), on, "left")
    return joined.select(
        *[
            F.when(cond, new[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in new else F.col(f"t.{c}")
            for c in target.columns
        ]
    )


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ISO text dates and timestamps to the declared types.

    A value that does not parse becomes NULL; every other column is cast.
    """
    have = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        column = F.col(field.name)
        text = isinstance(df.schema[field.name].dataType, T.StringType)
        if text and isinstance(field.dataType, (T.DateType, T.TimestampType)):
            column = F.try_to_timestamp(column)
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, {"comment": text})
    return df


def register_view(df: DataFrame, name: str, prefix: str = "") -> str:
    """Publish ``df`` under a (prefixed) temp-view name."""
    full = f"{prefix}{name}"
    df.createOrReplaceTempView(full)
    return full
