"""Incremental bases of the daily views.

A daily base is additive, so each micro-batch adds partial sums, one set per
source file, to a versioned table.  The file names in it are the ledger: a file
that was counted is not counted again, whether a batch is replayed or a fresh
checkpoint reads the source from its start, and what was counted stays when
the source no longer holds the file.  Late documents simply add to their day, and
no state has to be kept.  Lags and rolling means run in batch over the few daily rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselight.functions.exact import mean_of, shown
from caselight.functions.exprs import day, plus_minutes
from caselight.operators.intake import parse_docs
from caselight.operators.maintenance import STAGE_LAG
from caselight.plans import views as V
from caselight.sources.tables import merge_update
from caselight.sources.versions import VersionedTable

BatchFn = Callable[[DataFrame], DataFrame]

FILE = "source_file"  # name, size and time of the file a row came from; files of a source do not change


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table (one file or a folder of files) as a stream, with the file of each row."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    parts = ("file_path", "file_size", "file_modification_time")
    file = F.concat_ws("|", *[F.col(f"_metadata.{p}").cast("string") for p in parts])
    return reader.parquet(f"{folder}/{{{name}}}.parquet").select("*", file.alias(FILE))


def _per_batch(stream: DataFrame, sink: str, checkpoint: str, partial: BatchFn) -> StreamingQuery:
    """Append ``partial`` of each batch's new files to the table at ``sink``.

    ``partial`` keeps FILE.  A stream without that column is keyed by its query and batch.
    """
    spark = stream.sparkSession
    table = VersionedTable(spark, sink)
    if not table.exists():
        none = spark.createDataFrame([], stream.schema)
        table.create(partial(none if FILE in none.columns else none.withColumn(FILE, F.lit(""))))

    def write(batch: DataFrame, batch_id: int) -> None:
        if FILE not in batch.columns:
            query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
            batch = batch.withColumn(FILE, F.lit(f"{query}-{batch_id}"))
        counted = table.read().select(FILE).distinct()
        table.append(partial(batch).join(counted, FILE, "left_anti"))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, sink: str) -> None:
    """Rewrite a sink's many small commits as one; its rows and its ledger stay.  Run between batches."""
    table = VersionedTable(spark, sink)
    table.replace(table.read().coalesce(8))
    table.vacuum(2)


# Intake ------------------------------------------------------------------------


def intake_partial(docs: DataFrame) -> DataFrame:
    quality = F.col("quality_score")
    measures = [m for m, name in _named(V.intake_measures()) if name != "avg_quality_score"]
    return docs.groupBy(FILE, day(F.col("ingestion_timestamp")).alias("intake_date"), "payer_code").agg(
        *measures,
        F.try_sum(shown(quality)).alias("quality_sum"),
        F.count(shown(quality)).alias("quality_shown"),
        F.count(quality).alias("quality_n"),
        F.sum(quality.cast("double")).alias("quality_plain"),
    )


def _named(columns: list[Column]) -> list[tuple[Column, str]]:
    names = ["total_docs", *V.DOC_TYPE_COLUMNS, "unreadable_docs", "avg_quality_score", *V.CHANNEL_COLUMNS]
    return list(zip(columns, names))


def intake_stream(docs: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Add arriving documents to the daily intake sums."""
    return _per_batch(docs, sink, checkpoint, intake_partial)


def intake_base(spark: SparkSession, sink: str, by_payer: bool = False) -> DataFrame:
    """Daily intake rows from the sums of all batches."""
    keys = ["intake_date", "payer_code"] if by_payer else ["intake_date"]
    counts = ["total_docs", *V.DOC_TYPE_COLUMNS, "unreadable_docs"]
    n = F.sum("quality_n")
    plain = F.sum("quality_plain") / F.nullif(n, F.lit(0))
    quality = mean_of(F.try_sum("quality_sum"), F.sum("quality_shown"), n, plain, 3)
    return VersionedTable(spark, sink).read().groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts],
        quality.alias("avg_quality_score"),
        *[F.sum(c).alias(c) for c in V.CHANNEL_COLUMNS],
    )


def intake_windows(docs: DataFrame, sink: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Daily counts held as streaming state; the days a batch changed are put in place of those in the sink.

    Without ``late`` a document counts for its day however late it comes, and a day is one row of state for good.
    With it (an interval) UTC days older than that are let go of and documents of such days no longer count here.
    """
    measures = [m for m, name in _named(V.intake_measures()) if name != "avg_quality_score"]
    if late:
        recent = docs.withWatermark("ingestion_timestamp", late)
        daily = recent.groupBy(F.window("ingestion_timestamp", "1 day").alias("_day")).agg(*measures)
        daily = daily.select(day(F.col("_day.start")).alias("intake_date"), "*").drop("_day")
    else:
        daily = docs.groupBy(day(F.col("ingestion_timestamp")).alias("intake_date")).agg(*measures)
    table = VersionedTable(docs.sparkSession, sink)
    if not table.exists():
        table.create(docs.sparkSession.createDataFrame([], daily.schema), ["intake_date"])

    def upsert(changed: DataFrame, _: int) -> None:
        table.replace_partitions(changed)

    return (
        daily.writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def window_days(spark: SparkSession, sink: str) -> DataFrame:
    """The days of :func:`intake_windows` as last seen; readers meet whole batches only."""
    return VersionedTable(spark, sink).read()


# Data quality --------------------------------------------------------------------


def quality_stream(docs: DataFrame, extract: BatchFn, sink: str, checkpoint: str) -> StreamingQuery:
    """Add arriving documents to the daily quality counts.

    ``extract`` gives the structured rows of a batch of documents.
    """

    def partial(batch: DataFrame) -> DataFrame:
        code = F.col("parse_error_code") if "parse_error_code" in batch.columns else None
        parsed = parse_docs(batch, code, keep=[FILE])
        flags = extract(batch).select("doc_id", "missing_dob", "missing_ssn4")
        return (
            parsed.join(flags, "doc_id", "left")
            .groupBy(FILE, day(F.col("ingest_ts")).alias("parse_date"))
            .agg(*V.quality_counts())
        )

    return _per_batch(docs, sink, checkpoint, partial)


def quality_base(spark: SparkSession, sink: str) -> DataFrame:
    counts = [
        "total_docs", "unreadable_count", "missing_dob_count", "missing_ssn4_count", "docs_with_parse_error",
    ]
    return VersionedTable(spark, sink).read().groupBy("parse_date").agg(*[F.sum(c).alias(c) for c in counts])


# Cascade ---------------------------------------------------------------------------


def cascade_stream(docs: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Log payer and intake time of arriving documents.

    Stage tables are not rewritten per batch, and stage rows need not be there yet: :func:`cascaded` puts the newest
    arrival of each document on the rows of a stage when it is read, so either may come first and however late.
    """
    return _per_batch(docs, sink, checkpoint, lambda b: b.select(FILE, "doc_id", "payer_code", "ingestion_timestamp"))


def newest_arrivals(log: DataFrame) -> DataFrame:
    """One row per document: that of the latest intake time, then of the later file name."""
    order = [F.col("ingestion_timestamp").desc_nulls_last(), F.col(FILE).desc_nulls_last(), F.col("payer_code").desc_nulls_last()]
    newest = W.partitionBy("doc_id").orderBy(*order)
    return log.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") == 1).drop("_k")


def compact_arrivals(spark: SparkSession, sink: str) -> None:
    """Keep each document's newest arrival only.

    A file whose rows all went may be logged once more by a fresh checkpoint; its rows are older and stay without effect.
    """
    table = VersionedTable(spark, sink)
    table.replace(newest_arrivals(table.read()))
    table.vacuum(2)


def cascaded(stage: DataFrame, log: DataFrame, name: str) -> DataFrame:
    """Rows of stage table ``name`` with the payer of their document where they have none, and its intake time plus
    the stage's minutes where that is known."""
    column, minutes = STAGE_LAG[name]
    later = plus_minutes(F.col("s.ingestion_timestamp"), minutes)
    new = {
        "payer_code": F.coalesce("t.payer_code", "s.payer_code"),
        column: F.coalesce(later, F.col(f"t.{column}")),
    }
    return merge_update(stage, newest_arrivals(log).drop(FILE), ["doc_id"], new)
