import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from caselight.operators.maintenance import STAGE_LAG
from caselight.plans import views as V
from caselight.sources import fixtures as Fx
from caselight.sources.versions import VersionedTable
from caselight.streaming import stream as St
from conftest import rows, same


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    """The events table as a folder of several files, to be read one per batch."""
    folder = tmp_path_factory.mktemp("events")
    spark.read.parquet(f"{sf}/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def stream(spark, folder):
    return Fx.document_projection(St.read_stream(spark, folder, "events", files_per_batch=1))


def test_sums_of_several_batches_equal_the_batch_view(spark, reg, split_events, tmp_path):
    sink, state = f"{tmp_path}/sink", f"{tmp_path}/state"
    St.intake_stream(stream(spark, split_events), sink, state).awaitTermination()
    assert VersionedTable(spark, sink).read().select(St.FILE).distinct().count() == 4
    columns = St.intake_base(spark, sink).columns
    same(St.intake_base(spark, sink), V.intake_daily(reg).select(*columns))
    # A second run finds nothing new.
    St.intake_stream(stream(spark, split_events), sink, state).awaitTermination()
    same(St.intake_base(spark, sink), V.intake_daily(reg).select(*columns))


def test_held_counts_keep_late_rows_and_the_newest_day(spark, reg, split_events, tmp_path):
    sink = f"{tmp_path}/sink"
    St.intake_windows(stream(spark, split_events), sink, f"{tmp_path}/state").awaitTermination()
    found = St.window_days(spark, sink)
    same(found, V.intake_daily(reg).select(*found.columns))


def test_replayed_batch_does_not_count_twice(spark, split_events, tmp_path):
    sink = f"{tmp_path}/sink"
    St.intake_stream(stream(spark, split_events), sink, f"{tmp_path}/state-a").awaitTermination()
    once = rows(St.intake_base(spark, sink))
    # Lost checkpoint: the same files come once more.
    St.intake_stream(stream(spark, split_events), sink, f"{tmp_path}/state-b").awaitTermination()
    assert rows(St.intake_base(spark, sink)) == once


def test_fresh_checkpoint_with_other_batches_counts_once(spark, reg, split_events, tmp_path):
    sink = f"{tmp_path}/sink"
    St.intake_stream(stream(spark, split_events), sink, f"{tmp_path}/state-a").awaitTermination()
    all_at_once = Fx.document_projection(St.read_stream(spark, split_events, "events"))
    St.intake_stream(all_at_once, sink, f"{tmp_path}/state-b").awaitTermination()
    columns = St.intake_base(spark, sink).columns
    same(St.intake_base(spark, sink), V.intake_daily(reg).select(*columns))


def test_lost_checkpoint_and_trimmed_source_keep_the_totals(spark, reg, split_events, tmp_path):
    sink, source = f"{tmp_path}/sink", tmp_path / "source"
    shutil.copytree(split_events, source)
    St.intake_stream(stream(spark, str(source)), sink, f"{tmp_path}/state-a").awaitTermination()
    once = rows(St.intake_base(spark, sink))
    for old in sorted((source / "events.parquet").glob("*.parquet"))[:2]:
        old.unlink()
    more = spark.read.parquet(f"{source}/events.parquet").where("event_id % 50 = 0").coalesce(1)
    more.write.mode("append").parquet(f"{source}/events.parquet")
    St.intake_stream(stream(spark, str(source)), sink, f"{tmp_path}/state-b").awaitTermination()
    base = St.intake_base(spark, sink)
    assert base.agg(F.sum("total_docs")).first()[0] == sum(r[1] for r in once) + more.count()
    before = rows(base)
    St.compact(spark, sink)
    St.intake_stream(stream(spark, str(source)), sink, f"{tmp_path}/state-c").awaitTermination()
    assert rows(St.intake_base(spark, sink)) == before


def test_empty_streams_give_typed_frames(spark, reg, split_events, tmp_path):
    none = tmp_path / "none" / "events.parquet"
    spark.read.parquet(f"{split_events}/events.parquet").limit(0).write.parquet(str(none))

    def empty():
        return stream(spark, str(tmp_path / "none")).where("false")

    St.intake_stream(empty(), f"{tmp_path}/a", f"{tmp_path}/a-state").awaitTermination()
    St.intake_windows(empty(), f"{tmp_path}/b", f"{tmp_path}/b-state").awaitTermination()
    St.cascade_stream(empty(), f"{tmp_path}/c", f"{tmp_path}/c-state").awaitTermination()
    assert rows(St.intake_base(spark, f"{tmp_path}/a")) == [] and rows(St.window_days(spark, f"{tmp_path}/b")) == []
    want = V.intake_daily(reg)
    assert St.intake_base(spark, f"{tmp_path}/a").schema["avg_quality_score"].dataType == want.schema["avg_quality_score"].dataType
    assert VersionedTable(spark, f"{tmp_path}/c").read().columns == [St.FILE, "doc_id", "payer_code", "ingestion_timestamp"]


def test_windows_upsert_changed_days_only(spark, split_events, tmp_path):
    sink = f"{tmp_path}/sink"
    St.intake_windows(stream(spark, split_events), sink, f"{tmp_path}/state", late="3650 days").awaitTermination()
    once = rows(St.window_days(spark, sink))
    folder = tmp_path / "more"
    spark.read.parquet(f"{split_events}/events.parquet").repartition(1).write.parquet(f"{folder}/events.parquet")
    St.intake_windows(stream(spark, str(folder)), sink, f"{tmp_path}/other", late="3650 days").awaitTermination()
    assert rows(St.window_days(spark, sink)) == once and len(VersionedTable(spark, sink).versions()) > 5


def test_cascade_reaches_every_stage_whichever_comes_first(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    arrivals = [("d1", "OLD", at - dt.timedelta(1), "f1"), ("d1", "NEW", at, "f0"), ("d2", "X", at, "f1"), ("d4", None, None, "f1")]
    log = spark.createDataFrame(arrivals, f"doc_id string, payer_code string, ingestion_timestamp timestamp, {St.FILE} string")
    for name, (column, minutes) in STAGE_LAG.items():
        own = [("d1", None, None), ("d2", "kept", at), ("d3", None, at), ("d4", None, at)]
        stage = spark.createDataFrame(own, f"doc_id string, payer_code string, {column} timestamp")
        later = at + dt.timedelta(minutes=minutes)
        want = [("d1", "NEW", later), ("d2", "kept", later), ("d3", None, at), ("d4", None, at)]
        assert rows(St.cascaded(stage, log, name)) == want
        assert rows(St.cascaded(stage, log.limit(0), name)) == sorted(own, key=lambda r: r[0])


def test_arrival_log_is_compacted(spark, split_events, tmp_path):
    sink = f"{tmp_path}/sink"
    St.cascade_stream(stream(spark, split_events), sink, f"{tmp_path}/state").awaitTermination()
    log = VersionedTable(spark, sink).read()
    want = rows(St.newest_arrivals(log))
    VersionedTable(spark, sink).append(log.withColumns({"ingestion_timestamp": F.lit(None).cast("timestamp"), St.FILE: F.lit("other")}))
    St.compact_arrivals(spark, sink)
    assert rows(VersionedTable(spark, sink).read()) == want and len(VersionedTable(spark, sink).versions()) == 2
