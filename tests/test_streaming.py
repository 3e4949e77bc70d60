"""Streams over the same rows as their batch twins."""

import pytest
from pyspark.sql import functions as F

from landgrid.fixtures import fixture
from landgrid.streaming import events as ev

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    batch = fixture(spark, SF, "tile_events")
    batch.repartition(3).write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return batch, stream


def drain(frame, name, mode, tmp_path):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_progress_reaches_the_totals(spark, source, tmp_path):
    batch, stream = source
    last = {}
    for r in drain(ev.progress_stream(stream, 10**6), "progress", "update", tmp_path).collect():
        last[r.job_id] = max(last.get(r.job_id, (0, 0)), (r.completed, r.bytes))
    assert last == {r.job_id: (r["count"], r.b) for r in batch.groupBy("job_id").agg({"*": "count", "nbytes": "sum"}).toDF("job_id", "count", "b").collect()}


def test_throughput_equals_its_batch(spark, source, tmp_path):
    batch, stream = source
    got = drain(ev.throughput(stream), "throughput", "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.throughput(batch).collect()))


def test_late_tiles_are_dropped(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS job_id, 1L AS x, 1L AS y, 'ok' AS status, 5L AS nbytes, timestamp'2026-01-01 10:00:00' AS ts")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for minutes in (0, 60, 1):  # one run for each arrival; the third is far behind the watermark
        rows.selectExpr("job_id", "x", "y", "status", "nbytes", f"ts + make_interval(0, 0, 0, 0, 0, {minutes}) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ev.throughput(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.minute.minute, r.n) for r in got.collect()] == [(0, 1)]


def test_exactly_once(spark, source, tmp_path):
    batch, _ = source
    path = str(tmp_path / "all")
    batch.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)  # one trigger, so nothing is late
    got = {tuple(r) for r in drain(ev.completed_once(stream), "once", "append", tmp_path).collect()}
    assert got == {tuple(r) for r in ev.completed_once(batch).collect()}


def test_upserts_keep_the_latest_state(spark, source, tmp_path):
    batch, stream = source
    ev.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    newest = ev.logged(spark, f"{tmp_path}/out", ev.latest_states)
    want = batch.selectExpr("job_id", "struct(ts, event_id) AS seq", "status").groupBy("job_id").agg({"seq": "max"})
    assert newest.count() == want.count()
    assert {(r.job_id, r.seq) for r in newest.collect()} == {(r.job_id, r["max(seq)"]) for r in want.collect()}
    assert ev.failed(stream).isStreaming


def test_change_log_with_snapshots(spark, source, tmp_path):
    batch, stream = source
    got = {}
    for every in (1, 2, 20):
        ev.status_stream(stream, str(tmp_path / f"out{every}"), str(tmp_path / f"cp{every}"), {"availableNow": True}, every).awaitTermination(120)
        got[every] = sorted(map(tuple, ev.status_rows(spark, f"{tmp_path}/out{every}").collect()))
    want = batch.groupBy("job_id").agg(F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "failed"), F.sum("nbytes"), F.max("ts"))
    assert got[1] == got[2] == got[20] == sorted(map(tuple, want.collect()))
    assert {r.upto for r in spark.read.parquet(f"{tmp_path}/out2/snapshot").select("upto").distinct().collect()} == {0, 2}


def test_late_tiles_are_set_aside(spark, tmp_path):
    batch = fixture(spark, SF, "tile_events")
    path = str(tmp_path / "ordered")
    for k, (lo, hi) in enumerate(((0, 0.3), (0.3, 0.6), (0.6, 2))):  # three arrivals in order of time
        a, b = batch.selectExpr(f"percentile_approx(unix_micros(ts), {lo}, 10000)", f"percentile_approx(unix_micros(ts), {min(hi, 1)}, 10000)").first()
        part = batch.where((F.unix_micros("ts") > (a if k else -1)) & (F.unix_micros("ts") <= b))
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(batch.schema).parquet(path)
        rows = ev.late_stream(stream, 20, 24 * 60).writeStream.format("parquet").option("path", str(tmp_path / "late")).option("checkpointLocation", str(tmp_path / "state"))
        rows.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "late")).collect()
    want = ev.late_tiles(batch, 20, 24 * 60).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.reason for r in want} == {None, "done", "idle"}


def test_sums_in_order_carry_over_hours(spark):
    rows = [(1 if i % 3 else None, i, f"2026-01-01 {i % 24:02d}:{i * 7 % 60:02d}:00", "failed" if i * i % 5 else "ok") for i in range(200)]
    events = spark.createDataFrame(rows, "job_id long, event_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: (r.n, r.previous, r.total) for r in ev.in_order(events, {"n": F.lit(1)}).collect()}
    for job in (1, None):
        own = sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1]))
        assert [got[r[1]][0] for r in own] == list(range(len(own))) and {got[r[1]][2] for r in own} == {len(own)}
        assert [str(got[r[1]][1]) for r in own[1:]] == [r[2] for r in own[:-1]]
