"""Jobs over tile events. Functions take a batch or a stream unless they say that they are the batch twin of a stream job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def _n(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def coverage(events: DataFrame) -> DataFrame:
    """Sampled, placeholder, errored and covered tiles of each job; if every probe failed the ratio is 1, so that the job goes on."""
    c = events.groupBy("job_id").agg(F.count("*").alias("sampled"), _n("placeholder").alias("placeholder"), _n("failed").alias("errored"))
    c = c.withColumn("covered", F.expr("sampled - placeholder - errored"))
    ratio = F.when(F.col("errored") == F.col("sampled"), 1.0).otherwise(F.col("covered") / F.greatest(F.expr("sampled - errored"), F.lit(1)))
    return c.select("*", F.round(ratio, 6).alias("ratio"), (ratio >= 0.34).alias("proceed"))


def outcome_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(_n("ok").alias("wrote"), _n("placeholder").alias("skipped"), _n("failed").alias("failed"))


def job_totals(events: DataFrame) -> DataFrame:
    """Completed tiles, bytes and the failed events' ids in order."""
    lost = F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("event_id")))), ",")
    return events.groupBy("job_id").agg(_n("ok").alias("completed"), F.sum("nbytes").alias("bytes"), lost.alias("failed"))


def latest_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest ``seq`` of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def history(old: DataFrame, new: DataFrame, keys: list[str], seq: str, cap: int) -> DataFrame:
    """Upsert of ``new`` into ``old`` by key, newest first, at most ``cap`` entries."""
    return latest_per_key(old.unionByName(new), keys, seq).orderBy(F.desc(seq)).limit(cap)


def in_order(events: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``events`` with, for each event, the sums over its job's earlier events by (ts, event_id), ``previous``, the time of the one
    before, and ``first`` and ``total``, its job's first time and number of events.

    Sums are taken within an hour of a job and carried on over the hours, so that no task sorts a whole job.
    """
    rows = events.withColumns({"slot": F.floor(F.unix_micros("ts") / 3_600_000_000), **{f"own_{k}": v for k, v in sums.items()}})
    hours = rows.groupBy("job_id", "slot").agg(F.max("ts").alias("last"), F.min("ts").alias("start"), F.count("*").alias("n"), *[F.sum(f"own_{k}").alias(f"hour_{k}") for k in sums])
    job = Window.partitionBy("job_id")
    before = job.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(
        F.col("job_id").alias("of"), F.col("slot").alias("at"), F.max("last").over(before).alias("last"), F.min("start").over(job).alias("first"), F.sum("n").over(job).alias("total"),
        *[F.coalesce(F.sum(f"hour_{k}").over(before), F.lit(0)).alias(f"hour_{k}") for k in sums],
    )
    both = rows.join(carried, F.col("job_id").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
    hour = Window.partitionBy("job_id", "slot").orderBy("ts", "event_id")
    earlier = hour.rowsBetween(Window.unboundedPreceding, -1)
    return both.select(
        *events.columns, "first", "total", F.coalesce(F.lag("ts").over(hour), "last").alias("previous"),
        *[(F.col(f"hour_{k}") + F.coalesce(F.sum(f"own_{k}").over(earlier), F.lit(0))).alias(k) for k in sums],
    )


def progress_batch(events: DataFrame) -> DataFrame:
    """Batch twin of ``progress_stream``: completed, speed and remaining seconds after each event."""
    t = in_order(events.select("job_id", "event_id", "ts", "nbytes"), {"before": F.lit(1), "sent": F.col("nbytes")})
    elapsed = (F.unix_micros("ts") - F.unix_micros("first")) / 1000000.0
    t = t.select("job_id", "event_id", (F.col("before") + 1).alias("completed"), "total", (F.col("sent") + F.col("nbytes")).alias("bytes"), elapsed.alias("elapsed"))
    eta = F.when(F.col("completed") == F.col("total"), 0.0).otherwise(F.col("elapsed") * F.expr("total - completed") / F.greatest("completed", F.lit(1)))
    return t.select("job_id", "event_id", "completed", "total", F.round(F.col("bytes") / 1000000.0 / F.greatest("elapsed", F.lit(0.01)), 6).alias("mb_per_s"), F.round(eta, 3).alias("eta_s"))


def progress_stream(events: DataFrame, total: int) -> DataFrame:
    """Stateful progress of each job of ``total`` tiles: four numbers of state, one row for each job and trigger."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, size, first, last = state.get if state.exists else (0, 0, None, None)
        for f in frames:
            micros = f.ts.astype("int64") // (1000 if "ns" in str(f.ts.dtype) else 1)
            done, size = done + len(f), size + int(f.nbytes.sum())
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
            last = int(micros.max()) if last is None else max(last, int(micros.max()))
        state.update((done, size, first, last))
        elapsed = (last - first) / 1e6
        yield pd.DataFrame({
            "job_id": [key[0]], "completed": [done], "bytes": [size], "mb_per_s": [size / 1e6 / max(elapsed, 0.01)],
            "eta_s": [0.0 if done >= total else elapsed * (total - done) / max(done, 1)],
        })

    return events.select("job_id", "ts", "nbytes").groupBy("job_id").applyInPandasWithState(
        step, "job_id long, completed long, bytes long, mb_per_s double, eta_s double",
        "done long, size long, first long, last long", "update", GroupStateTimeout.NoTimeout,
    )


def throttled(events: DataFrame) -> DataFrame:
    """The last event of each job in each quarter of a second."""
    slot = F.floor(F.unix_micros("ts") / 250000)
    return events.groupBy("job_id", slot.alias("slot")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("events"))


def throughput(events: DataFrame) -> DataFrame:
    """Tiles, bytes and failures of each job and minute. A stream's watermark drops events ten minutes late."""
    if events.isStreaming:
        events = events.withWatermark("ts", LATE)
    out = events.groupBy("job_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.sum("nbytes").alias("bytes"), _n("failed").alias("failed"))
    return out.select("job_id", F.col("w.start").alias("minute"), "n", "bytes", "failed")


def completed_once(events: DataFrame) -> DataFrame:
    """Each finished tile of a job once, however often it was logged."""
    done = events.where("status = 'ok'")
    if events.isStreaming:
        return done.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["job_id", "x", "y"]).select("job_id", "x", "y")
    return done.select("job_id", "x", "y").distinct()


def lifecycle(events: DataFrame) -> DataFrame:
    """The latest state of each job (batch twin of ``upsert_stream``)."""
    state = F.when(F.col("status") == "ok", "in_progress").when(F.col("status") == "failed", "failed").otherwise("completed")
    return events.groupBy("job_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"))


def change_log(events: DataFrame, path: str, checkpoint: str, changes: Callable, merge: Callable, trigger: dict | None = None, every: int = 20) -> StreamingQuery:
    """Keep a table by key as a log of changes: each micro-batch writes the rows of the keys that it touches, ``log/batch=N``, and
    only every ``every`` batches all keys, ``snapshot/upto=N``, merged from the snapshot before and the log since.

    ``changes(batch)`` gives a row a key, ``merge(rows)`` makes one of several. A batch that is run again writes the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        changes(batch).write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        if number % every == 0:
            logged(batch.sparkSession, path, merge, number).write.mode("overwrite").parquet(f"{path}/snapshot/upto={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def logged(spark: SparkSession, path: str, merge: Callable, upto: int | None = None) -> DataFrame:
    """The table that ``change_log`` keeps: its newest snapshot and the log since (the state before and with batch ``upto``)."""
    log = spark.read.parquet(f"{path}/log")
    if upto == 0:
        return log.where("batch = 0").drop("batch")
    kept = spark.read.parquet(f"{path}/snapshot")
    if upto is not None:
        kept, log = kept.where(F.col("upto") < upto), log.where(F.col("batch") <= upto)
    newest = kept.agg(F.max("upto")).first()[0]
    return merge(kept.where(F.col("upto") == newest).drop("upto").unionByName(log.where(F.col("batch") > newest).drop("batch")))


def latest_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def upsert_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, every: int = 20) -> StreamingQuery:
    """Keep the latest state of every job as a ``change_log``; ``logged(spark, path, latest_states)`` reads it."""
    return change_log(events, path, checkpoint, lambda batch: latest_states(batch.select("job_id", F.struct("ts", "event_id").alias("seq"), "status")), latest_states, trigger, every)


def summed_states(rows: DataFrame) -> DataFrame:
    return rows.groupBy("job_id").agg(*[F.sum(c).alias(c) for c in ("completed", "failed", "bytes")], F.max("at").alias("at"))


def status_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, every: int = 20) -> StreamingQuery:
    """A status row for each job, brought up to date every five seconds: finished and failed tiles, bytes, last event. Kept as
    a ``change_log``, so a trigger's work follows its events, not the number of jobs."""

    def changes(batch: DataFrame) -> DataFrame:
        return batch.groupBy("job_id").agg(_n("ok").alias("completed"), _n("failed").alias("failed"), F.sum("nbytes").alias("bytes"), F.max("ts").alias("at"))

    return change_log(events, path, checkpoint, changes, summed_states, trigger or {"processingTime": "5 seconds"}, every)


def status_rows(spark: SparkSession, path: str) -> DataFrame:
    """The newest status row of each job."""
    return logged(spark, path, summed_states)


def failure_runs(events: DataFrame, least: int = 30) -> DataFrame:
    """Runs of at least ``least`` failures in a row of a job: failures with as many other events before them."""
    bad = F.col("status") == "failed"
    some = in_order(events.select("job_id", "event_id", "ts", "status"), {"island": F.when(bad, 0).otherwise(1)}).where(bad)
    runs = some.groupBy("job_id", "island").agg(F.min("event_id").alias("first_event"), F.count("*").alias("run"))
    return runs.where(F.col("run") >= least).select("job_id", "first_event", "run")


def late_tiles(events: DataFrame, total: int, idle_minutes: int) -> DataFrame:
    """``(job_id, event_id, late, reason)`` for every event: a job is over once it has ``total`` finished tiles (``done``) or heard
    nothing for ``idle_minutes`` (``idle``); what comes later is late and set aside, not lost. Batch twin of ``late_stream``."""
    known = in_order(events.select("job_id", "event_id", "ts", "status"), {"done": F.when(F.col("status") == "ok", 1).otherwise(0)})
    gap = F.coalesce(F.unix_micros("ts") - F.unix_micros("previous") > idle_minutes * 60_000_000, F.lit(False))
    known = in_order(known.select("job_id", "event_id", "ts", "done", gap.alias("gap")), {"gaps": F.col("gap").cast("int")})
    reason = F.when(F.col("done") >= total, "done").when((F.col("gaps") > 0) | F.col("gap"), "idle")
    return known.select("job_id", "event_id", reason.isNotNull().alias("late"), reason.alias("reason"))


def late_stream(events: DataFrame, total: int, idle_minutes: int) -> DataFrame:
    """Marks late events of a stream that arrives in order: a job's state is its finished tiles, its last time and whether it is
    over. A timer on event time closes a job that has gone quiet; its state stays, so that what comes later is known as late."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, last, idle = state.get if state.exists else (0, None, False)
        if state.hasTimedOut:
            state.update((done, last, True))
            return
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        micros = f.ts.astype("int64") // (1000 if "ns" in str(f.ts.dtype) else 1)
        out = []
        for event, status, at in zip(f.event_id, f.status, micros, strict=True):
            idle = idle or last is not None and at - last > idle_minutes * 60_000_000
            reason = "done" if done >= total else "idle" if idle else None
            out.append((key[0], event, reason is not None, reason))
            done, last = done + (status == "ok"), int(at)
        state.update((int(done), last, bool(idle)))
        if not idle:
            state.setTimeoutTimestamp(max(last // 1000 + idle_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "event_id", "late", "reason"])

    keyed = events.select("job_id", "event_id", "ts", "status").withWatermark("ts", "0 seconds").groupBy("job_id")
    return keyed.applyInPandasWithState(step, "job_id long, event_id long, late boolean, reason string", "done long, last long, idle boolean", "append", GroupStateTimeout.EventTimeTimeout)


def failed(events: DataFrame) -> DataFrame:
    return events.where("status = 'failed'").select("event_id", "job_id", "x", "y")


def monitor(events: DataFrame, target: int) -> DataFrame:
    """Hourly polls: successes so far, change against the poll before, whether the target is reached. Hours are few and counted first."""
    hours = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(_n("ok").alias("ok")).select(F.col("w.start").alias("hour"), "ok")
    w = Window.orderBy("hour")
    return hours.select("hour", F.sum("ok").over(w).alias("successes"), (F.col("ok") - F.coalesce(F.lag("ok").over(w), F.lit(0))).alias("delta"), (F.sum("ok").over(w) >= target).alias("reached"))


def run_log(lines: DataFrame) -> DataFrame:
    """Last ``done``, first ``error`` and last ``stage`` number of each run, from JSON lines with noise between."""
    j = lines.where("line LIKE '{%'").select("run_id", F.from_json("line", "type string, n long").alias("j")).select("run_id", "j.*")
    of = lambda t: F.when(F.col("type") == t, F.col("n"))
    return j.groupBy("run_id").agg(F.max(of("done")).alias("last_done"), F.min(of("error")).alias("first_error"), F.max(of("stage")).alias("last_stage"))
