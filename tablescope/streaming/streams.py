"""Event-time operators on unbounded input.

Stateful operators keep their state in RocksDB (off the Java heap); ``with_rocksdb`` sets the provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablescope.functions.dates import bucket_label
from tablescope.operators.usage import TOKEN_CLASSES, with_cost
from tablescope.sources.shared import remove, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # files set aside beforehand take 4 MB per partition of state, however little it holds
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The files at ``path``, whatever their age: by default a file a week older than one read before is passed over."""
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, mode: str, path: str):
    """Work off what is there, then stop; ``sink`` gets each batch, without one batches go to parquet."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True)
    if sink is None:
        query = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        query = writer.foreachBatch(sink).start()
    query.awaitTermination()
    return query


def append_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream to its end and read what it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    run_available(stream, None, "append", path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def upsert_batches(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update-mode stream: every batch writes its changed rows once, the newest batch wins per key.

    A batch that is run again overwrites its own folder, so retries change nothing.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    run_available(stream, sink, "update", path)
    rows = spark.read.parquet(f"{path}/data")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


class _Throttle(StatefulProcessor):
    """Events wait, by key, until the watermark has passed them; then they are decided in the order of their times.

    So the result does not depend on how events are dealt into batches. State is what waits, no longer than the
    watermark's delay, and the time of the last event kept, which is forgotten once it can no longer matter. What waits is
    kept in blocks, packed numbers of up to an Arrow batch of events, so that reads and writes of state are few.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks = [np.column_stack([r["at"], r["unnamed"], r["event_id"]]).astype(np.int64) for r in rows if len(r)]
        if blocks:
            self.waiting.appendList([(b.tobytes(),) for b in blocks])
            self._wake(min(int(b[:, 0].min()) for b in blocks))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [np.frombuffer(block, np.int64).reshape(-1, 3) for (block,) in self.waiting.get()]
        waiting = np.concatenate([np.empty((0, 3), np.int64), *blocks])
        late = waiting[:, 0] > passed
        due, rest = waiting[~late], waiting[late]
        due = due[np.lexsort(due.T[::-1])]  # by time, then by id
        held = self.last.get()
        last = before = held[0] if held is not None else None
        times, kept = due[:, 0], []
        at = 0 if last is None else int(np.searchsorted(times, last + self.window_us, "right"))
        while at < len(times):
            kept.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + self.window_us, "right"))
        if kept:
            ids = pd.array(due[kept, 2], "Int64")
            ids[due[kept, 1] == 1] = pd.NA
            yield pd.DataFrame({"event_id": ids})
        if len(rest):
            self._wake(int(rest[:, 0].min()))
        if len(due):
            self.waiting.put([(rest.tobytes(),)]) if len(rest) else self.waiting.clear()
        if last is not None and last + self.window_us < passed:
            self.last.clear()
        elif last != before:
            self.last.update((last,))
            self._wake(last + self.window_us + 1)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def throttled(
    events: DataFrame, keys: list[str], ts: str, event_id: str, window_seconds: int = 120, delay: str = "10 minutes"
) -> DataFrame:
    """Ids of events kept: one is dropped if a kept event of its key is at most the window older.

    Events may come in any order within ``delay``, and are decided when the watermark, the newest time seen less ``delay``,
    has passed them: the result is that of the batch operator over all events up to there. Later ones still wait.
    Expiry must follow the kept event and not the watermark alone, so dropping duplicates within the watermark is no
    substitute.
    """
    with_rocksdb(events.sparkSession)
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(
        *keys, ts, F.unix_micros(ts).alias("at"), F.col(event_id).isNull().alias("unnamed"),
        F.coalesce(F.col(event_id), F.lit(0)).cast("long").alias("event_id"),
    ).filter(F.col(ts).isNotNull())  # the watermark never passes an event without a time
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Throttle(window_seconds * 1_000_000),
        outputStructType="event_id long",
        outputMode="Append",
        timeMode="EventTime",
    )


def bucketed_usage(
    messages: DataFrame, ts: str, sums: list[str], bucket: str = "1 hour", delay: str = "1 hour", prices: DataFrame | None = None
) -> DataFrame:
    """User messages, a sketch of the users and summed measures per tumbling bucket (update mode).

    With ``prices`` (one row per provider and model) each message gets its cost, by a join of the stream with that table, and the
    costs are summed too. Exact distinct counts cannot be kept in streaming state: ``users`` is a sketch that merges, see
    ``merged_usage``. Message ids are unique, so messages count rows.
    """
    rows = messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    if prices is not None:
        rows = with_cost(rows, prices)
        sums = [*sums, *(f"{c}_cost" for c in TOKEN_CLASSES), "total_cost"]
    out = rows.groupBy(F.window(ts, bucket).alias("w")).agg(
        F.count_if(F.col("role") == "user").alias("message_count"),
        F.hll_sketch_agg("user_id").alias("users"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )
    return out.select(F.col("w.start").alias("start"), *out.columns[1:])


def merged_usage(usage: DataFrame, granularity: str) -> DataFrame:
    """Buckets of ``bucketed_usage`` put together to coarser ones: sums add, sketches merge; ``users`` becomes their number."""
    sums = [c for c in usage.columns if c not in ("start", "users")]
    return usage.groupBy(bucket_label(F.col("start"), granularity).alias("date")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), *[F.sum(c).alias(c) for c in sums]
    )


def view_sessions(
    segments: DataFrame, keys: list[str], ts: str, duration_ms: str, gap_seconds: int = HOUR, delay: str = "1 hour"
) -> DataFrame:
    """Sessions closed so far (append mode).

    Session windows also merge when a start equals the previous end; the rule here is strictly less than
    the gap, hence one microsecond off.
    """
    rows = segments.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    micros = F.coalesce(F.col(duration_ms), F.lit(0)) * 1000 + (gap_seconds * 1_000_000 - 1)
    session = F.session_window(ts, F.concat(micros.cast("string"), F.lit(" microseconds")))
    out = rows.groupBy(*keys, session.alias("w")).agg(
        F.sum(duration_ms).alias("duration_ms"), F.count(F.lit(1)).alias("segments")
    )
    return out.select(*keys, F.col("w.start").alias("started_at"), "duration_ms", "segments")


def run_outcomes(
    starts: DataFrame, finishes: DataFrame, run: str, ts: str, minutes: int = 30, delay: str = "5 minutes"
) -> DataFrame:
    """``done`` or ``failed`` per run: one not finished within the limit has failed.

    An outer stream join inside a time range: the watermark tells when a finish can no longer come, which
    is when the unmatched start leaves the state as failed. Run ids are many, so no key grows hot.
    """
    begun = starts.select(F.col(run).alias("run_id"), F.col(ts).cast("timestamp").alias("started_at"))
    ended = finishes.select(F.col(run).alias("_run"), F.col(ts).cast("timestamp").alias("_ended_at"))
    # a literal interval: the planner reads the state bound from it
    limit = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    in_time = (
        (F.col("run_id") == F.col("_run"))
        & (F.col("_ended_at") >= F.col("started_at"))
        & (F.col("_ended_at") < F.col("started_at") + limit)
    )
    joined = begun.withWatermark("started_at", delay).join(ended.withWatermark("_ended_at", delay), in_time, "left_outer")
    return joined.select("run_id", F.when(F.col("_run").isNotNull(), "done").otherwise("failed").alias("status"))


def bucket_counts(events: DataFrame, ts: str, bucket: str, delay: str) -> DataFrame:
    """Rows per bucket; rows behind the watermark are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = rows.groupBy(F.window(ts, bucket).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def counted_with_late(events: DataFrame, ts: str, bucket: str, delay: str, label: str) -> DataFrame:
    """One row: rows seen, rows counted in a bucket, rows that came too late.

    Progress reports drops after partial aggregation, so lateness is what was read less what was counted.
    """
    spark = events.sparkSession
    path = scratch_path(spark, label)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    def count(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")

    run_available(bucket_counts(events, ts, bucket, delay), sink, "update", path)
    # what was read is counted by batch too; the query's progress remembers its last batches only
    run_available(events.select(ts), count, "append", f"{path}/count")
    seen = spark.read.parquet(f"{path}/seen").agg(F.sum("n")).first()[0] or 0
    rows = spark.read.parquet(f"{path}/data")
    newest = rows.groupBy("start").agg(F.max_by("n", "batch").alias("n"))
    counted = newest.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    return counted.select(
        F.lit(seen).cast("long").alias("seen"), "counted", (F.lit(seen) - F.col("counted")).alias("late")
    )


def refresh_results(
    stream: DataFrame, source: Callable[[], DataFrame], results: dict[str, Callable[[DataFrame], DataFrame]], target: str
) -> None:
    """Scheduled refresh: if anything new arrived, rewrite every result as a new version.

    Readers take the newest version; an interrupted refresh leaves the one before untouched.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        for name, build in results.items():
            build(source()).write.mode("overwrite").parquet(f"{target}/{name}/version={batch_id}")

    run_available(stream, sink, "append", target)


def refreshed(spark: SparkSession, target: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{target}/{name}")
    newest = rows.agg(F.max("version")).scalar()
    return rows.filter(F.col("version") == newest).drop("version")


#: How a measure is computed from rows, and how stored values of it merge.
PARTIALS = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "distinct": (F.hll_sketch_agg, F.hll_union_agg),
}


def refresh_aggregate(
    stream: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], target: str
) -> None:
    """Scheduled refresh of an aggregate from new files only: their partial aggregate is merged into the newest version.

    ``measures`` maps a name to a kind of ``PARTIALS`` and what it is taken of. A version is the merged state, one row per group;
    it follows from the one before and its batch, so a batch that is run again writes the same. The last two versions
    are kept, older ones removed.
    """
    spark = stream.sparkSession

    def version(n: int) -> str:
        return f"{target}/state/version={n}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        state = batch.groupBy(*keys).agg(*[PARTIALS[kind][0](c).alias(name) for name, (kind, c) in measures.items()])
        if batch_id:
            before = spark.read.parquet(version(batch_id - 1))
            merged = state.unionByName(before).groupBy(*keys)
            state = merged.agg(*[PARTIALS[kind][1](name).alias(name) for name, (kind, _) in measures.items()])
        state.write.mode("overwrite").parquet(version(batch_id))
        if batch_id > 1:
            remove(spark, version(batch_id - 2))

    run_available(stream, sink, "append", target)


def refreshed_aggregate(spark: SparkSession, target: str, measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """The newest version, with sketches as numbers."""
    state = refreshed(spark, target, "state")
    sketches = [name for name, (kind, _) in measures.items() if kind == "distinct"]
    return state.withColumns({name: F.coalesce(F.hll_sketch_estimate(name), F.lit(0)) for name in sketches})
