"""Streaming jobs: first-N sequences, early warning, running and event-time counts, ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.entropy import shannon_entropy
from ..functions.scalars import MICROS, is_login, per
from ..operators.features import _mean_over
from ..operators.ordered import DAY_MICROS
from ..sources.logs import is_target_log, parse_flow_lines, type_flows
from .snapshots import Snapshots


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """Parquet files of a folder whose name matches, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.option("pathGlobFilter", name).parquet(folder)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- first N rows per address ----------------------------------------------------------------------

def _keep_earliest(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per Arrow batch, the n earliest rows of each address: no later row can be among the first n."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["us", "tie"], kind="stable").groupby("src_ip", sort=False).head(n)

    return keep


class _FirstRows(StatefulProcessor):
    """State of one address: its earliest rows so far, never more than n, or only that n rows were emitted.

    With ``idle_ms`` the state of an address goes once the watermark is that far behind its newest row, whether its
    rows were emitted or not; an address that comes back later starts anew. One timer per address stands at the
    earliest time at which that may be so and is set again if rows came meanwhile.
    """

    def __init__(self, n: int, idle_ms: int | None) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us bigint, tie bigint, item string")
        self.done = handle.getValueState("done", "done boolean")
        self.newest = handle.getValueState("newest", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, arrived, newest = self.done.exists(), [], 0
        for batch in rows:
            newest = max(newest, int(batch["us"].max()) // 1000)
            if not done:
                arrived += zip(batch["us"].tolist(), batch["tie"].tolist(), batch["item"].tolist())
                arrived = sorted(arrived, key=lambda row: row[:2])[: self.n]
        if self.idle_ms is not None:
            if not self.newest.exists():
                self.handle.registerTimer(newest + self.idle_ms)
            self.newest.update((max(newest, self.newest.get()[0] if self.newest.exists() else 0),))
        if done:
            return
        merged = [*map(tuple, self.rows.get()), *arrived][: self.n] if self.rows.exists() else arrived
        merged.sort(key=lambda row: row[:2])
        if len(merged) < self.n:
            self.rows.put([(int(us), int(tie), item) for us, tie, item in merged])
            return
        self.rows.clear()
        self.done.update((True,))
        columns = {"src_ip": [key[0]] * self.n, "rank": range(1, self.n + 1), "us": [r[0] for r in merged], "item": [r[2] for r in merged]}
        yield pd.DataFrame(columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.newest.get()[0] + self.idle_ms
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            for state in (self.rows, self.done, self.newest):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_n_stream(
    stream: DataFrame, n: int, item: Column, tie: str = "event_id", idle: str | None = None, lateness: str = "1 hour", done: DataFrame | None = None
) -> DataFrame:
    """``(src_ip, rank, us, item)``: the first n rows of each address, emitted once when complete.

    ``item`` is the text that travels with a row. A stateless step keeps n rows per address of
    every Arrow batch before the shuffle, so a heavy address reaches its state as a trickle. ``done``
    is a table of addresses that an earlier run emitted: their rows go before the shuffle.

    ``idle`` (a time like "30 days") lets addresses without rows for so long leave the state, see
    ``_FirstRows``; ``lateness`` is how long the watermark waits. Without it, state is kept for good.
    State is held in RocksDB on the executors' disks and snapshotted to the checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = stream.filter(F.col("src_ip").isNotNull() & F.col("timestamp").isNotNull())
    if done is not None:
        known = known.join(done.select("src_ip").distinct(), "src_ip", "left_anti")
    narrow = known.select(
        "src_ip", F.unix_micros("timestamp").alias("us"), F.col(tie).cast("bigint").alias("tie"), item.alias("item")
    )
    limited = narrow.mapInPandas(_keep_earliest(n), narrow.schema)
    if idle is not None:
        limited = limited.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness).select("src_ip", "us", "tie", "item", "at")
    return limited.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=_FirstRows(n, None if idle is None else int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))),
        outputStructType="src_ip string, rank int, us bigint, item string",
        outputMode="append",
        timeMode="none" if idle is None else "eventTime",
    )


SEQUENCE_ITEM = "eventid string, hour int, username string, password string"
LOGIN_ITEM = "password string"


def sequence_stream(stream: DataFrame, seq_len: int, **options) -> DataFrame:
    """The first ``seq_len`` events (of any type) of each address, as rows for the batch vectors."""
    item = F.to_json(F.struct("eventid", "hour", "username", "password"))
    rows = first_n_stream(stream, seq_len, item, **options)
    fields = F.from_json("item", SEQUENCE_ITEM)
    return rows.select("src_ip", "rank", F.timestamp_micros("us").alias("timestamp"), fields.alias("e")).select(
        "src_ip", "rank", "timestamp", "e.*"
    )


def early_warning_stream(stream: DataFrame, n: int, **options) -> DataFrame:
    """The first ``n`` logins of each address as soon as the n-th arrives."""
    logins = stream.filter(is_login("eventid"))
    rows = first_n_stream(logins, n, F.to_json(F.struct("password")), **options)
    return rows.select("src_ip", "rank", "us", F.from_json("item", LOGIN_ITEM)["password"].alias("password"))


def early_warning_features(rows: DataFrame, n: int) -> DataFrame:
    """The detection-window features of emitted login rows; usable inside ``foreachBatch``."""
    packed = rows.groupBy("src_ip").agg(
        F.array_sort(F.collect_list(F.struct("rank", "us"))).alias("r"),
        F.collect_set(F.nullif("password", F.lit(""))).alias("_passwords"),
    )
    times = F.transform("r", lambda row: row["us"])
    steps = F.zip_with(F.slice(times, 2, n), F.slice(times, 1, n - 1), lambda later, earlier: later - earlier)
    kept = F.transform(F.filter(steps, lambda d: (d > 0) & (d < DAY_MICROS)), lambda d: d / F.lit(float(MICROS)))
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, b: a + b)
    sized = packed.withColumn("_gaps", kept)
    count = F.size("_gaps")
    mean = F.when(count > 0, total(F.col("_gaps")) / count).otherwise(F.lit(0.0))
    spread = F.sqrt(total(F.transform("_gaps", lambda d: F.pow(d - F.col("avg_time_between"), 2))) / count)
    return sized.withColumn("avg_time_between", mean).select(
        "src_ip",
        F.size("_passwords").alias("unique_passwords"),
        "avg_time_between",
        F.when(count > 1, spread).otherwise(F.lit(0.0)).alias("std_time_between"),
        _mean_over(F.col("_passwords"), shannon_entropy).alias("password_entropy"),
        _mean_over(F.col("_passwords"), F.length).alias("password_length"),
        per(F.lit(n), F.size("_passwords")).alias("password_reuse"),
    )


# --- counts ------------------------------------------------------------------------------------------

def running_counts(stream: DataFrame, column: str) -> DataFrame:
    """Value counts that grow with every trigger; write in update or complete mode."""
    return stream.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def event_time_counts(stream: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Tumbling event-time counts; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "n")
    )


# --- ingest ------------------------------------------------------------------------------------------

def flow_line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Typed flows from a folder that collects flow-log files, skipped lines as empty rows with ``ok`` false; other files are left alone."""
    lines = spark.readStream.text(path, recursiveFileLookup=True)
    return type_flows(parse_flow_lines(lines.filter(is_target_log(F.col("_metadata.file_path")))), keep_skipped=True)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Process what is available and append it to Parquet, exactly once per checkpoint."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def latest_counts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Keep the changed counts of each trigger in a table of the newest row per key, see ``Snapshots``.

    A replayed batch changes nothing, so a restart after a lost executor adds nothing twice.
    """
    table = Snapshots(stream.sparkSession, path, list(keys))
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.add)
    return writer.trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The newest count per key that ``latest_counts`` has written."""
    return Snapshots(spark, path, list(keys)).read()


def scored_warnings(stream: DataFrame, n: int, model: Transformer, path: str, checkpoint: str, names: Sequence[str] = (), **options) -> StreamingQuery:
    """Score each address with a fitted model as soon as its n-th login arrives.

    ``model`` takes the columns of ``early_warning_features`` and adds ``prediction``, ``names`` are its classes. Each
    batch overwrites its own folder of ``path``, so a replayed one adds nothing twice.
    """
    classes = F.array(*map(F.lit, names))

    def score(rows: DataFrame, batch: int) -> None:
        scored = model.transform(early_warning_features(rows, n)).withColumn("prediction", F.col("prediction").cast("int"))
        if names:
            scored = scored.withColumn("predicted", F.get(classes, F.col("prediction")))
        kept = [c for c, kind in scored.dtypes if kind != "vector"]
        scored.select(kept).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    rows = early_warning_stream(stream, n, **options)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(score)
    return writer.trigger(availableNow=True).start()
