"""Streaming forms of the per-time-step measures. Rows later than the watermark are dropped, and counted by the query's progress."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.scratch import scratch_path

#: Regions that may be sent to all events.
MOST_REGIONS = 10_000


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream, its time a timestamp."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now, and read its output. Output and checkpoint are in the shared folder."""
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{path}/epoch=none")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/epoch={epoch:06d}")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(keep)).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/epoch=*")


def _timeout(idle_seconds: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout


def step_aggregate_stream(events: DataFrame, step: str, delay: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """Per time step (a tumbling window): rows, least, greatest and mean value, sent once the step is complete."""
    g = events.withWatermark(ts, delay).groupBy(F.window(ts, step))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "low", "high", "mean")


def multi_window_stream(events: DataFrame, regions: DataFrame, length: str, slide: str, delay: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """Per (sliding window, region): rows and mean of the values in the region's closed range. `regions` is static; over MOST_REGIONS raise."""
    e = events.withWatermark(ts, delay)
    if regions.limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError(f"at most {MOST_REGIONS} regions")
    hit = e.join(F.broadcast(regions), e[value].between(regions["low"], regions["high"]))
    g = hit.groupBy(F.window(ts, length, slide), "region").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), "region", "n", "mean")


def accumulated_deviation_stream(rows: DataFrame, pid: str = "pid", idle_seconds: int | None = None) -> DataFrame:
    """(pid, n, accumulated) after each batch, of rows (pid, t, deviation): the trapezoid integral with state by trajectory.

    The state is (n, last t, last deviation, integral), so a restart from the checkpoint goes on where it was. A batch's
    rows are put in order; rows older than the last one seen are left out. The state of a trajectory that is idle for
    `idle_seconds` is dropped, and it would start anew; by default none is.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, t0, d0, total = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        new = pd.concat(list(batches)).sort_values("t", kind="stable")
        new = new[new["t"] >= t0] if n else new
        t, d = (np.concatenate([[x0] if n else [], new[c].to_numpy(float)]) for c, x0 in (("t", t0), ("deviation", d0)))
        total += float((np.diff(t) * (d[1:] + d[:-1]) / 2).sum())
        n += len(new)
        state.update((n, float(t[-1]), float(d[-1]), total) if len(t) else (n, t0, d0, total))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame({pid: [key[0]], "n": [n], "accumulated": [total]})

    return rows.select(pid, "t", "deviation").groupBy(pid).applyInPandasWithState(add, f"{pid} long, n long, accumulated double", "n long, t double, d double, total double", "update", _timeout(idle_seconds))


def exit_detection_stream(rows: DataFrame, pid: str = "pid", idle_seconds: int | None = None) -> DataFrame:
    """(pid, steps, exited) after each batch, of rows (pid, t, inside): once a particle is outside it is stopped for good.

    The state of a particle that is idle for `idle_seconds` is dropped, and it would start anew; by default none is.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        steps, gone = state.get if state.exists else (0, False)
        if not gone:
            out = ~pd.concat(list(batches)).sort_values("t", kind="stable")["inside"].to_numpy(bool)
            gone = bool(out.any())
            steps += int(out.argmax()) if gone else len(out)
        state.update((int(steps), bool(gone)))
        if idle_seconds:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame({pid: [key[0]], "steps": [int(steps)], "exited": [bool(gone)]})

    return rows.select(pid, "t", "inside").groupBy(pid).applyInPandasWithState(watch, f"{pid} long, steps long, exited boolean", "steps long, gone boolean", "update", _timeout(idle_seconds))


def latest(table: DataFrame, pid: str = "pid") -> DataFrame:
    """The last row of each key of a table that run_to_table() wrote."""
    cols = [c for c in table.columns if c not in (pid, "epoch")]
    return table.groupBy(pid).agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select(pid, "r.*")
