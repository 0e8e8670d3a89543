"""Incremental and stateful processing: growing logs, leases on tasks, accepting each key once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType | str, format: str = "json", files_at_once: int = 100) -> DataFrame:
    """A folder of files as a stream; every file is read once, over restarts too, as the sink's checkpoint says."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(format).load(path)


def append_new(stream: DataFrame, done: Callable[[SparkSession], DataFrame | None], path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Rows whose keys are not done yet, appended as JSON lines with each batch. A batch that is repeated after a failure
    finds its own rows done."""

    def put(batch: DataFrame, _: int) -> None:
        old = done(batch.sparkSession)
        new = batch.dropDuplicates(list(keys))
        (new if old is None else new.join(old.select(*keys).distinct(), list(keys), "left_anti")).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_key(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark passes, so the state is bounded by `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


LEASE = "task_id string, worker_id string, granted boolean, expires timestamp"


def leases(stream: DataFrame, seconds: int = 300, forget: bool = True) -> DataFrame:
    """Claims (task_id, worker_id, ts, action: claim, renew or release) answered in order of time: a claim is granted if the
    task is free or its lease has run out, a renewal or release to its holder only. All claims of a task meet in one group,
    so of two in one batch one wins. The state of a task is its holder and the end of the lease; it goes at a release, and
    (`forget`) an hour after the last claim, for which the query keeps making batches: leave that off in a run that is to end."""

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        holder, end = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "worker_id"], kind="stable")
        out = []
        for worker, ts, action in zip(rows["worker_id"], rows["ts"], rows["action"]):
            now = int(ts.timestamp() * 1000)
            live = bool(holder) and now < end
            ok = (not live) if action == "claim" else holder == worker and live
            if ok:
                holder, end = ("", 0) if action == "release" else (worker, now + 1000 * seconds)
            out.append((key[0], worker, ok, pd.Timestamp(end, unit="ms") if ok and end else None))
        if holder:
            state.update((holder, end))
            if forget:
                state.setTimeoutDuration(3_600_000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["task_id", "worker_id", "granted", "expires"])

    src = stream.select("task_id", "worker_id", F.col("ts").cast("timestamp"), "action")
    return src.groupBy("task_id").applyInPandasWithState(answer, LEASE, "holder string, expires long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def recover(tasks: DataFrame, now) -> DataFrame:
    """Tasks in work whose lease has run out: pending again with one try more, or dead letters after the last; others stay."""
    out = (F.col("status") == "processing") & (F.col("lock_expires_at") <= now)
    over = F.col("retry_count") + 1 >= F.col("max_retries")
    return tasks.withColumns({"status": F.when(out & over, "dead_letter").when(out, "pending").otherwise(F.col("status")), "retry_count": F.when(out, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "lock_expires_at": F.when(~out, F.col("lock_expires_at"))})
