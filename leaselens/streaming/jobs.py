"""Job messages as streams: parsing, error routing, state with expiry, idempotent sinks, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import QUEUE_REQUEST

STATE = "status string, updated_at timestamp, events bigint"
OUTPUT = "job_id string, status string, updated_at timestamp, events bigint, expired boolean"


def messages(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """value: lines of files as they arrive, few at a time."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def kafka_messages(spark: SparkSession, servers: str, topic: str, most: int = 10_000) -> DataFrame:
    """value: the messages of a topic, at most that many in a batch. Needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(most), "startingOffsets": "earliest"}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with snake-case names, and error records of what is no request. Both names of a field are accepted."""
    schema = QUEUE_REQUEST + ", task_id string, s3_key string, user_id bigint, contract_text string, created_at timestamp_ntz, _bad string"
    x = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("m"))
    both = (("task_id", "taskId"), ("s3_key", "s3Key"), ("user_id", "userId"), ("contract_text", "contractText"), ("created_at", "createdAt"))
    x = x.select("value", F.col("m._bad").alias("bad"), *(F.coalesce(f"m.{a}", f"m.{b}").alias(a) for a, b in both))
    wrong = F.col("bad").isNotNull() | F.col("task_id").isNull()
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("invalid JSON: "), F.left("value", F.lit(200)))).otherwise("no task id")
    return x.where(~wrong).drop("bad", "value"), x.where(wrong).select("task_id", F.lit("FAILED").alias("status"), error.alias("error"))


def results(rows: DataFrame, key: str) -> DataFrame:
    """key, value: messages for a result queue, null fields left out, times as ISO text."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        status, at, n = state.get
        state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_at": [at], "events": [n], "expired": [True]})
        return
    status, at, n = state.get if state.exists else (None, None, 0)
    for b in batches:
        b = b.sort_values(["updated_at", "status"])
        n += len(b)
        last = b.iloc[-1]
        if at is None or last.updated_at >= at:
            status, at = last.status, last.updated_at
    state.update((status, at, n))
    state.setTimeoutDuration(3_600_000)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_at": [at], "events": [n], "expired": [False]})


def states(events: DataFrame) -> DataFrame:
    """Each job's last status after every batch that touches it; a job untouched for an hour comes out once more, expired, and is forgotten.

    events(job_id, status, updated_at).
    """
    by = events.select("job_id", "status", "updated_at").groupBy("job_id")
    return by.applyInPandasWithState(_step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def _upsert(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return write


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream to path: with once, what is there now. A stream with state that expires by the clock never ends so; it is to be stopped."""
    writer = stream.writeStream.outputMode("update").foreachBatch(_upsert(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def table_of(spark: SparkSession, path: str, key: str = "job_id") -> DataFrame:
    """The last row of each key among all batches."""
    rows = spark.read.parquet(f"{path}/*")
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("r")).select(key, "r.*")


def with_retries(send: Callable[[DataFrame], None], failed_path: str, retries: int = 3) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a batch that keeps failing goes to failed_path and the stream goes on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        error = None
        for _ in range(retries + 1):
            try:
                send(batch)
                error = None
                break
            except Exception as e:  # any failure of the sink counts
                error = f"{type(e).__name__}: {e}"
        if error:
            batch.withColumn("error", F.lit(error[:500])).write.mode("overwrite").parquet(f"{failed_path}/batch={number:012d}")
        batch.unpersist()

    return write


def jdbc_sink(options: dict[str, str]) -> Callable[[DataFrame], None]:
    return lambda batch: batch.write.format("jdbc").options(**options).mode("append").save()


def jdbc_update(spark: SparkSession, options: dict[str, str], key: str) -> Callable[[DataFrame], None]:
    """For with_retries(): sets the other columns of the rows that a batch's keys name; keys that the table lacks are passed over, and a batch may be run again.

    A batch is sent in one transaction by the driver, in rows of a job each: for status changes, not for bulk loads.
    """

    def send(batch: DataFrame) -> None:
        rest = [c for c in batch.columns if c != key]
        jvm = spark._jvm
        if "driver" in options:
            jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        link = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user", ""), options.get("password", ""))
        try:
            link.setAutoCommit(False)
            quoted = lambda c: f'"{c}"'
            statement = link.prepareStatement(f"UPDATE {options['dbtable']} SET {', '.join(quoted(c) + ' = ?' for c in rest)} WHERE {quoted(key)} = ?")
            for row in batch.toLocalIterator():
                for i, c in enumerate([*rest, key], 1):
                    statement.setObject(i, row[c]) if row[c] is not None else statement.setNull(i, 12)
                statement.addBatch()
            statement.executeBatch()
            link.commit()
        finally:
            link.close()

    return send


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums by window and type; events later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: a user's events with no longer pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


class Consumer:
    """Starts and stops a stream once."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start, self.query = start, None

    def start(self) -> StreamingQuery:
        if self.query is None or not self.query.isActive:
            self.query = self._start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
