"""Analysis jobs in batch: submission, state by events, lookups, priorities, expiry, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600
MAX_RETRIES, RETRY_DELAY, JITTER = 3, 10, 0.0


def submitted(requests: DataFrame, at: Column | None = None) -> DataFrame:
    """Job events of new requests: a fresh job_id, QUEUED. Not deterministic; requests keep their priority of 1 to 3."""
    return requests.select(F.uuid().alias("job_id"), F.lit("QUEUED").alias("status"), (at if at is not None else F.current_timestamp()).alias("updated_at"), F.lit(None).cast("string").alias("error"), "contract_id", F.greatest(F.lit(1), F.least(F.col("priority"), F.lit(3))).alias("priority"))


def latest(events: DataFrame, job: str = "job_id", at: str = "updated_at", tie: str = "event_id", columns: tuple[str, ...] = ("status",)) -> DataFrame:
    """Each job's columns as of its last event; one aggregation, no sort."""
    last = F.max_by(F.struct(at, *columns), F.struct(at, tie))
    return events.groupBy(job).agg(last.alias("s"), F.count("*").alias("events")).select(job, "s.*", "events")


def alive(states: DataFrame, now: Column, at: str = "updated_at", ttl: int = TTL_SECONDS) -> DataFrame:
    """States not older than the time they are kept."""
    return states.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl)))


def cancelled(states: DataFrame, requests: DataFrame) -> DataFrame:
    """States with CANCELLED where a request finds a job still waiting."""
    x = states.join(requests.select("job_id").distinct().withColumn("_asked", F.lit(True)), "job_id", "left")
    return x.withColumn("status", F.when(F.col("_asked") & F.col("status").isin("QUEUED", "PENDING"), "CANCELLED").otherwise(F.col("status"))).drop("_asked")


def retried(failures: DataFrame) -> DataFrame:
    """failures(job_id, attempt, ...) with next_status and delay: RETRYING with a doubled delay, FAILED after MAX_RETRIES."""
    more = F.col("attempt") < MAX_RETRIES
    return failures.withColumns({"next_status": F.when(more, "RETRYING").otherwise("FAILED"), "delay_s": F.when(more, RETRY_DELAY * F.pow(F.lit(2.0), F.col("attempt"))).cast("int")})


def lookup(jobs: DataFrame, cache: DataFrame, backend: DataFrame) -> DataFrame:
    """job_id, status, result: from the cache, else from the backend, else NOT_FOUND."""
    c = cache.select("job_id", F.col("status").alias("c_status"), F.col("result").alias("c_result"))
    b = backend.select("job_id", F.col("status").alias("b_status"), F.col("result").alias("b_result"))
    x = jobs.select("job_id").join(c, "job_id", "left").join(b, "job_id", "left")
    return x.select("job_id", F.coalesce("c_status", "b_status", F.lit("NOT_FOUND")).alias("status"), F.coalesce("c_result", "b_result").alias("result"))


def queue_order(jobs: DataFrame) -> DataFrame:
    """Jobs with place: higher priorities first, then arrival, then job_id.

    Ranked within a priority and day of arrival, and moved by the numbers of jobs of those before, so that
    no task holds more than a day's jobs of one priority; only a row for each of these is ranked alone.
    """
    x = jobs.withColumn("_day", F.to_date("arrived"))
    own = Window.partitionBy("priority", "_day").orderBy("arrived", "job_id")
    days = x.groupBy("priority", "_day").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("priority"), F.col("_day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("priority").alias("_p"), F.col("_day").alias("_d"), "_before")
    x = x.withColumn("_place", F.row_number().over(own)).join(days, F.col("priority").eqNullSafe(F.col("_p")) & F.col("_day").eqNullSafe(F.col("_d")))
    return x.withColumn("place", F.col("_place") + F.col("_before")).drop("_day", "_place", "_before", "_p", "_d")


def upserted(table: DataFrame, updates: DataFrame, key: str = "job_id") -> DataFrame:
    """table with updates of the jobs that it has; others' updates are lost, as an UPDATE by key does."""
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in table.columns if c in updates.columns and c != key)).withColumn("_hit", F.lit(True))
    x = table.join(new, key, "left")
    return x.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns and c != key else F.col(c) for c in table.columns))


def latency(events: DataFrame, value: str, by: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """An extension: exact quantiles of a value by group."""
    p = F.percentile(value, F.array(*(F.lit(q) for q in quantiles)))
    return events.groupBy(by).agg(F.count("*").alias("n"), p.alias("p")).select(by, "n", *(F.round(F.col("p")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(quantiles)))


def histogram(events: DataFrame, value: str, width: float) -> DataFrame:
    """An extension: counts by bucket of a width."""
    return events.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bucket")).agg(F.count("*").alias("n"))
