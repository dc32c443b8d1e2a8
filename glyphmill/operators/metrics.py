"""Operation metrics: hourly and daily rollups, summaries, gap-free series and retention.

Events have ts, operation, project, input_tokens, output_tokens, duration_ms, failed, hits, lookups, and may have
estimated: whether their tokens are estimates, which rollups then count and summaries tell.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores

SUMS = ("operations", "failures", "input_tokens", "output_tokens", "saved_tokens", "duration_ms", "hits", "lookups")
BUCKETS = {"hourly": "HOUR", "daily": "DAY"}
SPANS = {"hourly": timedelta(hours=1), "daily": timedelta(days=1)}


@dataclass(frozen=True)
class Span:
    """start <= time < end in UTC; None is without a bound. One that runs backwards is refused."""

    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self.start > self.end:
            raise ValueError(f"a span from {self.start.isoformat()} to {self.end.isoformat()} runs backwards")

    @staticmethod
    def last_days(days: int, now: datetime | None = None) -> Span:
        now = now or datetime.now(UTC)
        return Span(now - timedelta(days=days), now)

    @staticmethod
    def all_time() -> Span:
        return Span()

    def aligned(self, granularity: str) -> Span:
        """Begins with a whole bucket; the end stays, as the last bucket may still grow."""
        if self.start is None:
            return self
        since = self.start - datetime(1970, 1, 1, tzinfo=self.start.tzinfo)
        return Span(self.start - since % SPANS[granularity], self.end)

    def of(self, rows: DataFrame, column: str, **equal) -> DataFrame:
        """The rows within; the filters reach the scan."""
        return in_window(rows, column, self.start and F.lit(self.start), self.end and F.lit(self.end), **equal)


def rollup(events: DataFrame, granularity: str) -> DataFrame:
    """Sums by bucket, project and operation; hits never exceed lookups; no project is ''."""
    return (
        events.groupBy(F.date_trunc(BUCKETS[granularity], F.col("ts")).alias("bucket"), F.coalesce("project", F.lit("")).alias("project"), "operation")
        .agg(
            F.count("*").alias("operations"),
            F.count_if(F.col("failed")).alias("failures"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.col("input_tokens") - F.col("output_tokens")).alias("saved_tokens"),
            F.sum("duration_ms").alias("duration_ms"),
            F.max("duration_ms").alias("max_duration_ms"),
            F.sum(F.least("hits", "lookups")).alias("hits"),
            F.sum("lookups").alias("lookups"),
            *([F.count_if("estimated").alias("estimated")] if "estimated" in events.columns else []),
        )
        .select(F.lit(granularity).alias("granularity"), "*")
    )


def merge(rollups: DataFrame, *keys: str) -> DataFrame:
    """Totals of rollups: sums of sums, the maximum of maxima."""
    extra = [F.sum("estimated").alias("estimated")] if "estimated" in rollups.columns else []
    return rollups.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("max_duration_ms").alias("max_duration_ms"), *extra)


def both(events: DataFrame) -> DataFrame:
    """Hourly and daily rollups; days are merged from hours, so events are read once a day's work at most."""
    hourly = rollup(events, "hourly")
    daily = merge(hourly.withColumn("bucket", F.date_trunc("DAY", "bucket")), "bucket", "project", "operation").withColumn("granularity", F.lit("daily"))
    return hourly.unionByName(daily)


def summary(totals: DataFrame, rate_per_million: float | None = None) -> DataFrame:
    """Ratios from sums: none where there is nothing to divide by. estimated becomes whether any token count was one."""
    t = totals.withColumn("estimated", F.col("estimated") > 0) if "estimated" in totals.columns else totals
    return t.select(
        "*",
        F.round(scores.reduction_ratio(F.col("input_tokens"), F.col("output_tokens")), 6).alias("reduction"),
        F.round(F.when(F.col("operations") > 0, F.col("duration_ms") / F.col("operations")), 6).alias("average_ms"),
        F.round(scores.hit_rate(F.col("hits"), F.col("lookups")), 6).alias("hit_rate"),
        F.round(scores.cost_estimate(F.greatest(F.col("saved_tokens"), F.lit(0)), rate_per_million), 6).alias("saved_cost"),
    )


def by_operation(rollups: DataFrame) -> DataFrame:
    """Totals by operation, busiest first, then by name."""
    return summary(merge(rollups, "operation")).orderBy(F.desc("operations"), "operation")


def timeseries(rollups: DataFrame, start: Column, end: Column, step: str) -> DataFrame:
    """One row for every bucket from start to end, quiet ones with zeros."""
    spark = rollups.sparkSession
    every = spark.range(1).select(F.explode(F.sequence(start, end, F.expr(f"INTERVAL 1 {step}"))).alias("bucket"))
    totals = merge(rollups, "bucket")
    zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in (*SUMS, "max_duration_ms", "estimated") if c in totals.columns}
    return F.broadcast(every).join(totals, "bucket", "left").withColumns(zeros)


def refresh(events: DataFrame, existing: DataFrame, granularity: str, correct_late: bool = False) -> DataFrame:
    """The rollups after new events. By default only the newest stored bucket and later ones are aggregated again, so
    later events of older buckets are lost; correct_late aggregates every bucket that has events."""
    unit = BUCKETS[granularity]
    fresh_events = events
    if not correct_late:
        newest = existing.where(F.col("granularity") == granularity).agg(F.max("bucket").alias("newest"))
        fresh_events = events.join(F.broadcast(newest), F.lit(True)).where(F.col("newest").isNull() | (F.date_trunc(unit, "ts") >= F.col("newest"))).drop("newest")
    return replace(existing, rollup(fresh_events, granularity))


def replace(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the rows of new in the place of those of the same key."""
    key = ["granularity", "bucket", "project", "operation"]
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


def prune(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(column) >= cutoff)


def pruned(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """How many rows prune takes away."""
    return rows.agg(F.count_if(F.col(column) < cutoff).alias("removed"))


def in_window(rows: DataFrame, column: str, start: Column | None = None, end: Column | None = None, **equal) -> DataFrame:
    """start <= column < end, and equality for every filter that is not None; all of them reach the scan."""
    if start is not None:
        rows = rows.where(F.col(column) >= start)
    if end is not None:
        rows = rows.where(F.col(column) < end)
    for k, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(k) == F.lit(v))
    return rows


def recent(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def bounds(rows: DataFrame, column: str = "ts") -> DataFrame:
    """(earliest, latest): from where rollups begin, and how far they reach."""
    return rows.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"))
