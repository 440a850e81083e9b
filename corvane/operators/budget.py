"""Request budgets: how many calls a day and a run have left, as aggregates over a call log.

The log has one row per request that reached a server (run, at, input_tokens,
output_tokens). State is the log itself or its daily sums, so concurrent writers append
and nothing is read, changed and written back. A new day (UTC) begins empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class BudgetExceeded(RuntimeError):
    """The next request would exceed a cap."""


def utc_day(at: Column) -> Column:
    """The UTC date of a timestamp (the session's time zone is UTC) or of ISO text; null if unreadable."""
    return F.to_date(F.try_to_timestamp(at.cast("string")))


def daily(log: DataFrame) -> DataFrame:
    """day, request_count, input_tokens and output_tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.groupBy(utc_day(F.col("at")).alias("day")).agg(F.count("*").alias("request_count"), total("input_tokens"), total("output_tokens"))


def merged(state: DataFrame, log: DataFrame) -> DataFrame:
    """The daily state after the log's requests: sums by day, so that batches add up in any order."""
    both = state.unionByName(daily(log))
    return both.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("request_count", "input_tokens", "output_tokens")])


def decisions(log: DataFrame, per_day: int | None, per_run: int | None, order: str = "seq") -> DataFrame:
    """``log`` with allowed: whether the request was within both caps, by those before it.

    Requests count whether or not they were within the caps of another kind: what
    reached the server is spent.
    """
    day = Window.partitionBy(utc_day(F.col("at"))).orderBy("at", order)
    run = Window.partitionBy("run").orderBy("at", order)
    rows = log.withColumn("day_count", F.row_number().over(day) - 1).withColumn("run_count", F.row_number().over(run) - 1)
    fine = lambda n, cap: F.lit(True) if cap is None else F.col(n) < cap
    return rows.withColumn("allowed", fine("day_count", per_day) & fine("run_count", per_run))


def check(state: DataFrame, today: str, run_count: int, per_day: int | None, per_run: int | None) -> None:
    """Raises if one more request on ``today`` (an ISO date) would exceed a cap."""
    if per_run is not None and run_count >= per_run:
        raise BudgetExceeded(f"this run has made {run_count} of {per_run} requests")
    used = state.where(F.col("day") == F.lit(today).cast("date")).agg(F.sum("request_count")).first()[0] or 0
    if per_day is not None and used >= per_day:
        raise BudgetExceeded(f"{used} of {per_day} requests were made on {today} (UTC)")
