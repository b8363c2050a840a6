"""Retention by life-year and return curves from index events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.functions.columns import flag
from reprise.operators.asof import asof_join, interval_contains


def life_years(vehicles: DataFrame, start_col: str, first: dt.date, last: dt.date) -> DataFrame:
    """Fully observed 12-month intervals ``[start, end)`` of each vehicle, numbered from 1, up to its last one before
    ``last``."""
    whole = F.floor(F.months_between(F.lit(last), F.col(start_col)) / 12).cast("int") + 1
    y = vehicles.where(F.col(start_col).isNotNull()).withColumn("_years", whole).where(F.col("_years") >= 1)
    y = y.select(*vehicles.columns, F.explode(F.sequence(F.lit(1), F.col("_years"))).alias("k"))
    y = y.withColumns({"start": F.add_months(start_col, 12 * (F.col("k") - 1)), "end": F.add_months(start_col, 12 * F.col("k"))})
    return y.where((F.col("start") >= F.lit(first)) & (F.col("end") <= F.lit(last)))


def life_year_flags(years: DataFrame, maint: DataFrame, visits: DataFrame) -> DataFrame:
    """Maintenance and visit inside each interval, and maintenance in the year before."""
    y = interval_contains(years, maint, "vehicle_id", "start", "end", "event_date", "maint")
    y = interval_contains(y, visits, "vehicle_id", "start", "end", "event_date", "visit")
    w = Window.partitionBy("vehicle_id").orderBy("k")           # one row a year of the vehicle
    prev = F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag("maint").over(w))
    return y.withColumn("maint_prev", prev)


def next_after(index: DataFrame, events: DataFrame, alias: str, on: str = "start") -> DataFrame:
    """First event strictly after the index date."""
    return asof_join(index, events.select("vehicle_id", F.col("event_date").alias(alias)), "vehicle_id", on, alias, [alias], "forward")


def returned_by(next_col: str, start: str, months: int) -> Column:
    return flag(F.col(next_col) <= F.add_months(start, months))


def cycles(maint: DataFrame, vehicles: DataFrame, warranty: str, first: dt.date) -> DataFrame:
    """Service cycles: from each maintenance and from warranty starts inside the observed span."""
    a = maint.select("vehicle_id", F.col("event_date").alias("start"), F.col("customer_id").alias("cust_idx"), F.lit("maintenance").alias("origin"))
    b = (vehicles.where(F.col(warranty) >= F.lit(first))
         .select("vehicle_id", F.col(warranty).alias("start"), F.lit(None).cast("string").alias("cust_idx"), F.lit("warranty").alias("origin")))
    return a.unionByName(b)
