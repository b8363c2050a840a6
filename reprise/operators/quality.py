"""Data-quality rules, left-censoring and column profiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from reprise.functions.columns import count_if, flag


def rule_counts(df: DataFrame, table: str, rules: dict[str, Column], key: str = "vehicle_id") -> DataFrame:
    """Rows and distinct keys breaking each rule; rows are counted per key first, so no rule multiplies them."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_of"), *[count_if(c).alias(f"_r{i}") for i, c in enumerate(rules.values())])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cells = [F.struct(F.lit(table).alias("table"), F.lit(name).alias("rule"), total(f"_r{i}").alias("rows"),
                      count_if(F.col(key).isNotNull() & (F.col(f"_r{i}") > 0)).alias("keys"), total("_of").alias("of")) for i, name in enumerate(rules)]
    return per.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


KINDS = {"date": "date", "timestamp": "date", "timestamp_ntz": "date", "string": "categorical", "boolean": "categorical", "int": "integer", "bigint": "integer", "smallint": "integer", "double": "numeric", "float": "numeric"}


def column_profile(df: DataFrame, columns: list[str], groups: dict[str, str] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """Type, group, role and missing share of each column from a single pass; a column without a role is an input."""
    kinds, groups, roles = dict(df.dtypes), groups or {}, roles or {}
    cells = [F.struct(F.lit(c).alias("column"), F.lit(KINDS.get(kinds[c], kinds[c])).alias("type"), F.lit(groups.get(c, "other")).alias("grp"), F.lit(roles.get(c, "input")).alias("role"),
                      F.avg(F.col(c).isNull().cast("double")).alias("missing"), F.count(c).alias("known")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def history_depth(visits: DataFrame, maint: DataFrame, dates: list[dt.date]) -> DataFrame:
    """What is visible at several scoring dates: active vehicles, without maintenance, median recency.

    Each scoring date adds one conditional column to a per-vehicle aggregate, so the event table is
    read once whatever the number of dates.
    """
    def before(c: str, d: dt.date) -> Column:
        return F.col(c) < F.lit(d)

    v = visits.groupBy("vehicle_id").agg(F.min("event_date").alias("first_ev"))
    m = maint.groupBy("vehicle_id").agg(
        *[F.max(F.when(before("event_date", d), F.col("event_date"))).alias(f"last_{i}") for i, d in enumerate(dates)],
        *[count_if(before("event_date", d)).alias(f"n_{i}") for i, d in enumerate(dates)])
    j = v.join(m, "vehicle_id", "left")
    parts = []
    for i, d in enumerate(dates):
        parts.append(F.struct(F.lit(d).alias("scoring_date"), before("first_ev", d).alias("active"),
                              F.coalesce(F.col(f"n_{i}"), F.lit(0)).alias("n_prev"), F.datediff(F.lit(d), f"last_{i}").alias("recency")))
    x = j.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("active")
    return x.groupBy("scoring_date").agg(F.count(F.lit(1)).alias("active"), F.avg((F.col("n_prev") == 0).cast("double")).alias("without_maint"),
                                         F.avg("n_prev").alias("mean_maint"), F.percentile("recency", F.lit(0.5)).alias("median_recency"))


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of each side missing from the other, duplicates included."""
    only_a = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_first"))
    only_b = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_second"))
    return only_a.withColumn("only_second", only_b.scalar())
