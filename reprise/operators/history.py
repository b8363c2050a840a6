"""Neighbouring rows, last known values and running counts of an event history, by a segmented scan.

Rows are dealt by ranges of (key, day, tie), so a key or a single (key, day) of any size spreads over partitions. Each
range is scanned on its own; what earlier ranges hold of the same key arrives as one carried row a key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.runtime import stored


def scan_before(df: DataFrame, by: str, order: list[Column], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
                backward: bool = False) -> DataFrame:
    """Exclusive running sums, and last non-null values, over the earlier rows of the key (``backward``: the later ones);
    rows without a key are left out.

    ``order`` ends with a unique column. A key's ranges are numbered, so the carried window sees one row a range.
    """
    sums, last = sums or {}, last or {}
    rows = df.where(F.col(by).isNotNull()).withColumns({**{f"__s_{k}": F.coalesce(c.cast("long"), F.lit(0)) for k, c in sums.items()}, **{f"__l_{k}": c for k, c in last.items()}, "__o": F.struct(*order)})
    spot = stored(rows.repartitionByRange(F.col(by), F.col("__o")).withColumn("__part", F.spark_partition_id()))
    turn = lambda c: F.col(c).desc() if backward else F.col(c).asc()
    far = F.min_by if backward else F.max_by
    own = Window.partitionBy(by, "__part").orderBy(turn("__o")).rowsBetween(Window.unboundedPreceding, -1)
    ends = spot.groupBy(by, "__part").agg(*[F.sum(f"__s_{k}").alias(f"__t_{k}") for k in sums],
                                         *[far(F.col(f"__l_{k}"), F.when(F.col(f"__l_{k}").isNotNull(), F.col("__o"))).alias(f"__e_{k}") for k in last])
    past = Window.partitionBy(by).orderBy(turn("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(by, "__part", *[F.coalesce(F.sum(f"__t_{k}").over(past), F.lit(0)).alias(f"__c_{k}") for k in sums], *[F.last(f"__e_{k}", ignorenulls=True).over(past).alias(f"__c_{k}") for k in last])
    here = spot.withColumns({**{f"__h_{k}": F.coalesce(F.sum(f"__s_{k}").over(own), F.lit(0)) for k in sums}, **{f"__h_{k}": F.last(f"__l_{k}", ignorenulls=True).over(own) for k in last}})
    out = here.join(carry, [by, "__part"])
    new = {**{k: F.col(f"__h_{k}") + F.col(f"__c_{k}") for k in sums}, **{k: F.coalesce(f"__h_{k}", f"__c_{k}") for k in last}}
    return out.select(*[c for c in df.columns if c not in new], *[c.alias(k) for k, c in new.items()])


def _neighbour(df: DataFrame, by: str, day: str, tie: str, cols: list[str], prefix: str, back: bool) -> DataFrame:
    payload = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([*cols, day])])
    out = scan_before(df.where(F.col(day).isNotNull()), by, [F.col(day).alias("o0"), F.col(tie).alias("o1")], last={"__near": payload}, backward=not back)
    return out.withColumns({f"{prefix}{c}": F.col("__near")[c] for c in cols}).drop("__near")


def previous_row(df: DataFrame, by: str, day: str, tie: str, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the row just before, in (day, tie) order within the key; null keys are left out."""
    return _neighbour(df, by, day, tie, cols, prefix, True)


def next_row(df: DataFrame, by: str, day: str, tie: str, cols: list[str], prefix: str = "next_") -> DataFrame:
    """Columns of the row just after."""
    return _neighbour(df, by, day, tie, cols, prefix, False)


def counts_before(df: DataFrame, by: str, day: str, tie: str, flags: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """Exclusive running counts of each flag over the earlier rows of the key, and last known values of ``last``."""
    rows = df.where(F.col(day).isNotNull())
    return scan_before(rows, by, [F.col(day).alias("o0"), F.col(tie).alias("o1")], {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}, last)


def change_runs(df: DataFrame, by: str, day: str, tie: str, value: str) -> DataFrame:
    """Per key: rows, distinct values and runs (1 + value changes) of a non-null value."""
    known = df.where(F.col(value).isNotNull())
    p = previous_row(known, by, day, tie, [value])
    change = F.coalesce((F.col(value) != F.col(f"prev_{value}")).cast("long"), F.lit(0))
    return p.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(value).alias("n_values"),
                             (F.sum(change) + 1).alias("n_runs"))
