"""Global order statistics without a single-task window.

``number_rows`` range-partitions on the full sort key, sorts inside partitions and materialises the
result once in the checkpoint folder, so that partition contents cannot change between the pass
that counts partitions and the pass that uses the offsets. Offsets are a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.runtime import cut_lineage

_LOCAL_BITS = 33                  # monotonically_increasing_id: partition << 33 | position


def number_rows(df: DataFrame, order: list[Column], alias: str = "rn") -> DataFrame:
    """Add the 1-based global position under ``order`` (end it with a unique column)."""
    spot = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("__mid", F.monotonically_increasing_id()))
    spot = cut_lineage(spot)
    part = F.shiftright(F.col("__mid"), _LOCAL_BITS)
    pos = F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    spot = spot.withColumns({"__part": part, "__idx": pos})
    sizes = spot.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__part", (F.sum("__size").over(Window.partitionBy(F.lit(0)).orderBy("__part")
                                                         .rowsBetween(Window.unboundedPreceding, 0))
                                     - F.col("__size")).alias("__off"))
    # one row per shuffle partition: bounded by the session's partition count
    return (spot.join(F.broadcast(offsets), "__part")
            .withColumn(alias, F.col("__off") + F.col("__idx") + 1)
            .drop("__mid", "__part", "__idx", "__off"))


def rank_within(df: DataFrame, group: list[str], order: list[Column], alias: str = "rn") -> DataFrame:
    """Position inside each group, for groups of any size."""
    numbered = number_rows(df, [*[F.col(g).asc_nulls_first() for g in group], *order], "__g")
    first = numbered.groupBy(*group).agg(F.min("__g").alias("__first"))
    renamed = first.withColumnsRenamed({g: f"_k_{g}" for g in group})
    cond = F.lit(True)
    for g in group:
        cond &= F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    return (numbered.join(renamed, cond).withColumn(alias, F.col("__g") - F.col("__first") + 1)
            .drop("__g", "__first", *[f"_k_{g}" for g in group]))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None,
                   ) -> DataFrame:
    """Inclusive running sums of ``sums`` (source -> alias) in global order, optionally per group.

    Each range partition is summed on its own; earlier partitions arrive as an offset per group.
    """
    group = group or []
    spot = (df.repartitionByRange(*[F.col(g).asc_nulls_first() for g in group], *order)
            .withColumn("__part", F.spark_partition_id()))
    spot = cut_lineage(spot)
    sizes = spot.groupBy(*group, "__part").agg(*[F.sum(s).alias(f"_s_{a}") for s, a in sums.items()])
    earlier = (Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(g).alias(f"_k_{g}") for g in group], F.col("__part").alias("_kp"),
                           *[F.coalesce(F.sum(f"_s_{a}").over(earlier), F.lit(0)).alias(f"_o_{a}") for a in sums.values()])
    local = (Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = spot.withColumns({f"_l_{a}": F.sum(s).over(local) for s, a in sums.items()})
    cond = F.col("__part") == F.col("_kp")
    for g in group:
        cond &= F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    out = out.join(offsets, cond).withColumns({a: F.col(f"_o_{a}") + F.col(f"_l_{a}") for a in sums.values()})
    return out.select(*df.columns, *sums.values())


def average_rank(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Average rank of each distinct value (ties share the mean of their positions)."""
    group = group or []
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, [F.col(value).asc()], {"_n": "_cum"}, group)
    return cum.select(*group, value, (F.col("_cum") - (F.col("_n") - 1) / 2).alias("rank"))


def equal_count_bin(rn: Column, total: Column, n_bins: int) -> Column:
    """0-based bin of an ascending row number under equal-count quantile edges."""
    return F.greatest(F.ceil((rn - 1) * n_bins / F.greatest(total - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


def decile(rn: Column, total: Column, n_bins: int = 10) -> Column:
    """1-based decile of a descending row number: floor(i * bins / N) + 1 with i from 0."""
    return (F.floor((rn - 1) * n_bins / total) + 1).cast("int")
