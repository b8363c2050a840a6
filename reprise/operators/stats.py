"""Distribution and rate tables that stay distributed for any group size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.functions.columns import flag

BINS_PER_UNIT = 256


def _bin(v: Column) -> Column:
    """Monotone, data-independent bin of a double: signed logarithmic scale."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS_PER_UNIT)


def _pname(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def exact_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float],
                      names: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles, one row per group (one row in all without groups).

    Values are first counted per distinct value (map-side combined). Ranks are then located in
    logarithmic bins, of which a group has a few thousand at most, and only the bins that hold a
    wanted rank are ordered value by value. No task ever holds a whole group. Null keys form a group.
    """
    from reprise.operators.ranks import running_totals

    names = names or [_pname(p) for p in ps]
    v = F.col(value).cast("double")
    counted = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", _bin(F.col("_v"))))
    per_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ordered = per_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    lo = [F.floor(F.lit(p) * (F.col("_total") - 1)) for p in ps]
    hi = [F.ceil(F.lit(p) * (F.col("_total") - 1)) for p in ps]

    def wanted(start: Column, stop: Column) -> Column:
        cond = F.lit(False)
        for r in (*lo, *hi):
            cond |= (r >= start) & (r < stop)
        return cond

    bins = (counted.groupBy(*groups, "_bin").agg(F.sum("_n").alias("_bn"))
            .withColumns({"_cum": F.sum("_bn").over(ordered), "_total": F.sum("_bn").over(per_group)})
            .withColumn("_before", F.col("_cum") - F.col("_bn"))
            .where(wanted(F.col("_before"), F.col("_cum"))))
    b = bins.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bin").alias("_gbin"),
                    "_before", "_total")
    cond = F.col("_bin") == F.col("_gbin")
    for i, g in enumerate(groups):
        cond &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # a bin may hold most of a group (rates, narrow ranges): its values are ordered over several tasks
    inside = counted.join(b, cond, "inner").select(*groups, "_bin", "_v", "_n", "_before", "_total")
    ranked = (running_totals(inside, [F.col("_v").asc()], {"_n": "_inside"}, [*groups, "_bin"])
              .withColumn("_stop", F.col("_before") + F.col("_inside"))
              .withColumn("_start", F.col("_stop") - F.col("_n")))
    at = lambda r: F.max(F.when((r >= F.col("_start")) & (r < F.col("_stop")), F.col("_v")))
    aggs = [F.max("_total").alias("_total")]
    for i in range(len(ps)):
        aggs += [at(lo[i]).alias(f"_lo{i}"), at(hi[i]).alias(f"_hi{i}")]
    out = ranked.groupBy(*groups).agg(*aggs)
    cols = []
    for i, (p, name) in enumerate(zip(ps, names)):
        frac = F.lit(p) * (F.col("_total") - 1) - F.floor(F.lit(p) * (F.col("_total") - 1))
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    return out.select(*groups, F.col("_total").alias("n"), *cols)


def day_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float],
                    names: list[str] | None = None, mean: bool = True) -> DataFrame:
    """Percentiles and mean of a whole-day count.

    Day counts take at most a few thousand distinct values, so after counting per value the
    built-in exact percentile holds a bounded map per group.
    """
    names = names or [_pname(p) for p in ps]
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("int").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    aggs = [F.sum("_n").alias("n"),
            F.percentile("_v", F.array(*[F.lit(float(p)) for p in ps]), F.col("_n")).alias("_p")]
    if mean:
        aggs.append((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))
    out = counted.groupBy(*groups).agg(*aggs)
    return out.select(*groups, "n", *([F.col("mean")] if mean else []),
                      *[F.col("_p")[i].alias(nm) for i, nm in enumerate(names)])


def describe(df: DataFrame, groups: list[str], value: str, ps: list[float]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles."""
    base = df.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    pct = exact_percentiles(df, groups, value, ps).drop("n")
    return _null_safe_left(base, pct, groups)


def _null_safe_left(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    if not groups:
        return a.withColumns({c: b.select(c).scalar() for c in b.columns})
    rb = b.withColumnsRenamed({g: f"_r_{g}" for g in groups})
    cond = F.lit(True)
    for g in groups:
        cond &= F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    return a.join(rb, cond, "left").drop(*[f"_r_{g}" for g in groups])


def rate_table(df: DataFrame, level: str | Column, target: str, null_label: str = "(nulo)",
               min_n: int = 0) -> DataFrame:
    """Per level: n, rate of ``target``, lift over and gap to the overall rate, share of rows."""
    lv = F.col(level) if isinstance(level, str) else level
    g = (df.where(F.col(target).isNotNull())
         .groupBy(F.coalesce(lv.cast("string"), F.lit(null_label)).alias("level"))
         .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("_s")))
    every = Window.partitionBy(F.lit(0))          # one row per level, not per input row
    total_n, total_s = F.sum("n").over(every), F.sum("_s").over(every)
    rate, base = F.col("_s") / F.col("n"), total_s / total_n
    out = g.select("level", "n", rate.alias("rate"), F.try_divide(rate, base).alias("lift"),
                   (100 * (rate - base)).alias("diff_pp"), (F.col("n") / total_n).alias("share"))
    return out.where(F.col("n") >= min_n) if min_n else out


def strat_table(df: DataFrame, level: str | Column, strata: str | Column, target: str, min_n: int = 0,
                null_label: str = "(nulo)") -> DataFrame:
    """Rates of ``target`` by stratum and level; cells below ``min_n`` rows are not shown."""
    lv = F.col(level) if isinstance(level, str) else level
    st = F.col(strata) if isinstance(strata, str) else strata
    out = (df.where(F.col(target).isNotNull())
           .groupBy(F.coalesce(st.cast("string"), F.lit(null_label)).alias("stratum"),
                    F.coalesce(lv.cast("string"), F.lit(null_label)).alias("level"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate")))
    return out.where(F.col("n") >= min_n) if min_n else out


def information_value(df: DataFrame, features: dict[str, Column], target: str, smoothing: float = 0.5) -> DataFrame:
    """Information value of every binned feature in one pass over the data.

    Rows are unpivoted to (feature, level) and combined map-side; missing values are a level.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), F.coalesce(c.cast("string"), F.lit("(nulo)")).alias("level"))
                      for name, c in features.items()])
    y = F.col(target).cast("double")
    g = (df.where(y.isNotNull()).select(y.alias("_y"), F.explode(pairs).alias("f"))
         .groupBy("f.feature", "f.level").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")))
    per = Window.partitionBy("feature")
    # smoothed cells over their own sum, so that the shares of a feature add up to one
    pr = (F.col("pos") + smoothing) / F.sum(F.col("pos") + smoothing).over(per)
    pc = (F.col("neg") + smoothing) / F.sum(F.col("neg") + smoothing).over(per)
    return (g.withColumn("_iv", (pr - pc) * F.log(pr / pc))
            .groupBy("feature").agg(F.sum("_iv").alias("iv"), F.count(F.lit(1)).alias("levels")))


def weighted_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks, computed from distinct-value counts."""
    from reprise.operators.ranks import average_rank

    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    ra = average_rank(pairs, "_a").withColumnsRenamed({"_a": "_ka", "rank": "_ra"})
    rb = average_rank(pairs, "_b").withColumnsRenamed({"_b": "_kb", "rank": "_rb"})
    j = (pairs.join(ra, F.col("_a") == F.col("_ka")).join(rb, F.col("_b") == F.col("_kb")))
    return j.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman"))


def crosstab(df: DataFrame, row: str, col: str, levels: list, prefix: str = "") -> DataFrame:
    """Counts of ``row`` x fixed ``levels`` with a row total."""
    g = df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1)))
    names = [F.coalesce(F.col(f"`{lv}`"), F.lit(0)).cast("long").alias(f"{prefix}{i + 1}") for i, lv in enumerate(levels)]
    out = g.select(row, *names)
    return out.withColumn("total", sum((F.col(f"{prefix}{i + 1}") for i in range(1, len(levels))), F.col(f"{prefix}1")))


def value_shares(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Counts of each value with its share within the group."""
    g = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return g.withColumn("share", F.col("n") / F.sum("n").over(per))


def mode_of(df: DataFrame, groups: list[str], value: str, alias: str = "mode") -> DataFrame:
    """Most frequent non-null value; a tie goes to the greatest value."""
    g = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    return g.groupBy(*groups).agg(F.max_by(value, F.struct("_n", value)).alias(alias), F.max("_n").alias("mode_n"),
                                  F.sum("_n").alias("n"))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Only-A / only-B / both profile of two key sets with the rows behind them."""
    ka = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_na"))
    kb = b.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_nb"))
    side = (F.when(F.col("_nb").isNull(), F.lit("only_a")).when(F.col("_na").isNull(), F.lit("only_b"))
            .otherwise(F.lit("both")))
    return (ka.join(kb, key, "full_outer").groupBy(side.alias("side"))
            .agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("_na"), F.lit(0)).alias("rows_a"),
                 F.coalesce(F.sum("_nb"), F.lit(0)).alias("rows_b")))


def dense_levels(df: DataFrame, key: str, levels: list, values: list[str]) -> DataFrame:
    """Reindex to a fixed list of levels, filling absent counts with 0."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(lv,) for lv in levels], f"{key} {df.schema[key].dataType.simpleString()}")
    return (dim.join(df, key, "left")
            .select(key, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values]))
