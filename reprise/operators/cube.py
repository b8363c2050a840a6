"""Rates of outcomes by level: single features, crosses and strata from one pass, with direct standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reprise.runtime import stored


def level_cube(df: DataFrame, features: dict[str, Column], outcomes: list[str], stratum: Column | None = None, crosses: list[tuple[str, str]] | None = None) -> DataFrame:
    """Counts of every feature level and chosen cross, by stratum: feature, level, other, other_level, stratum, n and one
    sum an outcome. ``other`` is null for single features. Rows are combined where they are read; the table has the size
    of the levels, and all rates below are small aggregates of it."""
    named = {k: F.coalesce(c.cast("string"), F.lit("(nulo)")) for k, c in features.items()}
    none = F.lit(None).cast("string")
    cells = [F.struct(F.lit(k).alias("feature"), c.alias("level"), none.alias("other"), none.alias("other_level")) for k, c in named.items()]
    cells += [F.struct(F.lit(a).alias("feature"), named[a].alias("level"), F.lit(b).alias("other"), named[b].alias("other_level")) for a, b in crosses or []]
    at = F.lit("all") if stratum is None else stratum
    flat = df.select(*[F.col(o).cast("double").alias(o) for o in outcomes], at.cast("string").alias("stratum"), F.explode(F.array(*cells)).alias("c"))
    return stored(flat.groupBy("c.feature", "c.level", "c.other", "c.other_level", "stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum(o).alias(o) for o in outcomes]))


def level_rates(cube: DataFrame, outcomes: list[str]) -> DataFrame:
    """Per feature level: n, and for each outcome its rate and its lift over all rows."""
    g = cube.where("other is null").groupBy("feature", "level").agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in outcomes])
    total = g.groupBy("feature").agg(F.sum("n").alias("_n"), *[F.sum(o).alias(f"_{o}") for o in outcomes])
    j = g.join(total, "feature")
    rates = [c for o in outcomes for c in ((F.col(o) / F.col("n")).alias(f"{o}_rate"), F.try_divide(F.col(o) / F.col("n"), F.col(f"_{o}") / F.col("_n")).alias(f"{o}_lift"))]
    return j.select("feature", "level", "n", *rates)


def rate_range(cube: DataFrame, outcome: str, min_n: int) -> DataFrame:
    """Per feature: lowest and highest rate among levels of ``min_n`` rows or more, and their gap in points."""
    r = level_rates(cube, [outcome]).where(F.col("n") >= min_n).groupBy("feature").agg(F.min(f"{outcome}_rate").alias("low"), F.max(f"{outcome}_rate").alias("high"), F.count(F.lit(1)).alias("levels"))
    return r.withColumn("range_pp", 100 * (F.col("high") - F.col("low")))


def cross_rates(cube: DataFrame, outcome: str) -> DataFrame:
    g = cube.where("other is not null").groupBy("feature", "level", "other", "other_level").agg(F.sum("n").alias("n"), F.sum(outcome).alias("_s"))
    return g.select("feature", "level", "other", "other_level", "n", (F.col("_s") / F.col("n")).alias("rate"))


def standardised_rates(cube: DataFrame, outcome: str) -> DataFrame:
    """Crude rate of each level, and its rate at the strata mix of all rows (over the strata that the level has, whose
    share of all rows is ``covered``). Rows of an unknown stratum (null) are left out."""
    c = cube.where("other is null and stratum is not null")
    g = c.groupBy("feature", "level", "stratum").agg(F.sum("n").alias("n"), F.sum(outcome).alias("s"))
    mix = c.groupBy("feature", "stratum").agg(F.sum("n").alias("w"))
    all_rows = mix.groupBy("feature").agg(F.sum("w").alias("all"))
    j = g.join(mix, ["feature", "stratum"])
    out = j.groupBy("feature", "level").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("crude"), (F.sum(F.col("w") * F.col("s") / F.col("n")) / F.sum("w")).alias("standardised"), F.sum("w").alias("w"))
    return out.join(all_rows, "feature").select("feature", "level", "n", "crude", "standardised", (F.col("w") / F.col("all")).alias("covered"))
