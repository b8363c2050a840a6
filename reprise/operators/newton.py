"""Unpenalised logistic regression on counted cells by Newton steps, the factor with most levels absorbed.

Rows are first counted by their factor levels and values. In each step one factor's block of the normal equations is
diagonal, since a row has one of its levels, so it is eliminated level by level in Spark (a Schur complement); what
reaches the driver has the size of the other factors' levels, whatever the number of the absorbed one's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from reprise.runtime import stored

#: Levels of all factors but the absorbed one: the normal equations that the driver solves have this size at most.
MOST_OTHERS = 2000
_ITEMS = "array<struct<i:int,v:double>>"


@dataclass
class LogitFit:
    """``levels``: factor, level, coef (0 for the reference; infinite where a level has one outcome only); ``slopes``:
    coefficient of each numeric column; ``steps``: Newton steps taken."""

    levels: DataFrame
    slopes: dict[str, float]
    rows: int
    steps: int


def _counted(df: DataFrame, factors: list[str], numerics: list[str], target: str) -> DataFrame:
    d = df.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("string").alias(c) for c in factors], *[F.col(c).cast("double").alias(c) for c in numerics]).dropna()
    return d.groupBy(*factors, *numerics).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_y"))


def _one_sided(cells: DataFrame, factors: list[str]) -> DataFrame:
    """Levels all of whose rows have one outcome: (factor, level, sign)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("level")) for c in factors])
    g = cells.select(F.explode(pairs).alias("p"), "_n", "_y").groupBy("p.factor", "p.level").agg(F.sum("_n").alias("n"), F.sum("_y").alias("y"))
    return g.where((F.col("y") == 0) | (F.col("y") == F.col("n"))).select("factor", "level", F.when(F.col("y") == 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"))


def _inner(beta: np.ndarray, value: str = "items") -> Column:
    """Sum over a row's items of coefficient times value."""
    if not len(beta):
        return F.lit(0.0)
    b = F.array(*[F.lit(float(x)) for x in beta])
    return F.aggregate(value, F.lit(0.0), lambda s, e: s + F.get(b, e["i"]) * e["v"])


def fit_logit(df: DataFrame, factors: dict[str, str], target: str, numerics: list[str] | None = None, tolerance: float = 1e-10, most_steps: int = 50) -> LogitFit:
    """Maximum-likelihood fit with dummy factors (column -> reference level) and numeric columns.

    Rows with a null in any of them are left out. Levels whose rows all have one outcome have no finite coefficient: they
    are set apart first, with their rows, and reported as infinite. Steps are halved while the likelihood falls.
    """
    numerics = numerics or []
    cells = stored(_counted(df, list(factors), numerics, target))
    rows = int(cells.agg(F.sum("_n")).first()[0] or 0)
    apart = None
    while factors and rows:
        found = stored(_one_sided(cells, list(factors)))
        if not found.limit(1).count():
            break
        apart = found if apart is None else apart.unionByName(found)
        for c in factors:
            gone = found.where(F.col("factor") == c).select(F.col("level").alias(c))
            cells = cells.join(gone, c, "left_anti")
        cells = stored(cells)
        if not cells.limit(1).count():
            break
    sizes = cells.agg(*[F.count_distinct(c).alias(c) for c in factors]).first() if factors else None
    absorbed = max(factors, key=lambda c: (sizes[c], c)) if factors else None
    others = [c for c in factors if c != absorbed]
    if sum(sizes[c] for c in others) > MOST_OTHERS:
        raise ValueError(f"only one factor may have many levels; the others have {sum(sizes[c] for c in others)} together")
    known = [r["x"] for r in cells.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("level")) for c in others])).alias("x")).distinct().orderBy("x.factor", "x.level").collect()] if others else []
    slots = [(r["factor"], r["level"]) for r in known if r["level"] != factors[r["factor"]]]
    width = len(slots) + len(numerics)
    # the other factors' levels are MOST_OTHERS at most, so this table may go with the join
    places = df.sparkSession.createDataFrame([(c, v, k) for k, (c, v) in enumerate(slots)], "factor string, level string, i int")
    x = cells.withColumn("_a", F.col(absorbed) if absorbed else F.lit("all"))
    for c in others:
        of = places.where(F.col("factor") == c).select(F.col("level").alias(c), F.col("i").alias(f"_i_{c}"))
        x = x.join(F.broadcast(of), c, "left")
    items = [F.when(F.col(f"_i_{c}").isNotNull(), F.struct(F.col(f"_i_{c}").alias("i"), F.lit(1.0).alias("v"))) for c in others]
    items += [F.struct(F.lit(len(slots) + k).cast("int").alias("i"), F.col(c).alias("v")) for k, c in enumerate(numerics)]
    x = stored(x.select("_a", (F.filter(F.array(*items), lambda e: e.isNotNull()) if items else F.array()).cast(_ITEMS).alias("items"), "_n", "_y"))

    start = F.log(F.sum("_y") / (F.sum("_n") - F.sum("_y")))
    level = stored(x.groupBy("_a").agg(start.alias("alpha")))
    beta = np.zeros(width)

    def likelihood(level: DataFrame, beta: np.ndarray) -> float:
        eta = F.col("alpha") + _inner(beta)
        log1p = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        return x.join(level, "_a").agg(F.sum(F.col("_y") * eta - F.col("_n") * log1p)).first()[0] or 0.0

    now, steps = likelihood(level, beta), 0
    for steps in range(1, most_steps + 1):
        p = 1 / (1 + F.exp(-(F.col("alpha") + _inner(beta))))
        e = x.join(level, "_a").withColumns({"_p": p}).select("_a", "items", (F.col("_n") * F.col("_p") * (1 - F.col("_p"))).alias("w"), (F.col("_y") - F.col("_n") * F.col("_p")).alias("r"))
        own = e.groupBy("_a").agg(F.sum("w").alias("d"), F.sum("r").alias("g"))
        with_others = e.select("_a", F.explode("items").alias("e"), "w").groupBy("_a", F.col("e.i").alias("i")).agg(F.sum(F.col("w") * F.col("e.v")).alias("s"))
        shared = with_others.groupBy("_a").agg(F.collect_list(F.struct("i", F.col("s").alias("v"))).alias("a"))        # width entries at most
        own = stored(own.join(shared, "_a", "left").withColumn("a", F.coalesce("a", F.array().cast(_ITEMS))))
        delta = np.zeros(width)
        if width:
            pair = lambda a: F.explode(F.flatten(F.transform(a, lambda u: F.transform(a, lambda v: F.struct(u["i"].alias("i"), v["i"].alias("j"), (u["v"] * v["v"]).alias("v"))))))
            full = e.select(pair(F.col("items")).alias("z"), "w").select("z.i", "z.j", (F.col("z.v") * F.col("w")).alias("v"))
            less = own.select(pair(F.col("a")).alias("z"), "d").select("z.i", "z.j", (-F.col("z.v") / F.col("d")).alias("v"))
            right = e.select(F.explode("items").alias("e"), "r").select(F.col("e.i").alias("i"), F.lit(-1).alias("j"), (F.col("e.v") * F.col("r")).alias("v"))
            down = own.select(F.explode("a").alias("e"), "d", "g").select(F.col("e.i").alias("i"), F.lit(-1).alias("j"), (-F.col("e.v") * F.col("g") / F.col("d")).alias("v"))
            matrix, rhs = np.zeros((width, width)), np.zeros(width)
            for r in full.unionByName(less).unionByName(right).unionByName(down).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
                if r["j"] < 0:
                    rhs[r["i"]] = r["v"]
                else:
                    matrix[r["i"], r["j"]] = r["v"]
            delta = np.linalg.lstsq(matrix, rhs, rcond=1e-12)[0]
        moved = own.select("_a", F.try_divide(F.col("g") - _inner(delta, "a"), F.col("d")).alias("step"))
        size = 1.0
        while True:
            nxt = stored(level.join(moved, "_a").select("_a", (F.col("alpha") + F.lit(size) * F.coalesce("step", F.lit(0.0))).alias("alpha")))
            then = likelihood(nxt, beta + size * delta)
            if then >= now - 1e-9 * abs(now) or size < 1e-4:
                break
            size /= 2
        change = max(size * float(np.abs(delta).max(initial=0.0)), size * (moved.agg(F.max(F.abs("step"))).first()[0] or 0.0))
        level, beta, now = nxt, beta + size * delta, then
        if change < tolerance:
            break

    spark, none = df.sparkSession, "factor string, level string, coef double"
    fixed = [(c, v, float(b)) for (c, v), b in zip(slots, beta, strict=False)] + [(c, factors[c], 0.0) for c in others]
    out = spark.createDataFrame(fixed, none)
    if absorbed:
        zero = level.where(F.col("_a") == factors[absorbed]).select("alpha")
        out = out.unionByName(level.select(F.lit(absorbed).alias("factor"), F.col("_a").alias("level"), (F.col("alpha") - zero.scalar()).alias("coef")))
    if apart is not None:
        out = out.unionByName(apart.select("factor", "level", (F.col("sign") * F.lit(float("inf"))).alias("coef")))
    return LogitFit(stored(out), {c: float(beta[len(slots) + k]) for k, c in enumerate(numerics)}, rows, steps)


def odds_ratios(df: DataFrame, factors: dict[str, str], target: str, numerics: list[str] | None = None) -> DataFrame:
    """Adjusted odds ratio of each level against its factor's reference (factor, level, reference, coef, odds_ratio); a
    numeric column has one row, per unit, without a level."""
    fit = fit_logit(df, factors, target, numerics)
    spark = df.sparkSession
    refs = spark.createDataFrame(list(factors.items()), "factor string, reference string")
    out = fit.levels.join(F.broadcast(refs), "factor").where(F.col("level") != F.col("reference")).select("factor", "level", "reference", "coef")
    if fit.slopes:
        out = out.unionByName(spark.createDataFrame([(c, None, None, b) for c, b in fit.slopes.items()], "factor string, level string, reference string, coef double"))
    return out.withColumn("odds_ratio", F.exp("coef"))
