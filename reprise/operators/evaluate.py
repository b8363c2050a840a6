"""Evaluation of any score column: ordering, capacity and calibration measures.

Curves rest on two distributed orderings only: positions of single rows (``number_rows``) and running
totals over distinct scores. Everything after them is a small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.operators.ranks import decile, equal_count_bin, number_rows, rank_within, running_totals

CAPACITIES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def rank_scores(pairs: DataFrame, id_col: str = "id", y: str = "y", p: str = "p") -> DataFrame:
    """Position ``rn`` by descending score (ties by id) and population size ``total``."""
    ranked = number_rows(pairs.where(F.col(y).isNotNull() & F.col(p).isNotNull()), [F.col(p).desc(), F.col(id_col).asc()])
    return ranked.withColumn("total", ranked.agg(F.count(F.lit(1)).alias("c")).scalar())


def score_steps(pairs: DataFrame, group: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """Distinct scores, best first, with their own and cumulative counts and positives."""
    group = group or []
    steps = (pairs.where(F.col(y).isNotNull() & F.col(p).isNotNull())
             .groupBy(*group, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("pos")))
    return running_totals(steps, [F.col("p").desc()], {"n": "cum_n", "pos": "cum_pos"}, group)


def discrimination(pairs: DataFrame, group: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """n, base rate, ROC-AUC (ties count half) and average precision per group."""
    group = group or []
    steps = score_steps(pairs, group, y, p)
    neg = F.col("n") - F.col("pos")
    agg = steps.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("_p"),
        F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2)).alias("_conc"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_ap"))
    n, pos = F.col("n"), F.col("_p")
    return agg.select(*group, "n", (pos / n).alias("base_rate"), F.try_divide(F.col("_conc"), pos * (n - pos)).alias("roc_auc"),
                      F.try_divide(F.col("_ap"), pos).alias("pr_auc"))


def probability_losses(pairs: DataFrame, group: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """Brier score and clipped log-loss; null when a group has scores outside [0, 1]."""
    group = group or []
    yy, pp = F.col(y).cast("double"), F.col(p)
    q = F.least(F.greatest(pp, F.lit(1e-6)), F.lit(1 - 1e-6))
    ok = (F.min(pp) >= 0) & (F.max(pp) <= 1)
    loss = -(yy * F.log(q) + (1 - yy) * F.log(1 - q))
    return pairs.groupBy(*group).agg(F.when(ok, F.avg((pp - yy) * (pp - yy))).alias("brier"),
                                     F.when(ok, F.avg(loss)).alias("log_loss"))


def lift_table(ranked: DataFrame, n_bins: int = 10) -> DataFrame:
    """Decile 1 holds the highest scores; rates, lift and cumulative figures."""
    g = ranked.groupBy(decile(F.col("rn"), F.col("total"), n_bins).alias("decil")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("churners"), F.avg("p").alias("p_medio"))
    every = Window.partitionBy(F.lit(0))              # n_bins rows
    upto = every.orderBy("decil").rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum("churners").over(every) / F.sum("n").over(every)
    cum_y, cum_n = F.sum("churners").over(upto), F.sum("n").over(upto)
    return g.select("decil", "n", "churners", "p_medio", (F.col("churners") / F.col("n")).alias("tasa"),
                    F.try_divide(F.col("churners") / F.col("n"), base).alias("lift"), cum_y.alias("cum_churners"),
                    F.try_divide(cum_y, F.sum("churners").over(every)).alias("cum_recall"), cum_n.alias("cum_n"),
                    (cum_y / cum_n).alias("cum_precision"), F.try_divide(cum_y / cum_n, base).alias("cum_lift"))


def _half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def _capacity_rows(ranked: DataFrame, fractions, floor: int) -> DataFrame:
    """One aggregate for all capacities, unpivoted to a row per capacity."""
    parts = []
    for f in fractions:
        k = F.greatest(_half_even(F.lit(float(f)) * F.col("total")), F.lit(floor))
        parts.append(F.struct(F.lit(float(f)).alias("capacidad_pct"), F.max(k).alias("k"),
                              F.sum(F.when(F.col("rn") <= k, F.col("y")).otherwise(0.0)).alias("hits"),
                              F.max(F.when(F.col("rn") == k, F.col("p"))).alias("threshold")))
    one = ranked.agg(F.array(*parts).alias("a"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return one.select("pos", "n", F.explode("a").alias("c")).select("pos", "n", "c.*")


def recall_at_capacity(ranked: DataFrame, fractions=CAPACITIES) -> DataFrame:
    c = _capacity_rows(ranked, fractions, 1)
    hits, k, base = F.col("hits"), F.col("k"), F.col("pos") / F.col("n")
    return c.select("capacidad_pct", k.alias("contactados"), hits.cast("long").alias("churners_capturados"),
                    F.try_divide(hits, F.col("pos")).alias("recall"), (hits / k).alias("precision"),
                    F.try_divide(hits / k, base).alias("lift"), F.col("threshold").alias("umbral_score"))


def recall_at_share(long_pairs: DataFrame, share: float, model: str = "modelo", id_col: str = "id") -> DataFrame:
    """Share of each model's positives among its best ``share`` of rows; at least one row is taken."""
    r = rank_within(long_pairs, [model], [F.col("p").desc(), F.col(id_col).asc()])
    size = r.groupBy(model).agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_pos"))
    top = F.col("rn") <= F.greatest(_half_even(F.lit(share) * F.col("_n")), F.lit(1))
    hits = F.sum(F.when(top, F.col("y")).otherwise(0.0))
    return r.join(size, model).groupBy(model).agg(F.try_divide(hits, F.max("_pos")).alias(f"recall_{round(100 * share)}"))


def recall_at_monthly_capacity(pairs: DataFrame, k_per_month: int, date_col: str = "scoring_date", id_col: str = "id") -> DataFrame:
    """Contact the best ``k_per_month`` of every scoring month."""
    m = pairs.withColumn("_mes", F.trunc(date_col, "month"))
    r = rank_within(m, ["_mes"], [F.col("p").desc(), F.col(id_col).asc()])
    top = F.col("rn") <= k_per_month
    agg = r.agg(F.sum(top.cast("long")).alias("contactados"), F.sum(F.when(top, F.col("y")).otherwise(0.0)).alias("hits"),
                F.sum("y").alias("pos"), F.count_distinct("_mes").alias("meses"))
    return agg.select(F.lit(k_per_month).alias("k_por_mes"), "contactados", F.col("hits").cast("long").alias("churners_capturados"),
                      F.try_divide("hits", "pos").alias("recall"), F.try_divide("hits", "contactados").alias("precision"), "meses")


def calibration_table(ranked: DataFrame, n_bins: int = 10) -> DataFrame:
    """Equal-count bins from the lowest score up, with the observed rate of each."""
    asc = F.col("total") - F.col("rn") + 1
    return (ranked.groupBy(equal_count_bin(asc, F.col("total"), n_bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("score_medio"), F.avg("y").alias("tasa_observada"))
            .withColumn("gap", F.abs(F.col("tasa_observada") - F.col("score_medio"))))


def expected_calibration_error(ranked: DataFrame, n_bins: int = 10) -> DataFrame:
    return calibration_table(ranked, n_bins).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def precision_recall_points(pairs: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    s = score_steps(pairs, None, y, p)
    total = s.agg(F.sum("pos").alias("t")).scalar()
    return s.select((F.col("cum_pos") / F.col("cum_n")).alias("precision"), F.try_divide(F.col("cum_pos"), total).alias("recall"),
                    F.col("p").alias("umbral"))


def gains_curve(ranked: DataFrame, n_points: int = 101) -> DataFrame:
    """Share of positives reached at each contacted share.

    A row falls to the first grid point that contains it, so the curve is a sum over grid points.
    """
    step = 1.0 / (n_points - 1)
    upto = lambda j: F.greatest(F.floor(j * F.lit(step) * F.col("total")), F.lit(1))
    j0 = F.ceil(F.col("rn") / F.col("total") * (n_points - 1))
    first = (F.when(upto(j0 - 1) >= F.col("rn"), j0 - 1).when(upto(j0) >= F.col("rn"), j0).otherwise(j0 + 1))
    # the first position belongs to grid point 1 at the latest
    own = ranked.groupBy(F.greatest(first, F.lit(1)).cast("long").alias("_j")).agg(F.sum("y").alias("_y"))
    grid = ranked.sparkSession.range(n_points).withColumnRenamed("id", "_j")
    run = Window.partitionBy(F.lit(0)).orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    g = grid.join(own, "_j", "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    return g.select((F.col("_j") * F.lit(step)).alias("pct_contactados"),
                    F.when(F.col("_j") == 0, 0.0).otherwise(F.try_divide(F.sum("_y").over(run), F.sum("_y").over(every)))
                    .alias("pct_churners_capturados"))


def compare_models(long_pairs: DataFrame, model: str = "modelo", id_col: str = "id") -> DataFrame:
    """All summary measures of several scores held in one long table (model, id, y, p)."""
    d = discrimination(long_pairs, [model])
    losses = probability_losses(long_pairs, [model])
    r = rank_within(long_pairs, [model], [F.col("p").asc(), F.col(id_col).desc()])
    size = r.groupBy(model).agg(F.count(F.lit(1)).alias("total"))
    cal = (r.join(size, model).groupBy(model, equal_count_bin(F.col("rn"), F.col("total"), 10).alias("bin"))
           .agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("y") - F.avg("p")).alias("gap"))
           .groupBy(model).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("_ece")))
    return (d.join(losses, model, "left").join(cal, model, "left")
            .withColumn("ece", F.when(F.col("brier").isNotNull(), F.col("_ece"))).drop("_ece"))


def subgroup_metrics(pairs: DataFrame, group: str, min_n: int = 500) -> DataFrame:
    """Discrimination by subgroup where it is large enough and has both classes."""
    d = discrimination(pairs, [group])
    return d.where((F.col("n") >= min_n) & (F.col("base_rate") > 0) & (F.col("base_rate") < 1))
