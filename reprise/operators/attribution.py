"""Additive contributions of features to a score, long and wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import literal_map


def linear_contributions(df: DataFrame, weights: dict[str, float], id_cols: list[str],
                         value_text: dict[str, Column] | None = None) -> DataFrame:
    """Long table (ids, feature, value, contribution) with ``weight * (x - mean x)``.

    Exact for a linear score with independent features; contributions of a row sum to its score
    minus the mean score. The means come from one aggregate over the scored population.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in weights])
    parts = []
    for c, w in weights.items():
        parts.append(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              (F.lit(float(w)) * (F.col(c) - means.select(c).scalar())).alias("contribution")))
    return df.select(*id_cols, F.explode(F.array(*parts)).alias("e")).select(*id_cols, "e.*")


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution in log-odds and its percentage-point proxy around p = 0.5."""
    g = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_shap_logodds"))
    label = F.coalesce(literal_map(fv.FEATURE_LABELS, F.col("feature")), F.col("feature"))
    return g.withColumns({"nombre": label, "mean_abs_shap": F.col("mean_abs_shap_logodds") * 25})


def format_value(v: Column) -> Column:
    """Grouped whole number from 100 up, else at most two decimals without trailing zeros."""
    small = F.regexp_replace(F.regexp_replace(F.format_number(v, 2), r"0+$", ""), r"\.$", "")
    return F.when(F.abs(v) >= 100, F.format_number(v, 0)).when(v.isNotNull(), small)


def driver_text(feature: Column, value: Column, contribution: Column) -> Column:
    label = F.coalesce(literal_map(fv.FEATURE_LABELS, feature), feature)
    absent = F.when(feature.isin(fv.NO_RECORD_FEATURES), F.lit(fv.DRIVER_NO_RECORD)).otherwise(F.lit(fv.DRIVER_NO_VALUE))
    arrow = F.when(contribution > 0, F.lit(fv.DRIVER_UP)).otherwise(F.lit(fv.DRIVER_DOWN))
    return F.concat(label, F.lit(" = "), F.coalesce(format_value(value), absent), F.lit(" ("), arrow, F.lit(")"))


def top_drivers(scored: DataFrame, weights: dict[str, float], top: int = 3) -> DataFrame:
    """Adds ``driver_i``, ``driver_i_feature`` and ``driver_i_shap`` for the largest |contribution|.

    Row-wise: contributions sit in one array per row, so no shuffle is needed.
    """
    means = scored.agg(*[F.avg(c).alias(c) for c in weights])
    parts = []
    for c, w in weights.items():
        x = F.coalesce(F.lit(float(w)) * (F.col(c) - means.select(c).scalar()), F.lit(0.0))
        parts.append(F.struct((-F.abs(x)).alias("k"), F.lit(c).alias("f"), x.alias("c"), F.col(c).cast("double").alias("v")))
    out = scored.withColumn("_d", F.slice(F.sort_array(F.array(*parts)), 1, top))
    for i in range(top):
        e = F.col("_d")[i]
        out = out.withColumns({f"driver_{i + 1}": driver_text(e["f"], e["v"], e["c"]),
                               f"driver_{i + 1}_feature": e["f"], f"driver_{i + 1}_shap": e["c"]})
    return out.drop("_d")
