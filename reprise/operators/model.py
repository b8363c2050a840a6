"""Risk scores: the rule baseline and Spark ML models on a temporal split."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from reprise.functions.columns import clip
from reprise.operators import evaluate as el
from reprise.operators.batched import fit_groups, score_groups
from reprise.operators.features import CATEGORICAL, SNAPSHOT_COLUMNS, feature_columns
from reprise.operators.matrix import Preparation, prepare
from reprise.operators.pooled import fit_isotonic
from reprise.operators.stats import exact_percentiles
from reprise.operators.trees import explainer, long_form, node_table, shapley, split_shares
from reprise.params import SplitParams
from reprise.runtime import stored

LABEL = "label_churn"
# fixed values: inputs of the logistic baseline
LR_NUMERIC = ["days_since_last_maint", "days_since_last_appt", "n_maint", "n_noshow", "n_cancel", "cancel_rate",
              "vehicle_age_years", "km_per_year", "last_maint_number", "fordpass_share", "is_first_service",
              "n_recall", "n_diag", "n_repair", "months_observable", "n_customer_changes", "last_maint_late_days",
              "mean_interval_days", "fleet_size_sales", "last_rating"]
LR_CATEGORICAL = ["generation", "business_unit", "last_source", "binding_rule"]
HIGH_CARDINALITY = ["last_maint_dealer", "tma"]
MIN_LEVEL_ROWS = 50


def heuristic_score(f: DataFrame) -> DataFrame:
    """Rule of thumb: older vehicle, more missed bookings, less maintenance history, first service."""
    age = F.coalesce(F.col("vehicle_age_years"), exact_percentiles(f, [], "vehicle_age_years", [0.5], ["m"]).select("m").scalar())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    missed = zero("n_noshow") + 0.5 * zero("n_cancel")
    return f.withColumn("score", 0.25 * clip(age, 0.0, 10.0) + 0.6 * clip(missed, 0.0, 5.0)
                        - 0.3 * clip(zero("n_maint"), 0, 5) + 0.8 * zero("is_first_service"))


def temporal_split(df: DataFrame, split: SplitParams) -> DataFrame:
    s = F.col("scoring_date")
    return df.withColumn("period", F.when(s <= F.lit(split.train_end), F.lit("train")).when(s <= F.lit(split.valid_end), F.lit("valid"))
                         .otherwise(F.lit("test")))


def periods_without_support(split_df: DataFrame) -> list[str]:
    """Periods lacking one of the outcomes; three summary rows reach the driver."""
    rows = split_df.groupBy("period").agg(F.min(LABEL).alias("lo"), F.max(LABEL).alias("hi")).collect()
    good = {r["period"] for r in rows if r["lo"] == 0 and r["hi"] == 1}
    return [p for p in ("train", "valid", "test") if p not in good]


def require_both_classes(split_df: DataFrame) -> None:
    missing = periods_without_support(split_df)
    if missing:
        raise ValueError(f"periods without evaluable windows of both outcomes: {', '.join(missing)}; check the split dates")


def positive(df: DataFrame, alias: str) -> DataFrame:
    return df.withColumn(alias, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit_logreg(train: DataFrame, prep: Preparation, matrix: DataFrame, c: float = 0.5):
    """L2 logistic regression on a stored matrix; the penalty is the usual 1/C spread over the training rows."""
    x = matrix.where(F.col("period") == "train")
    n = x.count()
    return LogisticRegression(labelCol=LABEL, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100).fit(x)


def fit_gbt(matrix: DataFrame, max_iter: int = 60, depth: int = 5, step: float = 0.1, seed: int = 42):
    """Boosted trees on a stored matrix, stopped on the validation period."""
    x = matrix.where(F.col("period") != "test").withColumn("_val", F.col("period") == "valid").select("features", LABEL, "_val")
    return GBTClassifier(labelCol=LABEL, maxIter=max_iter, maxDepth=depth, stepSize=step, subsamplingRate=0.8, minInstancesPerNode=20, seed=seed,
                         validationIndicatorCol="_val", validationTol=0.001).fit(x)


def calibrated(model, df: DataFrame, p: str, alias: str) -> DataFrame:
    out = model.setFeaturesCol(p).setPredictionCol("_iso").transform(df)
    return out.withColumn(alias, F.least(F.greatest("_iso", F.lit(0.0)), F.lit(1.0))).drop("_iso")


IDS = ["window_id", "vehicle_id", "customer_id", "scoring_date", LABEL, "period"]


def train_all(data: DataFrame, split: SplitParams, exclude_snapshot: bool = True, drop: set[str] | None = None, max_iter: int = 60,
              with_logreg: bool = True) -> dict:
    """Both models with calibration on the validation period, scored on the test period.

    Each matrix is stored once, for the fit, the scores and the attributions.
    """
    d = stored(temporal_split(data.where(F.col(LABEL).isNotNull()), split))
    require_both_classes(d)
    train = d.where(F.col("period") == "train")
    cols = [c for c in feature_columns(data.columns, exclude_snapshot) if c not in (drop or ())]
    cat = [c for c in cols if c in CATEGORICAL]
    gprep = prepare(train, [c for c in cols if c not in cat], cat, False, MIN_LEVEL_ROWS)
    gm = gprep.matrix(d, IDS)
    gbt = fit_gbt(gm, max_iter)
    scored = positive(gbt.transform(gm.where(F.col("period") != "train")), "p_gbt_raw").select(*IDS, "p_gbt_raw")
    out = {"gbt": gbt, "gbt_prep": gprep, "gbt_matrix": gm, "nodes": stored(node_table(gbt, gprep)), "split": d, "columns": cols}
    if with_logreg:
        lprep = prepare(train, [x for x in LR_NUMERIC if x in data.columns], [x for x in LR_CATEGORICAL if x in data.columns], True, MIN_LEVEL_ROWS)
        lm = lprep.matrix(d, IDS)
        lr = fit_logreg(train, lprep, lm)
        b = positive(lr.transform(lm.where(F.col("period") != "train")), "p_lr_raw").select("window_id", "p_lr_raw")
        scored = scored.join(b, "window_id")
        out |= {"lr": lr, "lr_prep": lprep, "lr_matrix": lm}
    scored = stored(scored)
    valid, test = scored.where(F.col("period") == "valid"), scored.where(F.col("period") == "test").drop("period")
    out["iso_gbt"] = fit_isotonic(valid, "p_gbt_raw", LABEL)
    test = calibrated(out["iso_gbt"], test, "p_gbt_raw", "p_gbt")
    if with_logreg:
        out["iso_lr"] = fit_isotonic(valid, "p_lr_raw", LABEL)
        test = calibrated(out["iso_lr"], test, "p_lr_raw", "p_lr")
    return {**out, "test": stored(test)}


def save_model(result: dict, path: str) -> None:
    """Persist every artefact needed to score a new population."""
    result["gbt"].write().overwrite().save(f"{path}/gbt")
    result["gbt_prep"].save(result["test"].sparkSession, f"{path}/gbt_prep")
    result["iso_gbt"].write().overwrite().save(f"{path}/iso_gbt")


def scored_population(gbt, prep: Preparation, isotonic, population: DataFrame, alias: str) -> tuple[DataFrame, DataFrame]:
    """The population with its calibrated probability, and its stored matrix."""
    m = prep.matrix(population, population.columns)
    raw = positive(gbt.transform(m), "_raw").select(*population.columns, "_raw")
    return calibrated(isotonic, raw, "_raw", alias).drop("_raw"), m


def score_with_saved(spark, path: str, population: DataFrame, alias: str = "prob_churn") -> DataFrame:
    """Calibrated probability of a population from saved artefacts."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

    prep = Preparation.load(spark, f"{path}/gbt_prep")
    return scored_population(GBTClassificationModel.load(f"{path}/gbt"), prep, IsotonicRegressionModel.load(f"{path}/iso_gbt"), population, alias)[0]


def model_table(result: dict, rule: DataFrame, seed: int = 0) -> DataFrame:
    """Long (modelo, id, y, p) table of every compared score on the test period."""
    t = result["test"].withColumn("p_random", F.rand(seed))
    t = t.join(rule.select("window_id", F.col("score").alias("p_rule")), "window_id", "left")
    names = ["p_random", "p_rule", "p_lr", "p_gbt_raw", "p_gbt"]
    pairs = F.array(*[F.struct(F.lit(n[2:]).alias("modelo"), F.col(n).alias("p")) for n in names])
    return t.select(F.col("window_id").alias("id"), F.col(LABEL).alias("y"), F.explode(pairs).alias("m")).select("id", "y", "m.*")


def feature_importance(result: dict) -> DataFrame:
    """Splits and gain of each input of the boosted model, and its share of all."""
    return split_shares(result["nodes"])


def lr_contributions(result: dict, matrix: DataFrame, ids: list[str]) -> DataFrame:
    """Log-odds contribution of every logistic input relative to its population mean, long form.

    An input's levels and missing indicator count together. Means of matrix columns come from one aggregate over the
    entries that rows hold; a contribution is summed over a row's own entries.
    """
    prep, lr = result["lr_prep"], result["lr"]
    spark = matrix.sparkSession
    blocks = spark.createDataFrame(prep.blocks(), "feature string, at int, size int")
    coef = spark.createDataFrame([(k, float(c)) for k, c in enumerate(lr.coefficients.toArray())], "i int, c double")        # the model itself
    of = stored(coef.join(F.broadcast(blocks), (F.col("i") >= F.col("at")) & (F.col("i") < F.col("at") + F.col("size"))).select("i", "c", "feature"))
    stored_form = F.from_json(F.to_json(F.struct("features")), "struct<features:struct<type:tinyint,size:int,indices:array<int>,values:array<double>>>")["features"]
    x = matrix.select(*ids, stored_form.alias("s")).select(*ids, F.explode(F.arrays_zip(F.col("s.indices").alias("i"), F.col("s.values").alias("v"))).alias("e")).select(*ids, "e.i", "e.v").join(of, "i")
    own = x.groupBy(*ids, "feature").agg(F.sum(F.col("c") * F.col("v")).alias("own"))
    mean = own.groupBy("feature").agg((F.sum("own") / matrix.count()).alias("mean"))
    return own.join(F.broadcast(mean), "feature").select(*ids, "feature", (F.col("own") - F.col("mean")).alias("contribution"))


def tree_contributions(result: dict, matrix: DataFrame, ids: list[str]) -> DataFrame:
    """Path-dependent Shapley values of the boosted log-odds, long form, one player an input.

    The margin of Spark's boosted trees is half the log-odds, so leaf values count twice: a row's contributions and the
    explainer's base add up to logit(p).
    """
    e = explainer(result["nodes"], result["gbt_prep"])
    return long_form(shapley(matrix, e, ids), e.players, ids)


def seasonal_regression(monthly: DataFrame, value: str = "per_day") -> DataFrame:
    """Linear trend plus month dummies of the logarithm by least squares (one row per month).

    ``index``: 100 times the exponential of a calendar month's effect less the mean of the twelve effects.
    """
    m = monthly.withColumn("_y", F.log(value)).withColumns({"t": F.months_between("month", F.lit("1990-01-01").cast("date")), **{f"d{i}": (F.month("month") == i).cast("double") for i in range(2, 13)}})
    x = VectorAssembler(inputCols=["t", *[f"d{i}" for i in range(2, 13)]], outputCol="features").transform(m)
    fit = LinearRegression(labelCol="_y", solver="normal").fit(x)
    coef = fit.coefficients.toArray()
    effects = [0.0, *(float(c) for c in coef[1:])]
    mean = sum(effects) / 12
    index = F.element_at(F.array(*[F.lit(e - mean) for e in effects]), F.month("month"))
    return fit.transform(x).select("month", value, F.col("prediction").alias("fitted"), (F.col("_y") - F.col("prediction")).alias("residual"), (100 * F.exp(index)).alias("index"))


#: Variants fitted at a time: each holds its binned rows in the executors while it is fitted.
TOGETHER = 3
METRICS = ["n", "base_rate", "roc_auc", "pr_auc", "brier", "log_loss", "ece"]


def _variant(data: DataFrame, split: SplitParams, drop: set[str], name: str, max_iter: int) -> DataFrame | None:
    """Calibrated test scores of one variant, fitted as the trained model is; none without support in some period."""
    if periods_without_support(temporal_split(data.where(F.col(LABEL).isNotNull()), split)):
        return None
    test = train_all(data, split, exclude_snapshot=False, drop=drop, max_iter=max_iter, with_logreg=False)["test"]
    return test.select(F.lit(name).alias("modelo"), F.col("window_id").alias("id"), F.col(LABEL).alias("y"), F.col("p_gbt").alias("p"))


def ablations(data: DataFrame, leaky: DataFrame | None, split: SplitParams, max_iter: int = 60) -> DataFrame:
    """One metrics row per variant: dropped inputs, row filters, snapshot included, leaked odometer.

    Every variant has the trained model's settings and its own vocabulary and statistics, so ``base`` is the trained
    model. ``leaky``: windows and features on the snapshot odometer; the recorded readings give way to it.
    """
    sales_cols = {"in_sales", "person_type", "business_unit", "sales_channel", "sales_state", "is_buyer", "same_dealer_as_sale", "fleet_size_sales"}
    surveys = {"n_surveys", "min_rating", "last_rating", "mean_rating", "days_since_last_survey"}
    snap = set(SNAPSHOT_COLUMNS)
    variants = [
        ("base", data, snap), ("no_high_cardinality", data, snap | set(HIGH_CARDINALITY)), ("agenda_only", data, snap | sales_cols),
        ("history_6_months", data.where(F.col("history_days") >= 183), snap), ("no_surveys", data, snap | surveys), ("with_connectivity_snapshot", data, set()),
        ("first_service_only", data.where(F.col("anchor_type") == "warranty"), snap), ("later_services_only", data.where(F.col("anchor_type") != "warranty"), snap),
    ]
    if leaky is not None:
        variants.append(("with_odometer_snapshot", leaky, snap))
    # a fit is hundreds of short jobs: those of several variants run side by side, so that tasks don't wait for the driver
    with ThreadPoolExecutor(TOGETHER) as pool:
        fits = [pool.submit(inheritable_thread_target(data.sparkSession)(_variant), x, split, drop, name, max_iter) for name, x, drop in variants]
        found = {name: fit.result() for (name, _, _), fit in zip(variants, fits, strict=True)}
    pairs = None
    for df in found.values():
        if df is not None:
            pairs = df if pairs is None else pairs.unionByName(df)
    names_only = data.sparkSession.createDataFrame([(n,) for n in found], "modelo string")
    if pairs is None:
        return names_only.selectExpr("modelo", *[f"cast(null as double) {c}" for c in [*METRICS, "recall_20"]])
    pairs = stored(pairs)
    return names_only.join(el.compare_models(pairs).select("modelo", *METRICS), "modelo", "left").join(el.recall_at_share(pairs, 0.2), "modelo", "left")


def checked_columns(features: DataFrame) -> DataFrame:
    """The columns that ``check_definitions`` reads."""
    inputs = [c for c in features.columns if c in {*LR_NUMERIC, *LR_CATEGORICAL}]
    return features.select("definition", "vehicle_id", "scoring_date", LABEL, *inputs)


def check_definitions(features: DataFrame, split: SplitParams, ridge: float = 1.0) -> DataFrame:
    """Quick control of every window definition: a logistic model on the earlier periods, judged on the test period.

    ``features`` has ``definition`` and the inputs of the logistic baseline; all definitions are fitted in the same passes,
    with shared levels and scales. A definition without both outcomes on either side has null measures. ``features`` is read
    several times and should be stored by the caller.
    """
    d = temporal_split(checked_columns(features).where(F.col(LABEL).isNotNull()), split).withColumn("_key", F.concat_ws("|", "definition", "vehicle_id", F.date_format("scoring_date", "yyyyMMdd")))
    learn = F.col("period") != "test"
    prep = prepare(d.where(learn), [c for c in LR_NUMERIC if c in d.columns], [c for c in LR_CATEGORICAL if c in d.columns], True, MIN_LEVEL_ROWS)
    m = prep.matrix(d, ["definition", "period", LABEL], "_key")
    sizes = m.groupBy("definition").agg(F.count(F.when(learn, 1)).alias("n_train"), F.count(F.when(~learn, 1)).alias("n_test"), F.min(F.when(learn, F.col(LABEL))).alias("lo"), F.max(F.when(learn, F.col(LABEL))).alias("hi"))
    fair = sizes.where(F.col("lo") < F.col("hi")).select("definition")
    beta = fit_groups(m.where(learn).join(F.broadcast(fair), "definition", "left_semi"), "definition", LABEL, prep.width, ridge)
    scored = score_groups(m.where(~learn), "definition", beta, ["definition", F.col(LABEL).alias("y")])
    return sizes.select("definition", "n_train", "n_test").join(el.discrimination(scored, ["definition"]).select("definition", "base_rate", "roc_auc", "pr_auc"), "definition", "left")
