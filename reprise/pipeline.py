"""Job entry points over typed extracts: full run and contact refresh.

    spark-submit --py-files ... -m reprise.pipeline   (or call ``run`` / ``refresh_contacts``)

Stage cuts are Parquet tables under ``root``; each later stage reads the cut back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reprise.operators import attribution as at, business as bz, contact as ct, evaluate as el, model as md, windows as wd
from reprise.operators.events import appointments, maintenance_events, vehicle_master
from reprise.operators.features import build_features, day_log
from reprise.operators.trees import explainer, largest, shapley
from reprise.params import BusinessParams, ContactPolicy, DataSpan, SaleRules, SegmentParams, SplitParams, WindowParams
from reprise.sources.publish import publish_run, read_latest


def _cut(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prepare(spark: SparkSession, agenda: DataFrame, sales: DataFrame, root: str, params: WindowParams = WindowParams(),
            span: DataSpan = DataSpan(), rules: SaleRules = SaleRules()) -> dict[str, DataFrame]:
    """Visits, master, maintenance events, windows, day log and labelled features as stage tables."""
    appt = _cut(spark, appointments(agenda), f"{root}/appointments")
    master = _cut(spark, vehicle_master(appt, sales, rules), f"{root}/vehicles")
    maint = _cut(spark, maintenance_events(appt, params), f"{root}/maintenances")
    windows = _cut(spark, wd.build_windows(appt, sales, params, span, rules, master, maint), f"{root}/windows")
    log = _cut(spark, day_log(appt), f"{root}/day_log")
    feats = _cut(spark, build_features(windows.where(F.col("status") == "evaluable"), appt, sales, rules, master, log), f"{root}/features")
    return {"appt": appt, "master": master, "maint": maint, "windows": windows, "log": log, "features": feats, "sales": sales}


def score_population(stages: dict[str, DataFrame], result: dict, span: DataSpan, rules: SaleRules = SaleRules(),
                     segments: SegmentParams = SegmentParams(), days_ahead: int = 30) -> DataFrame:
    """Calibrated probability, segment, priority and three drivers for every vehicle due now."""
    pop = wd.current_population(stages["windows"], span.cutoff, days_ahead)
    f = build_features(pop, stages["appt"], stages["sales"], rules, stages["master"], stages["log"])
    scored, matrix = md.scored_population(result["gbt"], result["gbt_prep"], result["iso_gbt"], f, "prob_churn")
    explain = explainer(result["nodes"], result["gbt_prep"])
    top = shapley(matrix, explain, ["window_id"]).select("window_id", largest(explain.players, 3).alias("_d"))
    ranked = el.rank_scores(scored.withColumn("y", F.lit(0.0)), "window_id", "y", "prob_churn").drop("y")
    values = F.create_map(*[z for c in result["gbt_prep"].numeric for z in (F.lit(c), F.col(c).cast("double"))])
    out = ranked.join(top, "window_id", "left").withColumn("_v", values)
    for i in range(3):
        e = F.col("_d")[i]
        out = out.withColumns({f"driver_{i + 1}": at.driver_text(e["f"], F.try_element_at("_v", e["f"]), e["c"]),
                               f"driver_{i + 1}_feature": e["f"], f"driver_{i + 1}_shap": e["c"]})
    today = F.date_add(F.lit(span.cutoff).cast("date"), 1)
    return (out.drop("_d", "_v").join(wd.pending_bookings(stages["appt"], span.cutoff), "vehicle_id", "left")
            .withColumns({"segmento": bz.segment_by_capacity(F.col("rn"), F.col("total"), segments), "prioridad": F.col("rn"), "fecha_scoring": today,
                          "dias_restantes_horizonte": F.datediff("horizon_end", today), "dias_en_ventana": F.datediff(today, "scoring_date_original"),
                          "tiene_turno_agendado": F.col("fecha_turno_agendado").isNotNull()}).drop("rn", "total"))


def contact_tables(scores: DataFrame, policy: ContactPolicy) -> dict[str, DataFrame]:
    c = ct.contact_candidates(scores, policy)
    return {"contact_candidates": ct.published(c), "contact_clients": ct.contact_clients(c),
            "contact_client_vehicles": ct.client_vehicles(c).withColumnsRenamed({"_cliente": "customer_id", "_vehiculo": "vehicle_id"}),
            "contact_summary": ct.contact_summary(scores, c, policy)}


def refresh_contacts(spark: SparkSession, root: str, dataset_id: str, run_id: str, policy: ContactPolicy = ContactPolicy()) -> None:
    """Recompute the contact tables from the stored scores only."""
    scores = read_latest(spark, f"{root}/published", dataset_id, "scores")
    publish_run({"scores": scores, **contact_tables(scores, policy)}, scores, f"{root}/published", dataset_id, run_id)


def run(spark: SparkSession, agenda: DataFrame, sales: DataFrame, root: str, dataset_id: str, run_id: str,
        params: WindowParams = WindowParams(), span: DataSpan = DataSpan(), split: SplitParams = SplitParams(),
        rules: SaleRules = SaleRules(), business: BusinessParams = BusinessParams(), policy: ContactPolicy = ContactPolicy(),
        segments: SegmentParams = SegmentParams(), max_iter: int = 60) -> dict:
    """Full run: stages, training, evaluation tables, current scores and contact list."""
    st = prepare(spark, agenda, sales, f"{root}/stages/{dataset_id}/{run_id}", params, span, rules)
    result = md.train_all(st["features"], split, max_iter=max_iter)
    md.save_model(result, f"{root}/models/{dataset_id}/{run_id}")
    pairs = result["test"].select(F.col("window_id").alias("id"), "scoring_date", F.col(md.LABEL).alias("y"), F.col("p_gbt").alias("p"))
    ranked = el.rank_scores(pairs)
    seg = ranked.withColumn("segmento", bz.segment_by_capacity(F.col("rn"), F.col("total"), segments))
    scores = _cut(spark, score_population(st, result, span, rules, segments), f"{root}/stages/{dataset_id}/{run_id}/scores")
    tables = {
        "scores": scores, "user_view": bz.user_view(scores), "test_scored": result["test"],
        "metrics": el.compare_models(md.model_table(result, md.heuristic_score(st["features"]))), "importance": md.feature_importance(result),
        "lift": el.lift_table(ranked), "capacity": el.recall_at_capacity(ranked), "calibration": el.calibration_table(ranked), "gains": el.gains_curve(ranked),
        "monthly_capacity": el.recall_at_monthly_capacity(pairs, business.monthly_capacity), "segments": bz.segment_summary(seg),
        "roi": bz.roi_by_capacity(ranked, business), "roi_sensitivity": bz.roi_sensitivity(ranked, business, segments.top_high),
        "monthly_volume": wd.monthly_volume(st["windows"], span.cutoff), **contact_tables(scores, policy),
    }
    publish_run(tables, scores, f"{root}/published", dataset_id, run_id)
    return {"stages": st, "result": result, "scores": scores}
