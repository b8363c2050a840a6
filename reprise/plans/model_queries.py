"""Trained models and what follows from them. Iterative fits have no SQL form; tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.operators import attribution as at, evaluate as el, model as md, newton as nw, pooled as pl, trees as tr, windows as wd
from reprise.plans.channel_queries import _B, _MON, base, history_base, monthly
from reprise.plans.domain import PARAMS, RULES, SPAN, SPLIT, Tables, windows_sql
from reprise.plans.registry import query
from reprise.runtime import stored

_RESULTS: dict = {}
#: Boosting rounds of the trained model and of its ablations.
ROUNDS = 60


def trained(t: Tables) -> dict:
    """Models of this session and folder, fitted once."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.version)
    if key not in _RESULTS:
        _RESULTS[key] = md.train_all(t.features(), SPLIT, max_iter=ROUNDS)
    return _RESULTS[key]


query("temporal_split", "window_id s, period s", """SELECT window_id, CASE WHEN scoring_date <= DATE '1998-12-31' THEN 'train' WHEN scoring_date <= DATE '1999-09-30' THEN 'valid' ELSE 'test' END AS period FROM windows
 WHERE label_churn IS NOT NULL""", "windows")(lambda t: md.temporal_split(t.windows().where(F.col("label_churn").isNotNull()), SPLIT))
query("logreg_scores", "window_id s, label_churn d, p_lr d")(lambda t: trained(t)["test"])
query("gbt_scores", "window_id s, label_churn d, p_gbt_raw d")(lambda t: trained(t)["test"])
query("isotonic_scores", "window_id s, p_gbt_raw d, p_gbt d")(lambda t: trained(t)["test"])
query("model_comparison", "modelo s, n i, base_rate d, roc_auc d, pr_auc d, brier d, log_loss d, ece d")(lambda t: el.compare_models(md.model_table(trained(t), md.heuristic_score(t.features()))))
query("model_importance", "feature s, gain d, gain_pct d, splits i, splits_pct d")(lambda t: md.feature_importance(trained(t)))
query("model_trees", "tree i, node i, input s, threshold d, lower i, upper i, cover d, value d, gain d, weight d")(lambda t: trained(t)["nodes"])


def _test_matrix(t: Tables, model: str):
    return trained(t)[f"{model}_matrix"].where("period = 'test'")


query("attributions_logreg", "window_id s, feature s, contribution d")(lambda t: md.lr_contributions(trained(t), _test_matrix(t, "lr"), ["window_id"]))
query("attributions_gbt", "window_id s, feature s, contribution d")(lambda t: md.tree_contributions(trained(t), _test_matrix(t, "gbt"), ["window_id"]))


def _top3(t: Tables):
    r = trained(t)
    e = tr.explainer(r["nodes"], r["gbt_prep"])
    top = tr.shapley(_test_matrix(t, "gbt"), e, ["window_id"]).select("window_id", F.posexplode(tr.largest(e.players, 3)).alias("k", "d"))
    return top.select("window_id", (F.col("k") + 1).alias("k"), F.col("d.f").alias("feature"), F.col("d.c").alias("contribution"))


query("attributions_top3", "window_id s, k i, feature s, contribution d")(_top3)
query("attributions_global", "feature s, mean_abs_shap_logodds d, mean_abs_shap d")(lambda t: at.global_importance(md.tree_contributions(trained(t), _test_matrix(t, "gbt"), ["window_id"])))
query("isotonic_blocks", "lo d, hi d, w d, value d", """
WITH s AS (SELECT score AS x, count(*) AS w, sum(y) AS wy FROM scored WHERE scoring_date > DATE '1998-12-31' AND scoring_date <= DATE '1999-09-30' GROUP BY 1),
c AS (SELECT x, w, row_number() OVER (ORDER BY x) AS k, sum(w) OVER (ORDER BY x) AS cw, sum(wy) OVER (ORDER BY x) AS cy, wy FROM s),
m AS (SELECT i.k AS i, j.k AS j, (j.cy - i.cy + i.wy) / (j.cw - i.cw + i.w) AS mean FROM c i JOIN c j ON j.k >= i.k),
-- value at k: the largest over i <= k of the least over j >= k of the mean of i..j
low AS (SELECT i, j AS k, min(mean) OVER (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM m),
v AS (SELECT k, max(least) AS value FROM low GROUP BY k)
SELECT min(x) AS lo, max(x) AS hi, sum(w) AS w, min(value) AS value FROM c JOIN v USING (k) GROUP BY round(value, 10)""", "scored")(
    lambda t: pl.isotonic_blocks(md.temporal_split(t.scored(), SPLIT).where("period = 'valid'"), "score", "y"))
query("odds_ratios", "factor s, level s, reference s, odds_ratio d")(lambda t: nw.odds_ratios(base(t), {"gen": "BUILDING", "ScheduleSource": "Dealer", "number_bin": "2"}, "ret"))


#: Single-factor odds ratios are those of the 2 x 2 table of a level against the reference.
query("odds_ratio_by_channel", "factor s, level s, reference s, odds_ratio d", f"""WITH g AS (SELECT ScheduleSource AS level, sum(ret) AS p, sum(1 - ret) AS q FROM {_B} WHERE ScheduleSource IS NOT NULL GROUP BY 1)
 SELECT 'ScheduleSource' AS factor, g.level, r.level AS reference, (g.p / g.q) / (r.p / r.q) AS odds_ratio FROM g JOIN g r ON r.level = 'Dealer' WHERE g.level <> 'Dealer'""", "visits")(
    lambda t: nw.odds_ratios(base(t), {"ScheduleSource": "Dealer"}, "ret"))
query("odds_ratio_by_dealer", "factor s, level s, reference s, coef d", f"""WITH g AS (SELECT dealer_id AS level, sum(ret) AS p, sum(1 - ret) AS q FROM {_B} WHERE dealer_id IS NOT NULL GROUP BY 1)
 SELECT 'dealer_id' AS factor, g.level, r.level AS reference, CASE WHEN g.p = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN g.q = 0 THEN CAST('Infinity' AS DOUBLE) ELSE ln(g.p / g.q) - ln(r.p / r.q) END AS coef
 FROM g JOIN g r ON r.level = 'D1' WHERE g.level <> 'D1'""", "visits")(lambda t: nw.odds_ratios(base(t), {"dealer_id": "D1"}, "ret"))
_HISTORY = {"b_no_show": "0", "b_cancel_true": "0", "b_cancel_resched": "0", "b_recall": "0", "b_repair": "0", "b_diag": "0", "b_return_visit": "0", "b_turnos": "0", "rec": "91-180", "gen": "BUILDING", "number_bin": "2"}
_CONTROLS = {k: v for k, v in _HISTORY.items() if k in ("gen", "number_bin")}
query("odds_ratios_history", "factor s, level s, reference s, odds_ratio d")(lambda t: nw.odds_ratios(history_base(t), _HISTORY, "ret"))
query("odds_ratios_history_without_intensity", "factor s, level s, reference s, odds_ratio d")(
    lambda t: nw.odds_ratios(history_base(t), {k: v for k, v in _HISTORY.items() if k not in ("b_turnos", "rec")}, "ret"))
query("odds_ratios_with_dealer", "factor s, level s, reference s, odds_ratio d")(lambda t: nw.odds_ratios(
    history_base(t), {"ScheduleSource": "Dealer", **_CONTROLS, "b_turnos": "0", "rec": "91-180", "dealer_id": "D1"}, "ret"))
_SEASON = f"""WITH m AS (SELECT month, ln(per_day) AS y, date_diff('month', DATE '1990-01-01', month) AS t, month(month) AS k FROM {_MON}),
 c AS (SELECT k, avg(t) AS mt, avg(y) AS my FROM m GROUP BY k), s AS (SELECT sum((t - mt) * (y - my)) / sum((t - mt) * (t - mt)) AS b FROM m JOIN c USING (k)),
 e AS (SELECT k, my - b * mt AS a FROM c, s) SELECT month, a + b * t AS fitted, y - a - b * t AS residual, 100 * exp(a - (SELECT avg(a) FROM e)) AS index FROM m JOIN e USING (k), s"""
query("seasonal_regression", "month t, fitted d, residual d, index d", _SEASON, "visits")(lambda t: md.seasonal_regression(monthly(t)))


def _leaky(t: Tables):
    from reprise.operators.features import build_features
    w = lambda: wd.build_windows(t.appt(), t.sales(), PARAMS.with_(km_source="km"), SPAN, RULES, t.master()).where("status = 'evaluable'")
    return t.stage("features_snapshot", lambda: build_features(w(), t.appt(), t.sales(), RULES, t.master(), t.day_log()))


query("ablations", "modelo s, n i, base_rate d, roc_auc d, pr_auc d, brier d, ece d")(lambda t: md.ablations(t.features(), _leaky(t), SPLIT, max_iter=ROUNDS))

_SUMMARY_SQL = """
SELECT count(*) FILTER (WHERE status = 'evaluable') AS n_evaluables, avg(label_churn) AS churn_rate, count(*) FILTER (WHERE status = 'preempted') / greatest(count(*) FILTER (WHERE status <> 'fuera_de_rango'), 1) AS pct_preempted,
 avg(CAST(binding_rule = 'piso' AS INTEGER)) FILTER (WHERE status = 'evaluable') AS pct_piso, avg(CAST(binding_rule = 'km' AS INTEGER)) FILTER (WHERE status = 'evaluable') AS pct_km,
 avg(CAST(next_maint_date > scoring_date AND next_maint_date <= horizon_end AS INTEGER)) FILTER (WHERE status IN ('evaluable', 'preempted') AND next_maint_date - anchor_date <= 548) AS captura_retornos_18m,
 count(*) FILTER (WHERE status IN ('evaluable', 'preempted') AND next_maint_date - anchor_date <= 548) AS n_retornos_18m, median(days_next_vs_due) FILTER (WHERE status = 'evaluable' AND label_churn = 0) AS mediana_dias_retorno_vs_due
FROM windows"""
query("window_summary", "n_evaluables i, churn_rate d, pct_preempted d, pct_piso d, pct_km d, captura_retornos_18m d, n_retornos_18m i, mediana_dias_retorno_vs_due d", _SUMMARY_SQL, "windows")(lambda t: wd.window_summary(t.windows()))


def _definition_sql() -> str:
    """The summary text over every definition's windows."""
    text = _SUMMARY_SQL.split("FROM windows")[0]
    return " UNION ALL ".join(f"SELECT '{name}' AS params, * FROM ({text} FROM ({windows_sql(p, 'maint_km' if p.km_source == 'km' else 'maint')}))" for name, p in wd.default_grid(PARAMS).items())


query("window_sensitivity", "params s, n_evaluables i, churn_rate d, pct_preempted d, pct_piso d, pct_km d, captura_retornos_18m d, n_retornos_18m i, mediana_dias_retorno_vs_due d", _definition_sql(), "maint maint_km vm appt")(
    lambda t: wd.window_sensitivity(t.appt(), t.sales(), wd.default_grid(PARAMS), SPAN, RULES))


def _definitions(t: Tables):
    """Evaluable windows of all definitions with their features."""
    from reprise.operators.features import features_of_definitions

    def build():
        keep = ["vehicle_id", "scoring_date", "anchor_type", "anchor_date", "anchor_km", "k_gen", "km_rate_per_day", "rate_source", "due_date", "binding_rule", "history_days", "generation", "label_churn"]
        out = None
        for name, w in wd.windows_by_definition(t.appt(), t.sales(), wd.default_grid(PARAMS), SPAN, RULES).items():
            rows = w.where("status = 'evaluable'").select(F.lit(name).alias("definition"), *keep)
            out = rows if out is None else out.unionByName(rows)
        # rows are many (one a definition), and only the check reads them: no column that it doesn't
        return md.checked_columns(features_of_definitions(stored(out), t.appt(), t.sales(), RULES, t.master(), t.day_log()))
    return t.stage("definition_features", build)


query("window_model_check", "definition s, n_train i, n_test i, base_rate d, roc_auc d, pr_auc d")(lambda t: md.check_definitions(_definitions(t), SPLIT))
