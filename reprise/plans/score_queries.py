"""Evaluation, business and contact queries on the rule score."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.operators import business as bz, contact as ct, evaluate as el, windows as wd, attribution as at
from reprise.plans.domain import BUSINESS, DRIVER_WEIGHTS, POLICY, SPAN, SPLIT, Tables, rule_scores
from reprise.plans.registry import query

query("heuristic_score", "id s, y d, score d, p d", "SELECT * FROM scored", "scored")(lambda t: t.scored())

query("temporal_split_support", "period s, first_scoring t, last_scoring t, n i, base_rate d", """
SELECT CASE WHEN scoring_date <= DATE '1998-12-31' THEN 'train' WHEN scoring_date <= DATE '1999-09-30' THEN 'valid' ELSE 'test' END AS period,
 min(scoring_date) AS first_scoring, max(scoring_date) AS last_scoring, count(*) AS n, avg(label_churn) AS base_rate
FROM windows WHERE label_churn IS NOT NULL GROUP BY 1""", "windows")(
    lambda t: wd.temporal_support(t.windows(), SPLIT.train_end, SPLIT.valid_end))

query("horizon_crossing", "period s, windows i, crossing i, share d", """
SELECT period, count(*) AS windows, count(*) FILTER (WHERE horizon_end > lim) AS crossing, avg(CAST(horizon_end > lim AS INTEGER)) AS share FROM (
 SELECT horizon_end, CASE WHEN scoring_date <= DATE '1998-12-31' THEN 'train' ELSE 'valid' END AS period,
  CASE WHEN scoring_date <= DATE '1998-12-31' THEN DATE '1998-12-31' ELSE DATE '1999-09-30' END AS lim
 FROM windows WHERE status = 'evaluable' AND scoring_date <= DATE '1999-09-30') GROUP BY 1""", "windows")(
    lambda t: wd.horizon_crossing(t.windows(), SPLIT.train_end, SPLIT.valid_end))

_AUC = """(SELECT (sum(r) - max(np) * (max(np) + 1) / 2) / (max(np) * (max(n) - max(np))) FROM (SELECT CASE WHEN y = 1 THEN rk END AS r,
 sum(y) OVER () AS np, count(*) OVER () AS n FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM scored)))"""
query("roc_auc", "n i, base_rate d, roc_auc d", f"SELECT count(*) AS n, avg(y) AS base_rate, {_AUC} AS roc_auc FROM scored", "scored")(
    lambda t: el.discrimination(t.scored()))

_STEPS = """SELECT p, n, pos, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(pos) OVER () AS tp
 FROM (SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p)"""
query("average_precision", "n i, pr_auc d", f"SELECT sum(n) AS n, sum(pos / tp * cp / cn) AS pr_auc FROM ({_STEPS})", "scored")(
    lambda t: el.discrimination(t.scored()))
query("precision_recall_points", "precision d, recall d, umbral d", f"SELECT cp / cn AS precision, cp / tp AS recall, p AS umbral FROM ({_STEPS})",
      "scored")(lambda t: el.precision_recall_points(t.scored()))
query("brier_logloss", "brier d, log_loss d", """SELECT avg((p - y) * (p - y)) AS brier,
 avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS log_loss FROM scored""", "scored")(
    lambda t: el.probability_losses(t.scored()))
query("brier_outside_unit_interval", "brier d, log_loss d", "SELECT NULL AS brier, NULL AS log_loss")(
    lambda t: el.probability_losses(t.scored(), p="score"))

query("lift_table", "decil i, n i, churners d, p_medio d, tasa d, lift d, cum_churners d, cum_recall d, cum_n i, cum_precision d, cum_lift d", """
SELECT *, tasa / base AS lift, cum_churners / tot AS cum_recall, cum_churners / cum_n AS cum_precision, cum_churners / cum_n / base AS cum_lift FROM (
 SELECT *, churners / n AS tasa, sum(churners) OVER () AS tot, sum(churners) OVER () / sum(n) OVER () AS base,
  sum(churners) OVER (ORDER BY decil) AS cum_churners, sum(n) OVER (ORDER BY decil) AS cum_n FROM (
  SELECT ((rn - 1) * 10) // total + 1 AS decil, count(*) AS n, sum(y) AS churners, avg(p) AS p_medio FROM ranked GROUP BY 1))""", "ranked")(
    lambda t: el.lift_table(t.ranked()))

_CAP = """SELECT f, greatest(CAST(round_even(f * max(total), 0) AS BIGINT), {floor}) AS k, max(total) AS n, sum(y) AS pos FROM ranked,
 (SELECT unnest([{fs}]::DOUBLE[]) AS f) GROUP BY f"""
query("recall_at_capacity", "capacidad_pct d, contactados i, churners_capturados i, recall d, precision d, lift d, umbral_score d", f"""
SELECT f AS capacidad_pct, k AS contactados, sum(y) AS churners_capturados, sum(y) / max(pos) AS recall, avg(y) AS precision,
 avg(y) / (max(pos) / max(n)) AS lift, min(p) AS umbral_score
FROM ({_CAP.format(floor=1, fs='0.05, 0.1, 0.2, 0.3, 0.4, 0.5')}) JOIN ranked ON rn <= k GROUP BY f, k""", "ranked")(
    lambda t: el.recall_at_capacity(t.ranked()))

query("monthly_capacity", "k_por_mes i, contactados i, churners_capturados i, recall d, precision d, meses i", """
SELECT 40 AS k_por_mes, count(*) FILTER (WHERE k <= 40) AS contactados, sum(y) FILTER (WHERE k <= 40) AS churners_capturados,
 sum(y) FILTER (WHERE k <= 40) / sum(y) AS recall, avg(y) FILTER (WHERE k <= 40) AS precision, count(DISTINCT mes) AS meses
FROM (SELECT y, date_trunc('month', scoring_date) AS mes, row_number() OVER (PARTITION BY date_trunc('month', scoring_date) ORDER BY p DESC, id) AS k FROM scored)""",
      "scored")(lambda t: el.recall_at_monthly_capacity(t.scored(), BUSINESS.monthly_capacity))

_CAL = """SELECT bin, count(*) AS n, avg(p) AS score_medio, avg(y) AS tasa_observada, abs(avg(y) - avg(p)) AS gap FROM (
 SELECT greatest(CAST(ceil((rk - 1) * 10 / (total - 1)) AS BIGINT) - 1, 0) AS bin, p, y FROM (SELECT *, total - rn + 1 AS rk FROM ranked)) GROUP BY bin"""
query("calibration_table", "bin i, n i, score_medio d, tasa_observada d, gap d", _CAL, "ranked")(lambda t: el.calibration_table(t.ranked()))
query("calibration_ece", "ece d", f"SELECT sum(gap * n) / sum(n) AS ece FROM ({_CAL})", "ranked")(
    lambda t: el.expected_calibration_error(t.ranked()))

query("gains_curve", "pct_contactados d, pct_churners_capturados d", """
SELECT j * 0.01 AS pct_contactados, CASE WHEN j = 0 THEN 0 ELSE max(c) FILTER (WHERE rn <= greatest(CAST(floor(j * CAST(0.01 AS DOUBLE) * total) AS BIGINT), 1)) END AS pct_churners_capturados
FROM (SELECT unnest(range(101)) AS j), (SELECT rn, total, sum(y) OVER (ORDER BY rn) / sum(y) OVER () AS c FROM ranked) GROUP BY j""", "ranked")(
    lambda t: el.gains_curve(t.ranked()))


def _models(t: Tables):
    s = t.scored()
    alt = s.select(F.lit("age_rule").alias("modelo"), "id", "y", F.least(F.coalesce(F.col("vehicle_age_years"), F.lit(0.0)) / 10, F.lit(1.0)).alias("p"))
    return (s.select(F.lit("rule").alias("modelo"), "id", "y", "p").unionByName(alt)
            .unionByName(s.select(F.lit("rule_raw").alias("modelo"), "id", "y", F.col("score").alias("p"))))


_LONG = """SELECT 'rule' AS modelo, id, y, p FROM scored UNION ALL SELECT 'age_rule', id, y, least(coalesce(vehicle_age_years, 0) / 10, 1) FROM scored
 UNION ALL SELECT 'rule_raw', id, y, score FROM scored"""
_METRICS = """WITH l AS ({long}), st AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY g) AS tp, sum(n) OVER (PARTITION BY g) AS tn
  FROM (SELECT g, p, count(*) AS n, sum(y) AS pos FROM l GROUP BY 1, 2) WINDOW w AS (PARTITION BY g ORDER BY p DESC))
 SELECT g, max(tn) AS n, max(tp) / max(tn) AS base_rate, sum((n - pos) * (cp - pos / 2)) / (max(tp) * (max(tn) - max(tp))) AS roc_auc,
  sum(pos / tp * cp / cn) AS pr_auc FROM st GROUP BY g"""
query("compare_models", "modelo s, n i, base_rate d, roc_auc d, pr_auc d, brier d, log_loss d, ece d", f"""
WITH m AS ({_METRICS.format(long=f"SELECT modelo AS g, y, p FROM ({_LONG})")}),
pl AS (SELECT modelo, min(p) >= 0 AND max(p) <= 1 AS ok, avg((p - y) * (p - y)) AS b,
 avg(-(y * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS l FROM ({_LONG}) GROUP BY 1),
e AS (SELECT modelo, sum(gap * n) / sum(n) AS ece FROM (SELECT modelo, bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM (
 SELECT modelo, y, p, greatest(CAST(ceil((rk - 1) * 10 / (t - 1)) AS BIGINT) - 1, 0) AS bin FROM (SELECT *, count(*) OVER (PARTITION BY modelo) AS t,
  row_number() OVER (PARTITION BY modelo ORDER BY p, id DESC) AS rk FROM ({_LONG}))) GROUP BY 1, 2) GROUP BY 1)
SELECT g AS modelo, n, base_rate, roc_auc, pr_auc, CASE WHEN ok THEN b END AS brier, CASE WHEN ok THEN l END AS log_loss, CASE WHEN ok THEN ece END AS ece
FROM m JOIN pl ON pl.modelo = g JOIN e ON e.modelo = g""", "scored")(lambda t: el.compare_models(_models(t)))

query("subgroup_metrics", "binding_rule s, n i, base_rate d, roc_auc d, pr_auc d", f"""
SELECT g AS binding_rule, n, base_rate, roc_auc, pr_auc FROM ({_METRICS.format(long="SELECT binding_rule AS g, y, p FROM scored")})
WHERE n >= 500 AND base_rate > 0 AND base_rate < 1""", "scored")(lambda t: el.subgroup_metrics(t.scored(), "binding_rule"))

# ------------------------------------------------------------------------------------------ business
_SEG = "CASE WHEN rn / total <= 0.2 THEN 'Alto' WHEN rn / total <= 0.5 THEN 'Medio' ELSE 'Bajo' END"
query("segments_by_capacity", "id s, rn i, segmento s", f"SELECT id, rn, {_SEG} AS segmento FROM ranked", "ranked")(
    lambda t: t.ranked().withColumn("segmento", bz.segment_by_capacity(F.col("rn"), F.col("total"))))
query("segments_by_threshold", "segmento s, n i", """SELECT CASE WHEN p >= 0.45 THEN 'Alto' WHEN p >= 0.3 THEN 'Medio' ELSE 'Bajo' END AS segmento, count(*) AS n
 FROM scored GROUP BY 1""", "scored")(
    lambda t: t.scored().groupBy(bz.segment_by_threshold(F.col("p"), 0.45, 0.3).alias("segmento")).agg(F.count(F.lit(1)).alias("n")))
query("segment_summary", "segmento s, n i, p_media d, tasa_churn d, churners d, share_churners d, share d", f"""
SELECT segmento, count(*) AS n, avg(p) AS p_media, avg(y) AS tasa_churn, sum(y) AS churners, sum(y) / (SELECT sum(y) FROM ranked) AS share_churners,
 count(*) / (SELECT count(*) FROM ranked) AS share FROM (SELECT *, {_SEG} AS segmento FROM ranked) GROUP BY 1""", "ranked")(
    lambda t: bz.segment_summary(t.ranked().withColumn("segmento", bz.segment_by_capacity(F.col("rn"), F.col("total")))))

_ROI = "contactos i, churners_alcanzados_modelo i, churners_alcanzados_azar i, recall_modelo d, recall_azar d, services_recuperados_modelo d, " \
       "services_recuperados_azar d, valor_modelo_usd d, valor_azar_usd d, costo_contacto_usd d, beneficio_neto_modelo_usd d, " \
       "beneficio_neto_azar_usd d, ganancia_incremental_usd d, roi_modelo d"
query("roi_by_capacity", "capacidad_pct d, " + _ROI, f"""
SELECT f AS capacidad_pct, k AS contactos, h AS churners_alcanzados_modelo, round_even(rd, 0) AS churners_alcanzados_azar, h / pos AS recall_modelo,
 rd / pos AS recall_azar, h * 0.15 AS services_recuperados_modelo, rd * 0.15 AS services_recuperados_azar, h * 37.5 AS valor_modelo_usd, rd * 37.5 AS valor_azar_usd,
 k * 3.0 AS costo_contacto_usd, h * 37.5 - k * 3.0 AS beneficio_neto_modelo_usd, rd * 37.5 - k * 3.0 AS beneficio_neto_azar_usd,
 (h - rd) * 37.5 AS ganancia_incremental_usd, (h * 37.5 - k * 3.0) / (k * 3.0) AS roi_modelo
FROM (SELECT f, k, pos, sum(y) AS h, pos / n * k AS rd FROM ({_CAP.format(floor=0, fs='0.1, 0.2, 0.3, 0.5')}) JOIN ranked ON rn <= k GROUP BY f, k, pos, n)""",
      "ranked")(lambda t: bz.roi_by_capacity(t.ranked(), BUSINESS))
query("roi_sensitivity", "uplift d, valor_retencion_usd d, ganancia_incremental_usd d, beneficio_neto_modelo_usd d, roi_modelo d", f"""
SELECT u AS uplift, v AS valor_retencion_usd, (h - rd) * u * v AS ganancia_incremental_usd, h * u * v - k * 3.0 AS beneficio_neto_modelo_usd,
 (h * u * v - k * 3.0) / (k * 3.0) AS roi_modelo
FROM (SELECT k, sum(y) AS h, pos / n * k AS rd FROM ({_CAP.format(floor=0, fs='0.2')}) JOIN ranked ON rn <= k GROUP BY k, pos, n),
 (SELECT unnest([0.05, 0.10, 0.15, 0.25]::DOUBLE[]) AS u), (SELECT unnest([100, 200, 300, 500]::DOUBLE[]) AS v)""", "ranked")(
    lambda t: bz.roi_sensitivity(t.ranked(), BUSINESS))

# ------------------------------------------------------------------------------------------- current
query("current_population", "window_id s, vehicle_id s, scoring_date t, scoring_date_original t, poblacion_actual s, status s", "SELECT * FROM pop", "pop")(
    lambda t: t.current())
query("monthly_window_volume", "mes t, n i", """SELECT date_trunc('month', scoring_date) AS mes, count(*) AS n FROM windows WHERE status IN ('evaluable', 'censurada')
 AND date_trunc('month', scoring_date) <= DATE '2001-02-01' GROUP BY 1""", "windows")(lambda t: wd.monthly_volume(t.windows(), SPAN.cutoff))
query("pending_bookings", "vehicle_id s, fecha_turno_agendado t", """SELECT vehicle_id, min(ScheduleDate) AS fecha_turno_agendado FROM appt
 WHERE pending AND ScheduleDate > DATE '2001-02-28' AND vehicle_id IS NOT NULL GROUP BY 1""", "appt")(lambda t: wd.pending_bookings(t.appt(), SPAN.cutoff))
query("current_scores", "window_id s, vehicle_id s, customer_id s, prob_churn d, prioridad i, segmento s, driver_1 s, driver_2 s, driver_3 s, driver_1_feature s, "
      "driver_2_feature s, driver_3_feature s, driver_1_shap d, driver_2_shap d, driver_3_shap d, fecha_scoring t, dias_restantes_horizonte i, dias_en_ventana i, "
      "tiene_turno_agendado b, fecha_turno_agendado t, n_maint i, last_maint_dealer s, days_since_last_maint i, vencimiento_estimado t, cierre_horizonte t, "
      "fecha_apertura_ventana t", "SELECT * FROM scores_now", "scores_now")(lambda t: t.scores_now())
query("user_view", "customer_id s, vehiculos_en_ventana i, prob_max d, prob_media d, algun_alto b", """SELECT customer_id, count(*) AS vehiculos_en_ventana,
 max(prob_churn) AS prob_max, avg(prob_churn) AS prob_media, bool_or(segmento = 'Alto') AS algun_alto FROM scores_now WHERE customer_id IS NOT NULL GROUP BY 1""",
      "scores_now")(lambda t: bz.user_view(t.scores_now()))
query("local_attributions", "window_id s, feature s, contribution d", """
SELECT window_id, f AS feature, wt * (v - avg(v) OVER (PARTITION BY f)) AS contribution FROM (
 SELECT window_id, unnest(['vehicle_age_years', 'n_noshow', 'n_cancel', 'n_maint', 'is_first_service', 'days_since_last_maint']) AS f,
  unnest([0.25, 0.6, 0.3, -0.3, 0.8, 0.002]) AS wt,
  unnest([vehicle_age_years, n_noshow, n_cancel, n_maint, is_first_service, days_since_last_maint]::DOUBLE[]) AS v FROM features)""", "features")(
    lambda t: at.linear_contributions(t.features(), DRIVER_WEIGHTS, ["window_id"]))
query("global_importance", "feature s, mean_abs_shap_logodds d, mean_abs_shap d", """
SELECT feature, avg(abs(c)) AS mean_abs_shap_logodds, 25 * avg(abs(c)) AS mean_abs_shap FROM (SELECT f AS feature, wt * (v - avg(v) OVER (PARTITION BY f)) AS c FROM (
 SELECT unnest(['vehicle_age_years', 'n_noshow', 'n_cancel', 'n_maint', 'is_first_service', 'days_since_last_maint']) AS f,
  unnest([0.25, 0.6, 0.3, -0.3, 0.8, 0.002]) AS wt,
  unnest([vehicle_age_years, n_noshow, n_cancel, n_maint, is_first_service, days_since_last_maint]::DOUBLE[]) AS v FROM features)) GROUP BY 1""", "features")(
    lambda t: at.global_importance(at.linear_contributions(t.features(), DRIVER_WEIGHTS, ["window_id"])))

# ------------------------------------------------------------------------------------------- contact
_CAND = "window_id s, customer_id s, vehicle_id s, segmento s, prob_churn d, estado_contacto s, motivos_operativos s, shap_accionable b, vinculo_reciente b, " \
        "representante b, orden_contacto i, seleccionado b, en_espera b, vehiculos_cliente s, n_vehiculos_cliente i, grupos_cliente s"
query("contact_candidates", _CAND, "SELECT * FROM candidates", "candidates")(lambda t: t.candidates())
query("contact_clients", _CAND, "SELECT * FROM candidates WHERE representante", "candidates")(lambda t: ct.contact_clients(t.candidates()))
query("contact_client_vehicles", "customer_id s, vehicle_id s", "SELECT DISTINCT cli AS customer_id, veh AS vehicle_id FROM candidates WHERE cli <> '' AND veh <> ''",
      "candidates")(lambda t: ct.client_vehicles(t.candidates()).withColumnsRenamed({"_cliente": "customer_id", "_vehiculo": "vehicle_id"}))
query("contact_client_pages", "customer_id s, page i, n i, first s, last s", """SELECT cli AS customer_id, (k - 1) // 1000 AS page, count(*) AS n, min(veh) AS first, max(veh) AS last FROM (SELECT cli, veh, row_number() OVER (PARTITION BY cli ORDER BY veh) AS k
 FROM (SELECT DISTINCT cli, veh FROM candidates WHERE cli <> '' AND veh <> '')) GROUP BY 1, 2""", "candidates")(
    lambda t: ct.client_pages(t.candidates()).select(F.col("_cliente").alias("customer_id"), "page", "n", F.col("vehicles")[0].alias("first"), F.element_at("vehicles", -1).alias("last")))
query("contact_summary", "capacidad_por_corrida i, poblacion_inicial i, candidatos i, origen_alto i, origen_medio i, clientes_identificados i, clientes_elegibles i, "
      "clientes_seleccionados i, clientes_en_espera i, clientes_revisar i, vehiculos_sin_identificador i, vehiculos_unificados i, vehiculos_contactar i, clientes_contactar i, "
      "vehiculos_con_turno i, clientes_con_turno i, vehiculos_sin_margen i, vehiculos_revisar i", """
SELECT 60 AS capacidad_por_corrida, (SELECT count(*) FROM scores_now) AS poblacion_inicial, count(*) AS candidatos, count(*) FILTER (WHERE segmento = 'Alto') AS origen_alto,
 count(*) FILTER (WHERE segmento = 'Medio') AS origen_medio, count(*) FILTER (WHERE representante) AS clientes_identificados,
 count(*) FILTER (WHERE representante AND ok) AS clientes_elegibles, count(*) FILTER (WHERE seleccionado) AS clientes_seleccionados,
 count(*) FILTER (WHERE en_espera) AS clientes_en_espera, count(*) FILTER (WHERE representante AND estado_contacto = 'Revisar') AS clientes_revisar,
 count(*) FILTER (WHERE estado_contacto = 'Sin identificador') AS vehiculos_sin_identificador, count(*) FILTER (WHERE cli <> '' AND NOT representante) AS vehiculos_unificados,
 count(*) FILTER (WHERE ok) AS vehiculos_contactar, count(*) FILTER (WHERE representante AND ok) AS clientes_contactar,
 count(*) FILTER (WHERE estado_contacto = 'Con turno') AS vehiculos_con_turno, count(*) FILTER (WHERE representante AND estado_contacto = 'Con turno') AS clientes_con_turno,
 count(*) FILTER (WHERE estado_contacto = 'Sin margen') AS vehiculos_sin_margen, count(*) FILTER (WHERE estado_contacto = 'Revisar') AS vehiculos_revisar
FROM candidates""", "candidates")(lambda t: ct.contact_summary(t.scores_now(), t.candidates(), POLICY))
query("contact_funnel", "step i, stage s, n i", """
SELECT 1 AS step, 'scored' AS stage, (SELECT count(*) FROM scores_now) AS n UNION ALL SELECT 2, 'in_groups', count(*) FROM candidates
UNION ALL SELECT 3, 'without_identifier', count(*) FILTER (WHERE estado_contacto = 'Sin identificador') FROM candidates
UNION ALL SELECT 4, 'consolidated_clients', count(*) FILTER (WHERE representante) FROM candidates
UNION ALL SELECT 5, 'eligible_clients', count(*) FILTER (WHERE representante AND ok) FROM candidates
UNION ALL SELECT 6, 'selected_clients', count(*) FILTER (WHERE seleccionado) FROM candidates""", "candidates")(lambda t: ct.funnel(t.scores_now(), t.candidates()))
_VIEW = """SELECT *, segmento AS grupo, last_maint_dealer AS concesionario, CASE WHEN seleccionado THEN 'Seleccionado' WHEN en_espera THEN 'En espera'
 WHEN ok AND NOT representante THEN 'Otro vehículo representa al cliente' ELSE estado_contacto END AS situacion FROM candidates"""
query("operational_view", "vehicle_id s, customer_id s, situacion s, grupo s, concesionario s, orden_contacto i", _VIEW, "candidates")(
    lambda t: ct.operational_view(t.candidates()))
query("operational_filter", "vehicle_id s, customer_id s, situacion s, grupo s", f"""SELECT * FROM ({_VIEW}) WHERE grupo = 'Alto'
 AND (contains(lower(customer_id), 'c1') OR contains(lower(vehicle_id), 'c1') OR contains(lower(vehiculos_cliente), 'c1'))""", "candidates")(
    lambda t: ct.filter_view(ct.operational_view(t.candidates()), group="Alto", search="C1"))
