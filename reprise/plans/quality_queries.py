"""Data quality, coverage, left-censoring and leak checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from reprise.functions.columns import count_if, cut, share
from reprise.operators import features as ft, quality as ql, stats as st
from reprise.operators.asof import asof_join, asof_nearest, asof_tolerance
from reprise.operators.events import clean_km, event_rule
from reprise.operators.history import counts_before, previous_row
from reprise import fixed_values as fv
from reprise.plans.domain import AGENDA, RULES, SPAN, Tables
from reprise.plans.registry import query
from reprise.runtime import shared_path
from reprise.sources import records as rc
from reprise.sources.validation import profile_extract

one = lambda: F.count(F.lit(1))
_DATES = [dt.date(1996, 7, 1), dt.date(1997, 7, 1), dt.date(1999, 1, 1), dt.date(2001, 2, 28)]
query("left_censoring", "scoring_date t, active i, without_maint d, mean_maint d, median_recency d", """
SELECT t AS scoring_date, count(*) AS active, avg(CAST(n = 0 AS INTEGER)) AS without_maint, avg(n) AS mean_maint, median(t - l) AS median_recency FROM (
 SELECT t, v.vehicle_id, count(m.event_date) AS n, max(m.event_date) AS l FROM (SELECT unnest([DATE '1996-07-01', DATE '1997-07-01', DATE '1999-01-01', DATE '2001-02-28']) AS t) d
 JOIN (SELECT vehicle_id, min(event_date) AS f FROM visits GROUP BY 1) v ON v.f < t LEFT JOIN maint m ON m.vehicle_id = v.vehicle_id AND m.event_date < t GROUP BY 1, 2) GROUP BY 1""", "visits maint")(
    lambda t: ql.history_depth(t.visits(), t.maint(), _DATES))


def _lookback(t: Tables):
    cut_ = F.lit(SPAN.cutoff)
    act = t.visits().where((F.col("event_date") < cut_) & (F.col("event_date") >= F.date_sub(cut_, 182))).select("vehicle_id").distinct()
    m = t.maint().where(F.col("event_date") < cut_).groupBy("vehicle_id").agg(F.max("event_date").alias("last"))
    j = act.join(m, "vehicle_id", "left")
    rows = [F.struct(F.lit(d).alias("days"), F.avg((~F.coalesce(F.col("last") >= F.date_sub(cut_, d), F.lit(False))).cast("double")).alias("without_maint")) for d in (182, 366, 547, 731, 2250)]
    return j.agg(one().alias("n"), F.array(*rows).alias("a")).select("n", F.explode("a").alias("x")).select("n", "x.*")


query("left_censoring_lookback", "n i, days i, without_maint d", """SELECT count(*) AS n, d AS days, avg(CAST(NOT EXISTS (SELECT 1 FROM maint m WHERE m.vehicle_id = a.vehicle_id AND m.event_date < DATE '2001-02-28' AND m.event_date >= DATE '2001-02-28' - d) AS INTEGER)) AS without_maint
FROM (SELECT DISTINCT vehicle_id FROM visits WHERE event_date < DATE '2001-02-28' AND event_date >= DATE '2001-02-28' - 182) a, (SELECT unnest([182, 366, 547, 731, 2250]) AS d) GROUP BY d""", "visits maint")(_lookback)


def _hidden(t: Tables):
    """Plan number above the visible count hints at services before or outside the data."""
    g = t.maint().groupBy("vehicle_id").agg(one().alias("n"), F.max_by("maint_number", "event_date").alias("num"))
    g = g.join(t.master().select("vehicle_id", "warranty_agenda"), "vehicle_id", "left")
    return g.groupBy((F.col("warranty_agenda") >= F.lit(SPAN.start)).alias("fully_visible")).agg(one().alias("vehicles"), share(F.col("num") > F.col("n")).alias("gap_positive"), F.avg(F.col("num") - F.col("n")).alias("mean_gap"))


query("hidden_service_gap", "fully_visible b, vehicles i, gap_positive d, mean_gap d", """SELECT warranty_agenda >= DATE '1995-01-01' AS fully_visible, count(*) AS vehicles, avg(CAST(num > n AS INTEGER)) AS gap_positive, avg(num - n) AS mean_gap
 FROM (SELECT vehicle_id, count(*) AS n, last(maint_number ORDER BY event_date) AS num FROM maint GROUP BY 1) LEFT JOIN vm USING (vehicle_id) GROUP BY 1""", "maint vm")(_hidden)
query("connectivity_by_quarter", "quarter t, connected_status s, n i, share d", """SELECT date_trunc('quarter', event_date) AS quarter, coalesce(ConnectedStatusARG, 'none') AS connected_status, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('quarter', event_date)) AS share
 FROM visits GROUP BY 1, 2""", "visits")(lambda t: st.value_shares(t.visits().select(F.trunc("event_date", "quarter").alias("quarter"), F.coalesce("ConnectedStatusARG", F.lit("none")).alias("connected_status")), ["quarter"], "connected_status"))
query("connectivity_outcome", "stratum s, level s, n i, rate d", """SELECT coalesce(generation, '(nulo)') AS stratum, coalesce(connected_status, '(nulo)') AS level, count(*) AS n, avg(label_churn) AS rate FROM features GROUP BY 1, 2 HAVING count(*) >= 50""", "features")(
    lambda t: st.strat_table(t.features(), "connected_status", "generation", "label_churn", 50))
query("survey_lag", "n i, mean d, p25 d, p50 d, p75 d, same_or_before i", """SELECT count(*) AS n, avg(g) AS mean, quantile_cont(g, 0.25) AS p25, median(g) AS p50, quantile_cont(g, 0.75) AS p75, count(*) FILTER (WHERE g <= 0) AS same_or_before
 FROM (SELECT SurveyResponseDate - event_date AS g FROM appt WHERE SurveyResponseDate IS NOT NULL)""", "appt")(
    lambda t: (lambda s: st.day_percentiles(s, [], "g", [.25, .5, .75]).withColumn("same_or_before", s.agg(count_if(F.col("g") <= 0).alias("c")).scalar()))(
        t.appt().where(F.col("SurveyResponseDate").isNotNull()).select(F.datediff("SurveyResponseDate", "event_date").alias("g"))))


def _survey_prior(t: Tables):
    s = t.visits().where(F.col("SurveyResponseDate").isNotNull()).select("schedule_id", "vehicle_id", "SurveyResponseDate")
    v = t.visits().where("completed").select("vehicle_id", F.col("event_date").alias("visit_at"), F.col("schedule_id").alias("visit_id"))
    j = asof_join(s, v, "vehicle_id", "SurveyResponseDate", "visit_at", ["visit_at", "visit_id"], "backward", True, ["visit_id"])
    return j.groupBy((F.col("visit_id") == F.col("schedule_id")).alias("own_visit")).agg(one().alias("n"), F.avg(F.datediff("SurveyResponseDate", "visit_at")).alias("mean_gap"))


query("asof_backward_nonstrict", "own_visit b, n i, mean_gap d", """SELECT v.schedule_id = s.schedule_id AS own_visit, count(*) AS n, avg(s.SurveyResponseDate - v.event_date) AS mean_gap FROM (SELECT * FROM visits WHERE SurveyResponseDate IS NOT NULL) s
 LEFT JOIN LATERAL (SELECT schedule_id, event_date FROM visits x WHERE x.vehicle_id = s.vehicle_id AND x.completed AND x.event_date <= s.SurveyResponseDate ORDER BY event_date DESC, schedule_id DESC LIMIT 1) v ON true GROUP BY 1""", "visits")(_survey_prior)
query("survey_repeated", "rating d, surveys i, visits i", """SELECT rating, count(*) AS surveys, sum(k) AS visits FROM (SELECT vehicle_id, SurveyResponseDate, max(SurveyStarRating) AS rating, count(*) AS k FROM visits WHERE SurveyResponseDate IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""", "visits")(
    lambda t: t.visits().where(F.col("SurveyResponseDate").isNotNull()).groupBy("vehicle_id", "SurveyResponseDate").agg(F.max("SurveyStarRating").alias("rating"), one().alias("k")).where("k > 1").groupBy("rating").agg(
        one().alias("surveys"), F.sum("k").alias("visits")))
query("pending_ledger", "status s, timing s, n i, vehicles i", """SELECT StatusARG AS status, CASE WHEN ScheduleDate > DATE '2001-02-28' THEN 'future' WHEN ScheduleDate > DATE '2001-02-28' - 30 THEN 'recent' ELSE 'stale' END AS timing, count(*) AS n,
 count(DISTINCT vehicle_id) AS vehicles FROM appt WHERE pending GROUP BY 1, 2""", "appt")(
    lambda t: t.appt().where("pending").groupBy(F.col("StatusARG").alias("status"), F.when(F.col("ScheduleDate") > F.lit(SPAN.cutoff), "future").when(F.col("ScheduleDate") > F.date_sub(F.lit(SPAN.cutoff), 30), "recent").otherwise(
        "stale").alias("timing")).agg(one().alias("n"), F.count_distinct("vehicle_id").alias("vehicles")))

_gap = lambda: F.datediff("EffectiveCheckinDate", "ScheduleDate")
_AG_RULES = {
    "model_year_low": "ModelYear < 1991", "model_year_null": "ModelYear IS NULL", "warranty_model_gap": "abs(year(WarrantyStartDate) - ModelYear) > 1", "checkin_before_start": "EffectiveCheckinDate < DATE '1995-01-01'",
    "checkin_far": "abs({ci}) > 30", "done_without_checkin": "completed AND EffectiveCheckinDate IS NULL", "checkout_before_checkin": "EffectiveCheckoutDate < EffectiveCheckinDate",
    "no_show_with_checkin": "no_show AND EffectiveCheckinDate IS NOT NULL", "snapshot_km_zero": "completed AND KM = 0", "snapshot_km_high": "completed AND KM > 100000", "odometer_low": "completed AND VehicleCurrentKM < 100",
    "odometer_high": "completed AND VehicleCurrentKM > 150000", "vehicle_missing": "vehicle_id IS NULL", "customer_missing": "customer_id IS NULL", "dealer_missing": "dealer_id IS NULL"}
_SA_RULES = {
    "delivery_early": "DeliveryDate < DATE '1995-01-01'", "sale_after_delivery": "SalesDate > DeliveryDate", "sale_after_registration": "SalesDate > RegistrationDate", "warranty_before_delivery": "WarrantyStartDate < DeliveryDate",
    "person_type_rare": "PersonType NOT IN ('F', 'J') OR PersonType IS NULL", "not_accepted": "Status <> 'ACCEPTED'", "model_other": "ModelShortName <> 'PICKUP'", "dealer_missing": "dealer_id IS NULL", "warranty_missing": "WarrantyStartDate IS NULL",
    "delivery_missing": "DeliveryDate IS NULL"}
_CI_SPARK, _CI_SQL = "datediff(EffectiveCheckinDate, ScheduleDate)", "(EffectiveCheckinDate - ScheduleDate)"
query("quality_rules", "table s, rule s, rows i, keys i, of i".replace("table s", "src s").replace("rows i", "n_rows i").replace("of i", "total i"), " UNION ALL ".join(
    [f"SELECT 'agenda' AS src, '{k}' AS rule, count(*) FILTER (WHERE {v.format(ci=_CI_SQL)}) AS n_rows, count(DISTINCT vehicle_id) FILTER (WHERE {v.format(ci=_CI_SQL)}) AS keys, count(*) AS total FROM appt" for k, v in _AG_RULES.items()]
    + [f"SELECT 'sales', '{k}', count(*) FILTER (WHERE {v}), count(DISTINCT vehicle_id) FILTER (WHERE {v}), count(*) FROM sales" for k, v in _SA_RULES.items()]), "appt sales")(
    lambda t: ql.rule_counts(t.appt(), "agenda", {k: F.expr(v.format(ci=_CI_SPARK)) for k, v in _AG_RULES.items()}).unionByName(
        ql.rule_counts(t.sales(), "sales", {k: F.expr(v) for k, v in _SA_RULES.items()})).withColumnsRenamed({"table": "src", "rows": "n_rows", "of": "total"}))
query("checkin_gap_histogram", "gap i, n i", "SELECT EffectiveCheckinDate - ScheduleDate AS gap, count(*) AS n FROM appt WHERE abs(EffectiveCheckinDate - ScheduleDate) <= 45 GROUP BY 1", "appt")(
    lambda t: t.appt().where(F.abs(_gap()) <= 45).groupBy(_gap().alias("gap")).agg(one().alias("n")))


def odometer_pairs(t: Tables, cleaned: bool):
    v = t.visits().where(F.col("completed") & (F.col("VehicleCurrentKM") > 0))
    if cleaned:
        v = v.where(clean_km(F.col("VehicleCurrentKM")).isNotNull())
    p = previous_row(v.select("schedule_id", "vehicle_id", "event_date", "VehicleCurrentKM"), "vehicle_id", "event_date", "schedule_id", ["VehicleCurrentKM", "event_date"])
    p = p.where(F.col("prev_VehicleCurrentKM").isNotNull())
    dk, days = F.col("VehicleCurrentKM") - F.col("prev_VehicleCurrentKM"), F.greatest(F.datediff("event_date", "prev_event_date"), F.lit(1))
    return p.agg(F.lit("cleaned" if cleaned else "raw").alias("kind"), one().alias("pairs"), count_if(dk < 0).alias("down"), count_if(dk < -1000).alias("down_1000"), count_if((dk / days > 300) & (days > 1)).alias("implausible"))


_ODO = """SELECT '{k}' AS kind, count(*) AS pairs, count(*) FILTER (WHERE dk < 0) AS down, count(*) FILTER (WHERE dk < -1000) AS down_1000, count(*) FILTER (WHERE dk / dd > 300 AND dd > 1) AS implausible FROM (
 SELECT VehicleCurrentKM - lag(VehicleCurrentKM) OVER w AS dk, greatest(event_date - lag(event_date) OVER w, 1) AS dd FROM visits WHERE completed AND {c} WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)) WHERE dk IS NOT NULL"""
query("odometer_regressions", "kind s, pairs i, down i, down_1000 i, implausible i", _ODO.format(k="raw", c="VehicleCurrentKM > 0") + " UNION ALL " + _ODO.format(k="cleaned", c="VehicleCurrentKM BETWEEN 100 AND 1000000"), "visits")(
    lambda t: odometer_pairs(t, False).unionByName(odometer_pairs(t, True)))


def _price(t: Tables):
    m = t.items().where(F.col("ServiceMaintenance").isNotNull()).withColumn("quarter", F.trunc("ScheduleDate", "quarter"))
    p = F.col("ServiceFordFixedPrice")
    g = m.groupBy("quarter").agg(one().alias("items"), F.count(p).alias("known"), F.try_divide(count_if(p == 0), F.count(p)).alias("zero_share"))
    return g.join(st.exact_percentiles(m, ["quarter"], "ServiceFordFixedPrice", [0.5], ["median_price"]).drop("n"), "quarter", "left")


query("price_by_quarter", "quarter t, items i, known i, zero_share d, median_price d", """SELECT date_trunc('quarter', ScheduleDate) AS quarter, count(*) AS items, count(ServiceFordFixedPrice) AS known,
 count(*) FILTER (WHERE ServiceFordFixedPrice = 0) / nullif(count(ServiceFordFixedPrice), 0) AS zero_share, median(ServiceFordFixedPrice) AS median_price FROM items WHERE ServiceMaintenance IS NOT NULL GROUP BY 1""", "items")(_price)
query("duplicate_items", "copies i, distinct_rows i", f"SELECT copies, count(*) AS distinct_rows FROM (SELECT count(*) AS copies FROM agenda GROUP BY {', '.join(AGENDA)}) GROUP BY 1", "agenda")(
    lambda t: t.agenda().groupBy(*AGENDA).agg(one().alias("copies")).groupBy("copies").agg(one().alias("distinct_rows")))
query("logical_duplicates", "visits i, n i", "SELECT visits, count(*) AS n FROM (SELECT count(*) AS visits FROM visits WHERE is_completed_maintenance GROUP BY vehicle_id, event_date) GROUP BY 1", "visits")(
    lambda t: t.visits().where("is_completed_maintenance").groupBy("vehicle_id", "event_date").agg(one().alias("visits")).groupBy("visits").agg(one().alias("n")))


def _cancels(t: Tables):
    return t.visits().where("cancelled").select("schedule_id", "vehicle_id", "event_date")


def _others(t: Tables):
    return t.visits().where("completed").select("vehicle_id", F.col("event_date").alias("other_at"), F.col("schedule_id").alias("other_id"))


_LAT = "LATERAL (SELECT schedule_id AS other_id, event_date AS other_at FROM visits x WHERE x.vehicle_id = s.vehicle_id AND x.completed {c} ORDER BY {o} LIMIT 1) v ON true"
query("asof_nearest", "schedule_id s, other_id s, gap_days i", f"""SELECT s.schedule_id, other_id, abs(other_at - s.event_date) AS gap_days FROM (SELECT * FROM visits WHERE cancelled) s LEFT JOIN
 {_LAT.format(c='', o='abs(event_date - s.event_date), event_date, CASE WHEN event_date <= s.event_date THEN schedule_id END DESC, schedule_id')}""", "visits")(
    lambda t: asof_nearest(_cancels(t), _others(t), "vehicle_id", "event_date", "other_at", ["other_id"], ["other_id"]))
query("asof_tolerance", "schedule_id s, other_id s", f"""SELECT s.schedule_id, CASE WHEN other_at - s.event_date <= 30 THEN other_id END AS other_id FROM (SELECT * FROM visits WHERE cancelled) s LEFT JOIN
 {_LAT.format(c='AND event_date >= s.event_date', o='event_date, schedule_id')}""", "visits")(
    lambda t: asof_tolerance(_cancels(t), _others(t), "vehicle_id", "event_date", "other_at", ["other_id"], 30, tie=["other_id"]))
query("asof_backward_strict", "schedule_id s, other_id s, other_at t", f"""SELECT s.schedule_id, other_id, other_at FROM (SELECT * FROM visits WHERE cancelled) s LEFT JOIN {_LAT.format(c='AND event_date < s.event_date', o='event_date DESC, schedule_id DESC')}""", "visits")(
    lambda t: asof_join(_cancels(t), _others(t), "vehicle_id", "event_date", "other_at", ["other_id", "other_at"], "backward", False, ["other_id"]))
query("asof_forward_strict", "schedule_id s, other_id s, other_at t", f"""SELECT s.schedule_id, other_id, other_at FROM (SELECT * FROM visits WHERE cancelled) s LEFT JOIN {_LAT.format(c='AND event_date > s.event_date', o='event_date, schedule_id')}""", "visits")(
    lambda t: asof_join(_cancels(t), _others(t), "vehicle_id", "event_date", "other_at", ["other_id", "other_at"], "forward", False, ["other_id"]))
query("asof_offset", "schedule_id s, other_at t", f"""SELECT s.schedule_id, other_at FROM (SELECT * FROM visits WHERE cancelled) s LEFT JOIN {_LAT.format(c='AND event_date >= s.event_date + 30', o='event_date, schedule_id')}""", "visits")(
    lambda t: asof_join(_cancels(t).withColumn("key", F.date_add("event_date", 30)), _others(t), "vehicle_id", "key", "other_at", ["other_at"], "forward", True, ["other_id"]))
query("asof_by_customer", "schedule_id s, other_at t", """SELECT s.schedule_id, (SELECT max(event_date) FROM visits x WHERE x.customer_id = s.customer_id AND x.completed AND x.event_date < s.event_date) AS other_at FROM visits s WHERE cancelled""", "visits")(
    lambda t: asof_join(t.visits().where("cancelled").select("schedule_id", "customer_id", "event_date"), t.visits().where("completed").select("customer_id", F.col("event_date").alias("other_at")), "customer_id", "event_date",
                        "other_at", ["other_at"]))


def _coverage(t: Tables):
    s = t.sales().join(t.visits().where("completed").groupBy("vehicle_id").agg(F.min("event_date").alias("fv")), "vehicle_id", "left")
    d = F.col("DeliveryDate")
    return s.groupBy(F.trunc(d, "quarter").alias("cohort")).agg(one().alias("n"), share(F.col("fv").isNotNull()).alias("ever"), F.avg(F.when(F.date_add(d, 365) <= F.lit(SPAN.cutoff), F.coalesce(
        F.col("fv") <= F.date_add(d, 365), F.lit(False)).cast("double"))).alias("in_365d"))


query("sales_coverage", "cohort t, n i, ever d, in_365d d", """SELECT date_trunc('quarter', DeliveryDate) AS cohort, count(*) AS n, avg(CAST(fv IS NOT NULL AS INTEGER)) AS ever, avg(CASE WHEN DeliveryDate + 365 <= DATE '2001-02-28' THEN CAST(coalesce(fv <= DeliveryDate + 365, false) AS INTEGER) END) AS in_365d
 FROM sales LEFT JOIN (SELECT vehicle_id, min(event_date) AS fv FROM visits WHERE completed GROUP BY 1) USING (vehicle_id) GROUP BY 1""", "visits sales")(_coverage)
query("leakage_invariant", ", ".join(f"{c} i" for c in ft.RECENCIES), "SELECT " + ", ".join(f"0 AS {c}" for c in ft.RECENCIES))(lambda t: ft.leakage_violations(t.features()))
#: Group of a feature by the start or a part of its name, first match; and the kinds that SQL types have.
_GROUPS = [("survey", ("survey", "rating")), ("usage", ("km", "interval")), ("history", ("n_", "last_", "days_since", "noshow_rate", "cancel_rate", "fordpass_share", "maint_per_year")), ("customer", ("fleet", "person", "business", "is_buyer", "n_vehicles")),
           ("vehicle", ("generation", "model_year", "tma", "vehicle_age", "connected", "warranty")), ("sale", ("sales", "in_sales", "same_dealer")), ("window", ("due", "anchor", "binding", "rate_source", "scoring", "is_first", "months_observable", "history_days", "days_to"))]


def _group_of(c: str) -> str:
    return next((g for g, keys in _GROUPS if any(c.startswith(k) or (k[0] != "n" and k in c) for k in keys)), "other")


def _role_of(c: str) -> str:
    return "identifier or date" if c in ft.ID_COLUMNS else "label or outcome" if c in ft.LABEL_COLUMNS else "snapshot, not used" if c in ft.SNAPSHOT_COLUMNS else "input"


def _dictionary(t: Tables):
    f = t.features()
    return ql.column_profile(f, f.columns, {c: _group_of(c) for c in f.columns}, {c: _role_of(c) for c in f.columns}).withColumnRenamed("column", "name")


#: Columns of the feature table with their types, as the text below states them.
_DICT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS name, '{k}' AS type, '{_group_of(c)}' AS grp, '{_role_of(c)}' AS role, avg(CAST({c} IS NULL AS INTEGER)) AS missing, count({c}) AS known FROM features" for c, k in ft.FEATURE_TYPES.items())
query("column_profile", "name s, type s, grp s, role s, missing d, known i", _DICT_SQL, "features")(_dictionary)
_AGENDA_IDS = ["schedule_id", "vehicle_id", "customer_id", "dealer_id"]
_AGENDA_DAYS = [c for c in fv.AGENDA_DATES if c in AGENDA]
query("input_validation", "n_rows i, " + ", ".join(f"empty_{c} i" for c in _AGENDA_IDS) + ", " + ", ".join(f"invalid_{c} i, min_{c} t, max_{c} t" for c in _AGENDA_DAYS) + ", last_event t",
      "SELECT count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE coalesce(trim(CAST({c} AS VARCHAR)), '') = '') AS empty_{c}" for c in _AGENDA_IDS) + ", "
      + ", ".join(f"0 AS invalid_{c}, CAST(min({c}) AS DATE) AS min_{c}, CAST(max({c}) AS DATE) AS max_{c}" for c in _AGENDA_DAYS) + ", max(ScheduleDate) AS last_event FROM agenda", "agenda")(
    lambda t: profile_extract(t.agenda(), _AGENDA_IDS, _AGENDA_DAYS, "ScheduleDate"))


def _two_plans(t: Tables):
    """Feature counters recomputed by exclusive running counts must equal the one-pass features."""
    w = t.windows().where("status = 'evaluable'").select("vehicle_id", "scoring_date", "window_id")
    v = t.visits().select("schedule_id", "vehicle_id", "event_date", "no_show", "cancelled")
    probe = w.select(F.concat(F.lit(" "), "window_id").alias("schedule_id"), "vehicle_id", F.col("scoring_date").alias("event_date"), F.lit(False).alias("no_show"), F.lit(False).alias("cancelled"))
    c = counts_before(v.unionByName(probe), "vehicle_id", "event_date", "schedule_id", {"n_noshow": F.col("no_show"), "n_cancel": F.col("cancelled")})
    mine = c.where(F.col("schedule_id").startswith(" ")).select(F.trim("schedule_id").alias("window_id"), F.col("n_noshow").cast("int").alias("n_noshow"), F.col("n_cancel").cast("int").alias("n_cancel"))
    return ql.equivalence(mine, t.features().select("window_id", "n_noshow", "n_cancel"))


query("two_plan_equivalence", "only_first i, only_second i", "SELECT 0 AS only_first, 0 AS only_second")(_two_plans)


def _events_consistency(t: Tables):
    from reprise.operators.events import drop_split_visits, maintenance_days
    d = maintenance_days(t.appt())
    return (t.appt().agg(count_if(F.col("is_completed_maintenance")).alias("visits"), count_if(F.col("is_completed_maintenance") & F.col("vehicle_id").isNull()).alias("without_vehicle"))
            .withColumns({"vehicle_days": d.agg(one().alias("c")).scalar(), "after_split_rule": drop_split_visits(d).agg(one().alias("c")).scalar()}))


query("event_consistency", "visits i, without_vehicle i, vehicle_days i, after_split_rule i", """SELECT count(*) FILTER (WHERE is_completed_maintenance) AS visits, count(*) FILTER (WHERE is_completed_maintenance AND vehicle_id IS NULL) AS without_vehicle,
 (SELECT count(*) FROM maint_days) AS vehicle_days, (SELECT count(*) FROM maint_split) AS after_split_rule FROM appt""", "appt maint_split")(_events_consistency)


_CUT_SQL = f"DATE '{SPAN.cutoff}'"
query("event_rule", "schedule_id s, visita_red b, mant_completado b, dup_mant_dia b, dup_mant_n30 b", f"""WITH f AS (SELECT *, vehicle_id IS NOT NULL AND ScheduleDate <= {_CUT_SQL} AND (completed OR completed_no_os) AS visita_red FROM appt),
 c AS (SELECT schedule_id, vehicle_id, event_date, maint_number, row_number() OVER (PARTITION BY vehicle_id, event_date ORDER BY schedule_id) AS k FROM f WHERE visita_red AND completed AND has_maint),
 d AS (SELECT schedule_id, coalesce(maint_number = lag(maint_number) OVER w AND event_date - lag(event_date) OVER w <= 30, false) AS again FROM c WHERE k = 1 WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date))
SELECT f.schedule_id, coalesce(visita_red, false) AS visita_red, coalesce(NOT d.again, false) AS mant_completado, coalesce(c.k > 1, false) AS dup_mant_dia, coalesce(d.again, false) AS dup_mant_n30 FROM f LEFT JOIN c USING (schedule_id) LEFT JOIN d USING (schedule_id)""", "appt")(
    lambda t: event_rule(t.appt(), SPAN.cutoff))


def _ledger(t: Tables):
    """Rows that each exclusion or correction touches."""
    a, ci, cut_ = t.appt(), F.col("EffectiveCheckinDate"), F.lit(SPAN.cutoff)
    row = lambda df, name, col="n": df.select(F.lit(name).alias("exclusion"), F.col(col).cast("long").alias("n"))
    copies = t.agenda().groupBy(*AGENDA).agg(one().alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    km = F.col("VehicleCurrentKM")
    parts = a.agg(
        count_if(F.col("vehicle_id").isNull()).alias("without_vehicle"), count_if(F.col("vehicle_id").isNull() & F.col("is_completed_maintenance")).alias("completed_without_vehicle"),
        count_if(F.col("vehicle_id").isNotNull() & F.col("customer_id").isNull()).alias("without_customer"), count_if(ci < F.lit(SPAN.start)).alias("checkin_before_start"),
        count_if(F.col("completed") & ((km < 100) | (km > 1000000))).alias("odometer_out_of_range"), count_if(F.col("pending") & (F.col("ScheduleDate") <= F.date_sub(cut_, 30))).alias("stale_pending"),
        count_if(F.col("ScheduleDate") > cut_).alias("after_cutoff"))
    near = previous_row(t.visits().where("is_completed_maintenance"), "vehicle_id", "event_date", "schedule_id", ["event_date"]).agg(count_if(F.datediff("event_date", "prev_event_date") <= 7).alias("n"))
    s = t.sales().agg(count_if(~F.col("ModelShortName").eqNullSafe(F.lit(RULES.model)) | (F.col("DeliveryDate") < F.lit(RULES.min_delivery).cast("date")) | ~F.col("Status").eqNullSafe(F.lit(RULES.status))).alias("n"))
    return row(copies, "identical_items").unionByName(parts.unpivot([], parts.columns, "exclusion", "n")).unionByName(row(near, "maintenance_within_7_days")).unionByName(row(s, "sales_outside_rules"))


query("exclusion_ledger", "exclusion s, n i", f"""SELECT 'identical_items' AS exclusion, coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM agenda GROUP BY {', '.join(AGENDA)})
 UNION ALL SELECT 'without_vehicle', count(*) FILTER (WHERE vehicle_id IS NULL) FROM appt UNION ALL SELECT 'completed_without_vehicle', count(*) FILTER (WHERE vehicle_id IS NULL AND is_completed_maintenance) FROM appt
 UNION ALL SELECT 'without_customer', count(*) FILTER (WHERE vehicle_id IS NOT NULL AND customer_id IS NULL) FROM appt UNION ALL SELECT 'checkin_before_start', count(*) FILTER (WHERE EffectiveCheckinDate < DATE '{SPAN.start}') FROM appt
 UNION ALL SELECT 'odometer_out_of_range', count(*) FILTER (WHERE completed AND (VehicleCurrentKM < 100 OR VehicleCurrentKM > 1000000)) FROM appt UNION ALL SELECT 'stale_pending', count(*) FILTER (WHERE pending AND ScheduleDate <= {_CUT_SQL} - 30) FROM appt
 UNION ALL SELECT 'after_cutoff', count(*) FILTER (WHERE ScheduleDate > {_CUT_SQL}) FROM appt
 UNION ALL SELECT 'maintenance_within_7_days', count(*) FROM (SELECT event_date - lag(event_date) OVER (PARTITION BY vehicle_id ORDER BY event_date, schedule_id) AS g FROM visits WHERE is_completed_maintenance) WHERE g <= 7
 UNION ALL SELECT 'sales_outside_rules', count(*) FILTER (WHERE ModelShortName IS DISTINCT FROM '{RULES.model}' OR DeliveryDate < DATE '{RULES.min_delivery}' OR Status IS DISTINCT FROM '{RULES.status}') FROM sales""", "agenda appt visits sales")(_ledger)


# ---------------------------------------------------------------------------------- text extracts
#: A text copy of the bookings: notes with quotes and line feeds, and some days and prices that can't be read.
_NOTE = "concat('order ', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), 'said \"late\", left', chr(10), chr(10)) WHEN o_orderkey % 3 = 1 THEN ', paid' ELSE '' END)"
_TEXT = {"id": "CAST(o_orderkey AS STRING)", "note": _NOTE, "day": "CASE WHEN o_orderkey % 97 = 5 THEN 'soon' WHEN o_orderkey % 41 = 7 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
         "price": "CASE WHEN o_orderkey % 89 = 3 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END", "status": "concat(' ', o_orderstatus, ' ')"}


def text_extract(t: Tables):
    """The text copy written as quoted text and read back by records, typed, with rejected cells."""
    def build():
        path = shared_path(t.spark, "extracts")
        t.raw("orders").selectExpr(*[f"{e} AS {c}" for c, e in _TEXT.items()]).write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return rc.typed(rc.read_quoted_csv(t.spark, path), dates=["day"], numbers=["price"], trimmed=["status"])
    return t.stage("text_extract", build)


_TX = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in _TEXT.items()).replace("AS STRING", "AS VARCHAR") + " FROM orders)"
query("quoted_extract", "id s, note s, day t, price d, status s, malformed b", f"SELECT id, note, try_cast(nullif(day, 'soon') AS DATE) AS day, try_cast(price AS DOUBLE) AS price, trim(status) AS status, false AS malformed FROM {_TX}")(
    lambda t: text_extract(t).withColumnRenamed("_malformed", "malformed"))
query("reject_ledger", "id s, column s, raw s, reason s".replace("column s", "field s"), f"SELECT id, 'day' AS field, day AS raw, 'not a date' AS reason FROM {_TX} WHERE trim(day) <> '' AND try_cast(day AS DATE) IS NULL UNION ALL SELECT id, 'price', price, 'not a number' FROM {_TX} WHERE trim(price) <> '' AND try_cast(price AS DOUBLE) IS NULL")(
    lambda t: text_extract(t).select("id", F.explode("_rejected").alias("r")).select("id", F.col("r.column").alias("field"), "r.raw", "r.reason"))
query("text_validation", "n_rows i, empty_id i, invalid_day i, min_day t, max_day t, last_event t", f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(trim(id), '') = '') AS empty_id, count(*) FILTER (WHERE trim(day) <> '' AND try_cast(day AS DATE) IS NULL) AS invalid_day,
 min(try_cast(day AS DATE)) AS min_day, max(try_cast(day AS DATE)) AS max_day, max(try_cast(day AS DATE)) AS last_event FROM {_TX}""")(lambda t: profile_extract(t.raw("orders").selectExpr(*[f"{e} AS {c}" for c, e in _TEXT.items()]), ["id"], ["day"], "day"))
