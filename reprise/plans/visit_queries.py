"""Volume, item taxonomy, status semantics and sequence analyses."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import as_int, count_if, leading_integer, share
from reprise.operators import events as ev, stats as st
from reprise.operators.asof import asof_join
from reprise.operators.history import next_row, previous_row
from reprise.plans.domain import AGENDA, SPAN, Tables
from reprise.plans.registry import query

one = lambda: F.count(F.lit(1))
_ITEMS = "agenda"


def _volume(t: Tables):
    raw = t.agenda().agg(one().alias("items_raw"))
    d = t.items().agg(one().alias("items_distinct"), F.count_distinct("schedule_id").alias("schedules"), F.count_distinct("vehicle_id").alias("vehicles"))
    return d.withColumns({"items_raw": raw.scalar()}).withColumn("duplicates", F.col("items_raw") - F.col("items_distinct"))


query("eda_volume", "items_raw i, items_distinct i, duplicates i, schedules i, vehicles i", """
SELECT (SELECT count(*) FROM agenda) AS items_raw, count(*) AS items_distinct, (SELECT count(*) FROM agenda) - count(*) AS duplicates,
 count(DISTINCT schedule_id) AS schedules, count(DISTINCT vehicle_id) AS vehicles FROM items""", "items")(_volume)

query("eda_status_mix", "StatusARG s, n i, share d", "SELECT StatusARG, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM appt GROUP BY 1", "appt")(
    lambda t: st.value_shares(t.appt(), [], "StatusARG"))

query("eda_status_dense", "StatusARG s, n i", "SELECT s AS StatusARG, count(schedule_id) AS n FROM (SELECT unnest(["
      + ", ".join(f"'{s}'" for s in fv.STATUS_ORDER) + "]) AS s) LEFT JOIN appt ON StatusARG = s GROUP BY 1", "appt")(
    lambda t: st.dense_levels(t.appt().groupBy("StatusARG").agg(one().alias("n")), "StatusARG", fv.STATUS_ORDER, ["n"]))

_LEVEL = [c for c in fv.VISIT_COLUMNS if c in AGENDA]


def _consistency(t: Tables):
    """Bookings whose items disagree on an attribute: two values, or a value beside a missing one."""
    per = t.items().groupBy("schedule_id").agg(*[((F.min(c) != F.max(c)) | (F.bool_or(F.col(c).isNull()) & (F.count(c) > 0))).alias(c) for c in _LEVEL])
    return per.agg(*[count_if(F.col(c)).alias(c) for c in _LEVEL])


query("eda_within_visit_consistency", ", ".join(f"{c} i" for c in _LEVEL), "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} > 1) AS {c}" for c in _LEVEL) + " FROM (SELECT " + ", ".join(
    f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS {c}" for c in _LEVEL) + " FROM items GROUP BY schedule_id)", "items")(_consistency)

query("eda_item_classes", "item_class s, ServiceType s, n i", "SELECT item_class, coalesce(ServiceType, '(nulo)') AS ServiceType, count(*) AS n FROM items GROUP BY 1, 2", "items")(
    lambda t: t.items().groupBy("item_class", F.coalesce("ServiceType", F.lit("(nulo)")).alias("ServiceType")).agg(one().alias("n")))

query("eda_numbering_consistency", "numbered i, numbered_other_type i, named_unnumbered i, type_unnumbered i", """
SELECT count(ServiceMaintenance) AS numbered, count(*) FILTER (WHERE ServiceMaintenance IS NOT NULL AND ServiceType IS DISTINCT FROM 'Mantenimiento') AS numbered_other_type,
 count(*) FILTER (WHERE regexp_matches(ServiceName, 'Maintenance (?:service|review)') AND ServiceMaintenance IS NULL) AS named_unnumbered,
 count(*) FILTER (WHERE ServiceType = 'Mantenimiento' AND ServiceMaintenance IS NULL) AS type_unnumbered FROM items""", "items")(
    lambda t: t.items().agg(F.count("ServiceMaintenance").alias("numbered"),
                            count_if(F.col("ServiceMaintenance").isNotNull() & ~F.col("ServiceType").eqNullSafe(fv.TYPE_MAINTENANCE)).alias("numbered_other_type"),
                            count_if(F.col("ServiceName").rlike(fv.MAINTENANCE_NAME_PATTERN) & F.col("ServiceMaintenance").isNull()).alias("named_unnumbered"),
                            count_if((F.col("ServiceType") == fv.TYPE_MAINTENANCE) & F.col("ServiceMaintenance").isNull()).alias("type_unnumbered")))


def combos(t: Tables):
    """Item-class combination per booking; at most 13 classes exist, so the set is bounded."""
    c = t.items().groupBy("schedule_id").agg(F.array_sort(F.collect_set("item_class")).alias("classes"))
    return c.withColumn("combo", F.array_join("classes", "+"))


_COMBO = "SELECT schedule_id, string_agg(DISTINCT item_class, '+' ORDER BY item_class) AS combo, list_sort(list(DISTINCT item_class)) AS classes FROM items GROUP BY 1"


def _combo_status(t: Tables):
    j = combos(t).join(t.appt().select("schedule_id", "StatusARG"), "schedule_id")
    x = st.crosstab(j, "combo", "StatusARG", fv.STATUS_ORDER, "s")
    return x.orderBy(F.col("total").desc(), "combo").limit(15)


query("eda_combo_by_status", "combo s, s1 i, s2 i, s3 i, s4 i, s5 i, s6 i, total i", f"SELECT combo, " + ", ".join(
    f"count(*) FILTER (WHERE StatusARG = '{s}') AS s{i + 1}" for i, s in enumerate(fv.STATUS_ORDER))
    + f", count(*) AS total FROM ({_COMBO}) JOIN appt USING (schedule_id) GROUP BY 1 ORDER BY total DESC, combo LIMIT 15", "items appt")(_combo_status)

query("eda_target_composition", "combo s, n i, share d", f"""SELECT combo, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ({_COMBO})
 JOIN appt USING (schedule_id) WHERE is_completed_maintenance GROUP BY 1 ORDER BY n DESC, combo LIMIT 10""", "items appt")(
    lambda t: st.value_shares(combos(t).join(t.appt().where("is_completed_maintenance").select("schedule_id"), "schedule_id"), [], "combo")
    .orderBy(F.col("n").desc(), "combo").limit(10))


def _status_profile(t: Tables):
    a = t.appt()
    base = a.groupBy("StatusARG").agg(
        one().alias("n"), *[share(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("EffectiveCheckinDate", "EffectiveCheckoutDate", "VehicleCurrentKM", "SurveyStarRating")],
        share(F.col("has_maint")).alias("maint"), share(F.col("has_recall")).alias("recall"), share(F.col("ScheduleReturn") == "Y").alias("returns"))
    return base.join(st.exact_percentiles(a, ["StatusARG"], "DaysInDealer", [0.5], ["median_days"]).drop("n"), "StatusARG", "left")


query("eda_status_profile", "StatusARG s, n i, has_EffectiveCheckinDate d, has_EffectiveCheckoutDate d, has_VehicleCurrentKM d, has_SurveyStarRating d, maint d, recall d, "
      "returns d, median_days d", "SELECT StatusARG, count(*) AS n, " + ", ".join(
          f"count({c}) / count(*) AS has_{c}" for c in ("EffectiveCheckinDate", "EffectiveCheckoutDate", "VehicleCurrentKM", "SurveyStarRating"))
      + """, avg(CAST(has_maint AS INTEGER)) AS maint, avg(CAST(has_recall AS INTEGER)) AS recall, avg(CAST(ScheduleReturn = 'Y' AS INTEGER)) AS returns,
 median(DaysInDealer) AS median_days FROM appt GROUP BY 1""", "appt")(_status_profile)

_BANDS = [(-30, -1), (0, 0), (1, 30), (-30, 30), (1, 90)]


def _followup(t: Tables):
    """All bands in one ordered pass over the days of a vehicle; a probe is no completed visit, so it can't meet itself."""
    days = t.visits().groupBy("vehicle_id", "event_date").agg(
        count_if(F.col("completed_no_os")).alias("probes"), count_if(F.col("completed")).alias("done"), count_if(F.col("is_completed_maintenance")).alias("maint"))
    order = Window.partitionBy("vehicle_id").orderBy(F.datediff("event_date", F.lit("1970-01-01").cast("date")))
    hits = {f"_{c}{i}": F.col("event_date").isNotNull() & (F.sum(c).over(order.rangeBetween(lo, hi)) > 0) for i, (lo, hi) in enumerate(_BANDS) for c in ("done", "maint")}
    probes = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("probes"))), F.lit(0))
    cells = [F.struct(F.lit(f"[{lo}, {hi}]").alias("band"), probes(F.lit(True)).alias("n"), probes(F.col(f"_done{i}")).alias("with_completed"), probes(F.col(f"_maint{i}")).alias("with_maintenance"))
             for i, (lo, hi) in enumerate(_BANDS)]
    return days.withColumns(hits).agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


_EX = "EXISTS (SELECT 1 FROM visits r WHERE r.vehicle_id = s.vehicle_id AND r.{f} AND r.schedule_id <> s.schedule_id AND r.event_date - s.event_date BETWEEN {lo} AND {hi})"
query("eda_followup_bands", "band s, n i, with_completed i, with_maintenance i", " UNION ALL ".join(
    f"SELECT '[{lo}, {hi}]' AS band, count(*) AS n, count(*) FILTER (WHERE {_EX.format(f='completed', lo=lo, hi=hi)}) AS with_completed, "
    f"count(*) FILTER (WHERE {_EX.format(f='is_completed_maintenance', lo=lo, hi=hi)}) AS with_maintenance FROM visits s WHERE completed_no_os" for lo, hi in _BANDS),
    "visits")(_followup)


#: Groups of the follow-up curve, with the first day that counts: a completed visit needs another one, a day later at least.
_CURVES = {"cancelled_rescheduled": (lambda: F.col("cancelled") & (F.col("IsReschedule") == "Y"), "cancelled AND IsReschedule = 'Y'", 0), "cancelled_for_good": (lambda: F.col("cancelled") & (F.col("IsReschedule") == "N"), "cancelled AND IsReschedule = 'N'", 0),
           "no_show": (lambda: F.col("no_show"), "no_show", 0), "done_without_order": (lambda: F.col("completed_no_os"), "completed_no_os", 0), "completed": (lambda: F.col("completed"), "completed", 1)}
_CURVE_DAYS = 90


def _followup_curve(t: Tables):
    """Share of bookings with a completed visit of the vehicle within 0 to 90 days, for five groups of bookings."""
    v = t.visits().where(F.col("event_date") <= F.date_sub(F.lit(SPAN.cutoff), _CURVE_DAYS))
    group = lambda k, c, lo: F.when(c(), F.struct(F.lit(k).alias("grp"), F.lit(lo).alias("lo")))
    sub = v.select("vehicle_id", "event_date", F.explode(F.filter(F.array(*[group(k, c, lo) for k, (c, _, lo) in _CURVES.items()]), lambda g: g.isNotNull())).alias("g"))
    sub = sub.select("vehicle_id", "g.grp", "event_date", F.date_add("event_date", F.col("g.lo")).alias("from_day"))
    done = t.visits().where("completed").select("vehicle_id", F.col("event_date").alias("nxt")).distinct()
    j = asof_join(sub, done, "vehicle_id", "from_day", "nxt", ["nxt"], "forward", True)
    per = j.groupBy("grp", F.datediff("nxt", "event_date").alias("gap")).agg(one().alias("k"))
    n = per.groupBy("grp").agg(F.sum("k").alias("n"))
    days = per.where(F.col("gap") <= _CURVE_DAYS).select("grp", "k", F.explode(F.sequence("gap", F.lit(_CURVE_DAYS))).alias("day")).groupBy("grp", "day").agg(F.sum("k").alias("returned"))
    grid = n.select("grp", "n", F.explode(F.sequence(F.lit(0), F.lit(_CURVE_DAYS))).alias("day"))
    return grid.join(days, ["grp", "day"], "left").select("grp", "n", "day", (F.coalesce("returned", F.lit(0)) / F.col("n")).alias("share"))


query("eda_followup_curve", "grp s, n i, day i, share d", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS grp, (SELECT min(event_date) FROM visits r WHERE r.vehicle_id = s.vehicle_id AND r.completed AND r.event_date >= s.event_date + {lo}) - s.event_date AS gap FROM visits s WHERE ({c}) AND event_date <= DATE '2001-02-28' - {_CURVE_DAYS}"
    for k, (_, c, lo) in _CURVES.items()) + f") SELECT grp, count(*) AS n, d AS day, avg(CAST(coalesce(gap <= d, false) AS INTEGER)) AS share FROM s, (SELECT unnest(generate_series(0, {_CURVE_DAYS})) AS d) GROUP BY 1, 3", "visits")(_followup_curve)


def _dealer_share(t: Tables):
    d = t.appt().where(F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(one().alias("n"), share(F.col("completed_no_os")).alias("s"))
    p = st.exact_percentiles(d, [], "s", [0.5], ["median_share"]).drop("n")
    return d.agg(one().alias("dealers"), F.max("s").alias("max_share"), count_if(F.col("s") > 0.10).alias("above_10pct"), count_if(F.col("s") == 0).alias("without")).withColumn(
        "median_share", p.scalar())


query("eda_dealer_status_share", "dealers i, median_share d, max_share d, above_10pct i, without i", """
SELECT count(*) AS dealers, median(s) AS median_share, max(s) AS max_share, count(*) FILTER (WHERE s > 0.10) AS above_10pct, count(*) FILTER (WHERE s = 0) AS without
FROM (SELECT avg(CAST(completed_no_os AS INTEGER)) AS s FROM appt WHERE dealer_id IS NOT NULL GROUP BY dealer_id)""", "appt")(_dealer_share)

_AUX = ["PUD", "MOVIL"]


def _families(t: Tables):
    c = t.appt().where("completed").join(combos(t), "schedule_id")
    with_m = t.visits().where(F.col("completed") & F.col("has_maint")).select("vehicle_id").distinct().withColumn("_m", F.lit(True))
    fams = ["GARANTIA", "CAMPANA_RECALL", "ACEITE_FILTRO", "CONTACTLESS", "INSPECCION"]
    f = c.select("schedule_id", "vehicle_id", "has_maint", "classes", F.explode(F.array_intersect("classes", F.array(*[F.lit(x) for x in fams]))).alias("family"))
    only = F.size(F.array_except("classes", F.array(F.col("family"), *[F.lit(x) for x in _AUX]))) == 0
    f = f.withColumn("only", only).join(with_m, "vehicle_id", "left")
    return f.groupBy("family").agg(one().alias("visits"), count_if(~F.col("has_maint")).alias("without_maint"), count_if(F.col("only")).alias("only_family"),
                                   F.count_distinct(F.when(F.col("only"), F.col("vehicle_id"))).alias("vehicles_only"),
                                   F.count_distinct(F.when(F.col("only") & F.col("_m").isNull(), F.col("vehicle_id"))).alias("vehicles_never_maint"))


query("eda_family_reclassification", "family s, visits i, without_maint i, only_family i, vehicles_only i, vehicles_never_maint i", f"""
SELECT family, count(*) AS visits, count(*) FILTER (WHERE NOT has_maint) AS without_maint, count(*) FILTER (WHERE q_only) AS only_family,
 count(DISTINCT vehicle_id) FILTER (WHERE q_only) AS vehicles_only, count(DISTINCT vehicle_id) FILTER (WHERE q_only AND vehicle_id NOT IN (
  SELECT vehicle_id FROM visits WHERE completed AND has_maint)) AS vehicles_never_maint
FROM (SELECT *, len(list_filter(classes, lambda x: x NOT IN (family, 'PUD', 'MOVIL'))) = 0 AS q_only FROM (SELECT *, unnest(list_filter(classes, lambda x: x IN ('GARANTIA', 'CAMPANA_RECALL',
 'ACEITE_FILTRO', 'CONTACTLESS', 'INSPECCION'))) AS family FROM ({_COMBO}) JOIN appt USING (schedule_id) WHERE completed)) GROUP BY 1""", "items visits")(_families)


def _scenarios(t: Tables):
    a = t.appt().join(combos(t), "schedule_id")
    has = lambda c: F.array_contains("classes", c)
    done, no_os = F.col("completed"), F.col("completed_no_os")
    b = F.col("has_maint") | has("ACEITE_FILTRO")
    c = b | has("GARANTIA")
    sc = {"A": done & F.col("has_maint"), "B": done & b, "C": done & c, "D": done & (c | has("CAMPANA_RECALL")), "E": (done | no_os) & F.col("has_maint"), "F": done | no_os}
    per = a.groupBy("vehicle_id").agg(*[count_if(v).alias(f"_{k}") for k, v in sc.items()])       # counted per vehicle first: no row expansion
    rows = per.agg(F.array(*[F.struct(F.lit(k).alias("scenario"), F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias("visits"), count_if(F.col("vehicle_id").isNotNull() & (F.col(f"_{k}") > 0)).alias("vehicles"))
                             for k in sc]).alias("r")).select(F.explode("r").alias("x"), F.col("r")[0].alias("a"))
    return rows.select("x.*", (F.col("x.visits") - F.col("a.visits")).alias("delta_visits"), (F.col("x.vehicles") - F.col("a.vehicles")).alias("delta_vehicles"))


_SC = {"A": "completed AND has_maint", "B": "completed AND (has_maint OR o)", "C": "completed AND (has_maint OR o OR g)", "D": "completed AND (has_maint OR o OR g OR c)",
       "E": "(completed OR completed_no_os) AND has_maint", "F": "completed OR completed_no_os"}
query("target_scenarios", "scenario s, visits i, vehicles i, delta_visits i, delta_vehicles i", "WITH z AS (SELECT a.*, x.o, x.g, x.c FROM appt a JOIN (SELECT schedule_id, "
      "bool_or(item_class = 'ACEITE_FILTRO') AS o, bool_or(item_class = 'GARANTIA') AS g, bool_or(item_class = 'CAMPANA_RECALL') AS c FROM items GROUP BY 1) x USING (schedule_id)), y AS ("
      + " UNION ALL ".join(f"SELECT '{k}' AS scenario, count(*) AS visits, count(DISTINCT vehicle_id) AS vehicles FROM z WHERE {v}" for k, v in _SC.items())
      + ") SELECT *, visits - (SELECT visits FROM y WHERE scenario = 'A') AS delta_visits, vehicles - (SELECT vehicles FROM y WHERE scenario = 'A') AS delta_vehicles FROM y", "items appt")(_scenarios)


def _numbered(t: Tables):
    return t.items().where(F.col("ServiceMaintenance").isNotNull()).withColumns({
        "n": F.col("ServiceMaintenance").cast("int"),
        "family": F.when(F.col("ServiceName").contains("review"), F.lit("review")).otherwise(F.lit("service"))})


query("eda_number_names", "n i, ServiceName s, items i", "SELECT CAST(ServiceMaintenance AS INTEGER) AS n, ServiceName, count(*) AS items FROM items WHERE ServiceMaintenance IS NOT NULL GROUP BY 1, 2",
      "items")(lambda t: _numbered(t).groupBy("n", "ServiceName").agg(one().alias("items")))
query("eda_family_by_month", "month t, service i, review i", """SELECT date_trunc('month', ScheduleDate) AS month, count(*) FILTER (WHERE NOT contains(ServiceName, 'review')) AS service,
 count(*) FILTER (WHERE contains(ServiceName, 'review')) AS review FROM items WHERE ServiceMaintenance IS NOT NULL GROUP BY 1""", "items")(
    lambda t: _numbered(t).groupBy(F.trunc("ScheduleDate", "month").alias("month")).agg(count_if(F.col("family") == "service").alias("service"), count_if(F.col("family") == "review").alias("review")))
query("eda_name_vs_code_number", "code_number i, name_number i, items i", """SELECT CAST(ServiceMaintenance AS INTEGER) AS code_number, CAST(regexp_extract(ServiceName, '^\\s*(\\d+)', 1) AS INTEGER) AS name_number,
 count(*) AS items FROM items WHERE ServiceMaintenance IS NOT NULL GROUP BY 1, 2""", "items")(
    lambda t: _numbered(t).groupBy(F.col("n").alias("code_number"), leading_integer(F.col("ServiceName")).alias("name_number")).agg(one().alias("items")))

_PS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _km_by_number(t: Tables):
    m = t.maint().join(t.master().select("vehicle_id", "warranty_start"), "vehicle_id", "left").withColumn("age", F.datediff("event_date", "warranty_start") / 30.44)
    a = st.exact_percentiles(m, ["maint_number"], "km", [0.25, 0.5, 0.75], ["km25", "km50", "km75"]).withColumnRenamed("n", "n_km")
    b = st.exact_percentiles(m, ["maint_number"], "age", [0.5], ["age50"]).withColumnRenamed("n", "n_age")
    return a.join(b, "maint_number", "full_outer")


query("eda_km_age_by_number", "maint_number d, n_km i, km25 d, km50 d, km75 d, n_age i, age50 d", """
SELECT maint_number, count(km) AS n_km, quantile_cont(km, 0.25) AS km25, median(km) AS km50, quantile_cont(km, 0.75) AS km75, count(warranty_start) AS n_age,
 median((event_date - warranty_start) / 30.44) AS age50 FROM maint LEFT JOIN vm USING (vehicle_id) GROUP BY 1""", "maint vm")(_km_by_number)

query("eda_milestone_share", "maint_number d, n i, near d", """SELECT maint_number, count(*) AS n, avg(CAST(abs(km / maint_number - 12000) <= 2400 AS INTEGER)) AS near FROM maint
 WHERE km IS NOT NULL AND maint_number > 0 GROUP BY 1 HAVING count(*) >= 50""", "maint")(
    lambda t: t.maint().where(F.col("km").isNotNull() & (F.col("maint_number") > 0)).groupBy("maint_number").agg(
        one().alias("n"), share(F.abs(F.col("km") / F.col("maint_number") - 12000) <= 2400).alias("near")).where("n >= 50"))


def deltas(m):
    """Differences between consecutive maintenance days of a vehicle (one row per calendar day at most)."""
    w = Window.partitionBy("vehicle_id").orderBy("event_date")
    return m.withColumns({"d_n": F.col("maint_number") - F.lag("maint_number").over(w), "d_days": F.datediff("event_date", F.lag("event_date").over(w)),
                          "d_km": F.col("km") - F.lag("km").over(w), "pos": F.row_number().over(w)})


_DELTAS = """SELECT *, maint_number - lag(maint_number) OVER w AS d_n, event_date - lag(event_date) OVER w AS d_days, km - lag(km) OVER w AS d_km,
 row_number() OVER w AS pos FROM {src} WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date)"""


def _seq(t: Tables):
    d = deltas(t.maint()).where(F.col("d_days").isNotNull())
    a = st.day_percentiles(d, ["d_n"], "d_days", [0.25, 0.5, 0.75], ["d25", "d50", "d75"], mean=False)
    b = st.exact_percentiles(d, ["d_n"], "d_km", [0.5], ["km50"]).drop("n")
    return a.join(b, a.d_n.eqNullSafe(b.d_n), "left").drop(b.d_n)


query("eda_sequence_deltas", "d_n d, n i, d25 d, d50 d, d75 d, km50 d", f"""SELECT d_n, count(*) AS n, quantile_cont(d_days, 0.25) AS d25, median(d_days) AS d50, quantile_cont(d_days, 0.75) AS d75,
 median(d_km) AS km50 FROM ({_DELTAS.format(src='maint')}) WHERE d_days IS NOT NULL GROUP BY 1""", "maint")(_seq)

query("eda_monotonic_numbering", "vehicles i, share d", f"""SELECT count(*) AS vehicles, avg(CAST(m >= 0 AS INTEGER)) AS share FROM (SELECT min(d_n) AS m FROM ({_DELTAS.format(src='maint')})
 GROUP BY vehicle_id HAVING count(d_n) > 0)""", "maint")(
    lambda t: deltas(t.maint()).groupBy("vehicle_id").agg(F.min("d_n").alias("m")).where(F.col("m").isNotNull()).agg(one().alias("vehicles"), share(F.col("m") >= 0).alias("share")))

_V = ["event_date", "StatusARG", "ScheduleSource"]
_SEQ = "SELECT *, {f}(event_date) OVER w AS o_date, {f}(StatusARG) OVER w AS o_status, {f}(ScheduleSource) OVER w AS o_source, {f}(customer_id) OVER w AS o_cust, {f}(dealer_id) OVER w AS o_dealer " \
       "FROM visits WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)"


def _flag_semantics(t: Tables):
    v = t.visits().select("schedule_id", "vehicle_id", "event_date", "StatusARG", "IsReschedule", "cancelled")
    v = next_row(previous_row(v, "vehicle_id", "event_date", "schedule_id", ["event_date"]), "vehicle_id", "event_date", "schedule_id", ["event_date"])
    return v.where("cancelled").groupBy("IsReschedule").agg(one().alias("n"), share(F.datediff("next_event_date", "event_date") <= 30).alias("next_30"),
                                                           share(F.datediff("next_event_date", "event_date") <= 90).alias("next_90"),
                                                           share(F.datediff("event_date", "prev_event_date") <= 30).alias("prev_30"))


query("eda_flag_semantics", "IsReschedule s, n i, next_30 d, next_90 d, prev_30 d", """
SELECT IsReschedule, count(*) AS n, avg(CAST(coalesce(nx - event_date <= 30, false) AS INTEGER)) AS next_30, avg(CAST(coalesce(nx - event_date <= 90, false) AS INTEGER)) AS next_90,
 avg(CAST(coalesce(event_date - pv <= 30, false) AS INTEGER)) AS prev_30
FROM (SELECT *, lead(event_date) OVER w AS nx, lag(event_date) OVER w AS pv FROM visits WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id))
WHERE cancelled GROUP BY 1""", "visits")(_flag_semantics)


def _pairs(t: Tables):
    v = t.visits().select("schedule_id", "vehicle_id", "event_date", "StatusARG", "ScheduleSource")
    p = previous_row(v, "vehicle_id", "event_date", "schedule_id", ["event_date", "StatusARG"])
    gap = F.datediff("event_date", "prev_event_date")
    b = F.when(gap == 0, F.lit("same_day")).when(gap <= 3, F.lit("1-3")).when(gap <= 30, F.lit("4-30"))
    return p.where(gap <= 30).groupBy(b.alias("gap"), F.col("prev_StatusARG").alias("first_status"), F.col("StatusARG").alias("second_status")).agg(one().alias("n"))


query("eda_close_pairs", "gap s, first_status s, second_status s, n i", f"""SELECT CASE WHEN event_date = o_date THEN 'same_day' WHEN event_date - o_date <= 3 THEN '1-3' ELSE '4-30' END AS gap,
 o_status AS first_status, StatusARG AS second_status, count(*) AS n FROM ({_SEQ.format(f='lag')}) WHERE event_date - o_date <= 30 GROUP BY 1, 2, 3""", "visits")(_pairs)

query("eda_missing_vehicle_profile", "missing b, n i, completed d, maint d, has_customer d", """SELECT vehicle_id IS NULL AS missing, count(*) AS n, avg(CAST(completed AS INTEGER)) AS completed,
 avg(CAST(has_maint AS INTEGER)) AS maint, count(customer_id) / count(*) AS has_customer FROM appt GROUP BY 1""", "appt")(
    lambda t: t.appt().groupBy(F.col("vehicle_id").isNull().alias("missing")).agg(one().alias("n"), share(F.col("completed")).alias("completed"), share(F.col("has_maint")).alias("maint"),
                                                                               share(F.col("customer_id").isNotNull()).alias("has_customer")))


def _recoverable(t: Tables):
    """Bookings without a vehicle whose customer is known with exactly one vehicle."""
    single = t.visits().where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.min("vehicle_id").alias("a"), F.max("vehicle_id").alias("b")).select(
        "customer_id", (F.col("a") == F.col("b")).alias("single"))
    j = t.appt().where(F.col("vehicle_id").isNull()).join(single, "customer_id", "left")
    return j.groupBy(F.when(F.col("customer_id").isNull(), "no_customer").when(F.col("single").isNull(), "customer_unseen").when(F.col("single"), "single_vehicle").otherwise("many_vehicles").alias(
        "situation")).agg(one().alias("n"), count_if(F.col("is_completed_maintenance")).alias("maintenances"))


query("eda_missing_vehicle_recoverable", "situation s, n i, maintenances i", """SELECT CASE WHEN customer_id IS NULL THEN 'no_customer' WHEN k IS NULL THEN 'customer_unseen' WHEN k = 1 THEN 'single_vehicle' ELSE 'many_vehicles' END AS situation,
 count(*) AS n, count(*) FILTER (WHERE is_completed_maintenance) AS maintenances FROM appt LEFT JOIN (SELECT customer_id, count(DISTINCT vehicle_id) AS k FROM visits
 WHERE customer_id IS NOT NULL GROUP BY 1) USING (customer_id) WHERE vehicle_id IS NULL GROUP BY 1""", "visits")(_recoverable)

query("eda_dealer_regions", "regions i, zones i, dealers i", """SELECT r AS regions, z AS zones, count(*) AS dealers FROM (SELECT count(DISTINCT Region) AS r, count(DISTINCT DealerStateOrZone) AS z FROM appt
 WHERE dealer_id IS NOT NULL GROUP BY dealer_id) GROUP BY 1, 2""", "appt")(
    lambda t: t.appt().where(F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(F.count_distinct("Region").alias("regions"), F.count_distinct("DealerStateOrZone").alias("zones")).groupBy(
        "regions", "zones").agg(one().alias("dealers")))
query("eda_dealer_zone_mode", "dealer_id s, mode s, mode_n i, n i", """SELECT dealer_id, arg_max(z, (k, z)) AS mode, max(k) AS mode_n, sum(k) AS n FROM (SELECT dealer_id, DealerStateOrZone AS z, count(*) AS k FROM appt
 WHERE dealer_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "appt")(lambda t: st.mode_of(t.appt().where(F.col("dealer_id").isNotNull()), ["dealer_id"], "DealerStateOrZone"))


def snapshot_profile(v, col: str):
    """Does a column vary within a vehicle, and does it equal the last / first / highest reading?"""
    when = F.struct("event_date", "schedule_id")
    g = v.groupBy("vehicle_id").agg(one().alias("k"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.max("VehicleCurrentKM").alias("top"),
                                    F.max_by("VehicleCurrentKM", F.when(F.col("VehicleCurrentKM").isNotNull(), when)).alias("last"),
                                    F.min_by("VehicleCurrentKM", F.when(F.col("VehicleCurrentKM").isNotNull(), when)).alias("first"))
    return g.agg(one().alias("vehicles"), count_if(F.col("k") >= 2).alias("repeated"), count_if(F.col("lo") != F.col("hi")).alias("varying"), share(F.col("hi") == F.col("last")).alias("eq_last"),
                 share(F.col("hi") == F.col("first")).alias("eq_first"), share(F.col("hi") == F.col("top")).alias("eq_max"), share(F.col("hi") >= F.col("last")).alias("ge_last"))


_SNAP = """SELECT '{c}' AS col, count(*) AS vehicles, count(*) FILTER (WHERE k >= 2) AS repeated, count(*) FILTER (WHERE lo <> hi) AS varying, avg(CAST(coalesce(hi = l, false) AS INTEGER)) AS eq_last,
 avg(CAST(coalesce(hi = f, false) AS INTEGER)) AS eq_first, avg(CAST(coalesce(hi = top, false) AS INTEGER)) AS eq_max, avg(CAST(coalesce(hi >= l, false) AS INTEGER)) AS ge_last
FROM (SELECT count(*) AS k, min({c}) AS lo, max({c}) AS hi, max(VehicleCurrentKM) AS top, last(VehicleCurrentKM ORDER BY event_date, schedule_id) FILTER (WHERE VehicleCurrentKM IS NOT NULL) AS l,
 first(VehicleCurrentKM ORDER BY event_date, schedule_id) FILTER (WHERE VehicleCurrentKM IS NOT NULL) AS f FROM visits GROUP BY vehicle_id)"""
query("eda_snapshot_detection", "col s, vehicles i, repeated i, varying i, eq_last d, eq_first d, eq_max d, ge_last d", _SNAP.format(c="KM") + " UNION ALL " + _SNAP.format(c="VehicleCurrentKM"), "visits")(
    lambda t: snapshot_profile(t.visits(), "KM").withColumn("col", F.lit("KM")).unionByName(snapshot_profile(t.visits(), "VehicleCurrentKM").withColumn("col", F.lit("VehicleCurrentKM"))))

query("eda_event_date_diagnostics", "n i, no_checkin i, checkin_far i, checkin_used i, before_start i, after_cutoff i, both_done_states i", """
SELECT count(*) AS n, count(*) FILTER (WHERE EffectiveCheckinDate IS NULL) AS no_checkin, count(*) FILTER (WHERE abs(EffectiveCheckinDate - ScheduleDate) > 45) AS checkin_far,
 count(*) FILTER (WHERE event_date <> ScheduleDate) AS checkin_used, count(*) FILTER (WHERE event_date < DATE '1995-01-01') AS before_start, count(*) FILTER (WHERE event_date > DATE '2001-02-28') AS after_cutoff,
 count(*) FILTER (WHERE completed_no_os AND has_maint) AS both_done_states FROM appt""", "appt")(
    lambda t: t.appt().agg(one().alias("n"), count_if(F.col("EffectiveCheckinDate").isNull()).alias("no_checkin"),
                           count_if(F.abs(F.datediff("EffectiveCheckinDate", "ScheduleDate")) > 45).alias("checkin_far"), count_if(F.col("event_date") != F.col("ScheduleDate")).alias("checkin_used"),
                           count_if(F.col("event_date") < F.lit(SPAN.start)).alias("before_start"), count_if(F.col("event_date") > F.lit(SPAN.cutoff)).alias("after_cutoff"),
                           count_if(F.col("completed_no_os") & F.col("has_maint")).alias("both_done_states")))

query("fold_dedup", "vehicle_id s, event_date t, maint_number d", """
WITH RECURSIVE o AS (SELECT vehicle_id, event_date, maint_number, row_number() OVER (PARTITION BY vehicle_id ORDER BY event_date, maint_number) AS k FROM maint_days),
r AS (SELECT vehicle_id, k, event_date, maint_number, event_date AS kd, maint_number AS kn, true AS keep FROM o WHERE k = 1
 UNION ALL SELECT o.vehicle_id, o.k, o.event_date, o.maint_number, CASE WHEN d THEN r.kd ELSE o.event_date END, CASE WHEN d THEN r.kn ELSE o.maint_number END, NOT d
 FROM r JOIN (SELECT * FROM o) o ON o.vehicle_id = r.vehicle_id AND o.k = r.k + 1, LATERAL (SELECT coalesce(o.event_date - r.kd <= 30 AND o.maint_number = r.kn, false) AS d))
SELECT vehicle_id, event_date, maint_number FROM r WHERE keep""", "maint_days")(lambda t: ev.fold_duplicates(ev.maintenance_days(t.appt())))
