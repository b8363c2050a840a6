"""Second-look analyses: substitutes, sequences before and after de-duplication, alternative definitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from reprise.functions.columns import INF, count_if, cut, share
from reprise.operators import events as ev, stats as st
from reprise.operators.asof import asof_join, band_exists
from reprise.plans.channel_queries import _B, _DM, base, gen_deltas
from reprise.plans.domain import SPAN, Tables
from reprise.plans.registry import query
from reprise.plans.visit_queries import _COMBO, _DELTAS, combos, deltas

one = lambda: F.count(F.lit(1))
_CUT = "DATE '2001-02-28'"


def guarantees(t: Tables):
    """Completed visits with a guarantee item and no maintenance item."""
    return t.visits().where(F.col("completed") & F.col("has_guarantee") & ~F.col("has_maint")).select("schedule_id", "vehicle_id", "event_date")


_GU = "(SELECT * FROM visits WHERE completed AND has_guarantee AND NOT has_maint)"


def _neighbour_numbers(t: Tables):
    m = t.maint().select("vehicle_id", F.col("event_date").alias("at"), F.col("maint_number").alias("num"))
    nxt = asof_join(guarantees(t), m.withColumnsRenamed({"at": "next_at", "num": "next_n"}), "vehicle_id", "event_date", "next_at", ["next_n"], "forward")
    both = asof_join(nxt, m.withColumnsRenamed({"at": "prev_at", "num": "prev_n"}), "vehicle_id", "event_date", "prev_at", ["prev_n"])
    return both


_NB = f"""(SELECT g.*, (SELECT arg_min(maint_number, event_date) FROM maint m WHERE m.vehicle_id = g.vehicle_id AND m.event_date > g.event_date) AS next_n,
 (SELECT arg_max(maint_number, event_date) FROM maint m WHERE m.vehicle_id = g.vehicle_id AND m.event_date < g.event_date) AS prev_n FROM {_GU} g)"""
_NCASE = "CASE WHEN {c} IS NULL THEN 'none' WHEN {c} <= 1 THEN '1' WHEN {c} <= 2 THEN '2' ELSE '3+' END"
query("substitute_neighbour_numbers", "prev s, next s, followed b, n i".replace("prev s", "prev_n s").replace("next s", "next_n s"), f"SELECT {_NCASE.format(c='prev_n')} AS prev_n, {_NCASE.format(c='next_n')} AS next_n, event_date <= {_CUT} - 365 AS followed, count(*) AS n FROM {_NB} GROUP BY 1, 2, 3",
      "visits maint")(lambda t: _neighbour_numbers(t).groupBy(*[F.when(F.col(c).isNull(), "none").when(F.col(c) <= 1, "1").when(F.col(c) <= 2, "2").otherwise("3+").alias(c) for c in ("prev_n", "next_n")],
                                                              (F.col("event_date") <= F.date_sub(F.lit(SPAN.cutoff), 365)).alias("followed")).agg(one().alias("n")))
query("substitute_plan_gap", "d_n d, n i", f"SELECT next_n - prev_n AS d_n, count(*) AS n FROM {_NB} GROUP BY 1", "visits maint")(
    lambda t: _neighbour_numbers(t).groupBy((F.col("next_n") - F.col("prev_n")).alias("d_n")).agg(one().alias("n")))


def _milestone(t: Tables):
    """Distance of the odometer at a substitute visit to the nearest plan multiple."""
    k = 12000.0
    g = t.visits().where(F.col("completed") & F.col("has_guarantee") & ~F.col("has_maint") & F.col("VehicleCurrentKM").isNotNull())
    g = g.withColumn("off", F.abs(F.col("VehicleCurrentKM") - F.rint(F.col("VehicleCurrentKM") / k) * k))
    return st.exact_percentiles(g, [], "off", [.25, .5, .75]).withColumn("near", g.agg(share(F.col("off") <= 1500).alias("s")).scalar())


query("substitute_milestone_distance", "n i, p25 d, p50 d, p75 d, near d", """SELECT count(*) AS n, quantile_cont(o, 0.25) AS p25, median(o) AS p50, quantile_cont(o, 0.75) AS p75, avg(CAST(o <= 1500 AS INTEGER)) AS near FROM (
 SELECT abs(VehicleCurrentKM - round_even(VehicleCurrentKM / 12000e0, 0) * 12000) AS o FROM visits WHERE completed AND has_guarantee AND NOT has_maint AND VehicleCurrentKM IS NOT NULL)""", "visits")(_milestone)


def _event_kinds(t: Tables):
    v = t.visits().where("completed").withColumn("kind", F.when(F.col("has_maint"), "maintenance").when(F.col("has_guarantee"), "guarantee").otherwise("other"))
    v = v.where(F.col("event_date") <= F.date_sub(F.lit(SPAN.cutoff), 365)).select("schedule_id", "vehicle_id", "event_date", "kind")
    v = asof_join(v, t.maint().select("vehicle_id", F.col("event_date").alias("nxt")), "vehicle_id", "event_date", "nxt", ["nxt"], "forward")
    return v.groupBy("kind").agg(one().alias("n"), share(F.datediff("nxt", "event_date") <= 180).alias("r180"), share(F.datediff("nxt", "event_date") <= 365).alias("r365"))


query("retention_by_event_kind", "kind s, n i, r180 d, r365 d", f"""SELECT kind, count(*) AS n, avg(CAST(coalesce(nx - event_date <= 180, false) AS INTEGER)) AS r180, avg(CAST(coalesce(nx - event_date <= 365, false) AS INTEGER)) AS r365 FROM (SELECT *, CASE WHEN has_maint THEN 'maintenance'
 WHEN has_guarantee THEN 'guarantee' ELSE 'other' END AS kind, (SELECT min(event_date) FROM maint m WHERE m.vehicle_id = v.vehicle_id AND m.event_date > v.event_date) AS nx FROM visits v WHERE completed AND event_date <= {_CUT} - 365) GROUP BY 1""", "visits maint")(_event_kinds)


def _before_after(t: Tables):
    d = ev.maintenance_days(t.appt())
    out = None
    for name, x in (("before", d), ("after_chain", ev.drop_split_visits(d)), ("after_fold", ev.fold_duplicates(d).withColumn("km", F.lit(None).cast("double")))):
        y = deltas(x).where("d_days IS NOT NULL")
        row = y.agg(F.lit(name).alias("stage"), one().alias("pairs"), count_if(F.col("d_n") == 0).alias("same_number"), count_if((F.col("d_n") == 0) & (F.col("d_days") <= 30)).alias("same_within_30"), share(F.col("d_n") >= 0).alias("monotone"))
        out = row if out is None else out.unionByName(row)
    return out


_BA = "SELECT '{n}' AS stage, count(*) AS pairs, count(*) FILTER (WHERE d_n = 0) AS same_number, count(*) FILTER (WHERE d_n = 0 AND d_days <= 30) AS same_within_30, avg(CAST(coalesce(d_n >= 0, false) AS INTEGER)) AS monotone FROM (" + _DELTAS + ") WHERE d_days IS NOT NULL"
query("sequence_before_after_dedup", "stage s, pairs i, same_number i, same_within_30 i, monotone d")(_before_after)
query("sequence_before_dedup", "stage s, pairs i, same_number i, same_within_30 i, monotone d", _BA.format(n="before", src="maint_days") + " UNION ALL " + _BA.format(n="after_chain", src="maint_split"), "maint_split")(
    lambda t: _before_after(t).where("stage <> 'after_fold'"))
query("same_number_gap_buckets", "bucket s, n i", f"""SELECT CASE WHEN d_days <= 30 THEN '0-30' WHEN d_days <= 90 THEN '31-90' WHEN d_days <= 180 THEN '91-180' ELSE '181+' END AS bucket, count(*) AS n FROM ({_DELTAS.format(src='maint_days')}) WHERE d_n = 0 AND d_days IS NOT NULL GROUP BY 1""", "maint_days")(
    lambda t: deltas(ev.maintenance_days(t.appt())).where("d_n = 0 AND d_days IS NOT NULL").groupBy(cut(F.col("d_days"), [-INF, 30, 90, 180, INF], ["0-30", "31-90", "91-180", "181+"]).alias("bucket")).agg(one().alias("n")))


def _first_age(t: Tables):
    """Age at the first maintenance by quarterly warranty cohort."""
    f = t.maint().groupBy("vehicle_id").agg(F.min("event_date").alias("f")).join(t.master().select("vehicle_id", "warranty_start"), "vehicle_id")
    f = f.where(F.col("f") >= F.col("warranty_start")).select(F.trunc("warranty_start", "quarter").alias("cohort"), F.datediff("f", "warranty_start").alias("age"))
    return st.day_percentiles(f, ["cohort"], "age", [.25, .5, .75])


query("first_service_age_by_cohort", "cohort t, n i, mean d, p25 d, p50 d, p75 d", """SELECT date_trunc('quarter', warranty_start) AS cohort, count(*) AS n, avg(f - warranty_start) AS mean, quantile_cont(f - warranty_start, 0.25) AS p25, median(f - warranty_start) AS p50, quantile_cont(f - warranty_start, 0.75) AS p75
 FROM (SELECT vehicle_id, min(event_date) AS f FROM maint GROUP BY 1) JOIN vm USING (vehicle_id) WHERE f >= warranty_start GROUP BY 1""", "maint vm")(_first_age)


def _blended(t: Tables):
    """Recent, cumulative and blended pace at each maintenance after the first."""
    d = deltas(t.maint()).join(t.master().select("vehicle_id", "warranty_start"), "vehicle_id", "left")
    age = F.datediff("event_date", "warranty_start")
    d = d.withColumns({"cum": F.when(age >= 90, F.col("km") / age * 365.25), "rec": F.when((F.col("d_days") >= 30) & (F.col("d_km") > 0), F.col("d_km") / F.col("d_days") * 365.25)}).where("cum IS NOT NULL AND rec IS NOT NULL")
    d = d.withColumn("mix", (F.col("cum") + F.col("rec")) / 2)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("cum", "rec", "mix")]))
    return st.exact_percentiles(d.select(parts.alias("p")).select("p.*"), ["kind"], "v", [.25, .5, .75])


query("blended_usage_rate", "kind s, n i, p25 d, p50 d, p75 d", f"""WITH d AS (SELECT *, (cum + rec) / 2 AS mix FROM (SELECT km / CASE WHEN event_date - warranty_start >= 90 THEN event_date - warranty_start END * 365.25 AS cum, CASE WHEN d_days >= 30 AND d_km > 0 THEN d_km / d_days * 365.25 END AS rec
 FROM ({_DELTAS.format(src='maint')}) LEFT JOIN (SELECT vehicle_id, warranty_start FROM vm) USING (vehicle_id)) WHERE cum IS NOT NULL AND rec IS NOT NULL)
SELECT kind, count(*) AS n, quantile_cont(v, 0.25) AS p25, median(v) AS p50, quantile_cont(v, 0.75) AS p75 FROM (SELECT 'cum' AS kind, cum AS v FROM d UNION ALL SELECT 'rec', rec FROM d UNION ALL SELECT 'mix', mix FROM d) GROUP BY 1""", "maint vm")(_blended)
query("short_return_sensitivity", "year i, gen s, n i, ret d, ret30 d", f"SELECT year, gen, count(*) AS n, avg(ret) AS ret, avg(ret30) AS ret30 FROM {_B} GROUP BY 1, 2", "visits")(
    lambda t: base(t).groupBy("year", "gen").agg(one().alias("n"), F.avg("ret").alias("ret"), F.avg("ret30").alias("ret30")))


def _active_before(t: Tables):
    """Return among visits whose vehicle was active in the twelve months before, and the rest."""
    v = t.visits().select("schedule_id", "vehicle_id", "event_date")
    b = band_exists(base(t), v, "vehicle_id", "event_date", "event_date", -365, -1, "schedule_id", "active_before")
    return b.groupBy("active_before").agg(one().alias("n"), F.avg("ret").alias("ret"))


query("band_exists", "active_before b, n i, ret d", f"""SELECT EXISTS (SELECT 1 FROM visits v WHERE v.vehicle_id = b.vehicle_id AND v.schedule_id <> b.schedule_id AND v.event_date - b.event_date BETWEEN -365 AND -1) AS active_before, count(*) AS n, avg(ret) AS ret FROM {_B} b GROUP BY 1""", "visits")(_active_before)
query("gap_event_vs_vehicle", "per_event d, per_vehicle d", f"SELECT avg(d_days) AS per_event, (SELECT avg(m) FROM (SELECT avg(d_days) AS m FROM ({_DELTAS.format(src='maint')}) GROUP BY vehicle_id)) AS per_vehicle FROM ({_DELTAS.format(src='maint')})", "maint")(
    lambda t: deltas(t.maint()).groupBy("vehicle_id").agg(F.sum("d_days").alias("s"), F.count("d_days").alias("c")).agg((F.sum("s") / F.sum("c")).alias("per_event"), F.avg(F.try_divide("s", "c")).alias("per_vehicle")))
query("last_event_by_snapshot", "connected_status s, bucket s, n i, share d", f"""SELECT coalesce(c, 'none') AS connected_status, CASE WHEN g <= 180 THEN '0-180' WHEN g <= 365 THEN '181-365' ELSE '366+' END AS bucket, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY coalesce(c, 'none')) AS share
 FROM (SELECT last(ConnectedStatusARG ORDER BY event_date, schedule_id) AS c, {_CUT} - max(event_date) AS g FROM visits GROUP BY vehicle_id) GROUP BY 1, 2""", "visits")(
    lambda t: st.value_shares(t.visits().groupBy("vehicle_id").agg(F.max_by("ConnectedStatusARG", F.struct("event_date", "schedule_id")).alias("c"), F.datediff(F.lit(SPAN.cutoff), F.max("event_date")).alias("g")).select(
        F.coalesce("c", F.lit("none")).alias("connected_status"), cut(F.col("g"), [-INF, 180, 365, INF], ["0-180", "181-365", "366+"]).alias("bucket")), ["connected_status"], "bucket"))
query("snapshot_excess_by_connectivity", "connected_status s, n i, p50 d, p95 d", """SELECT coalesce(c, 'none') AS connected_status, count(x) AS n, median(x) AS p50, quantile_cont(x, 0.95) AS p95 FROM (SELECT max(ConnectedStatusARG) AS c, max(KM) - last(VehicleCurrentKM ORDER BY event_date, schedule_id) FILTER (WHERE VehicleCurrentKM IS NOT NULL) AS x
 FROM visits GROUP BY vehicle_id) GROUP BY 1""", "visits")(
    lambda t: st.exact_percentiles(t.visits().groupBy("vehicle_id").agg(F.max("ConnectedStatusARG").alias("c"), (F.max("KM") - F.max_by("VehicleCurrentKM", F.when(F.col("VehicleCurrentKM").isNotNull(), F.struct("event_date", "schedule_id")))).alias("x"))
                                   .withColumn("connected_status", F.coalesce("c", F.lit("none"))), ["connected_status"], "x", [.5, .95]))
query("future_bookings_effect", "month t, with_future d, without_future d", f"""SELECT date_trunc('month', event_date) AS month, avg(CAST(completed AS INTEGER)) AS with_future, avg(CAST(completed AS INTEGER)) FILTER (WHERE event_date <= {_CUT}) AS without_future FROM visits WHERE event_date >= DATE '2001-01-01' GROUP BY 1""", "visits")(
    lambda t: t.visits().where(F.col("event_date") >= F.lit(dt.date(2001, 1, 1))).groupBy(F.trunc("event_date", "month").alias("month")).agg(
        share(F.col("completed")).alias("with_future"), F.avg(F.when(F.col("event_date") <= F.lit(SPAN.cutoff), F.col("completed").cast("double"))).alias("without_future")))
query("deterministic_sample", "schedule_id s", "SELECT schedule_id FROM appt ORDER BY md5(schedule_id), schedule_id LIMIT 400", "appt")(lambda t: t.appt().orderBy(F.md5("schedule_id"), "schedule_id").limit(400).select("schedule_id"))
