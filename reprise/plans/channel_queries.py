"""Usage pace, due rules, seasonality, channels, dealers and return drivers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reprise.functions.columns import INF, count_if, cut, share
from reprise.operators import stats as st
from reprise.operators.asof import asof_join
from reprise.operators.history import counts_before
from reprise.operators.ranks import equal_count_bin, number_rows, running_totals
from reprise.plans.domain import SPAN, Tables
from reprise.plans.registry import query
from reprise.plans.visit_queries import _DELTAS, deltas

one = lambda: F.count(F.lit(1))
_CUT = "DATE '2001-02-28'"
_YEAR = 365.25


# ---------------------------------------------------------------------------------- usage pace
def pace(t: Tables):
    """Per vehicle: cumulative pace at the last reading and slope between first and last reading."""
    def build():
        m = t.maint().where(F.col("km").isNotNull()).groupBy("vehicle_id").agg(
            F.min("event_date").alias("d0"), F.max("event_date").alias("d1"), F.min_by("km", "event_date").alias("k0"), F.max_by("km", "event_date").alias("k1"))
        m = m.join(t.master().select("vehicle_id", "warranty_start", "generation", "business_unit"), "vehicle_id", "left")
        age, span = F.datediff("d1", "warranty_start") / _YEAR, F.datediff("d1", "d0")
        a, b = F.when(age >= 0.25, F.col("k1") / age), F.when((span >= 90) & (F.col("k1") > F.col("k0")), (F.col("k1") - F.col("k0")) / (span / _YEAR))
        return m.withColumns({"rate_a": a, "rate_b": b}).withColumns({"ok_a": F.when(F.col("rate_a").between(2000, 150000), F.col("rate_a")), "ok_b": F.when(F.col("rate_b").between(2000, 150000), F.col("rate_b"))})
    return t.stage("pace", build)


_PACE = """(SELECT *, CASE WHEN rate_a BETWEEN 2000 AND 150000 THEN rate_a END AS ok_a, CASE WHEN rate_b BETWEEN 2000 AND 150000 THEN rate_b END AS ok_b FROM (SELECT *, CASE WHEN (d1 - warranty_start) / 365.25 >= 0.25 THEN k1 / ((d1 - warranty_start) / 365.25) END AS rate_a,
 CASE WHEN d1 - d0 >= 90 AND k1 > k0 THEN (k1 - k0) / ((d1 - d0) / 365.25) END AS rate_b FROM (SELECT vehicle_id, min(event_date) AS d0, max(event_date) AS d1, arg_min(km, event_date) AS k0, arg_max(km, event_date) AS k1 FROM maint WHERE km IS NOT NULL GROUP BY 1)
 LEFT JOIN (SELECT vehicle_id, warranty_start, generation, business_unit FROM vm) USING (vehicle_id)))"""
query("usage_rate_methods", "with_a i, out_a i, with_b i, out_b i, within_25 d", f"""SELECT count(rate_a) AS with_a, count(rate_a) - count(ok_a) AS out_a, count(rate_b) AS with_b, count(rate_b) - count(ok_b) AS out_b,
 avg(CASE WHEN ok_a IS NOT NULL AND ok_b IS NOT NULL THEN CAST(abs(ok_b / ok_a - 1) <= 0.25 AS INTEGER) END) AS within_25 FROM {_PACE}""", "maint vm")(
    lambda t: pace(t).agg(F.count("rate_a").alias("with_a"), (F.count("rate_a") - F.count("ok_a")).alias("out_a"), F.count("rate_b").alias("with_b"), (F.count("rate_b") - F.count("ok_b")).alias("out_b"),
                          F.avg((F.abs(F.col("ok_b") / F.col("ok_a") - 1) <= 0.25).cast("double")).alias("within_25")))
query("spearman", "n i, spearman d", f"""SELECT count(*) AS n, corr(ra, rb) AS spearman FROM (SELECT rank() OVER (ORDER BY ok_a) + (count(*) OVER (PARTITION BY ok_a) - 1) / 2 AS ra, rank() OVER (ORDER BY ok_b) + (count(*) OVER (PARTITION BY ok_b) - 1) / 2 AS rb
 FROM {_PACE} WHERE ok_a IS NOT NULL AND ok_b IS NOT NULL)""", "maint vm")(lambda t: st.weighted_spearman(pace(t), "ok_a", "ok_b"))
_Q = [0.05, 0.25, 0.5, 0.75, 0.95]
query("percentile_table", "generation s, n i, p5 d, p25 d, p50 d, p75 d, p95 d", "SELECT generation, count(ok_a) AS n, " + ", ".join(f"quantile_cont(ok_a, {p}) AS p{p * 100:g}" for p in _Q) + f" FROM {_PACE} GROUP BY 1 HAVING count(ok_a) > 0", "maint vm")(
    lambda t: st.exact_percentiles(pace(t), ["generation"], "ok_a", _Q))


def tercile(t: Tables):
    e = st.exact_percentiles(pace(t), [], "ok_a", [1 / 3, 2 / 3], ["t1", "t2"])
    lo, hi = e.select("t1").scalar(), e.select("t2").scalar()
    return pace(t).where(F.col("ok_a").isNotNull()).withColumn("tercile", F.when(F.col("ok_a") <= lo, "low").when(F.col("ok_a") <= hi, "mid").otherwise("high"))


query("usage_terciles", "tercile s, n i, mean d", f"""SELECT CASE WHEN ok_a <= (SELECT quantile_cont(ok_a, 1e0 / 3e0) FROM {_PACE}) THEN 'low' WHEN ok_a <= (SELECT quantile_cont(ok_a, 2e0 / 3e0) FROM {_PACE}) THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, avg(ok_a) AS mean
 FROM {_PACE} WHERE ok_a IS NOT NULL GROUP BY 1""", "maint vm")(lambda t: tercile(t).groupBy("tercile").agg(one().alias("n"), F.avg("ok_a").alias("mean")))

_DM = f"(SELECT d.*, generation FROM ({_DELTAS.format(src='maint')}) d LEFT JOIN (SELECT vehicle_id, generation FROM vm) USING (vehicle_id))"
gen_deltas = lambda t: deltas(t.maint()).join(t.master().select("vehicle_id", "generation"), "vehicle_id", "left")
query("interval_percentiles", "generation s, n i, mean d, p5 d, p25 d, p50 d, p75 d, p95 d", "SELECT generation, count(*) AS n, avg(d_days) AS mean, " + ", ".join(f"quantile_cont(d_days, {p}) AS p{p * 100:g}" for p in _Q) + f" FROM {_DM} WHERE d_days IS NOT NULL GROUP BY 1", "maint vm")(
    lambda t: st.day_percentiles(gen_deltas(t), ["generation"], "d_days", _Q))
query("maintenances_per_vehicle", "k i, vehicles i", "SELECT k, count(*) AS vehicles FROM (SELECT count(*) AS k FROM maint GROUP BY vehicle_id) GROUP BY 1", "maint")(
    lambda t: t.maint().groupBy("vehicle_id").agg(one().alias("k")).groupBy("k").agg(one().alias("vehicles")))
query("gap_by_heavy_vehicle", "heavy b, gaps i, mean d, share d", f"""SELECT k > 5 AS heavy, count(*) AS gaps, avg(d_days) AS mean, count(*) / sum(count(*)) OVER () AS share FROM (SELECT d_days, count(*) OVER (PARTITION BY vehicle_id) AS k FROM ({_DELTAS.format(src='maint')})) WHERE d_days IS NOT NULL GROUP BY 1""", "maint")(
    lambda t: deltas(t.maint()).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("vehicle_id"))).where("d_days IS NOT NULL").groupBy((F.col("k") > 5).alias("heavy")).agg(
        one().alias("gaps"), F.avg("d_days").alias("mean")).withColumn("share", F.col("gaps") / F.sum("gaps").over(Window.partitionBy(F.lit(0)))))


def anchors18(t: Tables):
    """Maintenances with at least 18 months (548 days) of follow-up and the days to the next one."""
    w = Window.partitionBy("vehicle_id").orderBy("event_date")
    m = t.maint().withColumns({"to_next": F.datediff(F.lead("event_date").over(w), "event_date"), "prev_km": F.lag("km").over(w), "prev_d": F.lag("event_date").over(w)})
    return (m.where(F.datediff(F.lit(SPAN.cutoff), "event_date") >= 548).join(t.master().select("vehicle_id", "generation", "warranty_start"), "vehicle_id", "left")
            .withColumn("ret18", F.coalesce(F.col("to_next") <= 548, F.lit(False))))


_A18 = f"""(SELECT *, coalesce(to_next <= 548, false) AS ret18 FROM (SELECT m.*, generation, warranty_start, lead(event_date) OVER w - event_date AS to_next, lag(km) OVER w AS prev_km, lag(event_date) OVER w AS prev_d FROM maint m LEFT JOIN (SELECT vehicle_id, generation, warranty_start FROM vm)
 USING (vehicle_id) WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date)) WHERE {_CUT} - event_date >= 548)"""


def _censor(t: Tables):
    naive = st.day_percentiles(gen_deltas(t), ["generation"], "d_days", [0.5], ["naive_median"], mean=False).withColumnsRenamed({"n": "pairs", "generation": "g"})
    a = anchors18(t)
    base = a.groupBy("generation").agg(one().alias("anchors"), share(F.col("ret18")).alias("return18"))
    med = st.day_percentiles(a.where("ret18"), ["generation"], "to_next", [0.5], ["median18"], mean=False).drop("n").withColumnRenamed("generation", "g2")
    unc = st.day_percentiles(a.withColumn("x", F.coalesce("to_next", F.lit(10000))), ["generation"], "x", [0.5], ["median_all"], mean=False).drop("n").withColumnRenamed("generation", "g3")
    e = lambda c: F.col("generation").eqNullSafe(F.col(c))
    return base.join(naive, e("g"), "left").join(med, e("g2"), "left").join(unc, e("g3"), "left")


query("censor_correction", "generation s, pairs i, naive_median d, anchors i, return18 d, median18 d, median_all d", f"""SELECT a.generation, pairs, naive_median, anchors, return18, median18, median_all FROM (SELECT generation, count(*) AS anchors, avg(CAST(ret18 AS INTEGER)) AS return18,
 median(to_next) FILTER (WHERE ret18) AS median18, median(coalesce(to_next, 10000)) AS median_all FROM {_A18} GROUP BY 1) a LEFT JOIN (SELECT generation, count(*) AS pairs, median(d_days) AS naive_median FROM {_DM} WHERE d_days IS NOT NULL GROUP BY 1) n
 ON n.generation IS NOT DISTINCT FROM a.generation""", "maint vm")(_censor)

_RULES = {"time_only": None, "k10": 10000.0, "k14": 14000.0, "k20": 20000.0}


def _due_rules(t: Tables, levels: tuple = ("rule",)):
    """Delay against each due rule, captured returns and churn among windows still open at opening."""
    a = anchors18(t).where(F.datediff("event_date", "warranty_start") >= 90).withColumn("rate", F.col("km") / F.datediff("event_date", "warranty_start")).where(F.col("rate") > 0)
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), (F.lit(365.0) if k is None else F.least(F.lit(k) / F.col("rate"), F.lit(365.0))).alias("due")) for n, k in _RULES.items()])
    x = a.select("generation", "ret18", "to_next", F.explode(rules).alias("r")).select("*", "r.*").withColumn("delay", F.col("to_next") - F.col("due"))
    open_ = ~F.coalesce(F.col("delay") < -30, F.lit(False))
    late = lambda h: ~F.coalesce(F.col("delay") <= h, F.lit(False))
    return x.groupBy(*levels).agg(one().alias("windows"), share(F.col("ret18")).alias("return18"), *[F.avg(F.when(F.col("ret18"), (F.col("delay") <= h).cast("double"))).alias(f"captured_{h}") for h in (60, 90, 120)],
                                  *[F.avg(F.when(open_, late(h).cast("double"))).alias(f"churn_{h}") for h in (60, 90, 120)])


_DUEX = f"""(SELECT *, to_next - due AS delay FROM (SELECT *, CASE rule WHEN 'time_only' THEN 365e0 WHEN 'k10' THEN least(10000e0 / rate, 365e0) WHEN 'k14' THEN least(14000e0 / rate, 365e0) ELSE least(20000e0 / rate, 365e0) END AS due
 FROM (SELECT *, km / (event_date - warranty_start) AS rate FROM {_A18} WHERE event_date - warranty_start >= 90), (SELECT unnest(['time_only', 'k10', 'k14', 'k20']) AS rule) WHERE rate > 0))"""
_DUES = ", ".join(f"avg(CAST(delay <= {h} AS INTEGER)) FILTER (WHERE ret18) AS captured_{h}" for h in (60, 90, 120)) + ", " + ", ".join(
    f"avg(CAST(NOT coalesce(delay <= {h}, false) AS INTEGER)) FILTER (WHERE NOT coalesce(delay < -30, false)) AS churn_{h}" for h in (60, 90, 120))
_DSPEC = "windows i, return18 d, captured_60 d, captured_90 d, captured_120 d, churn_60 d, churn_90 d, churn_120 d"
query("due_rule_comparison", "rule s, " + _DSPEC, f"SELECT rule, count(*) AS windows, avg(CAST(ret18 AS INTEGER)) AS return18, {_DUES} FROM {_DUEX} GROUP BY 1", "maint vm")(_due_rules)
query("due_rule_by_generation", "rule s, generation s, " + _DSPEC, f"SELECT rule, generation, count(*) AS windows, avg(CAST(ret18 AS INTEGER)) AS return18, {_DUES} FROM {_DUEX} GROUP BY 1, 2", "maint vm")(lambda t: _due_rules(t, ("rule", "generation")))


def _opening_grid(t: Tables):
    a = anchors18(t)
    delay = F.col("to_next") - 365
    cells = [F.struct(F.lit(o).alias("opening"), F.lit(h).alias("horizon"), F.avg(F.when(~F.coalesce(delay < -o, F.lit(False)), (~F.coalesce(delay <= h, F.lit(False))).cast("double"))).alias("churn"),
                      share(F.coalesce(delay < -o, F.lit(False))).alias("preempted")) for o in (0, 30, 60) for h in (60, 90, 120)]
    return a.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


query("opening_horizon_grid", "opening i, horizon i, churn d, preempted d", f"""SELECT o AS opening, h AS horizon, avg(CAST(NOT coalesce(to_next - 365 <= h, false) AS INTEGER)) FILTER (WHERE NOT coalesce(to_next - 365 < -o, false)) AS churn,
 avg(CAST(coalesce(to_next - 365 < -o, false) AS INTEGER)) AS preempted FROM {_A18}, (SELECT unnest([0, 30, 60]) AS o), (SELECT unnest([60, 90, 120]) AS h) GROUP BY 1, 2""", "maint vm")(_opening_grid)


def _reweighted(t: Tables):
    """Prevalence per generation re-weighted to the mix of the latest anchors."""
    a = anchors18(t).withColumn("g", F.coalesce("generation", F.lit("none")))
    old = a.groupBy("g").agg(one().alias("n"), share(~F.col("ret18")).alias("churn"))
    new = a.where(F.col("event_date") >= F.lit("1999-01-01")).groupBy("g").agg(one().alias("n_new"))
    j = old.join(new, "g", "left")
    return j.agg((F.sum(F.col("churn") * F.col("n")) / F.sum("n")).alias("crude"), (F.sum(F.col("churn") * F.coalesce("n_new", F.lit(0))) / F.sum("n_new")).alias("reweighted"))


query("prevalence_reweighted", "crude d, reweighted d", f"""SELECT sum(churn * n) / sum(n) AS crude, sum(churn * coalesce(nn, 0)) / sum(nn) AS reweighted FROM (SELECT coalesce(generation, 'none') AS g, count(*) AS n, avg(CAST(NOT ret18 AS INTEGER)) AS churn,
 nullif(count(*) FILTER (WHERE event_date >= DATE '1999-01-01'), 0) AS nn FROM {_A18} GROUP BY 1)""", "maint vm")(_reweighted)


# ---------------------------------------------------------------------------------- seasonality
def monthly(t: Tables):
    """Completed visits per complete month up to the cut-off, and per business day (Monday to Friday)."""
    done = t.visits().where(F.col("completed") & (F.col("event_date") <= F.lit(SPAN.cutoff)))
    m = done.where(F.last_day("event_date") <= F.lit(SPAN.cutoff)).groupBy(F.trunc("event_date", "month").alias("month")).agg(one().alias("n"))
    days = F.sequence(F.col("month"), F.last_day("month"))
    return m.withColumn("business_days", F.size(F.filter(days, lambda d: F.weekday(d) < 5))).withColumn("per_day", F.col("n") / F.col("business_days"))


_MON = f"""(SELECT *, n / business_days AS per_day FROM (SELECT month, n, (SELECT count(*) FROM unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS u(d) WHERE isodow(d) <= 5) AS business_days
 FROM (SELECT date_trunc('month', event_date) AS month, count(*) AS n FROM visits WHERE completed AND last_day(event_date) <= {_CUT} GROUP BY 1)))"""
query("monthly_per_business_day", "month t, n i, business_days i, per_day d", f"SELECT * FROM {_MON}", "visits")(monthly)


def moving_ratio(m):
    """Ratio of the count to its centred 2x12 moving average over calendar months; a month that lacks one of them has none."""
    m = m.withColumn("_k", F.year("month") * 12 + F.month("month"))
    w = Window.partitionBy(F.lit(0)).orderBy("_k")
    a, b = w.rangeBetween(-6, 5), w.rangeBetween(-5, 6)
    full = (F.count("n").over(a) == 12) & (F.count("n").over(b) == 12)
    return m.withColumn("trend", F.when(full, (F.avg("n").over(a) + F.avg("n").over(b)) / 2)).withColumn("ratio", F.col("n") / F.col("trend"))


query("seasonal_ma_ratio", "month t, trend d, ratio d", f"""SELECT month, trend, n / trend AS ratio FROM (SELECT *, CASE WHEN count(*) OVER a = 12 AND count(*) OVER b = 12 THEN (avg(n) OVER a + avg(n) OVER b) / 2 END AS trend FROM {_MON}
 WINDOW a AS (ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (ORDER BY year(month) * 12 + month(month) RANGE BETWEEN 5 PRECEDING AND 6 FOLLOWING))""", "visits")(lambda t: moving_ratio(monthly(t)))
query("seasonal_index_raw", "cal_month i, idx d", f"SELECT month(month) AS cal_month, avg(per_day) / (SELECT avg(per_day) FROM {_MON}) AS idx FROM {_MON} GROUP BY 1", "visits")(
    lambda t: (lambda m: m.groupBy(F.month("month").alias("cal_month")).agg((F.avg("per_day") / m.agg(F.avg("per_day").alias("a")).scalar()).alias("idx")))(monthly(t)))


# ---------------------------------------------------------------------------------- return proxy
def base(t: Tables):
    """Completed maintenances with a 15-month return label and convenience attributes."""
    def build():
        v = t.visits().where(F.col("is_completed_maintenance") & F.col("event_date").between("1995-01-01", "1999-11-30"))
        v = v.select("schedule_id", "vehicle_id", "event_date", "dealer_id", "customer_id", "ScheduleSource", "maint_number", "SurveyStarRating", "WarrantyStartDate", "VehicleCurrentKM", "ModelYear", "has_pud", "has_mobile", "has_fixed_price",
                     "CustomerWaiting", F.coalesce("ShortVehicleModelGroupTreated", F.lit("none")).alias("gen"))
        md = t.visits().where("is_completed_maintenance").select("vehicle_id", F.col("event_date").alias("nxt")).distinct()
        v = asof_join(v, md, "vehicle_id", "event_date", "nxt", ["nxt"], "forward")
        v = asof_join(v.withColumn("key30", F.date_add("event_date", 30)), md.withColumnRenamed("nxt", "nxt30"), "vehicle_id", "key30", "nxt30", ["nxt30"], "forward", True)
        lim = F.least(F.date_add("event_date", 456), F.lit(SPAN.cutoff))
        return v.withColumns({"ret": F.coalesce(F.col("nxt") <= lim, F.lit(False)).cast("int"), "ret30": F.coalesce(F.col("nxt30") <= lim, F.lit(False)).cast("int"), "year": F.year("event_date"),
                              "number_bin": cut(F.col("maint_number"), [0, 1, 2, 3, 5, INF], ["1", "2", "3", "4-5", "6+"]), "survey": F.coalesce(cut(F.col("SurveyStarRating"), [-INF, 2, 3, 4, INF], ["1-2", "3", "4", "5+"]), F.lit("none"))})
    return t.stage("return_base", build)


_B = f"""(SELECT *, CAST(coalesce(nxt <= least(event_date + 456, {_CUT}), false) AS INTEGER) AS ret, CAST(coalesce(nxt30 <= least(event_date + 456, {_CUT}), false) AS INTEGER) AS ret30, year(event_date) AS year, coalesce(ShortVehicleModelGroupTreated, 'none') AS gen,
 CASE WHEN maint_number <= 0 THEN NULL WHEN maint_number <= 1 THEN '1' WHEN maint_number <= 2 THEN '2' WHEN maint_number <= 3 THEN '3' WHEN maint_number <= 5 THEN '4-5' WHEN maint_number > 5 THEN '6+' END AS number_bin,
 CASE WHEN SurveyStarRating <= 2 THEN '1-2' WHEN SurveyStarRating <= 3 THEN '3' WHEN SurveyStarRating <= 4 THEN '4' WHEN SurveyStarRating > 4 THEN '5+' ELSE 'none' END AS survey
FROM (SELECT b.*, (SELECT min(event_date) FROM visits x WHERE x.vehicle_id = b.vehicle_id AND x.is_completed_maintenance AND x.event_date > b.event_date) AS nxt,
 (SELECT min(event_date) FROM visits x WHERE x.vehicle_id = b.vehicle_id AND x.is_completed_maintenance AND x.event_date >= b.event_date + 30) AS nxt30 FROM visits b WHERE is_completed_maintenance AND event_date BETWEEN DATE '1995-01-01' AND DATE '1999-11-30'))"""
query("return_proxy", "month t, n i, ret d, ret30 d, under_30 i", f"SELECT date_trunc('month', event_date) AS month, count(*) AS n, avg(ret) AS ret, avg(ret30) AS ret30, count(*) FILTER (WHERE nxt - event_date < 30) AS under_30 FROM {_B} GROUP BY 1", "visits")(
    lambda t: base(t).groupBy(F.trunc("event_date", "month").alias("month")).agg(one().alias("n"), F.avg("ret").alias("ret"), F.avg("ret30").alias("ret30"), count_if(F.datediff("nxt", "event_date") < 30).alias("under_30")))
_RT = "level s, n i, rate d, lift d, diff_pp d, share d"
_RTS = "SELECT level, n, s / n AS rate, (s / n) / (sum(s) OVER () / sum(n) OVER ()) AS lift, 100 * (s / n - sum(s) OVER () / sum(n) OVER ()) AS diff_pp, n / sum(n) OVER () AS share FROM (SELECT coalesce(CAST({c} AS VARCHAR), '(nulo)') AS level, count(*) AS n, sum(ret) AS s FROM {b} GROUP BY 1)"
for _n, _c in {"rate_table_channel": "ScheduleSource", "rate_table_number": "number_bin", "rate_table_survey": "survey", "rate_table_generation": "gen", "rate_table_pickup": "has_pud", "rate_table_mobile": "has_mobile", "rate_table_fixed_price": "has_fixed_price",
               "rate_table_waiting": "CustomerWaiting"}.items():
    query(_n, _RT, _RTS.format(c=_c, b=_B), "visits")(lambda t, c=_c: st.rate_table(base(t), c, "ret"))
query("strat_table", "stratum s, level s, n i, rate d", f"SELECT number_bin AS stratum, ScheduleSource AS level, count(*) AS n, avg(ret) AS rate FROM {_B} GROUP BY 1, 2 HAVING count(*) >= 50".replace("number_bin AS stratum", "coalesce(number_bin, '(nulo)') AS stratum"), "visits")(
    lambda t: st.strat_table(base(t), "ScheduleSource", "number_bin", "ret", 50))


def _weighted_gap(t: Tables):
    """Fixed-price effect: crude difference and difference weighted by stratum size."""
    b = base(t)
    p, q = F.avg(F.when(F.col("has_fixed_price"), F.col("ret"))), F.avg(F.when(~F.col("has_fixed_price"), F.col("ret")))
    g = b.groupBy(F.coalesce("number_bin", F.lit("none")).alias("s")).agg(one().alias("n"), (p - q).alias("d")).where(F.col("d").isNotNull())
    return g.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("weighted"), F.count(F.lit(1)).alias("strata")).withColumn("crude", b.agg((p - q).alias("c")).scalar())


query("stratified_difference", "weighted d, strata i, crude d", f"""SELECT sum(d * n) / sum(n) AS weighted, count(*) AS strata, (SELECT avg(ret) FILTER (WHERE has_fixed_price) - avg(ret) FILTER (WHERE NOT has_fixed_price) FROM {_B}) AS crude FROM (SELECT coalesce(number_bin, 'none') AS s, count(*) AS n,
 avg(ret) FILTER (WHERE has_fixed_price) - avg(ret) FILTER (WHERE NOT has_fixed_price) AS d FROM {_B} GROUP BY 1) WHERE d IS NOT NULL""", "visits")(_weighted_gap)
_IVF = {"channel": "ScheduleSource", "number": "number_bin", "survey": "survey", "generation": "gen", "pickup": "has_pud", "mobile": "has_mobile", "fixed_price": "has_fixed_price", "waiting": "CustomerWaiting", "model_year": "ModelYear", "dealer": "dealer_id"}
query("information_value", "feature s, iv d, levels i", f"WITH b AS (SELECT * FROM {_B}), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, coalesce(CAST({v} AS VARCHAR), '(nulo)') AS level, ret FROM b" for k, v in _IVF.items())
      + """) SELECT feature, sum((pr - pc) * ln(pr / pc)) AS iv, count(*) AS levels FROM (SELECT feature, (p + 5e-1) / sum(p + 5e-1) OVER (PARTITION BY feature) AS pr, (q + 5e-1) / sum(q + 5e-1) OVER (PARTITION BY feature) AS pc
 FROM (SELECT feature, level, sum(ret) AS p, sum(1 - ret) AS q FROM l GROUP BY 1, 2)) GROUP BY 1""", "visits")(lambda t: st.information_value(base(t), {k: F.col(v) for k, v in _IVF.items()}, "ret"))
_RANK_MIN = 50      # rows that a level needs to be named best or worst


def _ranking(t: Tables):
    """Features by information value, with the level of highest and of lowest return among those with enough rows."""
    b, named = base(t), {k: F.col(v).cast("string") for k, v in _IVF.items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(c, F.lit("(nulo)")).alias("level")) for k, c in named.items()])
    levels = b.select("ret", F.explode(pairs).alias("f")).groupBy("f.feature", "f.level").agg(one().alias("n"), F.avg("ret").alias("rate")).where(F.col("n") >= _RANK_MIN)
    ends = levels.groupBy("feature").agg(F.max("rate").alias("best_rate"), F.min("rate").alias("worst_rate"), one().alias("levels_shown"))
    return st.information_value(b, {k: F.col(v) for k, v in _IVF.items()}, "ret").join(ends, "feature", "left").withColumn("spread_pp", 100 * (F.col("best_rate") - F.col("worst_rate")))


query("feature_ranking", "feature s, iv d, levels i, levels_shown i, best_rate d, worst_rate d, spread_pp d", f"WITH b AS (SELECT * FROM {_B}), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, coalesce(CAST({v} AS VARCHAR), '(nulo)') AS level, ret FROM b" for k, v in _IVF.items())
      + f"""), g AS (SELECT feature, level, count(*) AS n, sum(ret) AS p, sum(1 - ret) AS q FROM l GROUP BY 1, 2), s AS (SELECT *, (p + 5e-1) / sum(p + 5e-1) OVER (PARTITION BY feature) AS pr, (q + 5e-1) / sum(q + 5e-1) OVER (PARTITION BY feature) AS pc FROM g)
 SELECT feature, sum((pr - pc) * ln(pr / pc)) AS iv, count(*) AS levels, nullif(count(*) FILTER (WHERE n >= {_RANK_MIN}), 0) AS levels_shown, max(p / n) FILTER (WHERE n >= {_RANK_MIN}) AS best_rate, min(p / n) FILTER (WHERE n >= {_RANK_MIN}) AS worst_rate,
 100 * (max(p / n) FILTER (WHERE n >= {_RANK_MIN}) - min(p / n) FILTER (WHERE n >= {_RANK_MIN})) AS spread_pp FROM s GROUP BY 1""", "visits")(_ranking)
query("channel_mix_by_month", "month t, ScheduleSource s, n i, share d", "SELECT date_trunc('month', event_date) AS month, ScheduleSource, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY date_trunc('month', event_date)) AS share FROM visits GROUP BY 1, 2", "visits")(
    lambda t: st.value_shares(t.visits().select(F.trunc("event_date", "month").alias("month"), "ScheduleSource"), ["month"], "ScheduleSource"))
query("channel_outcome", "ScheduleSource s, StatusARG s, n i, share d", "SELECT ScheduleSource, StatusARG, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY ScheduleSource) AS share FROM visits GROUP BY 1, 2", "visits")(
    lambda t: st.value_shares(t.visits(), ["ScheduleSource"], "StatusARG"))
query("outcome_rates_by_year", "year i, n i, done d, no_show d, cancel_hard d, cancel_resched d, last_done d", f"""SELECT year(event_date) AS year, count(*) AS n, avg(CAST(completed AS INTEGER)) AS done, avg(CAST(no_show AS INTEGER)) AS no_show, avg(CAST(cancelled AND coalesce(IsReschedule = 'N', false) AS INTEGER)) AS cancel_hard,
 avg(CAST(cancelled AND coalesce(IsReschedule = 'Y', false) AS INTEGER)) AS cancel_resched, avg(CAST(completed AS INTEGER)) FILTER (WHERE NOT pending) AS last_done FROM visits WHERE event_date <= {_CUT} GROUP BY 1""", "visits")(
    lambda t: t.visits().where(F.col("event_date") <= F.lit(SPAN.cutoff)).groupBy(F.year("event_date").alias("year")).agg(
        one().alias("n"), share(F.col("completed")).alias("done"), share(F.col("no_show")).alias("no_show"), share(F.col("cancelled") & (F.col("IsReschedule") == "N")).alias("cancel_hard"),
        share(F.col("cancelled") & (F.col("IsReschedule") == "Y")).alias("cancel_resched"), F.avg(F.when(~F.col("pending"), F.col("completed").cast("double"))).alias("last_done")))


# ---------------------------------------------------------------------------------- dealers
def dealer_rates(t: Tables):
    return base(t).where(F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(one().alias("n"), F.avg("ret").alias("ret"))


def _gini(t: Tables):
    """Gini of dealer volume from running totals over the distinct volumes."""
    d = t.visits().where(F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(one().alias("v"))
    steps = d.groupBy("v").agg(one().alias("k")).withColumn("vol", F.col("v") * F.col("k"))
    r = running_totals(steps, [F.col("v").asc()], {"k": "cum_k"})
    # ranks cum_k-k+1 .. cum_k all carry volume v
    weighted = F.sum(F.col("v") * (F.col("k") * (F.col("cum_k") - F.col("k")) + F.col("k") * (F.col("k") + 1) / 2))
    g = r.agg(weighted.alias("w"), F.sum("vol").alias("tot"), F.sum("k").alias("n"), F.max("v").alias("top"))
    return g.select(F.col("n").alias("dealers"), (2 * F.col("w") / (F.col("n") * F.col("tot")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (F.col("top") / F.col("tot")).alias("top_share"))


query("gini_volume", "dealers i, gini d, top_share d", """SELECT count(*) AS dealers, 2 * sum(rk * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) AS gini, max(v) / sum(v) AS top_share FROM (SELECT v, row_number() OVER (ORDER BY v) AS rk FROM (
 SELECT count(*) AS v FROM visits WHERE dealer_id IS NOT NULL GROUP BY dealer_id))""", "visits")(_gini)
query("lorenz_curve", "dealer_id s, v i, cum_share d", """SELECT dealer_id, v, sum(v) OVER (ORDER BY v DESC, dealer_id) / sum(v) OVER () AS cum_share FROM (SELECT dealer_id, count(*) AS v FROM visits WHERE dealer_id IS NOT NULL GROUP BY 1)""", "visits")(
    lambda t: (lambda d: running_totals(d, [F.col("v").desc(), F.col("dealer_id").asc()], {"v": "c"}).select("dealer_id", "v", (F.col("c") / d.agg(F.sum("v").alias("s")).scalar()).alias("cum_share")))(
        t.visits().where(F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(one().alias("v"))))


def _stability(t: Tables):
    y = base(t).where(F.col("dealer_id").isNotNull() & F.col("year").isin(1997, 1998)).groupBy("dealer_id").agg(
        *[F.count(F.when(F.col("year") == v, 1)).alias(f"n{v}") for v in (1997, 1998)], *[F.avg(F.when(F.col("year") == v, F.col("ret"))).alias(f"r{v}") for v in (1997, 1998)])
    y = y.where("n1997 >= 20 AND n1998 >= 20")
    return y.agg(one().alias("dealers"), F.corr("r1997", "r1998").alias("pearson"))


query("dealer_stability", "dealers i, pearson d", f"""SELECT count(*) AS dealers, corr(a, b) AS pearson FROM (SELECT avg(ret) FILTER (WHERE year = 1997) AS a, avg(ret) FILTER (WHERE year = 1998) AS b FROM {_B} WHERE dealer_id IS NOT NULL GROUP BY dealer_id
 HAVING count(*) FILTER (WHERE year = 1997) >= 20 AND count(*) FILTER (WHERE year = 1998) >= 20)""", "visits")(_stability)


def _noise(t: Tables):
    """Observed spread of dealer rates against what binomial noise alone would give."""
    d = dealer_rates(t).where("n >= 30")
    p = base(t).agg(F.avg("ret").alias("p")).scalar()
    return d.withColumn("p", p).agg(one().alias("dealers"), F.stddev_samp("ret").alias("sd"), F.sqrt(F.avg(F.col("p") * (1 - F.col("p")) / F.col("n"))).alias("sd_noise")).withColumn("ratio", F.col("sd") / F.col("sd_noise"))


query("dealer_binomial_noise", "dealers i, sd d, sd_noise d, ratio d", f"""SELECT count(*) AS dealers, stddev_samp(r) AS sd, sqrt(avg(p * (1 - p) / n)) AS sd_noise, stddev_samp(r) / sqrt(avg(p * (1 - p) / n)) AS ratio FROM (SELECT count(*) AS n, avg(ret) AS r, (SELECT avg(ret) FROM {_B}) AS p FROM {_B} WHERE dealer_id IS NOT NULL
 GROUP BY dealer_id HAVING count(*) >= 30)""", "visits")(_noise)


def _residual(t: Tables):
    """Dealer rate minus the rate expected from its generation x model-year mix."""
    b = base(t).where(F.col("dealer_id").isNotNull())
    mix = base(t).groupBy("gen", "ModelYear").agg(F.avg("ret").alias("expected"))
    j = b.join(mix, b.gen.eqNullSafe(mix.gen) & b.ModelYear.eqNullSafe(mix.ModelYear), "left").select(b.dealer_id, b.ret, "expected")
    g = j.groupBy("dealer_id").agg(one().alias("n"), F.avg("ret").alias("observed"), F.avg("expected").alias("expected")).where("n >= 30")
    return g.withColumn("resid_pp", 100 * (F.col("observed") - F.col("expected")))


_RES = f"""(SELECT dealer_id, count(*) AS n, avg(ret) AS observed, avg(e) AS expected, 100 * (avg(ret) - avg(e)) AS resid_pp FROM (SELECT *, avg(ret) OVER (PARTITION BY gen, ModelYear) AS e FROM {_B}) WHERE dealer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)"""
query("dealer_mix_residual", "dealer_id s, n i, observed d, expected d, resid_pp d", f"SELECT * FROM {_RES}", "visits")(_residual)
query("dealer_extremes", "side s, dealer_id s, resid_pp d", f"(SELECT 'low' AS side, dealer_id, resid_pp FROM {_RES} ORDER BY resid_pp, dealer_id LIMIT 5) UNION ALL (SELECT 'high', dealer_id, resid_pp FROM {_RES} ORDER BY resid_pp DESC, dealer_id LIMIT 5)", "visits")(
    lambda t: (lambda r: r.orderBy("resid_pp", "dealer_id").limit(5).withColumn("side", F.lit("low")).unionByName(r.orderBy(F.col("resid_pp").desc(), "dealer_id").limit(5).withColumn("side", F.lit("high"))))(_residual(t)))


def _encoding(t: Tables):
    """Dealers in quintiles of their 1997 return, read on the 1998 visits."""
    te = base(t).where((F.col("year") == 1997) & F.col("dealer_id").isNotNull()).groupBy("dealer_id").agg(one().alias("n97"), F.avg("ret").alias("r97")).where("n97 >= 20")
    r = number_rows(te, [F.col("r97").asc(), F.col("dealer_id").asc()], "rk")
    r = r.withColumn("q", equal_count_bin(F.col("rk"), r.agg(one().alias("c")).scalar(), 5) + 1)
    b = base(t).where("year = 1998").join(r.select("dealer_id", "q"), "dealer_id", "left")
    return b.groupBy("q").agg(one().alias("n"), F.avg("ret").alias("ret"))


query("target_encoding_quintiles", "q i, n i, ret d", f"""SELECT q, count(*) AS n, avg(ret) AS ret FROM (SELECT * FROM {_B} WHERE year = 1998) b LEFT JOIN (SELECT dealer_id, greatest(CAST(ceil((rk - 1) * 5 / (c - 1)) AS BIGINT) - 1, 0) + 1 AS q FROM (SELECT *, row_number() OVER (ORDER BY r, dealer_id) AS rk,
 count(*) OVER () AS c FROM (SELECT dealer_id, avg(ret) AS r FROM {_B} WHERE year = 1997 AND dealer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 20))) q USING (dealer_id) GROUP BY 1""", "visits")(_encoding)


_EVEN = tuple("02468ace")


def _split_half(t: Tables):
    """Reliability of dealer rates between two disjoint halves of the vehicles."""
    half = F.md5("vehicle_id").substr(1, 1).isin(*_EVEN).cast("int").alias("half")
    b = base(t).where(F.col("dealer_id").isNotNull()).select("dealer_id", "ret", half)
    g = b.groupBy("dealer_id").agg(F.count(F.when(F.col("half") == 0, 1)).alias("n0"), F.count(F.when(F.col("half") == 1, 1)).alias("n1"), F.avg(F.when(F.col("half") == 0, F.col("ret"))).alias("a"),
                                   F.avg(F.when(F.col("half") == 1, F.col("ret"))).alias("b"))
    return g.where("n0 >= 15 AND n1 >= 15").agg(one().alias("dealers"), F.corr("a", "b").alias("pearson"))


query("dealer_split_half", "dealers i, pearson d", f"""SELECT count(*) AS dealers, corr(a, b) AS pearson FROM (SELECT dealer_id, avg(ret) FILTER (WHERE NOT h) AS a, avg(ret) FILTER (WHERE h) AS b FROM
 (SELECT dealer_id, ret, left(md5(vehicle_id), 1) IN ({', '.join(f"'{x}'" for x in _EVEN)}) AS h FROM {_B} WHERE dealer_id IS NOT NULL) GROUP BY 1 HAVING count(*) FILTER (WHERE h) >= 15 AND count(*) FILTER (WHERE NOT h) >= 15)""", "visits")(_split_half)


def _same_dealer(t: Tables):
    nxt = t.maint().select("vehicle_id", F.col("event_date").alias("nxt"), F.col("dealer_id").alias("next_dealer"))
    j = base(t).where("ret = 1").join(nxt, ["vehicle_id", "nxt"], "left")
    return j.groupBy("ScheduleSource").agg(one().alias("n"), share(F.col("next_dealer") == F.col("dealer_id")).alias("same"))


query("same_dealer_return", "ScheduleSource s, n i, same d", f"""SELECT ScheduleSource, count(*) AS n, avg(CAST(coalesce(m.dealer_id = b.dealer_id, false) AS INTEGER)) AS same FROM {_B} b LEFT JOIN maint m ON m.vehicle_id = b.vehicle_id AND m.event_date = b.nxt WHERE ret = 1 GROUP BY 1""", "visits maint")(_same_dealer)


def _true_cancel():
    return F.col("cancelled") & (F.col("IsReschedule") == "N")


#: The ten counters of a booking's prior history.
_COUNTERS = {
    "prev_no_show": (lambda: F.col("no_show"), "no_show"), "prev_cancel_true": (_true_cancel, "cancelled AND IsReschedule = 'N'"),
    "prev_cancel_resched": (lambda: F.col("cancelled") & (F.col("IsReschedule") == "Y"), "cancelled AND IsReschedule = 'Y'"),
    "prev_diag": (lambda: F.col("completed") & F.col("has_diag"), "completed AND has_diag"), "prev_repair": (lambda: F.col("completed") & F.col("has_repair"), "completed AND has_repair"),
    "prev_recall": (lambda: F.col("completed") & F.col("has_recall"), "completed AND has_recall"), "prev_return_visit": (lambda: F.col("ScheduleReturn") == "Y", "ScheduleReturn = 'Y'"),
    "prev_maint": (lambda: F.col("is_completed_maintenance"), "is_completed_maintenance"), "prev_digital": (lambda: F.col("ScheduleSource").isin("FordPass", "WEB", "Mobile"), "ScheduleSource IN ('FordPass', 'WEB', 'Mobile')"),
    "prev_turnos": (lambda: F.lit(True), "true"),
}
#: Last days by kind: of any booking, maintenance, completed visit and no-show.
_RECENT = {"days_since_prev": (lambda: F.lit(True), "true"), "days_since_prev_maint": (lambda: F.col("is_completed_maintenance"), "is_completed_maintenance"), "days_since_prev_done": (lambda: F.col("completed"), "completed"),
           "days_since_prev_no_show": (lambda: F.col("no_show"), "no_show")}


def prior_history(t: Tables):
    """Exclusive history of each booking: ten counters, and days since the last booking of four kinds."""
    def build():
        v = t.visits().select("schedule_id", "vehicle_id", "event_date", "no_show", "cancelled", "completed", "is_completed_maintenance", "IsReschedule", "ScheduleReturn", "ScheduleSource", "has_diag", "has_repair", "has_recall")
        c = counts_before(v, "vehicle_id", "event_date", "schedule_id", {k: f() for k, (f, _) in _COUNTERS.items()}, {f"__d_{k}": F.when(f(), F.col("event_date")) for k, (f, _) in _RECENT.items()})
        return c.select("schedule_id", *_COUNTERS, *[F.datediff("event_date", f"__d_{k}").alias(k) for k in _RECENT])
    return t.stage("prior_history", build)


_PRIOR = ("(SELECT schedule_id, " + ", ".join(f"count(*) FILTER (WHERE {c}) OVER w AS {k}" for k, (_, c) in _COUNTERS.items()) + ", "
          + ", ".join(f"event_date - max(event_date) FILTER (WHERE {c}) OVER w AS {k}" for k, (_, c) in _RECENT.items())
          + " FROM visits WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
query("exclusive_history", "schedule_id s, " + ", ".join(f"{k} i" for k in [*_COUNTERS, *_RECENT]), f"SELECT * FROM {_PRIOR}", "visits")(prior_history)
_REC_BINS, _REC_NAMES = [-INF, 30, 90, 180, 365, INF], ["0-30", "31-90", "91-180", "181-365", ">365"]


def _recency(c: str):
    return F.coalesce(cut(F.col(c), _REC_BINS, _REC_NAMES), F.lit("none"))


def history_base(t: Tables):
    """The return base with each visit's prior history, counters in three bins and recencies in five."""
    few = lambda c: F.when(F.col(c) == 0, "0").when(F.col(c) == 1, "1").otherwise("2+")
    h = prior_history(t).select("schedule_id", *[few(k).alias(k.replace("prev_", "b_")) for k in _COUNTERS], _recency("days_since_prev").alias("rec"), _recency("days_since_prev_maint").alias("recm"),
                                _recency("days_since_prev_done").alias("recd"), _recency("days_since_prev_no_show").alias("recn"), "prev_turnos", "prev_no_show")
    return base(t).join(h, "schedule_id")


_RECS = "CASE WHEN {c} <= 30 THEN '0-30' WHEN {c} <= 90 THEN '31-90' WHEN {c} <= 180 THEN '91-180' WHEN {c} <= 365 THEN '181-365' WHEN {c} > 365 THEN '>365' ELSE 'none' END"
_HB = (f"(SELECT b.*, " + ", ".join(f"CASE WHEN {k} = 0 THEN '0' WHEN {k} = 1 THEN '1' ELSE '2+' END AS {k.replace('prev_', 'b_')}" for k in _COUNTERS) + ", "
       + ", ".join(f"{_RECS.format(c=c)} AS {a}" for a, c in {"rec": "days_since_prev", "recm": "days_since_prev_maint", "recd": "days_since_prev_done", "recn": "days_since_prev_no_show"}.items())
       + f", prev_turnos, prev_no_show FROM {_B} b JOIN {_PRIOR} h USING (schedule_id))")
_HIST_FEATURES = [*[k.replace("prev_", "b_") for k in _COUNTERS], "rec", "recm", "recd", "recn"]
query("return_by_history_level", "feature s, level s, n i, rate d", f"WITH b AS (SELECT * FROM {_HB}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, count(*) AS n, avg(ret) AS rate FROM b GROUP BY 2" for c in _HIST_FEATURES), "visits")(
    lambda t: history_base(t).select("ret", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in _HIST_FEATURES])).alias("f")).groupBy("f.feature", "f.level").agg(one().alias("n"), F.avg("ret").alias("rate")))
query("history_information_value", "feature s, iv d, levels i", f"WITH b AS (SELECT * FROM {_HB}), l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS level, ret FROM b" for c in _HIST_FEATURES)
      + """) SELECT feature, sum((pr - pc) * ln(pr / pc)) AS iv, count(*) AS levels FROM (SELECT feature, (p + 5e-1) / sum(p + 5e-1) OVER (PARTITION BY feature) AS pr, (q + 5e-1) / sum(q + 5e-1) OVER (PARTITION BY feature) AS pc
 FROM (SELECT feature, level, sum(ret) AS p, sum(1 - ret) AS q FROM l GROUP BY 1, 2)) GROUP BY 1""", "visits")(lambda t: st.information_value(history_base(t), {c: F.col(c) for c in _HIST_FEATURES}, "ret"))
query("no_show_within_intensity", "b_turnos s, had_no_show b, n i, rate d", f"SELECT b_turnos, prev_no_show > 0 AS had_no_show, count(*) AS n, avg(ret) AS rate FROM {_HB} WHERE prev_turnos >= 1 GROUP BY 1, 2", "visits")(
    lambda t: history_base(t).where("prev_turnos >= 1").groupBy("b_turnos", (F.col("prev_no_show") > 0).alias("had_no_show")).agg(one().alias("n"), F.avg("ret").alias("rate")))
query("no_show_to_base_days", "n i, median d, p25 d, p75 d, within_30 d", f"""SELECT count(d) AS n, median(d) AS median, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.75) AS p75, avg(CAST(d <= 30 AS INTEGER)) AS within_30
 FROM (SELECT days_since_prev_no_show AS d FROM {_B} b JOIN {_PRIOR} h USING (schedule_id))""", "visits")(
    lambda t: base(t).select("schedule_id").join(prior_history(t), "schedule_id").agg(F.count("days_since_prev_no_show").alias("n"), *[F.percentile("days_since_prev_no_show", F.lit(q)).alias(a) for a, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))],
                                                                                     F.avg((F.col("days_since_prev_no_show") <= 30).cast("double")).alias("within_30")))
query("return_by_prior_history", "stratum s, level s, n i, rate d", f"""SELECT CASE WHEN pv > 5 THEN 'high' WHEN pv > 0 THEN 'low' ELSE 'none' END AS stratum, CASE WHEN pn > 0 THEN 'yes' ELSE 'no' END AS level, count(*) AS n, avg(ret) AS rate FROM {_B} b JOIN (SELECT schedule_id,
 coalesce(sum(CAST(no_show AS INTEGER)) OVER w, 0) AS pn, count(*) OVER w AS pv FROM visits WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h USING (schedule_id) GROUP BY 1, 2""", "visits")(
    lambda t: st.strat_table(base(t).join(prior_history(t).select("schedule_id", "prev_no_show", "prev_turnos"), "schedule_id"), F.when(F.col("prev_no_show") > 0, "yes").otherwise("no"),
                             F.when(F.col("prev_turnos") > 5, "high").when(F.col("prev_turnos") > 0, "low").otherwise("none"), "ret"))
