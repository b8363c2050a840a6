"""Vehicle universe, life-year retention, return horizons, cohorts and recurrence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reprise.functions.columns import INF, count_if, cut, share, whole_months
from reprise.operators import cohorts as co, stats as st
from reprise.plans.domain import SPAN, Tables
from reprise.plans.registry import query

one = lambda: F.count(F.lit(1))
LAST_INDEX = dt.date(1999, 11, 30)          # leaves 15 months of follow-up before the cut-off
_CUT, _START = "DATE '2001-02-28'", "DATE '1995-01-01'"


def universe(t: Tables):
    """Vehicles of either table; warranty taken from the agenda first."""
    return t.master().withColumns({
        "grp": F.when(F.col("in_agenda") & F.col("SalesDate").isNotNull(), F.lit("both")).when(F.col("in_agenda"), F.lit("agenda")).otherwise(F.lit("sales")),
        "wsd": F.coalesce("warranty_agenda", "warranty_sales"), "cohort": F.coalesce((F.year("SalesDate") == 1995), F.lit(False))})


_UNI = """SELECT *, CASE WHEN in_agenda AND SalesDate IS NOT NULL THEN 'both' WHEN in_agenda THEN 'agenda' ELSE 'sales' END AS grp,
 coalesce(warranty_agenda, warranty_sales) AS wsd, coalesce(year(SalesDate) = 1995, false) AS cohort FROM vm"""

query("eda_vehicle_universe", "grp s, vehicles i, with_warranty i, cohort i", f"SELECT grp, count(*) AS vehicles, count(wsd) AS with_warranty, count(*) FILTER (WHERE cohort) AS cohort FROM ({_UNI}) GROUP BY 1",
      "vm")(lambda t: universe(t).groupBy("grp").agg(one().alias("vehicles"), F.count("wsd").alias("with_warranty"), count_if(F.col("cohort")).alias("cohort")))
query("eda_universe_with_total", "grp s, vehicles i", f"SELECT coalesce(grp, 'total') AS grp, count(*) AS vehicles FROM ({_UNI}) GROUP BY ROLLUP (grp)", "vm")(
    lambda t: universe(t).rollup("grp").agg(one().alias("vehicles")).withColumn("grp", F.coalesce("grp", F.lit("total"))))
query("eda_cross_coverage", "year i, agenda i, agenda_unsold i, sold i, sold_unseen i", f"""SELECT year(wsd) AS year, count(*) FILTER (WHERE in_agenda) AS agenda, count(*) FILTER (WHERE grp = 'agenda') AS agenda_unsold,
 count(*) FILTER (WHERE grp <> 'agenda') AS sold, count(*) FILTER (WHERE grp = 'sales') AS sold_unseen FROM ({_UNI}) WHERE wsd IS NOT NULL GROUP BY 1""", "vm")(
    lambda t: universe(t).where(F.col("wsd").isNotNull()).groupBy(F.year("wsd").alias("year")).agg(
        count_if(F.col("in_agenda")).alias("agenda"), count_if(F.col("grp") == "agenda").alias("agenda_unsold"), count_if(F.col("grp") != "agenda").alias("sold"),
        count_if(F.col("grp") == "sales").alias("sold_unseen")))


def done_visits(t: Tables):
    return t.visits().where("completed").select("vehicle_id", "event_date")


def life(t: Tables):
    def build():
        u = universe(t).select("vehicle_id", "wsd", "grp", "generation", "person_type", "business_unit", "first_seen", "cohort")
        return co.life_year_flags(co.life_years(u, "wsd", SPAN.start, SPAN.cutoff), t.maint(), done_visits(t)).withColumn(
            "known_before", F.coalesce(F.col("first_seen") < F.col("start"), F.lit(False)))
    return t.stage("life_years", build)


_LIFE = f"""SELECT *, lag(maint) OVER (PARTITION BY vehicle_id ORDER BY k) AS lm, lag(k) OVER (PARTITION BY vehicle_id ORDER BY k) AS lk FROM (SELECT *, coalesce(first_seen < s, false) AS known_before,
 EXISTS (SELECT 1 FROM maint x WHERE x.vehicle_id = y.vehicle_id AND x.event_date >= s AND x.event_date < e) AS maint,
 EXISTS (SELECT 1 FROM visits x WHERE x.vehicle_id = y.vehicle_id AND x.completed AND x.event_date >= s AND x.event_date < e) AS visit
 FROM (SELECT *, CAST(wsd + to_months(CAST(12 * (k - 1) AS INTEGER)) AS DATE) AS s, CAST(wsd + to_months(CAST(12 * k AS INTEGER)) AS DATE) AS e FROM ({_UNI}), (SELECT unnest(range(1, CAST(date_diff('year', (SELECT min(wsd) FROM ({_UNI})), {_CUT}) + 2 AS BIGINT))) AS k) WHERE wsd IS NOT NULL) y
 WHERE s >= {_START} AND e <= {_CUT})"""
query("retention_life_year", "k i, n i, maint d, visit d, n_known i, maint_known d, n_cohort i, maint_cohort d", f"""SELECT k, count(*) AS n, avg(CAST(maint AS INTEGER)) AS maint, avg(CAST(visit AS INTEGER)) AS visit,
 count(*) FILTER (WHERE known_before) AS n_known, avg(CAST(maint AS INTEGER)) FILTER (WHERE known_before) AS maint_known, count(*) FILTER (WHERE cohort) AS n_cohort,
 avg(CAST(maint AS INTEGER)) FILTER (WHERE cohort) AS maint_cohort FROM ({_LIFE}) GROUP BY 1""", "maint visits vm")(
    lambda t: life(t).groupBy("k").agg(one().alias("n"), share(F.col("maint")).alias("maint"), share(F.col("visit")).alias("visit"), count_if(F.col("known_before")).alias("n_known"),
                                       F.avg(F.when(F.col("known_before"), F.col("maint").cast("double"))).alias("maint_known"), count_if(F.col("cohort")).alias("n_cohort"),
                                       F.avg(F.when(F.col("cohort"), F.col("maint").cast("double"))).alias("maint_cohort")))
query("retention_conditional", "k i, maint_prev b, n i, rate d", f"""SELECT k, lm AS maint_prev, count(*) AS n, avg(CAST(maint AS INTEGER)) AS rate FROM ({_LIFE}) WHERE lk = k - 1 GROUP BY 1, 2""", "maint visits vm")(
    lambda t: life(t).where(F.col("maint_prev").isNotNull()).groupBy("k", "maint_prev").agg(one().alias("n"), share(F.col("maint")).alias("rate")))


def _drops(t: Tables):
    from pyspark.sql import Window
    g = life(t).groupBy("k").agg(share(F.col("maint")).alias("rate"))
    w = Window.partitionBy(F.lit(0)).orderBy("k")              # at most twelve rows
    return g.select("k", "rate", (F.col("rate") - F.lag("rate").over(w)).alias("drop_pp"), F.try_divide(F.col("rate"), F.lag("rate").over(w)).alias("ratio"))


query("retention_drops", "k i, rate d, drop_pp d, ratio d", f"""SELECT k, rate, rate - lag(rate) OVER (ORDER BY k) AS drop_pp, rate / lag(rate) OVER (ORDER BY k) AS ratio FROM (
 SELECT k, avg(CAST(maint AS INTEGER)) AS rate FROM ({_LIFE}) GROUP BY 1)""", "maint visits vm")(_drops)
_GENS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
query("retention_pivot_generation", "k i, r1 d, n1 i, r2 d, n2 i, r3 d, n3 i", "SELECT k, " + ", ".join(
    f"avg(CAST(maint AS INTEGER)) FILTER (WHERE generation = '{g}') AS r{i + 1}, count(*) FILTER (WHERE generation = '{g}') AS n{i + 1}" for i, g in enumerate(_GENS)) + f" FROM ({_LIFE}) GROUP BY 1",
    "maint visits vm")(lambda t: life(t).withColumn("m", F.col("maint").cast("double")).groupBy("k").pivot("generation", _GENS).agg(F.avg("m").alias("r"), F.count("m").alias("n")).select(
        "k", *[c for i, g in enumerate(_GENS) for c in (F.col(f"{g}_r").alias(f"r{i + 1}"), F.coalesce(F.col(f"{g}_n"), F.lit(0)).alias(f"n{i + 1}"))]))
query("retention_by_group", "k i, grp s, n i, maint d, visit d", f"SELECT k, grp, count(*) AS n, avg(CAST(maint AS INTEGER)) AS maint, avg(CAST(visit AS INTEGER)) AS visit FROM ({_LIFE}) GROUP BY 1, 2", "maint visits vm")(
    lambda t: life(t).groupBy("k", "grp").agg(one().alias("n"), share(F.col("maint")).alias("maint"), share(F.col("visit")).alias("visit")))


def aged(t: Tables):
    m = t.maint().join(universe(t).select("vehicle_id", "wsd", "generation"), "vehicle_id", "left")
    return m.where(F.col("event_date") >= F.col("wsd")).withColumn("k", F.least(F.floor(whole_months(F.col("event_date"), F.col("wsd")) / 12) + 1, F.lit(12)))


_MB = "((year({b}) - year({a})) * 12 + month({b}) - month({a}) - CAST(day({b}) < day({a}) AS INTEGER))"
_AGED = f"SELECT *, least({_MB.format(a='wsd', b='event_date')} // 12 + 1, 12) AS k FROM maint JOIN ({_UNI}) u USING (vehicle_id) WHERE event_date >= wsd"
query("eda_km_by_life_year", "k i, n i, p25 d, p50 d, p75 d", f"SELECT k, count(km) AS n, quantile_cont(km, 0.25) AS p25, median(km) AS p50, quantile_cont(km, 0.75) AS p75 FROM ({_AGED}) GROUP BY 1 HAVING count(km) > 0",
      "maint vm")(lambda t: st.exact_percentiles(aged(t), ["k"], "km", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]))
query("eda_km_per_year_describe", "count i, mean d, std d, min d, max d, p50 d", f"""SELECT count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, median(x) AS p50
 FROM (SELECT km / greatest((event_date - wsd) / 365.25, 0.25) AS x FROM ({_AGED}))""", "maint vm")(
    lambda t: st.describe(aged(t).withColumn("x", F.col("km") / F.greatest(F.datediff("event_date", "wsd") / 365.25, F.lit(0.25))), [], "x", [0.5]))

_H = (3, 6, 9, 12, 15)


def index_events(t: Tables):
    def build():
        i = t.maint().where((F.col("event_date") >= F.lit(SPAN.start)) & (F.col("event_date") <= F.lit(LAST_INDEX))).withColumnRenamed("event_date", "start")
        i = i.join(universe(t).select("vehicle_id", "wsd", "generation", "grp"), "vehicle_id", "left")
        i = co.next_after(i, t.maint(), "next_maint")
        i = co.next_after(i, done_visits(t), "next_visit")
        return i.withColumns({"age_years": F.floor(whole_months(F.col("start"), F.col("wsd")) / 12),
                              **{f"m{h}": co.returned_by("next_maint", "start", h) for h in _H}, **{f"v{h}": co.returned_by("next_visit", "start", h) for h in (12, 15)}})
    return t.stage("index_events", build)


_IDX = f"""SELECT *, {", ".join(f"coalesce(next_maint <= CAST(s + INTERVAL {h} MONTH AS DATE), false) AS m{h}" for h in _H)},
 {", ".join(f"coalesce(next_visit <= CAST(s + INTERVAL {h} MONTH AS DATE), false) AS v{h}" for h in (12, 15))}, CAST(floor({_MB.format(a='wsd', b='s')} / 12) AS INTEGER) AS age_years
FROM (SELECT m.*, m.event_date AS s, u.wsd, u.generation, u.grp, (SELECT min(event_date) FROM maint x WHERE x.vehicle_id = m.vehicle_id AND x.event_date > m.event_date) AS next_maint,
 (SELECT min(event_date) FROM visits x WHERE x.vehicle_id = m.vehicle_id AND x.completed AND x.event_date > m.event_date) AS next_visit
 FROM maint m LEFT JOIN ({_UNI}) u ON u.vehicle_id = m.vehicle_id WHERE m.event_date >= {_START} AND m.event_date <= DATE '1999-11-30')"""
_FLAGS = [f"m{h}" for h in _H] + ["v12", "v15"]
_AVGS = ", ".join(f"avg(CAST({f} AS INTEGER)) AS {f}" for f in _FLAGS)
_SPEC = ", ".join(f"{f} d" for f in _FLAGS)
_shares = lambda: [share(F.col(f)).alias(f) for f in _FLAGS]
_ND = "maint visits vm"
query("base_rate_horizon", "n i, under_30 i, strict_12 d, " + _SPEC, f"""SELECT count(*) AS n, count(*) FILTER (WHERE next_maint - s < 30) AS under_30,
 avg(CAST(m12 AND next_maint - s >= 30 AS INTEGER)) AS strict_12, {_AVGS} FROM ({_IDX})""", _ND)(
    lambda t: index_events(t).agg(one().alias("n"), count_if(F.datediff("next_maint", "start") < 30).alias("under_30"),
                                  share(F.col("m12") & (F.datediff("next_maint", "start") >= 30)).alias("strict_12"), *_shares()))
_AGE_E, _AGE_L = [-1, 0, 1, 2, 3, INF], ["0", "1", "2", "3", "4+"]
query("base_rate_by_age", "age s, n i, " + _SPEC, f"SELECT CASE WHEN age_years > -1 AND age_years <= 3 THEN CAST(age_years AS VARCHAR) WHEN age_years > 3 THEN '4+' END AS age, count(*) AS n, {_AVGS} FROM ({_IDX}) GROUP BY 1", _ND)(
    lambda t: index_events(t).groupBy(cut(F.col("age_years"), _AGE_E, _AGE_L).alias("age")).agg(one().alias("n"), *_shares()))
query("base_rate_by_number", "maint_number d, n i, " + _SPEC, f"SELECT maint_number, count(*) AS n, {_AVGS} FROM ({_IDX}) GROUP BY 1", _ND)(
    lambda t: index_events(t).groupBy("maint_number").agg(one().alias("n"), *_shares()))
query("base_rate_by_generation", "generation s, n i, " + _SPEC, f"SELECT generation, count(*) AS n, {_AVGS} FROM ({_IDX}) GROUP BY 1", _ND)(
    lambda t: index_events(t).groupBy("generation").agg(one().alias("n"), *_shares()))
query("base_rate_age_by_number", "age_years i, maint_number d, n i, m15 d", f"SELECT age_years, maint_number, count(*) AS n, avg(CAST(m15 AS INTEGER)) AS m15 FROM ({_IDX}) GROUP BY 1, 2 HAVING count(*) >= 200", _ND)(
    lambda t: index_events(t).groupBy("age_years", "maint_number").agg(one().alias("n"), share(F.col("m15")).alias("m15")).where("n >= 200"))
query("base_rate_by_index_month", "month i, n i, m12 d, m15 d", f"SELECT month(s) AS month, count(*) AS n, avg(CAST(m12 AS INTEGER)) AS m12, avg(CAST(m15 AS INTEGER)) AS m15 FROM ({_IDX}) GROUP BY 1", _ND)(
    lambda t: index_events(t).groupBy(F.month("start").alias("month")).agg(one().alias("n"), share(F.col("m12")).alias("m12"), share(F.col("m15")).alias("m15")))


def _first_event_rate(t: Tables):
    from pyspark.sql import Window
    i = index_events(t).withColumn("rn", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("start")))
    return i.agg(one().alias("events"), share(F.col("m15")).alias("per_event"), F.sum((F.col("rn") == 1).cast("long")).alias("vehicles"), F.avg(F.when(F.col("rn") == 1, F.col("m15").cast("double"))).alias("per_vehicle"))


query("base_rate_event_vs_vehicle", "events i, per_event d, vehicles i, per_vehicle d", f"""SELECT count(*) AS events, avg(CAST(m15 AS INTEGER)) AS per_event, count(*) FILTER (WHERE rn = 1) AS vehicles,
 avg(CAST(m15 AS INTEGER)) FILTER (WHERE rn = 1) AS per_vehicle FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY s) AS rn FROM ({_IDX}))""", _ND)(_first_event_rate)


def _return_curve(t: Tables):
    """Monthly cumulative return from one count per whole month."""
    i = index_events(t)
    months = [F.struct(F.lit(h).alias("h"), share(F.col("next_maint") <= F.add_months("start", h)).alias("maint"), share(F.col("next_visit") <= F.add_months("start", h)).alias("visit")) for h in range(1, 16)]
    return i.agg(F.array(*months).alias("a")).select(F.explode("a").alias("x")).select("x.*")


query("return_curve_monthly", "h i, maint d, visit d", f"""SELECT h, avg(CAST(coalesce(next_maint <= CAST(s + to_months(CAST(h AS INTEGER)) AS DATE), false) AS INTEGER)) AS maint,
 avg(CAST(coalesce(next_visit <= CAST(s + to_months(CAST(h AS INTEGER)) AS DATE), false) AS INTEGER)) AS visit FROM ({_IDX}), (SELECT unnest(range(1, 16)) AS h) GROUP BY 1""", _ND)(_return_curve)
query("return_days_distribution", "n i, mean d, p10 d, p25 d, p50 d, p75 d, p90 d", f"""SELECT count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, median(x) AS p50, quantile_cont(x, 0.75) AS p75,
 quantile_cont(x, 0.9) AS p90 FROM (SELECT next_maint - s AS x FROM ({_IDX}) WHERE m15)""", _ND)(
    lambda t: st.day_percentiles(index_events(t).where("m15").withColumn("x", F.datediff("next_maint", "start")), [], "x", [.1, .25, .5, .75, .9]))


def cohort(t: Tables):
    def build():
        c = universe(t).where(F.col("cohort") & F.col("wsd").isNotNull() & (F.add_months("wsd", 18) <= F.lit(SPAN.cutoff))).withColumn("start", F.col("wsd"))
        c = co.next_after(c, t.maint(), "first_maint")
        c = co.next_after(c, t.maint().where(F.col("maint_number") == 2), "first_numbered")
        c = co.next_after(c, done_visits(t), "first_visit")
        return co.next_after(c, t.visits().select("vehicle_id", F.col("ScheduleDate").alias("event_date")), "first_booking")
    return t.stage("cohort_first", build)


_NX = "(SELECT min({d}) FROM {src} x WHERE x.vehicle_id = u.vehicle_id AND x.{d} > u.wsd {extra})"
_COH = f"""SELECT u.*, {_NX.format(d='event_date', src='maint', extra='')} AS first_maint, {_NX.format(d='event_date', src='maint', extra='AND x.maint_number = 2')} AS first_numbered,
 {_NX.format(d='event_date', src='visits', extra='AND x.completed')} AS first_visit, {_NX.format(d='ScheduleDate', src='visits', extra='')} AS first_booking
 FROM ({_UNI}) u WHERE cohort AND wsd IS NOT NULL AND CAST(wsd + INTERVAL 18 MONTH AS DATE) <= {_CUT}"""
_OUT = ["maint", "numbered", "visit", "booking"]


def _cohort_outcomes(t: Tables):
    rows = [F.struct(F.lit(h).alias("h"), *[share(F.col(f"first_{o}") <= F.add_months("wsd", h)).alias(o) for o in _OUT]) for h in (6, 9, 12, 15, 18)]
    return cohort(t).agg(one().alias("n"), F.array(*rows).alias("a")).select("n", F.explode("a").alias("x")).select("n", "x.*")


query("cohort_first_service", "n i, h i, maint d, numbered d, visit d, booking d", "SELECT count(*) AS n, h, " + ", ".join(
    f"avg(CAST(coalesce(first_{o} <= CAST(wsd + to_months(h) AS DATE), false) AS INTEGER)) AS {o}" for o in _OUT) + f" FROM ({_COH}), (SELECT unnest([6, 9, 12, 15, 18]) AS h) GROUP BY h", _ND)(_cohort_outcomes)
for _c in ("person_type", "business_unit", "sales_channel", "generation"):
    query(f"cohort_first_service_by_{_c}", f"{_c} s, n i, m12 d, m18 d, v18 d", f"SELECT {_c}, count(*) AS n, avg(CAST(coalesce(first_maint <= CAST(wsd + INTERVAL 12 MONTH AS DATE), false) AS INTEGER)) AS m12, "
          "avg(CAST(coalesce(first_maint <= CAST(wsd + INTERVAL 18 MONTH AS DATE), false) AS INTEGER)) AS m18, avg(CAST(coalesce(first_visit <= CAST(wsd + INTERVAL 18 MONTH AS DATE), false) AS INTEGER)) AS v18 "
          f"FROM ({_COH}) GROUP BY 1", _ND)(
        lambda t, c=_c: cohort(t).groupBy(c).agg(one().alias("n"), share(co.returned_by("first_maint", "wsd", 12)).alias("m12"), share(co.returned_by("first_maint", "wsd", 18)).alias("m18"),
                                                 share(co.returned_by("first_visit", "wsd", 18)).alias("v18")))


def all_cycles(t: Tables):
    def build():
        c = co.cycles(t.maint(), universe(t), "wsd", SPAN.start)
        c = co.next_after(c, t.maint(), "next_maint")
        return co.next_after(c, t.visits().where(F.col("completed") & ~F.col("has_maint")).select("vehicle_id", "event_date"), "next_other")
    return t.stage("cycles", build)


_CYC = f"""SELECT c.*, (SELECT min(event_date) FROM maint x WHERE x.vehicle_id = c.vehicle_id AND x.event_date > c.s) AS next_maint,
 (SELECT min(event_date) FROM visits x WHERE x.vehicle_id = c.vehicle_id AND x.completed AND NOT x.has_maint AND x.event_date > c.s) AS next_other FROM (
 SELECT vehicle_id, event_date AS s, customer_id AS cust_idx, 'maintenance' AS origin FROM maint UNION ALL SELECT vehicle_id, wsd, NULL, 'warranty' FROM ({_UNI}) WHERE wsd >= {_START}) c"""


def due_population(t: Tables):
    """Cycles reaching twelve months, and returns afterwards (null while follow-up is incomplete)."""
    d, cut_ = F.col("due12"), F.lit(SPAN.cutoff)
    c = all_cycles(t).withColumn("due12", F.add_months("start", 12)).where(d <= cut_).withColumn("open12", ~F.coalesce(F.col("next_maint") < d, F.lit(False)))
    return c.withColumns({f"back{h}": F.when(F.col("open12") & (F.add_months(d, h) <= cut_), F.coalesce(F.col("next_maint") <= F.add_months(d, h), F.lit(False)).cast("double")) for h in (1, 3, 6)})


_DUE = f"SELECT *, {', '.join(f'CASE WHEN open12 AND CAST(due12 + INTERVAL {h} MONTH AS DATE) <= {_CUT} THEN CAST(coalesce(next_maint <= CAST(due12 + INTERVAL {h} MONTH AS DATE), false) AS INTEGER) END AS back{h}' for h in (1, 3, 6))} FROM (" \
       f"SELECT *, NOT coalesce(next_maint < due12, false) AS open12 FROM (SELECT *, CAST(s + INTERVAL 12 MONTH AS DATE) AS due12 FROM ({_CYC})) WHERE due12 <= {_CUT})"
query("reach_12m_by_month", "month t, cycles i, open i, back1 d, back3 d, back6 d, vehicles i", f"""SELECT date_trunc('month', due12) AS month, count(*) AS cycles, count(*) FILTER (WHERE open12) AS open, avg(back1) AS back1, avg(back3) AS back3,
 avg(back6) AS back6, count(DISTINCT vehicle_id) FILTER (WHERE open12) AS vehicles FROM ({_DUE}) GROUP BY 1""", _ND)(
    lambda t: due_population(t).groupBy(F.trunc("due12", "month").alias("month")).agg(one().alias("cycles"), count_if(F.col("open12")).alias("open"), *[F.avg(f"back{h}").alias(f"back{h}") for h in (1, 3, 6)],
                                                                                   F.count_distinct(F.when(F.col("open12"), F.col("vehicle_id"))).alias("vehicles")))
query("reach_12m_by_origin", "origin s, cycles i, open d, back1 d, back3 d, back6 d", f"SELECT origin, count(*) AS cycles, avg(CAST(open12 AS INTEGER)) AS open, avg(back1) AS back1, avg(back3) AS back3, avg(back6) AS back6 FROM ({_DUE}) GROUP BY 1", _ND)(
    lambda t: due_population(t).groupBy("origin").agg(one().alias("cycles"), share(F.col("open12")).alias("open"), *[F.avg(f"back{h}").alias(f"back{h}") for h in (1, 3, 6)]))


def churned(t: Tables):
    c = all_cycles(t).withColumn("mark15", F.add_months("start", 15)).where((F.col("mark15") <= F.lit(SPAN.cutoff)) & (F.col("start") >= F.lit(SPAN.start)))
    c = c.withColumn("churn15", ~F.coalesce(F.col("next_maint") <= F.col("mark15"), F.lit(False)))
    return c.withColumns({"extra": whole_months(F.lit(SPAN.cutoff), F.col("mark15")), "back_after": whole_months(F.col("next_maint"), F.col("mark15"))})


_CHU = f"SELECT *, {_MB.format(a='mark15', b=_CUT)} AS extra, {_MB.format(a='mark15', b='next_maint')} AS back_after FROM (SELECT *, NOT coalesce(next_maint <= mark15, false) AS churn15 FROM (" \
       f"SELECT *, CAST(s + INTERVAL 15 MONTH AS DATE) AS mark15 FROM ({_CYC})) WHERE mark15 <= {_CUT} AND s >= {_START})"


def _recurrence(t: Tables):
    c = churned(t).where("churn15")
    rows = [F.struct(F.lit(h).alias("extra_months"), count_if(F.col("extra") >= h).alias("n"),
                     F.avg(F.when(F.col("extra") >= h, F.coalesce(F.col("back_after") < h, F.lit(False)).cast("double"))).alias("reappeared")) for h in (3, 6, 9, 12, 15)]
    return c.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")


query("recurrence_after_churn", "extra_months i, n i, reappeared d", f"""SELECT h AS extra_months, count(*) FILTER (WHERE extra >= h) AS n, avg(CAST(coalesce(back_after < h, false) AS INTEGER)) FILTER (WHERE extra >= h) AS reappeared
 FROM ({_CHU}), (SELECT unnest([3, 6, 9, 12, 15]) AS h) WHERE churn15 GROUP BY 1""", _ND)(_recurrence)
query("recurrence_by_origin", "origin s, churn15 b, n i, other_visit d", f"SELECT origin, churn15, count(*) AS n, avg(CAST(next_other IS NOT NULL AS INTEGER)) AS other_visit FROM ({_CHU}) GROUP BY 1, 2", _ND)(
    lambda t: churned(t).groupBy("origin", "churn15").agg(one().alias("n"), share(F.col("next_other").isNotNull()).alias("other_visit")))


def _owner_change(t: Tables):
    nxt = t.maint().select("vehicle_id", F.col("event_date").alias("next_maint"), F.col("customer_id").alias("cust_next"))
    r = churned(t).where((F.col("origin") == "maintenance") & F.col("next_maint").isNotNull()).join(nxt, ["vehicle_id", "next_maint"], "left")
    return r.groupBy("churn15").agg(one().alias("n"), share(F.col("cust_idx") != F.col("cust_next")).alias("owner_change"))


query("recurrence_owner_change", "churn15 b, n i, owner_change d", f"""SELECT churn15, count(*) AS n, avg(CAST(coalesce(cust_idx <> x.customer_id, false) AS INTEGER)) AS owner_change FROM ({_CHU}) c
 LEFT JOIN maint x ON x.vehicle_id = c.vehicle_id AND x.event_date = c.next_maint WHERE origin = 'maintenance' AND next_maint IS NOT NULL GROUP BY 1""", _ND)(_owner_change)


def _curve24(t: Tables):
    c = all_cycles(t).where((F.col("start") >= F.lit(SPAN.start)) & (F.add_months("start", 24) <= F.lit(SPAN.cutoff)))
    rows = [F.struct(F.lit(h).alias("h"), share(co.returned_by("next_maint", "start", h)).alias("rate")) for h in range(1, 25)]
    return c.groupBy("origin").agg(one().alias("n"), F.array(*rows).alias("a")).select("origin", "n", F.explode("a").alias("x")).select("origin", "n", "x.*")


query("return_curve_24m", "origin s, n i, h i, rate d", f"""SELECT origin, count(*) AS n, h, avg(CAST(coalesce(next_maint <= CAST(s + to_months(h) AS DATE), false) AS INTEGER)) AS rate FROM ({_CYC}), (SELECT unnest(range(1, 25)) AS h)
 WHERE s >= {_START} AND CAST(s + INTERVAL 24 MONTH AS DATE) <= {_CUT} GROUP BY 1, 3""", _ND)(_curve24)
