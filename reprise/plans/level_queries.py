"""Identity features against return: levels, crosses, age strata, clean return; dealer stability over replicate splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from reprise.functions.columns import INF, count_if, cut
from reprise.operators import cube as cb, difference as df_, features as ft, stats as st
from reprise.operators.asof import asof_join
from reprise.operators.history import previous_row, scan_before
from reprise.plans.channel_queries import _B, _HB, _HIST_FEATURES, _RANK_MIN, base, history_base
from reprise.plans.domain import Tables
from reprise.plans.identity_queries import _KN, _TR, identity_features, known, transfers
from reprise.plans.registry import query

one = lambda: F.count(F.lit(1))
_OUT = ["ret", "ret12"]
#: Rows that a level needs to enter a range.
RANGE_MIN = 50


def level_base(t: Tables):
    """The return base with as-of identity, dealer and sale attributes of each event, as levels."""
    def build():
        v = t.visits().select("schedule_id", "vehicle_id", "event_date", "dealer_id", "is_completed_maintenance")
        here = F.struct("dealer_id")
        p = scan_before(v, "vehicle_id", [F.col("event_date").alias("a"), F.col("schedule_id").alias("b")], last={"prev": here, "prev_m": F.when(F.col("is_completed_maintenance"), here)}).select("schedule_id", "prev", "prev_m")
        moved = transfers(t).select("vehicle_id", F.col("event_date").alias("moved"))
        b = base(t).select("schedule_id", "vehicle_id", "customer_id", "event_date", "dealer_id", "maint_number", "ret", "ret30", "nxt")
        b = asof_join(b, moved, "vehicle_id", "event_date", "moved", ["moved"], "backward", True)
        b = b.join(p, "schedule_id").join(identity_features(t).select("schedule_id", "owners_asof", "fleet_asof"), "schedule_id", "left")
        m = t.master().select("vehicle_id", "in_sales", "sales_customer_id", "sales_dealer_id", "business_unit", "person_type", "warranty_agenda")
        sold = t.sales().where(F.col("customer_id").isNotNull()).groupBy(F.col("customer_id").alias("sales_customer_id")).agg(F.count_distinct("vehicle_id").alias("bought"))
        b = b.join(m, "vehicle_id", "left").join(sold, "sales_customer_id", "left")
        fleet = lambda c: cut(F.col(c), [0, 1, 2, 9, INF], ["1", "2", "3-9", "10+"])
        changed = lambda c, first: F.when(F.col(c).isNull() | F.col(c)["dealer_id"].isNull(), first).when(~F.col(c)["dealer_id"].eqNullSafe(F.col("dealer_id")), "yes").otherwise("no")
        unsold = ~F.coalesce("in_sales", F.lit(False))
        return b.select("schedule_id", "ret", "ret30", F.coalesce(F.col("nxt") <= F.date_add("event_date", 365), F.lit(False)).cast("int").alias("ret12"), F.datediff("nxt", "event_date").alias("gap"),
                        F.when(unsold, "unsold").when(F.col("customer_id").eqNullSafe(F.col("sales_customer_id")), "yes").otherwise("no").alias("is_buyer"),
                        F.when(F.col("owners_asof") >= 3, "3+").otherwise(F.col("owners_asof").cast("string")).alias("owners"), fleet("fleet_asof").alias("fleet"), F.coalesce(fleet("bought"), F.lit("unsold")).alias("fleet_bought"),
                        F.when(unsold | F.col("sales_dealer_id").isNull(), "unsold").when(F.col("dealer_id").eqNullSafe(F.col("sales_dealer_id")), "yes").otherwise("no").alias("selling_dealer"),
                        changed("prev", "first").alias("dealer_change"), changed("prev_m", "first").alias("service_dealer_change"),
                        F.coalesce(cut(F.datediff("event_date", "moved") / 30.44, [-0.01, 3, 6, 12, 1000], ["0-3", "3-6", "6-12", "12+"]), F.lit("none")).alias("since_transfer"),
                        F.coalesce("business_unit", F.lit("unsold")).alias("business_unit"), F.coalesce("person_type", F.lit("unsold")).alias("person_type"),
                        F.when(F.col("maint_number").isNull(), "none").when(F.col("maint_number") >= 6, "6+").otherwise(F.col("maint_number").cast("int").cast("string")).alias("service"),
                        cut(F.datediff("event_date", "warranty_agenda") / 365.25, [-1, 2, 4, 100], ["<2", "2-4", "4+"]).alias("age"))
    return t.stage("level_base", build)


FEATURES = ["is_buyer", "owners", "fleet", "fleet_bought", "selling_dealer", "dealer_change", "service_dealer_change", "since_transfer", "business_unit", "person_type", "service"]
CROSSES = [("is_buyer", "person_type"), ("is_buyer", "business_unit"), ("fleet", "service"), ("selling_dealer", "service_dealer_change")]


def cube(t: Tables):
    return t.stage("identity_cube", lambda: cb.level_cube(level_base(t), {f: F.col(f) for f in FEATURES}, _OUT, F.col("age"), CROSSES))


_FLEET = "CASE WHEN {c} > 0 AND {c} <= 1 THEN '1' WHEN {c} <= 2 THEN '2' WHEN {c} <= 9 THEN '3-9' WHEN {c} > 9 THEN '10+' END"
_CHG = "CASE WHEN {c} IS NULL THEN 'first' WHEN {c} IS DISTINCT FROM dealer_id THEN 'yes' ELSE 'no' END"
_LB = f"""(SELECT schedule_id, ret, ret30, gap, CAST(coalesce(nxt <= event_date + 365, false) AS INTEGER) AS ret12, CASE WHEN NOT sold THEN 'unsold' WHEN customer_id IS NOT DISTINCT FROM sales_customer_id THEN 'yes' ELSE 'no' END AS is_buyer,
 CASE WHEN owners_asof >= 3 THEN '3+' ELSE CAST(owners_asof AS VARCHAR) END AS owners, {_FLEET.format(c='fleet_asof')} AS fleet, coalesce({_FLEET.format(c='bought')}, 'unsold') AS fleet_bought,
 CASE WHEN NOT sold OR sales_dealer_id IS NULL THEN 'unsold' WHEN dealer_id IS NOT DISTINCT FROM sales_dealer_id THEN 'yes' ELSE 'no' END AS selling_dealer, {_CHG.format(c='pd')} AS dealer_change, {_CHG.format(c='pmd')} AS service_dealer_change,
 CASE WHEN mo > -0.01 AND mo <= 3 THEN '0-3' WHEN mo <= 6 THEN '3-6' WHEN mo <= 12 THEN '6-12' WHEN mo <= 1000 THEN '12+' ELSE 'none' END AS since_transfer, coalesce(business_unit, 'unsold') AS business_unit, coalesce(person_type, 'unsold') AS person_type,
 CASE WHEN maint_number IS NULL THEN 'none' WHEN maint_number >= 6 THEN '6+' ELSE CAST(CAST(maint_number AS INTEGER) AS VARCHAR) END AS service, CASE WHEN ag > -1 AND ag <= 2 THEN '<2' WHEN ag > 2 AND ag <= 4 THEN '2-4' WHEN ag > 4 AND ag <= 100 THEN '4+' END AS age
FROM (SELECT b.*, nxt - b.event_date AS gap, coalesce(vm.in_sales, false) AS sold, vm.sales_customer_id, vm.sales_dealer_id, vm.business_unit, vm.person_type, (b.event_date - vm.warranty_agenda) / 365.25 AS ag, owners_asof, fleet_asof, bought, pd, pmd,
  (b.event_date - (SELECT max(x.event_date) FROM {_TR} x WHERE x.vehicle_id = b.vehicle_id AND x.event_date <= b.event_date)) / 30.44 AS mo
 FROM {_B} b LEFT JOIN vm ON vm.vehicle_id = b.vehicle_id
 LEFT JOIN (SELECT schedule_id, sum(CAST(np AS INTEGER)) OVER (PARTITION BY vehicle_id ORDER BY event_date, schedule_id) AS owners_asof, sum(CAST(np AS INTEGER)) OVER (PARTITION BY customer_id ORDER BY event_date, schedule_id) AS fleet_asof
  FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, customer_id ORDER BY event_date, schedule_id) = 1 AS np FROM {_KN})) i ON i.schedule_id = b.schedule_id
 LEFT JOIN (SELECT schedule_id, lag(dealer_id) OVER (PARTITION BY vehicle_id ORDER BY event_date, schedule_id) AS pd FROM visits) p ON p.schedule_id = b.schedule_id
 LEFT JOIN (SELECT schedule_id, lag(dealer_id) OVER (PARTITION BY vehicle_id ORDER BY event_date, schedule_id) AS pmd FROM visits WHERE is_completed_maintenance) q ON q.schedule_id = b.schedule_id
 LEFT JOIN (SELECT customer_id AS sc, count(DISTINCT vehicle_id) AS bought FROM sales WHERE customer_id IS NOT NULL GROUP BY 1) s ON s.sc = vm.sales_customer_id))"""
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce({f}, '(nulo)') AS level, age, ret, ret12, ret30 FROM b" for f in FEATURES) + ")"
query("identity_level_return", "feature s, level s, n i, ret_rate d, ret_lift d, ret12_rate d, ret12_lift d", f"""WITH b AS (SELECT * FROM {_LB}), {_LONG} SELECT feature, level, count(*) AS n, avg(ret) AS ret_rate, avg(ret) / (SELECT avg(ret) FROM b) AS ret_lift,
 avg(ret12) AS ret12_rate, avg(ret12) / (SELECT avg(ret12) FROM b) AS ret12_lift FROM l GROUP BY 1, 2""", "visits vm sales")(lambda t: cb.level_rates(cube(t), _OUT))
query("identity_level_range", "feature s, low d, high d, levels i, range_pp d", f"""WITH b AS (SELECT * FROM {_LB}), {_LONG} SELECT feature, min(r) AS low, max(r) AS high, count(*) AS levels, 100 * (max(r) - min(r)) AS range_pp
 FROM (SELECT feature, avg(ret) AS r FROM l GROUP BY feature, level HAVING count(*) >= {RANGE_MIN}) GROUP BY 1""", "visits vm sales")(lambda t: cb.rate_range(cube(t), "ret", RANGE_MIN))
query("identity_level_crosses", "feature s, level s, other s, other_level s, n i, rate d", f"WITH b AS (SELECT * FROM {_LB}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, coalesce({a}, '(nulo)') AS level, '{c}' AS other, coalesce({c}, '(nulo)') AS other_level, count(*) AS n, avg(ret) AS rate FROM b GROUP BY 2, 4" for a, c in CROSSES), "visits vm sales")(lambda t: cb.cross_rates(cube(t), "ret"))
query("identity_level_by_age", "feature s, level s, stratum s, n i, rate d", f"WITH b AS (SELECT * FROM {_LB}), {_LONG} SELECT feature, level, age AS stratum, count(*) AS n, avg(ret) AS rate FROM l WHERE age IS NOT NULL GROUP BY 1, 2, 3", "visits vm sales")(
    lambda t: cube(t).where("other is null and stratum is not null").select("feature", "level", "stratum", "n", (F.col("ret") / F.col("n")).alias("rate")))
query("identity_level_standardised", "feature s, level s, n i, crude d, standardised d, covered d", f"""WITH b AS (SELECT * FROM {_LB}), {_LONG}, c AS (SELECT feature, level, age, count(*) AS n, sum(ret) AS s FROM l WHERE age IS NOT NULL GROUP BY 1, 2, 3),
 w AS (SELECT feature, age, sum(n) AS w FROM c GROUP BY 1, 2) SELECT c.feature, level, sum(n) AS n, sum(s) / sum(n) AS crude, sum(w * s / n) / sum(w) AS standardised, sum(w) / (SELECT sum(w) FROM w x WHERE x.feature = c.feature) AS covered
 FROM c JOIN w ON w.feature = c.feature AND w.age = c.age GROUP BY c.feature, level""", "visits vm sales")(lambda t: cb.standardised_rates(cube(t), "ret"))
_CLEAN = ["is_buyer", "selling_dealer", "person_type", "business_unit"]
query("identity_clean_return", "feature s, level s, n i, ret d, clean d, gap_pp d", f"WITH b AS (SELECT * FROM {_LB}) " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS level, count(*) AS n, avg(ret) AS ret, avg(ret30) AS clean, 100 * (avg(ret) - avg(ret30)) AS gap_pp FROM b GROUP BY 2" for f in _CLEAN), "visits vm sales")(
    lambda t: cb.level_rates(cb.level_cube(level_base(t), {f: F.col(f) for f in _CLEAN}, ["ret", "ret30"]), ["ret", "ret30"]).select(
        "feature", "level", "n", F.col("ret_rate").alias("ret"), F.col("ret30_rate").alias("clean"), (100 * (F.col("ret_rate") - F.col("ret30_rate"))).alias("gap_pp")))
query("return_proxy_gaps", "events i, returns i, within_7 i, within_30 i, within_90 i", f"SELECT count(*) AS events, sum(ret) AS returns, count(*) FILTER (WHERE gap <= 7) AS within_7, count(*) FILTER (WHERE gap <= 30) AS within_30, count(*) FILTER (WHERE gap <= 90) AS within_90 FROM {_LB}", "visits vm sales")(
    lambda t: level_base(t).agg(one().alias("events"), F.sum("ret").alias("returns"), *[F.count(F.when(F.col("gap") <= d, 1)).alias(f"within_{d}") for d in (7, 30, 90)]))

# ---------------------------------------------------------------------------------- dealers over replicate splits
REPLICATES, HALF_MIN, YEAR_MIN = 32, 15, 20
_EVEN = ", ".join(f"'{x}'" for x in "02468ace")


def replicate_sums(t: Tables):
    """Per dealer, for every hash split of the vehicles, counts and returns of both halves: one array of sums, one pass."""
    b = base(t).where(F.col("dealer_id").isNotNull()).select("dealer_id", "ret", F.md5("vehicle_id").alias("h"))
    even = [F.col("h").substr(r + 1, 1).isin(*"02468ace") for r in range(REPLICATES)]
    part = lambda c: F.struct(F.count(F.when(c, 1)).alias("n1"), F.count(F.when(~c, 1)).alias("n0"), F.sum(F.when(c, F.col("ret")).otherwise(0)).alias("s1"), F.sum(F.when(~c, F.col("ret")).otherwise(0)).alias("s0"))
    return b.groupBy("dealer_id").agg(F.array(*[part(c) for c in even]).alias("parts"))


def _replicates(t: Tables):
    p = replicate_sums(t).select("dealer_id", F.posexplode("parts").alias("r", "p")).where((F.col("p.n0") >= HALF_MIN) & (F.col("p.n1") >= HALF_MIN))
    return p.groupBy("r").agg(one().alias("dealers"), F.corr(F.col("p.s0") / F.col("p.n0"), F.col("p.s1") / F.col("p.n1")).alias("pearson"))


_REP = f"""(SELECT r, count(*) AS dealers, corr(a, b) AS pearson FROM (SELECT dealer_id, r, avg(ret) FILTER (WHERE NOT e) AS a, avg(ret) FILTER (WHERE e) AS b FROM (SELECT dealer_id, ret, r, substr(md5(vehicle_id), r + 1, 1) IN ({_EVEN}) AS e
 FROM {_B}, (SELECT unnest(generate_series(0, {REPLICATES - 1})) AS r) WHERE dealer_id IS NOT NULL) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE e) >= {HALF_MIN} AND count(*) FILTER (WHERE NOT e) >= {HALF_MIN}) GROUP BY 1)"""
query("dealer_split_replicates", "r i, dealers i, pearson d", f"SELECT * FROM {_REP}", "visits")(_replicates)
query("dealer_split_distribution", "splits i, mean d, sd d, low d, median d, high d", f"SELECT count(pearson) AS splits, avg(pearson) AS mean, stddev_samp(pearson) AS sd, min(pearson) AS low, median(pearson) AS median, max(pearson) AS high FROM {_REP}", "visits")(
    lambda t: _replicates(t).agg(F.count("pearson").alias("splits"), F.avg("pearson").alias("mean"), F.stddev_samp("pearson").alias("sd"), F.min("pearson").alias("low"), F.median("pearson").alias("median"), F.max("pearson").alias("high")))


def _disjoint(t: Tables):
    """Dealer rates of 1997 against those of 1998 over vehicles without an event in 1997."""
    b = base(t)
    early = b.where("year = 1997").select("vehicle_id").distinct()
    a = b.where("year = 1997 and dealer_id is not null").groupBy("dealer_id").agg(one().alias("n0"), F.avg("ret").alias("r0"))
    c = b.where("year = 1998 and dealer_id is not null").join(early, "vehicle_id", "left_anti").groupBy("dealer_id").agg(one().alias("n1"), F.avg("ret").alias("r1"))
    j = a.join(c, "dealer_id").where((F.col("n0") >= YEAR_MIN) & (F.col("n1") >= YEAR_MIN // 2))
    return st.weighted_spearman(j, "r0", "r1").withColumnRenamed("n", "dealers").withColumn("pearson", j.agg(F.corr("r0", "r1").alias("c")).scalar())


_RANKS = "(SELECT count(*) AS dealers, corr(ra, rb) AS spearman, corr(r0, r1) AS pearson FROM (SELECT r0, r1, rank() OVER (ORDER BY r0) + (count(*) OVER (PARTITION BY r0) - 1) / 2 AS ra, rank() OVER (ORDER BY r1) + (count(*) OVER (PARTITION BY r1) - 1) / 2 AS rb FROM {j}))"
query("dealer_stability_disjoint", "dealers i, spearman d, pearson d", f"WITH b AS (SELECT * FROM {_B}), j AS (SELECT r0, r1 FROM (SELECT dealer_id, avg(ret) AS r0 FROM b WHERE year = 1997 AND dealer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {YEAR_MIN}) JOIN (SELECT dealer_id, avg(ret) AS r1 FROM b WHERE year = 1998 AND dealer_id IS NOT NULL AND vehicle_id NOT IN (SELECT vehicle_id FROM b WHERE year = 1997) GROUP BY 1 HAVING count(*) >= {YEAR_MIN // 2}) USING (dealer_id)) SELECT * FROM "
      + _RANKS.format(j="j"), "visits")(_disjoint)


def _year_residuals(t: Tables):
    """Dealer residuals against the mix of generation and service number, by year; 1997 against 1998."""
    b = base(t).where(F.col("year").isin(1997, 1998))
    mix = b.groupBy("year", "gen", F.coalesce("number_bin", F.lit("-")).alias("k")).agg(F.avg("ret").alias("e"))
    j = b.where(F.col("dealer_id").isNotNull()).withColumn("k", F.coalesce("number_bin", F.lit("-"))).join(mix, ["year", "gen", "k"])
    y = lambda v, c: F.when(F.col("year") == v, c)
    d = j.groupBy("dealer_id").agg(*[F.count(y(v, 1)).alias(f"n{v}") for v in (1997, 1998)], *[(100 * (F.avg(y(v, F.col("ret"))) - F.avg(y(v, F.col("e"))))).alias(f"r{k}") for k, v in enumerate((1997, 1998))])
    j = d.where((F.col("n1997") >= YEAR_MIN) & (F.col("n1998") >= YEAR_MIN))
    return st.weighted_spearman(j.withColumns({"r0": F.round("r0", 9), "r1": F.round("r1", 9)}), "r0", "r1").withColumnRenamed("n", "dealers").withColumn("pearson", j.agg(F.corr("r0", "r1").alias("c")).scalar())


query("dealer_residual_stability", "dealers i, spearman d, pearson d", f"""WITH b AS (SELECT *, avg(ret) OVER (PARTITION BY year, gen, coalesce(number_bin, '-')) AS e FROM {_B} WHERE year IN (1997, 1998)),
 j AS (SELECT round(100 * (avg(ret) FILTER (WHERE year = 1997) - avg(e) FILTER (WHERE year = 1997)), 9) AS r0, round(100 * (avg(ret) FILTER (WHERE year = 1998) - avg(e) FILTER (WHERE year = 1998)), 9) AS r1 FROM b WHERE dealer_id IS NOT NULL GROUP BY dealer_id
 HAVING count(*) FILTER (WHERE year = 1997) >= {YEAR_MIN} AND count(*) FILTER (WHERE year = 1998) >= {YEAR_MIN}) SELECT * FROM """ + _RANKS.format(j="j"), "visits")(_year_residuals)

# ---------------------------------------------------------------------------------- two plans of the counters
_COUNTERS = [*ft.visit_flags_names(), "n_customer_changes", "n_dealer_changes"]


def second_plan(t: Tables):
    """The feature counters from exclusive running counts of a segmented scan, instead of day tables."""
    w = t.windows().where("status = 'evaluable'").select(F.col("window_id").alias("schedule_id"), "vehicle_id", F.col("scoring_date").alias("event_date"), F.lit(0).alias("kind"))
    v = t.visits()
    flags = {k: F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in ft.visit_flags().items()}
    here = F.struct("customer_id", "dealer_id")
    rows = v.select("schedule_id", "vehicle_id", "event_date", F.lit(1).alias("kind"), "customer_id", "dealer_id", *flags.values()).unionByName(w, allowMissingColumns=True)
    order = [F.col("event_date").alias("a"), F.col("kind").alias("k"), F.col("schedule_id").alias("b")]
    rows = scan_before(rows, "vehicle_id", order, last={"_prev": F.when(F.col("kind") == 1, here)})
    rows = rows.withColumns({"n_customer_changes": F.coalesce(F.col("customer_id") != F.col("_prev.customer_id"), F.lit(False)).cast("int"),
                             "n_dealer_changes": (F.col("_prev.dealer_id").isNotNull() & ~F.col("dealer_id").eqNullSafe(F.col("_prev.dealer_id")) & (F.col("kind") == 1)).cast("int")})
    out = scan_before(rows.drop("_prev"), "vehicle_id", order, sums={k: F.coalesce(F.col(k), F.lit(0)) for k in _COUNTERS})
    return out.where("kind = 0").select(F.col("schedule_id").alias("window_id"), *_COUNTERS)


_FLAG_SQL = {"n_maint": "is_completed_maintenance", "n_completed": "completed", "n_no_os": "completed_no_os", "n_noshow": "no_show", "n_cancel": "cancelled", "n_appts": "true", "n_recall": "completed AND has_recall", "n_diag": "completed AND has_diag", "n_repair": "completed AND has_repair",
             "n_guarantee": "completed AND has_guarantee", "n_fordpass": "ScheduleSource = 'FordPass'", "n_web_or_app": "ScheduleSource IN ('FordPass', 'WEB', 'Mobile')", "n_pud": "completed AND has_pud", "n_mobile": "completed AND has_mobile", "n_fixed_price": "completed AND has_fixed_price",
             "n_reschedule": "IsReschedule = 'Y'", "n_hard_cancel": "cancelled AND IsReschedule = 'N'", "n_return_visits": "ScheduleReturn = 'Y'", "n_towing": "NeededTowing = 'Y'", "n_customer_changes": "coalesce(customer_id <> pc, false)", "n_dealer_changes": "pdl IS NOT NULL AND dealer_id IS DISTINCT FROM pdl"}
query("two_plan_counters", "column s, total_first i, total_second i, differing i".replace("column s", "counter s"), f"""WITH v AS (SELECT *, lag(customer_id) OVER x AS pc, lag(dealer_id) OVER x AS pdl FROM visits WINDOW x AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)),
 u AS (SELECT vehicle_id, scoring_date AS d, window_id, 0 AS k, {', '.join(f'0 AS {c}' for c in _FLAG_SQL)} FROM windows WHERE status = 'evaluable' UNION ALL SELECT vehicle_id, event_date, schedule_id, 1, {', '.join(f'CAST(coalesce({c}, false) AS INTEGER)' for c in _FLAG_SQL.values())} FROM v),
 s AS (SELECT window_id, k, {', '.join(f'coalesce(sum({c}) OVER y, 0) AS {c}' for c in _FLAG_SQL)} FROM u WINDOW y AS (PARTITION BY vehicle_id ORDER BY d, k, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """
      + " UNION ALL ".join(f"SELECT '{c}' AS counter, sum(f.{c}) AS total_first, sum(s.{c}) AS total_second, count(*) FILTER (WHERE f.{c} <> s.{c}) AS differing FROM features f JOIN s ON s.window_id = f.window_id AND s.k = 0" for c in _FLAG_SQL), "features visits")(
    lambda t: df_.difference_counts(t.features().select("window_id", *[F.col(c).cast("bigint").alias(c) for c in _COUNTERS]), second_plan(t), "window_id", _COUNTERS).withColumnRenamed("column", "counter"))


# ---------------------------------------------------------------------------------- all features ranked
_DAY_BINS, _DAY_NAMES = [-INF, 0, 1, 3, 7, INF], ["0", "1", "2-3", "4-7", "8+"]
_VISIT_COLUMNS = ["NeededTowing", "IsReschedule", "ScheduleReturn", "ConnectedStatusARG", "Region", "DealerStateOrZone", "has_diag", "has_repair", "has_recall", "has_guarantee"]
_DAYS_SQL = "CASE WHEN {c} <= 0 THEN '0' WHEN {c} <= 1 THEN '1' WHEN {c} <= 3 THEN '2-3' WHEN {c} <= 7 THEN '4-7' WHEN {c} > 7 THEN '8+' END"
#: Level of each feature, as SQL over the return base, prior history and the visit's own columns.
_ALL = {"gen": "gen", "model_year": "ModelYear", "number_bin": "number_bin", "source": "ScheduleSource", "digital": "ScheduleSource IN ('FordPass', 'WEB', 'Mobile')", "survey": "survey", "has_pud": "has_pud", "has_mobile": "has_mobile", "waiting": "CustomerWaiting",
        "has_fixed_price": "has_fixed_price", **{c: c for c in _VISIT_COLUMNS}, "days": "days_bin", "work_days": "work_days_bin", "items": "items_bin", **{c: c for c in _HIST_FEATURES}}
DEALER_MIN = 30


def ranking_base(t: Tables):
    """The return base with every feature of the ranking as a level, and the dealer's return of the year before in fifths."""
    def build():
        d = t.visits().select("schedule_id", *_VISIT_COLUMNS, cut(F.col("DaysInDealer"), _DAY_BINS, _DAY_NAMES).alias("days_bin"), cut(F.col("WorkDaysInDealer"), _DAY_BINS, _DAY_NAMES).alias("work_days_bin"),
                              F.when(F.col("n_items") >= 4, "4+").otherwise(F.col("n_items").cast("string")).alias("items_bin"))
        return history_base(t).join(d, "schedule_id")
    return t.stage("ranking_base", build)


def _feature_cube(t: Tables):
    return t.stage("ranking_cube", lambda: cb.level_cube(ranking_base(t), {k: F.expr(c) for k, c in _ALL.items()}, ["ret"]).unionByName(
        cb.level_cube(_dealers(t), {"dealer_id": F.col("dealer_id"), "dealer_encoding": F.col("fifth")}, ["ret"])))


def _dealers(t: Tables):
    """Visits of 1998 and later at dealers with enough visits in 1997, with the fifth of the dealer's return in 1997."""
    te = base(t).where("year = 1997 and dealer_id is not null").groupBy("dealer_id").agg(one().alias("n97"), F.avg("ret").alias("r97")).where(F.col("n97") >= DEALER_MIN)
    edges = te.agg(F.percentile("r97", F.array(*[F.lit(q / 5) for q in range(1, 5)])).alias("e"))        # one row a dealer
    b = base(t).where("year >= 1998").join(te, "dealer_id").withColumn("e", edges.select("e").scalar())
    fifth = F.size(F.filter("e", lambda e: F.col("r97") > e)) + 1
    return b.select("ret", "dealer_id", fifth.cast("string").alias("fifth"))


def _rank_all(t: Tables):
    g = _feature_cube(t).groupBy("feature", "level").agg(F.sum("n").alias("n"), F.sum("ret").alias("p"))
    total = g.groupBy("feature").agg(F.sum(F.col("p") + 0.5).alias("tp"), F.sum(F.col("n") - F.col("p") + 0.5).alias("tq"), F.sum("n").alias("rows"))
    j = g.join(total, "feature").withColumns({"a": (F.col("p") + 0.5) / F.col("tp"), "b": (F.col("n") - F.col("p") + 0.5) / F.col("tq"), "rate": F.when(F.col("n") >= _RANK_MIN, F.col("p") / F.col("n"))})
    return j.groupBy("feature", "rows").agg(one().alias("levels"), F.sum((F.col("a") - F.col("b")) * F.log(F.col("a") / F.col("b"))).alias("iv"), F.max("rate").alias("best_rate"), F.min("rate").alias("worst_rate")).withColumn("spread_pp", 100 * (F.col("best_rate") - F.col("worst_rate")))


query("feature_ranking_all", "feature s, rows i, levels i, iv d, best_rate d, worst_rate d, spread_pp d", f"""WITH h AS (SELECT * FROM {_HB}), r AS (SELECT h.*, {', '.join(f'v.{c}' for c in _VISIT_COLUMNS)}, {_DAYS_SQL.format(c='v.DaysInDealer')} AS days_bin, {_DAYS_SQL.format(c='v.WorkDaysInDealer')} AS work_days_bin,
 CASE WHEN v.n_items >= 4 THEN '4+' ELSE CAST(v.n_items AS VARCHAR) END AS items_bin FROM h JOIN visits v USING (schedule_id)),
te AS (SELECT dealer_id, avg(ret) AS r97 FROM h WHERE year = 1997 AND dealer_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {DEALER_MIN}), e AS (SELECT quantile_cont(r97, [0.2, 0.4, 0.6, 0.8]) AS e FROM te),
d AS (SELECT ret, dealer_id, CAST(len(list_filter(e, lambda x: r97 > x)) + 1 AS VARCHAR) AS fifth FROM h JOIN te USING (dealer_id), e WHERE year >= 1998),
l AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature, coalesce(CAST(({c}) AS VARCHAR), '(nulo)') AS level, ret FROM r" for k, c in _ALL.items())} UNION ALL SELECT 'dealer_id', dealer_id, ret FROM d UNION ALL SELECT 'dealer_encoding', fifth, ret FROM d),
g AS (SELECT feature, level, count(*) AS n, sum(ret) AS p FROM l GROUP BY 1, 2), s AS (SELECT *, (p + 5e-1) / sum(p + 5e-1) OVER w AS a, (n - p + 5e-1) / sum(n - p + 5e-1) OVER w AS b FROM g WINDOW w AS (PARTITION BY feature))
SELECT feature, sum(n) AS rows, count(*) AS levels, sum((a - b) * ln(a / b)) AS iv, max(p / n) FILTER (WHERE n >= {_RANK_MIN}) AS best_rate, min(p / n) FILTER (WHERE n >= {_RANK_MIN}) AS worst_rate, 100 * (max(p / n) FILTER (WHERE n >= {_RANK_MIN}) - min(p / n) FILTER (WHERE n >= {_RANK_MIN})) AS spread_pp
FROM s GROUP BY 1""", "visits")(_rank_all)


def _recent(t: Tables):
    """Completed visits with a booking of the vehicle in the 30 days before: how many carry the return flag."""
    p = previous_row(t.visits().select("schedule_id", "vehicle_id", "event_date", "StatusARG", "completed", "ScheduleReturn"), "vehicle_id", "event_date", "schedule_id", ["event_date", "completed"]).where("completed")
    near = F.coalesce(F.datediff("event_date", "prev_event_date") <= 30, F.lit(False))
    kinds = F.array(F.when(near, F.lit("any booking before")), F.when(near & F.col("prev_completed"), F.lit("completed before")), F.when(~near, F.lit("none before")))
    return p.select("ScheduleReturn", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).groupBy("kind").agg(one().alias("n"), count_if(F.col("ScheduleReturn") == "Y").alias("flagged"), F.avg((F.col("ScheduleReturn").eqNullSafe(F.lit("Y"))).cast("double")).alias("share"))


query("return_flag_by_predecessor", "kind s, n i, flagged i, share d", """WITH p AS (SELECT *, coalesce(event_date - lag(event_date) OVER w <= 30, false) AS near, lag(completed) OVER w AS pc FROM visits WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)),
 k AS (SELECT 'any booking before' AS kind, ScheduleReturn FROM p WHERE completed AND near UNION ALL SELECT 'completed before', ScheduleReturn FROM p WHERE completed AND near AND pc UNION ALL SELECT 'none before', ScheduleReturn FROM p WHERE completed AND NOT near)
 SELECT kind, count(*) AS n, count(*) FILTER (WHERE ScheduleReturn = 'Y') AS flagged, avg(CAST(coalesce(ScheduleReturn = 'Y', false) AS INTEGER)) AS share FROM k GROUP BY 1""", "visits")(_recent)
