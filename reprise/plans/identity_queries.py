"""Customer identity, transfers, fleets and dealers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reprise.functions.columns import INF, count_if, cut, mask_identifier, share
from reprise.operators import stats as st
from reprise.operators.history import change_runs, counts_before, previous_row
from reprise.plans.domain import SPAN, Tables
from reprise.plans.registry import query

one = lambda: F.count(F.lit(1))
FLEET = 3


def known(t: Tables):
    return t.visits().where(F.col("customer_id").isNotNull())


def sequence(t: Tables):
    """Bookings with the previous booking's owner, channel, dealer and date."""
    def build():
        s = previous_row(known(t), "vehicle_id", "event_date", "schedule_id", ["customer_id", "ScheduleSource", "dealer_id", "event_date"])
        s = s.withColumn("switch", F.coalesce(F.col("customer_id") != F.col("prev_customer_id"), F.lit(False)))
        return s.select("schedule_id", "vehicle_id", "customer_id", "dealer_id", "event_date", "ScheduleSource", "completed", "is_completed_maintenance", "has_maint", "WarrantyStartDate",
                        *[c for c in s.columns if c.startswith("prev_")], "switch")
    return t.stage("sequence", build)


_KN = "(SELECT * FROM visits WHERE customer_id IS NOT NULL)"
_SQ = f"""(SELECT *, coalesce(customer_id <> pc, false) AS switch FROM (SELECT *, lag(customer_id) OVER w AS pc, lag(ScheduleSource) OVER w AS ps, lag(dealer_id) OVER w AS pdl, lag(event_date) OVER w AS pd FROM {_KN}
 WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)))"""


def patterns(t: Tables):
    g = sequence(t).groupBy("vehicle_id").agg(F.count_distinct("customer_id").alias("n_cust"), count_if(F.col("switch")).alias("n_switch"),
                                              count_if(F.col("switch") & (F.col("event_date") == F.col("prev_event_date"))).alias("n_same_day"), one().alias("n_visits"))
    perm = F.col("n_switch") == F.col("n_cust") - 1
    return g.withColumn("pattern", F.when(F.col("n_cust") == 1, "single").when(perm & (F.col("n_same_day") == 0), "sequential").when(perm, "ambiguous").otherwise("alternating"))


_PAT = f"""(SELECT *, CASE WHEN n_cust = 1 THEN 'single' WHEN n_switch = n_cust - 1 AND n_same_day = 0 THEN 'sequential' WHEN n_switch = n_cust - 1 THEN 'ambiguous' ELSE 'alternating' END AS pattern FROM (
 SELECT vehicle_id, count(DISTINCT customer_id) AS n_cust, count(*) FILTER (WHERE switch) AS n_switch, count(*) FILTER (WHERE switch AND event_date = pd) AS n_same_day, count(*) AS n_visits FROM {_SQ} GROUP BY 1))"""
query("identity_patterns", "pattern s, n_cust i, vehicles i, switches i", f"SELECT pattern, least(n_cust, 5) AS n_cust, count(*) AS vehicles, sum(n_switch) AS switches FROM {_PAT} GROUP BY 1, 2", "visits")(
    lambda t: patterns(t).groupBy("pattern", F.least("n_cust", F.lit(5)).alias("n_cust")).agg(one().alias("vehicles"), F.sum("n_switch").alias("switches")))
query("identity_runs", "n_values i, n_runs i, vehicles i", f"""SELECT n_values, n_runs, count(*) AS vehicles FROM (SELECT count(DISTINCT customer_id) AS n_values, count(*) FILTER (WHERE switch) + 1 AS n_runs FROM {_SQ} GROUP BY vehicle_id) GROUP BY 1, 2""", "visits")(
    lambda t: change_runs(t.visits(), "vehicle_id", "event_date", "schedule_id", "customer_id").groupBy("n_values", "n_runs").agg(one().alias("vehicles")))


def customer_sizes(t: Tables):
    return known(t).groupBy("customer_id").agg(F.count_distinct("vehicle_id").alias("n_veh"))


def _context(t: Tables):
    multi = patterns(t).where(F.col("n_cust") > 1).select("vehicle_id")
    sz = customer_sizes(t)
    s = sequence(t).join(multi, "vehicle_id", "left_semi").where(F.col("prev_customer_id").isNotNull())
    s = s.join(sz.withColumnRenamed("n_veh", "n_new"), "customer_id", "left").join(sz.select(F.col("customer_id").alias("prev_customer_id"), F.col("n_veh").alias("n_old")), "prev_customer_id", "left")
    a, b = F.col("prev_ScheduleSource"), F.col("ScheduleSource")
    cross = ((a == "Dealer") & (b == "FordPass")) | ((a == "FordPass") & (b == "Dealer"))
    return s.groupBy("switch").agg(one().alias("n"), share(a != b).alias("channel"), share(~F.col("prev_dealer_id").eqNullSafe(F.col("dealer_id"))).alias("dealer"), share(cross).alias("crossing"),
                                   share(F.col("n_new") >= FLEET).alias("new_fleet"), share(F.col("n_old") >= FLEET).alias("old_fleet"))


_SZ = f"(SELECT customer_id, count(DISTINCT vehicle_id) AS n_veh FROM {_KN} GROUP BY 1)"
_CROSS = "((ps = 'Dealer' AND ScheduleSource = 'FordPass') OR (ps = 'FordPass' AND ScheduleSource = 'Dealer'))"
query("identity_change_context", "switch b, n i, channel d, dealer d, crossing d, new_fleet d, old_fleet d", f"""SELECT switch, count(*) AS n, avg(CAST(ps <> ScheduleSource AS INTEGER)) AS channel,
 avg(CAST(pdl IS DISTINCT FROM dealer_id AS INTEGER)) AS dealer, avg(CAST({_CROSS} AS INTEGER)) AS crossing, avg(CAST(a.n_veh >= 3 AS INTEGER)) AS new_fleet, avg(CAST(b.n_veh >= 3 AS INTEGER)) AS old_fleet
FROM {_SQ} s JOIN {_PAT} p ON p.vehicle_id = s.vehicle_id AND p.n_cust > 1 LEFT JOIN {_SZ} a ON a.customer_id = s.customer_id LEFT JOIN {_SZ} b ON b.customer_id = s.pc WHERE pc IS NOT NULL GROUP BY 1""", "visits")(_context)
_CH = ["Dealer", "FordPass", "WEB", "Mobile", "CAF"]
query("identity_channel_transition", "prev_ScheduleSource s, c1 i, c2 i, c3 i, c4 i, c5 i, total i", "SELECT ps AS prev_ScheduleSource, " + ", ".join(
    f"count(*) FILTER (WHERE ScheduleSource = '{c}') AS c{i + 1}" for i, c in enumerate(_CH)) + f", count(*) AS total FROM {_SQ} WHERE switch GROUP BY 1", "visits")(
    lambda t: st.crosstab(sequence(t).where("switch"), "prev_ScheduleSource", "ScheduleSource", _CH, "c"))


def _mix(t: Tables):
    fp = F.col("ScheduleSource") == "FordPass"
    v = t.visits().groupBy("vehicle_id").agg(F.bool_and(fp).alias("all_fp"), F.bool_or(fp).alias("any_fp"), one().alias("n"), F.count_distinct("customer_id").alias("nc")).where("n >= 2")
    v = v.withColumns({"mix": F.when(F.col("any_fp") & ~F.col("all_fp"), "mixed").otherwise("one_kind"), "visits": cut(F.col("n"), [1, 2, 3, 5, 8, INF], ["2", "3", "4-5", "6-8", "9+"])})
    return st.strat_table(v.withColumn("multi", (F.col("nc") > 1).cast("int")), "mix", "visits", "multi")


query("identity_channel_mix_stratified", "stratum s, level s, n i, rate d", """SELECT CASE WHEN n <= 2 THEN '2' WHEN n <= 3 THEN '3' WHEN n <= 5 THEN '4-5' WHEN n <= 8 THEN '6-8' ELSE '9+' END AS stratum,
 CASE WHEN f AND NOT al THEN 'mixed' ELSE 'one_kind' END AS level, count(*) AS n, avg(CAST(nc > 1 AS INTEGER)) AS rate FROM (SELECT bool_or(ScheduleSource = 'FordPass') AS f, bool_and(ScheduleSource = 'FordPass') AS al,
 count(*) AS n, count(DISTINCT customer_id) AS nc FROM visits GROUP BY vehicle_id) WHERE n >= 2 GROUP BY 1, 2""", "visits")(_mix)


def transfers(t: Tables):
    """Owner changes of sequential vehicles with their confidence tier."""
    seq = patterns(t).where(F.col("pattern") == "sequential").select("vehicle_id")
    sz = customer_sizes(t)
    s = sequence(t).where("switch").join(seq, "vehicle_id", "left_semi")
    s = s.join(sz.withColumnRenamed("n_veh", "n_new"), "customer_id", "left").join(sz.select(F.col("customer_id").alias("prev_customer_id"), F.col("n_veh").alias("n_old")), "prev_customer_id", "left")
    a, b = F.col("prev_ScheduleSource"), F.col("ScheduleSource")
    cross = ((a == "Dealer") & (b == "FordPass")) | ((a == "FordPass") & (b == "Dealer"))
    s = s.join(t.master().select("vehicle_id", "warranty_agenda"), "vehicle_id", "left")
    return s.withColumns({"tier": F.when(~cross & (F.col("n_new") < FLEET) & (F.col("n_old") < FLEET), 3).when(~cross, 2).otherwise(1),
                          "age": F.datediff("event_date", "warranty_agenda") / 365.25, "year": F.year("event_date")})


_TR = f"""(SELECT s.*, CASE WHEN NOT {_CROSS} AND a.n_veh < 3 AND b.n_veh < 3 THEN 3 WHEN NOT {_CROSS} THEN 2 ELSE 1 END AS tier, (event_date - warranty_agenda) / 365.25 AS age, year(event_date) AS year
FROM {_SQ} s JOIN {_PAT} p ON p.vehicle_id = s.vehicle_id AND p.pattern = 'sequential' LEFT JOIN {_SZ} a ON a.customer_id = s.customer_id LEFT JOIN {_SZ} b ON b.customer_id = s.pc
 LEFT JOIN vm ON vm.vehicle_id = s.vehicle_id WHERE switch)"""


def _tiers(t: Tables):
    return (transfers(t).select("vehicle_id", "year", F.explode(F.sequence(F.lit(1), F.col("tier"))).alias("min_tier")).groupBy("min_tier", "year")
            .agg(one().alias("transfers"), F.count_distinct("vehicle_id").alias("vehicles")))


query("transfer_tiers", "min_tier i, year i, transfers i, vehicles i", f"SELECT m AS min_tier, year, count(*) AS transfers, count(DISTINCT vehicle_id) AS vehicles FROM {_TR}, (SELECT unnest([1, 2, 3]) AS m) WHERE tier >= m GROUP BY 1, 2", "visits vm")(_tiers)
_AE, _AL = [-1, 1, 2, 3, 4, 5, INF], ["<1", "1-2", "2-3", "3-4", "4-5", "5+"]
_ACASE = "CASE WHEN {x} > -1 AND {x} <= 1 THEN '<1' WHEN {x} > 1 AND {x} <= 2 THEN '1-2' WHEN {x} > 2 AND {x} <= 3 THEN '2-3' WHEN {x} > 3 AND {x} <= 4 THEN '3-4' WHEN {x} > 4 AND {x} <= 5 THEN '4-5' WHEN {x} > 5 THEN '5+' END"


def _hazard(t: Tables):
    """Transfers of 1999 per vehicle active in 1999, by age."""
    act = t.visits().where(F.year("event_date") == 1999).select("vehicle_id").distinct().join(t.master().select("vehicle_id", "warranty_agenda"), "vehicle_id", "left")
    den = act.groupBy(cut(F.datediff(F.lit("1999-07-01").cast("date"), "warranty_agenda") / 365.25, _AE, _AL).alias("age")).agg(one().alias("active"))
    num = transfers(t).where(F.col("year") == 1999).groupBy(cut(F.col("age"), _AE, _AL).alias("_age")).agg(one().alias("transfers"), count_if(F.col("tier") == 3).alias("strict"))
    return (den.join(num, F.col("age").eqNullSafe(F.col("_age")), "left").select("age", "active", F.coalesce("transfers", F.lit(0)).alias("transfers"), F.coalesce("strict", F.lit(0)).alias("strict"))
            .withColumn("rate", F.col("transfers") / F.col("active")))


query("hazard_by_age", "age s, active i, transfers i, strict i, rate d", f"""SELECT d.age, active, coalesce(tr, 0) AS transfers, coalesce(st, 0) AS strict, coalesce(tr, 0) / active AS rate FROM (
 SELECT {_ACASE.format(x='x')} AS age, count(*) AS active FROM (SELECT DISTINCT v.vehicle_id, (DATE '1999-07-01' - warranty_agenda) / 365.25 AS x FROM visits v LEFT JOIN vm USING (vehicle_id) WHERE year(event_date) = 1999) GROUP BY 1) d
 LEFT JOIN (SELECT {_ACASE.format(x='age')} AS age, count(*) AS tr, count(*) FILTER (WHERE tier = 3) AS st FROM {_TR} WHERE year = 1999 GROUP BY 1) n ON n.age IS NOT DISTINCT FROM d.age""", "visits vm")(_hazard)
query("transfer_age_distribution", "age s, n i", f"SELECT {_ACASE.format(x='age')} AS age, count(*) AS n FROM {_TR} WHERE tier = 3 GROUP BY 1", "visits vm")(
    lambda t: transfers(t).where("tier = 3").groupBy(cut(F.col("age"), _AE, _AL).alias("age")).agg(one().alias("n")))
query("identity_change_by_gap", "gap s, n i, rate d", f"""SELECT CASE WHEN g <= 30 THEN '0-30' WHEN g <= 90 THEN '31-90' WHEN g <= 180 THEN '91-180' WHEN g <= 365 THEN '181-365' ELSE '366+' END AS gap, count(*) AS n, avg(CAST(switch AS INTEGER)) AS rate
 FROM (SELECT event_date - pd AS g, switch FROM {_SQ} WHERE pc IS NOT NULL) GROUP BY 1""", "visits")(
    lambda t: sequence(t).where(F.col("prev_customer_id").isNotNull()).groupBy(
        cut(F.datediff("event_date", "prev_event_date"), [-INF, 30, 90, 180, 365, INF], ["0-30", "31-90", "91-180", "181-365", "366+"]).alias("gap")).agg(one().alias("n"), share(F.col("switch")).alias("rate")))

_ENDS = f"""(SELECT vehicle_id, first(customer_id ORDER BY event_date, schedule_id) AS f, last(customer_id ORDER BY event_date, schedule_id) AS l FROM {_KN} GROUP BY 1)"""


def ends(t: Tables):
    w = F.struct("event_date", "schedule_id")
    return known(t).groupBy("vehicle_id").agg(F.min_by("customer_id", w).alias("first_c"), F.max_by("customer_id", w).alias("last_c"))


def _buyer_position(t: Tables):
    two = patterns(t).where((F.col("pattern") == "sequential") & (F.col("n_cust") == 2)).select("vehicle_id")
    j = ends(t).join(two, "vehicle_id", "left_semi").join(t.master().where("in_sales").select("vehicle_id", "sales_customer_id"), "vehicle_id")
    b = F.col("sales_customer_id")
    return j.groupBy(F.when(b == F.col("first_c"), "buyer_first").when(b == F.col("last_c"), "buyer_last").otherwise("buyer_absent").alias("position")).agg(one().alias("vehicles"))


query("buyer_position", "position s, vehicles i", f"""SELECT CASE WHEN sales_customer_id = f THEN 'buyer_first' WHEN sales_customer_id = l THEN 'buyer_last' ELSE 'buyer_absent' END AS position, count(*) AS vehicles
 FROM {_ENDS} e JOIN {_PAT} p ON p.vehicle_id = e.vehicle_id AND pattern = 'sequential' AND n_cust = 2 JOIN vm ON vm.vehicle_id = e.vehicle_id AND in_sales GROUP BY 1""", "visits vm")(_buyer_position)


def _buyer_agenda(t: Tables):
    any_ = known(t).select("vehicle_id", F.col("customer_id").alias("sales_customer_id")).distinct().withColumn("_hit", F.lit(True))
    j = t.master().where("in_sales").join(ends(t), "vehicle_id").join(any_, ["vehicle_id", "sales_customer_id"], "left")
    b = F.col("sales_customer_id")
    return j.groupBy("business_unit").agg(one().alias("n"), share(F.col("_hit").isNotNull()).alias("any"), share(b == F.col("first_c")).alias("first"), share(b == F.col("last_c")).alias("last"))


query("buyer_vs_agenda", "business_unit s, n i, any d, first d, last d".replace("any d", "seen d").replace("first d", "is_first d").replace("last d", "is_last d"), f"""SELECT business_unit, count(*) AS n, avg(CAST(EXISTS (SELECT 1 FROM {_KN} k WHERE k.vehicle_id = vm.vehicle_id AND k.customer_id = sales_customer_id) AS INTEGER)) AS seen,
 avg(CAST(sales_customer_id = f AS INTEGER)) AS is_first, avg(CAST(sales_customer_id = l AS INTEGER)) AS is_last FROM vm JOIN {_ENDS} e USING (vehicle_id) WHERE in_sales GROUP BY 1""", "visits vm")(
    lambda t: _buyer_agenda(t).withColumnsRenamed({"any": "seen", "first": "is_first", "last": "is_last"}))

_FE, _FL = [0, 1, 2, 9, 49, INF], ["1", "2", "3-9", "10-49", "50+"]
_FCASE = "CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 9 THEN '3-9' WHEN n <= 49 THEN '10-49' ELSE '50+' END"


def _fleet(t: Tables):
    a = customer_sizes(t).select(F.lit("agenda").alias("source"), "customer_id", "n_veh")
    s = t.sales().groupBy("customer_id").agg(F.count_distinct("vehicle_id").alias("n_veh")).select(F.lit("sales").alias("source"), "customer_id", "n_veh")
    pairs = known(t).select("customer_id", "vehicle_id").unionByName(t.sales().select("customer_id", "vehicle_id")).distinct()
    u = pairs.groupBy("customer_id").agg(one().alias("n_veh")).select(F.lit("union").alias("source"), "customer_id", "n_veh")
    return a.unionByName(s).unionByName(u).groupBy("source", cut(F.col("n_veh"), _FE, _FL).alias("fleet")).agg(one().alias("customers"), F.sum("n_veh").alias("vehicles"))


query("fleet_sizes", "source s, fleet s, customers i, vehicles i", f"""SELECT source, {_FCASE} AS fleet, count(*) AS customers, sum(n) AS vehicles FROM (SELECT 'agenda' AS source, n_veh AS n FROM {_SZ}
 UNION ALL SELECT 'sales', count(DISTINCT vehicle_id) FROM sales GROUP BY customer_id UNION ALL SELECT 'union', count(*) FROM (SELECT customer_id, vehicle_id FROM {_KN} UNION SELECT customer_id, vehicle_id FROM sales) GROUP BY customer_id) GROUP BY 1, 2""",
      "visits sales")(_fleet)
query("top_fleets", "customer s, n_veh i, visits i", f"""SELECT concat(customer_id[1:4], '…', right(customer_id, 2)) AS customer, count(DISTINCT vehicle_id) AS n_veh, count(*) AS visits FROM {_KN} GROUP BY customer_id
 ORDER BY n_veh DESC, visits DESC, customer_id LIMIT 8""", "visits")(
    lambda t: known(t).groupBy("customer_id").agg(F.count_distinct("vehicle_id").alias("n_veh"), one().alias("visits")).orderBy(F.col("n_veh").desc(), F.col("visits").desc(), "customer_id").limit(8)
    .withColumn("customer", mask_identifier(F.col("customer_id"))))
query("fleet_by_unit", "fleet s, business_unit s, n i, share d", f"""SELECT fleet, business_unit, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fleet) AS share FROM (SELECT {_FCASE} AS fleet, BusinessUnit AS business_unit FROM sales
 JOIN (SELECT customer_id, count(*) AS n FROM sales GROUP BY 1) USING (customer_id)) GROUP BY 1, 2""", "sales")(
    lambda t: st.value_shares(t.sales().join(t.sales().groupBy("customer_id").agg(one().alias("_n")), "customer_id").select(
        cut(F.col("_n"), _FE, _FL).alias("fleet"), F.col("BusinessUnit").alias("business_unit")), ["fleet"], "business_unit"))

query("key_overlap", "side s, keys i, rows_a i, rows_b i", """SELECT CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS keys, coalesce(sum(na), 0) AS rows_a, coalesce(sum(nb), 0) AS rows_b
 FROM (SELECT dealer_id AS k, count(*) AS na FROM appt WHERE dealer_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT dealer_id AS k, count(*) AS nb FROM sales WHERE dealer_id IS NOT NULL GROUP BY 1) b ON a.k = b.k GROUP BY 1""", "appt sales")(
    lambda t: st.key_overlap(t.appt(), t.sales(), "dealer_id"))


def first_dealers(t: Tables):
    w = F.struct("event_date", "schedule_id")
    d = t.visits().groupBy("vehicle_id").agg(F.min_by("dealer_id", F.when(F.col("dealer_id").isNotNull(), w)).alias("first_dealer"))
    m = t.maint().groupBy("vehicle_id").agg(F.min_by("dealer_id", F.when(F.col("dealer_id").isNotNull(), F.col("event_date"))).alias("first_maint_dealer"))
    return t.sales().where(F.col("dealer_id").isNotNull()).select("vehicle_id", F.col("dealer_id").alias("sale_dealer"), "BusinessUnit").join(d, "vehicle_id").join(m, "vehicle_id", "left")


_FD = """(SELECT s.vehicle_id, s.dealer_id AS sale_dealer, BusinessUnit, fd, fm FROM sales s JOIN (SELECT vehicle_id, first(dealer_id ORDER BY event_date, schedule_id) FILTER (WHERE dealer_id IS NOT NULL) AS fd FROM visits GROUP BY 1) USING (vehicle_id)
 LEFT JOIN (SELECT vehicle_id, first(dealer_id ORDER BY event_date) FILTER (WHERE dealer_id IS NOT NULL) AS fm FROM maint GROUP BY 1) USING (vehicle_id) WHERE s.dealer_id IS NOT NULL)"""
query("first_service_selling_dealer", "BusinessUnit s, n i, same_first_visit d, n_maint i, same_first_maint d", f"""SELECT BusinessUnit, count(*) AS n, avg(CAST(coalesce(sale_dealer = fd, false) AS INTEGER)) AS same_first_visit, count(fm) AS n_maint,
 avg(CAST(sale_dealer = fm AS INTEGER)) AS same_first_maint FROM {_FD} GROUP BY 1""", "visits maint sales")(
    lambda t: first_dealers(t).groupBy("BusinessUnit").agg(one().alias("n"), share(F.col("sale_dealer") == F.col("first_dealer")).alias("same_first_visit"), F.count("first_maint_dealer").alias("n_maint"),
                                                           F.avg((F.col("sale_dealer") == F.col("first_maint_dealer")).cast("double")).alias("same_first_maint")))


def _destination(t: Tables):
    g = first_dealers(t).where(F.col("first_dealer").isNotNull())
    top = st.mode_of(g, ["sale_dealer"], "first_dealer", "top_dealer")
    return top.select("sale_dealer", "top_dealer", F.col("n").alias("vehicles"), (F.col("mode_n") / F.col("n")).alias("top_share"))


query("dealer_destination_concentration", "sale_dealer s, top_dealer s, vehicles i, top_share d", f"""SELECT sale_dealer, arg_max(fd, (k, fd)) AS top_dealer, sum(k) AS vehicles, max(k) / sum(k) AS top_share FROM (
 SELECT sale_dealer, fd, count(*) AS k FROM {_FD} WHERE fd IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "visits maint sales")(_destination)


def identity_features(t: Tables):
    """As-of distinct owners of a vehicle and distinct vehicles of an owner at each booking."""
    k = known(t).select("schedule_id", "vehicle_id", "customer_id", "event_date")
    first = k.groupBy("vehicle_id", "customer_id").agg(F.min(F.struct("event_date", "schedule_id")).alias("_f"))
    k = k.join(first, ["vehicle_id", "customer_id"]).withColumn("new_pair", F.col("_f.schedule_id") == F.col("schedule_id"))
    k = counts_before(k, "vehicle_id", "event_date", "schedule_id", {"owners_before": F.col("new_pair")})
    k = counts_before(k, "customer_id", "event_date", "schedule_id", {"fleet_before": F.col("new_pair")})
    return k.withColumns({"owners_asof": F.col("owners_before") + F.col("new_pair").cast("int"), "fleet_asof": F.col("fleet_before") + F.col("new_pair").cast("int"),
                          "days_as_owner": F.datediff("event_date", "_f.event_date")})


query("identity_features_asof", "schedule_id s, owners_asof i, fleet_asof i, days_as_owner i", f"""SELECT schedule_id, sum(CAST(np AS INTEGER)) OVER (PARTITION BY vehicle_id ORDER BY event_date, schedule_id) AS owners_asof,
 sum(CAST(np AS INTEGER)) OVER (PARTITION BY customer_id ORDER BY event_date, schedule_id) AS fleet_asof, event_date - fe AS days_as_owner FROM (SELECT *, min(event_date) OVER (PARTITION BY vehicle_id, customer_id) AS fe,
 row_number() OVER (PARTITION BY vehicle_id, customer_id ORDER BY event_date, schedule_id) = 1 AS np FROM {_KN})""", "visits")(identity_features)


def _multi_users(t: Tables):
    act = known(t).where(F.col("event_date") >= F.lit("1999-01-01")).groupBy("customer_id").agg(F.count_distinct("vehicle_id").alias("n"))
    return act.agg(one().alias("customers"), count_if(F.col("n") >= 2).alias("multi"), F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("vehicles_of_multi"), F.sum("n").alias("vehicles"))


query("multi_vehicle_users", "customers i, multi i, vehicles_of_multi i, vehicles i", f"""SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS multi, sum(n) FILTER (WHERE n >= 2) AS vehicles_of_multi, sum(n) AS vehicles
 FROM (SELECT count(DISTINCT vehicle_id) AS n FROM {_KN} WHERE event_date >= DATE '1999-01-01' GROUP BY customer_id)""", "visits")(_multi_users)


def _coincidence(t: Tables):
    """Clients whose vehicles fall due in the same month, under two definitions of a due month."""
    m = t.maint().where(F.col("customer_id").isNotNull())
    every = m.select("customer_id", "vehicle_id", F.trunc(F.add_months("event_date", 12), "month").alias("month")).distinct()
    last = (m.groupBy("vehicle_id").agg(F.max_by("customer_id", "event_date").alias("customer_id"), F.max("event_date").alias("d"))
            .select("customer_id", "vehicle_id", F.trunc(F.add_months("d", 12), "month").alias("month")))
    both = every.select(F.lit("every").alias("definition"), "*").unionByName(last.select(F.lit("last_only").alias("definition"), "*"))
    g = both.groupBy("definition", "customer_id", "month").agg(one().alias("n"))
    return g.groupBy("definition").agg(F.sum("n").alias("windows"), F.count_distinct(F.when(F.col("n") >= 2, F.col("customer_id"))).alias("clients"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("coincident"))


query("window_coincidence", "definition s, windows i, clients i, coincident i", """WITH m AS (SELECT * FROM maint WHERE customer_id IS NOT NULL), b AS (SELECT DISTINCT 'every' AS definition, customer_id, vehicle_id,
 date_trunc('month', event_date + INTERVAL 12 MONTH) AS month FROM m UNION ALL SELECT 'last_only', last(customer_id ORDER BY event_date), vehicle_id, date_trunc('month', max(event_date) + INTERVAL 12 MONTH) FROM m GROUP BY vehicle_id)
SELECT definition, sum(n) AS windows, count(DISTINCT customer_id) FILTER (WHERE n >= 2) AS clients, coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS coincident FROM (SELECT definition, customer_id, month, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1""",
      "maint")(_coincidence)


def _never(t: Tables):
    s = t.sales().join(t.visits().select("vehicle_id").distinct().withColumn("_a", F.lit(True)), "vehicle_id", "left")
    s = s.join(t.visits().where("completed").select("vehicle_id").distinct().withColumn("_v", F.lit(True)), "vehicle_id", "left").join(
        t.maint().groupBy("vehicle_id").agg(F.min("event_date").alias("fm")), "vehicle_id", "left")
    months = F.datediff(F.lit(SPAN.cutoff), "WarrantyStartDate") / 30.44
    b = cut(months, [-INF, 24, 48, 60, 72, INF], ["0-24", "24-48", "48-60", "60-72", "72+"])
    return s.groupBy(b.alias("months"), "BusinessUnit").agg(one().alias("n"), share(F.col("_a").isNull()).alias("never_booked"), share(F.col("_v").isNull()).alias("never_visited"), share(F.col("fm").isNull()).alias("never_serviced"),
                                                           share(F.datediff("fm", "WarrantyStartDate") <= 456).alias("first_in_15m"))


query("sold_never_seen", "months s, BusinessUnit s, n i, never_booked d, never_visited d, never_serviced d, first_in_15m d", """SELECT CASE WHEN mo <= 24 THEN '0-24' WHEN mo <= 48 THEN '24-48' WHEN mo <= 60 THEN '48-60' WHEN mo <= 72 THEN '60-72' WHEN mo > 72 THEN '72+' END AS months,
 BusinessUnit, count(*) AS n, avg(CAST(a IS NULL AS INTEGER)) AS never_booked, avg(CAST(v IS NULL AS INTEGER)) AS never_visited, avg(CAST(fm IS NULL AS INTEGER)) AS never_serviced, avg(CAST(coalesce(fm - WarrantyStartDate <= 456, false) AS INTEGER)) AS first_in_15m
FROM (SELECT s.*, (DATE '2001-02-28' - WarrantyStartDate) / 30.44 AS mo, (SELECT min(1) FROM visits x WHERE x.vehicle_id = s.vehicle_id) AS a, (SELECT min(1) FROM visits x WHERE x.vehicle_id = s.vehicle_id AND completed) AS v,
 (SELECT min(event_date) FROM maint x WHERE x.vehicle_id = s.vehicle_id) AS fm FROM sales s) GROUP BY 1, 2""", "visits maint sales")(_never)
query("sold_not_in_agenda", "customer_id s, n i", "SELECT customer_id, count(*) AS n FROM sales WHERE vehicle_id NOT IN (SELECT vehicle_id FROM maint) GROUP BY 1", "maint sales")(
    lambda t: t.sales().join(t.maint().select("vehicle_id").distinct(), "vehicle_id", "left_anti").groupBy("customer_id").agg(one().alias("n")))
query("dealer_set_difference", "dealer_id s", "SELECT DISTINCT dealer_id FROM appt WHERE dealer_id IS NOT NULL EXCEPT SELECT dealer_id FROM sales", "appt sales")(
    lambda t: t.appt().where(F.col("dealer_id").isNotNull()).select("dealer_id").subtract(t.sales().select("dealer_id")))
query("dealer_set_intersection", "dealer_id s", "SELECT DISTINCT dealer_id FROM appt WHERE dealer_id IS NOT NULL INTERSECT SELECT dealer_id FROM sales", "appt sales")(
    lambda t: t.appt().where(F.col("dealer_id").isNotNull()).select("dealer_id").intersect(t.sales().select("dealer_id")))
query("pairs_union_distinct", "n i", f"SELECT count(*) AS n FROM (SELECT customer_id, vehicle_id FROM {_KN} UNION SELECT customer_id, vehicle_id FROM sales)", "visits sales")(
    lambda t: known(t).select("customer_id", "vehicle_id").unionByName(t.sales().select("customer_id", "vehicle_id")).distinct().agg(one().alias("n")))
query("transfer_verifiability", "both_sides b, vehicles i", f"""SELECT fb >= 2 AND la >= 2 AS both_sides, count(*) AS vehicles FROM (SELECT e.vehicle_id, count(*) FILTER (WHERE k.customer_id = f) AS fb, count(*) FILTER (WHERE k.customer_id = l) AS la
 FROM {_ENDS} e JOIN {_PAT} p ON p.vehicle_id = e.vehicle_id AND pattern = 'sequential' AND n_cust = 2 JOIN {_KN} k ON k.vehicle_id = e.vehicle_id GROUP BY 1) GROUP BY 1""", "visits")(
    lambda t: known(t).join(patterns(t).where("pattern = 'sequential' AND n_cust = 2").select("vehicle_id"), "vehicle_id", "left_semi").join(ends(t), "vehicle_id").groupBy("vehicle_id").agg(
        count_if(F.col("customer_id") == F.col("first_c")).alias("fb"), count_if(F.col("customer_id") == F.col("last_c")).alias("la")).groupBy(
        ((F.col("fb") >= 2) & (F.col("la") >= 2)).alias("both_sides")).agg(one().alias("vehicles")))
