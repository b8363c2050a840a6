"""Strictly as-of features: only events dated before the scoring date count.

Layout of the job
-----------------
1. Visits are exchanged once on (vehicle, day). Windows inside a day resolve same-day order.
2. A day summary (one row per vehicle-day) carries running values from day to day. Its window sees
   at most one row per calendar day of a vehicle, so a hot vehicle is split over its days in step 1
   and is small in step 2.
3. The carried values return to the visits on (vehicle, day), which are already placed that way.
4. Visits collapse to a day log of additive counts and "last known" payloads; the log, the surveys
   and the windows are read in one ordered pass per vehicle.
Customer-level features repeat the same idea on (customer, day).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import as_int, clip, flag
from reprise.operators.asof import asof_join
from reprise.operators.events import clean_km, event_km, vehicle_master
from reprise.params import DAYS_PER_MONTH, DAYS_PER_YEAR, SaleRules

COUNTERS = [
    "n_maint", "n_completed", "n_no_os", "n_noshow", "n_cancel", "n_appts", "n_recall", "n_diag", "n_repair",
    "n_guarantee", "n_fordpass", "n_web_or_app", "n_pud", "n_mobile", "n_fixed_price", "n_reschedule",
    "n_hard_cancel", "n_return_visits", "n_towing", "n_customer_changes", "n_dealer_changes",
]
CATEGORICAL = [
    "last_status", "last_source", "last_dealer_zone", "last_maint_source", "last_maint_dealer", "generation", "tma",
    "connected_status", "region", "person_type", "business_unit", "sales_channel", "sales_state", "binding_rule",
    "anchor_type", "rate_source",
]
ID_COLUMNS = [
    "window_id", "vehicle_id", "scoring_date", "anchor_date", "due_date", "due_time", "due_km", "customer_id",
    "last_dealer_id", "warranty_start", "sales_customer_id", "sales_dealer_id", "SalesDate", "history_days",
]
LABEL_COLUMNS = [
    "label_churn", "label_no_visit", "status", "customer_id_at_scoring", "window_n", "next_maint_date",
    "next_maint_km", "days_next_vs_due", "next_visit_date", "horizon_end", "first_seen",
]
SNAPSHOT_COLUMNS = ["connected_status"]
#: Columns of the feature table by kind.
DATES = ["scoring_date", "anchor_date", "due_date", "due_time", "due_km", "horizon_end", "next_maint_date", "next_visit_date", "warranty_start", "SalesDate"]
TEXTS = [*CATEGORICAL, "window_id", "vehicle_id", "customer_id", "last_dealer_id", "customer_id_at_scoring", "status", "sales_customer_id", "sales_dealer_id"]
WHOLE = ["history_days", "window_n", "days_next_vs_due", "n_maint", "n_completed", "n_no_os", "n_noshow", "n_cancel", "n_appts", "n_recall", "n_diag", "n_repair", "n_guarantee", "n_fordpass", "n_web_or_app", "n_pud", "n_mobile",
         "n_fixed_price", "n_reschedule", "n_hard_cancel", "n_return_visits", "n_towing", "n_customer_changes", "n_dealer_changes", "days_since_last_appt", "last_maint_fixed_price", "last_maint_pud", "last_maint_customer_waiting",
         "days_since_last_maint", "n_intervals_known", "n_numbering_jumps", "days_since_last_noshow", "days_since_last_cancel", "days_since_last_visit", "days_since_last_km", "n_surveys", "days_since_last_survey", "in_sales",
         "fleet_size_sales", "n_vehicles_customer_agenda", "vehicle_age_days", "is_buyer", "same_dealer_as_sale", "days_anchor_to_due", "days_to_due_at_scoring", "scoring_month", "is_first_service"]
REALS = ["anchor_km", "k_gen", "km_rate_per_day", "next_maint_km", "label_churn", "label_no_visit", "last_days_in_dealer", "last_maint_km", "last_maint_number", "last_maint_days_in_dealer", "last_interval_days", "last_interval_km",
         "mean_interval_days", "std_interval_days", "last_km", "min_rating", "last_rating", "mean_rating", "model_year", "vehicle_age_years", "months_observable", "km_per_year", "km_expected_at_scoring", "last_maint_late_days",
         "last_maint_km_vs_plan", "last_interval_km_vs_k", "noshow_rate", "cancel_rate", "fordpass_share", "maint_per_year_observed"]
FEATURE_TYPES = {c: k for k, cols in (("date", DATES), ("categorical", TEXTS), ("integer", WHOLE), ("numeric", REALS)) for c in cols}
RECENCIES = ["days_since_last_appt", "days_since_last_maint", "days_since_last_noshow", "days_since_last_cancel",
             "days_since_last_visit", "days_since_last_km", "days_since_last_survey"]
FLEET = ["fleet_size_sales", "n_vehicles_customer_agenda"]
WINDOW_INPUT = [
    "window_id", "vehicle_id", "scoring_date", "anchor_date", "anchor_km", "k_gen", "km_rate_per_day", "rate_source",
    "due_date", "due_time", "due_km", "binding_rule", "anchor_type", "history_days", "customer_id", "last_dealer_id",
]


def feature_columns(columns: list[str], exclude_snapshot: bool = True) -> list[str]:
    """Model inputs: everything but identifiers, labels, future facts and extraction snapshots."""
    drop = {*ID_COLUMNS, *LABEL_COLUMNS, *(SNAPSHOT_COLUMNS if exclude_snapshot else [])}
    return [c for c in columns if c not in drop]


def visit_flags() -> dict[str, Column]:
    """Counter name to the visit condition it counts (changes of owner and dealer come separately)."""
    done, src = F.col("completed"), F.col("ScheduleSource")
    return {
        "n_maint": F.col("is_completed_maintenance"), "n_completed": done, "n_no_os": F.col("completed_no_os"),
        "n_noshow": F.col("no_show"), "n_cancel": F.col("cancelled"), "n_appts": F.lit(True),
        "n_recall": done & F.col("has_recall"), "n_diag": done & F.col("has_diag"),
        "n_repair": done & F.col("has_repair"), "n_guarantee": done & F.col("has_guarantee"),
        "n_fordpass": src == fv.SOURCE_APP, "n_web_or_app": src.isin(fv.SOURCES_DIGITAL),
        "n_pud": done & F.col("has_pud"), "n_mobile": done & F.col("has_mobile"),
        "n_fixed_price": done & F.col("has_fixed_price"), "n_reschedule": F.col("IsReschedule") == "Y",
        "n_hard_cancel": F.col("cancelled") & (F.col("IsReschedule") == "N"),
        "n_return_visits": F.col("ScheduleReturn") == "Y", "n_towing": F.col("NeededTowing") == "Y",
    }


def visit_flags_names() -> list[str]:
    """Names of the visit counters; needs no session."""
    return ["n_maint", "n_completed", "n_no_os", "n_noshow", "n_cancel", "n_appts", "n_recall", "n_diag", "n_repair", "n_guarantee", "n_fordpass", "n_web_or_app", "n_pud", "n_mobile", "n_fixed_price",
            "n_reschedule", "n_hard_cancel", "n_return_visits", "n_towing"]


_DAY_KEY = ["vehicle_id", "event_date"]
#: Values of a visit that the day log reads beside its flags.
VISIT_VALUES = ["schedule_id", "customer_id", "dealer_id", "maint_number", "StatusARG", "ScheduleSource", "DealerStateOrZone", "DaysInDealer"]


def _in_day():
    return Window.partitionBy(*_DAY_KEY).orderBy("schedule_id")


def _in_day_before():
    return _in_day().rowsBetween(Window.unboundedPreceding, -1)


def _by_day():
    return Window.partitionBy("vehicle_id").orderBy("event_date")


def _days_before():
    return _by_day().rowsBetween(Window.unboundedPreceding, -1)


def _bits(values: Iterable[Column]) -> Column:
    """Zeros and ones as bits of one number."""
    return reduce(Column.bitwiseOR, [F.shiftleft(v.cast("int"), i) for i, v in enumerate(values)])


def dealt_visits(appt: DataFrame) -> DataFrame:
    """Visits of known vehicles and days, dealt by both. What is only counted travels as bits of one number and is
    unpacked where the row arrives."""
    bits = {**visit_flags(), "waiting": F.col("CustomerWaiting") == "Y"}
    v = (appt.where(F.col("vehicle_id").isNotNull() & F.col("event_date").isNotNull())
         .select(*_DAY_KEY, *VISIT_VALUES, clean_km(event_km("current")).alias("_km"), _bits(as_int(c) for c in bits.values()).alias("_bits")).repartition(*_DAY_KEY))
    return v.withColumns({k: F.getbit("_bits", F.lit(i)) == 1 for i, k in enumerate(bits)}).drop("_bits")


def placed_visits(appt: DataFrame) -> DataFrame:
    """Visits with their predecessor's owner, dealer, odometer and service number resolved."""
    v = dealt_visits(appt)
    v = v.withColumns({
        "_first": F.row_number().over(_in_day()) == 1,
        "_prev": F.lag(F.struct("customer_id", "dealer_id", "_km")).over(_in_day()),
        "_run": F.max("_km").over(_in_day_before()),
        "_prev_m": F.last(F.when(F.col("n_maint"), F.struct(F.col("maint_number").alias("n"))),
                          ignorenulls=True).over(_in_day_before()),
    })
    tail = F.struct("schedule_id")
    summary = v.groupBy(*_DAY_KEY).agg(
        F.max("_km").alias("d_km"),
        F.max_by(F.struct("customer_id", "dealer_id", "_km"), "schedule_id").alias("d_tail"),
        F.max_by(F.struct(F.col("maint_number").alias("n"), F.col("event_date").alias("d")),
                 F.when(F.col("n_maint"), tail)).alias("d_m"))
    carried = summary.select(
        *_DAY_KEY, F.lag("d_tail").over(_by_day()).alias("c_prev"), F.max("d_km").over(_days_before()).alias("c_run"),
        F.last("d_m", ignorenulls=True).over(_days_before()).alias("c_m"))
    v = v.join(carried, _DAY_KEY, "left").withColumns({
        "_p": F.when(F.col("_first"), F.col("c_prev")).otherwise(F.col("_prev")),
        "_top": F.greatest("_run", "c_run"),
        "_pn": F.when(F.col("_prev_m").isNotNull(), F.col("_prev_m.n")).otherwise(F.col("c_m.n")),
        "_pd": F.when(F.col("_prev_m").isNotNull(), F.col("event_date")).otherwise(F.col("c_m.d")),
    })
    # a reading after an unknown one is not checked against the running maximum
    unchecked = F.col("_p").isNull() | F.col("_p._km").isNull()
    owner, dealer = F.col("customer_id"), F.col("dealer_id")
    return v.withColumns({
        "km_event": F.when(unchecked | (F.col("_km") >= F.col("_top")), F.col("_km")),
        "owner_change": flag(owner != F.col("_p.customer_id")),
        # a dealer that becomes unknown counts as a change, an unknown predecessor does not
        "dealer_change": F.col("_p.dealer_id").isNotNull() & ~dealer.eqNullSafe(F.col("_p.dealer_id")),
        "kept_maint": F.col("n_maint")
                      & ~flag((F.datediff("event_date", "_pd") <= 30) & (F.col("maint_number") == F.col("_pn"))),
    }).drop("_first", "_prev", "_run", "_prev_m", "c_prev", "c_run", "c_m", "_p", "_top", "_pn", "_pd")


def _last_kept() -> dict[str, Column]:
    return {
        "last_maint_km": F.col("km_event"), "last_maint_number": F.col("maint_number"),
        "last_maint_source": F.col("ScheduleSource"), "last_maint_dealer": F.col("dealer_id"),
        "last_maint_days_in_dealer": clip(F.col("DaysInDealer"), 0.0),
        "last_maint_fixed_price": as_int(F.col("n_fixed_price")), "last_maint_pud": as_int(F.col("n_pud")),
        "last_maint_customer_waiting": as_int(F.col("waiting")),
    }


def day_log(appt: DataFrame) -> DataFrame:
    """One row per vehicle and day: additive counts and the last payload of each kind."""
    v = placed_visits(appt)
    # consecutive kept maintenances inside one day
    prev_kept = F.last(F.when(F.col("kept_maint"), F.struct(F.col("maint_number").alias("n"), F.col("km_event").alias("km"))),
                       ignorenulls=True).over(_in_day_before())
    v = v.withColumn("_pk", F.when(F.col("kept_maint"), prev_kept))
    sums = {**{k: F.col(k) for k in visit_flags_names()}, "n_customer_changes": F.col("owner_change"), "n_dealer_changes": F.col("dealer_change")}
    last = lambda value, cond=None: F.max_by(value, F.col("schedule_id") if cond is None else F.when(cond, F.col("schedule_id")))
    kept = F.col("kept_maint")
    jump = kept & F.col("_pk").isNotNull() & flag(F.col("maint_number") - F.col("_pk.n") >= 2)
    pair_km = F.col("km_event") - F.col("_pk.km")
    payload = F.struct(*[c.alias(k) for k, c in _last_kept().items()])
    return v.groupBy(*_DAY_KEY).agg(
        *[F.sum(as_int(c)).alias(k) for k, c in sums.items()],
        last(F.struct(F.col("StatusARG").alias("last_status"), F.col("ScheduleSource").alias("last_source"),
                      F.col("DealerStateOrZone").alias("last_dealer_zone"),
                      clip(F.col("DaysInDealer"), 0.0).alias("last_days_in_dealer"))).alias("d_last"),
        last(F.col("km_event"), F.col("km_event").isNotNull()).alias("d_km"),
        F.bool_or("n_noshow").alias("d_noshow"), F.bool_or("n_cancel").alias("d_cancel"),
        F.bool_or("n_completed").alias("d_visit"),
        last(payload, kept).alias("d_maint"),
        F.min_by(F.struct(F.col("maint_number").alias("n"), F.col("km_event").alias("km")),
                 F.when(kept, F.col("schedule_id"))).alias("d_first_kept"),
        last(F.struct((F.col("_pk").isNotNull()).alias("paired"), F.when(pair_km > 0, pair_km).alias("km")), kept).alias("d_pair"),
        F.sum(as_int(kept & F.col("_pk").isNotNull())).alias("d_pairs"),
        F.sum(as_int(jump)).alias("d_jumps"))


def _interval_columns(log: DataFrame, before: WindowSpec) -> DataFrame:
    """Intervals between kept maintenances, seen from each maintenance day; ``before``: the rows before it, of any kind."""
    is_m = F.col("d_maint").isNotNull()
    prev = F.last(F.when(is_m, F.struct(F.col("_t").alias("d"), F.col("d_maint.last_maint_number").alias("n"),
                                        F.col("d_maint.last_maint_km").alias("km"))), ignorenulls=True).over(before)
    log = log.withColumn("_pm", F.when(is_m, prev))
    gap = F.datediff("_t", "_pm.d").cast("double")
    cross_km = F.col("d_first_kept.km") - F.col("_pm.km")
    crossed = F.col("_pm").isNotNull()
    return log.withColumns({
        "i_n": F.coalesce(F.col("d_pairs") + crossed.cast("int"), F.lit(0)),
        "i_sum": F.coalesce(gap, F.lit(0.0)),
        "i_sq": F.coalesce(gap * gap, F.lit(0.0)),
        "i_jump": F.coalesce(F.col("d_jumps") + as_int(crossed & (F.col("d_first_kept.n") - F.col("_pm.n") >= 2)), F.lit(0)),
        # the last kept maintenance of the day follows another one of the same day, or the previous day's
        "i_last": F.when(is_m, F.struct(
            F.when(F.col("d_pair.paired"), F.lit(0.0)).otherwise(gap).alias("days"),
            F.when(F.col("d_pair.paired"), F.col("d_pair.km")).otherwise(F.when(cross_km > 0, cross_km)).alias("km"))),
    })


def vehicle_history(windows: DataFrame, appt: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Windows with everything known about their vehicle strictly before scoring."""
    log = day_log(appt) if log is None else log
    # counts of a day are mostly none or one: they are dealt as bits then, and as a list where any is more
    counts = [*COUNTERS, "d_pairs", "d_jumps"]
    few = F.greatest(*counts) <= 1
    events = log.withColumnRenamed("event_date", "_t").withColumns({
        "_few": F.when(few, _bits(F.col(c) for c in counts)),
        "_more": F.when(~few, F.array(*counts)),
    }).drop(*counts)
    rating = F.col("SurveyStarRating")
    surveys = (appt.where(F.col("vehicle_id").isNotNull() & F.col("SurveyResponseDate").isNotNull())
               .groupBy("vehicle_id", F.col("SurveyResponseDate").alias("_t"))
               .agg(F.count(F.lit(1)).alias("s_n"), F.min(rating).alias("s_min"), F.sum(rating).alias("s_sum"), F.count(rating).alias("s_rated"),
                    F.max_by(F.struct(rating.alias("r")), F.struct("event_date", "schedule_id")).alias("s_last")))
    rows = (events.unionByName(surveys, allowMissingColumns=True)
            .unionByName(windows.select("vehicle_id", F.col("scoring_date").alias("_t"), F.struct(*windows.columns).alias("_w")),
                         allowMissingColumns=True)).repartition("vehicle_id")
    rows = rows.withColumns({c: F.coalesce(F.col("_more")[i], F.getbit("_few", F.lit(i)).cast("long")) for i, c in enumerate(counts)}).drop("_few", "_more")
    # a window sorts before the events of its own day, so that day stays unseen
    before = (Window.partitionBy("vehicle_id").orderBy("_t", F.col("_w").isNull())
              .rowsBetween(Window.unboundedPreceding, -1))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = lambda c: F.last(c, ignorenulls=True).over(before)
    # intervals and payloads are made where the rows lie, so that the log is dealt once and without them
    is_log, on = F.col("n_appts").isNotNull(), lambda cond, value: F.when(cond, F.struct(F.col("_t").alias("d"), value.alias("v")))
    d = lambda cond: F.when(cond, F.col("_t"))
    rows = _interval_columns(rows, before).withColumns({
        "p_last": on(is_log, F.col("d_last")),
        "p_maint": F.when(F.col("d_maint").isNotNull(), F.struct(F.col("_t").alias("d"), F.col("d_maint").alias("v"), F.col("i_last").alias("i"))),
        "p_noshow": d(F.col("d_noshow")), "p_cancel": d(F.col("d_cancel")), "p_visit": d(F.col("d_visit")),
        "p_km": on(F.col("d_km").isNotNull(), F.col("d_km")),
        "p_survey": F.when(F.col("s_n").isNotNull(), F.struct(F.col("_t").alias("d"), F.col("s_last.r").alias("r"))),
    })
    out = rows.withColumns(
        {f"h_{c}": total(c) for c in (*COUNTERS, "i_n", "i_sum", "i_sq", "i_jump", "s_n")}
        | {f"h_{c}": known(c) for c in ("p_last", "p_maint", "p_noshow", "p_cancel", "p_visit", "p_km", "p_survey")}
        | {"h_s_min": F.min("s_min").over(before), "h_s_sum": F.sum("s_sum").over(before), "h_s_rated": F.sum("s_rated").over(before)}
    ).where(F.col("_w").isNotNull())
    since = lambda day: F.datediff(F.col("_w.scoring_date"), day)
    n_int = F.col("h_i_n")
    mean = F.col("h_i_sum") / n_int
    return out.select(
        "_w.*",
        *[F.col(f"h_{c}").cast("int").alias(c) for c in COUNTERS],
        "h_p_last.v.*", since(F.col("h_p_last.d")).alias("days_since_last_appt"),
        "h_p_maint.v.*", since(F.col("h_p_maint.d")).alias("days_since_last_maint"),
        F.col("h_p_maint.i.days").alias("last_interval_days"), F.col("h_p_maint.i.km").alias("last_interval_km"),
        F.when(n_int > 0, mean).alias("mean_interval_days"),
        F.when(n_int > 1, F.sqrt(F.greatest(F.col("h_i_sq") / n_int - mean * mean, F.lit(0.0)))).alias("std_interval_days"),
        n_int.cast("int").alias("n_intervals_known"), F.col("h_i_jump").cast("int").alias("n_numbering_jumps"),
        since(F.col("h_p_noshow")).alias("days_since_last_noshow"), since(F.col("h_p_cancel")).alias("days_since_last_cancel"),
        since(F.col("h_p_visit")).alias("days_since_last_visit"),
        F.col("h_p_km.v").alias("last_km"), since(F.col("h_p_km.d")).alias("days_since_last_km"),
        F.col("h_s_n").cast("int").alias("n_surveys"), F.when(F.col("h_p_survey.r").isNotNull(), F.col("h_s_min")).alias("min_rating"),
        F.col("h_p_survey.r").alias("last_rating"),
        F.when(F.col("h_p_survey.r").isNotNull(), F.col("h_s_sum") / F.col("h_s_rated")).alias("mean_rating"),
        since(F.col("h_p_survey.d")).alias("days_since_last_survey"))


def fleet_by_day(sales: DataFrame) -> DataFrame:
    """Vehicles bought by each customer up to and including each purchase day."""
    per_day = (sales.where(F.col("customer_id").isNotNull() & F.col("SalesDate").isNotNull())
               .groupBy("customer_id", F.col("SalesDate").alias("_fd")).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("customer_id").orderBy("_fd").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("customer_id", "_fd", F.sum("_n").over(w).alias("fleet_size_sales"))


def vehicles_seen_by_day(appt: DataFrame) -> DataFrame:
    """Distinct vehicles of each customer seen up to and including each day."""
    first = (appt.where(F.col("customer_id").isNotNull() & F.col("vehicle_id").isNotNull())
             .groupBy("customer_id", "vehicle_id").agg(F.min("event_date").alias("_vd")))
    per_day = first.groupBy("customer_id", "_vd").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("customer_id").orderBy("_vd").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("customer_id", "_vd", F.sum("_n").over(w).alias("n_vehicles_customer_agenda"))


def customer_history(f: DataFrame, appt: DataFrame, sales: DataFrame) -> DataFrame:
    """Fleet counts of the current customer before scoring, both sources in one pass per customer."""
    fleet = fleet_by_day(sales).withColumnRenamed("_fd", "_t")
    seen = vehicles_seen_by_day(appt).withColumnRenamed("_vd", "_t")
    probes = (f.where(F.col("customer_id").isNotNull())
              .select("customer_id", F.col("scoring_date").alias("_t")).distinct().withColumn("_probe", F.lit(True)))
    log = (fleet.unionByName(seen, allowMissingColumns=True).unionByName(probes, allowMissingColumns=True))
    before = (Window.partitionBy("customer_id").orderBy("_t", F.col("_probe").isNull())
              .rowsBetween(Window.unboundedPreceding, -1))
    hits = (log.select("customer_id", "_t", "_probe", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in FLEET])
            .where("_probe").select("customer_id", F.col("_t").alias("scoring_date"), *FLEET))
    return (f.join(hits, ["customer_id", "scoring_date"], "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in FLEET}))


def fleet_last(f: DataFrame) -> DataFrame:
    """Fleet counts after all other columns, customer and scoring date first."""
    lead = ["customer_id", "scoring_date"]
    return f.select(*lead, *[c for c in f.columns if c not in (*lead, *FLEET)], *FLEET)


def derived(f: DataFrame) -> DataFrame:
    """Age, geometry, pace and ratio features from columns already present."""
    ratio = lambda c: F.when(F.col("n_appts") > 0, F.col(c) / F.col("n_appts"))
    f = f.withColumn("vehicle_age_days", clip(F.datediff("scoring_date", "warranty_start"), 0))
    return f.withColumns({
        "vehicle_age_years": F.col("vehicle_age_days") / DAYS_PER_YEAR,
        "in_sales": as_int(F.col("in_sales")),
        "is_buyer": as_int(F.col("customer_id") == F.col("sales_customer_id")),
        "same_dealer_as_sale": as_int(F.col("last_maint_dealer") == F.col("sales_dealer_id")),
        "months_observable": F.col("history_days") / DAYS_PER_MONTH,
        "days_anchor_to_due": F.datediff("due_date", "anchor_date"),
        "km_per_year": F.col("km_rate_per_day") * DAYS_PER_YEAR,
        "km_expected_at_scoring": F.col("anchor_km") + F.col("km_rate_per_day") * F.datediff("scoring_date", "anchor_date"),
        "last_maint_late_days": F.col("last_interval_days") - 365,
        "last_maint_km_vs_plan": F.col("last_maint_km") - F.col("k_gen") * F.col("last_maint_number"),
        "last_interval_km_vs_k": F.col("last_interval_km") / F.col("k_gen"),
        "days_to_due_at_scoring": F.datediff("due_date", "scoring_date"),
        "noshow_rate": ratio("n_noshow"), "cancel_rate": ratio("n_cancel"), "fordpass_share": ratio("n_fordpass"),
        "maint_per_year_observed": F.col("n_maint") / (F.greatest("history_days", F.lit(30)) / DAYS_PER_YEAR),
        "scoring_month": F.month("scoring_date"),
        "is_first_service": as_int(F.col("anchor_type") == "warranty"),
    })


def build_features(windows: DataFrame, appt: DataFrame, sales: DataFrame, rules: SaleRules = SaleRules(),
                   master: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Feature row per window; window columns beyond the inputs (labels) pass through.

    master, log: stored vehicle master and ``day_log`` output, shared by every population scored.
    """
    extra = [c for c in windows.columns if c in LABEL_COLUMNS and c not in ("first_seen",)
             or c in ("poblacion_actual", "scoring_date_original")]
    w = windows.select(*WINDOW_INPUT, *extra)
    # fleet counts join the narrow windows, not the wide feature rows
    f = vehicle_history(customer_history(w, appt, sales), appt, log)
    static = (vehicle_master(appt, sales, rules) if master is None else master).select(
        "vehicle_id", "warranty_start", "generation", "model_year", "tma", "connected_status", "region", "in_sales",
        *(["sales_customer_id"] if "sales_customer_id" not in w.columns else []),
        "sales_dealer_id", "person_type", "business_unit", "sales_channel", "sales_state", "SalesDate")
    return derived(fleet_last(f.join(static, "vehicle_id", "left")))


def features_of_definitions(windows: DataFrame, appt: DataFrame, sales: DataFrame, rules: SaleRules = SaleRules(),
                            master: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Feature rows of the windows of many definitions (``definition``, windows without customer and id columns).

    History, customer and fleet depend on vehicle and scoring date alone: they are looked up once for each such probe,
    whatever the number of definitions that share it, in one ordered pass; each definition's own columns join them.
    """
    master = vehicle_master(appt, sales, rules) if master is None else master
    probes = windows.select("vehicle_id", "scoring_date").distinct()
    seen = (appt.where(F.col("vehicle_id").isNotNull() & F.col("customer_id").isNotNull())
            .select("vehicle_id", F.col("event_date").alias("_seen_at"), "schedule_id", F.col("customer_id").alias("_customer"), F.col("dealer_id").alias("last_dealer_id")))
    probes = asof_join(probes, seen, "vehicle_id", "scoring_date", "_seen_at", ["_customer", "last_dealer_id"], tie=["schedule_id"], left_unique=True)
    static = master.select("vehicle_id", "warranty_start", "model_year", "tma", "connected_status", "region", "in_sales", "sales_customer_id", "sales_dealer_id", "person_type", "business_unit", "sales_channel", "sales_state", "SalesDate")
    probes = probes.join(static, "vehicle_id", "left").withColumn("customer_id", F.coalesce("_customer", "sales_customer_id")).drop("_customer")
    known = fleet_last(vehicle_history(customer_history(probes, appt, sales), appt, log))
    own = windows.select(*[c for c in windows.columns if c in ("vehicle_id", "scoring_date") or c not in known.columns])
    return derived(own.join(known, ["vehicle_id", "scoring_date"]))


def leakage_violations(features: DataFrame) -> DataFrame:
    """Rows whose recency is zero or negative: one count per recency column, all expected to be 0."""
    return features.agg(*[F.sum((F.col(c) <= 0).cast("long")).alias(c) for c in RECENCIES if c in features.columns])
