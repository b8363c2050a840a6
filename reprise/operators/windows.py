"""Due windows per vehicle: anchors, usage rate, due date, label and status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.functions.columns import clip, flag, literal_map
from reprise.operators.asof import asof_join
from reprise.operators.events import maintenance_events, vehicle_master
from reprise.operators.stats import exact_percentiles
from reprise.runtime import cut_lineage
from reprise.params import DAYS_PER_YEAR, DataSpan, SaleRules, WindowParams

WINDOW_COLUMNS = [
    "window_id", "vehicle_id", "customer_id", "customer_id_at_scoring", "sales_customer_id", "window_n",
    "anchor_type", "anchor_date", "anchor_km", "k_gen", "km_rate_per_day", "rate_source", "due_time",
    "due_km", "due_date", "binding_rule", "scoring_date", "horizon_end", "next_maint_date",
    "next_maint_km", "days_next_vs_due", "next_visit_date", "history_days", "status", "label_churn",
    "label_no_visit", "last_dealer_id",
]


def _date(d: dt.date) -> Column:
    return F.lit(d).cast("date")


def maintenance_anchors(maint: DataFrame, vm: DataFrame) -> DataFrame:
    """A window starts at every maintenance and at the start of warranty (odometer 0)."""
    done = maint.select("vehicle_id", F.col("event_date").alias("anchor_date"), F.col("km").alias("anchor_km"),
                        F.lit("maintenance").alias("anchor_type"))
    start = vm.where(F.col("warranty_start").isNotNull()).select(
        "vehicle_id", F.col("warranty_start").alias("anchor_date"), F.lit(0.0).alias("anchor_km"),
        F.lit("warranty").alias("anchor_type"))
    return done.unionByName(start)


def plan_anchors(vm: DataFrame, cycle_days: int, cutoff: dt.date) -> DataFrame:
    """Warranty start plus k cycles up to the cut-off."""
    start = F.col("warranty_start")
    steps = F.floor(F.datediff(_date(cutoff), start) / cycle_days).cast("int")
    return (vm.where(start <= _date(cutoff))
            .select("vehicle_id", F.explode(F.sequence(F.lit(0), steps)).alias("_k"), start.alias("_start"))
            .select("vehicle_id", F.date_add("_start", F.col("_k") * cycle_days).alias("anchor_date"),
                    F.lit(None).cast("double").alias("anchor_km"), F.lit("plan").alias("anchor_type")))


def next_events(anchors: DataFrame, maint: DataFrame, appt: DataFrame) -> DataFrame:
    """Next maintenance and next completed visit strictly after each anchor.

    One log per vehicle (anchors, maintenance days, visit days; each at most one row per calendar
    day) and one ordered pass backwards in time answer both look-ups with a single exchange.
    """
    a_cols = [c for c in anchors.columns if c != "vehicle_id"]
    a_type = anchors.select(F.struct(*a_cols).alias("s")).schema["s"].dataType
    lane = {"_a": F.lit(None).cast(a_type), "_m": F.lit(None).cast("struct<d:date,km:double>"),
            "_v": F.lit(None).cast("date")}

    def rows(df: DataFrame, day: str, **own: Column) -> DataFrame:
        return df.select("vehicle_id", F.unix_date(day).alias("_t"), *[own.get(k, v).alias(k) for k, v in lane.items()])

    visits = appt.where(F.col("completed") & F.col("vehicle_id").isNotNull()).select("vehicle_id", "event_date").distinct()
    log = (rows(anchors, "anchor_date", _a=F.struct(*a_cols))
           .unionByName(rows(maint, "event_date", _m=F.struct(F.col("event_date").alias("d"), F.col("km").alias("km"))))
           .unionByName(rows(visits, "event_date", _v=F.col("event_date"))))
    later = (Window.partitionBy("vehicle_id").orderBy(F.col("_t").desc())
             .rangeBetween(Window.unboundedPreceding, -1))
    nxt = log.withColumns({"_nm": F.last("_m", ignorenulls=True).over(later),
                           "_nv": F.last("_v", ignorenulls=True).over(later)}).where(F.col("_a").isNotNull())
    # the key of the log itself, not a copy of it: rows stay known as dealt by vehicle for the steps that follow
    return nxt.select(*[c if c == "vehicle_id" else F.col(f"_a.{c}") for c in anchors.columns], F.col("_nm.d").alias("next_maint_date"), F.col("_nm.km").alias("next_maint_km"),
                      F.col("_nv").alias("next_visit_date"))


def usage_rate(anchors: DataFrame) -> DataFrame:
    """Individual km/day known at the anchor: odometer over age, else slope from the previous anchor."""
    w = Window.partitionBy("vehicle_id").orderBy("anchor_date", "anchor_type")
    age = F.datediff("anchor_date", "warranty_start")
    gap = F.datediff("anchor_date", "_prev_date")
    by_age = F.when(age >= 90, F.col("anchor_km") / age)
    slope = F.when(gap >= 60, (F.col("anchor_km") - F.col("_prev_km")) / gap)
    raw = F.coalesce(by_age, F.when(slope > 0, slope))
    plausible = raw.between(2000 / DAYS_PER_YEAR, 150000 / DAYS_PER_YEAR)
    return (anchors.withColumns({"_prev_date": F.lag("anchor_date").over(w), "_prev_km": F.lag("anchor_km").over(w)})
            .withColumn("own_rate", F.when(plausible, raw)).drop("_prev_date", "_prev_km"))


def rate_with_fallback(rated: DataFrame) -> DataFrame:
    """Missing rates take the median of the generation, then the overall median."""
    known = rated.where(F.col("anchor_type") == "maintenance").select("generation", "own_rate")
    by_gen = (exact_percentiles(known.where(F.col("generation").isNotNull()), ["generation"], "own_rate", [0.5], ["_gen_rate"])
              .drop("n"))
    overall = exact_percentiles(known, [], "own_rate", [0.5], ["_all_rate"]).select("_all_rate")
    # one row a generation: sent to all tasks instead of dealing the anchors by so few keys
    return (rated.join(F.broadcast(by_gen), "generation", "left")
            .withColumns({
                "rate_source": F.when(F.col("own_rate").isNotNull(), F.lit("individual")).otherwise(F.lit("generacion")),
                "km_rate_per_day": F.coalesce("own_rate", "_gen_rate", overall.scalar()),
            }).drop("_gen_rate", "own_rate"))


def due_dates(rated: DataFrame, params: WindowParams) -> DataFrame:
    """Due date as the earlier of the time and distance limits, never before the floor."""
    anchor = F.col("anchor_date")
    first = F.col("anchor_type") == "warranty"
    days_to_km = F.rint(clip(F.col("k_gen") / F.col("km_rate_per_day"), upper=3650.0)).cast("int")
    due_time, due_km = F.date_add(anchor, params.cycle_days), F.date_add(anchor, F.col("_days_to_km"))
    floor = F.date_add(anchor, params.min_gap_days)
    # least/greatest skip nulls, which is what a missing rate needs here
    due = F.greatest(F.least(due_time, due_km), floor)
    rule = (F.when(first, F.lit("primer_service_tiempo")).when(due == floor, F.lit("piso"))
            .when(due_km < due_time, F.lit("km")).otherwise(F.lit("tiempo")))
    out = (rated.withColumn("_days_to_km", days_to_km)
           .withColumns({
               "due_time": due_time,
               "due_km": F.when(~first, due_km),
               "binding_rule": rule,
               "due_date": F.when(first, F.date_add(anchor, params.first_due_days)).otherwise(due),
           })
           .withColumns({
               "km_rate_per_day": F.when(~first, F.col("km_rate_per_day")),
               "rate_source": F.when(first, F.lit("sin_km")).otherwise(F.col("rate_source")),
           }).drop("_days_to_km"))
    if params.label_mode == "mes_calendario":
        return out.withColumns({"scoring_date": F.trunc("due_date", "month"), "horizon_end": F.last_day("due_date")})
    return out.withColumns({"scoring_date": F.date_sub("due_date", params.lead_days),
                            "horizon_end": F.date_add("due_date", params.horizon_days)})


def label_and_status(w: DataFrame, params: WindowParams, span: DataSpan) -> DataFrame:
    """Right-censored labels and the window status; the last listed rule has precedence."""
    start, cutoff = _date(span.start), _date(span.cutoff)
    scoring, horizon = F.col("scoring_date"), F.col("horizon_end")

    def within(d: str) -> Column:
        return flag((F.col(d) > scoring) & (F.col(d) <= horizon))

    hist_start = F.greatest(F.least("warranty_start", "first_seen"), start)
    w = w.withColumns({
        "days_next_vs_due": F.datediff("next_maint_date", "due_date"),
        "history_days": F.greatest(F.datediff(scoring, hist_start), F.lit(0)),
    })
    status = (F.when(scoring > cutoff, F.lit("futura"))
              .when(scoring < start, F.lit("fuera_de_rango"))
              .when(flag(F.col("next_maint_date") <= scoring), F.lit("preempted"))
              .when(horizon > F.date_sub(cutoff, params.label_margin_days), F.lit("censurada")))
    if params.min_history_days > 0:
        status = status.when(F.col("history_days") < params.min_history_days, F.lit("poca_historia"))
    w = w.withColumn("status", status.otherwise(F.lit("evaluable")))
    open_label = F.col("status") == "evaluable"
    return w.withColumns({
        "label_churn": F.when(open_label, F.when(within("next_maint_date"), 0.0).otherwise(1.0)),
        "label_no_visit": F.when(open_label, F.when(within("next_visit_date"), 0.0).otherwise(1.0)),
    })


def customer_at(w: DataFrame, appt: DataFrame) -> DataFrame:
    """Customer and dealer of the last booking of any status before scoring."""
    seen = (appt.where(F.col("vehicle_id").isNotNull() & F.col("customer_id").isNotNull())
            .select("vehicle_id", F.col("event_date").alias("_seen_at"), "schedule_id",
                    F.col("customer_id").alias("customer_id_at_scoring"), F.col("dealer_id").alias("last_dealer_id")))
    out = asof_join(w, seen, "vehicle_id", "scoring_date", "_seen_at", ["customer_id_at_scoring", "last_dealer_id"],
                    tie=["schedule_id"], left_unique=True)
    return out.withColumn("customer_id", F.coalesce("customer_id_at_scoring", "sales_customer_id"))


def anchors_with_rates(appt: DataFrame, sales: DataFrame, params: WindowParams, span: DataSpan,
                       rules: SaleRules = SaleRules(), master: DataFrame | None = None,
                       maint: DataFrame | None = None) -> DataFrame:
    """Anchors with next events, vehicle attributes and usage rate (before fallback)."""
    vm = vehicle_master(appt, sales, rules) if master is None else master
    maint = maintenance_events(appt, params) if maint is None else maint
    anchors = (maintenance_anchors(maint, vm) if params.anchor == "last_maintenance"
               else plan_anchors(vm, params.cycle_days, span.cutoff))
    static = vm.select("vehicle_id", "warranty_start", "generation", "first_seen", "sales_customer_id")
    a = next_events(anchors, maint, appt).join(static, "vehicle_id", "left")
    return usage_rate(a.withColumn("k_gen", km_between(params)))


def km_between(params: WindowParams) -> Column:
    """Distance between two services of a vehicle's generation."""
    return F.coalesce(literal_map(dict(params.km_by_generation), F.col("generation")), F.lit(params.km_interval))


def dated_windows(rated: DataFrame, params: WindowParams, span: DataSpan) -> DataFrame:
    """Due dates, labels and status of rated anchors; of two anchors on one scoring date the later rules."""
    return later_anchor(label_and_status(due_dates(rated, params), params, span))


def later_anchor(w: DataFrame) -> DataFrame:
    """Of two anchors on one scoring date the later."""
    newest = Window.partitionBy("vehicle_id", "scoring_date").orderBy(F.col("anchor_date").desc(), F.col("anchor_type").desc())
    return w.withColumn("_pos", F.row_number().over(newest)).where(F.col("_pos") == 1).drop("_pos")


def build_windows(appt: DataFrame, sales: DataFrame, params: WindowParams = WindowParams(),
                  span: DataSpan = DataSpan(), rules: SaleRules = SaleRules(), master: DataFrame | None = None,
                  maint: DataFrame | None = None) -> DataFrame:
    """One row per vehicle and scoring date with label and status.

    master, maint: stored vehicle master and maintenance events, when a run already has them.
    """
    # read several times below (two medians and the windows): materialised once
    rated = cut_lineage(anchors_with_rates(appt, sales, params, span, rules, master, maint))
    # dealt by vehicle at once, which suits both orderings that follow; a vehicle has two anchors a day at most
    rated = rate_with_fallback(rated).repartition("vehicle_id")
    w = later_anchor(due_dates(rated, params).select(*rated.columns, "scoring_date"))
    w = w.withColumn("window_n", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("scoring_date")))
    # dates, labels and ids follow from the anchor: made anew after the rows were dealt, not dealt with them
    w = label_and_status(due_dates(customer_at(w, appt), params), params, span)
    return w.withColumn("window_id", F.concat_ws("_", "vehicle_id", F.date_format("scoring_date", "yyyyMMdd"))).select(*WINDOW_COLUMNS)


def current_population(windows: DataFrame, cutoff: dt.date, days_ahead: int = 30) -> DataFrame:
    """Windows to score today, one row per vehicle.

    Open windows keep the scoring date they were opened with; windows that open within
    ``days_ahead`` are scored on the day after the cut-off.
    """
    today = F.date_add(_date(cutoff), 1)
    is_open = (F.col("status") == "censurada") & F.col("next_maint_date").isNull()
    is_next = (F.col("status") == "futura") & (F.col("scoring_date") <= F.date_add(_date(cutoff), days_ahead))
    pop = windows.where(is_open | is_next).withColumns({
        "poblacion_actual": F.when(is_open, F.lit("en_ventana")).otherwise(F.lit("entra_en_30_dias")),
        "scoring_date_original": F.col("scoring_date"),
    })
    one = Window.partitionBy("vehicle_id").orderBy("poblacion_actual", "scoring_date")
    return (pop.withColumn("_pos", F.row_number().over(one)).where(F.col("_pos") == 1).drop("_pos")
            .withColumn("scoring_date", F.when(F.col("poblacion_actual") == "en_ventana", F.col("scoring_date")).otherwise(today)))


def pending_bookings(appt: DataFrame, cutoff: dt.date) -> DataFrame:
    """Earliest pending booking after the cut-off per vehicle."""
    return (appt.where(F.col("pending") & (F.col("ScheduleDate") > _date(cutoff)) & F.col("vehicle_id").isNotNull())
            .groupBy("vehicle_id").agg(F.min("ScheduleDate").alias("fecha_turno_agendado")))


def monthly_volume(windows: DataFrame, cutoff: dt.date) -> DataFrame:
    return (windows.where(F.col("status").isin("evaluable", "censurada"))
            .groupBy(F.trunc("scoring_date", "month").alias("mes")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("mes") <= F.trunc(_date(cutoff), "month")))


def window_summary(w: DataFrame) -> DataFrame:
    """One-row sensitivity summary of a window definition."""
    ev = F.col("status") == "evaluable"
    cand = (F.col("status").isin("evaluable", "preempted") & F.col("next_maint_date").isNotNull()
            & (F.datediff("next_maint_date", "anchor_date") <= 548))
    in_h = (F.col("next_maint_date") > F.col("scoring_date")) & (F.col("next_maint_date") <= F.col("horizon_end"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # days from due date: a bounded set of whole numbers, so the exact percentile map is bounded too
    late = F.when(ev & (F.col("label_churn") == 0), F.col("days_next_vs_due"))
    return w.agg(
        one(ev).alias("n_evaluables"),
        F.avg(F.when(ev, F.col("label_churn"))).alias("churn_rate"),
        (one(F.col("status") == "preempted") / F.greatest(one(F.col("status") != "fuera_de_rango"), F.lit(1))).alias("pct_preempted"),
        F.avg(F.when(ev, (F.col("binding_rule") == "piso").cast("double"))).alias("pct_piso"),
        F.avg(F.when(ev, (F.col("binding_rule") == "km").cast("double"))).alias("pct_km"),
        F.avg(F.when(cand, in_h.cast("double"))).alias("captura_retornos_18m"),
        one(cand).alias("n_retornos_18m"),
        F.percentile(late, F.lit(0.5)).alias("mediana_dias_retorno_vs_due"))


def windows_by_definition(appt: DataFrame, sales: DataFrame, grid: dict[str, WindowParams], span: DataSpan, rules: SaleRules = SaleRules()) -> dict[str, DataFrame]:
    """Dated windows of every named parameter set.

    Anchors and rates are built once for each set of parameters that they depend on and dealt by vehicle once; distances,
    lead, horizon and label rules only date them anew where they lie. Inputs should be stored by the caller.
    """
    master = cut_lineage(vehicle_master(appt, sales, rules))
    maint, rated, out = {}, {}, {}
    for name, p in grid.items():
        events = (p.km_source, p.split_visit_days)
        if events not in maint:
            maint[events] = cut_lineage(maintenance_events(appt, p))
        d = WindowParams()
        shared = p.with_(lead_days=d.lead_days, horizon_days=d.horizon_days, label_mode=d.label_mode, label_margin_days=d.label_margin_days, first_due_days=d.first_due_days, min_history_days=d.min_history_days,
                         km_by_generation=d.km_by_generation, km_interval=d.km_interval)
        if shared not in rated:
            rated[shared] = cut_lineage(rate_with_fallback(cut_lineage(anchors_with_rates(appt, sales, p, span, rules, master, maint[events])))).repartition("vehicle_id")
        out[name] = dated_windows(rated[shared].withColumn("k_gen", km_between(p)), p, span)
    return out


def window_sensitivity(appt: DataFrame, sales: DataFrame, grid: dict[str, WindowParams], span: DataSpan,
                       rules: SaleRules = SaleRules()) -> DataFrame:
    """One summary row per named parameter set."""
    out = None
    for name, w in windows_by_definition(appt, sales, grid, span, rules).items():
        row = window_summary(w).select(F.lit(name).alias("params"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def default_grid(base: WindowParams = WindowParams()) -> dict[str, WindowParams]:
    """Distance rules x lead x horizon, plus single variants around the default."""
    k = dict(base.km_by_generation)
    k_variants = {"K_GEN": k, "K_15": {g: (15000.0 if v == 16000.0 else v) for g, v in k.items()},
                  "K_16": {g: 16000.0 for g in k}, "K_TIME": {g: 1e9 for g in k}}
    grid = {}
    for kn, kv in k_variants.items():
        for lead in (30, 60):
            for h in (60, 90, 120, 180):
                grid[f"{kn}|lead={lead}|h={h}"] = base.with_(km_by_generation=tuple(kv.items()), lead_days=lead, horizon_days=h)
    grid["calendar_month"] = base.with_(label_mode="mes_calendario", label_margin_days=0)
    grid["first_due=270"] = base.with_(first_due_days=270)
    grid["first_due=365"] = base.with_(first_due_days=365)
    grid["anchor=plan"] = base.with_(anchor="plan")
    grid["km_snapshot"] = base.with_(km_source="km")
    return grid


def horizon_crossing(w: DataFrame, train_end: dt.date, valid_end: dt.date) -> DataFrame:
    """Evaluable windows whose outcome horizon passes the end of their split period."""
    s, h = F.col("scoring_date"), F.col("horizon_end")
    period = F.when(s <= _date(train_end), F.lit("train")).when(s <= _date(valid_end), F.lit("valid"))
    end = F.when(period == "train", _date(train_end)).otherwise(_date(valid_end))
    return (w.where(F.col("status") == "evaluable").withColumn("period", period).where(F.col("period").isNotNull())
            .groupBy("period").agg(F.count(F.lit(1)).alias("windows"), F.sum((h > end).cast("long")).alias("crossing"),
                                   F.avg((h > end).cast("double")).alias("share")))


def temporal_support(w: DataFrame, train_end: dt.date, valid_end: dt.date) -> DataFrame:
    """Dates, size and base rate of each split period."""
    s = F.col("scoring_date")
    period = (F.when(s <= _date(train_end), F.lit("train")).when(s <= _date(valid_end), F.lit("valid")).otherwise(F.lit("test")))
    return (w.where(F.col("label_churn").isNotNull()).groupBy(period.alias("period"))
            .agg(F.min(s).alias("first_scoring"), F.max(s).alias("last_scoring"), F.count(F.lit(1)).alias("n"),
                 F.avg("label_churn").alias("base_rate")))
