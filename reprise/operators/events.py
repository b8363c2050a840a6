"""Agenda items to visits, vehicle master and maintenance events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise import fixed_values as fv
from reprise.functions.columns import flag
from reprise.params import SaleRules, WindowParams


def item_is_maintenance() -> Column:
    return F.col("ServiceMaintenance").isNotNull() | flag(F.col("ServiceName").rlike(fv.MAINTENANCE_NAME_PATTERN))


def item_class() -> Column:
    """13-way item taxonomy; the first matching rule wins."""
    name, kind = F.coalesce("ServiceName", F.lit("")), F.coalesce("ServiceType", F.lit("SIN_TIPO"))
    rules = [
        (F.col("ServiceMaintenance").isNotNull(), "MANT"),
        (name == fv.NAME_GUARANTEE, "GARANTIA"),
        (name == fv.NAME_CONTACTLESS, "CONTACTLESS"),
        (F.lower(kind) == fv.TYPE_CAMPAIGN_LOWER, "CAMPANA_RECALL"),
        (kind == fv.TYPE_DIAGNOSIS, "DIAG"),
        (kind == fv.TYPE_REPAIR, "REPAR"),
        (name == fv.NAME_OIL, "ACEITE_FILTRO"),
        (name.isin(fv.NAMES_INSPECTION), "INSPECCION"),
        (kind == fv.TYPE_GENERAL, "SERV_GRAL"),
        (kind == fv.TYPE_PICKUP, "PUD"),
        (kind.isin(fv.TYPES_MOBILE), "MOVIL"),
        (kind == "SIN_TIPO", "SIN_ITEM"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for cond, label in rules[1:]:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit("OTRO"))


def appointments(agenda: DataFrame, visit_columns: list[str] | None = None) -> DataFrame:
    """One row per ``schedule_id`` with item flags and the first non-null visit attributes.

    "First" follows the service number (missing last) and then the value itself, so the result does
    not depend on row order. Both the de-duplication and the collapse combine map-side, so a booking
    with very many items never lands in one task whole.
    """
    cols = visit_columns or fv.VISIT_COLUMNS
    items = agenda.dropDuplicates().withColumn("_rank", F.coalesce("ServiceMaintenance", F.lit(float("inf"))))

    kind = F.coalesce("ServiceType", F.lit(""))
    maint = item_is_maintenance()
    flags = {
        "has_maint": maint, "has_recall": F.lower(kind) == fv.TYPE_CAMPAIGN_LOWER, "has_diag": kind == fv.TYPE_DIAGNOSIS,
        "has_repair": kind == fv.TYPE_REPAIR, "has_guarantee": flag(F.col("ServiceName") == fv.NAME_GUARANTEE),
        "has_fixed_price": flag(F.col("ServiceFordFixedPriceFlag") == "Y"), "has_pud": flag(F.col("PickupDeliveryService") == "Yes"),
        "has_mobile": flag(F.col("MobileService") == "Yes"),
    }
    # items of a booking nearly always agree on its attributes: buffers of fixed size first, so that item rows are
    # hashed and not sorted; text is compared over the few variants that are left
    variants = items.groupBy("schedule_id", *[F.col(c).alias(f"_v_{c}") for c in cols]).agg(
        F.min("_rank").alias("_rank"), F.count(F.lit(1)).alias("_items"), F.min(F.when(maint, F.col("ServiceMaintenance"))).alias("_number"),
        *[F.bool_or(c).alias(f"_f_{k}") for k, c in flags.items()])

    def first_known(c: str) -> Column:
        value = F.col(f"_v_{c}")
        return F.min(F.when(value.isNotNull(), F.struct("_rank", value.alias("v")))).getField("v").alias(c)

    collapsed = variants.groupBy("schedule_id").agg(
        *[first_known(c) for c in cols],
        F.sum("_items").cast("int").alias("n_items"),
        F.bool_or("_f_has_maint").alias("has_maint"),
        F.min("_number").alias("maint_number"),
        *[F.bool_or(f"_f_{k}").alias(k) for k in flags if k != "has_maint"],
    )
    status = F.col("StatusARG")
    gap = F.datediff("EffectiveCheckinDate", "ScheduleDate")
    return (collapsed
            .withColumns({
                "completed": flag(status == fv.ST_DONE),
                "completed_no_os": flag(status == fv.ST_DONE_NO_ORDER),
                "no_show": flag(status == fv.ST_NO_SHOW),
                "cancelled": flag(status == fv.ST_CANCELLED),
                "pending": flag(status.isin(fv.ST_SCHEDULED, fv.ST_IN_PROGRESS)),
                "event_date": F.coalesce(F.when(gap.between(-45, 45), F.col("EffectiveCheckinDate")),
                                         F.col("ScheduleDate")),
            })
            .withColumn("is_completed_maintenance", F.col("completed") & F.col("has_maint")))


def vehicle_master(appt: DataFrame, sales: DataFrame, rules: SaleRules = SaleRules()) -> DataFrame:
    """One row per vehicle: first known visit attributes, outer-joined with its valid sale."""
    when_seen = F.struct("event_date", "schedule_id")

    def earliest(c: str, alias: str) -> Column:
        value = F.col(c)
        return F.min_by(value, F.when(value.isNotNull(), when_seen)).alias(alias)

    seen = (appt.where(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id").agg(
        earliest("WarrantyStartDate", "warranty_agenda"),
        earliest("ShortVehicleModelGroupTreated", "generation_agenda"),
        earliest("ModelYear", "model_year_agenda"),
        earliest("TMA", "tma"),
        earliest("ConnectedStatusARG", "connected_status"),
        earliest("Region", "region"),
        earliest("DealerStateOrZone", "dealer_zone_first"),
        F.min("event_date").alias("first_seen"),
        F.count(F.lit(1)).alias("n_appts_total")))
    valid = valid_sales(sales, rules)
    sold = valid.where(F.col("vehicle_id").isNotNull()).select(
        "vehicle_id",
        F.col("customer_id").alias("sales_customer_id"), F.col("dealer_id").alias("sales_dealer_id"),
        F.col("PersonType").alias("person_type"), F.col("BusinessUnit").alias("business_unit"),
        F.col("SalesChannel").alias("sales_channel"), "SalesDate", "DeliveryDate",
        F.col("WarrantyStartDate").alias("warranty_sales"), F.col("ModelYear").alias("model_year_sales"),
        F.col("ModelCode").alias("sales_model_code"), F.col("State").alias("sales_state"))
    code = F.col("sales_model_code")
    from_code = (F.when(code.endswith(fv.MODEL_CODE_NEW_SUFFIX) | (code == fv.MODEL_CODE_NEW_EXACT),
                        F.lit(rules.generation_new))
                 .when(code.endswith(fv.MODEL_CODE_OLD_SUFFIX), F.lit(rules.generation_old)))
    return (seen.join(sold, "vehicle_id", "full_outer")
            .withColumns({
                "in_sales": F.col("sales_customer_id").isNotNull(),
                "in_agenda": F.col("first_seen").isNotNull(),
                "warranty_start": F.coalesce("warranty_sales", "warranty_agenda"),
                "model_year": F.coalesce(F.col("model_year_sales").cast("double"), F.col("model_year_agenda")),
                "generation": F.coalesce(F.col("generation_agenda"), from_code),
            })
            .drop("generation_agenda"))


def valid_sales(sales: DataFrame, rules: SaleRules = SaleRules()) -> DataFrame:
    delivery = F.col("DeliveryDate")
    return sales.where((F.col("Status") == rules.status) & (F.col("ModelShortName") == rules.model)
                       & (delivery.isNull() | (delivery >= F.lit(rules.min_delivery).cast("date"))))


def clean_km(km: Column) -> Column:
    return F.when(km.between(100, 1_000_000), km)


def event_km(source: str) -> Column:
    return F.col({"current": "VehicleCurrentKM", "km": "KM"}[source]).cast("double")


def maintenance_days(appt: DataFrame, km_source: str = "current") -> DataFrame:
    """Completed maintenances at vehicle-day grain, before duplicate removal."""
    km = clean_km(event_km(km_source))
    # an unknown reading sorts after every known one
    order = F.struct(F.col("_km").isNull().alias("a"), F.col("_km").alias("b"), F.col("schedule_id").alias("c"))

    def latest(c: str, alias: str | None = None) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(alias or c)

    return (appt.where(F.col("is_completed_maintenance") & F.col("vehicle_id").isNotNull())
            .withColumn("_km", km)
            .groupBy("vehicle_id", "event_date")
            .agg(F.max("_km").alias("km"), latest("customer_id"), latest("dealer_id"),
                 F.min("maint_number").alias("maint_number"), latest("schedule_id"),
                 latest("ScheduleSource", "source")))


def _by_day(*order) -> Window:
    return Window.partitionBy("vehicle_id").orderBy(*(order or ("event_date",)))


def drop_split_visits(days: DataFrame, limit_days: int = 30) -> DataFrame:
    """Remove a day whose predecessor carries the same service number at most ``limit_days`` before.

    The comparison is with the direct predecessor, kept or not (chain variant).
    """
    w = _by_day()
    return (days
            .withColumns({"_pn": F.lag("maint_number").over(w), "_pd": F.lag("event_date").over(w)})
            .where(~flag((F.datediff("event_date", "_pd") <= limit_days) & (F.col("maint_number") == F.col("_pn"))))
            .drop("_pn", "_pd"))


def monotonic_km(days: DataFrame, col: str = "km") -> DataFrame:
    """Null out a reading below the running maximum.

    A reading that follows an unknown one is not checked; the running maximum is only known on
    rows that have a reading.
    """
    w = _by_day()
    running = F.when(F.col(col).isNotNull(), F.max(col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (days.withColumn("_run", running).withColumn("_prev", F.lag("_run").over(w))
            .withColumn(col, F.when(F.col("_prev").isNull() | (F.col(col) >= F.col("_prev")), F.col(col)))
            .drop("_run", "_prev"))


def maintenance_events(appt: DataFrame, params: WindowParams = WindowParams()) -> DataFrame:
    """One row per vehicle and day of completed maintenance.

    The collapse to vehicle-days combines map-side, so the per-vehicle windows that follow see at
    most one row per calendar day, however many bookings a vehicle has.
    """
    days = maintenance_days(appt, params.km_source)
    return monotonic_km(drop_split_visits(days, params.split_visit_days))


def event_rule(appt: DataFrame, cutoff: dt.date, limit_days: int = 30) -> DataFrame:
    """The final event rule on every booking, with the reason why a maintenance is dropped.

    A network visit is a completed booking (with or without order) of a known vehicle up to the cut-off. Of completed
    maintenances the first booking of a day counts, and of two with one service number within ``limit_days`` the first.
    Bookings of a day are combined before they are ordered, so the ordered rows of a vehicle are its days.
    """
    visit = flag(F.col("vehicle_id").isNotNull() & (F.col("ScheduleDate") <= F.lit(cutoff)) & (F.col("completed") | F.col("completed_no_os")))
    a = appt.select("schedule_id", "vehicle_id", "event_date", "maint_number", visit.alias("visita_red"), (visit & F.col("completed") & F.col("has_maint")).alias("_cand"))
    days = a.where("_cand").groupBy("vehicle_id", "event_date").agg(F.min("schedule_id").alias("_first"), F.min_by("maint_number", "schedule_id").alias("_n"))
    order = Window.partitionBy("vehicle_id").orderBy("event_date")
    again = flag((F.col("_n") == F.lag("_n").over(order)) & (F.datediff("event_date", F.lag("event_date").over(order)) <= limit_days))
    out = a.join(days.withColumn("_again", again), ["vehicle_id", "event_date"], "left")
    first = flag(F.col("_cand") & (F.col("schedule_id") == F.col("_first")))
    return out.select("schedule_id", "visita_red", (first & ~F.col("_again")).alias("mant_completado"), (F.col("_cand") & ~first).alias("dup_mant_dia"), (first & F.col("_again")).alias("dup_mant_n30"))


def fold_duplicates(days: DataFrame, limit_days: int = 30) -> DataFrame:
    """Duplicate removal against the last *kept* day (no chain effect).

    Runs as one fold over each vehicle's day list, at most one entry per calendar day.
    """
    entry = F.struct("event_date", "maint_number")
    zero = F.array().cast("array<struct<event_date:date,maint_number:double>>")

    def step(kept, e):
        last = F.try_element_at(kept, F.lit(-1))
        dup = flag((F.datediff(e["event_date"], last["event_date"]) <= limit_days)
                   & (e["maint_number"] == last["maint_number"]))
        return F.when(dup, kept).otherwise(F.concat(kept, F.array(e)))

    listed = days.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    return (listed.select("vehicle_id", F.explode(F.aggregate("es", zero, step)).alias("e"))
            .select("vehicle_id", "e.event_date", "e.maint_number"))
