"""The driver tables read as a service agenda and a sales extract.

An order is a booking, its line items are service items, the ordering customer is the vehicle.
Every domain column is an expression over order, item, part and customer columns; the same text is
used by the Spark plan and by the reference SQL, because both dialects accept it.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from reprise import fixed_values as fv
from reprise.operators.events import appointments, item_class, maintenance_events, vehicle_master
from reprise.operators.features import build_features, day_log
from reprise.operators.attribution import top_drivers
from reprise.operators.business import segment_by_capacity
from reprise.operators.contact import contact_candidates
from reprise.operators.evaluate import rank_scores
from reprise.operators.model import heuristic_score
from reprise.operators.windows import build_windows, current_population, pending_bookings
from reprise.params import BusinessParams, ContactPolicy, DataSpan, SaleRules, SplitParams, WindowParams
from reprise.runtime import folder_version, row_tasks, stage_table

SPAN = DataSpan(start=dt.date(1995, 1, 1), cutoff=dt.date(2001, 2, 28))
RULES = SaleRules(model="PICKUP", min_delivery="1993-01-01", generation_new="BUILDING", generation_old="MACHINERY")
PARAMS = WindowParams(km_by_generation=(("BUILDING", 16000.0), ("MACHINERY", 10000.0), ("HOUSEHOLD", 12000.0)),
                      km_interval=14000.0)
SPLIT = SplitParams(train_end=dt.date(1998, 12, 31), valid_end=dt.date(1999, 9, 30))
BUSINESS = BusinessParams(monthly_capacity=40)
POLICY = ContactPolicy(capacity=60)

#: Items a task, whose wide rows a core holds several times over. Stored bytes would not do: they tell of compression.
ITEM_ROWS = 100_000

_DAY = "CAST(o_orderdate AS DATE)"
_AGE = "((year(o_orderdate) - 1994) * 365 + dayofyear(o_orderdate))"
_STATUS = """CASE WHEN o_orderstatus = 'F' THEN '(60) Concluido'
 WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN '(80) No asistio'
 WHEN o_orderstatus = 'P' AND o_totalprice < 220000 THEN '(70) Cancelado'
 WHEN o_orderstatus = 'P' AND o_totalprice < 300000 THEN '(90) Concluido sin OS'
 WHEN o_orderstatus = 'P' AND o_totalprice < 480000 THEN '(60) Concluido'
 WHEN o_orderstatus = 'O' AND o_totalprice < 250000 THEN '(60) Concluido'
 WHEN o_orderstatus = 'O' AND o_totalprice < 350000 THEN '(70) Cancelado'
 WHEN o_orderstatus = 'O' AND o_totalprice < 470000 THEN '(30) Agendado'
 ELSE '(40) En progreso' END"""
_DONE = f"({_STATUS}) = '(60) Concluido'"
_NUMBER = "CAST(year(o_orderdate) - 1994 + CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS DOUBLE)"
_IS_MAINT = "p_type IN ('PROMO', 'ECONOMY', 'STANDARD')"
_SURVEYED = f"{_DONE} AND o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW')"

AGENDA = {
    "schedule_id": "CAST(o_orderkey AS STRING)",
    "vehicle_id": "CASE WHEN o_totalprice >= 3000 THEN concat('V', CAST(o_custkey AS STRING)) END",
    "customer_id": """CASE WHEN o_totalprice > 497000 THEN NULL
 WHEN o_orderpriority = '1-URGENT' AND c_acctbal > 4000 THEN concat('N', CAST(c_nationkey AS STRING))
 WHEN c_acctbal < 1500 AND o_orderdate >= TIMESTAMP '1998-07-01 00:00:00' THEN concat('T', CAST(o_custkey AS STRING))
 ELSE concat('C', CAST(CAST(floor(o_custkey / 2) AS BIGINT) AS STRING)) END""",
    "dealer_id": """CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AND l_suppkey IS NOT NULL
 THEN concat('D', CAST(l_suppkey AS STRING)) WHEN o_totalprice > 494000 THEN NULL
 ELSE concat('D', CAST(c_nationkey AS STRING)) END""",
    "Region": "concat('R', CAST(CAST(floor(c_nationkey / 5) AS BIGINT) AS STRING))",
    "DealerStateOrZone": "concat('Z', CAST(c_nationkey AS STRING))",
    "ScheduleDate": _DAY,
    "ScheduleDateTime": "o_orderdate",
    "StatusARG": _STATUS,
    "ScheduleStatus": "o_orderstatus",
    "ScheduleSource": """CASE o_orderpriority WHEN '1-URGENT' THEN 'Dealer' WHEN '2-HIGH' THEN 'FordPass'
 WHEN '3-MEDIUM' THEN 'WEB' WHEN '4-NOT SPECIFIED' THEN 'Mobile' WHEN '5-LOW' THEN 'CAF' END""",
    "IsReschedule": "CASE WHEN o_orderstatus = 'O' THEN 'Y' WHEN o_totalprice < 250000 THEN 'N' END",
    "ScheduleReturn": "CASE WHEN o_totalprice BETWEEN 200000 AND 230000 THEN 'Y' ELSE 'N' END",
    "ShortVehicleModelGroupTreated": "CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END",
    "VehicleModelGroup": "c_mktsegment",
    "ModelYear": "CAST(1990 + CAST(floor(c_acctbal / 2500) AS BIGINT) AS DOUBLE)",
    "TMA": "concat('T', CAST(c_nationkey AS STRING))",
    "KM": "2900 * (15 + (c_acctbal + 1000) / 200)",
    "VehicleCurrentKM": f"CASE WHEN o_totalprice >= 20000 THEN {_AGE} * (15 + (c_acctbal + 1000) / 200) + o_totalprice / 50 END",
    "EffectiveCheckinDate": f"""CASE WHEN {_DONE} AND l_discount > 0.095 THEN CAST(l_shipdate AS DATE)
 WHEN {_DONE} AND l_linenumber IS NOT NULL THEN {_DAY} + (l_linenumber - 2) END""",
    "EffectiveCheckoutDate": f"CASE WHEN {_DONE} AND l_quantity IS NOT NULL THEN {_DAY} + (6 + CAST(floor(l_quantity / 10) AS INT)) END",
    "DaysInDealer": f"CASE WHEN {_DONE} THEN l_quantity / 5 - 2 END",
    "WorkDaysInDealer": f"CASE WHEN {_DONE} THEN l_quantity / 8 END",
    "EffectiveTerm": f"CASE WHEN {_DONE} THEN l_quantity / 2 END",
    "NeededTowing": "CASE WHEN o_totalprice > 470000 THEN 'Y' ELSE 'N' END",
    "CustomerWaiting": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END",
    "PickupDeliveryService": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Yes' ELSE 'No' END",
    "MobileService": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 35 THEN 'Yes' ELSE 'No' END",
    "SurveyStarRating": f"CASE WHEN {_SURVEYED} AND o_totalprice NOT BETWEEN 150000 AND 170000 THEN CAST(1 + CAST(floor(o_totalprice / 100000) AS BIGINT) AS DOUBLE) END",
    "SurveyResponseDate": f"CASE WHEN {_SURVEYED} THEN {_DAY} + (3 + c_nationkey) END",
    "WarrantyStartDate": "CASE WHEN c_acctbal <= 9000 THEN DATE '1994-09-01' + c_nationkey * 40 END",
    "ConnectedStatusARG": "CASE WHEN c_acctbal > 5000 THEN 'Connected' WHEN c_acctbal > 1000 THEN 'Pending' END",
    "ServiceMaintenance": f"CASE WHEN {_IS_MAINT} THEN {_NUMBER} END",
    "ServiceName": f"""CASE WHEN {_IS_MAINT} AND p_size > 30 THEN concat(CAST(CAST({_NUMBER} AS INT) AS STRING), '° Maintenance service')
 WHEN {_IS_MAINT} THEN concat(CAST(CAST({_NUMBER} AS INT) AS STRING), 'ª Maintenance review')
 WHEN p_type = 'LARGE' AND p_size > 25 THEN 'Guarantee' WHEN p_type = 'LARGE' AND p_size > 18 THEN 'Contactless service'
 WHEN p_type = 'LARGE' THEN 'Oil and filter change' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'Revision de Viaje'
 ELSE p_name END""",
    "ServiceType": f"""CASE WHEN {_IS_MAINT} OR (p_type = 'LARGE' AND p_size > 18) THEN 'Mantenimiento'
 WHEN p_type = 'LARGE' THEN 'Servicios Generales'
 WHEN p_type = 'MEDIUM' AND p_size > 34 THEN 'Campañas de servicio' WHEN p_type = 'MEDIUM' AND p_size > 17 THEN 'Diagnóstico'
 WHEN p_type = 'MEDIUM' THEN 'Reparación' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'Accesorios'
 WHEN p_type = 'SMALL' AND p_size > 20 THEN 'Pick Up & Delivery' WHEN p_type = 'SMALL' AND p_size > 10 THEN 'Taller Móvil'
 WHEN p_type = 'SMALL' AND p_size > 5 THEN 'Lavado' END""",
    "ServiceFordFixedPriceFlag": "CASE WHEN l_discount > 0.055 THEN 'Y' ELSE 'N' END",
    "ServiceMonth": f"CASE WHEN {_IS_MAINT} THEN 12 * {_NUMBER} END",
    "ServiceDuration": "l_quantity",
    "ServiceLaborCost": "l_tax * 1000",
    "ServiceFordFixedPrice": "CASE WHEN l_discount > 0.055 THEN l_extendedprice END",
    "ServicePriceDiscount": "l_discount",
}

_SALE_DAY = "DATE '1994-05-01' + (c_nationkey * 40 + CAST(floor(c_acctbal / 100) AS INT))"
SALES = {
    "vehicle_id": "concat('V', CAST(c_custkey AS STRING))",
    "customer_id": """CASE WHEN c_acctbal > 8500 THEN concat('N', CAST(c_nationkey AS STRING))
 ELSE concat('C', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)) END""",
    "dealer_id": "CASE WHEN c_acctbal > -900 THEN concat('D', CAST(c_nationkey AS STRING)) END",
    "PersonType": "CASE WHEN c_acctbal > 8500 THEN 'J' ELSE 'F' END",
    "BusinessUnit": "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Pro' ELSE 'Retail' END",
    "SalesChannel": """CASE WHEN c_nationkey < 10 THEN 'ROR' WHEN c_nationkey < 15 THEN 'CONSORTIUM'
 WHEN c_nationkey < 20 THEN 'DIRECT SALES' ELSE 'HR' END""",
    "SalesDate": _SALE_DAY,
    "DeliveryDate": f"{_SALE_DAY} + 10",
    "RegistrationDate": f"{_SALE_DAY} + 7",
    "WarrantyStartDate": f"CASE WHEN c_acctbal <= 6000 THEN {_SALE_DAY} + 15 END",
    "ModelYear": "1994 + CAST(floor(c_nationkey / 10) AS INT)",
    "ModelName": "concat(c_mktsegment, '   ')",
    "ModelShortName": "'PICKUP'",
    "ModelCode": """CASE c_mktsegment WHEN 'BUILDING' THEN 'X1DC' WHEN 'MACHINERY' THEN 'X2BC' WHEN 'HOUSEHOLD' THEN 'TA1'
 WHEN 'FURNITURE' THEN 'Y3DC' ELSE 'ZZ' END""",
    "State": "concat('S', CAST(c_nationkey AS STRING))",
    "Status": "CASE WHEN c_acctbal BETWEEN 0 AND 900 THEN 'CANCELLED' ELSE 'ACCEPTED' END",
}


class Tables:
    """Lazy domain tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.version = spark, folder, folder_version(spark, folder)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def agenda(self) -> DataFrame:
        """Service items with their booking, dealt once by booking while rows are still narrow.

        De-duplication and collapse group by booking first of all, so none of them deals the wide rows again.
        """
        o, l, p, c = (self.raw(n) for n in ("orders", "lineitem", "part", "customer"))
        tasks = row_tasks(l, ITEM_ROWS)
        booked = o.join(c, o.o_custkey == c.c_custkey, "left")
        # no column reads these two without a discount above its bound
        l = l.withColumns({"l_shipdate": F.when(F.col("l_discount") > 0.095, F.col("l_shipdate")),
                           "l_extendedprice": F.when(F.col("l_discount") > 0.055, F.col("l_extendedprice"))})
        # a part's name is read of parts of other types only; of no known type too
        p = p.withColumn("p_name", F.when(~F.coalesce(F.expr(f"{_IS_MAINT} OR p_type = 'LARGE'"), F.lit(False)), F.col("p_name")))
        items = l.join(p, l.l_partkey == p.p_partkey, "left")
        # what a booking alone decides is written once a booking, after its narrow row was dealt
        whole = {c: e for c, e in AGENDA.items() if not re.search(r"\b[lp]_", e)}
        needed = {name for name in (*o.columns, *c.columns) if any(name in e for k, e in AGENDA.items() if k not in whole)}
        # dealt by the text of the key, but as the number it is made from
        booking, item_of = F.expr(AGENDA["schedule_id"]), F.col("l_orderkey").cast("string")
        items = items.repartition(tasks, item_of).withColumn("_item_of", item_of)
        b = booked.repartition(tasks, booking).withColumn("_booking", booking).selectExpr(
            "_booking", *[f"{'_booking' if k == 'schedule_id' else e} AS {k}" for k, e in whole.items()], f"{_NUMBER} AS _number", *sorted(needed))
        j = b.join(items.hint("merge"), F.col("_booking") == F.col("_item_of"), "left")
        return j.selectExpr(*[k if k in whole else f"{e.replace(f'({_STATUS})', 'StatusARG').replace(_NUMBER, '_number')} AS {k}" for k, e in AGENDA.items()])

    def sales(self) -> DataFrame:
        return self.raw("customer").selectExpr(*[f"{e} AS {c}" for c, e in SALES.items()])

    def stage(self, name: str, build) -> DataFrame:
        """Stage table of this session and of the folder as it stands: written once, then read with pruning and pushdown."""
        return stage_table(self.spark, f"{self.folder}#{self.version}#{name}", build)

    def appt(self) -> DataFrame:
        return self.stage("appt", lambda: appointments(self.agenda()))

    def items(self) -> DataFrame:
        """De-duplicated service items with their class."""
        return self.stage("items", lambda: self.agenda().dropDuplicates().withColumn("item_class", item_class()))

    def visits(self) -> DataFrame:
        """Bookings of identified vehicles."""
        return self.appt().where(F.col("vehicle_id").isNotNull())

    def master(self) -> DataFrame:
        return self.stage("master", lambda: vehicle_master(self.appt(), self.sales(), RULES))

    def maint(self) -> DataFrame:
        return self.stage("maint", lambda: maintenance_events(self.appt(), PARAMS))

    def windows(self) -> DataFrame:
        return self.stage("windows", lambda: build_windows(
            self.appt(), self.sales(), PARAMS, SPAN, RULES, self.master(), self.maint()))

    def day_log(self) -> DataFrame:
        return self.stage("day_log", lambda: day_log(self.appt()))

    def features(self) -> DataFrame:
        return self.stage("features", lambda: build_features(
            self.windows().where(F.col("status") == "evaluable"), self.appt(), self.sales(), RULES, self.master(), self.day_log()))

    def scored(self) -> DataFrame:
        """Labelled windows with the rule score and its [0, 1] rescaling."""
        return self.stage("scored", lambda: rule_scores(self.features()).select(
            F.col("window_id").alias("id"), "vehicle_id", "customer_id", "scoring_date", F.col("label_churn").alias("y"),
            "anchor_type", "binding_rule", "generation", "vehicle_age_years", "n_appts", "score", "p"))

    def ranked(self) -> DataFrame:
        return self.stage("ranked", lambda: rank_scores(self.scored()))

    def current(self) -> DataFrame:
        return self.stage("current", lambda: current_population(self.windows(), SPAN.cutoff))

    def scores_now(self) -> DataFrame:
        return self.stage("scores_now", self._scores_now)

    def _scores_now(self) -> DataFrame:
        f = rule_scores(build_features(self.current(), self.appt(), self.sales(), RULES, self.master(), self.day_log()))
        r = rank_scores(f.withColumn("y", F.lit(0.0)), "window_id").drop("y")
        r = top_drivers(r.withColumn("segmento", segment_by_capacity(F.col("rn"), F.col("total"))), DRIVER_WEIGHTS)
        today = F.date_add(F.lit(SPAN.cutoff).cast("date"), 1)
        return (r.join(pending_bookings(self.appt(), SPAN.cutoff), "vehicle_id", "left")
                .withColumns({"fecha_scoring": today, "dias_restantes_horizonte": F.datediff("horizon_end", today),
                              "dias_en_ventana": F.datediff(today, "scoring_date_original"),
                              "tiene_turno_agendado": F.col("fecha_turno_agendado").isNotNull()})
                .withColumnsRenamed({"p": "prob_churn", "rn": "prioridad", "due_date": "vencimiento_estimado",
                                     "horizon_end": "cierre_horizonte", "scoring_date_original": "fecha_apertura_ventana"})
                .drop("total", "score"))

    def candidates(self) -> DataFrame:
        return self.stage("candidates", lambda: contact_candidates(self.scores_now(), POLICY))


def rule_scores(features: DataFrame) -> DataFrame:
    """Rule-based risk and a rescaling of it to [0, 1]."""
    return heuristic_score(features).withColumn("p", (F.col("score") + 1.5) / 8)


DRIVER_WEIGHTS = {"vehicle_age_years": 0.25, "n_noshow": 0.6, "n_cancel": 0.3, "n_maint": -0.3, "is_first_service": 0.8,
                  "days_since_last_maint": 0.002}

AGENDA_SQL = ("SELECT " + ",\n ".join(f"{e} AS {c}" for c, e in AGENDA.items())
              + "\nFROM orders LEFT JOIN customer ON o_custkey = c_custkey"
                "\nLEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
SALES_SQL = "SELECT " + ",\n ".join(f"{e} AS {c}" for c, e in SALES.items()) + "\nFROM customer"

ITEMS_SQL = """SELECT *, CASE WHEN ServiceMaintenance IS NOT NULL THEN 'MANT' WHEN ServiceName = 'Guarantee' THEN 'GARANTIA'
 WHEN ServiceName = 'Contactless service' THEN 'CONTACTLESS' WHEN lower(ServiceType) = 'campañas de servicio' THEN 'CAMPANA_RECALL'
 WHEN ServiceType = 'Diagnóstico' THEN 'DIAG' WHEN ServiceType = 'Reparación' THEN 'REPAR' WHEN ServiceName = 'Oil and filter change' THEN 'ACEITE_FILTRO'
 WHEN ServiceName IN ('Inspección Ford', 'Revision de Viaje') THEN 'INSPECCION' WHEN ServiceType = 'Servicios Generales' THEN 'SERV_GRAL'
 WHEN ServiceType = 'Pick Up & Delivery' THEN 'PUD' WHEN ServiceType IN ('Mobile Service', 'Taller Móvil') THEN 'MOVIL'
 WHEN ServiceType IS NULL THEN 'SIN_ITEM' ELSE 'OTRO' END AS item_class FROM (SELECT DISTINCT * FROM agenda)"""
_FIRST = "first({c} ORDER BY ServiceMaintenance NULLS LAST, {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
_MAINT_ITEM = "(ServiceMaintenance IS NOT NULL OR coalesce(regexp_matches(ServiceName, 'Maintenance (?:service|review)'), false))"
APPT_SQL = f"""
WITH d AS (SELECT DISTINCT * FROM agenda), g AS (
 SELECT schedule_id, {", ".join(_FIRST.format(c=c) for c in fv.VISIT_COLUMNS)},
  CAST(count(*) AS INTEGER) AS n_items, bool_or({_MAINT_ITEM}) AS has_maint,
  min(CASE WHEN {_MAINT_ITEM} THEN ServiceMaintenance END) AS maint_number,
  bool_or(coalesce(lower(ServiceType) = 'campañas de servicio', false)) AS has_recall,
  bool_or(coalesce(ServiceType = 'Diagnóstico', false)) AS has_diag,
  bool_or(coalesce(ServiceType = 'Reparación', false)) AS has_repair,
  bool_or(coalesce(ServiceName = 'Guarantee', false)) AS has_guarantee,
  bool_or(coalesce(ServiceFordFixedPriceFlag = 'Y', false)) AS has_fixed_price,
  bool_or(coalesce(PickupDeliveryService = 'Yes', false)) AS has_pud,
  bool_or(coalesce(MobileService = 'Yes', false)) AS has_mobile
 FROM d GROUP BY schedule_id)
SELECT *, completed AND has_maint AS is_completed_maintenance FROM (
 SELECT *, coalesce(StatusARG = '(60) Concluido', false) AS completed,
  coalesce(StatusARG = '(90) Concluido sin OS', false) AS completed_no_os,
  coalesce(StatusARG = '(80) No asistio', false) AS no_show, coalesce(StatusARG = '(70) Cancelado', false) AS cancelled,
  coalesce(StatusARG IN ('(30) Agendado', '(40) En progreso'), false) AS pending,
  CASE WHEN abs(EffectiveCheckinDate - ScheduleDate) <= 45 THEN EffectiveCheckinDate ELSE ScheduleDate END AS event_date
 FROM g)"""

_EARLY = "first({c} ORDER BY event_date, schedule_id) FILTER (WHERE {c} IS NOT NULL) AS {a}"
VM_SQL = f"""
WITH ag AS (SELECT vehicle_id, {_EARLY.format(c='WarrantyStartDate', a='warranty_agenda')},
  {_EARLY.format(c='ShortVehicleModelGroupTreated', a='gen_a')}, {_EARLY.format(c='ModelYear', a='model_year_agenda')},
  {_EARLY.format(c='TMA', a='tma')}, {_EARLY.format(c='ConnectedStatusARG', a='connected_status')},
  {_EARLY.format(c='Region', a='region')}, {_EARLY.format(c='DealerStateOrZone', a='dealer_zone_first')},
  min(event_date) AS first_seen, count(*) AS n_appts_total
 FROM appt WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id),
sa AS (SELECT * FROM sales WHERE Status = 'ACCEPTED' AND ModelShortName = 'PICKUP'
  AND (DeliveryDate IS NULL OR DeliveryDate >= DATE '1993-01-01'))
SELECT coalesce(ag.vehicle_id, sa.vehicle_id) AS vehicle_id, warranty_agenda, model_year_agenda, tma, connected_status,
 region, dealer_zone_first, first_seen, n_appts_total, sa.customer_id AS sales_customer_id, sa.dealer_id AS sales_dealer_id,
 PersonType AS person_type, BusinessUnit AS business_unit, SalesChannel AS sales_channel, SalesDate, DeliveryDate,
 WarrantyStartDate AS warranty_sales, ModelYear AS model_year_sales, ModelCode AS sales_model_code, State AS sales_state,
 sa.customer_id IS NOT NULL AS in_sales, first_seen IS NOT NULL AS in_agenda,
 coalesce(WarrantyStartDate, warranty_agenda) AS warranty_start,
 coalesce(CAST(ModelYear AS DOUBLE), model_year_agenda) AS model_year,
 coalesce(gen_a, CASE WHEN ModelCode LIKE '%DC' OR ModelCode = 'TA1' THEN 'BUILDING' WHEN ModelCode LIKE '%BC' THEN 'MACHINERY' END) AS generation
FROM ag FULL OUTER JOIN sa ON ag.vehicle_id = sa.vehicle_id"""

_LAST = "last({c} ORDER BY (k IS NULL), k, schedule_id) FILTER (WHERE {c} IS NOT NULL) AS {a}"
MAINT_DAYS_SQL = f"""
SELECT vehicle_id, event_date, max(k) AS km, {_LAST.format(c='customer_id', a='customer_id')},
 {_LAST.format(c='dealer_id', a='dealer_id')}, min(maint_number) AS maint_number,
 {_LAST.format(c='schedule_id', a='schedule_id')}, {_LAST.format(c='ScheduleSource', a='source')}
FROM (SELECT *, CASE WHEN VehicleCurrentKM BETWEEN 100 AND 1000000 THEN VehicleCurrentKM END AS k FROM appt
 WHERE is_completed_maintenance AND vehicle_id IS NOT NULL) GROUP BY vehicle_id, event_date"""
SPLIT_SQL = """
SELECT * EXCLUDE (pn, pd) FROM (SELECT *, lag(maint_number) OVER w AS pn, lag(event_date) OVER w AS pd FROM maint_days
 WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date))
WHERE NOT coalesce(event_date - pd <= 30 AND maint_number = pn, false)"""
MAINT_SQL = """
SELECT * EXCLUDE (km, run, prev), CASE WHEN prev IS NULL OR km >= prev THEN km END AS km FROM (
 SELECT *, lag(run) OVER (PARTITION BY vehicle_id ORDER BY event_date) AS prev FROM (
  SELECT *, CASE WHEN km IS NOT NULL THEN max(km) OVER (PARTITION BY vehicle_id ORDER BY event_date) END AS run FROM maint_split))"""

WINDOWS_SQL = """
WITH an AS (
 SELECT vehicle_id, event_date AS anchor_date, km AS anchor_km, 'maintenance' AS anchor_type FROM maint
 UNION ALL SELECT vehicle_id, warranty_start, 0.0, 'warranty' FROM vm WHERE warranty_start IS NOT NULL),
a1 AS (SELECT an.*, warranty_start, generation, first_seen, sales_customer_id,
  CASE generation WHEN 'BUILDING' THEN 16000.0 WHEN 'MACHINERY' THEN 10000.0 WHEN 'HOUSEHOLD' THEN 12000.0 ELSE 14000.0 END::DOUBLE AS k_gen,
  lag(anchor_km) OVER w AS pk, lag(anchor_date) OVER w AS pd
 FROM an JOIN vm USING (vehicle_id) WINDOW w AS (PARTITION BY vehicle_id ORDER BY anchor_date, anchor_type)),
a2 AS (SELECT *, CASE WHEN r BETWEEN 2000 / 365.25 AND 150000 / 365.25 THEN r END AS own FROM (
 SELECT *, coalesce(CASE WHEN anchor_date - warranty_start >= 90 THEN anchor_km / (anchor_date - warranty_start) END,
  CASE WHEN anchor_date - pd >= 60 AND (anchor_km - pk) / (anchor_date - pd) > 0 THEN (anchor_km - pk) / (anchor_date - pd) END) AS r FROM a1)),
med AS (SELECT generation AS g, median(own) AS m FROM a2 WHERE anchor_type = 'maintenance' AND generation IS NOT NULL GROUP BY 1),
a3 AS (SELECT a2.*, CASE WHEN own IS NOT NULL THEN 'individual' ELSE 'generacion' END AS rs,
  coalesce(own, m, (SELECT median(own) FROM a2 WHERE anchor_type = 'maintenance')) AS rate,
  anchor_type = 'warranty' AS is_first, anchor_date + 365 AS due_time, anchor_date + 90 AS floor_date
 FROM a2 LEFT JOIN med ON g = generation),
a4 AS (SELECT *, anchor_date + CAST(round_even(least(k_gen / rate, 3650), 0) AS INTEGER) AS due_km FROM a3),
a5 AS (SELECT *, CASE WHEN is_first THEN anchor_date + 300 ELSE greatest(least(due_time, due_km), floor_date) END AS due_date,
  CASE WHEN is_first THEN 'primer_service_tiempo' WHEN greatest(least(due_time, due_km), floor_date) = floor_date THEN 'piso'
   WHEN due_km < due_time THEN 'km' ELSE 'tiempo' END AS binding_rule FROM a4),
a6 AS (SELECT *, due_date - 30 AS scoring_date, due_date + 90 AS horizon_end,
  (SELECT min(event_date) FROM maint x WHERE x.vehicle_id = a5.vehicle_id AND x.event_date > a5.anchor_date) AS next_maint_date,
  (SELECT min(event_date) FROM appt x WHERE x.vehicle_id = a5.vehicle_id AND x.completed AND x.event_date > a5.anchor_date) AS next_visit_date
 FROM a5),
a7 AS (SELECT a6.*, x.km AS next_maint_km,
  greatest(scoring_date - greatest(least(warranty_start, first_seen), DATE '1995-01-01'), 0) AS history_days,
  CASE WHEN scoring_date > DATE '2001-02-28' THEN 'futura' WHEN scoring_date < DATE '1995-01-01' THEN 'fuera_de_rango'
   WHEN next_maint_date <= scoring_date THEN 'preempted' WHEN horizon_end > DATE '2001-01-29' THEN 'censurada' ELSE 'evaluable' END AS status
 FROM a6 LEFT JOIN maint x ON x.vehicle_id = a6.vehicle_id AND x.event_date = next_maint_date),
a8 AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY scoring_date) AS window_n FROM a7
 QUALIFY row_number() OVER (PARTITION BY vehicle_id, scoring_date ORDER BY anchor_date DESC, anchor_type DESC) = 1),
a9 AS (SELECT * EXCLUDE (window_n), CAST(row_number() OVER (PARTITION BY vehicle_id ORDER BY scoring_date) AS INTEGER) AS window_n FROM a8),
cu AS (SELECT a9.vehicle_id AS v, a9.scoring_date AS sd, last(x.customer_id ORDER BY x.event_date, x.schedule_id) AS c,
  last(x.dealer_id ORDER BY x.event_date, x.schedule_id) AS dl
 FROM a9 JOIN appt x ON x.vehicle_id = a9.vehicle_id AND x.customer_id IS NOT NULL AND x.event_date < a9.scoring_date GROUP BY 1, 2)
SELECT concat(vehicle_id, '_', strftime(scoring_date, '%Y%m%d')) AS window_id, vehicle_id, coalesce(c, sales_customer_id) AS customer_id,
 c AS customer_id_at_scoring, sales_customer_id, window_n, anchor_type, anchor_date, anchor_km, k_gen,
 CASE WHEN NOT is_first THEN rate END AS km_rate_per_day, CASE WHEN is_first THEN 'sin_km' ELSE rs END AS rate_source,
 due_time, CASE WHEN NOT is_first THEN due_km END AS due_km, due_date, binding_rule, scoring_date, horizon_end,
 next_maint_date, next_maint_km, next_maint_date - due_date AS days_next_vs_due, next_visit_date, history_days, status,
 CASE WHEN status = 'evaluable' THEN CASE WHEN next_maint_date > scoring_date AND next_maint_date <= horizon_end THEN 0.0 ELSE 1.0 END END::DOUBLE AS label_churn,
 CASE WHEN status = 'evaluable' THEN CASE WHEN next_visit_date > scoring_date AND next_visit_date <= horizon_end THEN 0.0 ELSE 1.0 END END::DOUBLE AS label_no_visit,
 dl AS last_dealer_id
FROM a9 LEFT JOIN cu ON v = vehicle_id AND sd = scoring_date"""

def windows_sql(p: WindowParams, maint: str = "maint") -> str:
    """The windows text for other parameters, without the customer at scoring."""
    anchors, rest = WINDOWS_SQL.split("a1 AS (", 1)
    if p.anchor == "plan":
        anchors = f"""
WITH an AS (SELECT vehicle_id, warranty_start + CAST(k * {p.cycle_days} AS INTEGER) AS anchor_date, CAST(NULL AS DOUBLE) AS anchor_km, 'plan' AS anchor_type
 FROM (SELECT vehicle_id, warranty_start, unnest(generate_series(0, CAST(floor((DATE '{SPAN.cutoff}' - warranty_start) / {p.cycle_days}) AS BIGINT))) AS k FROM vm WHERE warranty_start <= DATE '{SPAN.cutoff}')),
"""
    body = anchors + "a1 AS (" + rest.split("cu AS (", 1)[0].rstrip().rstrip(",")
    old = "CASE generation WHEN 'BUILDING' THEN 16000.0 WHEN 'MACHINERY' THEN 10000.0 WHEN 'HOUSEHOLD' THEN 12000.0 ELSE 14000.0 END::DOUBLE"
    new = "CASE generation " + " ".join(f"WHEN '{g}' THEN {k!r}" for g, k in p.km_by_generation) + f" ELSE {p.km_interval!r} END::DOUBLE"
    dates = f"due_date - {p.lead_days} AS scoring_date, due_date + {p.horizon_days} AS horizon_end"
    if p.label_mode == "mes_calendario":
        dates = "CAST(date_trunc('month', due_date) AS DATE) AS scoring_date, last_day(due_date) AS horizon_end"
    margin = SPAN.cutoff - dt.timedelta(days=p.label_margin_days)
    for a, b in ((old, new), ("anchor_date + 300", f"anchor_date + {p.first_due_days}"), ("due_date - 30 AS scoring_date, due_date + 90 AS horizon_end", dates), ("DATE '2001-01-29'", f"DATE '{margin}'"), ("FROM maint", f"FROM {maint}"), ("JOIN maint", f"JOIN {maint}")):
        body = body.replace(a, b)
    return body + """ SELECT *, next_maint_date - due_date AS days_next_vs_due,
 CASE WHEN status = 'evaluable' THEN CASE WHEN next_maint_date > scoring_date AND next_maint_date <= horizon_end THEN 0.0 ELSE 1.0 END END::DOUBLE AS label_churn FROM a9"""


FEATURES_SQL = """
WITH a0 AS (SELECT *, CASE WHEN VehicleCurrentKM BETWEEN 100 AND 1000000 THEN VehicleCurrentKM END AS k FROM appt WHERE vehicle_id IS NOT NULL),
a1 AS (SELECT *, CASE WHEN k IS NOT NULL THEN max(k) OVER w END AS run, row_number() OVER w AS pos,
  lag(customer_id) OVER w AS pc, lag(dealer_id) OVER w AS pdl FROM a0 WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_date, schedule_id)),
a2 AS (SELECT *, lag(run) OVER (PARTITION BY vehicle_id ORDER BY pos) AS prun FROM a1),
a AS (SELECT *, CASE WHEN prun IS NULL OR k >= prun THEN k END AS km_event,
  coalesce(customer_id <> pc, false) AS owner_change, pdl IS NOT NULL AND dealer_id IS DISTINCT FROM pdl AS dealer_change FROM a2),
m0 AS (SELECT *, lag(maint_number) OVER w AS pn, lag(event_date) OVER w AS pd FROM a WHERE is_completed_maintenance
 WINDOW w AS (PARTITION BY vehicle_id ORDER BY pos)),
m1 AS (SELECT *, lag(event_date) OVER w AS kd, lag(km_event) OVER w AS kk, lag(maint_number) OVER w AS kn FROM m0
 WHERE NOT coalesce(event_date - pd <= 30 AND maint_number = pn, false) WINDOW w AS (PARTITION BY vehicle_id ORDER BY pos)),
m AS (SELECT *, CAST(event_date - kd AS DOUBLE) AS iv, CASE WHEN km_event - kk > 0 THEN km_event - kk END AS ikm, maint_number - kn >= 2 AS jump FROM m1),
w AS (SELECT * FROM windows WHERE status = 'evaluable'),
h AS (SELECT w.window_id,
  count(*) FILTER (WHERE is_completed_maintenance) AS n_maint, count(*) FILTER (WHERE completed) AS n_completed,
  count(*) FILTER (WHERE completed_no_os) AS n_no_os, count(*) FILTER (WHERE no_show) AS n_noshow, count(*) FILTER (WHERE cancelled) AS n_cancel,
  count(*) AS n_appts, count(*) FILTER (WHERE completed AND has_recall) AS n_recall, count(*) FILTER (WHERE completed AND has_diag) AS n_diag,
  count(*) FILTER (WHERE completed AND has_repair) AS n_repair, count(*) FILTER (WHERE completed AND has_guarantee) AS n_guarantee,
  count(*) FILTER (WHERE ScheduleSource = 'FordPass') AS n_fordpass, count(*) FILTER (WHERE ScheduleSource IN ('FordPass', 'WEB', 'Mobile')) AS n_web_or_app,
  count(*) FILTER (WHERE completed AND has_pud) AS n_pud, count(*) FILTER (WHERE completed AND has_mobile) AS n_mobile,
  count(*) FILTER (WHERE completed AND has_fixed_price) AS n_fixed_price, count(*) FILTER (WHERE IsReschedule = 'Y') AS n_reschedule,
  count(*) FILTER (WHERE cancelled AND IsReschedule = 'N') AS n_hard_cancel, count(*) FILTER (WHERE ScheduleReturn = 'Y') AS n_return_visits,
  count(*) FILTER (WHERE NeededTowing = 'Y') AS n_towing, count(*) FILTER (WHERE owner_change) AS n_customer_changes,
  count(*) FILTER (WHERE dealer_change) AS n_dealer_changes,
  last(StatusARG ORDER BY pos) AS last_status, last(ScheduleSource ORDER BY pos) AS last_source, last(DealerStateOrZone ORDER BY pos) AS last_dealer_zone,
  last(CASE WHEN DaysInDealer < 0 THEN 0 ELSE DaysInDealer END ORDER BY pos) AS last_days_in_dealer,
  max(scoring_date) - max(event_date) AS days_since_last_appt,
  max(scoring_date) - max(event_date) FILTER (WHERE no_show) AS days_since_last_noshow,
  max(scoring_date) - max(event_date) FILTER (WHERE cancelled) AS days_since_last_cancel,
  max(scoring_date) - max(event_date) FILTER (WHERE completed) AS days_since_last_visit,
  last(km_event ORDER BY pos) FILTER (WHERE km_event IS NOT NULL) AS last_km,
  max(scoring_date) - max(event_date) FILTER (WHERE km_event IS NOT NULL) AS days_since_last_km
 FROM w JOIN a ON a.vehicle_id = w.vehicle_id AND a.event_date < w.scoring_date GROUP BY 1),
hm AS (SELECT w.window_id, max(scoring_date) - max(event_date) AS days_since_last_maint, last(km_event ORDER BY pos) AS last_maint_km,
  last(maint_number ORDER BY pos) AS last_maint_number, last(ScheduleSource ORDER BY pos) AS last_maint_source, last(m.dealer_id ORDER BY pos) AS last_maint_dealer,
  last(CASE WHEN DaysInDealer < 0 THEN 0 ELSE DaysInDealer END ORDER BY pos) AS last_maint_days_in_dealer,
  last(CAST(has_fixed_price AS INTEGER) ORDER BY pos) AS last_maint_fixed_price, last(CAST(has_pud AS INTEGER) ORDER BY pos) AS last_maint_pud,
  last(CAST(coalesce(CustomerWaiting = 'Y', false) AS INTEGER) ORDER BY pos) AS last_maint_customer_waiting,
  last(iv ORDER BY pos) AS last_interval_days, last(ikm ORDER BY pos) AS last_interval_km, count(iv) AS n_int, avg(iv) AS mean_interval_days,
  CASE WHEN count(iv) > 1 THEN sqrt(greatest(sum(iv * iv) / count(iv) - avg(iv) * avg(iv), 0)) END AS std_interval_days,
  count(*) FILTER (WHERE jump) AS jumps
 FROM w JOIN m ON m.vehicle_id = w.vehicle_id AND m.event_date < w.scoring_date GROUP BY 1),
hs AS (SELECT w.window_id, count(*) AS n_surveys, CASE WHEN last(SurveyStarRating ORDER BY SurveyResponseDate, pos) IS NOT NULL THEN min(SurveyStarRating) END AS min_rating, last(SurveyStarRating ORDER BY SurveyResponseDate, pos) AS last_rating,
  CASE WHEN last(SurveyStarRating ORDER BY SurveyResponseDate, pos) IS NOT NULL THEN avg(SurveyStarRating) END AS mean_rating, max(scoring_date) - max(SurveyResponseDate) AS days_since_last_survey
 FROM w JOIN a ON a.vehicle_id = w.vehicle_id AND SurveyResponseDate < w.scoring_date GROUP BY 1),
fl AS (SELECT w.window_id, count(*) AS n FROM w JOIN sales s ON s.customer_id = w.customer_id AND s.SalesDate < w.scoring_date GROUP BY 1),
cv AS (SELECT w.window_id, count(DISTINCT x.vehicle_id) AS n FROM w JOIN appt x ON x.customer_id = w.customer_id AND x.vehicle_id IS NOT NULL
  AND x.event_date < w.scoring_date GROUP BY 1),
z AS (SELECT w.*, h.* EXCLUDE (window_id, n_maint, n_completed, n_no_os, n_noshow, n_cancel, n_appts, n_recall, n_diag, n_repair, n_guarantee, n_fordpass,
   n_web_or_app, n_pud, n_mobile, n_fixed_price, n_reschedule, n_hard_cancel, n_return_visits, n_towing, n_customer_changes, n_dealer_changes),
  COUNTS, hm.* EXCLUDE (window_id, n_int, jumps), coalesce(n_int, 0) AS n_intervals_known, coalesce(jumps, 0) AS n_numbering_jumps,
  coalesce(hs.n_surveys, 0) AS n_surveys, min_rating, last_rating, mean_rating, days_since_last_survey,
  coalesce(fl.n, 0) AS fleet_size_sales, coalesce(cv.n, 0) AS n_vehicles_customer_agenda,
  vm.warranty_start, vm.generation, vm.model_year, vm.tma, vm.connected_status, vm.region, vm.person_type, vm.business_unit, vm.sales_channel,
  vm.sales_state, vm.sales_dealer_id, vm.SalesDate, coalesce(vm.in_sales, false) AS was_sold, vm.sales_customer_id AS buyer
 FROM w LEFT JOIN h USING (window_id) LEFT JOIN hm USING (window_id) LEFT JOIN hs USING (window_id) LEFT JOIN fl USING (window_id)
 LEFT JOIN cv USING (window_id) LEFT JOIN vm ON vm.vehicle_id = w.vehicle_id)
SELECT *, greatest(scoring_date - warranty_start, CASE WHEN warranty_start IS NOT NULL THEN 0 END) AS vehicle_age_days,
 greatest(scoring_date - warranty_start, CASE WHEN warranty_start IS NOT NULL THEN 0 END) / 365.25 AS vehicle_age_years,
 CAST(was_sold AS INTEGER) AS in_sales, CAST(coalesce(customer_id = buyer, false) AS INTEGER) AS is_buyer,
 CAST(coalesce(last_maint_dealer = sales_dealer_id, false) AS INTEGER) AS same_dealer_as_sale, history_days / 30.44 AS months_observable,
 due_date - anchor_date AS days_anchor_to_due, km_rate_per_day * 365.25 AS km_per_year,
 anchor_km + km_rate_per_day * (scoring_date - anchor_date) AS km_expected_at_scoring, last_interval_days - 365 AS last_maint_late_days,
 last_maint_km - k_gen * last_maint_number AS last_maint_km_vs_plan, last_interval_km / k_gen AS last_interval_km_vs_k,
 due_date - scoring_date AS days_to_due_at_scoring, CASE WHEN n_appts > 0 THEN n_noshow / n_appts END AS noshow_rate,
 CASE WHEN n_appts > 0 THEN n_cancel / n_appts END AS cancel_rate, CASE WHEN n_appts > 0 THEN n_fordpass / n_appts END AS fordpass_share,
 n_maint / (greatest(history_days, 30) / 365.25) AS maint_per_year_observed, month(scoring_date) AS scoring_month,
 CAST(anchor_type = 'warranty' AS INTEGER) AS is_first_service
FROM z""".replace("COUNTS", ", ".join(f"coalesce(h.{c}, 0) AS {c}" for c in (
    "n_maint n_completed n_no_os n_noshow n_cancel n_appts n_recall n_diag n_repair n_guarantee n_fordpass n_web_or_app n_pud n_mobile "
    "n_fixed_price n_reschedule n_hard_cancel n_return_visits n_towing n_customer_changes n_dealer_changes").split()))

_RULE_SQL = """25e-2 * least(greatest(coalesce(vehicle_age_years, (SELECT median(vehicle_age_years) FROM {src})), 0e0), 10e0)
 + 6e-1 * least(greatest(n_noshow + 5e-1 * n_cancel, 0e0), 5e0) - 3e-1 * least(greatest(n_maint, 0), 5) + 8e-1 * is_first_service"""
SCORED_SQL = f"""SELECT *, (score + 15e-1) / 8e0 AS p FROM (
SELECT window_id AS id, vehicle_id, customer_id, scoring_date, label_churn AS y, anchor_type, binding_rule, generation, vehicle_age_years, n_appts,
 {_RULE_SQL.format(src='features')} AS score FROM features)"""
POP_SQL = """
SELECT * EXCLUDE (scoring_date), scoring_date AS scoring_date_original,
 CASE WHEN poblacion_actual = 'en_ventana' THEN scoring_date ELSE DATE '2001-03-01' END AS scoring_date
FROM (SELECT *, CASE WHEN status = 'censurada' THEN 'en_ventana' ELSE 'entra_en_30_dias' END AS poblacion_actual FROM windows
 WHERE (status = 'censurada' AND next_maint_date IS NULL) OR (status = 'futura' AND scoring_date <= DATE '2001-02-28' + 30))
QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY poblacion_actual, scoring_date_original) = 1"""
_FMT = ("CASE WHEN v IS NULL THEN CASE WHEN f = 'days_since_last_maint' THEN 'sin registro en la red' ELSE 'sin dato' END "
        "WHEN abs(v) >= 100 THEN format('{:,}', CAST(round_even(v, 0) AS BIGINT)) "
        "ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '[.]$', '') END")
SCORES_NOW_SQL = f"""
WITH s AS (SELECT *, (score + 15e-1) / 8e0 AS prob_churn FROM (SELECT *, {_RULE_SQL.format(src='features_now')} AS score FROM features_now)),
r AS (SELECT *, row_number() OVER (ORDER BY prob_churn DESC, window_id) AS prioridad, count(*) OVER () AS total FROM s),
c AS (SELECT window_id, f, v, coalesce(wt * (v - avg(v) OVER (PARTITION BY f)), 0) AS c FROM (
 SELECT window_id, unnest(['vehicle_age_years', 'n_noshow', 'n_cancel', 'n_maint', 'is_first_service', 'days_since_last_maint']) AS f,
  unnest([0.25, 0.6, 0.3, -0.3, 0.8, 0.002]) AS wt,
  unnest([vehicle_age_years, n_noshow, n_cancel, n_maint, is_first_service, days_since_last_maint]::DOUBLE[]) AS v FROM s)),
d AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(c) DESC, f) AS k, concat(CASE f WHEN 'vehicle_age_years' THEN '{fv.FEATURE_LABELS["vehicle_age_years"]}'
  WHEN 'n_noshow' THEN '{fv.FEATURE_LABELS["n_noshow"]}' WHEN 'n_cancel' THEN '{fv.FEATURE_LABELS["n_cancel"]}'
  WHEN 'n_maint' THEN '{fv.FEATURE_LABELS["n_maint"]}' WHEN 'is_first_service' THEN '{fv.FEATURE_LABELS["is_first_service"]}'
  ELSE '{fv.FEATURE_LABELS["days_since_last_maint"]}' END, ' = ', {_FMT}, ' (', CASE WHEN c > 0 THEN '↑ riesgo' ELSE '↓ riesgo' END, ')') AS txt FROM c),
p AS (SELECT window_id, {", ".join(f"max(txt) FILTER (WHERE k = {i}) AS driver_{i}, max(f) FILTER (WHERE k = {i}) AS driver_{i}_feature, max(c) FILTER (WHERE k = {i}) AS driver_{i}_shap" for i in (1, 2, 3))}
 FROM d GROUP BY 1),
b AS (SELECT vehicle_id, min(ScheduleDate) AS fecha_turno_agendado FROM appt WHERE pending AND ScheduleDate > DATE '2001-02-28' AND vehicle_id IS NOT NULL GROUP BY 1)
SELECT r.*, p.* EXCLUDE (window_id), fecha_turno_agendado, fecha_turno_agendado IS NOT NULL AS tiene_turno_agendado,
 CASE WHEN prioridad / total <= 0.2 THEN 'Alto' WHEN prioridad / total <= 0.5 THEN 'Medio' ELSE 'Bajo' END AS segmento,
 DATE '2001-03-01' AS fecha_scoring, horizon_end - DATE '2001-03-01' AS dias_restantes_horizonte, DATE '2001-03-01' - scoring_date_original AS dias_en_ventana,
 due_date AS vencimiento_estimado, horizon_end AS cierre_horizonte, scoring_date_original AS fecha_apertura_ventana
FROM r JOIN p USING (window_id) LEFT JOIN b ON b.vehicle_id = r.vehicle_id"""
_ACT = ", ".join(f"'{f}'" for f in fv.ACTIONABLE_FEATURES)
_RT = {k: v.replace("%s", "{}") for k, v in fv.REASON_TEXT.items()}
CANDIDATES_SQL = f"""
WITH c0 AS (SELECT *, coalesce(trim(customer_id), '') AS cli, coalesce(trim(vehicle_id), '') AS veh, coalesce(trim(last_maint_dealer), '') AS dlr,
  list_filter([CASE WHEN driver_1_feature IN ({_ACT}) AND driver_1_shap > 0 THEN driver_1_feature END, CASE WHEN driver_2_feature IN ({_ACT})
   AND driver_2_shap > 0 THEN driver_2_feature END, CASE WHEN driver_3_feature IN ({_ACT}) AND driver_3_shap > 0 THEN driver_3_feature END], lambda x: x IS NOT NULL) AS sig,
  dias_restantes_horizonte AS mg, coalesce(days_since_last_maint BETWEEN 0 AND 730, false) AS vinculo_reciente
 FROM scores_now WHERE segmento IN ('Alto', 'Medio')),
c1 AS (SELECT *, len(sig) > 0 AS shap_accionable, CASE WHEN cli = '' THEN 'Sin identificador' WHEN tiene_turno_agendado THEN 'Con turno'
  WHEN mg < 14 THEN 'Sin margen' WHEN veh = '' OR n_maint <= 0 OR dlr = '' THEN 'Revisar' ELSE 'Contactar' END AS estado_contacto FROM c0),
c2 AS (SELECT *, estado_contacto = 'Contactar' AS ok, concat_ws(' ', CASE WHEN cli = '' THEN '{_RT["no_id"]}' END,
  CASE WHEN tiene_turno_agendado THEN '{_RT["booked"]}' END, CASE WHEN mg < 14 THEN format('{_RT["short"]}', CAST(mg AS VARCHAR), '14') END,
  CASE WHEN veh = '' THEN format('{_RT["missing"]}', 'vehicle_id') END, CASE WHEN n_maint = 0 THEN '{_RT["no_history"]}' END,
  CASE WHEN dlr = '' THEN '{_RT["no_dealer"]}' END, CASE WHEN estado_contacto = 'Contactar' THEN '{_RT["ok"]}' END,
  CASE WHEN shap_accionable THEN format('{_RT["signal"]}', array_to_string(sig, ', ')) ELSE '{_RT["no_signal"]}' END,
  CASE WHEN vinculo_reciente THEN format('{_RT["recent"]}', CAST(days_since_last_maint AS VARCHAR)) ELSE '{_RT["not_recent"]}' END) AS motivos_operativos FROM c1),
c3 AS (SELECT *, row_number() OVER (ORDER BY ok DESC, shap_accionable DESC, vinculo_reciente DESC, prob_churn DESC NULLS LAST, mg ASC NULLS LAST, cli, veh) AS ps FROM c2),
c4 AS (SELECT *, cli <> '' AND ps = min(ps) OVER (PARTITION BY cli) AS representante FROM c3),
c5 AS (SELECT *, CASE WHEN representante AND ok THEN row_number() OVER (PARTITION BY representante AND ok ORDER BY ps) END AS orden_contacto FROM c4),
g AS (SELECT cli AS gc, count(DISTINCT veh) FILTER (WHERE veh <> '') AS nv, string_agg(DISTINCT veh, ' | ' ORDER BY veh) AS vl,
  concat_ws(' | ', CASE WHEN bool_or(segmento = 'Alto') THEN 'Alto' END, CASE WHEN bool_or(segmento = 'Medio') THEN 'Medio' END) AS gl
 FROM c5 WHERE cli <> '' GROUP BY 1)
SELECT *, coalesce(orden_contacto <= 60, false) AS seleccionado, orden_contacto > 60 AND orden_contacto IS NOT NULL AS en_espera,
 CASE WHEN cli = '' THEN veh ELSE vl END AS vehiculos_cliente, coalesce(nv, 0) AS n_vehiculos_cliente, coalesce(gl, segmento) AS grupos_cliente
FROM c5 LEFT JOIN g ON gc = cli"""

CTES: dict[str, tuple[list[str], str]] = {
    "agenda": ([], AGENDA_SQL),
    "sales": ([], SALES_SQL),
    "items": (["agenda"], ITEMS_SQL),
    "appt": (["agenda"], APPT_SQL),
    "visits": (["appt"], "SELECT * FROM appt WHERE vehicle_id IS NOT NULL"),
    "vm": (["appt", "sales"], VM_SQL),
    "maint_days": (["appt"], MAINT_DAYS_SQL),
    "maint_split": (["maint_days"], SPLIT_SQL),
    "maint": (["maint_split"], MAINT_SQL),
    "windows": (["maint", "vm", "appt"], WINDOWS_SQL),
    "maint_km_days": (["appt"], MAINT_DAYS_SQL.replace("VehicleCurrentKM BETWEEN 100 AND 1000000 THEN VehicleCurrentKM", "KM BETWEEN 100 AND 1000000 THEN KM")),
    "maint_km_split": (["maint_km_days"], SPLIT_SQL.replace("maint_days", "maint_km_days")),
    "maint_km": (["maint_km_split"], MAINT_SQL.replace("maint_split", "maint_km_split")),
    "features": (["windows"], FEATURES_SQL),
    "scored": (["features"], SCORED_SQL),
    "ranked": (["scored"], "SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS total FROM scored"),
    "pop": (["windows"], POP_SQL),
    "features_now": (["pop"], FEATURES_SQL.replace("SELECT * FROM windows WHERE status = 'evaluable'", "SELECT * FROM pop")),
    "scores_now": (["features_now"], SCORES_NOW_SQL),
    "candidates": (["scores_now"], CANDIDATES_SQL),
}


def with_ctes(need: list[str], body: str) -> str:
    """``body`` preceded by the named common tables and everything they rest on."""
    order: list[str] = []

    def visit(name: str):
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in need:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]}\n)" for n in order) + "\n" + body
