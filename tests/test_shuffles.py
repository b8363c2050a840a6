"""Wide rows are dealt as seldom as their keys allow, with the same rows."""

import datetime as dt
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reprise.operators.events import appointments
from reprise.operators.features import COUNTERS, dealt_visits, vehicle_history, visit_flags
from reprise.operators.windows import anchors_with_rates, dated_windows, default_grid, rate_with_fallback, window_sensitivity, windows_by_definition
from reprise.plans import domain
from reprise.plans.domain import AGENDA, PARAMS, RULES, SPAN, Tables
from reprise.runtime import cut_lineage, row_tasks

_DAY = dt.datetime(1996, 5, 1)
_ORDERS = [(1, 1, "F", 90000.0, _DAY, "1-URGENT"), (1, 1, "F", 90000.0, _DAY, "1-URGENT"), (2, 2, "P", 250000.0, _DAY, "5-LOW"), (3, None, "O", 490000.0, _DAY, "4-NOT SPECIFIED"),
           (4, 9, "O", 200000.0, None, None), (None, 1, "F", 50000.0, _DAY, "2-HIGH"), (None, 2, None, None, _DAY, "3-MEDIUM")]
_ITEMS = [(1, 1, 1, 1, 17.0, 10.0, 0.06, 0.02, "R", "O", _DAY), (1, 1, 1, 1, 17.0, 10.0, 0.06, 0.02, "R", "O", _DAY), (1, 2, 2, 2, 40.0, 20.0, 0.1, 0.01, "A", "F", _DAY),
          (2, 3, None, 1, 5.0, 30.0, 0.0, 0.0, "N", "O", _DAY), (2, None, 4, None, None, None, None, None, None, None, None), (3, 2, 5, 3, 9.0, 1.0, 0.07, 0.0, "N", "F", _DAY), (None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", _DAY)]


def _folder(spark, path):
    tables = {"orders": (_ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
              "lineitem": (_ITEMS, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
              "part": ([(1, "large ring", "PROMO", 40), (2, "hot bolt", "LARGE", 20), (3, "blue ring", "SMALL", 7)], "p_partkey long, p_name string, p_type string, p_size int"),
              "customer": ([(1, 3, 4516.95, "BUILDING"), (2, 19, 900.0, "FURNITURE")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return Tables(spark, str(path))


def test_bookings_are_dealt_once_and_keep_their_rows(spark, tmp_path):
    t = _folder(spark, tmp_path)
    o, l, p, c = (t.raw(n) for n in ("orders", "lineitem", "part", "customer"))
    plain = (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
             .join(p, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(*[f"{e} AS {k}" for k, e in AGENDA.items()]))
    assert t.agenda().dtypes == plain.dtypes
    assert t.agenda().exceptAll(plain).count() == 0 and plain.exceptAll(t.agenda()).count() == 0
    got = appointments(t.agenda())
    assert got.count() == 5 and got.exceptAll(appointments(plain)).count() == 0
    # the two sides of the join only; the wide rows were dealt three times more
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def _dealt_by(df, key):
    return len(re.findall(rf"Exchange hashpartitioning\({key}#\d+L?, \d+\)", df._jdf.queryExecution().executedPlan().toString()))


def test_the_day_log_is_dealt_by_vehicle_once_and_keeps_its_counts(spark, tmp_path):
    t = _folder(spark, tmp_path)
    log = t.day_log().withColumn("n_towing", F.when(F.col("vehicle_id") == "V1", F.lit(300)).otherwise(F.col("n_towing")))
    probes = spark.createDataFrame([("V1", dt.date(1996, 1, 1)), ("V1", dt.date(1999, 1, 1)), ("V2", dt.date(1999, 1, 1)), ("V3", dt.date(1999, 1, 1))], "vehicle_id string, scoring_date date")
    seen = vehicle_history(probes, t.appt(), log)
    # intervals and histories are read in one ordering; the log was dealt once for each
    assert _dealt_by(seen, "vehicle_id") == 1
    got = {(r.vehicle_id, r.scoring_date.year): r for r in seen.collect()}
    days = {r.vehicle_id: r for r in log.groupBy("vehicle_id").agg(*[F.sum(c).alias(c) for c in COUNTERS]).collect()}
    assert days["V1"].n_towing >= 300 and {v for v, _ in got} >= set(days)
    assert all(got[v, 1999][c] == d[c] for v, d in days.items() for c in COUNTERS)
    assert all(got[k][c] == 0 for k in (("V1", 1996), ("V3", 1999)) for c in COUNTERS)


def test_flags_of_a_visit_are_dealt_as_one_number(spark, tmp_path):
    appt = _folder(spark, tmp_path).appt()
    v = dealt_visits(appt)
    plain = appt.where("vehicle_id IS NOT NULL AND event_date IS NOT NULL").select("schedule_id", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in visit_flags().items()])
    assert v.select(*plain.columns).exceptAll(plain).count() == 0 and plain.exceptAll(v.select(*plain.columns)).count() == 0


def test_anchors_are_not_dealt_by_generation(spark):
    day = dt.date(1997, 1, 1)
    rows = [("V1", day, "maintenance", "A", 30.0), ("V2", day, "maintenance", "A", 50.0), ("V3", day, "maintenance", "A", None), ("V4", day, "maintenance", None, None), ("V5", day, "warranty", "B", None)]
    rated = cut_lineage(spark.createDataFrame(rows, "vehicle_id string, anchor_date date, anchor_type string, generation string, own_rate double"))
    w = rate_with_fallback(rated)
    assert _dealt_by(w, "generation") <= 1          # the counts of the medians; the anchors are not dealt
    assert {r.vehicle_id: (r.km_rate_per_day, r.rate_source) for r in w.collect()} == {
        "V1": (30.0, "individual"), "V2": (50.0, "individual"), "V3": (40.0, "generacion"), "V4": (40.0, "generacion"), "V5": (40.0, "generacion")}


def test_definitions_share_their_dealt_anchors(spark, tmp_path):
    t = _folder(spark, tmp_path)
    grid = {n: p for n, p in default_grid(PARAMS).items() if n in ("K_GEN|lead=60|h=60", "K_16|lead=30|h=90")}
    found = windows_by_definition(t.appt(), t.sales(), grid, SPAN, RULES)
    for name, p in grid.items():
        rated = rate_with_fallback(anchors_with_rates(t.appt(), t.sales(), p, SPAN, RULES))
        plain = dated_windows(rated, p, SPAN)
        got = found[name].select(*plain.columns)
        assert plain.count() and got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    whole = window_sensitivity(t.appt(), t.sales(), grid, SPAN, RULES)
    whole.collect()
    # definitions of one set of anchors read one exchange
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(set(re.findall(r"hashpartitioning\(vehicle_id#\d+, \d+\), REPARTITION_BY_COL, \[plan_id=(\d+)\]", plan))) == 1


def test_bookings_and_items_are_dealt_by_numbers_and_keep_every_name(spark, tmp_path):
    t = _folder(spark, tmp_path / "rows")
    parts = [(1, "large ring", "PROMO", 40), (2, "hot bolt", "LARGE", 10), (3, "blue ring", "SMALL", 7), (4, "odd part", None, 10), (5, "no size", "MEDIUM", None), (6, None, "SMALL", 45)]
    items = [(1, k, 1, k, 7.0, 5.0, 0.01, 0.02, "R", "O", _DAY) for k in (1, 2, 3, 4, 5, 6, 7, None)]
    spark.createDataFrame(parts, t.raw("part").schema).write.parquet(str(tmp_path / "rows" / "part.parquet"), mode="overwrite")
    spark.createDataFrame(items, t.raw("lineitem").schema).write.parquet(str(tmp_path / "rows" / "lineitem.parquet"), mode="overwrite")
    o, l, p, c = (t.raw(n) for n in ("orders", "lineitem", "part", "customer"))
    plain = (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
             .join(p, F.col("l_partkey") == F.col("p_partkey"), "left").selectExpr(*[f"{e} AS {k}" for k, e in AGENDA.items()]))
    got = t.agenda()
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    assert {r.ServiceName for r in plain.collect()} >= {"blue ring", "odd part", "no size", "Oil and filter change", "Revision de Viaje"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the key's text would be dealt beside the key
    assert len(re.findall(r"Exchange hashpartitioning\(cast\([lo]_orderkey#\d+L? as string\)", plan)) == 2


def test_stages_are_written_small(spark, tmp_path):
    t = _folder(spark, tmp_path)
    files = t.appt().inputFiles()
    kinds = {pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0).compression for f in files}
    assert files and kinds == {"ZSTD"}


def test_tasks_follow_the_items_and_not_their_stored_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(domain, "ITEM_ROWS", 100)
    t = _folder(spark, tmp_path / "rows")
    # equal values lie side by side, so 1,000 items are stored in a few KB
    spark.createDataFrame([(1, 1, 1, 1, 17.0, 10.0, 0.06, 0.02, "R", "O", _DAY)] * 1000, t.raw("lineitem").schema).coalesce(1).write.parquet(str(tmp_path / "rows" / "lineitem.parquet"), mode="overwrite")
    plan = t.agenda()._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(cast\([lo]_orderkey#\d+L? as string\), (\d+)\)", plan)
    assert dealt == ["10", "10"]
    # two at least
    assert row_tasks(t.raw("part"), 100) == 2
