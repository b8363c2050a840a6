"""Extract typing, collapse to visits, window rules and publishing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reprise import fixed_values as fv
from reprise.operators import events as ev, windows as wd
from reprise.params import DataSpan, WindowParams
from reprise.sources import extracts, publish, validation

D = dt.date


def agenda(spark, rows):
    cols = {**{c: "string" for c in fv.VISIT_COLUMNS}, **{c: "double" for c in ("ModelYear", "KM", "VehicleCurrentKM", "DaysInDealer", "WorkDaysInDealer", "EffectiveTerm", "SurveyStarRating", "ServiceMaintenance")},
            **{c: "date" for c in ("ScheduleDate", "ScheduleDateTime", "EffectiveCheckinDate", "EffectiveCheckoutDate", "SurveyResponseDate", "WarrantyStartDate")},
            "schedule_id": "string", "ServiceName": "string", "ServiceType": "string", "ServiceFordFixedPriceFlag": "string"}
    base = dict(vehicle_id="v", customer_id="c", StatusARG=fv.ST_DONE)
    return spark.createDataFrame([tuple({**base, **r}.get(c) for c in cols) for r in rows], ", ".join(f"{c} {t}" for c, t in cols.items()))


def test_collapse(spark):
    a = agenda(spark, [
        dict(schedule_id="1", ScheduleDate=D(2024, 5, 1), ServiceMaintenance=2.0, ServiceName="2° Maintenance service"),
        dict(schedule_id="1", ScheduleDate=D(2024, 5, 1), ServiceMaintenance=2.0, ServiceName="2° Maintenance service"),
        dict(schedule_id="1", ScheduleDate=D(2024, 5, 1), ServiceMaintenance=1.0, ServiceName="1° Maintenance service", dealer_id=None),
        dict(schedule_id="1", ScheduleDate=D(2024, 5, 1), ServiceName="Guarantee", dealer_id="d9"),
        dict(schedule_id="2", ScheduleDate=D(2024, 5, 1), EffectiveCheckinDate=D(2024, 6, 16), ServiceName="Guarantee"),
        dict(schedule_id="3", ScheduleDate=D(2024, 5, 1), EffectiveCheckinDate=D(2024, 6, 15), StatusARG=fv.ST_DONE_NO_ORDER, ServiceMaintenance=3.0)])
    got = {r["schedule_id"]: r for r in ev.appointments(a).collect()}
    assert got["1"]["n_items"] == 3 and got["1"]["maint_number"] == 1.0 and got["1"]["dealer_id"] == "d9" and got["1"]["has_guarantee"]
    assert got["1"]["is_completed_maintenance"] and not got["2"]["has_maint"] and not got["2"]["is_completed_maintenance"]
    assert got["2"]["event_date"] == D(2024, 5, 1) and got["3"]["event_date"] == D(2024, 6, 15) and not got["3"]["is_completed_maintenance"]


def test_split_visits_chain_and_fold(spark):
    days = spark.createDataFrame([("v", D(2024, 1, 1), 1.0, 500.0), ("v", D(2024, 1, 31), 1.0, 500.0), ("v", D(2024, 3, 1), 1.0, 500.0), ("v", D(2024, 4, 2), 1.0, 900.0), ("v", D(2024, 4, 5), 2.0, 400.0), ("w", D(2024, 1, 1), None, 1.0),
                                  ("w", D(2024, 1, 2), None, 2.0)], "vehicle_id string, event_date date, maint_number double, km double")
    chain = sorted((r["vehicle_id"], r["event_date"]) for r in ev.drop_split_visits(days).collect())
    fold = sorted((r["vehicle_id"], r["event_date"]) for r in ev.fold_duplicates(days).collect())
    assert chain == [("v", D(2024, 1, 1)), ("v", D(2024, 4, 2)), ("v", D(2024, 4, 5)), ("w", D(2024, 1, 1)), ("w", D(2024, 1, 2))]
    assert fold == [("v", D(2024, 1, 1)), ("v", D(2024, 3, 1)), ("v", D(2024, 4, 2)), ("v", D(2024, 4, 5)), ("w", D(2024, 1, 1)), ("w", D(2024, 1, 2))]


def test_reading_after_unknown_is_not_checked(spark):
    days = spark.createDataFrame([("v", D(2024, 1, i), k) for i, k in enumerate([100.0, 500.0, 300.0, None, 200.0, 450.0, 600.0], 1)], "vehicle_id string, event_date date, km double")
    assert [r["km"] for r in ev.monotonic_km(days).orderBy("event_date").collect()] == [100.0, 500.0, None, None, 200.0, None, 600.0]


def test_due_rules_round_half_even_and_labels(spark):
    a = spark.createDataFrame([("km", D(2024, 1, 1), 16000.0, 32.0 * 16000 / 16400), ("half", D(2024, 1, 1), 200.5, 1.0), ("floor", D(2024, 1, 1), 10.0, 1.0), ("time", D(2024, 1, 1), 16000.0, None)],
                              "vehicle_id string, anchor_date date, k_gen double, km_rate_per_day double").withColumns({"anchor_type": F.lit("maintenance"), "rate_source": F.lit("individual")})
    got = {r["vehicle_id"]: r for r in wd.due_dates(a, WindowParams()).collect()}
    assert got["half"]["due_km"] == D(2024, 1, 1) + dt.timedelta(days=200) and got["half"]["binding_rule"] == "km"
    assert got["floor"]["binding_rule"] == "piso" and got["floor"]["due_date"] == D(2024, 3, 31) and got["time"]["binding_rule"] == "tiempo"
    span = DataSpan(D(2024, 1, 1), D(2026, 1, 1))
    w = spark.createDataFrame([("back_on_end", D(2025, 3, 31)), ("preempted", D(2024, 12, 1)), ("late", D(2025, 4, 1)), ("never", None)], "vehicle_id string, next_maint_date date").withColumns(
        {"scoring_date": F.lit(D(2024, 12, 1)), "due_date": F.lit(D(2024, 12, 31)), "horizon_end": F.lit(D(2025, 3, 31)), "next_visit_date": F.lit(None).cast("date"), "warranty_start": F.lit(D(2023, 1, 1)), "first_seen": F.lit(None).cast("date")})
    got = {r["vehicle_id"]: (r["status"], r["label_churn"]) for r in wd.label_and_status(w, WindowParams(), span).collect()}
    assert got == {"back_on_end": ("evaluable", 0.0), "preempted": ("preempted", None), "late": ("evaluable", 1.0), "never": ("evaluable", 1.0)}


def test_horizon_crossing_counts(spark):
    w = spark.createDataFrame([("evaluable", D(2025, 1, 1), D(2025, 10, 1)), ("evaluable", D(2025, 2, 1), D(2025, 9, 30)), ("evaluable", D(2025, 10, 5), D(2026, 2, 1)), ("censurada", D(2025, 1, 1), D(2027, 1, 1))],
                              "status string, scoring_date date, horizon_end date")
    got = {r["period"]: (r["windows"], r["crossing"], r["share"]) for r in wd.horizon_crossing(w, D(2025, 9, 30), D(2025, 12, 31)).collect()}
    assert got == {"train": (2, 1, 0.5), "valid": (1, 1, 1.0)}


def test_csv_typing_and_validation(spark, tmp_path):
    p = tmp_path / "sales.csv"
    head = fv.SALES_REQUIRED + ["SalesType"]
    vals = {"vehicle_id": "v1", "customer_id": "c1", "SalesDate": "2024-03-01 00:00:00+00:00", "DeliveryDate": "2024-03-05", "RegistrationDate": "31/12/2024", "ModelYear": "2024", "ModelName": "X   ", "Status": "ACCEPTED"}
    p.write_text("﻿" + ",".join(head) + "\n" + ",".join(vals.get(c, "") for c in head) + "\n", encoding="utf-8")
    s = extracts.load_sales(spark, str(p)).first()
    assert (s["SalesDate"], s["DeliveryDate"], s["RegistrationDate"], s["ModelYear"], s["ModelName"]) == (D(2024, 3, 1), D(2024, 3, 5), None, 2024, "X")
    assert "SalesType" not in s.asDict()
    raw = extracts.read_raw_csv(spark, str(p))
    prof = validation.profile_extract(raw, ["vehicle_id", "dealer_id"], ["SalesDate", "RegistrationDate"], "SalesDate").first().asDict()
    assert prof["empty_dealer_id"] == 1 and prof["invalid_RegistrationDate"] == 1 and prof["last_event"] == D(2024, 3, 1)
    assert validation.accept(prof, ["vehicle_id", "dealer_id"], D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)) == ["column dealer_id is empty in every row"]
    assert validation.check_header(["a", "a", ""], ["a", "b"]) == ["empty column name", "repeated: a", "missing: b"]
    first = extracts.build_interim(spark, str(p), str(tmp_path / "interim"), "sales").count()
    p.write_text(",".join(head) + "\n")
    assert extracts.build_interim(spark, str(p), str(tmp_path / "interim"), "sales").count() == first == 1


def test_publish_manifest_last_and_isolation(spark, tmp_path):
    root = str(tmp_path / "pub")
    s1, s2 = spark.range(5).selectExpr("id", "id * 2 AS x"), spark.range(6).selectExpr("id", "id * 2 AS x")
    publish.publish_run({"scores": s1}, s1, root, "ds1", "run1")
    publish.publish_run({"scores": s2}, s2, root, "ds2", "run1")
    assert publish.read_latest(spark, root, "ds1", "scores").count() == 5 and publish.catalogue(spark, root).count() == 2
    bad = s2.select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception):
        publish.publish_run({"scores": s2, "zz": bad}, s2, root, "ds1", "run2")
    assert publish.read_latest(spark, root, "ds1", "scores").count() == 5          # the broken run has no manifest row
    assert not publish.is_stale(spark, root, "ds1", s1.orderBy(F.col("id").desc())) and publish.is_stale(spark, root, "ds1", s2)


def test_ids_with_leading_zeros_are_found(spark, tmp_path):
    root, s1 = str(tmp_path / "pub"), spark.range(3)
    publish.publish_run({"scores": s1}, s1, root, "007", "001")
    publish.publish_run({"scores": s1}, s1, root, "7", "001")
    assert publish.read_latest(spark, root, "007", "scores").count() == 3 and publish.catalogue(spark, root).count() == 2


def test_half_written_copy_is_replaced_and_malformed_lines_are_told(spark, tmp_path):
    csv = tmp_path / "sales.csv"
    head = "vehicle_id,SalesDate,ModelYear,ModelName"
    csv.write_text(head + '\nv1,2024-01-02,2024,R\nv2,2024-01-02,2024,R,surplus\nv3,2024-01-02,"2024\n",R\n')
    assert sorted(r.line[:2] for r in extracts.malformed_rows(spark, str(csv)).collect())[-2:] == ["v2", "v3"]
    csv.write_text(head + "\nv1,2024-01-02,2024,R\n")
    target = tmp_path / "interim"
    target.mkdir()                                   # a writer died before its first file
    assert extracts.build_interim(spark, str(csv), str(target), "sales").count() == 1
    csv.write_text(head + "\n")
    assert extracts.build_interim(spark, str(csv), str(target), "sales").count() == 1         # finished: kept
    assert extracts.build_interim(spark, str(csv), str(target), "sales", force=True).count() == 0
