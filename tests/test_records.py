"""Quoted text over many splits, and the ledger of cells that can't be typed."""

import csv
import datetime as dt
import random

from reprise.sources import records as rc


def written(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)


def test_records_over_small_splits(spark, tmp_path):
    """Splits of 97 bytes cut records, quotes and runs of line feeds anywhere."""
    r = random.Random(4)
    bits = ["plain", "", 'a "quoted" word', "two\nlines", "\n\n\n", 'ends with "', "comma, here", '"', "x" * 200, 'mix "\n", "\n']
    rows = [[str(i), r.choice(bits), r.choice(bits)] for i in range(300)]
    (tmp_path / "d").mkdir()
    written(tmp_path / "d" / "a.csv", [["id", "u", "v"], *rows[:170]])
    written(tmp_path / "d" / "b.csv", [["id", "u", "v"], *rows[170:]])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        table = rc.read_quoted_csv(spark, str(tmp_path / "d"))
        got = sorted((int(x["id"]), x["u"] or "", x["v"] or "", x["_malformed"]) for x in table.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(int(i), u, v, False) for i, u, v in rows]


def test_cells_that_cannot_be_typed(spark, tmp_path):
    written(tmp_path / "a.csv", [["vehicle_id", "ScheduleDate", "KM", "ServiceName"], ["v1", "2024-05-01", "12.5", " Oil "], ["v2", "soon", "n/a", "x\ny"], ["v3", "", " ", ""], ["v4", "2024-05-02 10:00:00+00:00", "7", None], ["v5", "2024-05-03"]])
    t = rc.agenda_with_ledger(spark, str(tmp_path / "a.csv"))
    rows = {x["vehicle_id"]: x for x in t.collect()}
    assert rows["v1"]["ScheduleDate"] == dt.date(2024, 5, 1) and rows["v1"]["KM"] == 12.5 and rows["v1"]["ServiceName"] == "Oil" and rows["v2"]["ServiceName"] == "x\ny"
    assert rows["v4"]["ScheduleDate"] == dt.date(2024, 5, 2) and rows["v5"]["_malformed"] and not rows["v1"]["_malformed"]
    led = sorted((x["nth"], x["column"], x["raw"], x["reason"]) for x in rc.reject_ledger(t).collect())
    assert [x[1:] for x in led] == [("KM", "n/a", "not a number"), ("ScheduleDate", "soon", "not a date")]
