"""As-of joins, band and interval joins, neighbours and order statistics against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.operators import ranks, stats
from reprise.operators.asof import asof_join, asof_nearest, asof_tolerance, band_exists, interval_contains
from reprise.operators.history import change_runs, counts_before, next_row, previous_row

D0 = dt.date(2020, 1, 1)
day = lambda n: D0 + dt.timedelta(days=n)


def frames(spark, seed):
    r = random.Random(seed)
    # one key owns a third of the rows; nulls on both sides
    key = lambda: r.choice(["hot"] * 3 + ["a", "b", "c", "d", None])
    date = lambda: None if r.random() < 0.05 else day(r.randrange(40))
    left = [(f"l{i}", key(), date()) for i in range(80)]
    right = [(f"r{i:03d}", key(), date()) for i in range(80)]
    return (left, right, spark.createDataFrame(left, "lid string, k string, ld date"), spark.createDataFrame(right, "rid string, k string, rd date"))


@pytest.mark.parametrize("direction,exact", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_matches_brute_force(spark, direction, exact):
    left, right, l, r = frames(spark, hash((direction, exact)) % 1000)
    got = {x["lid"]: x["rid"] for x in asof_join(l, r, "k", "ld", "rd", ["rid"], direction, exact, ["rid"]).collect()}
    for lid, k, ld in left:
        c = [(rd, rid) for rid, rk, rd in right if k and rk == k and ld and rd and (
            (rd < ld or (exact and rd == ld)) if direction == "backward" else (rd > ld or (exact and rd == ld)))]
        want = (max(c) if direction == "backward" else min(c))[1] if c else None
        assert got[lid] == want
    assert len(got) == len(left)


def test_nearest_and_tolerance(spark):
    left, right, l, r = frames(spark, 5)
    near = {x["lid"]: x["gap_days"] for x in asof_nearest(l, r, "k", "ld", "rd", ["rid"], ["rid"]).collect()}
    tol = {x["lid"]: x["rid"] for x in asof_tolerance(l, r, "k", "ld", "rd", ["rid"], 5, tie=["rid"]).collect()}
    for lid, k, ld in left:
        gaps = [abs((rd - ld).days) for _, rk, rd in right if k and rk == k and ld and rd]
        assert near[lid] == (min(gaps) if gaps else None)
        ahead = sorted((rd, rid) for rid, rk, rd in right if k and rk == k and ld and rd and rd >= ld)
        assert tol[lid] == (ahead[0][1] if ahead and (ahead[0][0] - ld).days <= 5 else None)


def test_band_and_interval(spark):
    rows = [(f"s{i}", "v" if i % 3 else "w", day(i * 7 % 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, k string, d date")
    got = {x["id"]: x["in_band"] for x in band_exists(df, df, "k", "d", "d", -3, 4, "id").collect()}
    for i, k, d in rows:
        assert got[i] == any(j != i and kk == k and -3 <= (dd - d).days <= 4 for j, kk, dd in rows)
    iv = spark.createDataFrame([("v", day(0), day(5)), ("v", day(5), day(6)), ("z", day(0), day(99))], "k string, s date, e date")
    ev = spark.createDataFrame([("v", day(5))], "k string, d date")
    assert sorted((x["s"], x["hit"]) for x in interval_contains(iv, ev, "k", "s", "e", "d").collect() if x["k"] == "v") == [(day(0), False), (day(5), True)]


def test_neighbours_counts_and_runs(spark):
    r = random.Random(3)
    rows = [(f"{i:03d}", r.choice(["h", "h", "a"]), day(r.randrange(8)), r.choice(["x", "y"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, k string, d date, v string")
    prev = {x["id"]: x["prev_id"] for x in previous_row(df, "k", "d", "id", ["id"]).collect()}
    nxt = {x["id"]: x["next_id"] for x in next_row(df, "k", "d", "id", ["id"]).collect()}
    cnt = {x["id"]: x["xs"] for x in counts_before(df, "k", "d", "id", {"xs": F.col("v") == "x"}).collect()}
    runs = {x["k"]: x["n_runs"] for x in change_runs(df, "k", "d", "id", "v").collect()}
    for k in ("h", "a"):
        seq = sorted([(d, i, v) for i, kk, d, v in rows if kk == k])
        for p, (d, i, v) in enumerate(seq):
            assert prev[i] == (seq[p - 1][1] if p else None)
            assert nxt[i] == (seq[p + 1][1] if p + 1 < len(seq) else None)
            assert cnt[i] == sum(1 for s in seq[:p] if s[2] == "x")
        assert runs[k] == 1 + sum(1 for a, b in zip(seq, seq[1:]) if a[2] != b[2])


def test_row_numbers_percentiles_and_ranks(spark):
    r = random.Random(11)
    rows = [(f"{i:04d}", r.choice(["g", "g", "h", None]), r.choice([0.5, 0.5, 0.5, r.random(), -r.random() * 1e4])) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, g string, x double")
    got = {x["id"]: x["rn"] for x in ranks.number_rows(df, [F.col("x").desc(), F.col("id").asc()]).collect()}
    for want, (i, _, _) in enumerate(sorted(rows, key=lambda z: (-z[2], z[0])), 1):
        assert got[i] == want
    ps = [0.0, 0.05, 0.5, 0.9, 1.0]
    for x in stats.exact_percentiles(df, ["g"], "x", ps).collect():
        v = [z[2] for z in rows if z[1] == x["g"]]
        assert x["n"] == len(v)
        assert np.allclose([x[f"p{p * 100:g}"] for p in ps], np.quantile(v, ps))
    avg = {x["x"]: x["rank"] for x in ranks.average_rank(df, "x").collect()}
    s = sorted(z[2] for z in rows)
    for value, rank in avg.items():
        pos = [i + 1 for i, z in enumerate(s) if z == value]
        assert rank == sum(pos) / len(pos)
    within = {x["id"]: x["rn"] for x in ranks.rank_within(df, ["g"], [F.col("x").asc(), F.col("id").asc()]).collect()}
    for g in ("g", "h", None):
        for want, (i, _, _) in enumerate(sorted([z for z in rows if z[1] == g], key=lambda z: (z[2], z[0])), 1):
            assert within[i] == want


def test_percentiles_of_values_in_one_bin(spark):
    """Thousands of values between 0 and 0.003 share a bin; ranks inside it are still exact."""
    import numpy as np

    from reprise.operators.stats import exact_percentiles

    v = np.random.default_rng(3).random(4000) * 0.003
    d = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)], "v double, g int").repartition(7)
    got = {r["g"]: r for r in exact_percentiles(d, ["g"], "v", [0.05, 0.5, 0.9]).collect()}
    for g in range(3):
        want = np.percentile(v[g::3], [5, 50, 90])
        assert np.allclose([got[g]["p5"], got[g]["p50"], got[g]["p90"]], want, rtol=1e-12)


def test_one_hot_day_is_scanned_in_many_ranges(spark):
    """A third of all rows share one key and one day; counts, last values and neighbours stay exact, over all ranges."""
    from reprise.operators.history import scan_before

    n = 300_000
    df = spark.range(n).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 977)) k", "if(id % 3 = 0, date'2020-01-05', date_add(date'2020-01-01', cast(id % 13 as int))) d", "id", "id % 10 = 0 f", "if(id % 1000 = 0, id, null) v")
    out = scan_before(df, "k", [F.col("d").alias("a"), F.col("id").alias("b")], {"before": F.col("f")}, {"seen": F.col("v")}).where("k = 'hot'")
    got = out.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("before") - F.ceil(F.col("id") / 30))).alias("off"),
                  F.sum((~F.col("seen").eqNullSafe(F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3000) * 3000))).cast("int")).alias("wrong")).first()
    assert (got["n"], got["off"], got["wrong"]) == (n // 3, 0, 0)
    prev = previous_row(df, "k", "d", "id", ["id"]).where("k = 'hot' and prev_id <> id - 3").count()
    nxt = next_row(df, "k", "d", "id", ["id"]).where("k = 'hot' and next_id <> id + 3").count()
    assert prev == nxt == 0


def test_scan_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), dt.date(2020, 1, 1) + dt.timedelta(r.randrange(9)), i, r.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, id int, f boolean").repartition(9)
    got = {x["id"]: (x["c"], x["s"]) for x in counts_before(df, "k", "d", "id", {"c": F.col("f")}, {"s": F.when(F.col("f"), F.col("id"))}).collect()}
    want = {}
    for k, d, i, _ in rows:
        if k is not None:
            past = sorted((q[1], q[2]) for q in rows if q[0] == k and (q[1], q[2]) < (d, i) and q[3])
            want[i] = (len(past), past[-1][1] if past else None)
    assert got == want
