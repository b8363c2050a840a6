"""Level cubes, table differences and paged lists against plain versions."""

import collections
import random

from pyspark.sql import functions as F

from reprise.operators import contact as ct, cube as cb, difference as df_


def test_cube_and_standardised_rates(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), r.choice(["young", "old", None]), int(r.random() < 0.4)) for _ in range(500)]
    d = spark.createDataFrame(rows, "f string, g string, age string, y int").repartition(6)
    cube = cb.level_cube(d, {"f": F.col("f"), "g": F.col("g")}, ["y"], F.col("age"), [("f", "g")])
    rates = {(x["feature"], x["level"]): (x["n"], x["y_rate"]) for x in cb.level_rates(cube, ["y"]).collect()}
    for k, name in ((0, "f"), (1, "g")):
        for level in {q[k] for q in rows}:
            ys = [q[3] for q in rows if q[k] == level]
            n, rate = rates[name, level or "(nulo)"]
            assert n == len(ys) and abs(rate - sum(ys) / n) < 1e-12
    assert {(x["level"], x["other_level"]): x["n"] for x in cb.cross_rates(cube, "y").collect()} == dict(collections.Counter((q[0], q[1] or "(nulo)") for q in rows))
    known = [q for q in rows if q[2]]
    mix = collections.Counter(q[2] for q in known)
    for x in cb.standardised_rates(cube, "y").where("feature = 'f'").collect():
        part = {a: [q[3] for q in known if q[0] == x["level"] and q[2] == a] for a in mix}
        assert abs(x["standardised"] - sum(mix[a] * sum(v) / len(v) for a, v in part.items()) / sum(mix.values())) < 1e-12 and x["covered"] == 1.0


def test_differences_are_found_and_nothing_else(spark):
    a = spark.range(20_000).selectExpr("concat('k', id) k", "cast(id % 7 as int) u", "if(id % 5 = 0, null, id) v")
    assert df_.differing_cells(a, a.repartition(3), "k", ["u", "v"]).count() == 0
    b = a.withColumns({"u": F.when(F.col("k") == "k77", 100).otherwise(F.col("u")), "v": F.when(F.col("k").isin("k77", "k5"), 1).otherwise(F.col("v"))}).where("k <> 'k9'").unionByName(spark.sql("select 'new' k, 1 u, cast(2 as bigint) v"))
    got = {(r["key"], r["column"]): (r["first"], r["second"], r["kind"]) for r in df_.differing_cells(a, b, "k", ["u", "v"]).collect()}
    assert got == {("k77", "u"): ("0", "100", "changed"), ("k77", "v"): ("77", "1", "changed"), ("k5", "v"): (None, "1", "changed"), ("k9", "u"): ("2", None, "only_first"), ("k9", "v"): ("9", None, "only_first"),
                   ("new", "u"): (None, "1", "only_second"), ("new", "v"): (None, "2", "only_second")}
    assert df_.differing_cells(a.limit(0), a.limit(0), "k", ["u", "v"]).count() == 0


def test_pages_of_a_large_fleet(spark):
    """Search and counts over pages equal the long table; one client owns 100,000 vehicles."""
    c = spark.range(100_000).selectExpr("'fleet' _cliente", "concat('V', id) _vehiculo", "'Alto' segmento").unionByName(spark.range(30).selectExpr("concat('c', id % 10) _cliente", "concat('W', id) _vehiculo", "'Medio' segmento"))
    c = c.unionByName(c.limit(50)).unionByName(spark.sql("select '' _cliente, 'V1' _vehiculo, 'Alto' segmento"))
    pages = ct.client_pages(c)
    sizes = {(r["_cliente"], r["page"]): r["n"] for r in pages.select("_cliente", "page", "n").collect()}
    assert sum(n for (k, _), n in sizes.items() if k == "fleet") == 100_000 and max(sizes.values()) == ct.PAGE and len(sizes) == 110
    long = ct.client_vehicles(c)
    for part in ("v9999", "c3", "nothing"):
        want = long.where(F.lower("_vehiculo").contains(part) | F.lower("_cliente").contains(part)).collect()
        assert sorted(map(tuple, ct.find_in_pages(pages, part).collect())) == sorted(map(tuple, want))
    first = pages.where("_cliente = 'fleet' and page = 1").first()["vehicles"]
    assert first == sorted(first) and first[0] > max(pages.where("_cliente = 'fleet' and page = 0").first()["vehicles"])
