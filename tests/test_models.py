"""Invariants of fitted models on a small learnable population."""

import datetime as dt
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.operators import batched as bt, evaluate as el, matrix as mx, model as md, newton as nw, pooled as pl, trees as tr
from reprise.params import SplitParams

SPLIT = SplitParams(dt.date(2020, 6, 30), dt.date(2020, 9, 30))


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(1)
    rows = []
    for i in range(900):
        n, age, src = r.randrange(6), r.random() * 10 if r.random() > 0.1 else None, r.choice(["A", "B"])
        p = 1 / (1 + math.exp(-(0.9 * n - 2.5 + (0.8 if src == "A" else 0))))
        rows.append((f"w{i:04d}", f"v{i}", "c", dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(365)), float(r.random() < p), n, age, src, r.choice(["km", "tiempo"])))
    d = spark.createDataFrame(rows, "window_id string, vehicle_id string, customer_id string, scoring_date date, label_churn double, n_noshow int, vehicle_age_years double, last_source string, binding_rule string")
    return md.train_all(d, SPLIT, max_iter=5)


def test_learns_and_calibration_is_monotone(spark, fitted):
    t = fitted["test"].select(F.col("window_id").alias("id"), F.col("label_churn").alias("y"), "p_gbt_raw", "p_gbt", "p_lr").persist()
    assert el.discrimination(t.withColumn("p", F.col("p_gbt_raw"))).first()["roc_auc"] > 0.7
    assert el.discrimination(t.withColumn("p", F.col("p_lr"))).first()["roc_auc"] > 0.7
    pts = sorted((r["p_gbt_raw"], r["p_gbt"]) for r in t.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pts, pts[1:])) and all(0 <= p <= 1 for _, p in pts)


def test_contributions_add_up(fitted):
    """Contributions and one constant make the log-odds; of the trees the constant is the explainer's base."""
    from pyspark.ml.functions import vector_to_array

    test = fitted["lr_matrix"].where("period = 'test'")
    c = md.lr_contributions(fitted, test, ["window_id"]).groupBy("window_id").agg(F.sum("contribution").alias("s"))
    m = fitted["lr"].transform(test).select("window_id", vector_to_array("rawPrediction")[1].alias("m")).join(c, "window_id")
    gaps = [r["m"] - r["s"] for r in m.collect()]
    assert len(gaps) == test.count() and max(gaps) - min(gaps) < 1e-8
    test = fitted["gbt_matrix"].where("period = 'test'")
    g = md.tree_contributions(fitted, test, ["window_id"]).groupBy("window_id").agg(F.sum("contribution").alias("s"))
    p = fitted["gbt"].transform(test).select("window_id", vector_to_array("probability")[1].alias("p")).join(g, "window_id").collect()
    base = tr.explainer(fitted["nodes"], fitted["gbt_prep"]).base
    assert len(p) == test.count() and all(abs(math.log(r["p"] / (1 - r["p"])) - r["s"] - base) < 1e-9 for r in p)


def subset_value(tree, known, x, inputs):
    """Expected leaf value when only ``known`` inputs are seen: other splits go both ways by cover."""
    def walk(at):
        r = tree[at]
        if r["feature"] is None:
            return r["value"]
        lower, upper = r["lower"], r["upper"]
        if r["input"] in known:
            return walk(lower if x[r["feature"]] <= r["threshold"] else upper)
        return sum(tree[c]["cover"] / r["cover"] * walk(c) for c in (lower, upper))
    return walk(0)


def test_shapley_values_equal_brute_force(fitted):
    """Against all subsets of inputs, on some rows."""
    import itertools

    trees = {}
    for r in fitted["nodes"].collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    players = fitted["gbt_prep"].inputs()
    rows = fitted["gbt_matrix"].where("period = 'test'").orderBy("window_id").limit(6).collect()
    got = {}
    for r in md.tree_contributions(fitted, fitted["gbt_matrix"].where("period = 'test'"), ["window_id"]).collect():
        got[r["window_id"], r["feature"]] = r["contribution"]
    for row in rows:
        x = row["features"].toArray()
        value = {k: sum(2 * t[0]["weight"] * subset_value(t, set(k), x, players) for t in trees.values()) for n in range(len(players) + 1) for k in itertools.combinations(players, n)}
        for p in players:
            rest, total = [q for q in players if q != p], 0.0
            for n in range(len(rest) + 1):
                for k in itertools.combinations(rest, n):
                    total += math.factorial(n) * math.factorial(len(players) - n - 1) / math.factorial(len(players)) * (value[tuple(sorted((*k, p)))] - value[k])
            assert abs(total - got[row["window_id"], p]) < 1e-9


def test_split_shares_equal_the_models_own(fitted):
    shares = {r["feature"]: r for r in md.feature_importance(fitted).collect()}
    own = fitted["gbt"].featureImportances.toArray()
    want = {}
    for i, v in enumerate(own):
        want[fitted["gbt_prep"].input_of(i)] = want.get(fitted["gbt_prep"].input_of(i), 0.0) + v
    assert all(abs(shares[c]["gain_pct"] - v) < 1e-9 for c, v in want.items() if c in shares) and abs(sum(r["splits_pct"] for r in shares.values()) - 1) < 1e-12
    assert sum(r["splits"] for r in shares.values()) == fitted["nodes"].where("feature is not null").count()


def test_save_and_score(spark, fitted, tmp_path):
    md.save_model(fitted, str(tmp_path / "m"))
    pop = fitted["split"].where("period = 'test'").drop("period")
    a = {r["window_id"]: r["prob_churn"] for r in md.score_with_saved(spark, str(tmp_path / "m"), pop).collect()}
    b = {r["window_id"]: r["p_gbt"] for r in fitted["test"].collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_odds_ratio_of_a_two_by_two_table(spark):
    rows = [("x", 1)] * 30 + [("x", 0)] * 10 + [("y", 1)] * 20 + [("y", 0)] * 40 + [("z", 1)] * 3 + [("none", 0)] * 4 + [(None, 1)]
    d = spark.createDataFrame(rows, "f string, t int")
    got = {r["level"]: r["odds_ratio"] for r in nw.odds_ratios(d, {"f": "y"}, "t").collect()}
    assert abs(got["x"] - (30 / 10) / (20 / 40)) < 1e-10 and got["z"] == math.inf and got["none"] == 0 and len(got) == 3


def plain_newton(x, y, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p), rcond=1e-12)[0]
    return b


def test_absorbed_factor_equals_plain_newton(spark):
    """Three factors and a slope, one factor with many levels."""
    r = random.Random(5)
    rows = []
    for _ in range(4000):
        a, b, c, v = r.randrange(40), r.choice("pqr"), r.choice("st"), r.randrange(-3, 4)
        eta = 0.05 * (a - 20) + (0.7 if b == "q" else 0) - (0.4 if c == "t" else 0) + 0.3 * v
        rows.append((f"d{a:02d}", b, c, float(v), int(r.random() < 1 / (1 + math.exp(-eta)))))
    d = spark.createDataFrame(rows, "a string, b string, c string, v double, y int")
    fit = nw.fit_logit(d, {"a": "d00", "b": "p", "c": "s"}, "y", ["v"])
    names = [("a", f"d{k:02d}") for k in range(1, 40)] + [("b", "q"), ("b", "r"), ("c", "t")]
    x = np.array([[1.0, *[float({"a": q[0], "b": q[1], "c": q[2]}[f] == lv) for f, lv in names], q[3]] for q in rows])
    want = plain_newton(x, np.array([q[4] for q in rows], float))
    got = {(q["factor"], q["level"]): q["coef"] for q in fit.levels.collect()}
    assert max(abs(got[n] - w) for n, w in zip(names, want[1:])) < 1e-8 and abs(fit.slopes["v"] - want[-1]) < 1e-8
    assert got["a", "d00"] == got["b", "p"] == got["c", "s"] == 0 and fit.rows == 4000


def test_vocabulary_levels_sent_or_shuffled(spark):
    """The same matrix whether all levels are sent, or only frequent ones and the others met by a shuffle."""
    d = spark.range(6000).selectExpr("concat('w', id) window_id", "if(id % 3 = 0, 'hot', concat('v', id % 1500)) a", "if(id % 7 = 0, null, concat('k', id % 5)) b", "cast(if(id % 11 = 0, null, id % 9) as double) x")
    got = []
    for sent in (50_000, 10):
        prep = mx.prepare(d, ["x"], ["a", "b"], True, 2, sent)
        got.append({r["window_id"]: r["features"] for r in prep.matrix(d, ["window_id"]).collect()})
        assert prep.width == 2 + prep.vocabulary.sizes["a"] + prep.vocabulary.sizes["b"] + 2
    assert got[0] == got[1] and len(got[0]) == 6000
    assert all(v.size == prep.width and v.indices.tolist() == sorted(v.indices.tolist()) for v in got[1].values())
    unseen = spark.createDataFrame([("n", "never seen", "k1", 1.0)], "window_id string, a string, b string, x double")
    assert 2 + prep.vocabulary.sizes["a"] in prep.matrix(unseen, ["window_id"]).first()["features"].indices.tolist()


def test_vocabulary_of_a_million_levels(spark):
    """Levels stay in Spark: a row a column reaches the driver."""
    d = spark.range(1_000_000).selectExpr("concat('w', id) window_id", "concat('v', id) a")
    prep = mx.prepare(d, [], ["a"], False, 1)
    m = prep.matrix(d, ["window_id"])
    assert prep.vocabulary.sizes == {"a": 1_000_000} and len(m.schema.json()) < 2000
    assert m.where("window_id in ('w5', 'w999999')").select("features").distinct().count() == 2


def brute_isotonic(points):
    xs = sorted({x for x, _ in points})
    w = {x: [y for q, y in points if q == x] for x in xs}
    mean = lambda i, j: sum(sum(w[x]) for x in xs[i:j + 1]) / sum(len(w[x]) for x in xs[i:j + 1])
    return {x: max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k, x in enumerate(xs)}


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties"])
def test_isotonic_blocks_equal_max_min(spark, kind, monkeypatch):
    monkeypatch.setattr(pl, "FAN_IN", 2)
    r = random.Random(2)
    f = {"noise": lambda k: (r.random(), float(r.random() < 0.4)), "rising": lambda k: (float(k), float(k > 40)), "falling": lambda k: (float(k), float(k < 40)), "ties": lambda k: (float(k % 6), float(r.random() < 0.1 * (k % 6)))}[kind]
    points = [f(k) for k in range(90)]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "p double, y double").repartition(7)
    blocks = sorted((b["lo"], b["hi"], b["w"], b["value"]) for b in pl.isotonic_blocks(df, "p", "y").collect())
    want = brute_isotonic(points)
    assert sum(b[2] for b in blocks) == 90 and all(a[3] < b[3] for a, b in zip(blocks, blocks[1:]))
    for x, v in want.items():
        assert abs(next(b[3] for b in blocks if b[0] <= x <= b[1]) - v) < 1e-12
    model = pl.fit_isotonic(df, "p", "y")
    got = md.calibrated(model, df.where("p is not null"), "p", "q").collect()
    assert all(abs(g["q"] - want[g["p"]]) < 1e-12 for g in got if g["y"] is not None)


def test_period_without_both_classes_is_refused(spark):
    d = spark.createDataFrame([("w", dt.date(2020, 1, 1), 1.0)], "window_id string, scoring_date date, label_churn double")
    with pytest.raises(ValueError):
        md.require_both_classes(md.temporal_split(d, SPLIT))


def test_batched_fits_equal_fits_alone(spark):
    """Three groups in the same passes against plain penalised Newton steps of each."""
    from pyspark.ml.functions import array_to_vector

    r = random.Random(9)
    rows = []
    for g, shift in (("a", 0.0), ("b", 1.5), ("c", -1.0)):
        for _ in range(700):
            x = [r.gauss(0, 1), r.gauss(0, 1), float(r.random() < 0.2)]
            rows.append((g, float(r.random() < 1 / (1 + math.exp(-(shift + 0.8 * x[0] - 0.5 * x[2])))), x))
    d = spark.createDataFrame(rows, "g string, y double, x array<double>").withColumn("features", array_to_vector("x")).repartition(5)
    beta = bt.fit_groups(d, "g", "y", 3, ridge=2.0, tolerance=1e-9)
    for g in "abc":
        x = np.array([[*v, 1.0] for k, _, v in rows if k == g])
        y = np.array([t for k, t, _ in rows if k == g])
        b, penalty = np.zeros(4), np.diag([2.0, 2.0, 2.0, 0.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-x @ b))
            b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        assert np.abs(b - beta[g]).max() < 1e-6
        got = sorted(q["p"] for q in bt.score_groups(d, "g", beta, ["g"]).where(F.col("g") == g).collect())
        assert np.allclose(got, sorted(1 / (1 + np.exp(-x @ b))), atol=1e-6)


def test_definitions_are_checked_by_their_inputs_alone(spark):
    """What the check doesn't read is neither stored nor dealt, and changes nothing."""
    rows = [(d, f"v{k}", dt.date(1998 + k % 4, 1 + k % 12, 1), float((k * 7) % 3 > 0), float(k % 11), "D" if k % 2 else "E", "text " * 50) for d in ("a", "b") for k in range(240)]
    f = spark.createDataFrame(rows, "definition string, vehicle_id string, scoring_date date, label_churn double, n_maint double, generation string, note string")
    split = SplitParams(train_end=dt.date(1998, 12, 31), valid_end=dt.date(1999, 9, 30))
    assert md.checked_columns(f).columns == ["definition", "vehicle_id", "scoring_date", "label_churn", "n_maint", "generation"]
    got = [md.check_definitions(x, split).orderBy("definition").collect() for x in (f, f.drop("note"))]
    assert got[0] == got[1] and [r.n_train + r.n_test for r in got[0]] == [240, 240]


def test_variants_are_fitted_side_by_side(spark, monkeypatch):
    """Each variant waits for another one to have begun; its own failure comes out."""
    began = threading.Barrier(2, timeout=60)

    def variant(x, split, drop, name, max_iter):
        if name in ("base", "no_high_cardinality"):
            began.wait()
        if name == "no_surveys" and max_iter == 0:
            raise ValueError(name)
        return spark.createDataFrame([(name, f"{k}", float(k % 2), k / 10) for k in range(10)], "modelo string, id string, y double, p double")

    monkeypatch.setattr(md, "_variant", variant)
    data = spark.createDataFrame([(200, "warranty")], "history_days int, anchor_type string")
    assert sorted(r.modelo for r in md.ablations(data, None, None, 1).collect()) == sorted(["base", "no_high_cardinality", "agenda_only", "history_6_months", "no_surveys", "with_connectivity_snapshot", "first_service_only", "later_services_only"])
    began.reset()
    with pytest.raises(ValueError, match="no_surveys"):
        md.ablations(data, None, None, 0)
