"""Logistic models of many groups fitted together: one pass over all rows a Newton step, one matrix a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from reprise.runtime import ship_package


def fit_groups(matrix: DataFrame, group: str, label: str, width: int, ridge: float = 1.0, tolerance: float = 1e-6, most_steps: int = 25) -> dict[str, np.ndarray]:
    """Ridge logistic coefficients of every group (the last one is the intercept, which is not penalised).

    ``matrix`` has ``group``, ``label`` and ``features``, a vector of ``width`` entries of like scale. A step reads the
    rows once, adds each group's gradient and curvature up in its tasks, and brings one matrix a group to the driver,
    which solves it: memory there is groups times width squared. A group that is done takes no further part.
    """
    spark = matrix.sparkSession
    ship_package(spark)
    rows = matrix.select(F.col(group).cast("string").alias("g"), F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x")).where(F.col("y").isNotNull())
    names = [r["g"] for r in rows.select("g").distinct().collect()]
    beta, value, done = {g: np.zeros(width + 1) for g in names}, {}, set()
    step_of: dict[str, np.ndarray] = {g: np.zeros(width + 1) for g in names}
    penalty = np.append(np.full(width, ridge), 0.0)
    for _ in range(most_steps):
        sent = spark.sparkContext.broadcast({g: b for g, b in beta.items() if g not in done})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                g = b.column("g").dictionary_encode()
                code, y = g.indices.to_numpy(zero_copy_only=False), b.column("y").to_numpy()
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for k, name in enumerate(g.dictionary.to_pylist()):
                    if name not in sent.value:
                        continue
                    at = code == k
                    z = np.hstack([x[at], np.ones((at.sum(), 1))])
                    eta = z @ sent.value[name]
                    p = 1 / (1 + np.exp(-eta))
                    part = np.vstack([(z * (p * (1 - p))[:, None]).T @ z, z.T @ (y[at] - p), np.zeros(width + 1)])
                    part[-1, 0] = (y[at] * eta - np.logaddexp(0, eta)).sum()
                    sums[name] = sums.get(name, 0.0) + part
            for name, m in sums.items():
                yield pa.record_batch([pa.array([name] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))], ["g", "i", "row"])

        cells = rows.mapInArrow(run, "g string, i int, row array<double>").select("g", "i", F.posexplode("row").alias("j", "v")).groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
        whole = {g: np.zeros((width + 3, width + 1)) for g in names}
        for r in cells.collect():
            whole[r["g"]][r["i"], r["j"]] = r["v"]
        for g in names:
            if g in done:
                continue
            m, now = whole[g], whole[g][-1, 0] - 0.5 * (penalty * beta[g] ** 2).sum()
            if g in value and now < value[g] - 1e-9 * abs(value[g]):        # too far: half the way back
                step_of[g] = step_of[g] / 2
                beta[g] = beta[g] - step_of[g]
                continue
            value[g] = now
            step_of[g] = np.linalg.solve(m[:width + 1] + np.diag(penalty + 1e-9), m[width + 1] - penalty * beta[g])
            beta[g] = beta[g] + step_of[g]
            if np.abs(step_of[g]).max() < tolerance:
                done.add(g)
        if len(done) == len(names):
            break
    return beta


def score_groups(matrix: DataFrame, group: str, beta: dict[str, np.ndarray], keep: list[str], alias: str = "p") -> DataFrame:
    """``keep`` and the probability of every row under its group's model; null for a group without one."""
    spark = matrix.sparkSession
    models = spark.createDataFrame([(g, [float(v) for v in b]) for g, b in beta.items()], "_g string, _b array<double>")       # one row a group
    rows = matrix.join(F.broadcast(models), F.col(group) == F.col("_g"), "left").withColumn("_x", vector_to_array("features"))
    eta = F.aggregate(F.arrays_zip(F.col("_x").alias("x"), F.slice("_b", 1, F.size("_x")).alias("b")), F.element_at("_b", -1), lambda s, z: s + z["x"] * z["b"])
    return rows.select(*keep, (1 / (1 + F.exp(-eta))).alias(alias))
