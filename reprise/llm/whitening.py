"""Embedding whitening: equal vectors grouped with their multiplicity, weighted centred matrix products, each distinct
vector whitened once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reprise.llm.common import staged
from reprise.llm.topk import usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: A group with at least this share of its rows (one in HOT) is joined by broadcast; there are HOT such groups at most.
HOT = 1000
_BOUND = 2.0 ** 61
_BATCH = 1 << 18


@dataclass
class Fit:
    """Whitening of vectors of one length: exact sums of the fit list, and the kept eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def explained(self) -> list[float]:
        return (self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))).tolist()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of their variance; NaN where a component has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (centred(x, self.n, self.sums)[0] @ self.vectors) / np.sqrt(self.values)
        return np.where(self.values > 0, z, np.nan)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_width(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch that hold vectors of one length, of bounded size."""
    width = b.column("width").to_numpy()
    for w in np.unique(width):
        part = b.filter(pa.array(width == w))
        step = max(1, _BATCH // int(w))
        for s in range(0, part.num_rows, step):
            yield int(w), part.slice(s, step)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they hold it, Python integers elsewhere."""
    if int(np.abs(x).max(initial=0)) * n < 2 ** 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entries less their mean, rounded once, and the exact differences."""
    d = differences(x, n, sums)
    return (d / n).astype(np.float64), d


def deviations(d: np.ndarray) -> list[int]:
    """Sum of squared differences of each row, exact."""
    if d.dtype == object or int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2 ** 63:
        return [sum(int(v) ** 2 for v in r) for r in d]
    return (d * d).sum(1).tolist()


def totals(groups: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Weight and exact sums per dimension of each vector length; one row a dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for w, part in by_width(b, "x"):
                x, m = rows_of(part.column("x")), part.column("weight").to_numpy()
                total = int(m.sum())
                small = int(np.abs(x).max(initial=0)) * total < 2 ** 62
                add = (m @ x).astype(object) if small else (m.astype(object)[:, None] * x.astype(object)).sum(0)
                weight[w] = weight.get(w, 0) + total
                sums[w] = sums.get(w, np.zeros(w, object)) + add
        out = [(w, i, weight[w] if i == 0 else 0, Decimal(int(v))) for w, s in sums.items() for i, v in enumerate(s)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["width", "i", "n", "s"])

    parts = groups.select("width", "x", "weight").mapInArrow(run, "width int, i int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("width", "i").collect():
        n, sums = out.get(r["width"], (0, []))
        out[r["width"]] = (n + r["n"], [*sums, int(r["s"])])
    return out


def products(groups: DataFrame, column: str, centre: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum over the rows of weight times the outer product of ``centre(width, values)``: a matrix product a batch, one
    partial matrix a task, added up by entry. A matrix of each vector length reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for w, part in by_width(b, column):
                z = centre(w, rows_of(part.column(column)))
                sums[w] = sums.get(w, 0.0) + (z * part.column("weight").to_numpy()[:, None]).T @ z
        for w, m in sums.items():
            k = len(m)
            yield pa.record_batch([pa.array(np.full(k, w, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, k * k + 1, k, dtype=np.int32)), pa.array(m.ravel()))], ["width", "i", "row"])

    parts = groups.select("width", column, "weight").mapInArrow(run, "width int, i int, row array<double>")
    cells = parts.select("width", "i", F.posexplode("row").alias("j", "v")).groupBy("width", "i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("width", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["width"], np.zeros((len(r["row"]),) * 2))[r["i"]] = r["row"]
    return out


def fitted(groups: DataFrame, components: int) -> dict[int, Fit]:
    """Eigenvectors of each vector length's covariance (divisor: the weight of all rows), by falling eigenvalue."""
    sums = totals(groups)
    v = products(groups, "x", lambda w, x: centred(x, *sums[w])[0])
    out = {}
    for w, (n, s) in sums.items():
        cov = v[w] / n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1][:components].copy(), vectors[:, ::-1][:, :components].copy()
        values[values <= max(values[0], 0.0) * w * np.finfo(float).eps] = 0.0        # no variance beyond rounding
        out[w] = Fit(n, s, values, vectors, float(np.trace(cov)))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, weights: str = "count") -> DataFrame:
    """Whitened components of every vector, one row each.

    ``vectors`` has ``vec_id`` and ``embedding``; each entry c becomes x = floor(scale * c) + offset. Equal x vectors form
    one group; the fit weighs it by its rows (``weights="count"``) or by one. Rows whose vector is null, empty or holds a
    null or non-finite entry are left out; rows with a null or repeated id each have their own rows; vectors of different
    length are fitted apart; entries whose x passes 2^61 count as 2^61; a component without variance has a null
    ``whitened``; an empty table gives no rows; other columns are not read.

    Returns vec_id, component (from 1), n, deviation (null where a long can't hold it), deviation_exact, whitened,
    explained, identity_error.
    """
    as_long = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_BOUND)), F.lit(-_BOUND))) + F.lit(offset)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(usable() & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.transform("embedding", as_long).alias("x"))
    weight = F.col("copies") if weights == "count" else F.lit(1).cast("bigint")
    groups = staged(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x", F.size("x").alias("width"), "copies", weight.alias("weight")))
    fits = fitted(groups, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, part in by_width(b, "x"):
                fit, x = fits[w], rows_of(part.column("x"))
                z, exact = fit.whiten(x), deviations(differences(x, fit.n, fit.sums))
                flat = pa.array(z.ravel(), from_pandas=True)                           # NaN is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), flat)
                yield pa.record_batch([part.column("x"), part.column("width"), part.column("copies"), part.column("weight"), pa.array([Decimal(e) for e in exact], pa.decimal128(38, 0)), lists],
                                      ["x", "width", "copies", "weight", "deviation_exact", "z"])

    done = staged(groups.mapInArrow(run, "x array<bigint>, width int, copies long, weight long, deviation_exact decimal(38,0), z array<double>"))
    filled = lambda w, z: np.where(np.isnan(z.astype(float)), 0.0, z.astype(float))
    means = {w: np.zeros(min(components, w)) for w in fits}
    mean = done.select("width", "weight", F.posexplode("z").alias("i", "v")).groupBy("width", "i").agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("weight")).alias("s")).collect()
    for r in mean:
        means[r["width"]][r["i"]] = r["s"] / fits[r["width"]].n
    for w, m in products(done, "z", lambda w, z: filled(w, z) - means[w]).items():
        used = fits[w].values > 0
        fits[w].identity_error = float(np.abs(m / fits[w].n - np.eye(len(m)))[np.ix_(used, used)].max(initial=0.0))

    # a group of more than one row in HOT is one of at most HOT groups; the others are small and go by a shuffle
    share = F.lit(None).cast("bigint")
    for w, fit in fits.items():
        share = F.when(F.col("width") == w, F.lit(fit.n)).otherwise(share)
    total = done.groupBy("width").agg(F.sum("copies").alias("all_rows")) if weights != "count" else None
    sized = done.join(F.broadcast(total), "width") if total is not None else done.withColumn("all_rows", share)
    hot = F.col("copies") * HOT >= F.col("all_rows")
    kept = ["x", "width", "deviation_exact", "z"]
    few = sized.where(hot).select(*kept)
    joined = rows.join(F.broadcast(few), "x").unionByName(rows.join(F.broadcast(few.select("x")), "x", "left_anti").join(sized.where(~hot).select(*kept), "x"))
    models = vectors.sparkSession.createDataFrame([(w, f.n, f.explained(), f.identity_error) for w, f in fits.items()], "width int, n long, explained array<double>, identity_error double")
    out = joined.join(F.broadcast(models), "width").select("vec_id", "n", "deviation_exact", "identity_error", "explained", F.posexplode("z").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), "n", F.expr("try_cast(deviation_exact as bigint)").alias("deviation"), "deviation_exact", "whitened",
                      F.get("explained", F.col("i")).alias("explained"), "identity_error")
