"""Exact top-k inner products: tiled matrix products, partial selection per tile, tree merging of per-query lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reprise.llm.common import staged

#: Elements of one tile's matrix, so that a tile of any width holds about 8 MB.
TILE_ELEMENTS = 1 << 20
#: Tiles whose lists one step of the merging tree joins.
FAN_IN = 16
_RESULT = "query_row bigint, query_id bigint, tile int, vec_id bigint, row bigint, score bigint"


def usable(embedding: str = "embedding") -> Column:
    """True for vectors without a null or non-finite component."""
    e = F.col(embedding)
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), as doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(len(column), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles hold them where no partial sum can pass 2^53; larger ones are summed as
    Python integers and cut to the range of a long."""
    width = q.shape[1]
    if width and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width >= 2.0 ** 53:
        big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
        return np.clip(big, -2 ** 63, 2 ** 63 - 1).astype(np.int64)
    return (q @ c.T).astype(np.int64)


def best_of_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of each query's k best; candidates are sorted by id, so an earlier one wins a tie."""
    n = scores.shape[1]
    take = min(n, k + 1)                                      # one more: the query itself may be among them
    top = int(np.abs(scores).max(initial=0))
    if top < 2 ** 62 // max(1, n):
        key = scores * n + np.arange(n - 1, -1, -1)           # distinct, so partial selection is exact
        part = np.argpartition(key, n - take, axis=1)[:, n - take:]
        cols = np.take_along_axis(part, np.argsort(-np.take_along_axis(key, part, 1), axis=1, kind="stable"), 1)
    else:
        cols = np.array([np.lexsort((np.arange(n), -r.astype(object)))[:take] for r in scores])
    rows = np.repeat(np.arange(len(scores)), take)
    cols = cols.ravel()
    keep = ~own[rows, cols]
    rows, cols = rows[keep], cols[keep]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], cols[nth < k]


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, tile_elements: int = TILE_ELEMENTS) -> DataFrame:
    """The k highest integer inner products of each query row against all other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` marks the query rows. Rows with a null id, a null vector or
    a null or non-finite component take no part; rows of one id are rows like others: each is a candidate of all but
    itself and, where asked, a query with a list of its own; vectors of different length are not compared; an empty table gives no rows; other columns are not read. Query blocks meet candidate
    tiles, both of bounded size, on a grid; each cell multiplies two matrices and keeps k rows a query, and the lists
    are merged ``FAN_IN`` tiles at a time. Returns query_id, rank, vec_id, score.
    """
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding"), queries.alias("asked")).where(F.col("vec_id").isNotNull() & usable())
    base = staged(base.withColumns({"row": F.monotonically_increasing_id(), "width": F.size("embedding")}))
    sizes = [(r["width"], r["n"], r["q"]) for r in base.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).collect()]   # one row a vector length

    def tiles(n: int, width: int) -> int:
        return max(1, -(-n * max(1, width) // tile_elements))

    def numbered(which: int) -> Column:
        """Number of tiles for the row's width; ``which``: 1 for candidates, 2 for queries."""
        out = F.lit(1)
        for w, *counts in sizes:
            out = F.when(F.col("width") == w, F.lit(tiles(counts[which - 1] or 0, w))).otherwise(out)
        return out

    deal = lambda c, n: F.pmod(F.xxhash64(F.col("row"), F.lit(c)), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    cand = base.select("width", "vec_id", "row", "embedding", deal(1, numbered(1)).alias("tile"), spread(numbered(2)).alias("block"))
    asked = base.where("asked").select(F.col("width").alias("q_width"), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), deal(2, numbered(2)).alias("q_block"), spread(numbered(1)).alias("q_tile"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "tile", "vec_id", "row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int32() if n == "tile" else pa.int64()) for n in names})
        right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        q_row, q_id, c_id, c_row = left.column("query_row").to_numpy(), left.column("query_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("row").to_numpy()
        q, c = matrix(left.column("query"), scale), matrix(right.column("embedding"), scale)
        step, parts = max(1, tile_elements // max(1, len(c_id))), []
        for s in range(0, len(q_id), step):
            scores = products(q[s:s + step], c)
            rows, cols = best_of_tile(scores, q_row[s:s + step, None] == c_row[None, :], k)
            parts.append((q_row[s:s + step][rows], q_id[s:s + step][rows], c_id[cols], c_row[cols], scores[rows, cols]))
        q_rows, ids, vecs, vec_rows, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table(dict(zip(names, [q_rows, ids, pa.array(np.full(len(ids), right.column("tile")[0].as_py(), np.int32)), vecs, vec_rows, scores], strict=True)))

    lists = asked.groupBy("q_width", "q_block", "q_tile").cogroup(cand.groupBy("width", "block", "tile")).applyInArrow(cell, _RESULT)
    most = max((tiles(n, w) for w, n, _ in sizes), default=1)
    order = (F.desc("score"), F.asc("vec_id"), F.asc("row"))
    while most > FAN_IN:
        lists = lists.withColumn("tile", (F.col("tile") / FAN_IN).cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("query_row", "tile").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        most = -(-most // FAN_IN)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
