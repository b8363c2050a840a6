"""Difference of two tables by a keyed hash tree: digests of key ranges compared from the root, only differing ranges
descended, and the differing cells of their rows given out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reprise.runtime import stored

#: Bits of a key's hash that one level of the tree adds, and levels below the root.
BITS, LEVELS = 6, 3


def _digested(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return stored(df.select(F.col(key).cast("string").alias("key"), *columns).withColumns({"_at": F.xxhash64(F.col("key"), F.lit("place")), "_row": F.xxhash64(F.col("key"), *columns)}))


def _node(level: int) -> Column:
    """Range of the key's hash at a level; the root is one range."""
    return F.shiftrightunsigned("_at", 64 - BITS * level) if level else F.lit(0).cast("bigint")


def _digest(rows: DataFrame, level: int) -> DataFrame:
    """Order-free digest of every range: rows, and two sums of row digests that do not move together."""
    big = lambda c: c.cast("decimal(38,0)")
    return rows.groupBy(_node(level).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(big(F.col("_row"))).alias("s"), F.sum(big(F.xxhash64("_row", F.lit(1)))).alias("t"))


def differing_cells(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells that differ between two tables of unique keys: key, column, first, second, kind (``changed``, or the side
    that alone has the key). Values are compared and shown as text; nulls are equal.

    Both sides are stored with their row digests. A level compares one row a range that is still open; rows are read by
    the ranges that differ, so equal tables cost one aggregate of each.
    """
    x, y = _digested(a, key, columns), _digested(b, key, columns)
    for level in range(LEVELS + 1):
        p, q = _digest(x, level).withColumnsRenamed({"n": "n1", "s": "s1", "t": "t1"}), _digest(y, level).withColumnsRenamed({"n": "n2", "s": "s2", "t": "t2"})
        same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("s1").eqNullSafe(F.col("s2")) & F.col("t1").eqNullSafe(F.col("t2"))
        open_ = stored(p.join(q, "node", "full_outer").where(~same).select("node"))
        x, y = (d.join(open_, _node(level) == F.col("node"), "left_semi") for d in (x, y))
    cells = lambda d, v: d.select("key", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(v)) for c in columns])).alias("c"), F.lit(True).alias(f"in_{v}")).select("key", "c.*", f"in_{v}")
    j = cells(x, "first").join(cells(y, "second"), ["key", "column"], "full_outer")
    kind = F.when(F.col("in_second").isNull(), "only_first").when(F.col("in_first").isNull(), "only_second").otherwise("changed")
    return j.where(~F.col("first").eqNullSafe(F.col("second")) | F.col("in_first").isNull() | F.col("in_second").isNull()).select("key", "column", "first", "second", kind.alias("kind"))


def difference_counts(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: its totals on both sides and the number of differing cells."""
    d = differing_cells(a, b, key, columns).groupBy("column").agg(F.count(F.lit(1)).alias("differing"))
    total = lambda df, name: df.agg(*[F.sum(c).alias(c) for c in columns]).unpivot([], columns, "column", name)
    return total(a, "total_first").join(total(b, "total_second"), "column").join(d, "column", "left").withColumn("differing", F.coalesce("differing", F.lit(0)))
