"""As-of joins on date columns.

The matched right row depends only on (key, date), so both sides are first reduced to one row per
key and day with map-side combination. A key then contributes at most one row per calendar day and
side to the ordered window, no matter how many input rows it owns; the rows of a hot key come back
through an equi-join on (key, day), which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = "_day"


def _per_day(right: DataFrame, by: list[str], right_on: str, cols: list[str], tie: list[str] | None,
             last: bool) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in cols])
    order = F.struct(*[F.col(c) for c in tie]) if tie else payload
    known = F.col(right_on).isNotNull()
    for k in by:
        known &= F.col(k).isNotNull()
    pick = F.max_by if last else F.min_by
    return (right.where(known).groupBy(*by, F.col(right_on).alias(DAY)).agg(pick(payload, order).alias("_hit")))


def asof_join(left: DataFrame, right: DataFrame, by: str | list[str], left_on: str, right_on: str,
              cols: list[str], direction: str = "backward", allow_exact: bool = False,
              tie: list[str] | None = None, left_unique: bool = False) -> DataFrame:
    """Every left row plus ``cols`` of its latest earlier (or earliest later) right row.

    direction: ``backward`` or ``forward``. ``allow_exact`` admits a right row on the same day.
    tie: right columns that order rows of one key and day; backward takes the last, forward the first.
    left_unique: promise that (by, left_on) is unique and never null in ``left``; saves the join back.
    """
    by = [by] if isinstance(by, str) else list(by)
    backward = direction == "backward"
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    r = _per_day(right, by, right_on, cols, tie, last=backward)
    hit_type = r.schema["_hit"].dataType

    known = F.col(left_on).isNotNull()
    for k in by:
        known &= F.col(k).isNotNull()
    keys = [F.col(k) for k in by]
    carry = F.struct(*[F.col(c) for c in left.columns]) if left_unique else F.lit(None).cast("int")
    l = left.where(known).select(*keys, F.col(left_on).alias(DAY), carry.alias("_row"))
    if not left_unique:
        l = l.distinct()
    row_type = l.schema["_row"].dataType
    log = (l.withColumns({"_hit": F.lit(None).cast(hit_type), "_left": F.lit(True)})
           .unionByName(r.withColumns({"_row": F.lit(None).cast(row_type), "_left": F.lit(False)})))

    # strict: on equal days the left row comes first and so does not see the right row
    side = F.col("_left") if allow_exact else ~F.col("_left")
    order = [F.col(DAY).asc() if backward else F.col(DAY).desc(), side.asc()]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = log.withColumn("_m", F.last("_hit", ignorenulls=True).over(before)).where("_left")

    if left_unique:
        return found.select("_row.*", *[F.col(f"_m.{c}").alias(c) for c in cols])
    hits = found.select(*keys, F.col(DAY).alias(left_on), *[F.col(f"_m.{c}").alias(c) for c in cols])
    return left.join(hits, [*by, left_on], "left")


def asof_nearest(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
                 cols: list[str], tie: list[str] | None = None) -> DataFrame:
    """Closest right row by absolute day gap; an equal gap prefers the earlier row."""
    back = {c: f"_b_{c}" for c in cols}
    fwd = {c: f"_f_{c}" for c in cols}
    rb = right.select(by, F.col(right_on).alias("_b_at"), *[F.col(c).alias(back[c]) for c in cols],
                      *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie or [])])
    rf = right.select(by, F.col(right_on).alias("_f_at"), *[F.col(c).alias(fwd[c]) for c in cols],
                      *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie or [])])
    ties = [f"_t{i}" for i in range(len(tie or []))] or None
    out = asof_join(left, rb, by, left_on, "_b_at", ["_b_at", *back.values()], "backward", True, ties)
    out = asof_join(out, rf, by, left_on, "_f_at", ["_f_at", *fwd.values()], "forward", False, ties)
    gap_b, gap_f = F.datediff(left_on, "_b_at"), F.datediff("_f_at", left_on)
    use_back = gap_f.isNull() | (gap_b <= gap_f)
    picked = {c: F.when(use_back, F.col(back[c])).otherwise(F.col(fwd[c])) for c in cols}
    return (out.withColumns({**picked, "gap_days": F.when(use_back, gap_b).otherwise(gap_f)})
            .drop("_b_at", "_f_at", *back.values(), *fwd.values()))


def asof_tolerance(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, cols: list[str],
                   tolerance_days: int, direction: str = "forward", allow_exact: bool = True,
                   tie: list[str] | None = None) -> DataFrame:
    """As-of join whose match is discarded when it is more than ``tolerance_days`` away."""
    need = cols if right_on in cols else [*cols, right_on]
    out = asof_join(left, right, by, left_on, right_on, need, direction, allow_exact, tie)
    near = F.abs(F.datediff(right_on, left_on)) <= tolerance_days
    out = out.withColumns({c: F.when(near, F.col(c)) for c in need if c != right_on}
                          | {right_on: F.when(near, F.col(right_on))})
    return out if right_on in cols else out.drop(right_on)


def band_exists(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
                lo: int, hi: int, id_col: str, alias: str = "in_band") -> DataFrame:
    """Flag left rows with *another* right row of the same key in ``[left+lo, left+hi]`` days.

    Answered from day counts: rows of the key in the band, minus the row itself when its own id
    lies in the band. No pair of rows is ever formed.
    """
    per_day = (right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull())
               .groupBy(by, F.col(right_on).alias(DAY)).agg(F.count(F.lit(1)).alias("_n")))
    probes = left.where(F.col(by).isNotNull() & F.col(left_on).isNotNull()).select(by, F.col(left_on).alias(DAY)).distinct()
    log = (per_day.withColumn("_probe", F.lit(False))
           .unionByName(probes.withColumns({"_n": F.lit(0).cast("long"), "_probe": F.lit(True)})))
    w = Window.partitionBy(by).orderBy(F.unix_date(DAY)).rangeBetween(lo, hi)
    counts = (log.withColumn("_in", F.sum("_n").over(w)).where("_probe")
              .select(by, F.col(DAY).alias(left_on), "_in"))
    own = right.select(F.col(id_col).alias("_rid"), F.col(right_on).alias("_rat")).distinct()
    j = left.join(counts, [by, left_on], "left").join(own, F.col(id_col) == F.col("_rid"), "left")
    self_hit = F.coalesce(F.datediff("_rat", left_on).between(lo, hi).cast("long"), F.lit(0))
    return j.withColumn(alias, F.coalesce(F.col("_in"), F.lit(0)) - self_hit > 0).drop("_in", "_rid", "_rat")


def interval_contains(intervals: DataFrame, events: DataFrame, by: str, start: str, end: str, at: str,
                      alias: str = "hit") -> DataFrame:
    """Flag intervals ``[start, end)`` of a key that hold at least one of its events.

    The first event on or after ``start`` decides, so no interval-event pairs are produced.
    """
    first = asof_join(intervals, events.select(by, F.col(at).alias("_ev")), by, start, "_ev", ["_ev"],
                      "forward", allow_exact=True)
    return first.withColumn(alias, F.coalesce(F.col("_ev") < F.col(end), F.lit(False))).drop("_ev")
