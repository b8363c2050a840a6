"""Small Column helpers shared by the operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F


def flag(cond: Column) -> Column:
    """Two-valued flag: a null condition counts as false."""
    return F.coalesce(cond, F.lit(False))


def as_int(cond: Column) -> Column:
    return flag(cond).cast("int")


def share(cond: Column) -> Column:
    """Mean of a boolean where null counts as false."""
    return F.avg(flag(cond).cast("double"))


def count_if(cond: Column) -> Column:
    return F.sum(flag(cond).cast("long"))


def clip(x: Column, lower=None, upper=None) -> Column:
    """Null-preserving clip (``least``/``greatest`` alone would skip the null)."""
    y = x
    if lower is not None:
        y = F.greatest(y, F.lit(lower))
    if upper is not None:
        y = F.least(y, F.lit(upper))
    return F.when(x.isNotNull(), y)


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def literal_map(mapping: dict, key: Column) -> Column:
    """Dictionary lookup; missing keys give null."""
    if not mapping:
        return F.lit(None)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.when(key.isNotNull(), F.try_element_at(m, key))


INF = float("inf")


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins ``(lo, hi]``; open ends are infinite edges, values outside every bin give null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        inside = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def whole_months(end: Column, start: Column) -> Column:
    """Completed calendar months from ``start`` to ``end``."""
    months = (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    return months - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def month_of(d: Column) -> Column:
    return F.trunc(d, "month")


def parse_bool(text: Column) -> Column:
    """'true'/'false'/'1'/'0'/'1.0'/'0.0' in any case; anything else is unknown."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "1.0"), F.lit(True)).when(t.isin("false", "0", "0.0"), F.lit(False))


def parse_number(x: Column) -> Column:
    """Double, or null when unreadable or infinite."""
    v = x.cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def mask_identifier(x: Column) -> Column:
    """Keep the first four and last two characters."""
    return F.concat(F.substring(x, 1, 4), F.lit("…"), F.substring(x, -2, 2))


def leading_integer(x: Column) -> Column:
    return F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int")


def r6(x: Column) -> Column:
    """Published precision: six decimals, negative zero removed."""
    return F.round(x.cast("double"), 6) + F.lit(0.0)
