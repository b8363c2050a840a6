"""Checks on an extract before it is accepted as a dataset."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from reprise.functions.columns import count_if
from reprise.sources.extracts import parse_date


def check_header(columns: list[str], required: list[str], optional: list[str] | None = None) -> list[str]:
    """Problems with a header: empty or repeated names, missing required, unknown names."""
    problems = []
    if not columns or any(not c.strip() for c in columns):
        problems.append("empty column name")
    repeated = sorted({c for c in columns if columns.count(c) > 1})
    if repeated:
        problems.append("repeated: " + ", ".join(repeated))
    missing = [c for c in required if c not in columns]
    if missing:
        problems.append("missing: " + ", ".join(missing))
    if optional is not None:
        unknown = sorted(set(columns) - set(required) - set(optional))
        if unknown:
            problems.append("unknown: " + ", ".join(unknown))
    return problems


def profile_extract(raw: DataFrame, id_columns: list[str], date_columns: list[str],
                    event_column: str | None = None) -> DataFrame:
    """One row: row count, empty ids and unreadable dates per column, date range, last event.

    A single aggregate over the whole extract; ``raw`` may hold strings or dates.
    """
    text = dict(raw.dtypes)

    def as_date(c):
        return parse_date(F.col(c)) if text[c] == "string" else F.to_date(c)

    def empty(c):
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [count_if(empty(c)).alias(f"empty_{c}") for c in id_columns]
    for c in date_columns:
        aggs += [count_if(~empty(c) & as_date(c).isNull()).alias(f"invalid_{c}"),
                 F.min(as_date(c)).alias(f"min_{c}"), F.max(as_date(c)).alias(f"max_{c}")]
    if event_column:
        aggs.append(F.max(as_date(event_column)).alias("last_event"))
    return raw.agg(*aggs)


def accept(profile_row: dict, id_columns: list[str], train_end: dt.date, valid_end: dt.date,
           cutoff: dt.date) -> list[str]:
    """Acceptance rules on the one-row profile; an empty list means accepted."""
    problems = []
    if profile_row["n_rows"] == 0:
        problems.append("no rows")
    problems += [f"column {c} is empty in every row" for c in id_columns
                 if profile_row[f"empty_{c}"] == profile_row["n_rows"]]
    last = profile_row.get("last_event")
    if not train_end < valid_end < cutoff:
        problems.append("need train_end < valid_end < cutoff")
    if last is None or cutoff > last:
        problems.append("cutoff is after the last observed event")
    return problems
