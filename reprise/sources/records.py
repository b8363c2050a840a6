"""Quoted text as records: ends of records found across lines and splits by quote parity, cells typed with a ledger of
those that can't be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reprise import fixed_values as fv
from reprise.sources.extracts import BOM, parse_date, parse_moment

_PLACE = ["path", "block"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the text files under ``path``: (path, block, nth, record), a record being a line or, where a quoted
    field holds line feeds, several lines joined by one.

    Files are read in splits. A line lies inside quotes if an odd number of quotes stands before it in its file: each
    split is summed on its own, and the parity of earlier splits arrives as one row a split. Only lines of records that
    span lines are gathered, by record.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    # the end of a record's line may be lost where two quotes meet, so quotes are counted, not fields
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    blocks = lines.groupBy(*_PLACE).agg(F.sum("quotes").alias("sum"))
    past = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*_PLACE, F.coalesce(F.sum("sum").over(past), F.lit(0)).alias("before"))
    own = Window.partitionBy(*_PLACE).orderBy("seq")
    earlier = F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = lines.join(blocks, _PLACE).withColumn("starts", (F.col("before") + earlier) % 2 == 0)
    x = x.withColumn("nth", F.sum(F.col("starts").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = x.where(F.col("starts") & (F.col("quotes") % 2 == 0)).select(*_PLACE, "nth", F.col("value").alias("record"))
    parts = x.where(~(F.col("starts") & (F.col("quotes") % 2 == 0)))
    # lines before a split's first record belong to the last record of an earlier split
    last = x.groupBy(*_PLACE).agg(F.max("nth").alias("n")).withColumn("at", F.when(F.col("n") > 0, F.struct(F.col("block").alias("block"), F.col("n").alias("nth"))))
    last = last.select(*_PLACE, F.last("at", ignorenulls=True).over(past).alias("open"))
    parts = parts.join(last, _PLACE).withColumn("of", F.when(F.col("nth") > 0, F.struct(F.col("block").alias("block"), F.col("nth").alias("nth"))).otherwise(F.col("open")))
    joined = parts.groupBy("path", F.col("of.block").alias("block"), F.col("of.nth").alias("nth")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))), lambda p: p["value"]), "\n").alias("record"))
    return whole.unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns as strings, and ``_place`` (path, block, nth) of each record; the first record of each file is its header,
    and all files have the same one. A record with too few or too many fields is kept, with what could be read, and told
    by ``_malformed``."""
    r = read_records(spark, path)
    first = r.orderBy("path", "block", "nth").first()["record"]
    names = [c.strip().strip('"').replace(BOM, "") for c in first.split(",")]
    schema = ", ".join(f"`{c}` string" for c in names) + ", _line string"
    row = F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_line"})
    body = r.where(F.replace("record", F.lit(BOM), F.lit("")) != first.replace(BOM, ""))
    return body.select(F.struct(*_PLACE, "nth").alias("_place"), row.alias("r")).select("_place", *[F.col("r")[c].alias(c) for c in names], F.col("r._line").isNotNull().alias("_malformed"))


def typed(raw: DataFrame, dates: list[str] = (), moments: list[str] = (), numbers: list[str] = (), trimmed: list[str] = ()) -> DataFrame:
    """The columns typed, and ``_rejected``: (column, raw, reason) of each cell that holds text but no such value."""
    kinds: dict[str, tuple[Column, str]] = {**{c: (parse_date(F.col(c)), "not a date") for c in dates}, **{c: (parse_moment(F.col(c)), "not a moment") for c in moments},
                                            **{c: (F.trim(c).try_cast("double"), "not a number") for c in numbers}}
    bad = [F.when((F.trim(c) != "") & value.isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"), F.lit(reason).alias("reason"))) for c, (value, reason) in kinds.items()]
    rejected = F.filter(F.array(*bad), lambda b: b.isNotNull()) if bad else F.array().cast("array<struct<column:string,raw:string,reason:string>>")
    return raw.withColumn("_rejected", rejected).withColumns({**{c: v for c, (v, _) in kinds.items()}, **{c: F.trim(c) for c in trimmed}})


def reject_ledger(table: DataFrame) -> DataFrame:
    """One row a rejected cell: place of the record, column, raw text and reason."""
    return table.select("_place", F.explode("_rejected").alias("r")).select(F.col("_place.path").alias("path"), F.col("_place.block").alias("block"), F.col("_place.nth").alias("nth"), "r.column", "r.raw", "r.reason")


def agenda_with_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The agenda extract, typed, with its rejected cells."""
    raw = read_quoted_csv(spark, path)
    have = lambda cols: [c for c in cols if c in raw.columns]
    return typed(raw, have([c for c in fv.AGENDA_DATES if c != "ScheduleDateTime"]), have(["ScheduleDateTime"]), have(fv.AGENDA_NUMBERS), have(fv.AGENDA_TRIMMED)).drop(*[c for c in fv.ALL_NULL_COLUMNS if c in raw.columns])
