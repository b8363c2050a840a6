"""Reading the two raw CSV extracts and their typed Parquet form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reprise import fixed_values as fv

BOM = "﻿"


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as string; a UTF-8 byte-order mark on the first header is tolerated."""
    df = (spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False)
          .option("quote", '"').option("escape", '"').option("multiLine", False).csv(path))
    return df.toDF(*[c.replace(BOM, "").strip() for c in df.columns])


def parse_moment(text: Column) -> Column:
    """Mixed date formats to a zone-free UTC timestamp; unreadable text gives null."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in fv.DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    return F.to_date(parse_moment(text))


def drop_all_null(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in fv.ALL_NULL_COLUMNS if c in df.columns])


def type_sales(raw: DataFrame) -> DataFrame:
    typed = {c: parse_date(F.col(c)) for c in fv.SALES_DATES if c in raw.columns}
    typed["ModelYear"] = F.col("ModelYear").try_cast("double").try_cast("int")
    typed["ModelName"] = F.trim("ModelName")
    return drop_all_null(raw).withColumns(typed)


def type_agenda(raw: DataFrame) -> DataFrame:
    typed = {c: parse_date(F.col(c)) for c in fv.AGENDA_DATES if c in raw.columns and c != "ScheduleDateTime"}
    if "ScheduleDateTime" in raw.columns:
        typed["ScheduleDateTime"] = parse_moment(F.col("ScheduleDateTime"))
    typed |= {c: F.col(c).try_cast("double") for c in fv.AGENDA_NUMBERS if c in raw.columns}
    typed |= {c: F.trim(c) for c in fv.AGENDA_TRIMMED if c in raw.columns}
    return drop_all_null(raw).withColumns(typed)


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    return type_sales(read_raw_csv(spark, path))


def load_agenda(spark: SparkSession, path: str) -> DataFrame:
    return type_agenda(read_raw_csv(spark, path))


def build_interim(spark: SparkSession, csv_path: str, parquet_path: str, kind: str, force: bool = False) -> DataFrame:
    """CSV to typed Parquet once; a finished copy is kept unless ``force``, a half-written one is replaced."""
    loader = {"sales": load_sales, "agenda": load_agenda}[kind]
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{parquet_path}/_SUCCESS")
    finished = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if force or not finished:
        loader(spark, csv_path).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines that don't have the header's number of fields (a quoted line feed, a field too many), as ``line``.

    Such rows are typed with what could be read of them; a job that must not accept them looks here first.
    """
    header = spark.read.text(path).first()["value"]
    schema = ", ".join(f"`{c}` string" for c in read_raw_csv(spark, path).columns) + ", _line string"
    row = F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_line"})
    return spark.read.text(path).where(F.col("value") != header).select(row["_line"].alias("line")).where(F.col("line").isNotNull())
