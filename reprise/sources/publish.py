"""Publishing results: staged tables, a manifest written last, dataset isolation.

Layout under one root folder::

    <root>/<table>/dataset_id=<id>/run_id=<run>/part-*.parquet
    <root>/_manifest/dataset_id=<id>/run_id=<run>/part-*.parquet     one row, written last

A run without a manifest row is not visible, so a failed publish never shows partial results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "rows bigint, hash string, published_at timestamp_ntz, tables array<string>, info string, dataset_id string, run_id string"


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash of a table: row count and sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"))


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV export; with ``decimals`` every double is written in fixed notation."""
    if decimals is not None:
        df = df.withColumns({c: F.format_string(f"%.{decimals}f", F.col(c)) for c, k in df.dtypes if k in ("double", "float")})
    df.write.mode("overwrite").option("header", True).csv(path)


def publish_run(tables: dict[str, DataFrame], source: DataFrame, root: str, dataset_id: str, run_id: str,
                info: Column | None = None) -> None:
    """Write every table of a run, then its manifest row with the fingerprint of the source scores."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{root}/{name}/dataset_id={dataset_id}/run_id={run_id}")
    row = fingerprint(source).withColumns({
        "published_at": F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"),
        "tables": F.array(*[F.lit(t) for t in sorted(tables)]),
        "info": F.to_json(info) if info is not None else F.lit(None).cast("string"),
    })
    row.write.mode("error").parquet(f"{root}/{MANIFEST}/dataset_id={dataset_id}/run_id={run_id}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published runs of all datasets; ids are text, so that leading zeros stay."""
    return spark.read.schema(_MANIFEST_SCHEMA).option("basePath", f"{root}/{MANIFEST}").parquet(f"{root}/{MANIFEST}")


def latest_run(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    m = manifest(spark, root).where(F.col("dataset_id") == dataset_id)
    return m.orderBy(F.col("published_at").desc(), F.col("run_id").desc()).limit(1)


def read_latest(spark: SparkSession, root: str, dataset_id: str, table: str) -> DataFrame:
    """Rows of the latest published run of one dataset; unpublished runs are not seen."""
    run = latest_run(spark, root, dataset_id).first()
    if run is None:
        raise LookupError(f"no published run for dataset {dataset_id}")
    return spark.read.parquet(f"{root}/{table}/dataset_id={dataset_id}/run_id={run['run_id']}")


def is_stale(spark: SparkSession, root: str, dataset_id: str, source: DataFrame) -> bool:
    """True when the source no longer equals what the latest run was made from."""
    run = latest_run(spark, root, dataset_id).first()
    now = fingerprint(source).first()
    return run is None or run["rows"] != now["rows"] or run["hash"] != now["hash"]


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per dataset: published runs and the latest of them."""
    return manifest(spark, root).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("runs"), F.max_by("run_id", "published_at").alias("latest_run"), F.max("published_at").alias("latest_at"))
