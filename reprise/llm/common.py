"""Helpers shared by the corpus operators: table access, stage cuts and Arrow text chunks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from reprise.runtime import ensure_checkpoint_dir

#: Bytes of text that one numpy pass holds; longer texts make a chunk of their own.
CHUNK_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="reprise-code-")), "reprise_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "reprise")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors and recompute nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each part hold about ``limit`` bytes (a longer text stands alone).

    Null texts are given out as empty ones.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = batch.column(at).fill_null("")
        if not pa.types.is_string(text.type):
            text = text.cast(pa.string())
        batch = batch.set_column(at, column, text)
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the number of the text that each is from."""
    lists = pc.ascii_split_whitespace(text)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = lists.flatten(), np.repeat(np.arange(len(text)), counts)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each value, and the distinct values."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string; the same on every machine."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(values.to_pylist(), dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter-based generator: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows_of(code: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` values that lies in one row, and the place where it starts."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15 | 1) + value[k:k + n]
    start = np.flatnonzero(row[:n] == row[width - 1:])
    return mix(h[start]), start


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=n)
