"""Sequence packing by length patterns: few-document patterns, repeat counts by non-negative least squares, rounding,
best fit for what is left."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from reprise.llm.common import chunks, staged

CAPACITY = 2048
_ENCODERS: dict[tuple[str, str], object] = {}


class Encoder:
    """Ids of the byte-level BPE in ``json_path``.

    The rank file holds the same vocabulary and its library gives the same ids at a third of the time; a text with a
    special token's string goes to the library of the JSON file, which gives that string an id of its own.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.full, self.marks = json_path, None, ("<|endoftext|>",)

    def ids(self, text: str) -> list[int]:
        if any(m in text for m in self.marks):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_path)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(json_path: str, rank_path: str, pattern: str) -> Encoder:
    key = (json_path, rank_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json_path, rank_path, pattern)
    return _ENCODERS[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: only longer texts are cut, and only the first piece may be short."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its number among the pieces of its length that
    the writing task made (``part``, ``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(*tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in chunks(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*enc.ids(text), 0], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[start:start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def full_patterns(active: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of two or three lengths in ``active`` that fill a sequence exactly, longest first; rows of three,
    0 for none. At most capacity^2 / 12 + capacity / 2 rows."""
    has = np.zeros(capacity + 1, bool)
    has[active] = True
    a = np.flatnonzero(has[:capacity])
    two = a[(2 * a >= capacity) & has[capacity - a]]
    x, y = np.meshgrid(a, a, indexing="ij")
    z = capacity - x - y
    ok = (y <= x) & (z >= 1) & (z <= y)
    ok &= has[np.clip(z, 0, capacity)]
    three = np.stack([x[ok], y[ok], z[ok]], 1)
    return np.concatenate([np.stack([two, capacity - two, np.zeros_like(two)], 1), three]) if len(two) or len(three) else np.zeros((0, 3), np.int64)


def least_squares(patterns: np.ndarray, hist: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Non-negative repeat counts x with sum over patterns close to the histogram, by multiplicative updates."""
    n = len(hist)
    there = patterns > 0
    back = lambda v: (v[patterns] * there).sum(1)
    target = back(hist) + 1e-12
    x = np.full(len(patterns), hist.sum() / max(1, 3 * len(patterns)))
    for _ in range(rounds):
        fit = np.bincount(patterns.ravel(), weights=(x[:, None] * there).ravel(), minlength=n)[:n]
        x *= target / (back(fit) + 1e-12)
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, hist: np.ndarray, share: float) -> tuple[list[tuple], np.ndarray]:
    """Whole repeat counts: running sums of ``share * x`` are rounded down, and no count asks for more than is there."""
    order = np.lexsort((-patterns[:, 1], -patterns[:, 0]))
    total = np.floor(np.cumsum(x[order] * share) + 1e-9)
    times = np.diff(total, prepend=0).astype(np.int64)
    left, out = hist.astype(np.int64).copy(), []
    for k in np.flatnonzero(times):
        lengths = [int(v) for v in patterns[order[k]] if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min(int(times[k]), *(int(left[v]) // m for v, m in need.items()))
        if n > 0:
            for v, m in need.items():
                left[v] -= n * m
            out.append((tuple(need.items()), n))
    return out, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple]:
    """Best fit decreasing over a histogram: sequences with the same content are handled together."""
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    done: list[tuple] = []

    def put(free: int, content: tuple, n: int) -> None:
        (room[free].append([content, n]) if free else done.append((content, n)))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n > 0:
            free = next((c for c in range(length, capacity + 1) if room[c]), 0)
            if not free:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, ((length, each),), n // each)
                if n % each:
                    put(capacity - n % each * length, ((length, n % each),), 1)
                break
            content, m = room[free].pop()
            each = free // length
            if n >= each:                       # fill ``each`` more into as many sequences as there are pieces for
                k = min(m, n // each)
                put(free - each * length, (*content, (length, each)), k)
                n -= k * each
                if m > k:
                    room[free].append([content, m - k])
            else:
                put(free - n * length, (*content, (length, n)), 1)
                if m > 1:
                    room[free].append([content, m - 1])
                n = 0
    return [*done, *((c, n) for cell in room for c, n in cell)]


def plan(hist: np.ndarray, capacity: int = CAPACITY, shares: tuple[float, ...] = (1.0, 0.9, 0.7, 0.4)) -> list[tuple]:
    """Contents and how often each is used: ((length, times), ...), n. Of several shares of the fitted counts the one
    with the fewest sequences is taken, fewer left to best fit on a tie."""
    whole = [(((capacity, 1),), int(hist[capacity]))] if hist[capacity] else []
    rest = hist.copy()
    rest[capacity] = 0
    patterns = full_patterns(np.flatnonzero(rest), capacity)
    best = None
    x = least_squares(patterns, rest.astype(float)) if len(patterns) else np.zeros(0)
    for share in shares if len(patterns) else (0.0,):
        made, left = rounded(patterns, x, rest, share) if len(patterns) else ([], rest)
        trial = [*made, *best_fit(left, capacity)]
        if best is None or sum(n for _, n in trial) < sum(n for _, n in best):
            best = trial
    return whole + best


def slots(contents: list[tuple], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For the r-th piece of a length: rows sorted by (length, first r) with first sequence, pieces a sequence, offset."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for content, n in contents:
        offset = 0
        for length, times in content:
            rows.append((length, used[length], sequence, times, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    t = np.array(rows, np.int64).reshape(-1, 5)
    key = (t[:, 0] << np.int64(50)) | t[:, 1]
    order = np.argsort(key, kind="stable")
    return {"key": key[order], "first": t[order, 1], "sequence": t[order, 2], "times": t[order, 3], "offset": t[order, 4]}


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Each text (null: empty) gives its ids and a closing id 0; longer ones are cut into pieces of ``capacity``, of which
    the first may be shorter. Only the histogram of lengths (``capacity`` rows) and the plan over it pass the driver. A
    piece's number within its length is its number in the task that made it plus the counts of the tasks before, so a
    length that holds a third of all pieces is never gathered. Null ids and repeated rows are packed like any other row;
    no rows give no sequences; other columns are not read. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.
    """
    spark = docs.sparkSession
    made = staged(pieces(docs, tokenizer, capacity))
    counts = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():      # one row a length: at most ``capacity``
        hist[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(slots(plan(hist, capacity), capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = made.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = where.value
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(s["key"], (length << np.int64(50)) | r, side="right") - 1
            j = r - s["first"][k]
            sequence, offset = s["sequence"][k] + j // s["times"][k], s["offset"][k] + j % s["times"][k] * length
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
