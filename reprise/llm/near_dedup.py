"""Near duplicates by DartMinHash: hashed darts are thrown into the weighted regions of a text's shingles, the earliest
dart of each coordinate makes a sparse weighted signature, and bands of it are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reprise.llm.common import chunks, coded, hashed, mix, per_row, staged, words_of
from reprise.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates in a band: a pair at the limit shares a band with probability 1 - (1 - 0.8^6)^24 = 0.9993.
BANDS, ROWS = 24, 6
#: Bytes of text that one pass of sketching or comparing holds: darts take a hundred times as much for short texts.
SKETCH_BYTES, COMPARE_BYTES = 2 << 20, 1 << 20
#: Texts in a tile of the comparison grid of a family.
TILE = 256
#: Ids that may be broadcast to pick texts; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rank levels of the darts: unit slabs below 2^-FINE are thrown at once, then each level doubles the range.
FINE = 6


def word_values(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word."""
    words, row = words_of(text)
    if not len(words):
        return row, np.zeros(0, np.uint64)
    code, distinct = coded(words)
    return row, mix(hashed(distinct) + np.uint64(0x632BE59BD9B4E019))[code]


def shingles(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the unit slabs of each text, in order of rows: one slab for the n-th occurrence of each shingle, so
    that a shingle of weight w owns slabs 1..w. A text of fewer words than a shingle has one shingle of all its words."""
    if not len(value):
        return row, value
    n = per_row(row, rows)
    first = np.cumsum(n) - n
    width = np.minimum(n, SHINGLE)[row]                      # words in the shingles of this text
    start = np.flatnonzero(np.arange(len(row)) + width <= (first + n)[row])
    width = width[start]
    h = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        x = mix(h * np.uint64(0x9E3779B97F4A7C15) + value[np.minimum(start + k, len(value) - 1)])
        h = x if width.min() > k else np.where(k < width, x, h)
    r = row[start]
    key = mix(h + r.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    nth = np.empty(len(h), np.uint64)
    nth[order] = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return r, mix(h + nth * np.uint64(0xD1B54A32D192ED03))


def poisson_limits(mean: float) -> np.ndarray:
    """Upper ends, on the 64-bit scale, of the hash ranges that mean 0, 1, 2, ... darts."""
    p, total, out = np.exp(-mean), 0.0, []
    for k in range(1, 64):
        total += p
        out.append(int(min(total, 1 - 2 ** -53) * 2 ** 64))
        p *= mean / k
    return np.array(out, np.uint64)


def signatures(row: np.ndarray, slab: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k DartMinHash signature of unit slabs; rows without slabs get zeros.

    Darts are a Poisson process of unit density over (slab, rank), seeded by slab and rank level alone, so equal slabs
    of two texts hold equal darts. A dart's hash names its coordinate and each coordinate keeps its earliest dart; levels
    of higher rank are thrown only for texts that still have an empty coordinate, so about k ln k darts are thrown per
    text whatever its weight. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
    """
    best = np.zeros((n, k), np.uint64)
    none = np.uint64(2 ** 64 - 1)
    rows, r, s = np.unique(row), np.searchsorted(np.unique(row), row), slab      # texts with an empty coordinate, their slabs
    level, low, width = 0, 0.0, 2.0 ** -FINE
    while len(rows):
        seed = mix(s + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))
        limits = poisson_limits(width)
        some = np.flatnonzero(seed >= limits[0])
        count = np.searchsorted(limits, seed[some], side="right")
        at = np.repeat(some, count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(seed[at] + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        cell = r[at] * k + (dart % np.uint64(k)).astype(np.int64)
        earliest = np.full(len(rows) * k, none)
        np.minimum.at(earliest, cell, mix(dart + np.uint64(0xE7037ED1A0B428DB)))         # a dart's place in its level
        earliest = earliest.reshape(-1, k)
        own = best[rows]
        new = (own == 0) & (earliest != none)
        own[new] = mix(earliest[new] + np.uint64(level)) | np.uint64(1)
        best[rows] = own
        still = (own == 0).any(1)
        if not still.all():
            use = still[r]
            r, s, rows = (np.cumsum(still) - 1)[r[use]], s[use], rows[still]
        low += width
        width = min(8.0, low)           # 2^-6, 2^-6, 2^-5, ... and steps of 8 from there on
        level += 1
    return best


def sketch(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, same, bands): key of the text's word sequence, and band hashes (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", SKETCH_BYTES):
            n = b.num_rows
            at, value = word_values(b.column("text"))
            row, slab = shingles(at, value, n)
            sig = signatures(row, slab, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
            some = per_row(row, n) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(key[some].ravel().view(np.int64)))
            place = per_row(at, n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(place) - place, place)
            keys = []
            for salt in (1, 2):                 # 128 bits of the word sequence
                total = np.zeros(n, np.uint64)
                np.add.at(total, at, mix(value ^ mix(nth.astype(np.uint64) * np.uint64(4) + np.uint64(salt))))
                keys.append(mix(total).view(np.int64))
            yield pa.record_batch([b.column("id"), pa.array(keys[0], mask=~some), pa.array(keys[1], mask=~some), bands], ["id", "same1", "same2", "bands"])

    return docs.select(F.col(id_column).alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, same1 long, same2 long, bands array<long>")


def similar(pairs: DataFrame, texts: DataFrame, limit: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is ``limit`` or more, by the whole ``texts`` (id, text)."""
    rows = pairs.join(texts.toDF("b", "right"), "b").join(texts.toDF("a", "left"), "a").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(iter([batch]), "left", COMPARE_BYTES):
                for c in chunks(iter([b]), "right", COMPARE_BYTES):
                    n = c.num_rows
                    left, distinct = coded(c.column("left"))         # a pivot's text is cut into shingles once
                    row1, slab1 = shingles(*word_values(distinct), len(distinct))
                    row2, slab2 = shingles(*word_values(c.column("right")), n)
                    size1, size2 = per_row(row1, len(distinct))[left], per_row(row2, n)
                    shared = np.zeros(n, np.int64)
                    by = np.argsort(left[row2], kind="stable")       # members side by side with their pivot
                    ends = np.searchsorted(left[row2][by], np.arange(len(distinct) + 1))
                    start = np.searchsorted(row1, np.arange(len(distinct) + 1))
                    for p in range(len(distinct)):
                        mine = by[ends[p]:ends[p + 1]]
                        if len(mine):
                            hit = np.isin(slab2[mine], slab1[start[p]:start[p + 1]])
                            shared += per_row(row2[mine][hit], n)
                    ok = shared >= limit * (size1 + size2 - shared) - 1e-9
                    yield pa.record_batch([c.column("a").filter(pa.array(ok)), c.column("b").filter(pa.array(ok))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def spanning(size: np.ndarray, row: np.ndarray, slab: np.ndarray, side: np.ndarray, root: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Similar pairs of the texts of two tiles (side 0 and 1; one tile: all 0) that join different classes, as few as
    join them: exact overlaps by products of the tiles' incidence matrices, taken a block of shared slabs at a time."""
    n = len(size)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    names, code, count = np.unique(slab, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    row, column = row[column[code] >= 0], column[code][column[code] >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(left), len(right)))
    width = 4096
    for first in range(0, len(common), width):
        x, y = np.searchsorted(column, [first, first + width])
        block = np.zeros((n, width), np.float32)
        block[row[x:y], column[x:y] - first] = 1
        overlap += block[left] @ block[right].T
    close = overlap >= limit * (size[left][:, None] + size[right][None, :] - overlap) - 1e-9
    close &= (root[left][:, None] != root[right][None, :]) & (size[left][:, None] > 0)
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(close), strict=True):
        x, y = find(root[left[i]]), find(root[right[j]])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((left[i], right[j]))
    return out


def grid(members: DataFrame, texts: DataFrame, limit: float) -> DataFrame:
    """Links (a, b) between classes of a family. ``members``: family, rep, root. Each family is dealt into tiles of about
    ``TILE`` texts, and two tiles that may hold two classes meet in one task."""
    roots = members.groupBy("family", "root").agg(F.count("*").alias("n"))
    main = roots.groupBy("family").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    sizes = main.select("family", F.col("m.root").alias("main"), tiles(F.col("m.n")).alias("own"), tiles(F.col("n") - F.col("m.n")).alias("others"))
    dealt = members.join(sizes, "family").withColumn("inner", F.col("root") == F.col("main"))
    at = F.xxhash64("rep")
    dealt = dealt.withColumn("tile", F.when(F.col("inner"), F.pmod(at, F.col("own"))).otherwise(F.col("own") + F.pmod(at, F.greatest("others", F.lit(1)))).cast("int"))
    # the largest class has tiles of its own, which need not meet each other
    others = F.sequence(F.when(F.col("inner"), F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("others") - 1)
    met = dealt.where("others > 0").select("family", "rep", "root", "tile", F.explode(others).alias("other"))
    met = met.select("family", "rep", "root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).alias("second"))
    rows = met.join(texts.withColumnRenamed("id", "rep"), "rep")

    def run(t: pa.Table) -> pa.Table:
        root, rep = t.column("root").to_numpy(), t.column("rep").to_numpy()
        out: list[tuple[int, int]] = []
        if (root != root[0]).any():
            text = t.column("text").combine_chunks()
            row, slab = shingles(*word_values(text), len(text))
            out = spanning(per_row(row, len(text)), row, slab, t.column("second").to_numpy(zero_copy_only=False).astype(int), root, limit)
        return pa.table({"a": pa.array([rep[i] for i, _ in out], pa.int64()), "b": pa.array([rep[j] for _, j in out], pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_column: str = "doc_id", limit: float = SIMILARITY) -> DataFrame:
    """Class of every document: (id, class_id), ``class_id`` the smallest id of its class.

    Documents are in one class if a chain of pairs with a weighted Jaccard similarity of ``limit`` or more joins them;
    the elements are five-word shingles, the weights their counts. Equal word sequences are folded first. In each band
    bucket the most central member (the one whose buckets are fullest) is compared with the others, exactly and by whole
    texts, which joins a group of copies around its original at one comparison a member. Buckets that still hold several
    classes are joined to families, and a family's texts are compared across classes by matrix products of bounded
    tiles, of which only spanning links come out. So no pairs within a group are spelled out, and no candidate is
    dropped. Texts without words (null or empty) and rows with a null id are classes of their own; ``class_id`` is null
    for a null id. Repeated rows share a class; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("_id"), "text")
    whole = docs.where(F.col("_id").isNotNull())
    sketches = staged(sketch(whole, "_id"))
    worded = sketches.where("same1 is not null")
    folded = staged(worded.groupBy("same1", "same2").agg(F.min("id").alias("rep")))
    member = worded.select("id", "same1", "same2").distinct().join(folded, ["same1", "same2"]).select("id", "rep")
    bands = sketches.join(folded.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.first("bands").alias("bands"))
    entries = bands.select(F.col("id").alias("rep"), F.explode("bands").alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    open_ = staged(entries.join(crowded, "bucket"))
    central = open_.groupBy("rep").agg(F.sum("n").alias("weight"))
    reps = staged(central)
    few = reps.count() <= BROADCAST_IDS
    ids = reps.select(F.col("rep").alias("_id"))
    texts = staged(whole.join(F.broadcast(ids) if few else ids, "_id", "left_semi").select(F.col("_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).dropDuplicates(["id"]))
    best = open_.join(reps, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("p")).select("bucket", (-F.col("p.minus")).alias("pivot"))
    pairs = open_.join(best, "bucket").where("rep <> pivot").select(F.least("pivot", "rep").alias("least"), F.greatest("pivot", "rep").alias("most"), F.col("pivot").alias("a"), F.col("rep").alias("b")).dropDuplicates(["least", "most"]).select("a", "b")
    found = staged(similar(pairs, texts, limit))
    label = components(found)
    named = staged(open_.select("bucket", "rep").join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root")))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("rep").alias("first")).where("x < y").select("bucket", "first")
    rest = staged(named.join(mixed, "bucket").select("rep", "root", "first").distinct())
    if not rest.isEmpty():
        family = components(rest.select(F.col("rep").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("rep"), F.col("root").alias("family"))
        across = staged(grid(rest.select("rep", "root").distinct().join(family, "rep"), texts, limit))
        label = components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across))
    of = member.join(label.select(F.col("node").alias("rep"), F.col("root").alias("of")), "rep", "left").groupBy("id").agg(F.min(F.coalesce("of", "rep")).alias("class_id"))
    return docs.select(F.col("_id").alias("id")).join(of, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def row_classes(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """Class of every row: (doc_id, class_id), ``class_id`` the smallest doc_id among the rows of its class.

    Rows are compared by their own texts, so rows of one doc_id with different texts keep their own links, and rows
    without a doc_id join the class of their copies (a class of such rows alone has a null ``class_id``).
    """
    d = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    of = d.select("row", "doc_id").join(classes(d, "row", limit).select(F.col("id").alias("row"), "class_id"), "row")
    first = of.groupBy("class_id").agg(F.min("doc_id").alias("first"))
    return of.join(first, "class_id").select("doc_id", F.col("first").alias("class_id"))
