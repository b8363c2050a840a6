"""Phrase mining over occurrence relations: sorted (piece, position) relations joined at adjacent positions, counted by
group, and kept where their group is frequent before the next length (SETM)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reprise.llm.common import chunks, coded, mix, staged

LONGEST, LEAST, TOP = 5, 100, 2000
#: Frequent groups that a length may broadcast. Beyond it only groups with one occurrence in HOT_SHARE or more are, which
#: are HOT_SHARE at most, and the others are met by a shuffle.
BROADCAST = 1 << 20
HOT_SHARE = 1 << 16
#: Bytes of text whose words make one row of the first relation, and occurrences that one sort counts.
ROW_BYTES, COUNTED = 2 << 20, 1 << 19
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
PARTS = 128
#: Bits of a row's number below that of the part of the table that holds it.
PART_BITS = 36
_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_RELATION = "row long, gap array<tinyint>, h array<bigint>"
#: Columns of the first relation and of later ones.
_FIRST, _LATER = ("row", "gap", "code", "lang", "word"), ("row", "gap", "h")
_NAMES = "marks long, name array<bigint>, first array<bigint>, last array<bigint>, mark array<int>"


def word_positions(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in order, the text of each, its position); positions jump by more than one between pieces and texts."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[list(_BLANKS)], kind[list(_BREAKS)] = 1, 2
    k = kind[data] if len(data) else np.zeros(0, np.uint8)
    inside = k == 0
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(k) else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 if len(k) else start
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    ends = np.cumsum([len(t.encode()) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    text = np.searchsorted(ends, start, side="right")
    return words, text, np.arange(len(start)) + np.cumsum(k == 2)[start] if len(start) else start


def found(sorted_codes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_codes, h), len(sorted_codes) - 1)
    return sorted_codes[at] == h


@dataclass(frozen=True)
class Codes:
    """How parts make the code of a longer occurrence: ``bits`` of a 64-bit hash, and anew, with a second hash, for codes
    that several phrases were found to share (``split``, in the order they were found)."""

    seed: int
    bits: int
    split: tuple[np.ndarray, ...] = ()

    def cut(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def joined(self, gap: np.ndarray, h: np.ndarray, marked: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge join of a sorted relation with itself at adjacent positions: places, codes and marks (31 bits of a second
        hash) of the longer occurrences, whose first and last parts are those at the place and after it."""
        at = np.flatnonzero(gap[1:] == 1)
        u = np.uint64
        first, last = h[at].view(u), h[at + 1].view(u)
        inner = mix(last + u(0x632BE59BD9B4E019 + self.seed))
        code = self.cut(mix(first * u(0x9E3779B97F4A7C15) + inner))
        if not (marked or self.split):
            return at, code, at
        second = mix((first ^ u(0xD6E8FEB86659FD93)) * u(0xA0761D6478BD642F) + inner)
        for shared in self.split:
            again = found(shared, code)
            code[again] = self.cut(mix(second[again] ^ code[again].view(u)))
        return at, code, (second >> u(33)).astype(np.int32)


def kept(keep: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Gaps between the occurrences that stay."""
    p = position[keep]
    return np.concatenate([[2], np.minimum(np.diff(p), 2)]).astype(np.int8)[:len(p)]


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    if not len(column):
        return iter(())
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return iter(np.split(flat, ends[:-1]))


def as_list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


class Numbers:
    """Row numbers that no other task gives."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << PART_BITS

    def one(self) -> pa.Array:
        self.next += 1
        return pa.array([self.next - 1], pa.int64())


@dataclass
class Frequent:
    """Codes of a length's frequent groups: ``sent`` to all tasks (sorted, with the origin of each), ``rest`` where there are
    too many to send."""

    sent: Broadcast
    rest: DataFrame | None


def keyed(values: pa.Array, seed: int) -> np.ndarray:
    """64-bit hash of each string, another one for each seed."""
    return pd.util.hash_array(np.asarray(values.to_pylist(), dtype=object), hash_key=f"{seed:016d}", categorize=False)


def word_codes(langs: pa.Array, lang: np.ndarray, words: pa.Array, word: np.ndarray, codes: Codes) -> np.ndarray:
    """Code of each (lang, word), given as places in their distinct values."""
    return codes.cut(mix(keyed(words, codes.seed)[word] ^ mix(keyed(langs, codes.seed))[lang]))


def coded_words(words: DataFrame, codes: Codes) -> DataFrame:
    """(lang, word, n) with the code ``h`` that occurrences carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, langs = coded(b.column("lang"))
            h = word_codes(langs, lang, b.column("word"), np.arange(b.num_rows), codes)
            yield pa.record_batch([pa.array(h), *b.columns], ["h", *b.schema.names])

    return words.mapInArrow(run, "h long, lang string, word string, n long")


def occurrences(docs: DataFrame) -> DataFrame:
    """The first relation, one row a stretch of texts: gaps and each occurrence's place among the stretch's (lang, word),
    which stand beside them with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        for b in chunks(batches, "text", ROW_BYTES):
            words, text, position = word_positions(pc.ascii_lower(b.column("text")).to_pylist())
            if not len(words):
                continue
            code, distinct = coded(words)
            lang, langs = coded(b.column("lang"))
            pair, inverse, times = np.unique(code * len(langs) + lang[text], return_inverse=True, return_counts=True)
            gap = np.concatenate([[2], np.minimum(np.diff(position), 2)]).astype(np.int8)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), x)
            yield pa.record_batch([number.one(), as_list(gap, pa.int8()), as_list(inverse, pa.int32()), one(langs.take(pa.array(pair % len(langs)))), one(distinct.take(pa.array(pair // len(langs)))),
                                   one(pa.array(times.astype(np.int64)))], ["row", "gap", "code", "lang", "word", "times"])

    d = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return d.mapInArrow(run, "row long, gap array<tinyint>, code array<int>, lang array<string>, word array<string>, times array<bigint>")


def rows_of(b: pa.RecordBatch, codes: Codes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, gap, code) of every row of a relation; the first relation's codes are made from its words."""
    rows = b.column("row").to_pylist()
    if "h" in b.schema.names:
        yield from zip(rows, lists(b.column("gap")), lists(b.column("h")), strict=True)
        return
    for k, (row, gap, place) in enumerate(zip(rows, lists(b.column("gap")), lists(b.column("code")), strict=True)):
        lang, langs = coded(b.column("lang")[k].values)
        words = b.column("word")[k].values
        yield row, gap, word_codes(langs, lang, words, np.arange(len(words)), codes)[place]


def counted(relation: DataFrame, keep: Broadcast | None, codes: Codes, careful: bool) -> DataFrame:
    """(h, n, origin) of the longer occurrences, ``origin`` being one of the written parts that hold the group; with
    ``careful`` also low and high, which differ where phrases share a code. ``keep``: codes of the frequent groups where
    the relation holds others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size, origin = 0, -1

        def out() -> pa.RecordBatch:
            code = np.concatenate([p[0] for p in parts])
            if not careful:
                h, n = np.unique(code, return_counts=True)
                return pa.record_batch([pa.array(h), pa.array(n), pa.array(np.full(len(h), origin, np.int32))], names)
            mark = np.concatenate([p[1] for p in parts])
            order = np.lexsort((mark, code))
            code, mark = code[order], mark[order]
            # one row a code and mark: two phrases of one code stay apart until they are compared
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (mark[1:] != mark[:-1])]))
            return pa.record_batch([pa.array(code[new]), pa.array(np.diff(np.append(new, len(code)))), pa.array(np.full(len(new), origin, np.int32)), pa.array(mark[new])], names)

        for b in batches:
            for row, gap, h in rows_of(b, codes):
                if parts and (size >= COUNTED or row >> PART_BITS != origin):
                    yield out()
                    parts, size = [], 0
                origin = row >> PART_BITS
                if keep is not None:
                    stay = found(keep.value[0], h)
                    gap, h = kept(stay, np.cumsum(gap, dtype=np.int64)), h[stay]
                parts.append(codes.joined(gap, h, careful)[1:])
                size += len(parts[-1][0])
        if size:
            yield out()

    names = ["h", "n", "origin", "mark"] if careful else ["h", "n", "origin"]
    one = relation.mapInArrow(run, "h long, n long, origin int" + (", mark int" if careful else ""))
    return one.groupBy("h").agg(F.sum("n").alias("n"), F.min("origin").alias("origin"), *([F.min("mark").alias("low"), F.max("mark").alias("high")] if careful else []))


def extended(relation: DataFrame, keep: Broadcast | None, sent: Broadcast, all_of: bool, codes: Codes) -> DataFrame:
    """The relation of the longer occurrences whose group is in ``sent`` (``all_of``: of all) with the sum of each row's
    marks, and (code, first part, last part, mark) of the groups: of one that was sent, where its origin is read; of
    others, where a task meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        seen = np.zeros(0, np.int64)
        sent_codes, origin = sent.value
        for b in batches:
            for row, gap, h in rows_of(b, codes):
                position = np.cumsum(gap, dtype=np.int64)
                if keep is not None:
                    stay = found(keep.value[0], h)
                    gap, h, position = kept(stay, position), h[stay], position[stay]
                at, code, mark = codes.joined(gap, h)
                known = found(sent_codes, code)
                stay = np.ones(len(code), bool) if all_of else known
                if not stay.any():
                    continue
                at, code, known, mark = at[stay], code[stay], known[stay], mark[stay]
                groups, one = np.unique(code, return_index=True)
                new = ~found(seen, groups)
                if len(origin):
                    here = origin[np.minimum(np.searchsorted(sent_codes, groups), len(origin) - 1)] == row >> PART_BITS
                    new &= here | ~known[one]
                one = one[new]
                if len(seen) < COUNTED:
                    seen = np.union1d(seen, code[one])
                yield pa.record_batch([number.one(), as_list(kept(np.arange(len(at)), position[at]), pa.int8()), as_list(code, pa.int64()), pa.array([int(mark.sum(dtype=np.int64))]),
                                       *(as_list(x[one], pa.int64()) for x in (code, h[at], h[at + 1])), as_list(mark[one], pa.int32())], ["row", "gap", "h", "marks", "name", "first", "last", "mark"])
            pa.default_memory_pool().release_unused()

    return relation.mapInArrow(run, f"{_RELATION}, {_NAMES}")


def one_phrase_a_code(relation: DataFrame, names: DataFrame) -> bool:
    """Whether every occurrence of a code is of the phrase that named it: the marks of a row's occurrences add up to those
    of the names. ``names`` are few enough to send."""
    table = names.select("h", "mark").toArrow()
    codes, marks = table.column("h").to_numpy().astype(np.int64), table.column("mark").to_numpy().astype(np.int64)
    order = np.argsort(codes)
    if len(codes) and (np.diff(codes[order]) == 0).any():
        return False
    sent = relation.sparkSession.sparkContext.broadcast((codes[order], marks[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, marks = sent.value
        for b in batches:
            off = [int(m != marks[np.searchsorted(codes, h)].sum()) for m, h in zip(b.column("marks").to_pylist(), lists(b.column("h")), strict=True)]
            yield pa.record_batch([pa.array([sum(off)], pa.int64())], ["off"])

    return not relation.select("marks", "h").mapInArrow(run, "off long").where("off > 0").limit(1).count()


def frequent(groups: DataFrame, occurrences_of_all: int, broadcast: int) -> Frequent:
    """Codes to send to all tasks. Too many: only those with one occurrence in HOT_SHARE or more, and a table of the rest."""
    spark = groups.sparkSession
    if groups.count() <= broadcast:
        sent, rest = groups, None
    else:
        hot = F.col("n") * HOT_SHARE >= F.lit(occurrences_of_all)
        sent, rest = groups.where(hot), groups.where(~hot).select("h")
    table = sent.select("h", "origin").toArrow()
    codes, origin = table.column("h").to_numpy().astype(np.int64), table.column("origin").to_numpy().astype(np.int64)
    order = np.argsort(codes)
    return Frequent(spark.sparkContext.broadcast((codes[order], origin[order])), rest)


def semi_joined(relation: DataFrame, groups: Frequent, codes: Codes) -> DataFrame:
    """Occurrences of frequent groups. Those not sent are met by a shuffle: each such code has few occurrences, and what
    is found is listed by row, which holds a bounded number of them."""
    sent = groups.sent

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, h in rows_of(b, codes):
                at = np.flatnonzero(~found(sent.value[0], h))
                yield pa.record_batch([pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)), pa.array(h[at])], ["row", "at", "h"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (row, gap, h), more in zip(rows_of(b, codes), b.column("places").to_pylist(), strict=True):
                keep = found(sent.value[0], h)
                keep[more or []] = True
                yield pa.record_batch([pa.array([row]), as_list(kept(keep, np.cumsum(gap, dtype=np.int64)), pa.int8()), as_list(h[keep], pa.int64())], ["row", "gap", "h"])

    hits = relation.mapInArrow(others, "row long, at int, h long").join(groups.rest, "h", "left_semi")
    places = hits.groupBy("row").agg(F.collect_list("at").alias("places"))
    return relation.join(places, "row", "left").mapInArrow(stay, _RELATION)


def _unnested(df: DataFrame, **columns: str) -> DataFrame:
    z = F.explode(F.arrays_zip(*columns.values()))
    return df.where(F.col(next(iter(columns.values()))).isNotNull()).select(z.alias("z")).select(*[F.col(f"z.{c}").alias(a) for a, c in columns.items()])


def _counts(relation: DataFrame, keep: Broadcast | None, least: int, codes: Codes) -> tuple[DataFrame, Codes] | None:
    """Frequent groups of the longer occurrences with codes of their own: those that phrases share are split and all is
    counted again; None where splitting doesn't end."""
    for _ in range(3):
        counts = staged(counted(relation, keep, codes, True).where(F.col("n") >= least))
        shared = [r["h"] for r in counts.where(F.col("low") < F.col("high")).select("h").collect()]     # next to none among 2^64 codes
        if not shared:
            return counts.select("h", "n", "origin"), codes
        codes = replace(codes, split=(*codes.split, np.sort(np.array(shared, np.int64))))
    return None


def _longer(relation: DataFrame, keep: Broadcast | None, least: int, broadcast: int, codes: Codes) -> tuple[DataFrame, DataFrame, Frequent] | str:
    """(relation and names of the longer occurrences, counts, frequent groups). Counted without marks first; where there
    are too many groups to send, or a code turns out to be shared, again with them."""
    for careful in (False, True):
        if careful:
            own = _counts(relation, keep, least, codes)
            if own is None:
                return "shared"
            counts, codes = own
        else:
            counts = staged(counted(relation, keep, codes, False).where(F.col("n") >= least))
        size = counts.agg(F.sum("n")).first()[0]
        if not size:
            return "none"
        groups = frequent(counts, size, broadcast)
        if groups.rest is not None and not careful:
            continue
        longer = staged(extended(relation, keep, groups.sent, groups.rest is not None, codes))
        if careful or one_phrase_a_code(longer, _unnested(longer, h="name", mark="mark").distinct()):
            return longer, counts, groups
    return "shared"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of relations are long: Arrow batches of a few of them instead of a partition's whole content."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _mined(docs: DataFrame, longest: int, least: int, broadcast: int, codes: Codes) -> tuple[DataFrame, DataFrame] | None:
    """(frequent phrases of all lengths, words of each lang); None where codes collide that can't be split."""
    first = staged(occurrences(docs))
    words = staged(coded_words(_unnested(first, lang="lang", word="word", n="times").groupBy("lang", "word").agg(F.sum("n").alias("n")), codes))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    one = words.where(F.col("n") >= least)
    if words.join(one.select("h"), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        return None
    level = staged(one.select("h", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), "n",
                              F.array("n").alias("starts"), F.array("n").alias("ends")))
    found_all = level.withColumn("k", F.lit(1))
    relation, seen = first.select(*_FIRST), words.agg(F.sum("n")).first()[0] or 0
    groups = frequent(level.select("h", "n", F.lit(-1).alias("origin")), seen, broadcast)
    keep: Broadcast | None = groups.sent
    for k in range(2, longest + 1):
        if groups.rest is not None:
            relation, keep = staged(semi_joined(relation, groups, codes)), None
        step = _longer(relation, keep, least, broadcast, codes)
        if step == "none":
            break
        if step == "shared":
            return None
        longer, counts, groups = step
        names = _unnested(longer, h="name", first="first", last="last").distinct().join(counts.select("h", "n"), "h")
        a = level.select(F.col("h").alias("first"), "lang", F.col("phrase").alias("first_phrase"), "starts")
        z = level.select(F.col("h").alias("last"), "last_word", "ends")
        whole = names.join(a, "first").join(z, "last")
        level = staged(whole.select("h", "lang", F.concat_ws(" ", "first_phrase", "last_word").alias("phrase"), "last_word", "first", "last", "n",
                                    F.concat("starts", F.array("n")).alias("starts"), F.concat("ends", F.array("n")).alias("ends")))
        found_all = found_all.unionByName(level.withColumn("k", F.lit(k)))
        relation, keep = longer.select(*_LATER), None
    return found_all, total


def worst_cut(n: Column, k: Column, starts: Column, ends: Column, total: Column) -> Column:
    """(score, cut, l, r) of the lowest-scoring cut, ties to the smallest: floor(1000 * a * n / (l * r)) in decimals of 38
    digits, which hold counts up to 10^16."""
    big = lambda c: c.cast("decimal(17,0)")
    whole = (F.lit(1000).cast("decimal(4,0)") * big(n) * big(total)).cast("decimal(38,0)")

    def of(cut: Column) -> Column:
        left, right = F.element_at(starts, cut), F.element_at(ends, k - cut)
        score = F.call_function("div", whole, (big(left) * big(right)).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), cut.alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), k - 1), of))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, broadcast: int = BROADCAST, code_bits: int = 64) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words.

    Words are runs without blanks within pieces; a piece never crosses a text. A phrase counts with ``least`` occurrences
    or more, overlaps included; it goes where a longer phrase that holds it is as frequent; its score is that of its
    lowest cut. Null texts hold no words; a null lang is ``und``; repeated rows count again; equal scores and counts are
    ordered by the phrase's bytes; a table without phrases gives no rows; other columns are not read.

    Phrases go by 64-bit codes (``code_bits``); those that share one are found by a second hash and told apart, so counts
    are exact. Returns lang, rank, phrase, a, l, r, n, score.
    """
    seed, mined = 0, None
    while mined is None:                     # a frequent word's code is another's too: next to never with 64 bits
        with small_batches(docs.sparkSession):
            mined = _mined(docs, longest, least, broadcast, Codes(seed, code_bits))
        seed += 1
    phrases, total = mined
    longer = phrases.where("k > 2")
    covered = longer.select(F.col("first").alias("h"), (F.col("k") - 1).alias("k"), "n").unionByName(longer.select(F.col("last").alias("h"), (F.col("k") - 1).alias("k"), "n"))
    covered = covered.groupBy("k", "h").agg(F.max("n").alias("most"))
    # a phrase inside a longer one is inside one of one word more, whose count lies between theirs
    best = phrases.where("k > 1").join(covered, ["k", "h"], "left").where(F.coalesce(F.col("most") < F.col("n"), F.lit(True)))
    scored = best.withColumnRenamed("n", "a").join(total, "lang").withColumn("w", worst_cut(F.col("a"), F.col("k"), F.col("starts"), F.col("ends"), F.col("n")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    found_all = scored.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score", F.pmod("h", F.lit(PARTS)).alias("part"))
    # a language's phrases are ranked in parts first, so that one task orders PARTS * top rows of it at most
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    some = found_all.withColumn("rank", in_part).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return some.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
