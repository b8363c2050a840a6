"""Encoding and decoding with a merge-type piece model, with seeded merge-dropout: a candidate merge is skipped if its
keyed hash falls under the rate, so that texts get varied segmentations that decode to the same text."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reprise.llm.common import chunks, coded, hashed, mix, per_row

RATE, SEED = 0.1, 1
#: Segmentations of equal units differ between documents by this many variants, told by a hash of doc_id.
VARIANTS = 4
#: Units of more characters than this have an agenda of their own; shorter ones go step by step together.
TOGETHER = 48
SPACE, UNKNOWN = "▁", 0xFFFF
NEVER = np.int64(2 ** 40)
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MODELS: dict[str, "Pieces"] = {}


@dataclass(frozen=True)
class Pieces:
    """Tables of a model file: id of each character, merged piece and order of each pair, bytes of each piece."""

    of_char: np.ndarray
    pair: np.ndarray
    merged: np.ndarray
    order: np.ndarray
    raw: list[bytes]
    byte: np.ndarray

    @staticmethod
    def load(path: str) -> Pieces:
        if path in _MODELS:
            return _MODELS[path]
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = {text[i]: i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        byte = np.zeros(256, np.int64)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                byte[int(text[i][1:-1], 16)], raw[i] = i, bytes([int(text[i][1:-1], 16)])
        of_char = np.full(0x110000, UNKNOWN, np.int64)
        pairs = []
        # equal scores share an order: the place decides between them
        rank = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain.values()}, reverse=True))}
        for p, i in plain.items():
            raw[i] = p.replace(SPACE, " ").encode()
            if len(p) == 1:
                of_char[ord(p)] = i
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    pairs.append(((a << 16) | b, i, rank[sp.get_score(i)]))
        of_char[ord(" ")] = of_char[ord(SPACE)]
        of_char[ord(SPACE)] = UNKNOWN           # the mark itself goes by its bytes, or it would decode to a space
        pairs.sort()
        t = np.array(pairs, np.int64)
        _MODELS[path] = Pieces(of_char, t[:, 0], t[:, 1], t[:, 2], raw, byte)
        return _MODELS[path]

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, merged piece) of each pair; NEVER where they don't merge."""
        key = (a << 16) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a != UNKNOWN) & (b != UNKNOWN)
        return np.where(hit, self.order[at], NEVER), self.merged[at]


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate merge of [start, middle) and [middle, end) of a unit is skipped."""
    u = lambda x: x.astype(np.uint64)
    h = mix(key + u(start) * np.uint64(_A) + u(middle) * np.uint64(_B) + u(end) * np.uint64(_C))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < rate


def agenda(pieces: Pieces, points: np.ndarray, key: np.uint64, rate: float) -> list[tuple[int, int]]:
    """(start, piece) of one unit: a heap of candidate merges, best order and then leftmost first."""
    n = len(points)
    piece, after, before, end = pieces.of_char[points].tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, heap = [True] * n, []

    def propose(left: list[int]) -> None:
        left = [i for i in left if i >= 0 and after[i] < n]
        if not left:
            return
        right = [after[i] for i in left]
        order, merged = pieces.candidates(np.array([piece[i] for i in left]), np.array([piece[i] for i in right]))
        ends = [end[i] for i in right]
        skip = skipped(np.full(len(left), key), np.array(left), np.array(right), np.array(ends), rate)
        for i, j, e, o, m, s in zip(left, right, ends, order.tolist(), merged.tolist(), skip.tolist(), strict=True):
            if o < NEVER and not s:
                heapq.heappush(heap, (o, i, j, e, m))

    propose(list(range(n)))
    while heap:
        _, i, j, e, m = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == e):
            continue
        piece[i], end[i], after[i], alive[j] = m, e, after[j], False
        if after[i] < n:
            before[after[i]] = i
        propose([before[i], i])
    return [(i, piece[i]) for i in range(n) if alive[i]]


def together(pieces: Pieces, points: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, piece) of all units at once: in each step every unit takes the best entry of its agenda."""
    unit = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    end = start + 1
    piece = pieces.of_char[points]

    def entries(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.minimum(i + 1, len(piece) - 1)
        order, merged = pieces.candidates(piece[i], piece[j])
        no = (unit[i] != unit[j]) | (i == j) | skipped(key[unit[i]], start[i], start[j], end[j], rate)
        return np.where(no, NEVER, order), merged

    order, merged = entries(np.arange(len(piece)))
    done: list[tuple] = []
    while len(piece):
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        n = np.diff(np.append(first, len(unit)))
        best = np.minimum.reduceat(order, first)
        live = np.repeat(best < NEVER, n)
        if not live.all():
            done.append((unit[~live], start[~live], piece[~live]))
            unit, start, end, piece, order, merged = (x[live] for x in (unit, start, end, piece, order, merged))
            n, best = n[best < NEVER], best[best < NEVER]
            if not len(piece):
                break
        hit = np.flatnonzero(order == np.repeat(best, n))
        hit = hit[np.concatenate([[True], unit[hit[1:]] != unit[hit[:-1]]])]        # the leftmost of each unit
        piece[hit], end[hit] = merged[hit], end[hit + 1]
        keep = np.ones(len(piece), bool)
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        unit, start, end, piece, order, merged = (x[keep] for x in (unit, start, end, piece, order, merged))
        near = np.concatenate([at, at[at > 0] - 1])
        order[near], merged[near] = entries(near)
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (unit, start, piece)


def units_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units that no merge can cross, and the text of each: runs of spaces with what follows up to the next space. A
    space is put before each text that isn't empty."""
    some = np.flatnonzero(pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    spaced = pc.binary_join_element_wise(pa.scalar(""), text.take(pa.array(some)), " ")
    if not len(some):
        return pa.array([], pa.string()), some
    ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset:spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[:ends[-1]]
    space = data == 32
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[:ends[0]] = False
    new[ends[:-1]] = True
    at = np.flatnonzero(new).astype(np.int32)
    offsets = np.append(at, ends[-1]).astype(np.int32)
    units = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), spaced.buffers()[2])
    return units, some[np.searchsorted(ends, at, side="right") - 1]


def encode_batch(pieces: Pieces, text: pa.Array, variant: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each."""
    units, row = units_of(text)
    if not len(units):
        return np.zeros(0, np.int64), np.zeros(len(text), np.int64)
    code, distinct = coded(units)
    pair, inverse = np.unique(code * VARIANTS + variant[row], return_inverse=True)
    which = pair // VARIANTS
    key = mix(hashed(distinct)[which] ^ mix((pair % VARIANTS).astype(np.uint64) + np.uint64(seed * VARIANTS)))
    size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    begin = np.cumsum(size) - size
    spread = lambda k: np.repeat(begin[which[k]], size[which[k]]) + np.arange(size[which[k]].sum()) - np.repeat(np.cumsum(size[which[k]]) - size[which[k]], size[which[k]])
    short = np.flatnonzero(size[which] <= TOGETHER)
    parts = []
    if len(short):
        u, s, p = together(pieces, points[spread(short)], size[which[short]], key[short], rate)
        parts.append((short[u], s, p))
    for k in np.flatnonzero(size[which] > TOGETHER):
        b = begin[which[k]]
        got = np.array(agenda(pieces, points[b:b + size[which[k]]], key[k], rate))
        parts.append((np.full(len(got), k), got[:, 0], got[:, 1]))
    unit, start, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, unit))
    unit, start, piece = unit[order], start[order], piece[order]
    odd = np.flatnonzero(piece == UNKNOWN)
    if len(odd):                                    # characters without a piece go by their bytes
        spelled = [[int(pieces.byte[x]) for x in chr(c).encode()] for c in points[begin[which[unit[odd]]] + start[odd]].tolist()]
        n = np.ones(len(piece), np.int64)
        n[odd] = [len(s) for s in spelled]
        first = (np.cumsum(n) - n)[odd]
        unit, piece = np.repeat(unit, n), np.repeat(piece, n)
        for f, s in zip(first.tolist(), spelled, strict=True):
            piece[f:f + len(s)] = s
    many = per_row(unit, len(pair))
    base = np.cumsum(many) - many
    n = many[inverse]
    at = np.repeat(base[inverse], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return piece[at], per_row(row, len(text), n).astype(np.int64)


def decoded(pieces: Pieces, ids: list[int] | np.ndarray) -> str:
    """The text of ids: the first space is the one that encoding put there."""
    return b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, text, ids) of every document.

    Null texts are empty and have no ids; a null doc_id has a variant of its own; repeated rows give equal ids; an empty
    table gives no rows; columns other than doc_id and text are not read. With rate 0 the ids are those of the model's
    own library. Whole texts are encoded where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for b in chunks(batches, "text", 4 << 20):
            ids, n = encode_batch(pieces, b.column("text"), b.column("variant").to_numpy(), rate, seed)
            yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "text", "ids"])

    return _with_variant(docs, seed).mapInArrow(run, "doc_id long, text string, ids array<int>")


def _with_variant(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(VARIANTS)).cast("bigint").alias("variant"), F.col("text").cast("string").alias("text"))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([decoded(pieces, i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), lossless (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for b in chunks(batches, "text", 4 << 20):
            ids, n = encode_batch(pieces, b.column("text"), b.column("variant").to_numpy(), rate, seed)
            ends = np.cumsum(n)
            little, crc, same = ids.astype("<u4"), [], []
            for text, e, k in zip(b.column("text").to_pylist(), ends.tolist(), n.tolist(), strict=True):
                crc.append(zlib.crc32(little[e - k:e].tobytes()))
                same.append(decoded(pieces, little[e - k:e].tolist()) == text)
            yield pa.record_batch([b.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "lossless"])

    return _with_variant(docs, seed).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")
