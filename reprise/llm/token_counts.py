"""Token counts of a byte-level BPE: pre-tokens as ragged numpy arrays, the lowest-ranked pair of every sequence applied
in each step, surviving symbols counted."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reprise.llm.common import CHUNK_BYTES, chunks

LIMIT = 1024
#: Pre-tokens that are merged together at most.
TOGETHER = 1 << 19
#: Pre-tokens whose size a worker remembers at most.
KNOWN = 1 << 18
_NEVER = np.int64(2 ** 62)
_MODELS: dict[str, "Merges"] = {}


def byte_symbols() -> list[str]:
    """The vocabulary's one-character names of bytes 0 to 255: visible Latin-1 characters name themselves, the others
    take code points from 256 on in their order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """Pair ranks, special strings and the pre-token pattern of a tokenizer file."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)       # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.find = regex.compile(pattern)
        # letters, digits and spaces that the pattern's library knows but the tokenizer's older tables may not
        unassigned = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
        self.newer = np.zeros(sys.maxunicode + 1, bool)
        self.newer[[ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", unassigned)]] = True
        self.library = Tokenizer.from_file(path)
        self.sizes: dict[str, int] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Merges:
        if path not in _MODELS:
            _MODELS[path] = cls(path, pattern)
        return _MODELS[path]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; _NEVER where they don't merge."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER)

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of a text between special strings, and the special strings with their ids."""
        at = 0
        if self.cut is not None and any(s in text for s in self.special):
            for m in self.cut.finditer(text):
                if m.start() > at:
                    yield text[at:m.start()], None
                yield m.group(), self.special[m.group()]
                at = m.end()
        if at < len(text):
            yield (text[at:] if at else text), None

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a stretch, a bounded number at a time."""
        if not text.isascii() and self.newer[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            yield [text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        elif len(text) <= CHUNK_BYTES:
            yield self.find.findall(text)
        else:
            found = (m.group() for m in self.find.finditer(text))
            while part := list(islice(found, TOGETHER)):
                yield part


def merge(model: Merges, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words in order, number of symbols of each).

    In each step every sequence takes its pair of lowest rank, at all its places from left to right. Merging a pair only
    makes pairs of higher rank, so this is the order in which the tokenizer merges them one by one.
    """
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    count = size.copy()
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer() if len(words) else b""
    symbol = model.of_byte[np.frombuffer(flat, np.uint8)]
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(symbol))
    rank = np.full(len(symbol), _NEVER)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = model.ranks(symbol[inner], symbol[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        live = best < _NEVER
        if not live.all():                                   # no pair left: the word is finished
            stay = np.repeat(live, n)
            done.append((place[~stay], symbol[~stay]))
            word, symbol, rank, place = word[stay], symbol[stay], rank[stay], place[stay]
            n, best = n[live], best[live]
            if not len(symbol):
                break
        hit = np.flatnonzero(rank == np.repeat(best, n))
        fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])           # in a run of one symbol every other pair merges
        nth = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        hit = hit[nth % 2 == 0]
        symbol[hit] = model.merged[rank[hit]]
        np.subtract.at(count, word[hit], 1)
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        at = (np.cumsum(keep) - 1)[hit]
        word, symbol, rank, place = word[keep], symbol[keep], rank[keep], place[keep]
        near = np.concatenate([at, at[at > 0] - 1])
        right = np.minimum(near + 1, len(symbol) - 1)
        rank[near] = np.where((word[near] == word[right]) & (near != right), model.ranks(symbol[near], symbol[right]), _NEVER)
    if not done:
        return np.zeros(0, np.int64), count
    where, what = (np.concatenate(x) for x in zip(*done, strict=True))
    return what[np.argsort(where, kind="stable")], count


def gather(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each of the ranges of ``n`` entries, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def counts_of(model: Merges, texts: list[str], with_ids: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of tokens of each text, and their ids where they are asked for.

    Sizes of pre-tokens met before are kept in a table of bounded size, so a frequent one is merged once a task.
    """
    total = np.zeros(len(texts), np.int64)
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[str] = []
    owner: list[tuple[int, int, int | None]] = []            # (text, pre-tokens, id of a special string)

    def sizes() -> np.ndarray:
        n = np.fromiter(map(model.sizes.get, held, repeat(0)), np.int64, len(held))
        new = np.flatnonzero(n == 0)
        if len(new):
            words = pa.array([held[k] for k in new.tolist()], pa.string()).dictionary_encode()
            _, each = merge(model, words.dictionary)
            n[new] = each[words.indices.to_numpy(zero_copy_only=False)]
            if len(model.sizes) + len(each) > KNOWN:
                model.sizes.clear()
            if len(each) <= KNOWN:
                model.sizes.update(zip(words.dictionary.to_pylist(), each.tolist(), strict=True))
        return n

    def flush() -> None:
        row = np.repeat(np.array([o[0] for o in owner], np.int64), np.array([o[1] for o in owner], np.int64))
        if not with_ids:
            total[:] += np.bincount(row, weights=sizes(), minlength=len(texts)).astype(np.int64)
        else:
            words = pa.array(held, pa.string()).dictionary_encode()
            symbols, each = merge(model, words.dictionary)
            code, begin, at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(each) - each, 0
            for text, many, special in owner:
                c = code[at:at + many]
                ids[text].append(symbols[gather(begin[c], each[c])] if special is None else np.array([special]))
                total[text] += len(ids[text][-1]) if special is None else 0
                at += many
        held.clear()
        owner.clear()

    for k, text in enumerate(texts):
        for stretch, special in model.pieces(text):
            if special is not None:
                total[k] += 1
                owner.append((k, 0, special))
                continue
            for part in model.pre_tokens(stretch):
                held.extend(part)
                owner.append((k, len(part), None))
                if len(held) >= TOGETHER:
                    flush()
    flush()
    return total, [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row, counted where it is read.

    Null texts are empty and have no tokens; rows with a null or a repeated id each have a row; a special string inside a
    text is one token, as the tokenizer's library has it; an empty table gives no rows; columns other than doc_id and
    text are not read. Whole texts are counted, a bounded number of pre-tokens at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Merges.load(path, pattern)
        for b in chunks(batches, "text"):
            text = b.column("text")
            n, _ = counts_of(model, text.to_pylist())
            yield pa.record_batch([b.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _source(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every row; nulls, repeats and special strings as in ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Merges.load(path, pattern)
        for b in chunks(batches, "text"):
            n, ids = counts_of(model, b.column("text").to_pylist(), with_ids=True)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>")
