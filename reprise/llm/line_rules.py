"""Quality rules over words and lines, with the document frequency of lines per host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reprise.llm.common import chunks, coded, hashed, per_row, staged, windows_of, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: A line is boilerplate of a host if more of its distinct documents hold it, however large the host.
MAX_DOCUMENTS = 50
#: A document is depleted if fewer words, or a smaller share of them, are left.
MIN_SHARE_LEFT = 0.3
SYMBOLS = "[#*$%&|<>]"

_MEASURED = ("row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, text_key long, lines array<long>, line_words array<int>")


def repeated_words(code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in it."""
    h, start = windows_of(code, row, WINDOW)
    order = np.lexsort((h, row[start]))
    h, at = h[order], start[order]
    same = (h[1:] == h[:-1]) & (row[at[1:]] == row[at[:-1]])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return per_row(row[np.cumsum(edge[:-1]) > 0], n)


def normalised(lines: pa.Array) -> pa.Array:
    """Lines as they are compared between documents: lower case, single spaces."""
    return pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(lines))), " ")


def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    text, n = batch.column("text"), batch.num_rows
    words, row = words_of(text)
    code, _ = coded(words)
    parts = pc.split_pattern(text, "\n")
    lines = parts.flatten()
    line_row = np.repeat(np.arange(n), pc.list_value_length(parts).to_numpy())
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, line_row = lines.filter(full), line_row[full.to_numpy(zero_copy_only=False)]
    exact, distinct = coded(lines)
    seen = line_row.astype(np.int64) * (len(distinct) + 1) + exact
    repeats = per_row(line_row, n) - per_row(np.unique(seen) // (len(distinct) + 1), n)
    normal = normalised(distinct)
    size = pc.list_value_length(pc.ascii_split_whitespace(normal)).to_numpy(zero_copy_only=False).astype(np.int64)
    key = hashed(normal).view(np.int64)[exact] if len(distinct) else np.zeros(0, np.int64)
    order = np.lexsort((key, line_row))
    k, r, w = key[order], line_row[order], size[exact][order] if len(distinct) else np.zeros(0, np.int64)
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(first) - 1
    total = np.bincount(group, weights=w, minlength=int(first.sum()))[:int(first.sum())].astype(np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(per_row(r[first], n))]).astype(np.int32))
    cols = [batch.column("row_id"), batch.column("doc_id"), batch.column("host"), per_row(row, n), per_row(row, n, pc.utf8_length(words).to_numpy().astype(np.int64)).astype(np.int64),
            pc.count_substring_regex(text, SYMBOLS).cast(pa.int64()), repeats, repeated_words(code, row, n), hashed(text).view(np.int64),
            pa.ListArray.from_arrays(offsets, pa.array(k[first])), pa.ListArray.from_arrays(offsets, pa.array(total))]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in cols],
                           ["row_id", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "line_words"])


def measure(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """One row per document: the base measures and its distinct normalised lines with the words that they hold; rows are
    numbered unless they bring a ``row_id``."""
    row_id = F.monotonically_increasing_id() if row_id is None else row_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield measured(b)

    return docs.select(row_id.alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, _MEASURED)


def frequent_lines(measures: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(host, line, owner): lines that too many distinct documents of a host hold, and the row that is the first of these
    documents (by doc_id, null last, then by row).

    Equal texts count as one document, so a group of copies can't make its own lines look like boilerplate.
    """
    texts = measures.groupBy("host", "text_key").agg(F.min("row_id").alias("row_id"))
    one = measures.join(texts.select("row_id"), "row_id", "left_semi")
    held = one.select("host", "row_id", "doc_id", F.explode("lines").alias("line"))
    counted = held.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("o")).withColumn("owner", F.col("o.row_id"))
    return counted.where(F.col("documents") > max_documents).select("host", "line", "owner", "documents")


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Base measures and verdict of every document.

    Lines are compared in lower case with single spaces. A line that more than ``max_documents`` of a host's distinct
    documents hold, whatever the host's size, is removed from all rows but the first (smallest doc_id, null last), so that a
    passage isn't lost altogether. A document is rejected if it fails the base rules (fewer than ten words; more
    than 20 % of its words in repeated five-word windows) or if, without removed lines, under ten words or under 30 % of
    its words are left. Null texts have no words and fail; a null host is a host of its own; repeated rows are judged
    alike; an empty table gives no rows; columns other than doc_id, text, source are not read.
    Returns row_id, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed, kept.
    """
    return _judged(staged(measure(docs)), max_documents).drop("gone_lines")


def _judged(m: DataFrame, max_documents: int) -> DataFrame:
    """The verdicts of ``judge``, and ``gone_lines``: the lines to be removed of each document."""
    common = frequent_lines(m, max_documents)
    held = m.select("row_id", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row_id", "doc_id", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = held.join(common, ["host", "line"]).where(F.col("row_id") != F.col("owner")).groupBy("row_id").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("gone_lines"))
    out = m.drop("lines", "line_words").join(removed, "row_id", "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("bigint"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < MIN_WORDS) | (left < MIN_SHARE_LEFT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select(
        "row_id", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept", "gone_lines")


def shortened(text: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the lines whose hash is in their list ``gone``; the other lines stay as they are, in order."""
    parts = pc.split_pattern(text, "\n")
    lines, n = parts.flatten(), pc.list_value_length(parts).to_numpy()
    row = np.repeat(np.arange(len(text)), n)
    exact, distinct = coded(lines)
    key = hashed(normalised(distinct)).view(np.int64)[exact]
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(distinct)), 0).to_numpy(zero_copy_only=False)[exact]
    hashes, which = coded(pa.concat_arrays([pa.array(key), gone.flatten().cast(pa.int64())]))
    gone_row = np.repeat(np.arange(len(text)), pc.list_value_length(gone).to_numpy())
    stays = ~(full & np.isin(row * len(which) + hashes[:len(key)], gone_row * len(which) + hashes[len(key):]))
    offsets = np.concatenate([[0], np.cumsum(per_row(row[stays], len(text)))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), lines.filter(pa.array(stays))), "\n")


def without_lines(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text"), max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``columns`` of every row with the text as ``judge`` leaves it, n_removed_words and kept.

    A text loses the lines over the limits unless it is the first that holds them; its other lines, blank ones too, stay
    as they are, in order. Frequent lines are joined to the lines of the documents, never collected. Verdict and text
    belong to the row, whatever its doc_id. Null texts stay null.
    """
    d = staged(docs.select(F.monotonically_increasing_id().alias("_row"), *dict.fromkeys([*columns, "doc_id", "text", "source"])))
    verdicts = _judged(staged(measure(d, F.col("_row"))), max_documents).select(F.col("row_id").alias("_row"), "n_removed_words", "kept", "gone_lines")
    rows = d.join(verdicts, "_row").select(*columns, "n_removed_words", "kept", "gone_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            loses = whole.column("gone_lines").is_valid()
            yield whole.filter(pc.invert(loses)).select(names)
            for b in chunks(iter([whole.filter(loses)]), "text"):
                yield b.set_column(b.schema.get_field_index("text"), "text", shortened(b.column("text"), b.column("gone_lines"))).select(names)

    out = rows.drop("gone_lines")
    names = out.columns
    return rows.mapInArrow(run, out.schema)
