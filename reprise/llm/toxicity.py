"""Toxicity by non-negative positive-unlabelled learning: a linear classifier over words and shared word beginnings, fitted in numpy to
confirmed toxic examples and unlabelled texts with a class-prior-corrected risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reprise.llm.common import chunks, coded, hashed, mix, per_row, staged, windows_of, words_of

#: Bounds of the sample that the classifier is fitted on: confirmed positives, unlabelled texts, words.
MAX_POSITIVES = 20_000
MAX_UNLABELLED = 20_000
MAX_FEATURES = 4096
#: A word or beginning is a feature if this many positives hold it, its share among them stands out by a log-likelihood
#: ratio of twice the logarithm of the number of candidates (about one by chance), and by the class prior at least
#: MIN_PRECISION of the texts with it are positive.
MIN_POSITIVES = 3
MIN_PRECISION = 0.5
#: Features that stand out most: they bound the class prior.
SURE_FEATURES = 10
#: The most that a text scores where no word stands out.
BLIND_SCORE = 0.1
THRESHOLD = 0.3
#: Lengths of the word beginnings that count as features.
STEMS = (3, 4, 5, 6, 7)
#: Shares of a text's words from which a word or a beginning counts as present.
WORD_SHARE, STEM_SHARE = 0.0004, 0.002
#: Orders under which near copies in the sample are told by a common earliest window.
FAMILY_KEYS = 4
_EDGE = "#*$%&|<>.,;:!?\"'()[]{}-_/\\"


@dataclass(frozen=True)
class Model:
    """Sorted word hashes, their weights, and the bias; ``prior`` is the share of positives that it was fitted to."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + per_row(row, n, self.weights[feature] * value), -30, 30)))


def evidence(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, value, strong) of each text's features, only those in the sorted array ``wanted`` if given.

    Features: each distinct word, in lower case without marks at its ends, and each word beginning of a length in
    ``STEMS`` that two words or more of the text share. Values are percentages of the text's words, at most 1 for a word
    and 2 for a beginning, so that a word which a long text holds by chance weighs little. ``strong``: often enough in
    the text to count as present when features are chosen.
    """
    words, row = words_of(text)
    out: list[tuple] = []
    if len(words):
        size = per_row(row, len(text))
        code, distinct = coded(words)
        code2, plain = coded(pc.utf8_trim(pc.utf8_lower(distinct), characters=_EDGE))
        code = code2[code]
        width = pc.utf8_length(plain).to_numpy(zero_copy_only=False)

        def take(code: np.ndarray, h: np.ndarray, ok: np.ndarray, least: int, share: float, most: float) -> None:
            if wanted is not None:
                ok = ok & ((wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)[code] if len(wanted) else False)
            pair, n = np.unique(row[ok] * np.int64(len(h)) + code[ok], return_counts=True)
            pair, n = pair[n >= least], n[n >= least]
            r = pair // len(h)
            out.append((r, h[pair % len(h)], np.minimum(most, 100.0 * n / size[r]), n >= share * size[r]))

        take(code, hashed(plain), (width > 0)[code], 1, WORD_SHARE, 1.0)
        for length in STEMS:
            stem, stems = coded(pc.utf8_slice_codeunits(plain, 0, length))
            take(stem[code], mix(hashed(stems) + np.uint64(1)), (width > length)[code], 2, STEM_SHARE, 2.0)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def known(model_words: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature number, value) of the model's features in each text."""
    row, h, value, _ = evidence(text, model_words)
    return row, np.searchsorted(model_words, h), value


def families(text: pa.Array) -> np.ndarray:
    """rows x FAMILY_KEYS earliest five-word windows under as many orders: near copies share most of them. A text of fewer
    words goes by its whole word sequence; texts without words share one key."""
    words, row = words_of(text)
    out = np.full((len(text), FAMILY_KEYS), -1, np.int64)
    if len(words):
        code, distinct = coded(words)
        value, size = hashed(distinct)[code], per_row(row, len(text))
        for width in range(1, 5):
            few = np.flatnonzero(size == width)
            of_few = np.isin(row, few)
            h, start = windows_of(value[of_few], row[of_few], width)
            for k in range(FAMILY_KEYS):
                out[row[of_few][start], k] = mix(h + np.uint64(k)).view(np.int64)
        h, start = windows_of(value, row, 5)
        r = row[start]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        for k in range(FAMILY_KEYS):
            if len(r):
                out[r[first], k] = np.minimum.reduceat(mix(h + np.uint64(k)), first).view(np.int64)
    return out


def risk_step(f_pos: np.ndarray, f_unl: np.ndarray, prior: float, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Slopes of the non-negative risk at the scores, and the risk.

    Risk: prior * mean_P l(f) + max(-slack, mean_U l(-f) - prior * mean_P l(-f)) with the logistic loss. Where the
    second part falls below -slack, the step climbs it instead, as the correction asks.
    """
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -30, 30)))
    negative = loss(-f_unl).mean() - prior * loss(-f_pos).mean()
    g_pos = prior * slope(f_pos) / len(f_pos)
    n_pos, n_unl = prior * slope(-f_pos) / len(f_pos), -slope(-f_unl) / len(f_unl)
    if negative >= -slack:
        return g_pos + n_pos, n_unl, float(prior * loss(f_pos).mean() + max(-slack, negative))
    return -n_pos, -n_unl, float(prior * loss(f_pos).mean())


Part = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def fit(positive: Part, unlabelled: Part, n_features: int, prior: float,
        steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; inputs are (row, feature, value, number of rows)."""
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, best, best_w = np.zeros_like(w), np.zeros_like(w), np.inf, w.copy()

    def scores(part: Part) -> np.ndarray:
        return w[-1] + per_row(part[0], part[3], w[part[1]] * part[2])

    def slopes(part: Part, g: np.ndarray) -> np.ndarray:
        return np.bincount(part[1], weights=g[part[0]] * part[2], minlength=n_features + 1)

    for t in range(1, steps + 1):
        gp, gu, risk = risk_step(scores(positive), scores(unlabelled), prior)
        if risk < best:
            best, best_w = risk, w.copy()
        g = slopes(positive, gp) + slopes(unlabelled, gu)
        g[:-1] += decay * w[:-1]
        g[-1] = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)      # features stand out among positives: none speaks against them
    return best_w[:-1], float(best_w[-1])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """Fit on rows of ``docs`` (doc_id, text) where ``may_learn``, a column over doc_id, holds.

    Positives: rows that ``labels`` (doc_id, toxic) marks 1. Unlabelled: rows as they come, whatever their label. The
    class prior is the share of 1 among labelled rows. Samples are the rows with the smallest hashes of doc_id, within
    the bounds above; only word counts over the sample and the rows' feature numbers reach the driver. Null ids and
    labels are left out, repeated labels count once (1 wins); without positives, or words that stand out
    among them, every text has the prior's score, BLIND_SCORE at most, and none is predicted toxic.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = docs.where(F.col("doc_id").isNotNull() & may_learn).select("doc_id", "text")
    of = own.select("doc_id").distinct().join(marked, "doc_id")
    total, ones = of.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(1e-3, (ones + 0.5) / (total + 1.0)))
    blind = min(prior, BLIND_SCORE)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(blind / (1 - blind))), prior)
    if not ones:
        return empty
    def pick(df: DataFrame, seed: int, most: int) -> DataFrame:
        """The ids with the smallest hashes; all but about twice ``most`` are left out before they are ordered."""
        part = min(1.0, 2.0 * most / max(1, df.count()))
        h = F.xxhash64("doc_id", F.lit(seed))
        return df.where(h <= F.lit(int(-2 ** 63 + part * (2 ** 64 - 1)) if part < 1 else 2 ** 63 - 1)).orderBy(h, "doc_id").limit(most).select("doc_id")

    ids = pick(of.where("toxic = 1"), 1, MAX_POSITIVES).withColumn("side", F.lit(1)).union(pick(own.select("doc_id").distinct(), 2, MAX_UNLABELLED).withColumn("side", F.lit(0)))
    # at most MAX_POSITIVES + MAX_UNLABELLED ids: small enough for every executor
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            keys = families(b.column("text"))
            yield pa.record_batch([b.column("side"), b.column("doc_id"), b.column("text"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), FAMILY_KEYS).cast(pa.list_(pa.int64()))], ["side", "doc_id", "text", "keys"])

    drawn = staged(own.join(F.broadcast(ids), "doc_id").select("side", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        keyed, "side int, doc_id long, text string, keys array<long>"))
    # copies and near copies teach once: a group of them must not make its own words look toxic
    key = drawn.select("side", "doc_id", F.posexplode("keys").alias("k", "key"))
    firsts = key.groupBy("side", "k", "key").agg(F.min("doc_id").alias("doc_id")).groupBy("side", "doc_id").agg(F.count("*").alias("n")).where(F.col("n") == FAMILY_KEYS).select("side", "doc_id")
    sample = staged(drawn.join(F.broadcast(firsts), ["side", "doc_id"], "left_semi").drop("keys"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            side = b.column("side").to_numpy(zero_copy_only=False)
            row, h, _, strong = evidence(b.column("text"))
            row, h = row[strong], h[strong]
            u, inv = np.unique(h, return_inverse=True)
            pos = per_row(inv, len(u), side[row] == 1).astype(np.int64)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(pos), pa.array(per_row(inv, len(u)) - pos)], ["word", "pos", "unl"])

    n_pos, n_unl = sample.agg(F.count(F.when(F.col("side") == 1, 1)), F.count(F.when(F.col("side") == 0, 1))).first()
    counts = sample.mapInArrow(words, "word long, pos long, unl long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    counts = staged(counts)
    candidates = counts.count()
    xlog = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    p, u = F.col("pos").cast("double"), F.col("unl").cast("double")
    rate = (p + u) / (n_pos + n_unl)
    ratio = 2 * (xlog(p, n_pos * rate) + xlog(u, n_unl * rate) + xlog(n_pos - p, n_pos * (1 - rate)) + xlog(n_unl - u, n_unl * (1 - rate)))
    chosen = counts.where((p >= MIN_POSITIVES) & (prior * p * n_unl >= MIN_PRECISION * u * n_pos) & (rate < 1)).withColumn("ratio", ratio).where(F.col("ratio") >= 2 * float(np.log(max(2, candidates)))).orderBy(F.desc("ratio"), "word").limit(MAX_FEATURES)
    top = chosen.select("word", "pos", "unl").collect()                  # at most MAX_FEATURES
    if not top:
        return empty
    features = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    # features that only positives have are held by prior * (their share among positives) of the unlabelled texts: the
    # prior can't be above what the features that stand out most say
    sure = top[:SURE_FEATURES]
    prior = min(prior, sum(r["unl"] for r in sure) * n_pos / (sum(r["pos"] for r in sure) * n_unl))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            row, f, value = known(features, b.column("text"))
            order = np.argsort(row, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(per_row(row, b.num_rows))]).astype(np.int32))
            yield pa.record_batch([b.column("side"), b.column("doc_id"), *(pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (f.astype(np.int32), value))], ["side", "doc_id", "found", "share"])

    found = sample.mapInArrow(matches, "side int, doc_id long, found array<int>, share array<double>").collect()       # the bounded sample's feature numbers
    found.sort(key=lambda r: (r["side"], r["doc_id"], r["found"]))

    def part(side: int) -> Part:
        rows = [r for r in found if r["side"] == side]
        flat = lambda c: np.array([v for r in rows for v in r[c]])
        return np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows]), flat("found").astype(np.int64), flat("share").astype(float), len(rows)

    unlabelled = part(0)
    weights, bias = fit(part(1), unlabelled, len(features), prior)
    # no more of the unlabelled texts than the class prior says may reach the threshold
    f = bias + per_row(unlabelled[0], unlabelled[3], weights[unlabelled[1]] * unlabelled[2])
    bias += min(0.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.quantile(f, 1 - prior)))
    return Model(features, weights, bias, prior)


def classify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of every document, with score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts have no words and get the model's base score; repeated rows are scored alike; an empty table
    gives no rows; other columns are not read, and only the text is an input.
    """
    spark = docs.sparkSession
    at = spark.sparkContext.broadcast(model)            # at most MAX_FEATURES words
    kept = docs.select(*columns)
    own = "text" in columns and kept.schema["text"].dataType.simpleString() == "string"         # sent to Python once
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], *([] if own else [F.col("text").cast("string").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = at.value
        for batch in batches:
            if own:                     # scored on a copy without nulls; the column itself goes through as it is
                batch = batch.append_column("_text", batch.column(columns.index("text")))
            for b in chunks(iter([batch]), "_text"):
                score = m.score(*known(m.words, b.column("_text")), b.num_rows)
                yield pa.record_batch([*b.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields))
    return inner.mapInArrow(run, f"{types}, score double, predicted int").toDF(*columns, "score", "predicted")


def fold(seed: int = 4) -> Column:
    """Remainder of the CRC of doc_id's text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % seed


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: labels are learnt only from rows whose fold isn't 2 of 4."""
    model = train(docs, labels, fold() != 2)
    out = classify(docs, model)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")
