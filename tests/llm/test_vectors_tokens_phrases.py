"""Whitening, token counts and phrases against plain versions, and their defined results on odd input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reprise.llm import phrases, token_counts, whitening
from reprise.llm.queries import bpe_files

FOLDER = "/root/testdata/sf0.001"
CLASHES = ["n", "h", "row", "x", "width", "weight", "word", "first", "last", "rank", "component", "copies"]


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def plain_whitening(x, components=32):
    n, s = len(x), x.sum(0)
    d = (n * x - s) / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return d @ u / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(1)


def test_whitening_equals_plain_fit(spark):
    """Repeated vectors weigh by their number; signs agree over all rows."""
    base = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    df = base.unionByName(base.where("vec_id % 7 = 3").select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding")).unionByName(base.where("vec_id = 5").crossJoin(spark.range(60)).select("vec_id", "embedding"))
    rows = sorted((r.vec_id, tuple(r.embedding)) for r in df.collect())
    x = np.floor(64 * np.array([e for _, e in rows])).astype(np.int64) + 1_000_000
    z, explained, deviation = plain_whitening(x)
    got = collections.defaultdict(list)
    for r in whitening.whiten(clashing(df)).collect():
        got[r.vec_id, r.component].append(r)
    ids = [i for i, _ in rows]
    assert sum(map(len, got.values())) == 32 * len(rows)
    sign = [np.sign(got[ids[0], k + 1][0].whitened * z[0, k]) for k in range(32)]
    for j, i in enumerate(ids):
        for k in range(32):
            for r in got[i, k + 1]:
                assert r.n == len(rows) and r.deviation == deviation[j] == r.deviation_exact
                assert abs(r.whitened - sign[k] * z[j, k]) < 1e-8 and abs(r.explained - explained[k]) < 1e-9 and r.identity_error < 1e-9


def test_whitening_weights_of_one(spark):
    df = spark.createDataFrame([(k, [float(k % 5), float((k * k) % 3)]) for k in range(40)], "vec_id long, embedding array<float>")
    x = np.array(sorted({(64 * (k % 5) + 1_000_000, 64 * ((k * k) % 3) + 1_000_000) for k in range(40)}))
    z, explained, _ = plain_whitening(x)
    rows = whitening.whiten(df, weights="one").collect()
    assert {r.n for r in rows} == {len(x)} and len(rows) == 80
    assert np.allclose(sorted({round(abs(r.whitened), 9) for r in rows if r.component == 1}), sorted({round(abs(v), 9) for v in z[:, 0]}))


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, []), (7, [5.0]), (8, [3e38, -3e38, 0.0]), (9, [0.0, 1.0, 0.0])]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    rows = whitening.whiten(df).collect()
    got = sorted(((r.vec_id or 0, r.component, r.n) for r in rows))
    assert got == sorted([(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (0, 1, 3), (0, 2, 3), (7, 1, 1), *[(i, k, 2) for i in (8, 9) for k in (1, 2, 3)]])
    assert {r.whitened for r in rows if r.vec_id == 7} == {None}                                  # no variance
    assert {round(abs(r.whitened), 9) for r in rows if r.vec_id == 1 and r.component == 1} == {round(0.5 ** 0.5, 9)}
    big = [r for r in rows if r.vec_id == 8][0]
    assert big.deviation is None and big.deviation_exact > 2 ** 63
    assert whitening.whiten(df.limit(0)).collect() == []


def odd_texts():
    random.seed(7)
    pick = lambda *r: chr(random.randrange(*random.choice(r)))
    return ["", " ", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>", " " * 5000, "\n\t \x0b\x1c\x85\xa0x", "aaaa" * 3000, "it's we'll THEY'RE 'd  x\r\n\r\n  y",
            "".join(pick((0x20, 0x2000), (0x4E00, 0x5E00), (0x10000, 0x1FFFF)) for _ in range(20_000)), "".join(random.choice("abcdefghij") for _ in range(30_000)), "word " * 300_000]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    path, _, pattern = bpe_files()
    library, model = Tokenizer.from_file(path), token_counts.Merges.load(path, pattern)
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    n, _ = token_counts.counts_of(model, texts)
    again, ids = token_counts.counts_of(model, texts, with_ids=True)
    assert n.tolist() == again.tolist() == [len(w) for w in want]
    assert [i.tolist() for i in ids] == want


def test_every_character_is_cut_as_the_library_cuts_it():
    from tokenizers import Tokenizer

    path, _, pattern = bpe_files()
    library, model = Tokenizer.from_file(path), token_counts.Merges.load(path, pattern)
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    n, _ = token_counts.counts_of(model, texts)
    assert n.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_rows(spark, monkeypatch):
    path, _, pattern = bpe_files()
    data = [(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "ü " * 2000)]
    df = clashing(spark.createDataFrame(data, "doc_id long, text string"))
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counts(df, path, pattern).collect())
    assert rows == [(0, 1, 1, False), (1, 7, 2, False), (1, 7, 2, False), (2, 0, 0, False), (3, 0, 0, False), (4, 6000, rows[-1][2], True)]
    assert token_counts.counts(df.limit(0), path, pattern).collect() == []
    assert {(r.doc_id, len(r.ids)) for r in token_counts.encode(df, path, pattern).collect()} == {(1, 2), (None, 1), (2, 0), (3, 0), (4, rows[-1][2])}
    model = token_counts.Merges.load(path, pattern)
    texts = odd_texts()
    want = token_counts.counts_of(model, texts)[0].tolist()
    monkeypatch.setattr(token_counts, "TOGETHER", 50)             # many passes, a table that overflows
    monkeypatch.setattr(token_counts, "KNOWN", 40)
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 1000)
    assert token_counts.counts_of(model, [t[:40_000] for t in texts])[0].tolist() == want[:-1] + [40_000 // 5 + 1]


def brute_phrases(rows, longest=5, least=100, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        wanted = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + k] for q, b in wanted.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= wanted[q[i:i + k]]}
        scored = []
        for p, a in wanted.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{"least": 6}, {"least": 3, "broadcast": 50, "top": 300}])
def test_phrases_equal_brute_force(spark, options, monkeypatch):
    """With a low ``broadcast`` the groups that are too many to send go by the shuffle."""
    monkeypatch.setattr(phrases, "ROW_BYTES", 4000)
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {k: v for k, v in options.items() if k != "broadcast"}
    assert mined(df.repartition(5), **options) == brute_phrases([(r.text, r.lang) for r in df.collect()], **want)


def test_phrases_of_odd_texts(spark):
    rows = [("A b\tc d, a B c d.\x0ba b c d e", "x"), ("a b c d" * 3, None), ("a b c d", "und"), (None, "x"), ("", None), (" .,; \n", "x"), ("Ä ä Ä ä " * 40, "x"), ("z " * 5000, "x"), ("a b c d", "x"), ("a b c d", "x"), ("q" * 100_000, "y")]
    df = clashing(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string"))
    for least in (1, 2, 3, 100):
        assert mined(df, least=least) == brute_phrases(rows, least=least)
    assert mined(df.limit(0)) == []


def test_phrases_that_share_a_code(spark, monkeypatch):
    """Short codes, so that many phrases share one: told apart by the second hash, or the run begins anew."""
    tries, real = [], phrases._mined
    monkeypatch.setattr(phrases, "_mined", lambda *a: (tries.append(a[-1]), real(*a))[1])
    random.seed(4)
    rows = [(" ".join(random.choice("abcdefghijklmnopqrst") for _ in range(60)), "x") for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    split = []
    counts = phrases._counts
    monkeypatch.setattr(phrases, "_counts", lambda *a: (lambda r: (split.append(r is not None and len(r[1].split)), r)[1])(counts(*a)))
    assert mined(df, least=3, code_bits=16) == brute_phrases(rows, least=3)
    assert any(split)


def test_scores_beyond_64_bits(spark):
    n, total, left, right = 3_000_000_000_017, 9_999_999_999_999_999, 3_000_000_000_019, 3_000_000_000_023
    df = spark.createDataFrame([(n, total, 2, [left, n], [right, n])], "a long, n long, k int, starts array<long>, ends array<long>")
    w = df.select(phrases.worst_cut(F.col("a"), F.col("k"), F.col("starts"), F.col("ends"), F.col("n")).alias("w")).first().w
    assert (w.score, w.l, w.r) == (1000 * n * total // (left * right), left, right)
