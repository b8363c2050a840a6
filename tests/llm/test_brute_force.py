"""Operators that SQL can't express, against plain versions on small inputs."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reprise.llm import main_text, merge_dropout, near_dedup, packing, suffix_tree, toxicity
from reprise.llm.queries import ORACLES, QUERIES, bpe_files
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    status, _, _, _, detail = compare(spark, duck(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert status == "ok", detail


def weighted(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    sets, root = {i: weighted(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if min(len(a), len(b)) * 2 >= max(len(a), len(b)) * 0.5 and jaccard(a, b) >= 0.8 - 1e-12:
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_near_duplicate_classes(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_family_of_copies_with_stragglers(spark):
    """A base, copies at several distances, and texts that only the copies link: one family over several classes."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        words = [f"z{rng.randrange(10 ** 6)}" if rng.random() < rng.choice((0.01, 0.03, 0.05)) else w for w in base]
        rows.append((k, " ".join(words)))
    got = {r.id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_tiles_find_spanning_links():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(40) if rng.random() < 0.01 else k}" for k in range(60)) for _ in range(30)]
    row, slab = near_dedup.shingles(*near_dedup.word_values(pa.array(texts)), 30)
    side = np.array([k % 2 for k in range(30)])
    root = np.arange(30)
    links = near_dedup.spanning(np.bincount(row, minlength=30), row, slab, side, root, 0.8)
    want = {(i, j) for i in range(0, 30, 2) for j in range(1, 30, 2) if jaccard(weighted(texts[i]), weighted(texts[j])) >= 0.8}
    assert set(map(tuple, links)) <= want

    def parts(pairs):
        root = list(range(30))
        for _ in range(30):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert parts(links) == parts(want)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    base = [f"w{k % 90}" for k in range(400)]
    texts = [" ".join(base)] + [" ".join(w if rng.random() > rate else f"x{rng.randrange(99999)}" for w in base) for rate in (0.01, 0.03, 0.1) for _ in range(30)]
    row, slab = near_dedup.shingles(*near_dedup.word_values(pa.array(texts)), len(texts))
    sig = near_dedup.signatures(row, slab, len(texts), 144)
    assert (sig > 0).all()
    for g in range(3):
        part = range(1 + 30 * g, 31 + 30 * g)
        true = np.mean([jaccard(weighted(texts[0]), weighted(texts[k])) for k in part])
        assert abs(np.mean([(sig[0] == sig[k]).mean() for k in part]) - true) < 0.03


def test_base_scores_and_held_out_gain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tok = {r.doc_id: [*WORD.findall((r.text or "").translate(low)), "\n"] for r in df.collect()}
    c = collections.Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, total = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    rows = suffix_tree.score(df, suffix_tree.fold() != 0, suffix_tree.fold() == 0).collect()
    for r in rows:
        t = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10(c[w] + 0.1) for w in t) - len(t) * total, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    per = lambda k: sum(r[k] for r in out) / sum(r.n_tokens for r in out)
    assert per("score") > per("base_score") + 0.1


def plain_tree(rows, learns):
    """log10 gains of (id, text) over the add-0.1 base: all sequences counted from short to long, scored from the root down."""
    end, least = suffix_tree.END_TOKEN, suffix_tree.LEAST
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, (end, *WORD.findall((t or "").translate(low)), end)) for i, t in rows]
    train = [t for i, t in texts if learns(i)]
    one = collections.Counter(w for t in train for w in t[1:])
    total = sum(one.values()) + 0.1 * (len(one) + 1)
    p = {(): lambda w: (one[w] + 0.1) / total}                 # a context's distribution, of contexts that are kept
    grow, sizes = {(w,): n for w, n in one.items() if n >= least}, []
    while grow:
        k = len(next(iter(grow)))
        after = collections.defaultdict(collections.Counter)
        for t in train:
            for j in range(k, len(t)):
                if t[j - k:j] in grow:
                    after[t[j - k:j]][t[j]] += 1
        sizes.append(len(grow))
        kept = {}
        for s, count in after.items():
            suffix = next(p[s[j:]] for j in range(1, k + 1) if s[j:] in p)
            edges = {w: (c, suffix(w)) for w, c in count.items() if c >= least}
            n, rest = sum(count.values()), sum(c for c in count.values() if c < least)
            left = max(1 - sum(q for _, q in edges.values()), suffix_tree.MIN_REST)
            d = sum(c * math.log(c / n / q) for c, q in edges.values()) + (rest * math.log(rest / n / left) if rest else 0.0)
            if not edges or d < suffix_tree.MIN_DIVERGENCE * (len(edges) + 1):
                continue
            others = (rest + suffix_tree.SMOOTHING * left) / ((n + suffix_tree.SMOOTHING) * left)
            own = {w: (c + suffix_tree.SMOOTHING * q) / (n + suffix_tree.SMOOTHING) for w, (c, q) in edges.items()}
            kept[s] = lambda w, own=own, others=others, suffix=suffix: own[w] if w in own else others * suffix(w)
        grow = {(*s, w): n for s, count in after.items() for w, n in count.items() if n >= least and w != end and (*s, w)[1:] in kept}
        p |= kept
    out = []
    for _, t in texts:
        value = 0.0
        for j in range(1, len(t)):
            context = next((s for s in (t[i:j] for i in range(max(0, j - len(sizes)), j)) if s in p), ())
            value += math.log10(p[context](t[j])) - math.log10(p[()](t[j]))
        out.append(value)
    return out, sizes


@pytest.mark.parametrize("most", [suffix_tree.SENT, 40])
def test_tree_scores_equal_a_plain_tree(spark, monkeypatch, most):
    """Every word is a symbol of its own and contexts are as long as they diverge, whether nodes are sent or shuffled."""
    monkeypatch.setattr(suffix_tree, "STRETCH_BYTES", 20_000)
    monkeypatch.setattr(suffix_tree, "MERGED", 1_000)
    passage = "a passage of some words that stands in many texts"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(10_000 + k, f"Note {k} {passage}") for k in range(40)] + [(20_000, None), (20_001, ""), (20_002, "the " * 30), (20_002, "the " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, round(r.score - r.base_score, 6)) for r in suffix_tree.score(df, suffix_tree.fold() != 0, suffix_tree.fold() == 0, most).collect())
    gain, sizes = plain_tree(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    want = sorted((i, round(g, 6)) for (i, _), g in zip(rows, gain, strict=True))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([g for _, g in got], [g for _, g in want], atol=1e-4)
    assert len(sizes) > 3 and sizes[0] > 100 and max(g for i, g in got if i >= 10_000) > 10

def test_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    ones = rng.integers(0, 40, (7, 7)).astype(float)
    root = ones.sum(0) / ones.sum()
    one, kept = suffix_tree.smoothed(ones, np.broadcast_to(root, ones.shape))
    assert np.allclose(one.sum(1), 1) and kept.shape == (7,)
    same, none = suffix_tree.smoothed(np.outer(np.ones(7), root) * 50, np.broadcast_to(root, ones.shape))
    assert not none.any() and np.allclose(same, root)


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judge(d, lab).join(lab, "doc_id").where("held_out").collect()
    hit, miss, wrong = (sum(1 for r in rows if (r.toxic, r.predicted) == k) for k in ((1, 1), (1, 0), (0, 1)))
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.95


def test_risk_is_corrected_below_zero():
    f_pos, f_unl = np.full(5, 9.0), np.full(50, -9.0)
    up, down, risk = toxicity.risk_step(f_pos, f_unl, 0.4)
    assert risk >= 0 and (up > 0).all() and (down < 0).all()          # the step climbs the negative part


def test_pieces_match_the_library_and_decode():
    import public_tokenizers as files
    import sentencepiece

    path = files.path("piece_bpe_32k.model")
    pieces, sp = merge_dropout.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = ["Hello  world\n\tfoo  　x ﬁ Å", " lead", "trail ", "", "é😀z", "日本語のテキスト。" * 9, "x" * 300, "   ", "a\x00b"]
    texts += ["".join(rng.choice("abcdetion  \n.,éß日😀") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    ids, n = merge_dropout.encode_batch(pieces, pa.array(texts), np.zeros(len(texts), np.int64), 0.0, 1)
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n, strict=True):
        assert ids[e - k:e].tolist() == sp.encode(t)
    seen = set()
    for variant in range(4):
        ids, n = merge_dropout.encode_batch(pieces, pa.array([*texts, "a▁b"]), np.full(len(texts) + 1, variant), 0.3, 1)
        ends = np.cumsum(n)
        assert all(merge_dropout.decoded(pieces, ids[e - k:e].tolist()) == t for t, e, k in zip([*texts, "a▁b"], ends, n, strict=True))
        seen.add(tuple(ids.tolist()))
    assert len(seen) == 4
    key = np.uint64(77)
    for t in texts[:60]:
        for u in merge_dropout.units_of(pa.array([t]))[0].to_pylist():
            points = np.frombuffer(u.encode("utf-32-le"), "<u4").astype(np.int64)
            _, start, piece = merge_dropout.together(pieces, points, np.array([len(points)]), np.array([key]), 0.3)
            assert sorted(zip(start.tolist(), piece.tolist(), strict=True)) == merge_dropout.agenda(pieces, points, key, 0.3)


def test_packing_ids_and_count(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_files()[0])
    rows = packing.pack(docs, bpe_files()).collect()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r.doc_id][r.piece] = r
    total = 0
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k in range(len(by[d.doc_id])):
            r = by[d.doc_id][k]
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    sequences = len({r.sequence_id for r in rows})
    assert sequences <= math.ceil(total / 2048) * 1.02 + 1


def test_plan_keeps_the_histogram():
    rng = np.random.default_rng(5)
    hist = np.zeros(2049, np.int64)
    for v in np.clip(rng.lognormal(6, 1.2, 5000).astype(int), 1, 2048):
        hist[v] += 1
    out = np.zeros(2049, np.int64)
    contents = packing.plan(hist)
    for content, n in contents:
        assert sum(a * k for a, k in content) <= 2048
        for a, k in content:
            out[a] += k * n
    assert (out == hist).all()
    assert sum(n for _, n in contents) <= sum(n for _, n in packing.best_fit(hist, 2048))


def test_articles_of_pages(spark):
    import html

    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert main_text.main_text(r.html) == want


def test_pages_without_article_mark():
    long = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr. " * 4
    page = (f'<html><body><header><h1>Site</h1></header><ul class="menu"><li><a href=/>Home</a><li><a href=/x>More</a></ul><div id="content"><h2>Title of the story</h2><p>{long}</p><p>Short.</p>'
            f'<p>{long}</p></div><div class="comments"><p>{long}</p></div><aside>{long}</aside><form><p>{long}</p></form><footer>&copy; x</footer></body></html>')
    assert main_text.main_text(page) == " ".join(f"Title of the story {long} Short. {long}".split())


def test_pages_with_misleading_wrappers():
    body = "<h1>T</h1><p>First.<p>Second &amp; last."
    for page in (f'<body class="has-sidebar"><div class="wrap with-sidebar"><article class="post">{body}</article></div><section class="related"><article>Other story</article></section>',
                 f'<div class="no-sidebar page"><main>{body}</main></div><article class="related-item">Other</article>',
                 f'<form action="/"><div>{body}</div></form>', f'<div class="cookie-free">{body}</div>',
                 f'<article>{body}<div class="share-buttons">Share</div><!-- x --><script>if (a<b) c("</p>")</script></article><article class="comment">No!</article><div id="comments">Bad</div>'):
        assert main_text.main_text(page) == "T First. Second & last.", page


def test_pipeline_stages_against_brute_force(spark):
    """Each stage keeps what a plain version keeps, on its own input; the last places every piece."""
    import corpus_pipeline

    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "near duplicates", "best-fit packing"]
    kept, before = d, {r.doc_id: r.text for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == d.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        assert after.items() <= before.items()
        if name == "near duplicates":
            classes = brute_classes(list(before.items()))
            assert set(after) == set(classes.values())
        elif name == "quality rules":
            verdict = {r["doc_id"]: r["kept"] for r in QUERIES["op7_line_frequency"](spark, FOLDER).collect()}
            assert all(len(WORD.findall(t or "")) >= 10 for t in after.values())
            assert sum(verdict[i] for i in before) >= len(after) * 0.98
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(before)
