"""Thin queries over the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reprise.llm import fixity, licences, line_rules, main_text, merge_dropout, near_dedup, packing, phrases, suffix_tree, token_counts, topk, toxicity, whitening
from reprise.llm.common import ship, staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), fn(spark, sf_dir))[1]
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def bpe_files() -> tuple[str, str, str]:
    import public_tokenizers as files

    return files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN


@query("op4_exact_topk", """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS query_row, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


_OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT r, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT r, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w0),
base AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
win AS (SELECT r, unnest(generate_series(1, len(ws) - 4)) AS p, ws FROM w0 WHERE len(ws) >= 5),
win2 AS (SELECT r, p, list_slice(ws, p, p + 4) AS g FROM win),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win2) WHERE c > 1),
repw AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + 4)) AS q FROM rep) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, line, count(*) AS c FROM l0 WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]') GROUP BY r, line),
dup AS (SELECT r, sum(c - 1) AS n FROM l GROUP BY r),
n AS (SELECT r, trim(regexp_replace(lower(line), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS line, c FROM l),
n1 AS (SELECT r, line, sum(c) * len(string_split(line, ' ')) AS words FROM n GROUP BY r, line),
t AS (SELECT host, min(r) AS r FROM d GROUP BY host, text),
f AS (SELECT host, line, count(*) AS c, arg_min(r, (doc_id IS NULL, doc_id, r)) AS owner FROM t JOIN d USING (r, host) JOIN n1 USING (r) GROUP BY host, line),
f1 AS (SELECT f.* FROM f WHERE f.c > 50),
gone AS (SELECT d.r, sum(n1.words) AS n FROM d JOIN n1 USING (r) JOIN f1 ON f1.host = d.host AND f1.line = n1.line WHERE d.r <> f1.owner GROUP BY d.r),
o AS (SELECT d.doc_id, CAST(coalesce(b.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(b.word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN base b USING (r) LEFT JOIN dup USING (r) LEFT JOIN repw USING (r) LEFT JOIN gone USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3 * n_words)) AS kept FROM v"""


@query("op7_line_frequency", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("row_id")


@query("op7_line_removal")
def op7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines over the limits."""
    return line_rules.without_lines(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op10_pattern_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_files())


@query("op1_dart_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.row_classes(table(spark, sf_dir, "documents"))


@query("op6_positive_unlabelled_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_suffix_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), suffix_tree.fold() != 0, suffix_tree.fold() == 0)


@query("op2_licence_sentences", licences.sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


_OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(CAST(floor(page_id / 4096) AS BIGINT), -1) AS archive FROM pages),
r AS (SELECT *, CASE WHEN page_id % 97 = 13 THEN html || '~' ELSE html END AS other FROM p),
x AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM r),
y AS (SELECT archive, page_id, url, head || CAST(strlen(html) AS VARCHAR) || gap || html || gap AS a, head || CAST(strlen(other) AS VARCHAR) || gap || other || gap AS b FROM x),
z AS (SELECT archive, page_id, CAST(strlen(a) AS BIGINT) AS length, sha256(a) AS expected, CASE WHEN page_id % 211 = 5 THEN NULL ELSE sha256(b) END AS found,
  CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, sha256(a) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM y)
SELECT archive, "offset", page_id, length, CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS kind, expected, found FROM z WHERE expected IS DISTINCT FROM found"""


@query("op9_merkle_fixity", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which each 97th record has a byte too many and each 211th is lost."""
    longer = fixity.record(F.col("page_id"), F.col("url"), F.concat("html", F.lit("~")))
    other = F.when(F.col("page_id") % 97 == 13, F.sha2(longer, 256))
    own = fixity.manifest(table(spark, sf_dir, "pages"), other=other).select("archive", "offset", "page_id", "length", "digest", F.coalesce("other", "digest").alias("other"))
    own = staged(own)
    replica = own.where("page_id is null or page_id % 211 <> 5").select("archive", "offset", F.col("other").alias("digest"))
    bad = fixity.audit(own.select("archive", "offset", "digest"), replica)
    return bad.join(own.select("archive", "offset", "page_id", "length"), ["archive", "offset"]).select("archive", "offset", "page_id", "length", "kind", "expected", "found")


@query("op5_merge_dropout")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return merge_dropout.digest(table(spark, sf_dir, "documents"), files.path("piece_bpe_32k.model"))


@query("op11_multiplicity_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_rank_merge_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _, pattern = bpe_files()
    return token_counts.counts(table(spark, sf_dir, "documents"), path, pattern)


_OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0b\f\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, ws, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
sub AS (SELECT lang, m, a, ws, unnest(generate_series(1, k - m + 1)) AS i FROM c JOIN (SELECT unnest([2, 3, 4]) AS m) ON m < k),
cover AS (SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS most FROM sub GROUP BY ALL),
live AS (SELECT c.* FROM c LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
cut AS (SELECT lang, phrase, a, ws, k, unnest(generate_series(1, k - 1)) AS j FROM live),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cut JOIN total ON total.lang = cut.lang
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(list_slice(ws, 1, j), ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(list_slice(ws, j + 1, cut.k), ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM best)
SELECT * FROM ranked WHERE rank <= 2000"""


@query("op13_setm_collocations", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
