"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import Row, functions as F

from reprise.llm import fixity, licences, line_rules, main_text, merge_dropout, near_dedup, packing, suffix_tree, topk, toxicity
from reprise.llm.queries import bpe_files

LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
TEXTS = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (None, "a text without an id"), (6, "Ünï ▁ 日本 😀 <|endoftext|>\x0b!"), (None, None)]
#: Columns that operators make for themselves.
CLASHES = ["id", "rep", "bucket", "row_id", "word", "n", "tile", "side", "key", "score", "part", "length", "line", "host", "_text", "_id", "variant", "learn", "base"]


def documents(spark, rows=None):
    df = spark.createDataFrame([Row(doc_id=i, text=t, lang=None, source=None, n_chars=None) for i, t in (TEXTS if rows is None else rows)] or [],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def pieces_model():
    import public_tokenizers as files

    return files.path("piece_bpe_32k.model")


def labels(spark, rows=((1, 1), (5, 0), (None, 1), (3, None), (1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


ON_DOCUMENTS = {
    "near duplicates": lambda s, d: near_dedup.classes(d), "licences": lambda s, d: licences.scan(d), "suffix tree": lambda s, d: suffix_tree.score(d, suffix_tree.fold() != 0, suffix_tree.fold() == 0),
    "merge dropout": lambda s, d: merge_dropout.digest(d, pieces_model()), "toxicity": lambda s, d: toxicity.judge(d, labels(s)), "line rules": lambda s, d: line_rules.judge(d),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_one_row_a_document(spark, name):
    rows = ON_DOCUMENTS[name](spark, documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert len({r for r in rows if (r["doc_id"] if "doc_id" in r else r["id"]) == 5} if name != "line rules" else {1}) == 1      # repeated rows alike


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_documents(spark, name):
    assert ON_DOCUMENTS[name](spark, documents(spark, [])).collect() == []


def test_packing_places_everything(spark):
    rows = packing.pack(documents(spark), bpe_files()).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(documents(spark, []), bpe_files()).collect() == []


def test_near_duplicates_defined_results(spark):
    got = {r.id: r.class_id for r in near_dedup.classes(documents(spark)).collect() if r.id is not None}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    copies = [(k, "same words in each of these texts here") for k in range(40, 0, -1)] + [(99, "same  words in each\nof these texts here")]
    assert {r.class_id for r in near_dedup.classes(documents(spark, copies)).collect()} == {1}


def test_toxicity_without_positives_and_labels(spark):
    d = documents(spark)
    for lab in ([], [(1, 0)]):
        rows = toxicity.judge(d, labels(spark, lab)).collect()
        assert len(rows) == len(TEXTS) and {r.predicted for r in rows} == {0}
        assert all(0 <= r.score <= 1 for r in rows)


def test_suffix_tree_without_training(spark):
    rows = suffix_tree.score(documents(spark), F.lit(False), suffix_tree.fold() == 0).collect()
    assert {r.train_tokens for r in rows} == {0} and {r.base_score for r in rows} == {0.0}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (20, [0.25, -1.0]), (1, [0.25, -1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (40, [1.0]), (7, [2.0]), (60, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("tile", F.lit(1)).withColumn("score", F.lit(1))
    rows = topk.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20, 40, 60)}
    assert got == {0: [(1, -1024), (2, -1024), (2, -1024)], 20: [(1, 4352), (2, 4352), (2, 4352)], 40: [(7, 8192)], 60: []}
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    twins = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (0, [1.0, 0.5])], "vec_id long, embedding array<float>")
    rows = topk.search(twins, F.col("vec_id") == 0, k=20).collect()                  # each row of an id is a candidate and a query
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted([(0, 1, 1, 8192), (0, 2, 0, 4096), (0, 3, 1, 2048)] * 2)
    big = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.search(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2 ** 63 - 1), (2, -2 ** 63)]


def test_pages(spark):
    html = "<article><p>" + "long text here. " * 9000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", html), (1, "u", html), (2, None, None), (3, "x", ""), (None, "y", "<p>plain"), (4, "z", "<div")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = main_text.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, 16 * 9000 - 1), (1, 16 * 9000 - 1), (2, 0), (3, 0), (None, 5), (4, 0)]
    assert main_text.extract(df.limit(0)).collect() == []
    m = fixity.manifest(df)
    assert m.count() == 6
    assert fixity.audit(m, m).collect() == [] and fixity.audit(m.limit(0), m.limit(0)).collect() == []
    missing = fixity.audit(m, m.where("page_id <> 3 or page_id is null")).collect()
    assert [r.kind for r in missing] == ["missing"]
    found = fixity.audit(m, m.withColumn("digest", F.when(F.col("page_id") == 4, "bad").otherwise(F.col("digest")))).collect()
    assert [r.kind for r in found] == ["changed"]


def test_licence_sequences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software\nwithout restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = {r.doc_id: r for r in licences.scan(documents(spark, [(1, mit), (2, "Intro. Licensed under CC BY-NC 4.0. Also released under the MIT License!\nReleased under the MIT License."), (3, "All rights reserved."), (4, None)])).collect()}
    assert (rows[1].licences, rows[1].n_unmatched) == ("MIT", 0)
    assert rows[2].licences == "CC-BY-NC-4.0 AND MIT"
    assert (rows[3].licences, rows[3].n_unmatched, rows[4].licences) == ("UNKNOWN", 1, "NONE")


def test_words_are_split_alike():
    import pyarrow as pa

    from reprise.llm.common import words_of

    texts = [t or "" for _, t in TEXTS] + ["a\x0bb\x0cc\x1cd\x85e f\r\n g", " lead", "trail "]
    words, row = words_of(pa.array(texts))
    assert words.to_pylist() == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert row.tolist() == [i for i, t in enumerate(texts) for _ in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_classify_keeps_columns_and_nulls(spark):
    import numpy as np

    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -3.0, 0.1)
    rows = toxicity.classify(documents(spark), model, ("doc_id", "text", "lang")).collect()
    assert sorted([(r.doc_id or 0, r.text or "") for r in rows]) == sorted([(i or 0, t or "") for i, t in TEXTS])
    assert sum(r.text is None for r in rows) == 2 and {r.predicted for r in rows} == {0}


APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details.
#
# You should have received a copy of the GNU Lesser General Public
# License along with this library; if not, write to the Free Software
# Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
BSD = """Copyright (c) 2020, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
ENDORSE = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_wrapped_licence_notices(spark):
    """Verbatim notices as they stand in files: identifiers, and what no rule takes ("All rights reserved" of BSD)."""
    want = [(APACHE, "Apache-2.0", 0), (GPL3, "GPL-3.0-or-later", 0), (GPL2, "GPL-2.0-or-later", 0), (LGPL, "LGPL-2.1-or-later", 0), (LGPL.replace("# ", "// ").replace("version 2.1", "version 3"), "LGPL-3.0-or-later", 0),
            (MPL, "MPL-2.0", 0), (BSD.format(""), "BSD-2-Clause", 1), (BSD.format(ENDORSE.format("the copyright holder")), "BSD-3-Clause", 1), (BSD.format(ENDORSE.format("Example Ltd.")), "BSD-3-Clause", 1), (MIT, "MIT", 0),
            ("The tool is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only", 0),
            ("Old code\nlicensed under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later", 0), ("It is not released under the MIT License.", "NONE", 0),
            ("The page, licensed under\nCC BY-SA 4.0, was merged.", "CC-BY-SA-4.0", 0), (f"{APACHE}\n\n{MIT}", "Apache-2.0 AND MIT", 0)]
    rows = {r.doc_id: r for r in licences.scan(documents(spark, [(k, t) for k, (t, _, _) in enumerate(want)])).collect()}
    assert [(rows[k].licences, rows[k].n_unmatched) for k in range(len(want))] == [x[1:] for x in want]
    assert rows[0].sentence_ids == "ApacheLic2 ApacheComply ApacheObtain ApacheAsIs ApacheSee"


def hosts(spark, rows):
    return spark.createDataFrame([(i, t, None, h, None if t is None else len(t)) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")


def own(i):
    return " ".join(f"own{i}x{k}" for k in range(40))


def test_frequent_lines_leave_the_texts(spark):
    """60 documents of a host share a line: it stays in the first alone, all other lines as they were; null ids too."""
    import corpus_pipeline

    rows = [(i, f"{own(i)}\n\n  Share  THIS page\n{own(i + 1000)} end\n", "h") for i in range(60)] + [(None, f"share this page\r\n{own(99)}", "h"), (100, f"{own(100)}\nshare this page", "other"), (101, None, "h")]
    got = {(r.doc_id, r.text, r.n_removed_words) for r in line_rules.without_lines(hosts(spark, rows)).collect()}
    want = {(0, rows[0][1], 0), (100, rows[61][1], 0), (101, None, 0), (None, own(99), 3), *[(i, f"{own(i)}\n\n{own(i + 1000)} end\n", 3) for i in range(1, 60)]}
    assert got == want
    passed = corpus_pipeline.quality(spark, hosts(spark, rows), "").collect()
    assert {(r.doc_id, r.text) for r in passed} == {x[:2] for x in want if x[1] is not None}
    assert all(r.n_chars == len(r.text) for r in passed)


def test_line_limit_is_the_same_in_every_host(spark):
    """The same line in 60 documents of a 500-document host and of a hot one goes, in 20 of a 20-document host it stays;
    a line in 50 documents stays in each."""
    line = line_rules.hashed(line_rules.pa.array(["planted here", "rarer line"])).view("int64").tolist()
    held = spark.range(20_000).selectExpr("'hot' as host", "id").unionByName(spark.range(500).selectExpr("'mid' as host", "id")).unionByName(spark.range(20).selectExpr("'small' as host", "id"))
    m = held.selectExpr("host", "xxhash64(host, id) as row_id", "id as doc_id", "xxhash64(id) as text_key", f"filter(array(if(id < 60, {line[0]}L, null), if(id < 50, {line[1]}L, null)), x -> x is not null) as lines")
    first = {r.host: r.row_id for r in m.where("doc_id = 0").collect()}
    assert sorted((r.host, r.line, r.owner, r.documents) for r in line_rules.frequent_lines(m).collect()) == [("hot", line[0], first["hot"], 60), ("mid", line[0], first["mid"], 60)]


def test_rows_without_or_with_equal_ids_lose_lines_too(spark):
    """120 rows of no id, or of one id, share a line: it stays in one of them."""
    for i in (None, 7):
        rows = [(i, f"{own(k)}\nshare this page", "h") for k in range(120)]
        got = line_rules.without_lines(hosts(spark, rows)).collect()
        assert sorted(r.n_removed_words for r in got) == [0] + [3] * 119 and sum("share" in r.text for r in got) == 1


def test_rows_of_one_id_keep_their_own_links(spark):
    """Two texts under one id, a copy of each under others: both pairs are found, whatever the order of rows."""
    rows = [(1, own(1)), (1, own(2)), (2, own(1)), (3, own(2)), (None, own(3)), (9, own(3)), (None, own(4))]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(((r.doc_id, r.class_id) for r in near_dedup.row_classes(d).collect()), key=str)
        assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 9), (9, 9), (None, None)], key=str)


def test_short_texts_teach_apart():
    """Texts of fewer than five words share a family only with equal word sequences."""
    import pyarrow as pa

    keys = toxicity.families(pa.array(["vile word", "vile word", "other vile", "a b c d", "x", "", "a b c d e f", "vile  word"]))
    same = lambda i, j: (keys[i] == keys[j]).all()
    assert same(0, 1) and same(0, 7) and not any(same(i, j) for i, j in ((0, 2), (0, 3), (3, 4), (4, 5), (3, 6)))


def test_pipeline_filters_row_by_row(spark):
    """Clean rows without a doc_id or with an equal one stay, a rejected row of an equal doc_id goes, copies go once."""
    import corpus_pipeline

    rows = [(None, own(1), "h"), (None, own(2), "h"), (None, own(1), "h"), (7, own(3), "h"), (7, own(4), "h"), (7, "too short", "h"), (8, own(4), "h"), (9, own(1), "h"), (7, own(3), "h")]
    passed = corpus_pipeline.quality(spark, hosts(spark, rows), "")
    assert sorted((r.doc_id or 0, r.text) for r in passed.collect()) == sorted((i or 0, t) for i, t, _ in rows if t != "too short")
    kept = corpus_pipeline.distinct(spark, passed, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, own(2)), (7, own(3)), (7, own(4)), (9, own(1))])
