"""Licence recognition by sentences: normalised sentences are mapped to known identifiers, and sequences of identifiers
are matched against ordered rules. DataFrame functions only; every document is judged in its own row, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Normalised licence sentences (lower case, other characters than a-z and 0-9 as one space).
SENTENCES = [
    ("ApacheRef2", "licensed under the apache license version 2 0"),
    ("ApacheLic2", "licensed under the apache license version 2 0 the license"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitPermit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GplRef3", "this work is licensed under the gnu general public license version 3"),
    ("GplRef3", "licensed under the gnu general public license version 3"),
    ("GplRef2", "this work is licensed under the gnu general public license version 2"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplMore", "see the gnu general public license for more details"),
    ("BsdPermit", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CcByNc4", "licensed under cc by nc 4 0"),
    ("CcBy4", "licensed under cc by 4 0"),
    ("CcBySa4", "licensed under cc by sa 4 0"),
    ("CcZero1", "licensed under cc0 1 0"),
    ("AllRights", "all rights reserved"),
]
#: Ordered rules, longer sequences of a family first: each takes its identifiers out of the sequence.
RULES = [
    ("Apache-2.0", ("ApacheLic2", "ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheLic2", "ApacheComply")),
    ("BSD-3-Clause", ("BsdPermit", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdPermit", "BsdSource", "BsdBinary")),
    ("MIT", ("MitPermit", "MitNotice", "MitAsIs")),
    ("MIT", ("MitPermit", "MitNotice")),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplMore")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("Apache-2.0", ("ApacheRef2",)),
    ("Apache-2.0", ("ApacheLic2",)),
    ("MIT", ("MitRef",)),
    ("GPL-3.0-only", ("GplRef3",)),
    ("GPL-2.0-only", ("GplRef2",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("CcZero1",)),
]
#: Further sentences of the standard notices, as ``scan`` looks for them; names of programs and holders are left out.
_FREE = "free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = ("or at your option any later version", "or any later version", "or later")
_GNU = (("Gpl", "general public license"), ("Lgpl", "lesser general public license"), ("Agpl", "affero general public license"))
_VERSIONS = {"Gpl": ("2", "3"), "Lgpl": ("2.1", "3"), "Agpl": ("3",)}


def _gnu() -> list[tuple[str, str]]:
    """Grants of every GNU licence and version, with and without later versions."""
    out = []
    for family, title in _GNU:
        for version in _VERSIONS[family]:
            v, name = version.replace(".", " "), family + version.replace(".", "_")
            for number in (f"version {v}", f"version {v} of the license"):
                out += [(f"{name}Free", f"{_FREE.format(title)} {either}{number} {later}") for either in ("either ", "") for later in _LATER]
                out.append((f"{name}FreeOnly", f"{_FREE.format(title)} {number}"))
            out.append((f"{name}FreeOnly", _FREE.format(f"{title} version {v}")))
            for v in dict.fromkeys((v, v if " " in v else f"{v} 0")):
                out.append((f"{name}RefOnly", f"licensed under the gnu {title} version {v}"))
                out += [(f"{name}Ref", f"licensed under the gnu {title} version {v} {later}") for later in ("or later", "or any later version", "or at your option any later version")]
        out += [(f"{family}More", f"see the gnu {title} for more details"), (f"{family}Copy", f"you should have received a copy of the gnu {title} along with this program"),
                (f"{family}Copy", f"you should have received a copy of the gnu {title} along with this library")]
    return out


NOTICES = [
    *[x for x in _gnu() if x[1] not in dict((s, n) for n, s in SENTENCES)],
    ("GplHope", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("ApacheObtain", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("BsdSource", "redistributions of source code must retain the copyright notice this list of conditions and the following disclaimer"),
    ("BsdEndorse", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("MplSubject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplObtain", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("MplObtain", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("MplRef", "licensed under the mozilla public license version 2 0"),
    ("IscPermit", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("BoostRef", "distributed under the boost software license version 1 0"),
    ("UnlicenseRef", "this is free and unencumbered software released into the public domain"),
    *[(name, f"licensed under a creative commons {title} 4 0 international license") for name, title in
      (("CcBy4", "attribution"), ("CcBySa4", "attribution sharealike"), ("CcByNc4", "attribution noncommercial"))],
]
#: Rules over all identifiers: whole notices before their parts.
NOTICE_RULES = [
    ("MPL-2.0", ("MplSubject", "MplObtain")), ("MPL-2.0", ("MplSubject",)), ("MPL-2.0", ("MplRef",)), ("ISC", ("IscPermit",)), ("BSL-1.0", ("BoostRef",)), ("Unlicense", ("UnlicenseRef",)),
    ("BSD-3-Clause", ("BsdPermit", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")), ("BSD-2-Clause", ("BsdPermit", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("MIT", ("MitPermit", "MitNotice", "MitAsIs")),
    *[(f"{family.upper()}-{version if '.' in version else version + '.0'}-{form}", (f"{family}{version.replace('.', '_')}{kind}", *rest))
      for family in _VERSIONS for version in _VERSIONS[family] for form, kind in (("or-later", "Free"), ("only", "FreeOnly"))
      for rest in (("GplHope", f"{family}More", f"{family}Copy"), ("GplHope", f"{family}More"), ("GplHope",), ())],
    *[(f"{family.upper()}-{version if '.' in version else version + '.0'}-{form}", (f"{family}{version.replace('.', '_')}{kind}",))
      for family in _VERSIONS for version in _VERSIONS[family] for form, kind in (("or-later", "Ref"), ("only", "RefOnly"))],
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplMore", "GplCopy")),
]
#: Every known sentence holds one of these; texts without any are not searched.
ANCHORS = ("license", "software", "redistribution", "rights reserved", "mpl")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Normalised sentences. A sentence ends at a mark with white space after it, or at a line end unless the next line
    goes on in lower case."""
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\n[ \t*#/]*([a-z])", " $1")
    t = F.translate(F.regexp_replace(t, "([.!?:])[ \t\r]+", "$1\n"), UPPER, LOWER)
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", "\n")
    return F.filter(F.split(F.trim(t), "\n"), lambda s: s != "")


def phrases(text: Column) -> Column:
    """The text as one normalised line between spaces: wrapped lines, comment marks and list marks make no difference."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.regexp_replace(t, "[^a-z0-9]+", " "), F.lit(" "))


def found(line: Column) -> Column:
    """Known sentences in text order, the longest at each place, wherever they stand; not after "not" or "never"."""
    known = sorted({s for _, s in [*SENTENCES, *NOTICES]}, key=lambda s: (-len(s), s))
    pattern = f"(?<= )(?<! not )(?<! never )(?:{'|'.join(known)})(?= )"
    return F.when(reduce(lambda a, b: a | b, [line.contains(x) for x in ANCHORS]), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, n_unmatched of every document.

    ``sentence_ids``: known identifiers in text order, whatever the line breaks and whether a known sentence stands
    alone or inside a longer one; ``licences``: names of the rules that matched, sorted, joined by AND; NONE without a
    known sentence, UNKNOWN if no rule takes any; ``n_unmatched``: known sentences that no rule took. Null and empty
    texts have no sentence; repeated rows are judged alike; an empty table gives no rows; columns other than doc_id and
    text are not read.
    """
    known = F.create_map(*[F.lit(x) for s, name in {s: n for n, s in [*NOTICES, *SENTENCES]}.items() for x in (s, name)])
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size(sentences(F.col("text"))).cast("bigint").alias("n_sentences"), phrases(F.col("text")).alias("_line"))
    d = d.select("doc_id", "n_sentences", found(F.col("_line")).alias("_found"))
    d = d.select("doc_id", "n_sentences", F.transform("_found", lambda s: known[s]).alias("_ids"))
    marked = F.concat_ws("", F.transform("_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    taken = reduce(lambda c, r: F.replace(c, F.lit("".join(f"<{x}>" for x in r[1])), F.lit(f"[{r[0]}]")), [*NOTICE_RULES, *RULES], marked)
    d = d.select("*", taken.alias("_taken"))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("_taken", F.lit(r"\[([^\]]+)\]"), F.lit(1))))
    return d.select("doc_id", "n_sentences", F.concat_ws(" ", "_ids").alias("sentence_ids"),
                    F.when(F.size("_ids") == 0, "NONE").when(F.size(names) == 0, "UNKNOWN").otherwise(F.concat_ws(" AND ", names)).alias("licences"),
                    (F.length("_taken") - F.length(F.replace("_taken", F.lit("<"), F.lit("")))).cast("bigint").alias("n_unmatched"))


def sql() -> str:
    """The scan of one-sentence mentions in SQL, over SENTENCES and RULES alone: the same result where no notice is wrapped
    and no known sentence stands inside a longer one."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(s)}, {quoted(n)})" for n, s in SENTENCES)
    taken = "ids"
    for name, seq in RULES:
        taken = f"replace({taken}, {quoted(''.join(f'<{x}>' for x in seq))}, {quoted(f'[{name}]')})"
    return f"""
WITH known(s, name) AS (VALUES {table}),
t AS (SELECT row_number() OVER () AS r, doc_id, translate(regexp_replace(regexp_replace(coalesce(text, ''), '\\n[ \\t*#/]*([a-z])', ' \\1', 'g'), '([.!?:])[ \\t\\r]+', '\\1' || chr(10), 'g'), '{UPPER}', '{LOWER}') AS x FROM documents),
s AS (SELECT r, doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(x, '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' '), chr(10)), lambda y: y <> '') AS ss FROM t),
p AS (SELECT r, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM s),
k AS (SELECT r, string_agg('<' || name || '>', '' ORDER BY i) AS ids, string_agg(name, ' ' ORDER BY i) AS plain FROM p JOIN known USING (s) GROUP BY r),
m AS (SELECT r, plain, {taken} AS taken FROM k),
n AS (SELECT r, plain, taken, list_sort(list_distinct(regexp_extract_all(taken, '\\[([^\\]]+)\\]', 1))) AS names FROM m)
SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_sentences, coalesce(n.plain, '') AS sentence_ids,
  CASE WHEN n.plain IS NULL THEN 'NONE' WHEN len(n.names) = 0 THEN 'UNKNOWN' ELSE array_to_string(n.names, ' AND ') END AS licences,
  CAST(coalesce(length(n.taken) - length(replace(n.taken, '<', '')), 0) AS BIGINT) AS n_unmatched
FROM s LEFT JOIN n USING (r)"""
