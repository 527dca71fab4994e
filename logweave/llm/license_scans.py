"""License scans: known licence sentences give a document a sequence of identifiers, ordered rules read it.

DataFrame functions only, one row from scan to result. Sentences end at their marks and at blank lines, so wrapped lines
and comment leaders don't part them; what no known sentence is, is looked up line by line as well. Sentences are normalised
(lower case, letters and digits only) and looked up in a table of known ones; the identifiers found, in text order, are
matched against the rules, longest first, each match taking its identifiers out of the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: Identifier of each known sentence, by its normalised words. Sentences of public licence texts.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-obtain",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "licensed under the gnu lesser general public license version 2 1": "lgpl2-ref",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is dedicated to the public domain under cc0 1 0": "cc0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-header",
    "http www apache org licenses license 2 0": "apache2-url",
    "https www apache org licenses license 2 0": "apache2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-obtain",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-ref",
    "distributed under the boost software license version 1 0": "bsl1-ref",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "if not see http www gnu org licenses": "gnu-see",
    "if not see https www gnu org licenses": "gnu-see",
}
#: The notices of the GNU licences differ by name, version and what they call the work. Fixed values.
GNU = {"general public license": "gpl", "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl"}
for _name, _id in GNU.items():
    for _version in ("2", "2 1", "3"):
        _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name} as published by the free software foundation"
        for _start in ("", "this program is free software ", "this library is free software ", "this file is free software "):
            _key = _id + _version.replace(" ", "")
            SENTENCES[f"{_start}{_terms} either version {_version} of the license or at your option any later version"] = f"{_key}-terms"
            SENTENCES[f"{_start}{_terms} version {_version} of the license"] = f"{_key}-only"
            SENTENCES[f"{_start}{_terms} version {_version}"] = f"{_key}-only"
    SENTENCES[f"see the gnu {_name} for more details"] = "gnu-details"
    for _work in ("program", "library", "file"):
        SENTENCES[f"you should have received a copy of the gnu {_name} along with this {_work}"] = "gnu-copy"
        SENTENCES[f"this {_work} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "gnu-warranty"
#: Licences that the identifiers of the GNU notices stand for. Fixed values.
GNU_NAMES = (("GPL-2.0", "gpl2"), ("GPL-3.0", "gpl3"), ("LGPL-2.0", "lgpl2"), ("LGPL-2.1", "lgpl21"), ("LGPL-3.0", "lgpl3"), ("AGPL-3.0", "agpl3"))
#: Ordered rules: the licence and the identifiers that make it, one after the other. Longer ones come first.
RULES = (
    ("BSD-3-Clause", ("all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("Apache-2.0", ("apache2-header", "apache2-obtain", "apache2-url", "apache2-asis", "apache2-see")),
    ("BSD-3-Clause", ("all-rights", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    *((f"{name}-or-later", (f"{key}-terms", "gnu-warranty", "gnu-details", "gnu-copy", "gnu-see")) for name, key in GNU_NAMES),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("all-rights", "bsd-grant", "bsd-source", "bsd-binary")),
    *((f"{name}-or-later", (f"{key}-terms", "gnu-warranty", "gnu-details", "gnu-copy")) for name, key in GNU_NAMES),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-obtain")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    *((f"{name}-or-later", (f"{key}-terms", "gnu-warranty", "gnu-details")) for name, key in GNU_NAMES),
    *((f"{name}-only", (f"{key}-only", "gnu-warranty", "gnu-details")) for name, key in GNU_NAMES),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl2-ref", "mpl2-obtain")),
    ("Unlicense", ("unlicense", "unlicense-grant")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("Apache-2.0", ("apache2-header",)),
    *((f"{name}-or-later", (f"{key}-terms",)) for name, key in GNU_NAMES),
    *((f"{name}-only", (f"{key}-only",)) for name, key in GNU_NAMES),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("LGPL-2.1-only", ("lgpl2-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("BSL-1.0", ("bsl1-ref",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("all-rights",)),
)
#: What ends a sentence: a mark before white space, or a blank line, comment leaders and rules aside.
BREAK = r"[.!?:][^\p{L}\p{N}\s]*\s+|\n[^\p{L}\p{N}]*\n"
#: The clause on endorsement names the holder.
HOLDER, ANY = "^neither the name of .+ nor the names of", "neither the name of the copyright holder nor the names of"


def _marked(sequence: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in sequence)


def key(sentence: Column) -> Column:
    """The normalised sentence: its words in lower case."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), HOLDER, ANY)


def sentence_keys(text: Column, known: list[str]) -> Column:
    """The normalised sentences of a text, in order; one of several lines that isn't known is taken line by line."""

    def of(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n"), key)
        return let(key(sentence), lambda k: F.when(F.contains(sentence, F.lit("\n")) & ~k.isin(known), lines).otherwise(F.array(k)))

    return F.flatten(F.transform(F.split(text, BREAK), of))


def licenses(docs: DataFrame, text: str = "text", sentences: dict = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """``docs`` plus ``n_sentences``, ``sentence_ids`` (array, in text order) and ``licenses`` (array, in rule order).

    A null or empty text has one empty sentence and no licence. Repeated sentences count each time, a licence once; of
    rules of one length the first goes first. Repeated rows are read alike, texts of any length whole; an empty table gives
    no rows. Other columns pass through; those named as a result are replaced.
    """
    known = list(sentences)
    lookup = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    table_of_rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_marked(ids)).alias("seq")) for name, ids in rules])
    keys = sentence_keys(F.coalesce(F.col(text), F.lit("")), known)
    found = F.transform(F.filter(F.col("_keys"), lambda k: k.isin(known)), lambda k: lookup[k])
    start = F.struct(
        F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("left"),
        F.array().cast("array<string>").alias("names"),
    )
    read = F.aggregate(
        table_of_rules,
        start,
        lambda a, r: F.struct(
            F.replace(a["left"], r["seq"], F.lit("|")).alias("left"),
            F.when(F.contains(a["left"], r["seq"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"),
        ),
        lambda a: F.array_distinct(a["names"]),
    )
    out = docs.withColumn("_keys", keys).withColumns({"n_sentences": F.size("_keys").cast("long"), "sentence_ids": found})
    none = F.array().cast("array<string>")
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, read).otherwise(none)).drop("_keys")


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_sentences",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    steps, last = [], "marked"
    for i, (_, ids) in enumerate(RULES):
        seq = _marked(ids)
        steps.append(f"r{i} as (select *, contains(m{i}, '{seq}') as f{i}, replace(m{i}, '{seq}', '|') as m{i + 1} from {last})")
        last = f"r{i}"
    hits = ", ".join(f"case when f{i} then '{name}' end" for i, (name, _) in enumerate(RULES))
    norm = lambda x: f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '{HOLDER}', '{ANY}')"
    # names in rule order, each once: list_distinct keeps no order, so the first place of each decides
    return f"""
with known(k, id) as (values {pairs}),
s as (select doc_id, regexp_split_to_array(coalesce(text, ''), '{BREAK}') as parts from documents),
u as (select doc_id, unnest(parts) as p, unnest(range(len(parts))) as i from s),
v as (select doc_id, i, case when contains(p, chr(10)) and {norm("p")} not in (select k from known) then string_split(p, chr(10)) else [p] end as ls from u),
n as (select doc_id, sum(len(ls))::bigint as n_sentences from v group by doc_id),
e as (select doc_id, i, unnest(ls) as l, unnest(range(len(ls))) as j from v),
f as (select doc_id, i, j, id from e join known on {norm("l")} = k),
g as (select doc_id, string_agg(id, ',' order by i, j) as sentence_ids, string_agg('<' || id || '>', '' order by i, j) as m from f group by doc_id),
marked as (select n.doc_id, n_sentences, coalesce(sentence_ids, '') as sentence_ids, coalesce(m, '') as m0
           from n left join g using (doc_id)),
{", ".join(steps)},
names as (select doc_id, n_sentences, sentence_ids, list_filter([{hits}], lambda x: x is not null) as h from {last})
select doc_id, n_sentences, sentence_ids,
       array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ',') as licenses from names
"""


ORACLE = _sql()
