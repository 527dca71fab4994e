"""Quality rules, licence scans, decontamination: against their SQL, and cases by hand."""

import pytest
from pyspark.sql import functions as F

from logweave.llm import decontamination as D
from logweave.llm import license_scans as L
from logweave.llm import quality_rules as Q
from logweave.llm import queries

from ..oracle import compare
from .conftest import frame


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name])


def test_quality_odd_rows(spark, odd):
    out = Q.quality(odd)
    assert out.count() == odd.count()
    assert {r["kept"] for r in out.where("doc_id < 5 or doc_id is null").collect()} == {False}
    assert Q.quality(odd.limit(0)).isEmpty()


def test_repeat_words(spark):
    texts = ["a b c d e f a b c d e", "a b c d e f g", "x " * 12, "a b c d e a b c d", "a b c d e f g h a b c d e f"]
    got = [r["n_repeat_words"] for r in Q.quality(frame(spark, texts)).orderBy("doc_id").collect()]

    def brute(t):
        w = t.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)})

    assert got == [brute(t) for t in texts]


def test_lines(spark):
    fine = "The quick brown fox jumps over the lazy dog near the old river bank."
    text = "\n".join([fine, "Home | About | News | Contact", fine.replace("fox", "cat"), "This site uses cookies to improve your stay."])
    r = Q.quality(frame(spark, [text])).first()
    assert r["cleaned"] == fine + "\n" + fine.replace("fox", "cat")


def test_licences(spark, odd):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    texts = [mit, "Text. Licensed under the Apache License, Version 2.0. More.", "No licence here.", "All rights reserved.\n// Released under the MIT License."]
    got = [r["licenses"] for r in L.licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["Apache-2.0"], [], ["MIT", "Proprietary"]]
    assert L.licenses(odd).count() == odd.count() and L.licenses(odd.limit(0)).isEmpty()


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Copyright (c) 2011, Some Org
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of Some Org nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{by} either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
NOTICES = {
    "MIT": MIT,
    "BSD-3-Clause": BSD,
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL.format(mark=":", by=",", version=3, name="General Public License"),
    "GPL-2.0-or-later": GPL.format(mark=";", by=";", version=2, name="General Public License"),
    "LGPL-2.1-or-later": GPL.format(mark=";", by=";", version=2.1, name="Lesser General Public License"),
    "AGPL-3.0-or-later": GPL.format(mark=":", by=",", version=3, name="Affero General Public License"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n",
}


@pytest.mark.parametrize("lead", ["", "// ", " * ", "# ", "-- "])
def test_wrapped_notices(spark, lead):
    """Notices as files have them: wrapped at 72 columns, behind comment leaders, code before and after."""
    import textwrap

    def wrap(t):
        lines = [x for p in t.split("\n\n") for x in (*(y for z in p.split("\n") for y in textwrap.wrap(z.strip(), 72, break_on_hyphens=False)), "")]
        return "import this\n\n" + "\n".join((lead + x).rstrip() for x in lines) + "\n\nint main;\n"

    texts = [wrap(t) for t in NOTICES.values()] + list(NOTICES.values())
    got = [r["licenses"] for r in L.licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[name] for name in NOTICES] * 2


ITEM = "If Alice buys 3 apples at 2 dollars each and Bob buys 5 pears then how much does Alice pay for the apples in all"


@pytest.mark.parametrize(
    "text,hit",
    [
        (ITEM, True),
        ("Some words before. " + ITEM.replace("Alice", "Carol").replace("3", "17").replace("Bob", "Dave") + " And after.", True),
        (ITEM.replace("Alice", "Carol", 1), True),  # all but one token are the item's
        (ITEM.replace("Alice", "Mary Ann").replace("Bob", "Jean Luc Roy").replace("3", "1,500 000"), True),  # names and numbers of other lengths
        (ITEM.replace(" and Bob", " and then later Bob"), True),  # two words put in
        ("If Carol buys 7 apples at 9 euros each and Dave sells 5 plums then nobody knows how much the shop of his friend makes", False),
        ("apples and pears are fruit that grows on trees in the garden behind the house", False),
        (None, False),
    ],
)
@pytest.mark.parametrize("broadcast", [0, 1000])
def test_templates(spark, text, hit, broadcast):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short item here")], "item_id long, text string")
    found = D.contaminated(frame(spark, [text]), items, broadcast_windows=broadcast).collect()
    assert bool(found) == hit


def test_items_of_names_and_numbers(spark):
    """Windows of mostly slots count where the tokens are the same, and only there."""
    item = "Barack Obama met Angela Merkel in Berlin on Monday"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["We read: " + item + ".", "We read: " + item.replace("Berlin", "Paris").replace("Obama", "Smith") + "."]
    assert [r["doc_id"] for r in D.contaminated(frame(spark, texts), items).collect()] == [0]


def test_same_on_both_branches(spark, odd):
    """Null and repeated ids, each judged by its own text, whether the benchmark is broadcast or shuffled."""
    items = spark.createDataFrame([(1, ITEM), (None, "short item here")], "item_id long, text string")
    rows = [(None, ITEM), (None, "clean"), (5, ITEM), (5, "clean"), (5, ITEM), (6, "a short item here too"), (7, None)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [sorted(map(repr, D.contaminated(docs, items, broadcast_windows=n).collect())) for n in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) == 3
    left = [sorted(map(repr, D.without_items(docs, items, broadcast_windows=n).collect())) for n in (0, 1000)]
    assert left[0] == left[1] and len(left[0]) == odd.count() + 3


def test_short_items_and_odd_rows(spark, odd):
    items = spark.createDataFrame([(7, "three plain words"), (7, "three plain words")], "item_id long, text string")
    found = D.contaminated(frame(spark, ["here are three plain words.", "three words plain"]), items).collect()
    assert [(r["doc_id"], r["items"]) for r in found] == [(0, [7])]
    assert D.without_items(odd, items).count() == odd.count()
    assert D.without_items(odd, items.limit(0)).count() == odd.count()
    same = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert D.without_items(odd, same).where(F.col("text").startswith("one")).isEmpty()
