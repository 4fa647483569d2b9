"""Licence scans: normalised text against licence templates, by the Dice coefficient of word bigrams.

DataFrame functions only. A document's lines, its paragraphs and its whole text are compared, each as a set of
word bigrams: 2 * common / (own + template's). Since common is at most the smaller set, a template can
only reach ``least`` if its size is between least / (2 - least) and (2 - least) / least times the
text's; the other templates are not intersected, and texts that fit no template's size, or share no
bigram with any, stop there. All happens within a row: no join, no shuffle.

``scan_windows`` compares every window of words instead, wherever lines and paragraphs end.

Cases: null and empty texts, and texts of fewer than two words, match nothing; the same template in
several places counts once in ``licenses``; rows with the same doc_id are scanned each for itself; an
empty table gives no rows; further columns are passed on, and ``matches`` gets underscores where one has its
name; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, table

LEAST = 0.8

# Notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

# Whole licences, and standard file headers with all their paragraphs. The SQL of op5_licenses, and so that query, keeps to TEMPLATES.
WHOLE = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    "Apache-2.0 full header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0 full header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0 full header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1 full header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "LGPL-3.0 full header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0 full header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "CC0-1.0 header": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
}


def bigrams(text: Column) -> Column:
    """Set of word bigrams of the lower-cased text, words being runs of letters and digits; empty for fewer than two words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pair = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pair(w)).otherwise(F.array().cast("array<string>")))[0]


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        out[name] = list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:], strict=False)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``docs`` with ``matches``, last: array of (name, dice, unit) of every unit of text that reaches ``least``."""
    sets = template_bigrams(templates)
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in sets.items()])
    vocabulary = F.array(*map(F.lit, dict.fromkeys(x for b in sets.values() for x in b)))
    low, high = least / (2 - least), (2 - least) / least
    shortest, longest = min(map(len, sets.values())), max(map(len, sets.values()))

    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.array_distinct(F.concat(F.split(text, "\n"), paragraphs, F.array(text)))
    # a unit of too few characters cannot have enough bigrams
    units = F.filter(units, lambda u: F.length(u) >= int(low * shortest) * 2)
    sized = F.transform(units, lambda u: F.struct(u.alias("unit"), bigrams(u).alias("b")))
    fit = F.filter(sized, lambda s: (F.size(s["b"]) >= low * shortest) & (F.size(s["b"]) <= high * longest))
    near = F.filter(fit, lambda s: F.arrays_overlap(s["b"], vocabulary))

    def against(s: Column) -> Column:
        possible = F.filter(known, lambda t: (F.size(t["bigrams"]) >= low * F.size(s["b"])) & (F.size(t["bigrams"]) <= high * F.size(s["b"])))
        dice = lambda t: 2.0 * F.size(F.array_intersect(s["b"], t["bigrams"])) / (F.size(s["b"]) + F.size(t["bigrams"]))
        return F.filter(F.transform(possible, lambda t: F.struct(t["name"].alias("name"), dice(t).alias("dice"), s["unit"].alias("unit"))), lambda m: m["dice"] >= least)

    return docs.withColumn(free_name(docs, "matches"), F.flatten(F.transform(near, against)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def scan_windows(docs: DataFrame, templates: dict[str, str], least: float = LEAST) -> DataFrame:
    """``docs`` with ``matches``, last: array of (name, dice, unit), for each template the best window of words that reaches ``least``.

    Windows start and end at any word, with (2 - least) / least times the template's bigrams at most, repeats
    counted: no larger set can reach ``least``. One that does has least / (2 - least) of the template's bigrams,
    so a text without these is done; and the best ones start and end with a bigram of the template, so
    only those are compared, none left out. Of equal windows the first and shortest is returned.
    """
    sets = template_bigrams(templates)
    low, high = least / (2 - least), (2 - least) / least
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(math.ceil(low * len(b) - 1e-9)).alias("need"), F.lit(math.floor(high * len(b) + 1e-9)).alias("longest")) for n, b in sets.items()])
    vocabulary = F.array(*map(F.lit, dict.fromkeys(x for b in sets.values() for x in b)))
    fewest = min(math.ceil(low * len(b) - 1e-9) for b in sets.values())

    def best(t: Column, words: Column, grams: Column) -> Column:
        def of(places: Column) -> Column:
            at = lambda i: F.get(places, i)["at"]

            def window(a: Column, b: Column) -> Column:
                common = F.size(F.array_distinct(F.slice(places["gram"], a + 1, b - a + 1)))
                own = F.size(F.array_distinct(F.slice(grams, at(a) + 1, at(b) - at(a) + 1)))
                return F.struct((2.0 * common / (own + F.size(t["bigrams"]))).alias("dice"), (-at(a)).alias("start"), (at(a) - at(b)).alias("end"))

            fits = lambda a, b: at(b) - at(a) < t["longest"]
            starts = F.filter(F.sequence(F.lit(0), F.size(places) - t["need"]), lambda a: fits(a, a + t["need"] - 1))
            ends = lambda a: F.filter(F.sequence(a + t["need"] - 1, F.least(F.size(places), a + t["longest"]) - 1), lambda b: fits(a, b))
            return F.array_max(F.transform(starts, lambda a: F.array_max(F.transform(ends(a), lambda b: window(a, b)))))

        places = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda p: F.array_contains(t["bigrams"], p["gram"]))
        return _let(_let(places, of), lambda m: F.struct(t["name"].alias("name"), m["dice"].alias("dice"), F.array_join(F.slice(words, 1 - m["start"], 2 - m["end"]), " ").alias("unit")))

    def matches(words: Column) -> Column:
        def among(grams: Column, common: Column) -> Column:
            possible = F.filter(known, lambda t: F.size(F.array_intersect(common, t["bigrams"])) >= t["need"])
            return F.filter(F.transform(possible, lambda t: best(t, words, grams)), lambda m: m["dice"] >= least)

        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return _let(pairs, lambda grams: _let(F.array_intersect(grams, vocabulary), lambda common: F.when(F.size(common) >= fewest, among(grams, common))))

    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    none = F.array().cast("array<struct<name:string,dice:double,unit:string>>")
    return docs.withColumn(free_name(docs, "matches"), F.coalesce(_let(words, lambda w: F.when(F.size(w) > 1, matches(w))), none))


def op5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: the licences that some window of its words matches, whole texts among the templates."""
    found = scan_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), {**TEMPLATES, **WHOLE})
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.transform("matches", lambda m: m["name"])), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0)), 9).alias("best_dice"),
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
with template as (
  select name, {grams} as b from (select name, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from (values {rows}) t(name, body))
), d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), unit as (
  select distinct r, u from d, lateral (select unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: contains(p, chr(10))), [text])) as u)
), own as (
  select r, {grams} as b from (select r, list_filter(regexp_split_to_array(lower(u), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from unit) where len(w) > 1
), dice as (
  select r, name, 2.0::double * len(list_intersect(own.b, template.b)) / (len(own.b) + len(template.b)) as dice from own, template where list_has_any(own.b, template.b)
), best as (
  select r, count(*) as n_matches, string_agg(distinct name, ',' order by name) as licenses, max(dice) as best from dice where dice >= {LEAST} group by r
)
select doc_id, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licenses, '') as licenses, round(coalesce(best, 0), 9) as best_dice from d left join best using (r)
"""


SQL = _sql()
