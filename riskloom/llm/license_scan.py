"""Licence notices in texts by the Dice coefficient over word bigrams, in DataFrame operations only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public licence notices (identifier, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Whole licence texts.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Frequent words of English, the last to be chosen as marks.
COMMON = "a an and any are as at be by can for from in is it may not of on or that the this to under was with you".split(" ")
#: Bytes that part words: all of ASCII but letters and digits.
APART = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    bigrams: tuple[str, ...]

    def need(self, percent: int) -> int:
        """Bigrams that a passage has to share, whatever its own size."""
        return -(-len(self.bigrams) * percent // (200 - percent))

    def longest(self, percent: int) -> int:
        """Bigrams of the longest passage that can be like the template."""
        return len(self.bigrams) * (200 - percent) // percent


def templates(texts: list[tuple[str, str]] = TEMPLATES) -> list[Template]:
    out = []
    for number, (name, text) in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", low).strip(" ").split(" ")
        out.append(Template(number, name, tuple(sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))))
    return out


def marks(known: list[Template], percent: int) -> list[str]:
    """Words of which every passage that is like a template has at least one: of each template the longest words that aren't
    common, until more bigrams hold one than a passage may lack."""
    out: set[str] = set()
    for t in known:
        spare, left = len(t.bigrams) - t.need(percent), {b: b.split(" ") for b in t.bigrams}
        covered = sum(any(w in out for w in b) for b in left.values())
        for word in sorted({w for b in left.values() for w in b} - out, key=lambda w: (w in COMMON, -len(w), w)):
            if covered > spare:
                break
            out.add(word)
            covered = sum(any(w in out for w in b) for b in left.values())
    return sorted(out)


def _once(rows: DataFrame, value, name: str) -> DataFrame:
    """Adds a column that is computed once a row: what uses it later isn't merged with its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _words(text):
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(low, APART, " ")), " ")


def _table(known: list[Template], percent: int):
    row = lambda t: F.struct(F.lit(t.number).alias("template"), F.lit(t.license).alias("license"), F.lit(len(t.bigrams)).alias("size"), F.lit(t.need(percent)).alias("need"), F.lit(t.longest(percent)).alias("longest"), F.array(*[F.lit(b) for b in t.bigrams]).alias("bigrams"))
    return F.array(*[row(t) for t in known])


def scan_licenses(docs: DataFrame, known: list[Template] | None = None, percent: int = 80) -> DataFrame:
    """(doc_id, start, end, template, license, n_bigrams, n_common, dice, also): the passages of docs(doc_id, text) that are like a template.

    Texts are normalised to lower case (A-Z) and words of letters, digits and characters beyond ASCII, whatever the lines,
    so that wrapped notices and notices inside a longer line count like others. A passage runs over words start to end (end
    not included), begins and ends with a run of the template's word bigrams, and has at most as many bigrams as the size bound allows; n_bigrams
    are its distinct bigrams. A template fits with 2 * n_common / (n_bigrams + its own) of at least percent / 100. Of
    passages that overlap, of any template, the one with most common bigrams stays, then the greatest value, the first
    template, the first place; also names the other licences that fit passages overlapping it, sorted and comma-joined.

    Null, empty and one-word texts have no bigrams and give no rows; repeated rows give repeated results; further columns
    are ignored; a null doc_id is carried along; an empty table gives an empty result. No shuffle: each row is judged where
    it is read. Texts without one of a few long words, of which a passage can't lack all, are left at once.
    """
    known = templates() if known is None else known
    every = sorted({b for t in known for b in t.bigrams})
    low, found = _once(docs.where("text is not null").select("doc_id", "text"), F.lower("text"), "low"), marks(known, percent)
    short = "|".join(re.escape(w) for w in found if len(w) < 4)
    held = [F.contains("low", F.lit(w)) for w in found if len(w) >= 4] + ([F.col("low").rlike(rf"(?<![a-z0-9\x{{80}}-\x{{10FFFF}}])(?:{short})(?![a-z0-9\x{{80}}-\x{{10FFFF}}])")] if short else [])
    rows = low.where(reduce(or_, held)).drop("low")
    rows = _once(rows.select("doc_id", _words("text").alias("w")), F.col("w"), "words").where(F.size("words") > 1).drop("w")
    rows = _once(rows, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i))), "pairs").drop("words")
    rows = _once(rows, F.filter(F.transform("pairs", lambda b, i: F.when(b.isin(every), i)), lambda i: i.isNotNull()), "at")
    rows = _once(rows, F.array_distinct(F.transform("at", lambda i: F.get("pairs", i))), "hits")
    rows = _once(rows, F.filter(_table(known, percent), lambda t: F.size(F.array_intersect("hits", t["bigrams"])) >= t["need"]), "possible").where(F.size("possible") > 0)
    own = lambda t: F.struct(t.alias("t"), F.filter("at", lambda i: F.array_contains(t["bigrams"], F.get("pairs", i))).alias("at"))
    rows = _once(rows.select("doc_id", "pairs", "at", "possible"), F.transform("possible", own), "own").drop("at", "possible")

    def ends(o):
        at, need, longest = o["at"], o["t"]["need"], o["t"]["longest"]
        place = F.transform(at, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
        first = lambda p: ((p["k"] == 0) | (F.get(at, p["k"] - 1) < p["x"] - 1)) & (F.get(at, p["k"] + need - 1) - p["x"] < longest)
        last = lambda p: ((p["k"] == F.size(at) - 1) | (F.get(at, p["k"] + 1) > p["x"] + 1)) & (p["x"] - F.get(at, p["k"] - need + 1) < longest)
        return F.struct(o["t"].alias("t"), F.filter(place, first).alias("starts"), F.filter(place, last).alias("ends"))

    rows = _once(rows, F.transform("own", ends), "ends").drop("own")

    def passages(o):
        t = o["t"]
        fitting = lambda s: F.filter(o["ends"], lambda e: (e["k"] - s["k"] + 1 >= t["need"]) & (e["x"] - s["x"] < t["longest"]))
        inside = lambda s, e: F.array_distinct(F.slice("pairs", s["x"] + 1, e["x"] - s["x"] + 1))
        made = lambda s, e: F.struct(t["template"].alias("template"), t["license"].alias("license"), t["size"].alias("size"), s["x"].alias("start"), (e["x"] + 2).alias("end"), F.size(inside(s, e)).alias("n"), F.size(F.array_intersect(inside(s, e), t["bigrams"])).alias("common"))
        return F.flatten(F.transform(o["starts"], lambda s: F.transform(fitting(s), lambda e: made(s, e))))

    rows = _once(rows, F.flatten(F.transform("ends", passages)), "made").drop("ends", "pairs")
    fits = lambda v: (v["common"] * 200 >= (v["n"] + v["size"]) * percent) & (v["n"] * percent <= v["size"] * (200 - percent))
    rows = _once(rows, F.filter("made", fits), "fitting").drop("made").where(F.size("fitting") > 0)
    ranked = lambda v: F.struct((-v["common"]).alias("less"), (-(v["common"] * 2.0 / (v["n"] + v["size"]))).alias("value"), v["template"].alias("template"), v["start"].alias("start"), v["end"].alias("end"), v["license"].alias("license"), v["n"].alias("n"))
    rows = _once(rows, F.array_sort(F.transform("fitting", ranked)), "ranked").drop("fitting")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    none = F.expr("cast(array() as array<struct<less:int,value:double,template:int,start:int,end:int,license:string,n:int>>)")
    rows = _once(rows, F.aggregate("ranked", none, lambda a, v: F.when(F.exists(a, lambda x: meets(x, v)), a).otherwise(F.concat(a, F.array(v)))), "best")
    rows = rows.select("doc_id", "ranked", F.explode("best").alias("v"))
    also = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("ranked", lambda x: meets(x, F.col("v")) & (x["license"] != F.col("v")["license"])), lambda x: x["license"]))), ",")
    return rows.select("doc_id", "v.start", "v.end", "v.template", "v.license", F.col("v.n").alias("n_bigrams"), (-F.col("v.less")).alias("n_common"), F.round(-F.col("v.value"), 6).alias("dice"), also.alias("also"))


def _sql(percent: int = 80) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({t.number}, {quoted(t.license)}, {len(t.bigrams)}, {t.need(percent)}, {t.longest(percent)}, [{', '.join(map(quoted, t.bigrams))}])" for t in templates())
    return f"""
with t(template, license, size, need, longest, bigrams) as (values {values}),
w as (select row_number() over () as r, doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ') as w from documents where text is not null),
p as (select r, doc_id, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) as pairs from w where len(w) > 1),
known as (select template, license, size, need, longest, bigrams, unnest(bigrams) as b from t),
hit as (select r, template, x, row_number() over (partition by r, template order by x) as k, lag(x) over (partition by r, template order by x) as before, lead(x) over (partition by r, template order by x) as after
  from (select r, unnest(pairs) as b, generate_subscripts(pairs, 1) - 1 as x from p) join known using (b)),
s as (select r, template, x, k from hit where before is null or before < x - 1),
e as (select r, template, x, k from hit where after is null or after > x + 1),
c as (select s.r, doc_id, t.template, license, size, s.x as start_at, e.x + 2 as end_at, list_distinct(pairs[s.x + 1 : e.x + 1]) as own, bigrams
  from s join e on s.r = e.r and s.template = e.template and e.k - s.k >= -1 join t on t.template = s.template and e.k - s.k + 1 >= need and e.x - s.x < longest join p on p.r = s.r),
f as (select r, doc_id, template, license, size, start_at, end_at, len(own)::int as n, len(list_intersect(own, bigrams))::int as common from c),
g as (select r, doc_id, list({{'less': -common, 'value': -(common * 2.0::double / (n + size)), 'template': template, 's': start_at, 'e': end_at, 'license': license, 'n': n}}
  order by -common, -(common * 2.0::double / (n + size)), template, start_at, end_at) as ranked from f where common * 200 >= (n + size) * {percent} and n * {percent} <= size * {200 - percent} group by r, doc_id),
b as (select r, doc_id, ranked, list_reduce(list_transform(ranked, lambda v: [v]), lambda a, v: case when len(list_filter(a, lambda y: y.s < v[1].e and v[1].s < y.e)) > 0 then a else list_concat(a, v) end) as best from g),
u as (select doc_id, ranked, unnest(best) as v from b)
select doc_id, v.s::int as start, v.e::int as "end", v.template::int as template, v.license as license, v.n as n_bigrams, -v.less as n_common, round(-v.value, 6) as dice,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(ranked, lambda y: y.s < v.e and v.s < y.e and y.license <> v.license), lambda y: y.license))), ','), '') as also from u
"""


OP8_SQL = _sql()
