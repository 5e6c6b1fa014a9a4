"""License scans: texts against licence templates by Dice over word bigrams.

A unit of text (each line and the whole document) is normalised to lower-case
words and turned into its set of word bigrams. Dice = 2 |A & B| / (|A| + |B|)
cannot reach t unless |A| lies in [|B| t / (2 - t), |B| (2 - t) / t], so a unit's
size picks the templates that it is compared with, and most lines meet none.

Notices broken over lines or amid other words are sought in all windows of the
document's words. What a window on one line shows counts only for licences that
no unit shows: else the score is that of the line. A template is tried
only if the document holds |B| t / (2 - t) of its bigrams. A best window starts
and ends with bigrams of the template that it holds once, so a start is followed
to its bigram's next place at most: |B| times the document's length in all.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import byte_rows, real_id, texts

#: Wording of licences, where they are short, and of the notices and grants of others.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'),
    "BSD": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
    "BSD-2-Clause": ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',),
    "BSD-3-Clause": ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    "LGPL-2.1": ('This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',),
    "AGPL-3.0": ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',),
    "All-Rights-Reserved": ("All rights reserved.",),
}
THRESHOLD = 0.8
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def bigrams(text: bytes) -> frozenset[tuple[bytes, bytes]]:
    words = WORD.findall(text.lower())
    return frozenset(zip(words[:-1], words[1:], strict=True))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size, with the sizes of texts that may reach the threshold."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        self.threshold = threshold
        self.items = [(name, i, bigrams(x.encode())) for name, own in sorted(templates.items()) for i, x in enumerate(own)]
        # A little wider than they are, so that rounding loses no text that just reaches the threshold.
        self.bounds = [(len(g) * threshold / (2 - threshold) - 1e-9, len(g) * (2 - threshold) / threshold + 1e-9) for *_, g in self.items]
        self.least = min((low for low, _ in self.bounds), default=0)
        self.most = max((high for _, high in self.bounds), default=-1)
        self.vocabulary = {w for *_, g in self.items for pair in g for w in pair}
        #: Words of a text that shares enough with some template are mostly of templates.
        self.firsts = {pair for *_, g in self.items for pair in g}

    def windows(self, pairs: list[tuple[bytes, bytes]]) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first pair, last pair) of windows that reach the threshold, the best of those that overlap."""
        hits: dict[tuple[bytes, bytes], list[int]] = {}
        for i, pair in enumerate(pairs):
            if pair in self.firsts:
                hits.setdefault(pair, []).append(i)
        out = []
        for (name, _, own), (low, high) in zip(self.items, self.bounds, strict=True):
            held = own & hits.keys()
            if len(held) < low or not held:
                continue
            last = None
            for start, stop in sorted((a, b) for pair in held for a, b in zip(hits[pair], [*hits[pair][1:], len(pairs)], strict=True)):
                seen, shared, best = set(), 0, None
                for end in range(start, stop):
                    pair = pairs[end]
                    if pair in seen:
                        continue
                    seen.add(pair)
                    if len(seen) > high:
                        break
                    if pair in own:
                        shared += 1
                        d = 2 * shared / (len(seen) + len(own))
                        if d >= self.threshold and (best is None or d > best[1]):
                            best = (name, d, start, end)
                if best and last and best[2] <= last[3]:
                    last = min(last, best, key=lambda x: (-x[1], x[3] - x[2], x[2]))
                elif best:
                    out += [last] if last else []
                    last = best
            out += [last] if last else []
        return out

    def matches(self, grams: frozenset) -> list[tuple[str, float]]:
        n = len(grams)
        if not self.least <= n <= self.most or grams.isdisjoint(self.firsts):
            return []
        out = []
        for (name, _, own), (low, high) in zip(self.items, self.bounds, strict=True):
            if low <= n <= high and (d := dice(grams, own)) >= self.threshold:
                out.append((name, d))
        return out


def units(text: bytes, most_words: int, spans: tuple[int, ...]) -> list[tuple[int, int, bytes]]:
    """(first line, lines, text) of each line, of each run of so many lines that has template size, and of the whole."""
    lines = text.split(b"\n")
    out = [(i, 1, x) for i, x in enumerate(lines) if x]
    short = [len(x) <= 12 * most_words for x in lines]
    for size in spans:
        out += [(i, size, b" ".join(lines[i : i + size])) for i in range(len(lines) - size + 1) if all(short[i : i + size])]
    if len(lines) > 1:
        out.append((0, len(lines), text))
    return out


def embedded(text: bytes, known: Templates) -> dict[str, tuple[float, int, int]]:
    """(dice, lines, first line) of each licence's best window, of equal ones the longest.

    A window of which half is in a better one of another licence, or in one of twice
    its length, is a part of that notice, as the first sentence of GPL-3.0 is of
    GPL-2.0's wording.
    """
    lower = text.lower()
    words = WORD.findall(lower)
    found = known.windows(list(zip(words[:-1], words[1:], strict=True)))
    if not found:
        return {}
    at = [m.span() for m in WORD.finditer(lower)]
    out: dict[str, tuple[float, int, int]] = {}
    for name, d, a, b in sorted(found, key=lambda x: (-x[1], x[2] - x[3], x[2])):
        if name not in out and not any(n != name and (e > d or y - x + 1 >= 2 * (b - a + 1)) and 2 * (min(b, y) - max(a, x) + 1) >= b - a + 1 for n, e, x, y in found):
            first, last = at[a][0], at[b + 1][1]
            out[name] = (d, text.count(b"\n", first, last) + 1, text.count(b"\n", 0, first))
    return out


def _scan(threshold: float, templates: dict, spans: tuple[int, ...]):
    def run(batches):
        known = Templates(templates, threshold)
        longest = int(known.most) + 1
        for batch in batches:
            rows = []
            for text in byte_rows(batch.column("text")):
                best: dict[str, tuple[float, int, int]] = {}
                for first, n, unit in units(text, longest, spans):
                    words = WORD.findall(unit.lower())
                    if len(words) - 1 < known.least or known.vocabulary.isdisjoint(words):
                        continue
                    for name, d in known.matches(frozenset(zip(words[:-1], words[1:], strict=True))):
                        if name not in best or (-d, n, first) < (-best[name][0], best[name][1], best[name][2]):
                            best[name] = (d, n, first)
                for name, (d, n, first) in embedded(text, known).items():
                    if name not in best or n > 1 and (-d, n, first) < (-best[name][0], best[name][1], best[name][2]):
                        best[name] = (d, n, first)
                rows.append([{"license": k, "dice": d, "first_line": f, "lines": n} for k, (d, n, f) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))])
            kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("lines", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    return run


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None, spans: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, license, dice, first_line, lines, found), a row for each row of docs.

    found: the licences whose best unit or window of words reaches threshold,
    best first; license and the columns after it: the first of them, or null.
    spans: numbers of lines that are joined to units too. A window has the lines
    that its words stand on.

    Null and empty text: nothing found. Equal scores: by licence name, then the
    shorter and earlier unit. Null doc_id and repeated rows: a row each. Empty
    table: no rows. Other columns are ignored.
    """
    out = texts(docs).mapInArrow(_scan(threshold, templates or TEMPLATES, spans), "doc_id long, found array<struct<license string, dice double, first_line int, lines int>>")
    best = F.get("found", F.lit(0))
    return out.select(real_id("doc_id"), best["license"].alias("license"), best["dice"].alias("dice"), best["first_line"].alias("first_line"), best["lines"].alias("lines"), "found")


def op1(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "license", "dice", "first_line", "lines", F.size("found").cast("long").alias("n_licenses"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


SQL = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{name}', '{_quoted(x)}')" for name, own in sorted(TEMPLATES.items()) for x in own)}) AS t(license, body)),
tw AS (SELECT license, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM t),
tg AS (SELECT license, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS g FROM tw),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
u AS (SELECT doc_id, i AS first_line, 1 AS lines, line AS body FROM l UNION ALL
      SELECT doc_id, 0, len(string_split(text, chr(10))), text FROM documents WHERE contains(text, chr(10))),
uw AS (SELECT doc_id, first_line, lines, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM u),
ug AS (SELECT doc_id, first_line, lines, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS g FROM uw WHERE len(w) >= 2),
m AS (SELECT doc_id, license, first_line, lines, 2.0::DOUBLE * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice
      FROM ug JOIN tg ON len(ug.g) >= len(tg.g) * 0.8 / 1.2 AND len(ug.g) <= len(tg.g) * 1.2 / 0.8),
b AS (SELECT doc_id, license, dice, first_line, lines, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, lines, first_line) AS r, count(DISTINCT license) OVER (PARTITION BY doc_id) AS n FROM m WHERE dice >= 0.8)
SELECT d.doc_id, b.license, b.dice, b.first_line::INTEGER AS first_line, b.lines::INTEGER AS lines, coalesce(b.n, 0)::BIGINT AS n_licenses
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND b.r = 1
"""
