"""License scans with native functions only: MinHash bands over overlapping windows retrieve templates,
exact shingle containment verifies them.

A text becomes hashes of its word shingles. Templates are put into classes by their number of
shingles, rounded up to a power of two B; a text's windows for a class hold 2B shingles and start
every B, so each place where a template may stand lies whole in a window. Template and window then
have a Jaccard similarity of at least SIMILARITY (see `least_similarity`), and BANDS bands of one
MinHash value each miss such a pair with probability (1 - similarity)^BANDS, under one in a
thousand. Retrieved templates count if the window holds CONTAINMENT of their shingles.

Two steps skip work without skipping cases. A shingle of a template has at least one anchor word
(a hitting set of all shingles), so texts without anchors are not hashed; and a window that shares
no shingle with a template can't collide with it, so only windows that do get MinHash values.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, CONTAINMENT, BANDS = 5, 0.8, 32
# Fixed texts: license notices and terms as they are commonly printed.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "mit-line-licensed": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "lgpl-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_COMMON = frozenset("the a an of and or to in is are be by for on at it its as if that this with you your any all not no so do from but was will may can".split())
_MATCH = "array<struct<license:string,word:int,containment:double>>"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hash(words: list[str]) -> int:
    """What the SQL function xxhash64 gives for the words."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return _signed(seed)


def min_hash(shingles: frozenset[int], k: int) -> int:
    return min(_signed(xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", s), 42))) for s in shingles)


@functools.cache
def templates() -> tuple[tuple[str, int, frozenset[int]], ...]:
    """(name, words a shingle, shingles). A template of fewer than WORDS words is one shingle of all its words."""
    out = []
    for name, text in TEMPLATES.items():
        words = words_of(text)
        size = min(WORDS, len(words))
        out.append((name, size, frozenset(shingle_hash(words[k : k + size]) for k in range(len(words) - size + 1))))
    return tuple(out)


@functools.cache
def anchors() -> tuple[str, ...]:
    """Words of which every shingle of every template has at least one: rare ones first, greedily."""
    left = set()
    for text in TEMPLATES.values():
        words = words_of(text)
        size = min(WORDS, len(words))
        left |= {frozenset(words[k : k + size]) for k in range(len(words) - size + 1)}
    chosen = []
    while left:
        counts = Counter(w for s in left for w in s)
        best = max(counts, key=lambda w: (w not in _COMMON and len(w) > 2, counts[w], len(w), w))
        chosen.append(best)
        left = {s for s in left if best not in s}
    return tuple(chosen)


def base_of(shingles: int) -> int:
    return 1 << max(0, math.ceil(math.log2(shingles)))


def least_similarity(shingles: int, containment: float = CONTAINMENT) -> float:
    """Of a template and the window around a place that holds `containment` of it."""
    return containment * shingles / (2 * base_of(shingles) + (1 - containment) * shingles)


def _longs(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _matches(shingles: Column, chosen: list[tuple[str, int, frozenset[int]]], base: int, containment: float, bands: int) -> Column:
    """Matches of the templates of one class in an array of shingle hashes."""
    known = _longs(sorted(frozenset().union(*(s for _, _, s in chosen))))
    windows = F.transform(F.sequence(F.lit(0), F.size(shingles) - 1, F.lit(base)), lambda at: F.struct(at.alias("at"), F.slice(shingles, at + 1, 2 * base).alias("held")))
    near = F.filter(windows, lambda w: F.arrays_overlap(w["held"], known))
    numbers = F.array(*(F.lit(k) for k in range(bands)))
    hashed = F.transform(near, lambda w: F.struct(w["at"].alias("at"), w["held"].alias("held"), F.transform(numbers, lambda k: F.array_min(F.transform(w["held"], lambda x: F.xxhash64(x, k)))).alias("least")))
    table = F.array(*(F.struct(F.lit(name).alias("license"), _longs(min_hash(s, k) for k in range(bands)).alias("least"), _longs(sorted(s)).alias("shingles")) for name, _, s in chosen))

    def retrieved(w: Column) -> Column:
        hit = F.filter(table, lambda t: F.exists(F.zip_with(w["least"], t["least"], lambda a, b: a == b), lambda same: same))
        share = F.transform(hit, lambda t: F.struct(t["license"].alias("license"), w["at"].alias("word"), (F.size(F.array_intersect(t["shingles"], w["held"])) / F.size(t["shingles"])).alias("containment")))
        return F.filter(share, lambda m: m["containment"] >= containment)

    return F.flatten(F.transform(hashed, retrieved)).cast(_MATCH)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(id, licenses) for each row: licenses is array<struct<license,word,containment>> by name, each
    license once, with the first of its best windows (as the number of the window's first word).

    A null text counts as empty and has none; texts are scanned whole, whatever their length; words
    are runs of letters and digits in any case. Repeated rows stay; there is no shuffle.
    """
    lowered = F.lower(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    split = docs.select(docs[id_col].alias("id"), F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    gate = F.arrays_overlap("words", F.array(*(F.lit(w) for w in anchors())))
    empty, sizes = F.expr("cast(array() as array<bigint>)"), sorted({size for _, size, _ in templates()})

    def hashes(size: int) -> Column:
        last = F.size("words") - size
        made = F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(*(F.get("words", k + j) for j in range(size))))
        return F.when(gate & (last >= 0), made).otherwise(empty).alias(f"s{size}")

    hashed = split.select("id", *(hashes(size) for size in sizes))
    none, parts = F.expr(f"cast(array() as {_MATCH})"), []
    for size in sizes:
        mine = [t for t in templates() if t[1] == size]
        every = _longs(sorted(frozenset().union(*(s for _, _, s in mine))))
        each = [_matches(F.col(f"s{size}"), [t for t in mine if base_of(len(t[2])) == base], base, containment, bands) for base in sorted({base_of(len(t[2])) for t in mine})]
        parts.append(F.when((F.size(f"s{size}") > 0) & F.arrays_overlap(f"s{size}", every), F.concat(*each)).otherwise(none))
    # A generator of one row: what a caller filters by must not be pushed into these expressions, once for each use.
    found = hashed.select("id", F.explode(F.array(F.concat(*parts))).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))

    def best(name: Column) -> Column:
        top = F.array_max(F.transform(F.filter("found", lambda m: m["license"] == name), lambda m: F.struct(m["containment"].alias("containment"), (-m["word"]).alias("back"))))
        return F.struct(name.alias("license"), (-top["back"]).alias("word"), top["containment"].alias("containment"))

    return found.select("id", F.when(F.size("found") > 0, F.transform(names, best)).otherwise(none).alias("licenses"))
