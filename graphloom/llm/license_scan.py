"""License scans (operator 9): MinHash bands over overlapping windows retrieve templates; exact containment verifies.

For a template of n words, windows of 1.25 n words start at every n / 4 words of a document, so that every stretch of
n words lies whole in one of them. A signature has 80 minima over 5-word shingles, in 40 bands of 2. A window that
holds a stretch with 0.75 of a template's shingles has a Jaccard similarity of 0.5 to the template at least, so one
band agrees with a probability of 1 - (1 - 0.25)**40 > 0.99999. Only windows with some template's shingle get a
signature: minima of others agree with none. The templates that the bands retrieve are verified by the share of their
distinct shingles that the best stretch of n words in the window holds.

Null and wordless texts match nothing. Documents with fewer words than a template are compared whole. Repeated rows
each give their own. Templates are a table of whole texts that a broadcast can hold (``MOST`` bytes; more raise).
Columns of the documents other than id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.arrays import mix, slices, trimmed, utf8
from graphloom.llm.windows import Items

THRESHOLD = 0.75
BANDS, ROWS = 40, 2
#: About so many bytes of templates are broadcast at once; a table of more is taken in blocks, each with a pass over the texts.
MOST = 64 << 20
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: Notices, the notes that licenses ask to put into files, and whole short licenses. Blanks stand for names and years.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def signature(shingles: np.ndarray) -> list[tuple[int, int, int]]:
    """(band, minimum, minimum) for each band."""
    low = mix(shingles[None, :] ^ SEEDS[:, None]).min(axis=1).reshape(BANDS, ROWS)
    return [(b, x, y) for b, (x, y) in enumerate(low.tolist())]


class Scanner:
    def __init__(self, ids: list, texts: list[str], threshold: float):
        self.items, self.threshold = Items(ids, texts), threshold
        self.bands: dict[tuple, list[int]] = defaultdict(list)
        for i, (keys, _) in enumerate(self.items.distinct):
            for band in signature(keys):
                self.bands[(int(self.items.k[i]), *band)].append(i)

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, template, containment, first word, words) of the best stretch of each row and template."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        lengths = sorted(set(zip(self.items.k.tolist(), self.items.n.tolist(), strict=True)))
        for row, k, size, shingles, hit, _ in self.items.hits(data, off):
            for n in (n for kk, n in lengths if kk == k):
                m = min(n, size)
                step = max(1, n // 4)
                # windows [g, g + m + step) with g a multiple of step; the last one reaches the end
                grid = np.arange(0, size - m + 1, step)
                to = np.minimum(grid + m + step - 1, size) - k + 1  # shingles of a window: grid..to
                grid, to = grid[np.searchsorted(hit, to) > np.searchsorted(hit, grid)], to[np.searchsorted(hit, to) > np.searchsorted(hit, grid)]
                for g, e in zip(grid.tolist(), to.tolist(), strict=True):
                    found = {i for band in signature(np.unique(shingles[g:e])) for i in self.bands.get((k, *band), ()) if self.items.n[i] == n}
                    for i in found:
                        keys = self.items.distinct[i][0]
                        for s in range(g, e - (m - k)):
                            share = len(np.intersect1d(keys, shingles[s : s + m - k + 1])) / len(keys)
                            if share >= self.threshold and (share, -s) > best.get((row, i), (0.0, 0, 0))[:2]:
                                best[row, i] = (share, -s, m)
        return [(row, i, share, -s, m) for (row, i), (share, s, m) in best.items()]


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and template that it contains: doc_id, license, containment, first_word, n_words. No shuffle.

    ``templates``: texts by name, or a table of (license, text).
    """
    templates = TEMPLATES if templates is None else templates
    found = None
    for block in template_blocks(templates):
        part = _scanned(docs, block, threshold, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return found


def template_blocks(templates: dict[str, str] | DataFrame) -> Iterator[dict[str, str]]:
    """The templates in blocks of about MOST bytes, at least one; of a table, a block at a time comes to the driver."""
    if not isinstance(templates, DataFrame):
        block, size = {}, 0
        for name in sorted(templates):
            n = len(templates[name].encode())
            if block and size + n > MOST:
                yield block
                block, size = {}, 0
            block[name], size = templates[name], size + n
        yield block
        return
    rows = templates.select("license", F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-2 * (rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // MOST))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("license"), F.lit(blocks)) == b)
        yield {r.license: r.text for r in part.orderBy("license", "text").collect()}


def _scanned(docs: DataFrame, templates: dict[str, str], threshold: float, id_col: str, text_col: str) -> DataFrame:
    ids, texts = list(templates), list(templates.values())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ids, texts, threshold)
        names = pa.array(scanner.items.ids, pa.string())
        for b in slices(batches, text_col):
            rows = sorted(scanner.scan(*utf8(b.column(1))))
            if rows:
                row, item, share, first, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(item)), pa.array(share), pa.array(first, pa.int64()), pa.array(n, pa.int64())], [id_col, "license", "containment", "first_word", "n_words"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), f"`{id_col}` {kind}, license string, containment double, first_word long, n_words long")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
