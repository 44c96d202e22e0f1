"""License scans: winnowed fingerprints pick candidates, banded alignment confirms.

Templates are word sequences. The hashes of their k-word grams, winnowed to the
least of every w in a row, form an inverted index; any run of k + w - 1 common
words shares a fingerprint with it. Fingerprints of a document that are in the
index propose a template and a diagonal; the words around it are aligned with the
template in a band, and matches that cover enough of it are reported with spans.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WordHash, lean, ngram_hashes, small_batches, utf8_column
from tessera.llm.decontam import FOLD

#: Notices as licensors word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash (the last of equals) of every w in a row; of all if there are fewer."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if len(hashes) <= w:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    best, place = hashes[: len(hashes) - w + 1].copy(), np.arange(len(hashes) - w + 1)
    for j in range(1, w):
        other = hashes[j : len(hashes) - w + 1 + j]
        less = other <= best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + j
    return np.unique(place)


def build(templates: list[tuple[str, str]], k: int, w: int) -> dict:
    hashes = WordHash()
    words = [hashes.of(text.encode().translate(FOLD).split()) for _, text in templates]
    posts = sorted((int(h), t, int(p)) for t, own in enumerate(words) for grams in [ngram_hashes(own, k)] for p in winnow(grams, w) for h in [grams[p]])
    return {"names": [n for n, _ in templates], "words": words, "keys": np.array([x[0] for x in posts], np.uint64), "template": [x[1] for x in posts], "place": [x[2] for x in posts]}


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Most (template place, word place) pairs in order, with word - template within band of the diagonal."""
    width = 2 * band + 1
    rows = np.zeros((len(template) + 1, width + 1), np.int32)  # cell j: word place = i + diagonal + j - band
    same = np.zeros((len(template), width), bool)
    for i in range(len(template)):
        low = i + diagonal - band
        a, b = max(0, low), min(len(words), low + width)
        if a < b:
            same[i, a - low : b - low] = words[a:b] == template[i]
    if not same.any():
        return []
    for i in range(len(template) - 1, -1, -1):
        below = rows[i + 1]
        best = np.where(same[i], below[:width] + 1, 0)
        best[1:] = np.maximum(best[1:], below[: width - 1])
        rows[i, :width] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(template) and 0 <= j < width:
        if same[i, j] and rows[i, j] == rows[i + 1, j] + 1:
            out.append((i, i + diagonal + j - band))
            i += 1
        elif rows[i, j] == rows[i, j + 1]:
            j += 1
        else:
            i, j = i + 1, j - 1
    return out


def chosen(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(template, first, last, matched) of those that don't overlap, in order; the first of found come first.

    found: sorted by (-matched, missing, template, first, last).
    """
    starts: list[int] = []
    out: list[tuple[int, int, int, int]] = []
    for less, _, t, a, b in found:
        at = bisect.bisect_left(starts, a)
        if (at == 0 or out[at - 1][2] < a) and (at == len(out) or b < out[at][1]):
            starts.insert(at, a)
            out.insert(at, (t, a, b, -less))
    return out


def matches(index: dict, words: np.ndarray, k: int, w: int, band: int, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, matched words) that don't overlap, the most covered words first."""
    grams = ngram_hashes(words, k)
    places = winnow(grams, w)
    own = grams[places]
    low, high = np.searchsorted(index["keys"], own, side="left"), np.searchsorted(index["keys"], own, side="right")
    tried: set[tuple[int, int]] = set()
    found = set()
    for at in np.flatnonzero(high > low).tolist():
        for post in range(low[at], high[at]):
            t, diagonal = index["template"][post], int(places[at]) - index["place"][post]
            size = len(index["words"][t])
            own_band = min(band, 2 + size // 4)
            if any((t, diagonal + x) in tried for x in range(-(own_band // 2), own_band // 2 + 1)):
                continue
            tried.add((t, diagonal))
            pairs = align(index["words"][t], words, diagonal, own_band)
            if len(pairs) >= coverage * size:
                found.add((-len(pairs), size - len(pairs), t, pairs[0][1], pairs[-1][1]))
    return chosen(sorted(found))


SCHEMA = "doc_id long, n_matches long, licenses string, spans string, found array<struct<license:string,start:long,end:long,matched:long,coverage:double>>"


def _scanner(index, k: int, w: int, band: int, coverage: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))

    @lean
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            every = []
            for at in range(batch.num_rows):
                raw = utf8_column(batch.column(1).slice(at, 1))[0] or b""
                words = hashes.of(raw.translate(FOLD).split())
                own = matches(index, words, k, w, band, coverage)
                spans = [m.span() for m in WORD.finditer(raw.decode())] if own else []
                every.append([{"license": index["names"][t], "start": spans[a][0], "end": spans[b][1], "matched": n, "coverage": n / len(index["words"][t])} for t, a, b, n in own])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in every], pa.int64()), pa.array([",".join(sorted({y["license"] for y in x})) for x in every], pa.string()),
                pa.array([",".join(f"{y['license']}:{y['start']}:{y['end']}" for y in x) for x in every], pa.string()), pa.array(every, kind),
            ], ["doc_id", "n_matches", "licenses", "spans", "found"])

    return run


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, k: int = 3, w: int = 3, band: int = 16, coverage: float = 0.85) -> DataFrame:
    """One row for each row of docs with the licenses that its text holds.

    A match covers `coverage` or more of the words of a template; start and end are
    code points of the text, end exclusive, from its first to its last matched word.
    Of overlapping matches that with the most words stays, then the fuller, then the
    first listed, then the first in the text. Words are ASCII digits and letters in lower
    case and other characters; punctuation does not count. Null and empty texts have no
    match, and without templates nothing has; an empty table gives an empty result. Repeated
    rows are scanned each. A text's words are in one task's memory, however long it is; time
    grows with its words and with the places where templates may lie. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    index = build(TEMPLATES if templates is None else templates, k, w)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(index, k, w, band, coverage), SCHEMA)
