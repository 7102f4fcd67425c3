"""License scans: lines, paragraphs and whole texts compared with licence templates by Dice over word bigrams."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import MULTIPLIER, _LOWER, buffers, mix, runs, span_hashes

#: The wording of licence notices and short licences (name, template).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole texts of the common licences, and notices of those that TEMPLATES lacks; license_texts holds the long ones.
FULL = (
    ("MIT", TEMPLATES[4][1] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", TEMPLATES[5][1] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _CLAUSES + _DISCLAIMER),
    ("BSD-3-Clause", _CLAUSES + _NAMES + _DISCLAIMER),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
) + tuple((p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt")))
THRESHOLD = 0.8
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BREAK[raw], [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, span_hashes(raw, starts, ends)


def _bigrams(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words[:-1] * MULTIPLIER + words[1:])


@lru_cache
def _templates(templates: tuple) -> tuple[list[tuple[str, frozenset, int]], np.ndarray, np.ndarray, list[list[int]]]:
    """Names, bigrams and numbers of words; all bigrams; which template has which; templates that have all of one's and more."""
    words = [_words(_LOWER[np.frombuffer(text.encode(), np.uint8)])[2] for _, text in templates]
    sets = [(name, frozenset(np.unique(_bigrams(w)).tolist()), len(w)) for (name, _), w in zip(templates, words, strict=True)]
    known = np.unique(np.array([x for _, s, _ in sets for x in s], np.uint64))
    member = np.zeros((len(sets), len(known)), bool)
    for k, (_, s, _) in enumerate(sets):
        member[k, np.searchsorted(known, np.array(list(s), np.uint64))] = True
    return sets, known, member, [[j for j, (other, b, _) in enumerate(sets) if other != name and s < b] for name, s, _ in sets]


def _windows(grams: np.ndarray, own: np.ndarray, doc: np.ndarray, n_grams: int, n_words: int, threshold: float):
    """(text, Dice, first and last word) of the best window of every text in which one reaches the threshold.

    own holds the places of a template's bigrams. A window starts and ends on one of them, as the best do, and has as many
    words as the Dice bound allows a text without repeats. Only starts are tried that have enough of them within that size.
    """
    need = max(1, int(np.ceil(n_grams * threshold / (2 - threshold) - 1e-9)))
    longest = int((n_words - 1) * (2 - threshold) / threshold + 1e-9)
    best: dict[int, tuple] = {}
    if len(own) < need:
        return best
    near = own[need - 1 :] - own[: len(own) - need + 1] < longest
    near &= doc[own[need - 1 :]] == doc[own[: len(own) - need + 1]]
    for i in np.flatnonzero(near).tolist():
        start = int(own[i])
        d = int(doc[start])
        if d in best and best[d][0] == 1:
            continue
        stop = int(np.searchsorted(own, start + longest))
        last = own[i:stop]
        last = last[doc[last] == d] - start
        fresh = np.zeros(int(last[-1]) + 1, np.int64)
        fresh[np.unique(grams[start : start + len(fresh)], return_index=True)[1]] = 1
        hit = np.zeros(len(fresh), np.int64)
        hit[last] = fresh[last]
        dice = 2 * np.cumsum(hit) / (np.cumsum(fresh) + n_grams)
        at = int(np.argmax(dice))
        if dice[at] >= threshold and (d not in best or dice[at] > best[d][0]):
            best[d] = float(dice[at]), start, start + at + 1
    return best


def scan(docs: DataFrame, templates: tuple = TEMPLATES + FULL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice and n_units of every row.

    Units of a text are its lines, its paragraphs (lines without words part them) and the whole; words are runs of letters and
    digits with A-Z lower-cased. Every template is compared with the units and with all windows of words, wherever they
    begin, of the sizes that the threshold allows. license is the template with the best Dice of all of these (ties: the first
    name), null where none reaches the threshold; a template that is part of another licence's counts only where that one
    does not reach it. n_units counts the different word sequences of the units that do, and is 1 where only a window does.
    Null and empty texts have no units. Rows are scanned one by one.
    """

    def work(batches):
        sets, known, member, owners = _templates(templates)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            names, dices, units = [None] * len(batch), [None] * len(batch), [0] * len(batch)
            for first, last in runs(at, 1 << 22):
                part = _LOWER[raw[at[first] : at[last]]]
                cut = at[first : last + 1] - at[first]
                starts, ends, words = _words(part)
                doc = np.searchsorted(cut, starts, side="right") - 1
                crossing = np.flatnonzero(np.isin(cut[1:-1], starts, invert=True) & (cut[1:-1] > 0) & (cut[1:-1] < len(part)))
                if len(crossing):  # a word that runs from one text into the next is cut there
                    edges = cut[1:-1][crossing]
                    inside = edges[(~_BREAK[part[edges]]) & (~_BREAK[part[edges - 1]])]
                    starts, ends = np.union1d(starts, inside), np.union1d(ends, inside)
                    words = span_hashes(part, starts, ends)
                    doc = np.searchsorted(cut, starts, side="right") - 1
                if len(words) < 2:
                    continue
                grams = _bigrams(words)
                where = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hit = known[where] == grams
                breaks = np.flatnonzero(part == 10)
                line = np.searchsorted(breaks, starts)
                prior = np.zeros(len(starts), np.int64)
                prior[1:] = line[1:] - line[:-1]
                filled = np.zeros(len(starts), bool)
                filled[1:] = prior[1:] > 1
                whole = np.zeros(len(starts), np.int64)
                hits = np.flatnonzero(hit & (doc[1:] == doc[:-1]))
                holds = member[:, where[hits]]
                seen: dict[int, set] = {}
                best: dict[int, dict[int, float]] = {}
                for kind in (line, np.cumsum(filled), whole):
                    change = (np.diff(kind, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
                    edge = np.flatnonzero(change)
                    stop = np.append(edge[1:], len(words))
                    unit = np.cumsum(change) - 1
                    inside = unit[hits] == unit[hits + 1]
                    sized: dict[int, frozenset] = {}
                    for k, (_, s, _) in enumerate(sets):
                        ids, n = np.unique(unit[hits[holds[k] & inside]], return_counts=True)
                        for u in ids[n >= len(s) * threshold / (2 - threshold) - 1e-9].tolist():
                            if u not in sized:
                                sized[u] = frozenset(np.unique(grams[edge[u] : stop[u] - 1]).tolist())
                            dice = 2 * len(sized[u] & s) / (len(sized[u]) + len(s))
                            if dice >= threshold:
                                d = int(doc[edge[u]])
                                seen.setdefault(d, set()).add(words[edge[u] : stop[u]].tobytes())
                                own = best.setdefault(d, {})
                                own[k] = max(own.get(k, 0.0), dice)
                for k, (_, s, n) in enumerate(sets):
                    for d, (dice, lo, hi) in _windows(grams, hits[holds[k]], doc, len(s), n, threshold).items():
                        seen.setdefault(d, {words[lo : hi + 1].tobytes()})
                        own = best.setdefault(d, {})
                        own[k] = max(own.get(k, 0.0), dice)
                for d, own in best.items():
                    negative, name = min((-dice, sets[k][0]) for k, dice in own.items() if not any(j in own for j in owners[k]))
                    names[first + d], dices[first + d], units[first + d] = name, -negative, len(seen[d])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(dices, pa.float64()), pa.array(units, pa.int64())], ["doc_id", "license", "dice", "n_units"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, license string, dice double, n_units long")
