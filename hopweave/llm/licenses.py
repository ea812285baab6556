"""License scans by matching texts against templates with optional and replaceable regions.

A template is license wording with <<beginOptional>> ... <<endOptional>> around what may be missing and <<var;max=N>> for up to
N words of anyone's choice. It is compiled into an automaton over words whose states are bits of one integer: a step moves the
states that the next word satisfies and adds what optional regions let it skip. A text matches where, from some word on, the
automaton reaches its end: mandatory wording must stand word for word. Templates begin with three mandatory words; only places
where those stand are tried, so a text without license wording costs one vectorised pass.

Base phrases are templates without regions and label a text by themselves. score: 1 for a whole license text, conditions and
disclaimer included, 0.95 for a license's whole standard notice, 0.9 for a short notice, 0.8 for a base phrase alone, 0.5 for the
opening of a license text alone, which altered terms may follow, 0 for none. In whole texts only names can be replaced.

What tells two licenses apart (Affero, Lesser, ShareAlike, NoDerivatives, a version) is never in an optional or replaceable region.
A base phrase keeps its label also where a longer name stands: "CC BY-NC-ND 4.0" has the base phrase of cc-by-nc and gets both.

Cases: null and empty texts have no words, no labels and score 0; other columns are ignored; rows that repeat are scanned each, and
rows of one id and different texts are told apart; equal labels of several matches are named once; an empty table gives no rows;
very long texts are scanned whole, one at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import IN_ALNUM, hash_word, load, lowered, mix, pieces, small_batches, spans, word_hashes

#: Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Parts of the BSD licenses: the first two conditions, the third, the disclaimer.
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "<<beginOptional>>3.<<endOptional>> Neither the name of <<var;max=8>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY <<var;max=8>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Public license wording, as (label, score, template).
TEMPLATES = (
    ("mit", 1.0, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the Software)<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", 1.0, "Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software <<beginOptional>>and its documentation<<endOptional>> for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;max=8>> <<beginOptional>>DISCLAIMS<<endOptional>> <<beginOptional>>DISCLAIM<<endOptional>> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", 1.0, "This software is provided as-is, without any express or implied warranty. In no event will <<var;max=8>> be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."),
    ("bsl-1", 1.0, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("unlicense", 1.0, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-clause", 1.0, f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", 1.0, f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("mit", 0.5, "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=8>> and associated documentation files <<beginOptional>>(the Software)<<endOptional>>, to deal in <<var;max=8>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of <<var;max=8>>, and to permit persons to whom <<var;max=8>> furnished to do so, subject to the following conditions"),
    ("isc", 0.5, "Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software <<beginOptional>>and its documentation<<endOptional>> for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", 0.5, "Redistribution and use <<beginOptional>>of this software<<endOptional>> in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met"),
    ("bsl-1", 0.5, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 0.5, "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", 0.5, "This is free and unencumbered software released into the public domain"),
    ("apache-2", 0.9, "Licensed under the Apache License, Version 2.0"),
    ("apache-2", 0.95, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;max=10>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("mpl-2", 0.9, "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2", 0.9, "under the Mozilla Public License, Version 2.0"),
    ("mpl-2", 0.95, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;max=8>> MPL 2.0"),
    ("cc0-1", 0.9, "To the extent possible under law, <<var;max=16>> waived all copyright and related or neighboring rights to"),
    ("cc0-1", 0.9, "CC0 1.0 Universal"),
    ("mit", 0.9, "released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
)

#: The GNU licenses' names and versions, and their labels.
GNU = (("General", "2", "gpl-2"), ("General", "3", "gpl-3"), ("Lesser General", "2.1", "lgpl-2.1"), ("Lesser General", "3", "lgpl-3"), ("Library General", "2", "lgpl-2"), ("Affero General", "3", "agpl-3"))
GNU_NOTICES = tuple(
    (label, 0.9, f"{opening} GNU {name} Public License {by} version {version}")
    for name, version, label in GNU
    for opening in ("licensed under the", "under the terms of the")
    for by in ("<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>>",)
)

#: The names of the Creative Commons licenses' terms, and their versions.
CC_TERMS = {"nc": ("NonCommercial", "Non-Commercial"), "sa": ("ShareAlike", "Share-Alike"), "nd": ("NoDerivatives", "NoDerivs", "No-Derivatives")}
CC_LICENSES = ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def cc_notices() -> tuple[tuple[str, float, str], ...]:
    """Notices of each Creative Commons license by its spelled name or its short one. What follows the name, a version or the word
    License, is mandatory, so that no license's notice stands in another's."""
    out = []
    for terms in CC_LICENSES:
        label, ends = "-".join(["cc-by", *terms]), (*CC_VERSIONS, "License", "International License")
        for spelled in itertools.product(*(CC_TERMS[t] for t in terms)):
            name = " ".join(["Attribution", *spelled])
            out += [(label, 0.9, f"{opening} Creative Commons {name} {end}") for opening in ("under a", "under the") for end in ends]
            out += [(label, 0.9, f"{name} {v}" if terms else f"{name} {v} International") for v in CC_VERSIONS]
        short = " ".join(["CC BY", *(t.upper() for t in terms)])
        out += [(label, 0.9, f"{short} {v}") for v in CC_VERSIONS]
        out += [(label, 0.9, f"under {opening} {short} {end}") for opening in ("a", "the") for end in ("License", "licence")]
    return tuple(out)


TEMPLATES += GNU_NOTICES + cc_notices()

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LEAD = 3


def template_words(text: str) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Template:
    """The automaton of one template. State i waits for element i; the bit of the last state means a match."""

    def __init__(self, label: str, score: float, text: str):
        self.label, self.score = label, score
        steps: list[str | None] = []  # a word, or None for any word
        skips: list[tuple[int, int]] = []  # from a state to a later one without a word
        opened: list[int] = []
        for part in re.split(r"(<<.*?>>)", text):
            if part == "<<beginOptional>>":
                opened.append(len(steps))
            elif part == "<<endOptional>>":
                skips.append((opened.pop(), len(steps)))
            elif part.startswith("<<var"):
                a, n = len(steps), int(re.search(r"max=(\d+)", part)[1])
                steps += [None] * n
                skips += [(a + i, a + n) for i in range(n)]
            else:
                steps += template_words(part)
        first = min([a for a, _ in skips], default=len(steps))
        if opened or first < LEAD or None in steps[:LEAD]:
            raise ValueError(f"a template begins with {LEAD} mandatory words and closes its regions: {text[:60]}")
        self.lead = tuple(steps[:LEAD])
        self.end = 1 << len(steps)
        self.any = sum(1 << i for i, s in enumerate(steps) if s is None)
        self.on: dict[int, int] = {}
        for i, s in enumerate(steps):
            if s is not None:
                self.on[hash_word(s)] = self.on.get(hash_word(s), 0) | 1 << i
        self.skips = sorted(skips)

    def close(self, states: int) -> int:
        for a, b in self.skips:
            if states >> a & 1:
                states |= 1 << b
        return states

    def match(self, hashes: list[int]) -> int | None:
        """Words of the shortest match at the start of hashes, or None."""
        states = self.close(1)
        for n, h in enumerate(hashes, 1):
            states = self.close((states & (self.any | self.on.get(h, 0))) << 1)
            if states & self.end:
                return n
            if not states:
                return None
        return None

    @property
    def longest(self) -> int:
        return self.end.bit_length()


def lead_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of the LEAD words that begin at each word but the last ones."""
    out = np.zeros(max(0, len(h) - LEAD + 1), np.uint64)
    for k in range(LEAD):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - LEAD + 1 + k])
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (of templates: label, start, end in words)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [(label, np.array([hash_word(w) for w in phrase.split()], np.uint64)) for phrase, label in phrases]
        compiled = [Template(*t) for t in templates]
        leads: dict[int, list[Template]] = {}
        for t in compiled:
            leads.setdefault(int(lead_hashes(np.array([hash_word(w) for w in t.lead], np.uint64))[0]), []).append(t)
        starts_at = np.array(sorted(leads), np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for a, b, data, offs in pieces(batch, "text"):
                data = lowered(data)
                starts, ends, row = spans(data, offs, IN_ALNUM)
                h = word_hashes(data, starts, ends)
                n_words = np.bincount(row, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(n_words)])
                places: dict[int, list[tuple[int, str]]] = {}
                for label, phrase in base:
                    n = len(phrase)
                    at = np.flatnonzero(h[: len(h) - n + 1] == phrase[0]) if len(h) >= n else np.zeros(0, np.int64)
                    for k in range(1, n):
                        at = at[h[at + k] == phrase[k]]
                    for i in at[row[at] == row[at + n - 1]].tolist() if len(at) else ():
                        places.setdefault(int(row[i]), []).append((i - int(first[row[i]]), label))
                found: dict[int, list[tuple[str, int, int, float]]] = {}
                tri = lead_hashes(h)
                for i in np.flatnonzero(np.isin(tri, starts_at)).tolist():
                    r = int(row[i])
                    for t in leads[int(tri[i])]:
                        n = t.match(h[i : min(i + t.longest, int(first[r + 1]))].tolist())
                        if n is not None:
                            at = i - int(first[r])
                            found.setdefault(r, []).append((t.label, at, at + n, t.score))
                for r in range(b - a):
                    p, m = places.get(r, ()), found.get(r, ())
                    own, all_ = sorted({x for _, x in p}), sorted({x for _, x in p} | {x[0] for x in m})
                    score = max([0.8] * bool(p) + [x[3] for x in m], default=0.0)
                    out.append((int(n_words[r]), len(p), min((x for x, _ in p), default=None), max((x for x, _ in p), default=None), ",".join(own), ",".join(all_), score, [{"label": x[0], "start": x[1], "end": x[2]} for x in m]))
            if out:
                columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(SCHEMA)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, start: long, end: long>>"
    return small_batches(docs).select("doc_id", "text").mapInArrow(scan, kinds)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents")).drop("matches")
