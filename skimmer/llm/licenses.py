"""License scans (operator 2): conditional compression against license templates.

Candidate blocks are the sentences, lines, paragraphs and stretches of text that hold a cue word of licensing. Each block is compressed
alone and with each template as zstandard raw dictionary; templates are ranked by the bytes that they save. In this order, what saves
enough of what its own wording would is confirmed by its exact wording: few words of the template may be worded differently, found by word alignment, none
that tells it from a similar template of another license, and no clause may be added or left out. Every place of a block that is so worded counts, and
the first template that is confirmed is the notice of its place.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.shared import Kept, slices, small_batches

#: Every template holds one of these, and so does every text that is looked at.
CUES = r"licen[sc]|copyright|permission|redistribut|warrant|public\s+domain|creative\s+commons|\bcc0\b|\bcc[ -]by|\bspdx|\b[al]?gpl|\bapache\b"
#: A template is looked at if it saves this share of what it saves of its own wording (names of some eight letters after a link save nothing, and are not found), and confirmed if so many of its words differ at most.
SHARE, DIFFERENCES = 0.4, 0.1
#: A notice that adds, or leaves out, so many words in one place has another clause, and is not the template's.
CLAUSE = 8
#: Templates up to this many words are sought in sentences and lines, too.
SHORT_WORDS = 16
#: Templates of two licenses are similar if so much of the longer one's words differ at most.
SIMILAR = 0.5
#: Bytes of blocks that a worker remembers.
CACHE_BYTES = 16 << 20
LEVEL = 3

# License identifiers with the names that notices give them.
NAMES = {
    "MIT": ["the MIT License", "the MIT license (MIT)"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "the Apache 2 license", "the Apache-2.0 license", "the Apache License v2"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL 2.0 license"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPLv2", "the GPL v2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPLv3", "the GPL v3"],
    "LGPL-2.0": ["the GNU Library General Public License, version 2", "the GNU Library General Public License v2.0", "LGPLv2.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPLv2.1", "the LGPL v2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPLv3", "the LGPL v3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPLv3", "the AGPL v3"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons Zero v1.0 Universal license"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
LEADS = ("licensed under", "released under", "available under", "distributed under", "under the terms of")
#: What links a name to the notice right before it.
LINKS = ("or", "and")
# Short names and identifiers as lists of licenses and fields of a project's description give them.
SHORT = {"MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "ISC": ["ISC"], "MPL-2.0": ["MPL-2.0"], "GPL-2.0": ["GPL-2.0", "GPLv2"], "GPL-3.0": ["GPL-3.0", "GPLv3"], "LGPL-2.1": ["LGPL-2.1", "LGPLv2.1"], "LGPL-3.0": ["LGPL-3.0", "LGPLv3"], "AGPL-3.0": ["AGPL-3.0", "AGPLv3"]}
# The wording of longer notices, of one paragraph.
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.0": "is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
# The wording of whole licenses, of several paragraphs.
FULL = {
    "MIT": f"{NOTICES['MIT']} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0": f"{NOTICES['MIT-0']} {_AS_IS}",
    "ISC": f"{NOTICES['ISC']} {_ISC_AS_IS}",
    "0BSD": f"{NOTICES['0BSD']} {_ISC_AS_IS}",
    "BSD-2-Clause": " ".join([*_BSD[:3], _BSD[4]]),
    "BSD-3-Clause": " ".join(_BSD),
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_CUE = re.compile(CUES, re.I)
_BREAK = re.compile(r"\n|(?<=[.!?;])\s+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_NEVER = re.compile(r"(?!)")
#: Each whole license and longer notice holds one of these.
_LONG_CUE = re.compile(r"hereby\s+granted|permission\s+is|permission\s+to\s+use|redistribut|warrant|free\s+software|public\s+license|apache\s+license|public\s+domain|boost\s+software|licensed\s+under", re.I)
_ARTICLES = frozenset(("the", "a", "an"))


def templates() -> list[tuple[str, str]]:
    """(license, wording): every name after every lead, identifiers, the longer notices, and whole licenses; names after a link count next to another notice only."""
    short = [(k, f"{lead} {name}") for k, names in NAMES.items() for name in names for lead in LEADS]
    fields = [(k, f"{lead} {name}") for k, names in SHORT.items() for name in names for lead in ("License:", *LINKS)]
    links = [(k, f"{link} {name}") for k, names in NAMES.items() for name in names for link in LINKS]
    ids = [(k, f"SPDX-License-Identifier: {k}") for k in NAMES]
    return list(dict.fromkeys([*short, *ids, *fields, *links, *NOTICES.items(), *FULL.items()]))


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text, which are what its wording is (lower case, without articles and signs), and where they are."""
    found = [(m[0].lower(), m.span()) for m in _WORD.finditer(text)]
    found = [x for x in found if x[0] not in _ARTICLES]
    return [x[0] for x in found], [x[1] for x in found]


def differences(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(n, begin, end): the stretch of the block's words that is worded most like the template, and how many words differ.

    Words that are missing, added or other count one each. Among equal stretches the first to end wins.
    """
    m, n = len(template), len(block)
    joined, own = f" {' '.join(block)} ", f" {' '.join(template)} "
    at = joined.find(own)
    if at >= 0:
        begin = joined.count(" ", 0, at)
        return 0, begin, begin + m
    number: dict[str, int] = {}
    t = np.array([number.setdefault(w, len(number)) for w in template])
    b = np.array([number.get(w, -1) for w in block])
    steps = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), steps.copy()
    for k in range(m):
        # of the three ways to a cell, the first two at once; then words that the block adds, by running minimum
        other, missing = np.concatenate([[k + 1], cost[:-1] + (b != t[k])]), cost + 1
        new = np.minimum(other, missing)
        first = np.where(other <= missing, np.concatenate([[0], start[:-1]]), start)
        key = (new - steps) * (n + 1) + np.arange(n + 1)[::-1]
        best = np.minimum.accumulate(key)
        source = n - best % (n + 1)
        cost, start = new[source] + steps - source, first[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def other_clauses(template: list[str], stretch: list[str]) -> tuple[int, str]:
    """(n words, the first): the clauses of CLAUSE words or more in one place that a stretch adds, or leaves out, which a minus says, by the longest runs that both share."""
    n, first = 0, ""
    if template == stretch or max(len(stretch), len(template)) < CLAUSE:
        return n, first
    for how, a, b, c, d in SequenceMatcher(None, template, stretch, autojunk=False).get_opcodes():
        if how != "equal" and abs((d - c) - (b - a)) >= CLAUSE:
            n += max(b - a, d - c)
            first = first or (" ".join(stretch[c:d]) if d - c > b - a else f"-{' '.join(template[a:b])}")
    return n, first


def telling_words(licenses: list[str], words: list[list[str]]) -> list[tuple[frozenset[str], frozenset[str]]]:
    """For each template, the words that must be in its place, and those that may not be there.

    Of two similar templates of different licenses, the words that only one has tell them apart. Numbers always must be there.
    """
    counts = [Counter(w) for w in words]
    sizes = np.array([len(w) for w in words])
    out = []
    for k, own in enumerate(counts):
        must, never = {w for w in own if w[0].isdigit()}, set()
        for j in np.flatnonzero(np.abs(sizes - sizes[k]) <= SIMILAR * np.maximum(sizes, sizes[k])).tolist():
            if licenses[j] != licenses[k] and max((own - counts[j]).total(), (counts[j] - own).total()) <= SIMILAR * max(sizes[j], sizes[k]):
                must |= own.keys() - counts[j].keys()
                never |= counts[j].keys() - own.keys()
        out.append((frozenset(must), frozenset(never)))
    return out


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    begin: int
    end: int
    saved: int
    share: float
    differing: int
    words: int
    clause: str = ""


class Scanner:
    """Finds notices in texts; keeps the blocks that it has seen."""

    def __init__(self, of: list[tuple[str, str]] | None = None, share: float = SHARE, most: float = DIFFERENCES, level: int = LEVEL):
        self.of = templates() if of is None else of
        for _, wording in self.of:
            if not _CUE.search(wording) and not wording.startswith(LINKS) or len(words_of(wording)[0]) > SHORT_WORDS and not _LONG_CUE.search(wording):
                raise ValueError(f"no cue word in {wording!r}")
        self.share, self.most = share, most
        self.words = [words_of(w)[0] for _, w in self.of]
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.primed, self.own = [], []
        for own in self.words:
            raw = " ".join(own).encode()
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.primed.append(zstandard.ZstdCompressor(dict_data=d, **plain))
            self.own.append(len(self.alone.compress(raw)) - len(self.primed[-1].compress(raw)))
        self.telling = telling_words([k for k, _ in self.of], self.words)
        # what is sought in blocks of each kind: sentences and lines, paragraphs, and text over paragraph ends
        size = [len(own) for own in self.words]
        one = max((len(words_of(w)[0]) for w in NOTICES.values()), default=1)
        self.kinds = [(_BREAK, [k for k, n in enumerate(size) if n <= SHORT_WORDS]), (_PARAGRAPH, [k for k, n in enumerate(size) if n <= one]), (_NEVER, [k for k, n in enumerate(size) if n > SHORT_WORDS])]
        self.known: dict[str, list[Match]] = Kept(CACHE_BYTES, 4096)

    def ranked(self, block: list[str], among: list[int]) -> list[tuple[int, float, int]]:
        """(bytes saved, share of what the template saves of itself, template), the most bytes first."""
        raw = " ".join(block).encode()
        size = len(self.alone.compress(raw))
        saved = [(size - len(self.primed[k].compress(raw)), k) for k in among]
        return sorted(((s, s / self.own[k], k) for s, k in saved if s > 0 < self.own[k]), key=lambda x: (-x[0], x[2]))

    def confirmed(self, k: int, words: list[str]) -> Iterator[tuple[int, int, int, str]]:
        """(n differing words, begin, end, the clause that is added or left out) of every stretch of ``words`` that is a template's wording: the one worded most like it is judged, then what lies left and right of it."""
        must, never = self.telling[k]
        most, ahead = self.most * len(self.words[k]), [(0, len(words))]
        while ahead:
            lo, hi = ahead.pop()
            own = words[lo:hi]
            if len(own) < len(self.words[k]) / 2 or not must.issubset(own):
                continue
            n, begin, end = differences(self.words[k], own)
            long = len(self.words[k]) > SHORT_WORDS
            if n > (len(self.words[k]) / 2 if long else most) or begin >= end:
                continue
            clauses, first = other_clauses(self.words[k], own[begin:end]) if long else (0, "")
            if n - clauses > most:
                continue
            there = set(own[begin:end])
            if must <= there and never.isdisjoint(there):
                yield n, lo + begin, lo + end, first
            ahead += [(lo + end, hi), (lo, lo + begin)]

    def block(self, text: str, kind: int) -> list[Match]:
        """The notices of a block: in order of bytes saved, those whose wording is confirmed and that none before them overlaps. A license that was given another clause keeps its place."""
        key = f"{kind}{text}"
        if key in self.known:
            return self.known[key]
        words, spans = words_of(text)
        out: list[Match] = []
        for saved, share, k in self.ranked(words, self.kinds[kind][1]) if words else ():
            for n, begin, end, clause in self.confirmed(k, words) if share >= self.share else ():
                out.append(Match(self.of[k][0], k, spans[begin][0], spans[end - 1][1], saved, share, n, len(self.words[k]), clause))
        out = best(out)
        self.known.keep(key, out, 150 * len(out))
        return out

    def scan(self, text: str | None, changed: bool = False) -> list[Match]:
        """All notices of a text, in order of place. None or empty: none. ``changed``: also the licenses with a clause added or left out, each with its clause."""
        if not text or not _CUE.search(text):
            return []
        found: list[Match] = []
        for kind, (breaks, among) in enumerate(self.kinds):
            reach = 3 * max((len(self.words[k]) for k in among), default=1)
            at = 0
            for m in [*breaks.finditer(text), None]:
                a, b = at, m.start() if m else len(text)
                at = m.end() if m else b
                for c, d in self._windows(text, a, b, reach, self.kinds[kind][0] is _NEVER):
                    found += [replace(x, begin=x.begin + c, end=x.end + c) for x in self.block(text[c:d], kind)]
        out: list[Match] = []
        for x in sorted(best(found), key=lambda x: (x.begin, x.end)):
            if not self.of[x.template][1].startswith(LINKS) or out and not text[out[-1].end : x.begin].strip(" \t\r\n,/()"):
                out.append(x)
        return [x for x in out if changed or not x.clause]

    def _windows(self, text: str, a: int, b: int, reach: int, long: bool) -> Iterator[tuple[int, int]]:
        """A block as it is, if it has a cue; a very long one as windows of three steps around the cues, so that a notice lies whole in one."""
        cues = [m.start() for m in (_LONG_CUE if long else _CUE).finditer(text, a, b)]
        if not cues:
            return
        if b - a <= 40 * reach:
            yield a, b
            return
        ends = [m.end() for m in _WORD.finditer(text, a, b)]
        last = -1
        for place in cues:
            k = bisect_left(ends, place) // reach
            if k > last:
                last = k
                lo, hi = (k - 1) * reach, (k + 2) * reach
                yield (ends[lo] if lo > 0 else a), (ends[hi] if hi < len(ends) else b)


def best(matches: list[Match]) -> list[Match]:
    """Of matches that overlap, the one that saves the most bytes; then the one with the fewest differing words; then the longer; then the first."""
    out: list[Match] = []
    for x in sorted(matches, key=lambda x: (-x.saved, x.differing, x.begin - x.end, x.begin, x.template)):
        if all(x.end <= y.begin or x.begin >= y.end for y in out):
            out.append(x)
    return out


SCHEMA = "array<struct<license:string,wording:string,begin:int,end:int,saved_bytes:int,share:double,n_differing:int,n_words:int>>"


@lru_cache(4)
def scanner(of: tuple[tuple[str, str], ...], share: float, most: float) -> Scanner:
    """One scanner for all tasks of a worker: what tells templates apart takes longer to work out than many texts to scan."""
    return Scanner(list(of), share, most)


def scan_licenses(docs: DataFrame, text_column: str = "text", of: list[tuple[str, str]] | None = None, share: float = SHARE, most: float = DIFFERENCES) -> DataFrame:
    """``docs`` with _notices, an array of what ``Scanner.scan`` finds in each whole text; begin and end count code points.

    A null text has none, an empty array. Repeated rows stay; ties go to the template that stands first. An empty table
    gives an empty result. Other columns are kept, but for one named _notices.
    """
    pairs = templates() if of is None else of

    @F.arrow_udf(SCHEMA)
    def notices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = scanner(tuple(pairs), share, most)
        kind = pa.list_(pa.struct([("license", pa.string()), ("wording", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("saved_bytes", pa.int32()), ("share", pa.float64()), ("n_differing", pa.int32()), ("n_words", pa.int32())]))
        for texts in (part for batch in batches for part in slices(batch)):
            cued = pc.fill_null(pc.match_substring_regex(texts, f"(?i){CUES}"), False).to_pylist()
            found = [own.scan(t.as_py()) if c else [] for t, c in zip(texts, cued)]
            yield pa.array([[(x.license, pairs[x.template][1], x.begin, x.end, x.saved, x.share, x.differing, x.words) for x in notices_] for notices_ in found], kind)

    small_batches(docs.sparkSession)
    return docs.withColumn("_notices", notices(F.col(text_column).cast("string")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs).select("doc_id", F.posexplode("_notices").alias("notice", "n"))
    return found.select("doc_id", "notice", *[F.col(f"n.{c}").alias(c) for c in ("license", "wording", "begin", "end", "saved_bytes", "share", "n_differing", "n_words")])
