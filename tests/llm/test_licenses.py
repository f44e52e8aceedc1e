"""License scans: alignment against brute force, planted notices, odd texts, whole tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import zstandard

from skimmer.llm.licenses import DIFFERENCES, FULL, LINKS, NOTICES, SHARE, Scanner, differences, op2_license_scan, scan_licenses, templates, words_of

SCANNER = Scanner()


def brute(template, block):
    """(differences, end): edit distance of the template to every stretch of the block."""
    best = None
    for end in range(len(block) + 1):
        for begin in range(end + 1):
            a, b = template, block[begin:end]
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, old = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
            if best is None or row[-1] < best:
                best = row[-1]
    return best


def test_differences_are_least():
    r = random.Random(3)
    for _ in range(150):
        t = [r.choice("abcd") for _ in range(r.randint(1, 6))]
        b = [r.choice("abcde") for _ in range(r.randint(0, 9))]
        n, begin, end = differences(t, b)
        assert n == brute(t, b) and 0 <= begin <= end <= len(b)


@pytest.mark.parametrize("text, licenses", [
    (None, []), ("", []), ("no notice here", []), ("a license to drive, with permission and copyright", []), ("Released under the MIT License.", ["MIT"]), ("x\nLICENSED   UNDER the apache license version 2.0\ny", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under the Apache License, Version 1.1.", []),
    ("Released under the MIT License. Also distributed under Apache 2.0.", ["MIT", "Apache-2.0"]), ("// SPDX-License-Identifier: MPL-2.0", ["MPL-2.0"]), *((w, [k]) for k, w in NOTICES.items()), *((w.replace(" ", "\n  "), [k]) for k, w in NOTICES.items()),
])
def test_scan(text, licenses):
    assert [x.license for x in SCANNER.scan(text)] == licenses


def test_every_template_finds_itself():
    for license_, wording in templates():
        if wording.startswith(LINKS):
            continue
        found = SCANNER.scan(f"Some words before. {wording}. And after it.")
        assert [x.license for x in found] == [license_], wording
        assert found[0].differing == 0


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize("text, licenses", [
    (GPL.format("", "3"), ["GPL-3.0"]), (GPL.format("", "2"), ["GPL-2.0"]), (GPL.format("", "1"), []), (GPL.format("", "4"), []), (GPL.format("Affero ", "3"), ["AGPL-3.0"]), (GPL.format("Lesser ", "3"), ["LGPL-3.0"]), (GPL.format("Lesser ", "2.1"), ["LGPL-2.1"]),
    (GPL.format("Library ", "2"), ["LGPL-2.0"]), (GPL.format("Affero ", "1"), []), (FULL["BSD-3-Clause"], ["BSD-3-Clause"]), (FULL["BSD-2-Clause"], ["BSD-2-Clause"]), (FULL["MIT"], ["MIT"]), (FULL["MIT-0"], ["MIT-0"]), (FULL["ISC"], ["ISC"]), (FULL["0BSD"], ["0BSD"]), (FULL["Zlib"], ["Zlib"]),
    (NOTICES["Apache-2.0"].replace("2.0", "1.1"), []), (NOTICES["MPL-2.0"].replace("2.0", "1.1"), []), ("Licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]), ("Licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]),
    ("Released under the New BSD License; see also the Simplified BSD License, distributed under the BSD 2-Clause License", ["BSD-3-Clause", "BSD-2-Clause"]), ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 3.0", []),
    ("Copyright (c) 1999 Somebody\n\n" + FULL["BSD-3-Clause"].replace("conditions are met: ", "conditions are met:\n\n 1. ").replace("disclaimer. ", "disclaimer.\n\n 2. ").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS"), ["BSD-3-Clause"]),
])
def test_licenses_that_are_worded_alike(text, licenses):
    assert [x.license for x in SCANNER.scan(text)] == licenses
    assert [x.license for x in SCANNER.scan(f"Before it.\n\n{text}\n\nAfter it.")] == licenses


ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
X11 = " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale."


@pytest.mark.parametrize("text, licenses", [
    ("A is licensed under the MIT License and B is licensed under the MIT License", ["MIT"] * 2), (f"{FULL['MIT']} {FULL['MIT']}", ["MIT"] * 2), (f"{FULL['BSD-2-Clause']}\n\nOther words.\n\n{FULL['BSD-2-Clause']}", ["BSD-2-Clause"] * 2), ("released under the ISC License, " * 7, ["ISC"] * 7),
    (f"{FULL['ISC']}\n\n{FULL['MIT']} {FULL['Zlib']} {FULL['MIT']}", ["ISC", "MIT", "Zlib", "MIT"]), (FULL["BSD-3-Clause"].replace("Neither", ADVERTISING + "Neither"), []), (FULL["MIT"] + X11, ["MIT"]), (FULL["MIT"].replace(" THE SOFTWARE IS", X11 + " THE SOFTWARE IS"), []),
    ("Available under the GNU Affero General Public License v3.0 or later", ["AGPL-3.0"]), ("Licensed under the AGPL v3", ["AGPL-3.0"]), ("License: MIT", ["MIT"]), ("Released under the Apache 2 license", ["Apache-2.0"]), ("License: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("It is released under the MIT License or the GNU General Public License, version 3", ["MIT", "GPL-3.0"]), ("We read of patents and the MIT License, a license of note", []), ("Licensed under the MIT License. And the Apache License 2.0 is a license, too", ["MIT"]), ("licensed under the MIT License, or the BSD 3-Clause License and GPL-2.0", ["MIT", "BSD-3-Clause", "GPL-2.0"]),
])
def test_every_notice_and_no_other_clause(text, licenses):
    assert [x.license for x in SCANNER.scan(text)] == licenses


def test_other_clauses_are_named():
    found = SCANNER.scan(FULL["BSD-3-Clause"].replace("Neither", ADVERTISING + "Neither"), changed=True)
    assert [x.license for x in found] == ["BSD-3-Clause"] and "advertising materials mentioning features" in found[0].clause
    assert [x.clause for x in SCANNER.scan(FULL["MIT"], changed=True)] == [""]


def by_force(text, of):
    """The licenses of a text of one block: every template against every stretch, each compressed anew; what tells two licenses apart is worked out by pairs."""
    words = words_of(text)[0]
    raw = " ".join(words).encode()

    def size(raw, own=None):
        how = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        given = {"dict_data": zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if own else {}
        return len(zstandard.ZstdCompressor(**how, **given).compress(raw))

    found = []
    for k, (license_, wording) in enumerate(of):
        own = words_of(wording)[0]
        saved = size(raw) - size(raw, own)
        alone = " ".join(own).encode()
        if saved < SHARE * (size(alone) - size(alone, own)) or saved <= 0 or size(alone) <= size(alone, own):
            continue
        most = DIFFERENCES * len(own)
        near = sorted((edit(own, words[a:b]), b, a) for a in range(len(words)) for b in range(a + 1, len(words) + 1) if abs(b - a - len(own)) <= most)
        judged = []  # every stretch, the nearest first, that none before it overlaps
        for n, b, a in near:
            if n > most or any(a < y and x < b for x, y in judged):
                continue
            judged.append((a, b))
            there = Counter(words[a:b])
            ok = all(there[w] for w in own if w[0].isdigit())
            for other, said in of:
                rest = words_of(said)[0]
                if other != license_:
                    gone, new = Counter(own) - Counter(rest), Counter(rest) - Counter(own)
                    if max(gone.total(), new.total(), abs(len(rest) - len(own))) <= 0.5 * max(len(rest), len(own)):
                        ok &= all(there[w] for w in gone if w not in rest) and not any(there[w] for w in new if w not in own)
            if ok:
                found.append((-saved, n, a - b, a, k, b, license_))
    out = []
    for x in sorted(found):
        if all(x[5] <= y[3] or x[3] >= y[5] for y in out):
            out.append(x)
    return [x[6] for x in sorted(out, key=lambda x: x[3])]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_against_all_templates_and_stretches():
    r = random.Random(5)
    of = [x for x in templates() if len(words_of(x[1])[0]) <= 8]
    names = [w for _, w in of]
    scanner = Scanner(of)
    for _ in range(60):
        text = r.choice(names)
        if r.random() < 0.6:
            own = text.split()
            k = r.randrange(len(own))
            own[k] = r.choice(["the", "3", "2.0", "Lesser", "Affero", "NC", "License", "GNU", own[k]])
            text = " ".join(own)
        if r.random() < 0.4:
            text = f"{text} and {r.choice([text, *names])}"
        if r.random() < 0.2:
            text = f"{text}, {text}"
        text = f"{r.choice(['See', 'Text that is', ''])} {text}".strip()
        assert [x.license for x in sorted(scanner.block(text, 1), key=lambda x: x.begin)] == by_force(text, of), text


def test_few_words_may_differ_in_long_notices():
    wording = NOTICES["MIT"].replace("hereby", "gladly").replace("Software", "Program")
    found = SCANNER.scan(f"Intro.\n\n{wording}\n\nBody.")
    assert [x.license for x in found] == ["MIT"] and 0 < found[0].differing <= 0.1 * found[0].words


def test_long_texts_are_scanned_whole():
    words = "license word other " * 40_000
    text = words + "released under the MIT License " + words
    found = [x for x in SCANNER.scan(text) if x.license == "MIT"]
    assert len(found) == 1 and text[found[0].begin : found[0].end] == "released under the MIT License"


def test_table_of_documents(spark):
    rows = [(1, "é Released under the MIT License.", 0), (1, "é Released under the MIT License.", 0), (None, None, None), (2, "", 1)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect()
    assert sorted(len(r["_notices"]) for r in got) == [0, 0, 1, 1]
    n = next(r["_notices"][0] for r in got if r["_notices"])
    assert (n["begin"], n["end"], n["n_differing"]) == (2, 32, 0)
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_finds_every_license_line(spark, sf_dir):
    lines = ("licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = {r["doc_id"] for r in docs if r["text"] and any(x in r["text"] for x in lines)}
    assert {r["doc_id"] for r in op2_license_scan(spark, sf_dir).collect()} == wanted
