import random

import numpy as np
import pytest

from meterwise.llm import licenses as L


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = "the of and thor mena quell under version license free rights terms public use general software notice copy".split() + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(600)]


@pytest.fixture(scope="module")
def scanner(prose):
    return L.train_scanner(prose[:300])


def scanned(spark, scanner, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    return {r.doc_id: r.spans for r in L.license_scan(docs, scanner).collect()}


#: None of these texts is among the templates or the phrases that train.
HELD_OUT = [
    ("MIT", "Made available to everyone under the MIT License."),
    ("MIT", "distributed under the MIT License, see the accompanying file"),
    ("MIT", "MIT License"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Use of this source code is governed under the terms of the 3-clause BSD license"),
    ("GPL-3.0", "Distributed under the terms of the GNU General Public License v3."),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY", "Licensed under CC BY 3.0."),
    ("CC-BY-SA", "All texts here are offered under the Creative Commons Attribution-ShareAlike 3.0"),
    ("Apache-2.0", "The sources come under the Apache License v2.0"),
    ("MPL-2.0", "It is shipped under the Mozilla Public License, version 2.0, by the team."),
    ("LGPL", "can be used under the LGPL v2.1"),
    ("AGPL-3.0", "The server runs under the AGPLv3"),
    ("ISC", "Offered under the ISC License"),
]


def test_held_out_notices_and_prose(spark, scanner, prose):
    rng = random.Random(6)
    texts = [f"{rng.choice(prose[300:])}\n{rng.choice(('', 'Note: ', '* '))}{t}\n{rng.choice(prose[300:])}" for _, t in HELD_OUT]
    texts = [t.replace("Note: MIT License", "MIT License") for t in texts]
    got = scanned(spark, scanner, texts)
    missed = [t for i, (f, t) in enumerate(HELD_OUT) if [s.family for s in got[i]] != [f]]
    assert not missed
    assert all((s.first_line, s.lines) == (1, 1) and s.similarity >= 0.8 for spans in got.values() for s in spans)
    clean = scanned(spark, scanner, ["\n".join(prose[i : i + 3]) for i in range(300, 597)] + list(L.NO_LICENCES))
    assert sum(bool(s) for s in clean.values()) <= 1


def test_expressions_name_several_families(spark, scanner):
    got = scanned(spark, scanner, ["SPDX-License-Identifier: MIT OR Apache-2.0", "# SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)"])
    assert [[s.family for s in got[i]] for i in range(2)] == [["Apache-2.0", "MIT"], ["BSD", "GPL-2.0"]]


def wrapped(text, width, mark=""):
    lines, line = [], mark
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = mark
        line += f" {w}" if line else w
    return [*lines, line]


def test_wrapped_notices_and_notices_inside_long_lines(spark, scanner, prose):
    grant, warranty = L.TEMPLATES["MIT"][0], L.TEMPLATES["MIT"][2]
    block = wrapped(grant, 80, "#")
    assert len(block) >= 5
    many = " ".join(prose[310:370])
    texts = ["\n".join(["intro", "", *block, "", "more"]), "\n".join([prose[301], *block, prose[302]]), "\n".join(wrapped(warranty.lower(), 60)), f"{many} This project is licensed under the MIT license. {many}", f"{many} {L.TEMPLATES['GPL-3.0'][0]} {many}"]
    got = scanned(spark, scanner, texts)
    assert [[s.family for s in got[i]] for i in range(5)] == [["MIT"], ["MIT"], ["MIT"], ["MIT"], ["GPL-3.0"]]
    assert got[0][0].first_line == 2 and got[0][0].lines == len(block)
    assert got[1][0].first_line <= 1 and got[1][0].lines >= len(block)


def brute_spans(text, scanner, likely=0.5):
    """The same by plain loops: units, scores by dictionary, templates."""
    weight = {int(f): scanner.weights[:, i] for i, f in enumerate(scanner.features)}
    hashed = lambda w: L.Words([w.encode()], kind=L.LETTERS_AND_DIGITS).hashes
    words = [(w.lower(), n) for n, line in enumerate(text.split("\n")) for w in L._WORD.findall(line)]
    paragraphs = [[]]
    for k, (_, n) in enumerate(words):
        if paragraphs[-1] and n > words[paragraphs[-1][-1]][1] + 1:
            paragraphs.append([])
        paragraphs[-1].append(k)
    units = []
    for n in sorted({n for _, n in words}):
        at = [k for k, w in enumerate(words) if w[1] == n]
        if len(at) <= L.LONG:
            units.append((at[0], at[-1] + 1, True))
    for p in paragraphs:
        if p and (words[p[0]][1] < words[p[-1]][1] or len(p) > L.LONG):
            at = p[0]
            while True:
                units.append((at, min(at + L.WIDE, p[-1] + 1), False))
                if at + L.WIDE >= p[-1] + 1:
                    break
                at += L.STEP
    covered = set()
    for a, b, line in units:
        h = [int(hashed(w)[0]) for w, _ in words[a:b]]
        pairs = [int(L.mix(hashed(words[k][0]) * 3 ^ hashed(words[k + 1][0]))[0]) for k in range(a, b - 1)]
        z = scanner.bias + sum((weight.get(x - 2**64 if x >= 2**63 else x, 0.0) for x in h + pairs), 0.0)
        p = 1 / (1 + np.exp(-(scanner.slope * z + scanner.shift)))
        for k, f in enumerate(L.FAMILIES):
            hit = L.matched(tuple(w for w, _ in words[a:b]), f, line) if p[k] >= likely else None
            if hit:
                covered |= {(f, n) for n in range(words[a + hit[1]][1], words[a + hit[2] - 1][1] + 1)}
    return covered


def test_spans_equal_brute_force(spark, scanner, prose):
    rng = random.Random(9)
    texts = []
    for _ in range(25):
        parts = [rng.choice([*prose[300:], "", " ".join(prose[320:326]), rng.choice(HELD_OUT)[1], *wrapped(L.TEMPLATES[rng.choice(L.FAMILIES)][0], 50)]) for _ in range(12)]
        texts.append("\n".join(parts))
    got = scanned(spark, scanner, texts)
    for i, t in enumerate(texts):
        assert {(s.family, n) for s in got[i] for n in range(s.first_line, s.first_line + s.lines)} == brute_spans(t, scanner)


def test_neighbouring_lines_are_one_span(spark, scanner):
    text = "x\n" + "\n".join(L.TEMPLATES["BSD"][1:4]) + "\nend"
    assert [(s.family, s.first_line, s.lines) for s in scanned(spark, scanner, [text])[0]] == [("BSD", 1, 3)]


def test_nulls_ties_and_long_texts(spark, scanner):
    long = "word " * 200_000 + "\nReleased under the MIT License."
    got = scanned(spark, scanner, [None, "", "\n\n", long, "Released under the MIT License."])
    assert [[s.family for s in got[i]] for i in range(5)] == [[], [], [], ["MIT"], ["MIT"]]
    assert got[3][0].first_line == 1
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string"), scanner).count() == 0
    assert L.corpus_lines(spark.createDataFrame([(None, None), (1, "a\n\nb")], "doc_id long, text string")) != []


def test_templates_confirm():
    words = L.words_of
    assert L.matched(words("this is Released under the MIT License, friends"), "MIT", True) == (1.0, 3, 7)
    assert L.matched(words("MIT license"), "MIT", True) == (1.0, 0, 2)
    assert L.matched(words("MIT license"), "MIT", False) is None
    assert L.matched(words("the MIT license is short"), "MIT", True) is None
    assert L.matched((), "MIT", True) is None
    assert L.matched(words("SPDX-License-Identifier: LGPL-2.1"), "GPL-2.0", True) is None
