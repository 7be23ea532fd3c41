"""Licence scans: a trained classifier of paragraphs proposes licence families, templates confirm them.

Paragraphs are looked at line by line, and in windows of words where they have several lines or a long one, so that wrapped
notices and notices inside long lines are seen. Words and pairs of words go to a logistic regression for each family,
trained on altered copies of templates and short notices against lines of the corpus. The score, calibrated on held-out
rows, gives the probability that a unit is no unknown text; a likely family counts if one of its templates confirms it.
Overlapping and neighbouring finds of one family are one span.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS_AND_DIGITS, Words, few_rows, mix, small_batches
from .toxicity import fit, sigmoid

#: Sentences of well-known licences and of the notices that they ask for.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "AGPL-3.0": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_GNU = ("{} version {}", "{}, version {}.0", "{} v{}", "{} v{}.0", "{} {}", "{} {}.0")
_CC = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _versions(names: tuple[str, ...], forms: tuple[str, ...], numbers: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(form.format(name, number) for name in names for form in forms for number in numbers)


#: How notices name a licence, and the beginnings of its identifiers in SPDX expressions.
NAMES = {
    "Apache-2.0": _versions(("Apache License", "Apache Software License", "Apache"), ("{} {}", "{}, Version {}", "{} v{}", "{} {} license"), ("2.0",)),
    "MIT": ("MIT License", "Expat License", "MIT/X11 License", "MIT"),
    "GPL-3.0": (*_versions(("GNU General Public License", "GNU GPL", "GPL"), _GNU, ("3",)), "GPLv3"),
    "GPL-2.0": (*_versions(("GNU General Public License", "GNU GPL", "GPL"), _GNU, ("2",)), "GPLv2"),
    "LGPL": (*_versions(("GNU Lesser General Public License", "GNU LGPL", "LGPL"), (*_GNU, "{} version 2.1", "{} v2.1", "{} 2.1"), ("3",)), "LGPLv3", "GNU Lesser General Public License"),
    "AGPL-3.0": (*_versions(("GNU Affero General Public License", "GNU AGPL", "AGPL"), _GNU, ("3",)), "AGPLv3"),
    "BSD": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "2-Clause BSD License", "3-Clause BSD License", "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD 3-Clause", "BSD 2-Clause"),
    "ISC": ("ISC License",),
    "MPL-2.0": _versions(("Mozilla Public License", "MPL"), ("{} {}", "{}, version {}", "{}, v. {}", "{} v{}"), ("2.0",)),
    "CC-BY": _versions(("CC BY", "Creative Commons Attribution"), ("{} {}", "{} {} International License"), _CC),
    "CC-BY-SA": _versions(("CC BY-SA", "Creative Commons Attribution-ShareAlike"), ("{} {}", "{} {} International License"), _CC),
    "CC-BY-NC": _versions(("CC BY-NC", "Creative Commons Attribution-NonCommercial"), ("{} {}", "{} {} International License"), _CC),
    "CC0": ("CC0 1.0 Universal", "CC0 1.0", "CC0"),
    "Unlicense": ("Unlicense",),
}
TAGS = {
    "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "GPL-3.0": ("GPL-3.0",), "GPL-2.0": ("GPL-2.0",), "LGPL": ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0"), "AGPL-3.0": ("AGPL-3.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "ISC": ("ISC",),
    "MPL-2.0": ("MPL-2.0",), "CC-BY": tuple(f"CC-BY-{v}" for v in _CC), "CC-BY-SA": tuple(f"CC-BY-SA-{v}" for v in _CC), "CC-BY-NC": tuple(f"CC-BY-NC-{v}" for v in _CC), "CC0": ("CC0-1.0",), "Unlicense": ("Unlicense",),
}
#: What a short notice says before the name; the first ones are templates, the others only train.
GRANTS = ("under {}", "under the {}", "under a {}", "under the terms of the {}", "under the terms of {}")
PHRASES = ("Released {}.", "Licensed {}.", "This project is licensed {}.", "Distributed {}, see the file LICENSE.", "The code is available {}", "This work is {}.", "You may use it {} or later", "Published {}")
SPDX = "SPDX-License-Identifier:"
#: Lines that speak of licences and grant nothing.
NO_LICENCES = (
    "A driving licence is needed to rent a car in this city.", "The license plate of the car was never found.", "Her fishing licence expired in version two of the story.", "The Apache helicopters were released from the base.", "MIT published the results of the study.",
    "The general public may not use this road.", "All rights of the author are reserved.", "Permission to land was granted without restriction.", "He was licensed to sell spirits under the old law.", "The foundation published a free copy of the report.",
    "Under the new law the BSD team may not sell copies.", "This work is under way in version 3 of the plan.",
)
FAMILIES = tuple(TEMPLATES)
#: Altered copies of a template; documents, and lines of them, that stand for the corpus.
COPIES, DOCUMENTS, LINES = 16, 300, 2000
SHINGLE, SIMILAR = 5, 0.8
#: Words of the windows in paragraphs of several lines, and from one to the next: few enough that some window misses at most
#: four words of a notice on either side. Lines of more than LONG words are looked at in windows only.
WIDE, STEP, LONG = 40, 8, 60
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORD.findall(text))


def _shingles(words: tuple[str, ...]) -> dict[tuple, int]:
    """The five-word shingles of the words, each with its first place."""
    return {words[i : i + SHINGLE]: i for i in range(len(words) - SHINGLE, -1, -1)}


_LONG = {family: [_shingles(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}
_HEADINGS = {family: {words_of(n) for n in names if len(words_of(n)) > 1} for family, names in NAMES.items()}
_SHORT = {family: {words_of(g.format(n)) for n in names for g in GRANTS} for family, names in NAMES.items()}
_TAG, _TAGS = words_of(SPDX), {family: [words_of(t) for t in tags] for family, tags in TAGS.items()}


def _place(words: tuple[str, ...], part: tuple[str, ...], start: int = 0) -> int:
    """Where part begins in words, from start on; -1 if nowhere."""
    return next((i for i in range(start, len(words) - len(part) + 1) if words[i : i + len(part)] == part), -1)


def matched(words: tuple[str, ...], family: str, whole_line: bool) -> tuple[float, int, int] | None:
    """How like the words are to a template of the family, and from which to which word; None under SIMILAR.

    Of a long template and the words, the smaller set of five-word shingles must lie in the other by SIMILAR. A short
    notice, or an identifier in an SPDX expression, must be there as it is; a mere name must be a whole line.
    """
    own, best = _shingles(words), None
    for template in _LONG[family]:
        both = [own[s] for s in own.keys() & template.keys()]
        share = len(both) / max(min(len(own), len(template)), 1)
        if share >= SIMILAR and (best is None or share > best[0]):
            best = share, min(both), max(both) + SHINGLE
    if best is None:
        sizes = sorted({len(t) for t in _SHORT[family]}, reverse=True)
        for i, n in ((i, n) for n in sizes for i in range(len(words) - n + 1)):
            if words[i : i + n] in _SHORT[family]:
                return 1.0, i, i + n
        at = _place(words, _TAG)
        tag = max((_place(words, t, at + len(_TAG)) for t in _TAGS[family]), default=-1) if at >= 0 else -1
        if tag >= 0:
            return 1.0, at, len(words) if whole_line else tag + 1
        if whole_line and words in _HEADINGS[family]:
            return 1.0, 0, len(words)
    return best


class Units:
    """What is classified in some texts: their lines of up to LONG words, and windows of WIDE words, every STEP words, in paragraphs that
    have several lines or a longer one. Paragraphs end at empty lines. Unit i has the words first[i] to last[i]."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts, lower=True, kind=LETTERS_AND_DIGITS)
        raw = np.frombuffer(words.data, np.uint8)
        breaks = np.flatnonzero(raw == 10)
        self.line = np.searchsorted(breaks, words.starts)
        count = len(words.starts)
        head = np.flatnonzero(np.diff(self.line, prepend=-1)) if count else np.zeros(0, np.int64)
        tail = np.append(head[1:], count)[: len(head)]
        short = tail - head <= LONG
        # words of two lines are of one paragraph if the lines follow each other, in one text
        text = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.text = text
        apart = np.flatnonzero((np.diff(self.line) > 1) | (np.diff(text) > 0)) + 1 if count else np.zeros(0, np.int64)
        starts, ends = (np.concatenate(x).astype(np.int64) for x in (([0], apart), (apart, [count])))
        several = (self.line[ends - 1] > self.line[starts]) | (ends - starts > LONG) if count else np.zeros(1, bool)
        starts, ends = starts[several], ends[several]
        number = np.maximum(-(-(ends - starts - WIDE) // STEP), 0) + 1
        at = np.repeat(starts, number) + STEP * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
        self.first = np.concatenate((head[short], at)).astype(np.int64)
        self.last = np.concatenate((tail[short], np.minimum(at + WIDE, np.repeat(ends, number)))).astype(np.int64)
        self.lines = int(short.sum())  # the first units are lines
        self.pairs = mix(words.hashes[:-1] * np.uint64(3) ^ words.hashes[1:]) if count else words.hashes


@dataclass(frozen=True)
class Scanner:
    """The trained models: sorted features, weights and bias for each family, and the calibration of their scores."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: float
    shift: float

    def _sums(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        value = hashes.view(np.int64)
        at = np.searchsorted(self.features, value)
        at[at == len(self.features)] = 0
        known = np.flatnonzero(self.features[at] == value)
        sums = np.concatenate((np.zeros((1, len(self.bias))), np.cumsum(self.weights.T[at[known]], axis=0)))
        return sums[np.searchsorted(known, last)] - sums[np.searchsorted(known, first)]

    def probabilities(self, units: Units) -> np.ndarray:
        """For each unit and family the probability that the unit is a notice of this family rather than unknown."""
        z = self._sums(units.words.hashes, units.first, units.last) + self._sums(units.pairs, units.first, np.maximum(units.last - 1, units.first)) + self.bias
        return sigmoid(self.slope * z + self.shift)


def _altered(text: str, rng: random.Random, others: list[str]) -> str:
    words = [w for w in text.split() if rng.random() > 0.06] or text.split()
    words = [rng.choice(others) if rng.random() < 0.04 else w for w in words]
    before, after = ([rng.choice(others) for _ in range(rng.choice((0, 0, 1, 3, 12)))] for _ in range(2))
    return " ".join([*before, *words, *after])


def _parts(text: str) -> list[str]:
    """A long template in windows, as it will be seen."""
    words = text.split()
    return [" ".join(words[i : i + WIDE]) for i in range(0, max(len(words) - WIDE // 2, 1), WIDE // 2)]


def _training(rng: random.Random, corpus: list[str], others: list[str], copies: int) -> list[tuple[str, frozenset]]:
    rows: list[tuple[str, frozenset]] = []
    for k, family in enumerate(FAMILIES):
        own = frozenset([k])
        rows += [(_altered(part, rng, others), own) for t in TEMPLATES[family] for part in _parts(t) for _ in range(copies)]
        for name in NAMES[family]:
            rows += [(_altered(rng.choice(PHRASES).format(rng.choice(GRANTS).format(name)), rng, others), own) for _ in range(max(copies // 2, 96 // len(NAMES[family])))]
            rows += [(name, own)] * 2 if len(words_of(name)) > 1 else []
        for tag in TAGS[family]:
            for _ in range(copies):
                other = rng.randrange(len(FAMILIES))
                rows.append((f"{SPDX} {tag}{rng.choice(('', '-only', '-or-later', ''))}", own))
                rows.append((f"{SPDX} {tag} {rng.choice(('OR', 'AND'))} {rng.choice(TAGS[FAMILIES[other]])}", frozenset([k, other])))
        rows += [(" ".join(rng.sample(t.split(), min(3, len(t.split())))), frozenset()) for t in TEMPLATES[family] for _ in range(4)]
    rows += [(x, frozenset()) for x in corpus] + [(_altered(x, rng, others), frozenset()) for x in NO_LICENCES for _ in range(copies)]
    rng.shuffle(rows)
    return rows


def train_scanner(lines: list[str], copies: int = COPIES, seed: int = 17) -> Scanner:
    """Trains on altered templates and notices, and on lines of the corpus, of which those that match a template are left
    out. Three rows in four are fitted; the others calibrate the probability of the best family."""
    rng = random.Random(seed)
    corpus = [x for x in (" ".join(t.split()[:WIDE]) for t in lines) if not any(matched(words_of(x), f, True) for f in FAMILIES)]
    others = [w for x in corpus[:500] for w in x.split()] or ["text"]
    rows = _training(rng, corpus, others, copies)
    words = Words([" ".join(t.split()).encode() for t, _ in rows], lower=True, kind=LETTERS_AND_DIGITS)
    text = np.repeat(np.arange(len(rows)), np.diff(words.first))
    pair = np.flatnonzero(text[1:] == text[:-1])
    feature = np.concatenate((words.hashes, mix(words.hashes[pair] * np.uint64(3) ^ words.hashes[pair + 1]))).view(np.int64)
    row = np.concatenate((text, text[pair]))
    y = np.array([[k in own for k in range(len(FAMILIES))] for _, own in rows], float)
    found, counts = np.unique(feature[y.any(1)[row]], return_counts=True)
    features = found[counts >= 3]
    place = np.searchsorted(features, feature)
    place[place == len(features)] = 0
    known = features[place] == feature
    row, place = row[known], place[known]
    held = np.arange(len(rows)) % 4 == 0
    inside = ~held[row]
    number = np.cumsum(~held) - 1
    fitted = [fit(number[row[inside]], place[inside], np.zeros((int((~held).sum()), 0)), y[~held, k], len(features)) for k in range(len(FAMILIES))]
    weights, bias = np.array([w[:-1] for w in fitted]), np.array([w[-1] for w in fitted])
    z = np.stack([np.bincount(row, weights[k][place], minlength=len(rows)) + bias[k] for k in range(len(FAMILIES))], 1)[held]
    best = z.max(1)
    right = y[held][np.arange(len(z)), z.argmax(1)]
    spread = max(float(best.std()), 1e-9)
    slope, shift = fit(np.zeros(0, np.int64), np.zeros(0, np.int64), ((best - best.mean()) / spread)[:, None], right, 0, penalty=0.01)
    return Scanner(features, weights, bias, float(slope / spread), float(shift - slope * best.mean() / spread))


def corpus_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, lines: int = LINES) -> list[str]:
    """At most `lines` lines of up to 2,000 characters, of the documents whose id has the least hash, for the class of unknown texts."""
    some = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id")).limit(documents).distinct()
    texts = docs.join(F.broadcast(some), docs[id_col] == some["id"])  # bounded by `documents`
    found = texts.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where("length(trim(line)) BETWEEN 1 AND 2000").orderBy(F.xxhash64("line"), "line").limit(lines)
    return [r.line for r in found.collect()]


SPANS = "array<struct<family: string, first_line: int, lines: int, probability: double, similarity: double>>"


def spans_of(units: Units, scanner: Scanner, likely: float, texts: list[bytes]) -> list[list[dict]]:
    """The notices of each text: likely units that match a template, joined where they overlap or lie on neighbouring lines."""
    p = scanner.probabilities(units)
    found: list[tuple] = []
    for i, k in np.argwhere(p >= likely).tolist():
        a, b = int(units.first[i]), int(units.last[i])
        # the texts are lower-cased as bytes, templates as texts
        words = tuple(units.words.data[x:y].decode("utf-8", "replace").lower() for x, y in zip(units.words.starts[a:b].tolist(), units.words.ends[a:b].tolist(), strict=True))
        hit = matched(words, FAMILIES[k], i < units.lines)
        if hit:
            found.append((int(units.text[a]), FAMILIES[k], int(units.line[a + hit[1]]), int(units.line[a + hit[2] - 1]), float(p[i, k]), hit[0]))
    begins = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
    out: list[list[dict]] = [[] for _ in texts]
    last: dict[tuple, dict] = {}
    for text, family, first, end, probability, similarity in sorted(found):
        span, base = last.get((text, family)), int(begins[text])
        if span and first - base <= span["first_line"] + span["lines"]:
            span["lines"] = max(span["lines"], end - base - span["first_line"] + 1)
            span["probability"], span["similarity"] = max(span["probability"], probability), max(span["similarity"], similarity)
        else:
            last[text, family] = span = {"family": family, "first_line": first - base, "lines": end - first + 1, "probability": probability, "similarity": similarity}
            out[text].append(span)
    return [sorted(s, key=lambda x: (x["first_line"], x["family"])) for s in out]


def _scan(scanner: Scanner, likely: float):
    kind = pa.list_(pa.struct([("family", pa.string()), ("first_line", pa.int32()), ("lines", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in small_batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans_of(Units(texts), scanner, likely, texts), kind)], names=["doc_id", "spans"])

    return run


def license_scan(docs: DataFrame, scanner: Scanner, likely: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and spans, the licence notices in the order of their lines (counted from 0), then families.

    Null and empty texts have no spans; texts of any length are looked at whole; an empty table gives no rows. Where
    families tie, each has its span. Repeated rows and null ids stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return few_rows(rows).mapInArrow(_scan(scanner, likely), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
