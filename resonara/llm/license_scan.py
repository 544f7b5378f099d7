"""License scans by a trained paragraph classifier.

A sparse logistic regression over word unigrams and bigrams names a window's
licence family or ``unknown``; it alone decides what is looked at and what counts.
Its positive rows are variants of public notices and of short grants made by rule
(``FORMS`` with the families' names), whole paragraphs or between other words.  Its
negative rows are windows of the corpus, mentions and denials of licences, names
between other words, grants of invented licences, and licence words out of order.
A temperature calibrates its probabilities on rows kept apart: other forms, and
families that it never saw (``UNSEEN``), which must be unknown.

A paragraph ends at a line without a letter or digit; its other lines are joined,
so that wrapped and commented notices are read as one, and its ends are words of
their own.  N-grams whose weights speak for a family are cues.  Runs of cues that
lie close together, with a few words around them, are windows; those whose cues
can't outweigh ``unknown`` are passed over by a bound on the weights, all others are
judged.  Where cues of several families stand in a window, each family is judged
without the cues of the others, so that a window may name several.

The templates of the family then confirm a finding, or lower its score by what they
don't share with it; it counts with ``CONFIDENT`` or more (``BESIDES`` for further
families of a window).

Null texts have no paragraph.  Documents are independent and the training sample
is chosen by hash, so repeated rows give equal results, whatever the order or the
partitions of the input; an empty table gives an empty result; further columns
are not looked at.  Work is linear in the length of a text: a window is judged once
for each family that it has cues of.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Names of public licences by family: fixed values.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3", "GNU AGPL", "Affero GPL", "AGPL"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 license", "Apache 2.0"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "2-clause BSD license", "New BSD License", "Simplified BSD License", "BSD license", "BSD"],
    "cc": [
        "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-SA 3.0",
        "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International License",
        "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution License",
    ],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "EPL 2.0", "EPL v1.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL v3", "GNU GPL", "GPL", "GPL v2", "GPL v3", "GPL version 2", "GPLv2", "GPLv3"],
    "isc": ["ISC License", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3.0", "LGPL v2.1", "LGPL v3", "LGPLv3", "GNU LGPL", "LGPL"],
    "mit": ["MIT License", "MIT License (MIT)", "MIT licence", "Expat License", "MIT/Expat license"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib License", "zlib/libpng license"],
}
#: SPDX identifiers by family: fixed values.
SPDX = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "boost": ["BSL-1.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "cc": ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"], "cc0": ["CC0-1.0"], "epl": ["EPL-1.0", "EPL-2.0"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl": ["MPL-2.0"], "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}
#: Paragraphs of public notices by family: fixed values.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see the web site of the GNU licenses.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit the Creative Commons web site."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which accompanies this distribution."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the web site of the GNU licenses.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."],
}
#: Short grants; those of ``APART`` serve calibration alone.
FORMS = [
    "Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}", "This project is licensed under the terms of the {}", "This work is licensed under {}", "Published under {}, or any later version",
    "License: {}", "Licence: {}", "License {}", "{} licensed", "The {} applies to this code", "see the {} for details", "covered by the {}", "It is available under either the {}", "Dual licensed under {}", "at your option the {}", "under the terms of {}", "use is governed by the {}", "Code is {}", "available under the {}",
]
APART = ["Made available under the {}", "Subject to the terms of the {}", "You may use this file under the {}", "SPDX: {}", "Licensed with {}", "All files are {} licensed"]
#: What stands before and after a name that is a grant by itself, in lists.
LISTS = ["{} or", "or {}", "{} and", "and {}", "either of {} or"]
#: Licences that training never sees; calibration expects them to be unknown.
UNSEEN = ["Artistic License 2.0", "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Microsoft Public License", "CeCILL Free Software License", "Academic Free License 3.0", "Python Software Foundation License"]
MENTIONS = [
    "the {} was discussed at length", "a history of the {}", "many people like the {} more than others", "the {} and its critics", "compared with the {} this is long", "what is the {}", "we like the {} for its clarity", "the {} is popular among authors",
    "an essay about the {} and others", "lawyers have read the {} many times", "he wrote the {} in those years",
]
DENIALS = ["not licensed under the {}", "is not released under the {}", "never distributed under the {}", "no longer available under the {}", "was not licensed under {}", "this is not {} licensed", "incompatible with the {}", "cannot be combined with {} code", "the text isn t under the {}", "unlike the {} this"]

#: Words of licences that name none.
NAMELESS = ["version 3 of this license or any later one", "the second version of that license", "a copy of the license", "see the license for details", "version 2.0 of the license", "any later version of the license", "under the terms of the license"]

#: Windows of the corpus that the classifier is trained against, and words of each.
SAMPLE_WINDOWS, WINDOW_WORDS = 3000, 60
VARIANTS = 6
#: Score of a finding at least, and of further families of a window that surely grants one.
CONFIDENT, BESIDES = 0.6, 0.5
#: How much more an n-gram must weigh for a family than for ``unknown`` to be a cue, and than for other families to be the family's own.
CUE, OWN = 0.15, 1.8
#: Words between cues of a window at most, and words around them that are judged with them.
GAP, AROUND = 6, 3
#: Shared bigrams, or share of a window's, that confirm it; what is left of a score without any.
ENOUGH, CONFIRMED, UNSHARED = 8, 0.5, 0.92
FIRST, LAST = "<p>", "</p>"

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_BREAK = re.compile(r"\n(?:[^\w\n]*\n)+")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def paragraphs_of(text: str | None) -> list[list[str]]:
    """Words of each paragraph that has any."""
    return [w for w in map(words_of, _BREAK.split(text)) if w] if text else []


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def templates(family: str) -> list[list[str]]:
    """Words of a family's notices and of the grants made by rule."""
    tags = [words_of(f"SPDX-License-Identifier: {i}") for i in SPDX[family]]
    return [words_of(n) for n in NOTICES[family]] + [words_of(f.format(n)) for n in NAMES[family] for f in FORMS] + tags


@dataclass
class Classifier:
    """Weights (features and bias and strangeness x classes; the last class is unknown), and the templates' bigrams that confirm."""

    families: list[str]
    features: dict = field(default_factory=dict)
    weights: np.ndarray | None = None
    temperature: float = 1.0
    #: N-gram -> (how much it speaks for a family at most, the family that it is own to, or -1).
    cues: dict = field(default_factory=dict)
    shared: list[frozenset] = field(default_factory=list)

    def index_of(self, words: list[str], without: set | frozenset = frozenset()) -> tuple[list[int], float]:
        """Known n-grams and the share of those it doesn't know."""
        grams = [g for g in (*words, *bigrams(words)) if g not in without]
        found = {self.features[g] for g in grams if g in self.features}
        return sorted(found), 1 - len(found) / max(1, len(set(grams)))

    def probabilities(self, words: list[str], without: set | frozenset = frozenset()) -> np.ndarray:
        index, strange = self.index_of(words, without)
        logits = (self.weights[index].sum(axis=0) + self.weights[-2] + strange * self.weights[-1]) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def index_cues(self) -> None:
        """Find the cues by the weights, and the templates' bigrams of each family."""
        gain = self.weights[:-2, :-1] - self.weights[:-2, -1:]
        order = np.sort(gain, axis=1)
        for gram, at in self.features.items():
            top = order[at, -1]
            if top >= CUE:
                self.cues[gram] = (float(top), int(gain[at].argmax()) if top - order[at, -2] >= OWN else -1)
        self.shared = [frozenset(g for t in templates(f) for g in bigrams(t)) for f in self.families]
        #: What cues must outweigh for a window to be named.
        bias = self.weights[-2] + np.minimum(0, self.weights[-1])
        self.least = float(max(0.0, (self.weights[-2, -1] + min(0.0, self.weights[-1, -1])) - (self.weights[-2, :-1] + np.maximum(0, self.weights[-1, :-1])).max())) if len(bias) else 0.0

    def windows(self, words: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """(first, end, places of cues) of runs of cues that may outweigh unknown."""
        cues, run, weight = self.cues, [], 0.0
        seen: set = set()
        for i, word in enumerate([*words, None]):
            hit = word is not None and (word in cues or (i + 1 < len(words) and (word, words[i + 1]) in cues))
            if run and (word is None or i - run[-1] > GAP):
                if weight > self.least:
                    yield run[0], min(len(words), run[-1] + 2), run
                run, weight, seen = [], 0.0, set()
            if hit:
                run.append(i)
                for g in (word, (word, words[i + 1]) if i + 1 < len(words) else None):
                    if g in cues and g not in seen:
                        seen.add(g)
                        weight += cues[g][0]

    def find(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(family, score, first word, end) of the licence windows of a paragraph of any length."""
        marked, found = [FIRST, *words, LAST], []
        for first, end, places in self.windows(marked):
            own: dict[int, list] = {}
            at: dict[int, list[int]] = {}
            for i in places:
                for g in (marked[i], (marked[i], marked[i + 1]) if i + 1 < len(marked) else None):
                    if g in self.cues and (k := self.cues[g][1]) >= 0:
                        own.setdefault(k, []).append(g)
                        at.setdefault(k, []).append(i)
            judged = marked[max(0, first - AROUND) : end + AROUND]
            p = self.probabilities(judged)
            named = {int(p.argmax()): float(p.max())}
            for k in own if len(own) > 1 else ():
                near = {i + d for j, places_ in at.items() if j != k for i in places_ for d in (-1, 0, 1)}
                if near >= set(at[k]):  # part of another family's name
                    continue
                p = self.probabilities(judged, {g for j, grams in own.items() if j != k for g in grams})
                if int(p.argmax()) == k:  # a family is named besides by its own cues
                    named[k] = max(float(p[k]), named.get(k, 0.0))
            named.pop(len(self.families), None)
            sure = max(named.values(), default=0.0) >= 0.9
            for best, p in named.items():
                if len(named) == 1 or best not in at:
                    a, b = first, end
                else:
                    a, b = min(at[best]), max(at[best]) + 2
                a, b = max(a, 1) - 1, min(b, len(marked) - 1) - 1
                pairs = set(bigrams(words[a:b]))
                share = len(pairs & self.shared[best])
                if share < min(ENOUGH, CONFIRMED * max(1, len(pairs))):
                    p *= UNSHARED + (1 - UNSHARED) * share / max(1, len(pairs))
                if p >= (BESIDES if sure else CONFIDENT) and b > a:
                    found.append((self.families[best], p, a, b))
        return sorted(found, key=lambda x: (x[2], x[3]))


def _variants(words: list[str], rng: np.random.Generator) -> list[list[str]]:
    """A notice or grant, whole, with words lost, and cut at either end."""
    out = [words]
    for _ in range(VARIANTS):
        kept = [w for w in words if rng.random() > 0.08] or words
        if rng.random() < 0.4 and len(kept) > 8:
            cut = int(len(kept) * rng.uniform(0.3, 0.9))
            kept = kept[:cut] if rng.random() < 0.5 else kept[cut:]
        out.append(kept)
    return out


def _invented(rng: np.random.Generator) -> str:
    """The name of a licence that there isn't."""
    syllables = ["zor", "vex", "plim", "tar", "quo", "ner", "bal", "mi", "osk", "ul", "gra", "phe"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(2, 4)))).capitalize()
    kinds = ["{} License", "{} Public License", "{} {} License", "{} General License, version 3", "{} License 2.0", "{} v2", "{} Free Software License"]
    return str(rng.choice(kinds)).format(word(), word())


def _between(words: list[str], corpus: list[list[str]], rng: np.random.Generator) -> list[str]:
    """Words as they stand inside a longer paragraph."""
    some = lambda: list(corpus[int(rng.integers(len(corpus)))][: int(rng.integers(1, AROUND + 1))]) if corpus else []
    return [*some(), *words, *some()]


def training_rows(corpus: list[list[str]], apart: bool) -> list[tuple[list[str], str, str]]:
    """(words, family or unknown, kind of row); with ``apart`` those for calibration.  All rows of a kind weigh as much as those of another."""
    rng = np.random.default_rng(23 if apart else 11)
    whole = lambda w: [FIRST, *w, LAST]
    inside = lambda w: _between(w, corpus[apart::2], rng)
    rows: list[tuple[list[str], str, str]] = []
    for family in sorted(NAMES):
        names = NAMES[family] + SPDX[family]
        if apart:
            grants = [words_of(f.format(n)) for n in NAMES[family] for f in APART]
            positive = [x for g in grants for x in (whole(g), inside(g))] + [inside(w) for n in NOTICES[family] for w in _variants(words_of(n), rng)[1:]]
            titles: list[list[str]] = []
        else:
            grants = [words_of(f.format(n)) for n in names for f in FORMS] + [words_of(f"SPDX-License-Identifier: {i}") for i in SPDX[family]]
            positive = [x for g in grants for x in (whole(g), inside(g), inside(g), [FIRST, *g, *inside([])], [*inside([]), *g, LAST])]
            positive += [x for n in NOTICES[family] for v in _variants(words_of(n), rng) for x in (v, whole(v), inside(v), [FIRST, *v, *inside([])], [*inside([]), *v, LAST])]
            positive += [x for n in NAMES[family] for w in (["under", "the", *words_of(n)], ["under", *words_of(n)]) for x in (w, inside(w), [*inside(w), LAST])]
            lists = [words_of(f"Licensed under {x}".format(n)) for n in names for x in LISTS]
            positive += [inside(x) for x in lists]
            titles = [v for n in names for v in (whole(words_of(n)), whole(["the", *words_of(n)]), [FIRST, *words_of(n), "or", LAST], [FIRST, "or", *words_of(n), LAST])]
            # a later version, a word lost or another one in its place
            titles += [whole([*words_of(n), "or", "later"]) for n in names]
            odd = lambda w, i: [w[:i] + w[i + 1 :], [*w[:i], "other", *w[i + 1 :]]]
            titles += [whole(x) for n in NAMES[family] for w in [words_of(n)] if len(w) > 3 for i in range(1, len(w)) for x in odd(w, i)]
        rows += [(w, family, family) for w in positive] + [(w, family, f"title of {family}") for w in titles]
        for n in NAMES[family]:
            mentions, denials = (MENTIONS[::2], DENIALS[::2]) if apart else (MENTIONS, DENIALS)
            rows += [(x, "unknown", "mention of " + family) for m in mentions for x in (whole(words_of(m.format(n))), inside(words_of(m.format(n))))]
            rows += [(x, "unknown", "denial of " + family) for m in denials for x in (whole(words_of(m.format(n))), inside(words_of(m.format(n))))]
            # a name is a grant by itself only where it is a paragraph of its own
            w = words_of(n)
            rows += [(x, "unknown", "name of " + family) for x in (inside(w), [FIRST, *w, *inside([])], [FIRST, "the", *w, *inside([])])]
            rows.append((list(rng.permutation(words_of(FORMS[0].format(n)))), "unknown", "disorder"))
    names = UNSEEN if apart else [_invented(rng) for _ in range(150)]
    rows += [(x, "unknown", "other licence") for n in names for f in (APART if apart else FORMS) for x in (whole(words_of(f.format(n))), inside(words_of(f.format(n))))] + [(whole(words_of(n)), "unknown", "other licence") for n in names]
    rows += [(x, "unknown", "no licence") for f in FORMS + MENTIONS + DENIALS + NAMELESS for x in (whole(words_of(f.format(""))), inside(words_of(f.format(""))))]
    return rows + [(w, "unknown", "corpus") for w in corpus[apart::2]]


def _even(kinds: list[str]) -> np.ndarray:
    """Weights of rows that give each kind the same total, but grants of a family three times as much, as there are three kinds against them."""
    names, kind, counts = np.unique(kinds, return_inverse=True, return_counts=True)
    share = np.where(np.isin(names, list(NAMES)), 3, 1) / counts
    return share[kind] / len(counts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class _Rows:
    """Rows of a sparse 0/1 matrix: features by row, and the same by feature."""

    features: np.ndarray
    row_ends: np.ndarray
    strange: np.ndarray

    @classmethod
    def of(cls, model: Classifier, rows: list[list[str]]) -> _Rows:
        found = [model.index_of(r) for r in rows]
        return cls(np.array([i for index, _ in found for i in index], dtype=np.int64), np.cumsum([len(index) for index, _ in found]), np.array([s for _, s in found]))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        sums = np.vstack([np.zeros(weights.shape[1]), np.cumsum(weights[self.features], axis=0)])
        own = sums[self.row_ends] - sums[np.concatenate([[0], self.row_ends[:-1]])]
        return own + weights[-2] + self.strange[:, None] * weights[-1]

    def gradient(self, delta: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        out = np.zeros(shape)
        row = np.repeat(np.arange(len(self.row_ends)), np.diff(self.row_ends, prepend=0))
        order = np.argsort(self.features, kind="stable")
        sorted_ = self.features[order]
        first = np.flatnonzero(np.r_[True, np.diff(sorted_) != 0]) if len(order) else np.zeros(0, dtype=int)
        if len(first):
            out[sorted_[first]] = np.add.reduceat(delta[row[order]], first, axis=0)
        out[-2] = delta.sum(axis=0)
        out[-1] = (self.strange[:, None] * delta).sum(axis=0)
        return out


def fit(windows: list[str]) -> Classifier:
    """Classifier from the templates, the forms and a sample of the corpus's windows."""
    model = Classifier(sorted(NAMES))
    corpus = [w for w in map(words_of, windows) if w]
    # windows of the corpus that speak of licences say nothing about what is none
    named = frozenset(g for f in model.families for n in NAMES[f] + NOTICES[f] for g in bigrams(words_of(n)))
    corpus = [w for w in corpus if len(named & set(bigrams(w))) < 2]
    rows, apart = training_rows(corpus, False), training_rows(corpus, True)
    # n-grams of what is said about licences, for and against; words of the corpus are strange
    plain = {g for w in corpus for g in (*w, *bigrams(w))} - named
    own = [w for w, label, kind in rows if label != "unknown" or kind == "disorder"] + [words_of(m.format("")) for m in MENTIONS + DENIALS + FORMS]
    said = {g for m in MENTIONS + DENIALS for n in ("mit license", "gpl", "") for g in (*words_of(m.format(n)), *bigrams(words_of(m.format(n))))}
    fixed = {g for f in model.families for t in (*templates(f), *map(words_of, NAMES[f] + SPDX[f])) for g in (*t, *bigrams(t))} | said | {FIRST, LAST}
    known = {g for w in own for g in (*w, *bigrams(w))}
    known = {g for g in known if g in fixed or (g not in plain and (isinstance(g, str) or FIRST in g or LAST in g)) and all(x in fixed for x in ((g,) if isinstance(g, str) else g))}
    model.features = {g: i for i, g in enumerate(sorted(g for g in known if isinstance(g, str)) + sorted(g for g in known if not isinstance(g, str)))}
    classes = [*model.families, "unknown"]
    shape = (len(model.features) + 2, len(classes))
    model.weights = np.zeros(shape)
    x, share = _Rows.of(model, [w for w, _, _ in rows]), _even([kind for _, _, kind in rows])
    target, velocity = np.eye(len(classes))[[classes.index(label) for _, label, _ in rows]], np.zeros(shape)
    for _ in range(150):
        gradient = x.gradient((_softmax(x.logits(model.weights)) - target) * share[:, None], shape) + 1e-6 * model.weights
        velocity = 0.9 * velocity - 4.0 * gradient
        model.weights += velocity
    z, wanted = _Rows.of(model, [w for w, _, _ in apart]).logits(model.weights), np.array([classes.index(label) for _, label, _ in apart])
    weight = _even([kind for _, _, kind in apart])
    loss = lambda t: -float((np.log(_softmax(z / t)[np.arange(len(z)), wanted].clip(1e-12)) * weight).sum())
    model.temperature = min(np.geomspace(0.05, 4, 40).tolist(), key=loss)
    model.index_cues()
    return model


def sample_windows(docs: DataFrame, size: int = SAMPLE_WINDOWS, words: int = WINDOW_WORDS) -> list[str]:
    """``size`` windows of ``words`` words from as many documents, all chosen by hash of id and text, in order."""
    n = docs.count()
    mixed = F.xxhash64("text", "doc_id")
    picked = docs.where(F.col("text").isNotNull() & (F.pmod(mixed, F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, 2 * size / max(1, n)))))
    parts = F.split("text", "[ \n]+")
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.size(parts) - F.lit(words - 1))) + 1
    rows = picked.select(mixed.alias("mixed"), F.array_join(F.slice(parts, begin.cast("int"), words), " ").alias("window")).orderBy("mixed", "window").limit(size)
    return [r["window"] for r in rows.collect()]  # bounded by size and words


def license_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-separated), score (highest), findings of every row.

    ``findings`` lists paragraph, family, score, and the first word and end of each span.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(sample_windows(own)))
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                paragraphs = paragraphs_of(text)
                found = [{"paragraph": k, "family": f, "score": p, "first_word": a, "end_word": b} for k, w in enumerate(paragraphs) for f, p, a, b in find(w)]
                rows.append((len(paragraphs), len({x["paragraph"] for x in found}), ",".join(sorted({x["family"] for x in found})), max((x["score"] for x in found), default=0.0), found))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3], pa.float64()), pa.array(columns[4], kind)],
                names=["doc_id", "n_paragraphs", "n_licensed", "families", "score", "findings"],
            )

    schema = "doc_id long, n_paragraphs long, n_licensed long, families string, score double, findings array<struct<paragraph:long,family:string,score:double,first_word:long,end_word:long>>"
    return own.mapInArrow(run, schema)
