"""License notices in documents: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into words, and of each run of word n-grams the one with the least hash is a fingerprint in
an inverted index (n-gram -> template and place). The index is as small as the templates and goes to every
task. All n-grams of a document are looked up, so a notice of enough words can't be missed by the choice of
fingerprints on the document's side. Hits whose places in template and document run along nearby diagonals
are one candidate, and an alignment within a band around them says how many words of the template are there in
order, and where. Candidates that reach the coverage are reported if their distinguishing words (version, variant,
family; inserted ones too) are those of the template; of overlapping ones of different templates that share
their words all are.

The templates are notices of the common licenses in their versions, and whole texts only of MIT and ISC (without title
and copyright line). Of the long texts (GPL, LGPL, AGPL, Apache, MPL, CC) there is at most the beginning of the preamble.

Words are runs of ASCII letters and digits in either case. Spans are code points of the text, end exclusive.
Null text counts as empty; a null doc_id is kept; repeated rows are reported each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import packed, text_or_empty

GRAM = 3
WINNOW = 4
COVERAGE = 0.8
WORD = re.compile(rb"[a-z0-9]+")

# Notices by which common public licenses are declared.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "CC0-1.0-waiver": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work"
    ),
    "GPL-2.0-preamble": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, "
        "the GNU General Public License is intended to guarantee your freedom to share and change free software--to "
        "make sure the software is free for all its users."
    ),
    "GPL-3.0-preamble": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses "
        "for most software and other practical works are designed to take away your freedom to share and change the works."
    ),
    "AGPL-3.0-preamble": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software."
    ),
}

_GNU = [
    ("GPL", "1.0", "General"), ("GPL", "2.0", "General"), ("GPL", "3.0", "General"), ("LGPL", "2.0", "Library General"),
    ("LGPL", "2.1", "Lesser General"), ("LGPL", "3.0", "Lesser General"), ("AGPL", "3.0", "Affero General"),
]
for _name, _version, _kind in _GNU:
    _short = _version.removesuffix(".0")
    TEMPLATES.setdefault(f"{_name}-{_version}", f"This work is licensed under the GNU {_kind} Public License, version {_short}.")
    for _thing in ("program", "library"):
        TEMPLATES[f"{_name}-{_version}-{_thing}-notice"] = (
            f"This {_thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind} "
            f"Public License as published by the Free Software Foundation, either version {_short} of the License, or (at "
            "your option) any later version"
        )
for _version, _scope in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
    for _code, _kind in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ):
        TEMPLATES.setdefault(f"CC-{_code}-{_version}-short", f"Licensed under CC {_code} {_version}.")
        TEMPLATES.setdefault(f"CC-{_code}-{_version}", f"This work is licensed under a Creative Commons {_kind} {_version} {_scope} License.")
# These two names already stand for one of the two forms.
TEMPLATES["CC-BY-NC-4.0-notice"] = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
del TEMPLATES["CC-BY-NC-4.0-short"]

# Words that tell a license from its relatives; they must be the same in notice and template.
VARIANTS = frozenset(
    b"lesser library affero gpl lgpl agpl apache mit bsd isc mozilla cc cc0 nc nd sa noncommercial noderivatives noderivs "
    b"sharealike".split()
)


def marks_of(words: list[bytes], numbered: bool) -> set[bytes]:
    """The distinguishing words; of numbers those of versions, where 2 and 2.0 are the same."""
    return {w for w in words if w in VARIANTS or numbered and len(w) <= 2 and w.isdigit() and w != b"0"}


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower())


@dataclass
class Index:
    """Templates as word numbers, and their winnowed fingerprints."""

    names: list[str]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    templates: list[np.ndarray] = field(default_factory=list)
    marks: list[set[bytes]] = field(default_factory=list)
    numbered: list[bool] = field(default_factory=list)
    places: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """One number per n-gram; zero where a word is in no template."""
        n = len(codes) - GRAM + 1
        if n < 1:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(GRAM):
            part = codes[i : i + n]
            out = out * (len(self.vocabulary) + 1) + part
            known &= part > 0
        return np.where(known, out, 0)


def build(templates: Mapping[str, str] = TEMPLATES) -> Index:
    index = Index(list(templates))
    split = [words_of(t) for t in templates.values()]
    for word in (w for words in split for w in words):
        index.vocabulary.setdefault(word, len(index.vocabulary) + 1)
    for number, words in enumerate(split):
        codes = np.array([index.vocabulary[w] for w in words], np.int64)
        index.templates.append(codes)
        index.numbered.append(any(w.isdigit() for w in words))
        index.marks.append(marks_of(words, True))
        grams = index.grams(codes).tolist()
        order = [zlib.crc32(str(g).encode()) for g in grams]
        chosen = set()
        for at in range(max(1, len(grams) - WINNOW + 1)):
            run = range(at, min(at + WINNOW, len(grams)))
            if run:
                chosen.add(min(run, key=lambda i: (order[i], -i)))
        for at in sorted(chosen):
            index.places[grams[at]].append((number, at))
    return index


def align(template: np.ndarray, codes: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most template words found in order within `band` of a diagonal, and the first and last word used.

    Row by row over the template: the best count at each shift from the diagonal, where a word of the
    document may be passed over within the row and a word of the template between rows.
    """
    width = 2 * band + 1
    best, first, last = np.zeros(width, int), np.full(width, -1), np.full(width, -1)
    for i, word in enumerate(template):
        at = diagonal + i - band + np.arange(width)
        inside = (at >= 0) & (at < len(codes))
        equal = inside & (codes[np.clip(at, 0, len(codes) - 1)] == word)
        new, begin, end = best + equal, np.where(equal & (best == 0), at, first), np.where(equal, at, last)
        # Passing over a template word keeps the document's place, one shift higher.
        for s in range(width - 1):
            if best[s + 1] > new[s]:
                new[s], begin[s], end[s] = best[s + 1], first[s + 1], last[s + 1]
        for s in range(1, width):
            if new[s - 1] > new[s]:
                new[s], begin[s], end[s] = new[s - 1], begin[s - 1], end[s - 1]
        best, first, last = new, begin, end
    at = int(best.argmax())
    return int(best[at]), int(first[at]), int(last[at])


def agrees(index: Index, number: int, words: list[bytes], first: int, last: int, raw: bytes, ends: list[tuple[int, int]]) -> bool:
    """Whether the span has the template's distinguishing words and no others, whatever else it has or lacks."""
    span = words[first : last + 1]
    # A version may go on behind the span: 2.1 is not 2.
    if last + 1 < len(words) and words[last].isdigit() and words[last + 1].isdigit() and raw[ends[last][1] : ends[last + 1][0]] == b".":
        span = [*span, words[last + 1]]
    return marks_of(span, index.numbered[number]) == index.marks[number]


def find(index: Index, text: str, coverage: float = COVERAGE) -> list[tuple[str, int, int, float]]:
    """(name, start, end, coverage) of every notice, by place."""
    raw = text.encode("utf-8", "replace").lower()
    words = WORD.findall(raw)
    codes = np.fromiter(map(index.vocabulary.get, words, repeat(0)), np.int64, len(words))
    grams = index.grams(codes)
    hits = defaultdict(set)
    for at in np.nonzero(grams)[0].tolist():
        for number, place in index.places.get(int(grams[at]), ()):
            hits[number].add(at - place)
    if not hits:
        return []
    ends = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    out = []
    for number, diagonals in sorted(hits.items()):
        template = index.templates[number]
        band = max(2, len(template) // 6)
        ordered, begin = sorted(diagonals), None
        done = set()
        for d in ordered:
            if begin is None or d - begin > band:
                begin = d
                # No alignment has more words than the template has in this stretch.
                near = codes[max(0, d + band // 2 - band) : max(0, d + band // 2 + band + len(template))]
                if np.isin(template, near).sum() < coverage * len(template):
                    continue
                n, first, last = align(template, codes, d + band // 2, band)
                if n >= coverage * len(template) and (first, last) not in done and agrees(index, number, words, first, last, raw, ends):
                    done.add((first, last))
                    out.append((index.names[number], first, last, n / len(template)))
    if not out:
        return []
    point = lambda byte: len(raw[:byte].decode("utf-8", "ignore"))
    if len(raw) == len(text):
        point = int
    return sorted(
        ((name, point(ends[first][0]), point(ends[last][1]), share) for name, first, last, share in out),
        key=lambda x: (x[1], x[2], x[0]),
    )


MATCHES = "array<struct<license:string,s:long,e:long,coverage:double>>"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Each row as `doc`, with `matches` (license, s, e, coverage) by place."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(templates))

    @F.pandas_udf(MATCHES)
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = build(sent.value)
        for texts in batches:
            found = ([dict(zip(("license", "s", "e", "coverage"), m)) for m in find(index, t, coverage)] for t in texts)
            yield pd.Series(list(found), dtype=object)

    return packed(docs).select("doc", matches(text_or_empty("doc.text")).alias("matches"))
