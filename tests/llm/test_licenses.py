from __future__ import annotations

import random

import pytest
from brute import frame, words, with_repeats

from tidewatch.llm import licenses

INDEX = licenses.build()


def longest_common(template, found):
    """Words of the template that occur in order in the other list."""
    row = [0] * (len(found) + 1)
    for w in template:
        last = row
        row = [0]
        for j, x in enumerate(found):
            row.append(last[j] + 1 if w == x else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_a_notice_in_a_document_is_found_with_its_span(name):
    rng = random.Random(1)
    notice = licenses.TEMPLATES[name]
    before = "é\U0001f600 " + " ".join(words(rng, 50)) + "\n"
    text = before + notice.replace(" ", "\n * ").upper() + " " + " ".join(words(rng, 2000))
    found = {m[0]: m for m in licenses.find(INDEX, text)}
    _, s, e, share = found[name]
    assert share == 1.0
    assert licenses.words_of(text[s:e]) == licenses.words_of(notice)


def test_changed_words_lower_the_coverage():
    rng = random.Random(2)
    name = "MIT-permission"
    template = licenses.words_of(licenses.TEMPLATES[name])
    for _ in range(40):
        changed = [w.decode() for w in template]
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.choice([1, 1, 0])] = rng.choice([["extra"], []])
        shared = longest_common(template, [w.encode() for w in changed])
        found = {m[0]: m for m in licenses.find(INDEX, " ".join(["start", *changed, "end"]))}
        if name in found:
            assert found[name][3] <= shared / len(template) + 1e-9
            assert found[name][3] >= licenses.COVERAGE
        if shared >= 0.95 * len(template):
            assert found[name][3] == pytest.approx(shared / len(template))


def test_each_of_several_notices_and_no_false_ones():
    rng = random.Random(3)
    line = licenses.TEMPLATES["MIT"]
    text = "\n".join([line, " ".join(words(rng, 30)), line, line, licenses.TEMPLATES["CC-BY-NC-4.0"]])
    assert [m[0] for m in licenses.find(INDEX, text)] == ["MIT", "MIT", "MIT", "CC-BY-NC-4.0"]
    for clean in ("", "the license of this work is not known", "released under the moon", " ".join(words(rng, 5000))):
        assert licenses.find(INDEX, clean) == []


def test_a_table(spark):
    docs = with_repeats(spark, [None, "", "x" * 50_000, *[licenses.TEMPLATES["ISC"]] * 6])
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [m.license for m in r.matches] == (["ISC"] if r.doc.text and "Permission" in r.doc.text else [])
    assert licenses.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 2.0.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 9.", []),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0-short"]),
        ("Licensed under CC BY-NC-ND 3.0.", ["CC-BY-NC-ND-3.0-short"]),
        ("Licensed under CC0 1.0 Universal.", ["CC0-1.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
    ],
)
def test_version_and_variant_decide_between_relatives(text, want):
    for before, after in (("", ""), ("words before it. ", " 17 words after it")):
        assert [m[0] for m in licenses.find(INDEX, before + text + after)] == want
