from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from brute import frame, sample_texts, with_repeats

from tidewatch.llm import simhash


def plain_fingerprint(text):
    """Bit by bit, as the definition reads."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    n = min(4, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(codes: list[int], distance: int) -> list[int]:
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints():
    for text in sample_texts():
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 4])
@pytest.mark.parametrize("split", [False, True])
def test_forest_finds_every_link(distance, split):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(40)]
    codes = list(dict.fromkeys(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)))
    both = np.array(codes, np.uint64)
    if split:
        parts = [(both[::2], None), (both[1::2], None), (both[::2], both[1::2])]
    else:
        parts = [(both, None)]
    root = {c: c for c in codes}
    for left, right in parts:
        ordered = [None if x is None else simhash._gray_order(x) for x in (left, right)]
        for a, b in zip(*simhash.forest(*ordered, distance)):
            ra, rb = root[int(a)], root[int(b)]
            root = {c: ra if r == rb else r for c, r in root.items()}
    want = plain_components(codes, distance)
    assert len(set(root.values())) == len(set(want))
    assert len(set(zip(want, (root[c] for c in codes)))) == len(set(want))


@pytest.mark.parametrize("run", [simhash.RUN, 16])
def test_links_in_one_run_or_many(spark, run):
    rng = random.Random(5)
    hub = rng.getrandbits(63)
    codes = {hub ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(700)}
    codes |= {rng.getrandbits(63) for _ in range(300)}
    codes = sorted(codes)
    found = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"), 4, run).collect()
    root = plain_components(codes, 4)
    place = {c: i for i, c in enumerate(codes)}
    own = list(range(len(codes)))
    for a, b in ((place[r.a], place[r.b]) for r in found):
        ra, rb = own[a], own[b]
        own = [min(ra, rb) if r in (ra, rb) else r for r in own]
    assert own == root


def test_classes_and_deduplicate(spark):
    texts = sample_texts()
    docs = frame(spark, texts)
    want = plain_components([plain_fingerprint(t) for t in texts], 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {i: (plain_fingerprint(t), want[i]) for i, t in enumerate(texts)}
    kept = simhash.deduplicate(with_repeats(spark, texts))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want))
    assert ids.count(None) == 1  # "no id at all" is unlike the rest; the null text without an id has doc 0 before it


def test_empty_table(spark):
    docs = frame(spark, [])
    assert simhash.classes(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0
