from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import frame, sample_texts, with_repeats
from tokenizers import Tokenizer

from tidewatch.llm import packing

WINDOW = 64


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    for n, window in [(0, 64), (1, 64), (3000, 64), (500, 2048)]:
        histogram = np.bincount(rng.integers(1, window + 1, n), minlength=window + 1)
        histogram[1] += n
        made = packing.plan(histogram, window)
        used = np.zeros(window + 1, int)
        for parts, times in made.made:
            assert times > 0 and sum(length * per for length, per in parts) <= window
            for length, per in parts:
                used[length] += per * times
        assert (used[1:] == histogram[1:]).all()
    assert made.by_squares > 0


def test_squares_find_an_exact_solution():
    columns = packing.combinations(np.arange(1, 33), 32)
    rng = np.random.default_rng(3)
    histogram = np.zeros(33)
    for c in rng.choice(len(columns), 12, replace=False):
        np.add.at(histogram, columns[c][columns[c] > 0], 100)
    x = packing.repeats(columns, histogram, rounds=500)
    made = np.zeros(33)
    for c in np.nonzero(x)[0]:
        np.add.at(made, columns[c][columns[c] > 0], x[c])
    assert (x >= 0).all() and np.abs(made - histogram).max() < 0.02 * histogram.max()


def test_every_id_lies_in_one_piece(spark, reference):
    docs = with_repeats(spark, [*sample_texts(), "<|endoftext|> x", "a<|endoftext|><|endoftext|>  b", *(["same short text"] * 300)])
    found = packing.pieces(docs, window=WINDOW, keep_ids=True)
    out = packing.pack(found, WINDOW).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append(reference(r.text))
    total = sum(len(x) for same in ids.values() for x in same)
    assert sum(r.length for r in out) == total
    for r in out:
        same = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        pieces = [np.array(x[r.start : r.start + r.length], "<u4").tobytes() for x in same]
        assert bytes(r.ids) in pieces and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        parts.sort()
        ends = [0, *(o + n for o, n in parts)]
        assert [o for o, _ in parts] == ends[:-1] and ends[-1] <= WINDOW
    assert total / (len(filled) * WINDOW) > 0.97
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    rows = packing.sequences(packing.pack(found, WINDOW), WINDOW).collect()
    assert sum(r.tokens for r in rows) == total and all(len(r.ids) in (WINDOW, r.tokens) for r in rows)


def test_very_long_white_space(spark, reference):
    texts = [" " * 1_000_000, "\n" * 1_000_000, ("x" + " " * 30_000) * 3, "ab" * 100_000 + "<|endoftext|>"]
    found = {r.doc_id: r for r in packing.pieces(frame(spark, texts)).where("start = 0").collect()}
    for i, text in enumerate(texts):
        ids = reference(text)
        assert found[i].doc_tokens == len(ids)
        assert found[i].ids_crc32 == zlib.crc32(np.array(ids[: packing.WINDOW], "<u4").tobytes())


def test_empty_table(spark):
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0
