from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from brute import frame, sample_texts, with_repeats

from tidewatch.llm import substrings


def plain(rows: list[bytes], length: int) -> list[tuple[int, list[list[int]], bytes]]:
    """Every start of every row, counted."""
    seen = Counter(r[i : i + length] for r in rows for i in range(len(r) - length + 1))
    out = []
    for r in rows:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]]))
        spans = [list(x) for x in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())]
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def shared_passages(seed: int) -> list[str]:
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [draw(rng.randint(20, 140)) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [draw(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            parts += [p[a : len(p) - rng.randint(0, 8)], draw(rng.randint(0, 50))]
        out.append("".join(parts))
    return [*out, "a" * 300, "ab" * 200, "xyz" * 9]


@pytest.mark.parametrize("length, gram, gathered", [(40, 8, 1024), (40, 16, 2), (60, 30, 1024), (41, 41, 3)])
def test_spans_of_shared_passages(spark, length, gram, gathered):
    docs = with_repeats(spark, [None, "", *shared_passages(length)])
    rows = docs.collect()
    want = plain([(r.text or "").encode() for r in rows], length)
    got = substrings.remove_repeats(docs, length, gram, gathered).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in got), key=key) == sorted(
        ((r.doc_id, *w) for r, w in zip(rows, want)), key=key
    )
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)


def test_default_length_on_long_texts(spark):
    docs = frame(spark, sample_texts())
    rows = docs.collect()
    want = plain([(r.text or "").encode() for r in rows], 400)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, texts=False).collect()}
    for r, (n, spans, kept) in zip(rows, want):
        assert (got[r.doc_id].n_bytes, got[r.doc_id].spans) == (n, spans)
        assert got[r.doc_id].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_chunks_of_a_long_text(monkeypatch):
    data = np.random.default_rng(1).integers(97, 99, 5000).astype(np.uint8)
    whole = substrings.anchors(data, 40, 8)
    monkeypatch.setattr(substrings, "CHUNK", 700)
    parts = substrings.anchors(data, 40, 8)
    def windows(found):
        return {p: (int(g), int(a)) for g, a, s, e in zip(*found) for p in range(s, e + 1)}
    assert windows(whole) == windows(parts)


def test_merge_sort_and_equal_hashes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    segment = np.sort(rng.integers(0, 20, 500))
    s = substrings.Suffixes(data, start, 30)
    order = s.sort(segment)
    text = [(int(g), data[p : p + 30].tobytes()) for g, p in zip(segment, start)]
    assert [text[i] for i in order] == sorted(text)
    times = Counter(text)
    want = [times[t] > 1 for t in text]
    assert s.repeated(segment).tolist() == want
    s.whole[:] = 0  # as if all strings had one hash
    assert s.repeated(segment).tolist() == want


def test_empty_table(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_a_worker_hands_contexts_on_in_bounded_pieces(monkeypatch):
    texts = pd.Series(shared_passages(3))
    batch = pd.DataFrame({"k1": range(len(texts)), "k2": 0, "text": texts})
    batch["shared"] = [np.unique(substrings.anchors(substrings._bytes(t), 40, 8)[0]) for t in texts]
    names = [c.split()[0] for c in substrings.OCCURRENCES.split(", ")]
    whole = pd.concat(substrings._occurrences(40, 8)([batch]), ignore_index=True)
    monkeypatch.setattr(substrings, "HANDED_ON", 1000, raising=False)
    parts = list(substrings._occurrences(40, 8)([batch]))
    assert len(parts) > 5 and max(p.context.dropna().map(len).sum() for p in parts) < 1000 + max(map(len, texts)) * 2
    got = pd.concat(parts, ignore_index=True)
    assert got[names].values.tolist() == whole[names].values.tolist()
    # Few windows in many bytes are bounded as well, with the same runs.
    classes = got.dropna(subset="context").sort_values("g", kind="stable").assign(times=1).reset_index(drop=True)
    calls, compare = [], substrings.compare

    def counted(rows, length):
        calls.append(int(rows.context.map(len).sum()))
        return compare(rows, length)

    monkeypatch.setattr(substrings, "compare", counted)
    at_once = pd.concat(substrings._comparer(40)([classes]))
    monkeypatch.setattr(substrings, "SORTED_BYTES", 500, raising=False)
    in_parts = pd.concat(substrings._comparer(40)([classes]))
    assert len(calls) > 3 and at_once.reset_index(drop=True).equals(in_parts.reset_index(drop=True))
