from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, position int"


def plain(rows, width, rounds=codebooks.ROUNDS):
    """(vec_id, code, error, label_error, sha) by the definition, in Python integers."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (width - len(v))
        kept.append((i, tuple(w), label))
    least = {}
    for i, w, _ in kept:
        if i is not None:
            least[i] = min(least.get(i, w), w)
    seeds = [least[i] for i in sorted(least)[:16]]
    n = width // 8
    cut = lambda w, p: w[p * n : (p + 1) * n]
    books = [[cut(w, p) for w in seeds] for p in range(8)]

    def near(book, part):
        away = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(8):
            members = defaultdict(list)
            for _, w, _ in kept:
                members[near(books[p], cut(w, p))[0]].append(cut(w, p))
            books[p] = [
                tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if members[e] else books[p][e]
                for e in range(len(books[p]))
            ]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for i, w, label in kept:
        found = [near(books[p], cut(w, p)) for p in range(8)]
        error = sum(d for _, d in found)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("owner_rows", [codebooks.OWNER_ROWS, 7])
def test_equals_definition(spark, owner_rows, monkeypatch):
    monkeypatch.setattr(codebooks.train, "__defaults__", (8, 16, 6, owner_rows))
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(3).tolist(), int(rng.integers(4))) for i in range(300)]
    rows += [(300 + i, [0.25] * 16, None) for i in range(150)]  # one common vector
    rows += [(i + 500, rng.choice([0.0, 0.5, -0.5], 16).tolist(), 9) for i in range(60)]  # ties
    rows += [(700, None, 1), (701, [1.0, None], 1), (702, [float("nan")] * 16, 1), (703, [float("inf")], 1)]
    rows += [(704, [], 2), (705, [0.5] * 5, 2), (None, [0.1] * 16, 3), (3, [-9.0] * 16, 3), (7, rows[7][1], 3), (7, rows[7][1], 3)]
    frame = spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], SCHEMA).repartition(5)
    assert ordered(codebooks.compress(frame).collect()) == ordered(plain(rows, 16))


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(1, [1.0] * 8, 0, "c", 1), (2, [-1.0] * 8, None, "c", 1)], SCHEMA)
    assert ordered(codebooks.compress(frame).collect()) == ordered(plain([(1, [1.0] * 8, 0), (2, [-1.0] * 8, None)], 8))
    assert codebooks.compress(frame.where("false")).count() == 0
    assert codebooks.compress(spark.createDataFrame([(1, None, 0, "c", 1)], SCHEMA)).count() == 0


def test_members_move_only_when_their_entry_changes(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(codebooks, "shared_path", lambda _, name: written.append(str(tmp_path / name)) or written[-1])
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist(), 0, "c", 1) for i in range(500)]
    codebooks.train(spark.createDataFrame(rows, SCHEMA))
    counts = [spark.read.schema(codebooks.MEMBERS).parquet(p).count() for p in written]
    moved = spark.read.schema(codebooks.MEMBERS).parquet(*written[1:])
    assert counts[0] == 500 * 8 and all(0 < n < counts[0] / 2 for n in counts[1:])
    assert moved.where("origin = entry or origin < 0").isEmpty()


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 8, 0, "c", 1)], SCHEMA)
    with pytest.raises(ValueError, match="fit into a long"):
        codebooks.train(frame)
