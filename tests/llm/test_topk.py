from __future__ import annotations

import math

import numpy as np
import pytest

from tidewatch.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def plain(rows, top):
    def weights(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * float(np.float32(x))) for x in v]

    usable = [(i, weights(v)) for i, v in rows if i is not None and weights(v) is not None]
    queries = {}
    for i, w in usable:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, w), w)
    out = []
    for q, w in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:top]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block, shard", [(topk.BLOCK, topk.SHARD), (3, 16)])
def test_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 12) for i in range(100)]  # one common vector: ties
    rows += [(400 + i, [0.0] * 11 + [float(i)]) for i in range(30)]  # few postings
    rows += [(450, None), (500, [1.0, None]), (550, [float("nan")]), (600, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(650, []), (700, [2.0, -1.0]), (750, [1.0] * 15), (150, [9.0] * 12), (7, [0.1] * 12), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA)
    got = topk.top_k(frame, frame.where("vec_id % 50 = 0"), block=block).collect()
    exact = [(i, None if v is None else v) for i, v in rows]
    assert sorted(tuple(r) for r in got) == plain(exact, topk.TOP)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(frame.where("false"), frame.where("false")).count() == 0
    assert topk.top_k(frame, frame.where("false")).count() == 0


def test_probing_leaves_out_no_winner():
    rng = np.random.default_rng(3)
    weights = np.where(rng.random((40, 2000)) < 0.2, rng.integers(-300, 300, (40, 2000)), 0)
    shard = topk.Shard(np.arange(2000), weights)
    for scale in (1, 1 << 40):
        query = np.where(rng.random(40) < 0.5, rng.integers(-300, 300, 40), 0) * scale
        score = np.array([sum(int(a) * int(b) for a, b in zip(query, w)) for w in weights.T])
        for bar in (None, int(np.sort(score)[-50]), int(score.max())):
            ids, found = topk.search(shard, 7, query, bar)
            want = [i for i in range(2000) if i != 7 and (bar is None or score[i] >= bar)]
            if bar is None:
                assert ids.tolist() == want
            assert set(want) == set(ids.tolist())
            assert found.tolist() == score[ids].tolist()
