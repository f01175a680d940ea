from __future__ import annotations

import math

import numpy as np
import pytest

from tidewatch.llm import graphs

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def plain(rows, top=graphs.TOP):
    """query_id to its nearest (distance, vec_id), over all rows."""
    width = max((len(v) for _, v in rows if v), default=0)
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        kept.append((i, np.float32(list(v) + [0.0] * (width - len(v))).astype(float)))
    queries = {}
    for i, v in kept:
        if i % 100 == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    out = {}
    for q, w in queries.items():
        out[q] = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, v in kept if i != q)[:top]
    return out


def found(frame, **settings):
    out = {}
    for r in graphs.nearest(graphs.index(frame), frame.where("vec_id % 100 = 0"), **settings).orderBy("query_id", "rank").collect():
        of = out.setdefault(r.query_id, [])
        of.append((r.score, r.vec_id))
        assert r["rank"] == len(of)
    return out


def clustered(rng, n, width=24):
    centers = rng.normal(size=(12, width))
    return (centers[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, width))).round(4)


@pytest.mark.parametrize("shard, block", [(graphs.SHARD, graphs.BLOCK), (150, 7)])
def test_recall_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(graphs, "SHARD", shard)
    rng = np.random.default_rng(1)
    rows = list(enumerate(clustered(rng, 3000).tolist()))
    rows += [(3000 + i, [0.5] * 24) for i in range(1500)]  # one common vector
    rows += [(4500 + i, (np.array([2.0] * 24) + 1e-3 * rng.normal(size=24)).tolist()) for i in range(500)]  # near copies
    rows += [(5000, None), (5100, [1.0, None]), (5200, [float("nan")]), (5300, [float("inf")] * 24), (5400, [0.0] * 24)]
    rows += [(None, [1.0] * 24), (5500, []), (5600, [2.0, -1.0]), (100, [9.0] * 24), (7, [0.1] * 24), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA).repartition(3)
    got, want = found(frame, block=block), plain(rows)
    assert set(got) == set(want)
    assert all(len(got[q]) == len(want[q]) and got[q] == sorted(got[q]) for q in want)
    hits = sum(sum(any(i == j and abs(d - e) < 1e-9 for e, j in want[q]) for d, i in got[q]) for q in want)
    assert hits / sum(map(len, want.values())) > 0.97
    # Copies are found by their least ids.
    assert [i for _, i in got[3100]] == list(range(3000, 3010))


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1e30, 0.0]), (4, [1e-30, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA)
    got, want = found(frame), plain(rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert np.allclose([d for v in got.values() for d, _ in v], [d for v in want.values() for d, _ in v], rtol=1e-12)
    assert found(frame.where("false")) == {} and found(frame.where("vec_id = 2")) == {}
    assert found(frame.where("vec_id = 0")) == {}


def test_graph_is_hierarchical_and_flat():
    rng = np.random.default_rng(2)
    vectors = clustered(rng, 4000)
    graph = graphs.build(np.arange(4000), vectors)
    assert graph.layers[0] == 4000 and list(graph.layers) == sorted(graph.layers, reverse=True) and len(graph.layers) > 2
    assert len(graph.neighbours) == sum(n * graphs._links(k) for k, n in enumerate(graph.layers))
    for k, n in enumerate(graph.layers):
        links = graph.links(k)
        assert links.max() < n and all((row[row >= 0] != i).all() for i, row in enumerate(links))
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in links)
    # Searching looks at few of the nodes: links are followed from the first node down.
    assert (graphs._follow(graph, graph.links(0), graph.near[:5], np.zeros((5, 1), np.int32), 8) >= 0).all()


def test_a_closed_part_of_a_graph_is_left():
    vectors = np.random.default_rng(3).normal(size=(400, 8))
    graph = graphs.build(np.arange(400), vectors)
    graph.neighbours = np.full_like(graph.neighbours, -1)
    near = graphs.search(graph, vectors[:3], beam=20)
    want = np.argsort(((graph.vectors[None] - vectors[:3, None]) ** 2).sum(2), axis=1)[:, :20]
    assert [set(a) for a in near] == [set(b) for b in want]
