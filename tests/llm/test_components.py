from __future__ import annotations

import random

from tidewatch.llm.components import components


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)] + [(500, 500), (None, 3)]
    mesh = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    pairs = chain + star + mesh
    for a, b in pairs:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(frame.where("false")).count() == 0
