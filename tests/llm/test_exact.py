from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from brute import frame, sample_texts, with_repeats

from tidewatch.llm import exact


@pytest.mark.parametrize("block", [exact.BLOCK, 3])
def test_groups(spark, block):
    texts = sample_texts()
    if block == 3:
        texts = [t for t in texts if len(t or "") < 2000]
    docs = with_repeats(spark, texts)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    bare = [re.sub(r"[ \t\n\v\f\r]", "", t) for _, t in rows]
    members = defaultdict(list)
    for (i, t), b in zip(rows, bare):
        members[b].append((-len(t), i is None, i or 0))
    got = exact.groups(docs, block).collect()
    want = []
    for (i, _), b in zip(rows, bare):
        first = min(members[b])
        want.append((i, None if first[1] else first[2], len(members[b]), hashlib.sha256(b.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    stay = [r for r in got if r.kept]
    assert len(stay) == len(members) and all(r.doc_id == r.keep_id for r in stay)
    kept = exact.deduplicate(docs, block)
    assert kept.columns == docs.columns and kept.count() == len(members)


def test_of_repeated_rows_the_same_stays_in_every_run(spark):
    rows = [(1, "same text", n, {"k": n}) for n in range(40)]
    kept = set()
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, place long, more map<string,int>").repartition(parts, "place")
        kept.add(exact.deduplicate(docs).first()["place"])
    assert len(kept) == 1


def test_long_text_without_white_space(spark):
    text = "é" * 200_000
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.groups(frame(spark, [text, text[:-1], text + " "])).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2)}


def test_empty_table(spark):
    docs = frame(spark, [])
    assert exact.groups(docs).count() == 0 and exact.deduplicate(docs).count() == 0
