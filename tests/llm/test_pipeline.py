from __future__ import annotations

import random
import re

import pytest
from brute import words

import corpus_pipeline
from tidewatch.llm import packing, quality, secrets, simhash, tokens


def corpus():
    rng = random.Random(8)
    good = [" ".join(words(rng, rng.randint(40, 120))) + "." for _ in range(70)]
    junk = [" ".join(w.upper() + "!!" for w in words(rng, 30)) for _ in range(40)]
    copies = [good[i].replace(" ", "  ") for i in range(6)]
    near = []
    for i in range(6, 30):
        w = good[i].split(" ")
        w[rng.randrange(len(w))] = "other"
        near.append(" ".join(w))
    leaks = [good[i] + f"\npassword = hunter{i}hunter{i} and done {i}" for i in range(30, 34)]
    return [*good, *junk, *copies, *near, *leaks], len(good)


def near_classes(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    codes = {i: simhash.fingerprint(t) % 2**64 for i, t in rows}
    for i in codes:
        for j in codes:
            if i < j and (codes[i] ^ codes[j]).bit_count() <= simhash.DISTANCE:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in codes}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    texts, n_good = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < n_good), 0) for i in range(n_good + 40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_the_whole_pipeline_equals_its_stages_by_hand(spark, tables):
    path, texts = tables
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert set(range(70)) <= good and not good & set(range(70, 110))
    bare: dict[str, tuple] = {}
    for i in sorted(good):
        key = re.sub(r"[ \t\n\v\f\r]", "", texts[i])
        bare[key] = min(bare.get(key, (0, i)), (-len(texts[i]), i))
    left = [(i, texts[i]) for _, i in sorted(bare.values())]
    root = near_classes(left)
    left = [(i, t) for i, t in left if root[i] == i]
    want = {}
    encode = tokens.byte_tokenizer(tokens.read(tokens.BYTES)).encode
    for i, t in left:
        spans = sorted(s for rule in secrets.RULES for s in secrets.find(rule, t))
        for s, e in reversed(spans):
            t = t[:s] + "[removed]" + t[e:]
        want[i] = len(encode(t)) + 1
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want
    assert sum(r.length for r in out) == sum(want.values())
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_stages_keep_the_columns_of_documents(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, path).columns == docs.columns


def test_empty_documents(spark, tables, tmp_path):
    path, _ = tables
    spark.read.parquet(f"{path}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
