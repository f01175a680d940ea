from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import frame, sample_texts, with_repeats
from pyspark.sql import functions as F

from tidewatch.llm import pieces

PATH = public_tokenizers.path(pieces.VOCABULARY)
library = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return pieces.Encoder(file.read())


def odd_texts():
    rng = random.Random(1)
    out = ["", "a", " ", "   ", "  a  b ", "\n\t", "▁▁x", "\x00", "日本語テキスト✓😀 mixed ñandú", "a" * 5000, "=" * 300 + " " * 70]
    out.append("".join(rng.choice("ab \n") for _ in range(20_000)))
    for _ in range(60):
        spots = [rng.randrange(32, 127), rng.randrange(160, 0x2500), rng.randrange(0x4E00, 0x9FFF), 0x1F600 + rng.randrange(60)]
        out.append("".join(chr(rng.choice(spots)) for _ in range(80)))
    return out


def test_ids_and_texts_equal_the_library(encoder):
    texts = odd_texts()
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
    for t in texts:
        assert encoder.decode(np.array(library.encode(t), np.int64)) == library.decode(library.encode(t))


def test_long_units_equal_the_library(encoder, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdetnors") for _ in range(n)) for n in (511, 512, 3000)]
    texts += ["日本語ab" * 400, "x" * 2000 + " y", "a b " * 10 + "q" * 700 + " z " + "theand" * 300]
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
    # The heap gives what the rounds give.
    monkeypatch.setattr(pieces, "LONG", 2)
    fresh = pieces.Encoder(library.serialized_model_proto())
    assert [x.tolist() for x in fresh.encode(odd_texts())] == [library.encode(t) for t in odd_texts()]


def test_a_very_long_unit_takes_seconds(encoder):
    rng = random.Random(4)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(200_000)), "日本" * 100_000):
        started = time.process_time()
        (ids,) = encoder.encode([text])
        assert ids.tolist() == library.encode(text) and encoder.decode(ids) == text
        assert time.process_time() - started < 30


def test_a_small_memory_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    monkeypatch.setattr(pieces, "JOINED", 40)
    monkeypatch.setattr(pieces, "SPLIT", 20)
    small = pieces.Encoder(library.serialized_model_proto())
    for t in (["one two three", "three two one four"], ["five " * 20, "one six"]):
        assert [x.tolist() for x in small.encode(t)] == [library.encode(x) for x in t]
    assert len(small.known) <= 5


def test_occurrences_are_all_found(encoder):
    text = "the theme of them all"
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = {(int(s), encoder.vocabulary.texts[p]) for s, _, p in zip(*pieces.occurrences(encoder.vocabulary, chars))}
    wanted = {(i, t) for t in encoder.vocabulary.texts for i in range(len(text)) if text.startswith(t, i)}
    assert found == wanted


def test_round_trip_of_a_table(spark):
    docs = with_repeats(spark, sample_texts())
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.encode(frame(spark, [])).count() == 0


def test_a_round_trip_in_one_worker_tells_the_same(spark):
    docs = with_repeats(spark, [*sample_texts(), *odd_texts()])
    apart = pieces.decode(pieces.encode(docs)).select("doc_id", "text", F.size("ids").alias("n_ids"), pieces.crc32_of(F.col("ids")).alias("ids_crc32"), "decoded")
    together = pieces.round_trip(docs)
    assert together.columns == apart.columns and together.count() == docs.count()
    assert together.exceptAll(apart).isEmpty() and apart.exceptAll(together).isEmpty()
    assert pieces.round_trip(frame(spark, [])).count() == 0
