from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from brute import frame, sample_texts, with_repeats
from tokenizers import Tokenizer

from tidewatch.llm import alignment, tokens


@pytest.fixture(scope="module")
def encoders():
    """Both libraries as they are: ids with the bytes of each token."""
    first = Tokenizer.from_file(public_tokenizers.path(tokens.BYTES))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    byte_of = tokens._byte_of_character()

    def a(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in ids]

    def b(text):
        out = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            out.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        return out

    return a, b


def groups_of(text, encoders):
    """[(ids of the first kind, ids of the second)] of a text, by walking over its bytes."""
    if not text:
        return []
    a, b = (encode(text) for encode in encoders)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []

    def ends(side):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((at, i))
        return out

    a, b = ends(a), ends(b)
    cuts = sorted({e for e, _ in a} & {e for e, _ in b})
    out, start = [], 0
    for cut in cuts:
        out.append(([i for e, i in a if start < e <= cut], [i for e, i in b if start < e <= cut]))
        start = cut
    return out


def plain(rows, encoders):
    grouped = [groups_of(t, encoders) for _, t in rows]
    links = [[(a, b) for left, right in g for a in left for b in right] for g in grouped]
    count = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), g, x in zip(rows, grouped, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                i,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                len(x),
                sum(count[p] == most[p[0]] for p in x),
                sum(count[p] for p in x),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return out


def awkward():
    rng = random.Random(5)
    return [
        "<|endoftext|> and <s> </s> <unk> <0x41>",
        "marked▁space",
        " two  spaces, \t tab\r\n\n\n end  ",
        "日本語のテキスト 한국어 🙂🙃 \u0000 ​ ﬁ é é",
        base64.b64encode(rng.randbytes(3000)).decode(),
        "x" + " " * 3000 + "y",
        "🙂" * 500,
        "1234567890" * 50,
        "the cat sat on the mat " * 20,
    ]


@pytest.mark.parametrize("held, many", [(alignment.HELD, alignment.MANY_LINKS), (0, 1)])
def test_equals_definition(spark, encoders, monkeypatch, held, many):
    monkeypatch.setattr(alignment, "MANY_LINKS", many)
    texts = [t for t in sample_texts() if len(t or "") < 3000] + awkward()
    docs = with_repeats(spark, texts).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = alignment.measure(docs, held=held)
    assert got.columns == alignment._NAMES
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, encoders), key=key)


def test_batches_do_not_matter(encoders, monkeypatch):
    tools = alignment.tokenizers(tokens.read(tokens.BYTES), tokens.read(alignment.PIECES))
    texts = [t for t in sample_texts(2) if len(t or "") < 3000] + awkward()
    whole = alignment.align(tools, texts).to_pylist()
    assert whole == [row for t in texts for row in alignment.align(tools, [t]).to_pylist()]
    assert [r["n_groups"] for r in whole] == [len(groups_of(t, encoders)) for t in texts]


def test_very_long_texts(spark):
    rng = random.Random(7)
    texts = [" " * 1_000_000, "\n" * 1_000_000, base64.b64encode(rng.randbytes(150_000)).decode(), "日本" * 100_000]
    docs = frame(spark, texts)
    for r in alignment.measure(docs).collect():
        assert 0 < r.n_groups <= min(r.n_a, r.n_b) and r.n_links >= r.n_groups and r.n_best <= r.n_links <= r.count_sum


def test_empty_table(spark):
    assert alignment.measure(frame(spark, [])).count() == 0
    assert sorted(map(tuple, alignment.measure(frame(spark, [None, ""])).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]
