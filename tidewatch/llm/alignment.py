"""Alignment of two tokenizers over a corpus: byte ranges where both end cut their tokens into groups.

A batch of documents runs through an Arrow pipeline: lists of ids are flattened with parent indices, token lengths
become end positions by segmented cumulative sums, an Acero hash join on document-end keys finds the common
ends, another one on groups pairs the tokens that share a group, and Table.group_by counts the pairs of each
document. Documents are written once, with their pairs and how often each occurs. Table.group_by then counts
documents per pair batch by batch, and Spark merges these partial counts. How each document's pairs fare in
the whole corpus is looked up in the table of counts: a binary search in every task while that table has at
most HELD rows, a shuffle join beyond.

The first tokenizer is byte-level and reads the text behind a space; the second is a SentencePiece model,
which puts a space there itself. Both read the text without special tokens; strings of special tokens are
ordinary text.

A text that is null or empty, or whose joined tokens of either kind aren't its bytes behind a space, has no
tokens: zeros, and an empty digest. Every row is a document, rows that repeat an id or all else too; a null
doc_id stays null; an empty table gives an empty result; further columns are ignored. Texts of any length are
aligned as a whole; pairs of a group that has very many are counted before they are joined.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import ready
from tidewatch.session import stage

PIECES = "piece_bpe_32k.model"
# A pair of ids as one number: the first id, then as many bits for the second.
SECOND_BITS = 15
# Characters of text aligned at once; a longer text goes alone.
AT_ONCE = 1 << 18
# Rows of the table of counts sent to all tasks, at most: some 40 MB.
HELD = 1 << 21
# Links of one group above which repeated ids in it are counted before they are paired.
MANY_LINKS = 256

ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
)


class Vocabulary:
    """Bytes, lengths and decimal texts of a tokenizer's ids."""

    def __init__(self, of_id: list[bytes], before: list[str]):
        self.bytes = pa.array(of_id, pa.large_binary())
        self.lengths = np.array([len(x) for x in of_id], np.int64)
        # The text of an id behind each of the separators `before`, which follow one another.
        self.texts = pa.array([sep + str(i) for sep in before for i in range(len(of_id))], pa.large_string())


class Tokenizers:
    """Both tokenizers with their vocabularies, built once per worker."""

    def __init__(self, first: bytes, second: bytes):
        self.first = tokens.byte_tokenizer(first)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.a = Vocabulary(self.first.token_bytes, ["", ";", ","])
        self.b = Vocabulary(pieces, ["|", ","])
        self.texts = pa.concat_arrays([self.a.texts, self.b.texts])
        if len(pieces) > 1 << SECOND_BITS or len(self.first.token_bytes) > 1 << 16:
            raise ValueError("a vocabulary is too large for pairs of ids in one number")

    def ids(self, texts: list[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        kind = pa.large_list(pa.int32())
        first = pa.array([self.first.encode(" " + t, added=False) for t in texts], kind)
        return first, pa.array(self.second.encode(texts, num_threads=1), kind)


_built: dict[tuple[int, int], Tokenizers] = {}


def tokenizers(first: bytes, second: bytes) -> Tokenizers:
    key = zlib.crc32(first), zlib.crc32(second)
    if key not in _built:
        _built[key] = Tokenizers(first, second)
    return _built[key]


def _offsets(lists: pa.LargeListArray) -> np.ndarray:
    """Where each list begins in the flattened array, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(np.int64)


def _joins(values: pa.LargeBinaryArray, at: np.ndarray) -> Iterator[memoryview]:
    """The values from each of `at` to the next one, joined: Arrow holds them side by side."""
    _, ends, data = values.buffers()
    data = memoryview(data) if data is not None else memoryview(b"")
    cuts = np.frombuffer(ends, np.int64, len(values) + 1)[at].tolist() if len(values) else [0] * len(at)
    return (data[s:e] for s, e in zip(cuts[:-1], cuts[1:]))


def _spells(lists: pa.LargeListArray, vocabulary: Vocabulary, raw: list[bytes]) -> np.ndarray:
    """Whether the tokens of each document, joined, are its bytes."""
    joined = _joins(pc.take(vocabulary.bytes, lists.flatten()), _offsets(lists))
    return np.array([bytes(mine) == r for mine, r in zip(joined, raw)], bool)


def _ends(lists: pa.LargeListArray, vocabulary: Vocabulary, base: np.ndarray) -> pa.Table:
    """Per token: its place, document, and document-end key, which is the document's base plus the end in it."""
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    running = np.asarray(pc.cumulative_sum(pa.array(vocabulary.lengths[np.asarray(flat)])))
    before = np.concatenate([[0], running])[_offsets(lists)[:-1]]
    doc = np.asarray(parent)
    within = running - before[doc]
    return pa.table({"key": base[doc] + within, "place": np.arange(len(flat), dtype=np.int64)})


def _paired(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, many: bool) -> pa.Table:
    """Pairs of ids that share a group, with the number of occurrences they stand for: group, a, b, times."""
    left, right = pa.table({"group": group_a, "a": a}), pa.table({"group": group_b, "b": b})
    if many:
        left = left.group_by(["group", "a"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", "a", "n_a"])
        right = right.group_by(["group", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", "b", "n_b"])
    both = left.join(right, "group", join_type="inner", use_threads=False)
    if many:
        return both.append_column("times", pc.multiply(both["n_a"], both["n_b"])).select(["group", "a", "b", "times"])
    return both.append_column("times", pa.array(np.ones(both.num_rows, np.int64)))


def align(tools: Tokenizers, texts: list[str | None]) -> pa.Table:
    """Rows of ALIGNED but for doc_id, one per text."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests, offsets = [""] * n, np.zeros(n + 1, np.int64)
    whole = np.array([i for i, t in enumerate(texts) if t], np.int64)
    given = [texts[i] for i in whole]
    ids_a, ids_b = tools.ids(given)
    raw = [b" " + t.encode() for t in given]
    spelled = _spells(ids_a, tools.a, raw) & _spells(ids_b, tools.b, raw)
    whole, raw = whole[spelled], [r for r, ok in zip(raw, spelled) if ok]
    ids_a, ids_b = ids_a.filter(pa.array(spelled)), ids_b.filter(pa.array(spelled))
    pairs = times = np.empty(0, np.int64)
    if len(whole):
        base = np.concatenate([[0], np.cumsum([len(r) for r in raw])])[:-1]
        a, b = np.asarray(ids_a.flatten()), np.asarray(ids_b.flatten())
        at_a, at_b = _offsets(ids_a), _offsets(ids_b)
        common = _ends(ids_a, tools.a, base).join(
            _ends(ids_b, tools.b, base), "key", join_type="inner", right_suffix="_b", use_threads=False
        )
        order = np.argsort(np.asarray(common["key"]))
        # The last token of each group on either side, and so the number of tokens in it.
        last_a, last_b = np.asarray(common["place"])[order], np.asarray(common["place_b"])[order]
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        doc = np.searchsorted(at_a, last_a, "right") - 1
        links = size_a * size_b
        number = np.arange(len(links))
        group_a, group_b = np.repeat(number, size_a), np.repeat(number, size_b)
        large = links > MANY_LINKS
        found = []
        for many in (False, True):
            if large.any() or not many:
                some_a, some_b = large[group_a] == many, large[group_b] == many
                found.append(_paired(group_a[some_a], a[some_a], group_b[some_b], b[some_b], many))
        found = pa.concat_tables(found) if len(found) > 1 else found[0]
        of_doc = doc[np.asarray(found["group"])].astype(np.int64)
        pair = np.asarray(found["a"]).astype(np.int64) << SECOND_BITS | np.asarray(found["b"])
        key = of_doc << (16 + SECOND_BITS) | pair
        counted = pa.table({"key": key, "times": found["times"]}).group_by("key", use_threads=False)
        counted = counted.aggregate([("times", "sum")])
        key, times = np.asarray(counted["key"]), np.asarray(counted["times_sum"])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        pairs = key & (1 << (16 + SECOND_BITS)) - 1
        offsets[whole + 1] = np.bincount(key >> (16 + SECOND_BITS), minlength=len(whole))
        out["n_a"][whole], out["n_b"][whole] = np.diff(at_a), np.diff(at_b)
        out["n_groups"][whole] = np.bincount(doc, minlength=len(whole))
        out["n_links"][whole] = np.add.reduceat(links, np.searchsorted(doc, np.arange(len(whole))))
        written = _written(tools, a, b, size_a, size_b, doc, len(whole))
        for i, text in zip(whole, written):
            digests[i] = hashlib.sha256(text).hexdigest()
    at = np.cumsum(offsets).astype(np.int32)
    columns = {c: pa.array(v) for c, v in out.items()} | {
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(pa.array(at), pa.array(pairs)),
        "times": pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
    }
    return pa.table(columns)


def _written(tools: Tokenizers, a, b, size_a, size_b, doc, docs: int) -> Iterator[memoryview]:
    """Per document its groups as text: `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = len(tools.a.lengths), len(tools.b.lengths)
    before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    # Which separator stands before an id: of the first ones, none where a document begins.
    sep_a, sep_b = np.full(len(a), 2), np.full(len(b), 1)
    sep_a[before_a], sep_b[before_b] = 1, 0
    sep_a[before_a[np.concatenate([[True], doc[1:] != doc[:-1]])]] = 0
    # A token of the first kind stands behind all tokens of earlier groups, one of the second also behind the group's first ones.
    place_a = np.arange(len(a)) + np.repeat(before_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(before_a + size_a, size_b)
    at = np.empty(len(a) + len(b), np.int64)
    at[place_a], at[place_b] = sep_a * n_a + a, 3 * n_a + sep_b * n_b + b
    texts = pc.take(tools.texts, pa.array(at))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size_a + size_b, minlength=docs).astype(np.int64))])
    return _joins(texts, ends)


def aligned(docs: DataFrame) -> DataFrame:
    """ALIGNED rows of all documents, written."""
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast((tokens.read(tokens.BYTES), tokens.read(PIECES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(*sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= AT_ONCE):
                    size += len(texts[stop] or "")
                    stop += 1
                rows = align(tools, texts[start:stop])
                ids = batch.column("doc_id").slice(start, stop - start)
                yield from rows.add_column(0, "doc_id", ids).combine_chunks().to_batches()
                start = stop

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(given.mapInArrow(run, ALIGNED), "aligned")


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair, batch by batch; what is held between batches is sent on when it gets large."""
    held = None
    for batch in batches:
        new = pa.table({"pair": batch.column("pairs").flatten()})
        new = new.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
        if held is not None:
            new = pa.concat_tables([held, new.select(held.column_names)])
            new = new.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
        held = new
        if held.num_rows > HELD:
            yield from held.combine_chunks().to_batches()
            held = None
    if held is not None:
        yield from held.combine_chunks().to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """Written table of all linked pairs: pair, n (documents that hold it linked), best (n is its first id's highest)."""
    each = rows.select("pairs").mapInArrow(_partial_counts, "pair long, n long")
    counts = stage(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.shiftright("pair", SECOND_BITS)
    # One row per id of the first vocabulary.
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return stage(
        counts.join(F.broadcast(most), first == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
        "pair-scores",
    )


MEASURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]


def _looked_up(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Sums over each document's links, with the table of counts in every task."""
    table = scores.orderBy("pair").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(tuple(table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            found = np.searchsorted(pair, np.asarray(lists.flatten()))
            times = np.asarray(batch.column("times").flatten()).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            summed = {}
            for name, value in (("n_best", times * best[found]), ("count_sum", times * n[found])):
                summed[name] = np.diff(np.concatenate([[0], np.cumsum(value)])[ends])
            columns = [pa.array(summed[c]) if c in summed else batch.column(c) for c in _NAMES]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return rows.mapInArrow(run, MEASURES)


def _joined(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """The same by a shuffle join, for a table of counts of any size."""
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "*")
    each = numbered.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    sums = (
        each.join(scores, "pair")
        .groupBy("_row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    sums = stage(sums, "link-sums")
    out = numbered.select("_row", *_KEPT).join(sums, "_row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}).select(*_NAMES)


def measure(docs: DataFrame, held: int = HELD) -> DataFrame:
    """One row per document: MEASURES. `n_best` counts links whose pair is as common as any of its first id."""
    rows = aligned(docs)
    scores = pair_counts(rows)
    return _looked_up(rows, scores) if scores.count() <= held else _joined(rows, scores)
