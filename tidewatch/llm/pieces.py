"""SentencePiece encoding and decoding by matching all pieces in a suffix array of the batch text.

Text becomes units: a run of word marks and what follows up to the next mark. No piece of the vocabulary goes
beyond a unit, so equal units have equal encodings. For each batch the units not seen before are joined into
one text and indexed by a suffix array (sorted to the depth of the longest piece); all pieces are searched in it
at once by bisection, three characters at a time; each range of suffixes is the piece's list of occurrences.
These edges, in order of position, are relaxed into paths.

The vocabulary given here is of the byte-pair kind, where the right path is not the one of the best total score:
edges are taken by rank, and an edge is taken only where its two ends are ends of neighbouring symbols. So the
relaxation takes, round by round and for all units at once, the best edge over two neighbouring symbols (ties:
leftmost) until none is left. In a unit of very many characters, where a round would do too little, the same edges
are taken from a heap. Characters that no edge covers become byte pieces.

Null and empty texts have no ids; a null doc_id is kept; repeated rows are encoded each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Beyond any character: ends a unit in the joined text, and fills keys of three characters.
STOP = 0x110000
PACKED = 3
SHIFT = np.uint64(21)
# Units remembered by a worker, and characters indexed at once.
CACHE = 600_000
JOINED = 1 << 18
NONE = np.iinfo(np.int32).max
# Characters split into units at once.
SPLIT = 1 << 20
# Characters of a unit from which on its edges are taken from a heap.
LONG = 512


class Vocabulary:
    """Pieces of a byte-pair model with byte pieces, no normalisation and a mark before the text."""

    def __init__(self, model: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = m.get_piece_size()
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i) for i in range(size)]
        self.ids = np.array([i for i in range(size) if not special[i]])
        self.texts = [m.id_to_piece(int(i)) for i in self.ids]
        score = np.array([m.get_score(int(i)) for i in self.ids])
        if any(MARK in t.lstrip(MARK) for t in self.texts):
            raise ValueError("a piece goes beyond the next word mark")
        # Equal scores are one rank: among them the leftmost edge is taken first.
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.single = {t: int(i) for t, i in zip(self.texts, self.ids) if len(t) == 1}
        self.longest = max(map(len, self.texts))
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(size) if m.is_byte(i)}
        self.raw: dict[int, bytes] = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw |= {int(i): t.replace(MARK, " ").encode() for t, i in zip(self.texts, self.ids)}
        self.raw_of_id = pa.array([self.raw.get(i) for i in range(size)], pa.large_binary())

    @cached_property
    def of_text(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.texts)}

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the pieces, and their characters in keys of three (one row per key)."""
        wide = -(-self.longest // PACKED) * PACKED
        chars = np.zeros((len(self.texts), wide), np.uint64)
        for i, t in enumerate(self.texts):
            chars[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return np.array([len(t) for t in self.texts]), _pack([chars[:, i] for i in range(wide)])


def _pack(chars: list[np.ndarray]) -> np.ndarray:
    """Keys of three characters each, which sort like the characters."""
    return np.stack([(a << SHIFT | b) << SHIFT | c for a, b, c in zip(chars[::3], chars[1::3], chars[2::3])])


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = np.argsort(values)
    sorted_values = values[order]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], sorted_values[1:] != sorted_values[:-1]]))
    return ranks


def suffix_array(chars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes up to `depth` characters, and these suffixes as keys.

    Suffixes are ranked by three characters first; the ranks of neighbouring parts, as many as fit into a number,
    rank them by a multiple of that, until the depth is reached.
    """
    wide, n = -(-depth // PACKED) * PACKED, len(chars)
    filled = np.concatenate([chars, np.full(2 * wide, STOP, chars.dtype)]).astype(np.uint64)
    m = n + wide
    keys = _pack([filled[i : i + m] for i in range(wide)])
    bits, span = max(1, m.bit_length()), PACKED
    values = keys[0]
    while span < wide:
        ranks = _ranks(values)
        parts = min(63 // bits, -(-wide // span))
        values = ranks
        for i in range(1, parts):
            # Beyond the end all is filled alike.
            values = values << bits | np.concatenate([ranks[i * span :], np.full(min(i * span, m), ranks[-1])])[:m]
        span *= parts
    order = np.argsort(values[:n])
    return order, keys[:, order]


def _bisect(sorted_keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each range the first place whose key is not below (or is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        key = sorted_keys[np.minimum(middle, len(sorted_keys) - 1)]
        right = open_ & ((key <= wanted) if after else (key < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def occurrences(vocabulary: Vocabulary, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, length, piece) of all pieces in a text, by position."""
    order, keys = suffix_array(chars, vocabulary.longest)
    length, wanted = vocabulary.keys
    piece = np.arange(len(length))
    low, high = np.zeros(len(length), np.int64), np.full(len(length), len(order), np.int64)
    edges = []
    for step in range(len(keys)):
        rest = length[piece] - step * PACKED
        # The last key of a piece holds fewer characters: its range is from all zeros to all ones after them.
        open_bits = np.maximum(0, PACKED - rest).astype(np.uint64) * SHIFT
        least = wanted[step][piece]
        most = least | ((np.uint64(1) << open_bits) - np.uint64(1))
        if step == 0:
            low, high = np.searchsorted(keys[0], least, "left"), np.searchsorted(keys[0], most, "right")
        else:
            low, high = _bisect(keys[step], low, high, least, False), _bisect(keys[step], low, high, most, True)
        ended = (rest <= PACKED) & (low < high)
        edges.append((piece[ended], low[ended], high[ended]))
        go_on = (rest > PACKED) & (low < high)
        piece, low, high = piece[go_on], low[go_on], high[go_on]
    piece, low, high = (np.concatenate(x) for x in zip(*edges))
    times = high - low
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start, piece = order[np.repeat(low, times) + within], np.repeat(piece, times)
    by_place = np.argsort(start)
    return start[by_place], length[piece][by_place], piece[by_place]


def relax(vocabulary: Vocabulary, chars: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the symbols of all units, and the piece of each (-1: a character in no piece).

    `unit` numbers the unit of each character, or is -1 between units.
    """
    start, length, piece = occurrences(vocabulary, chars)
    wide = vocabulary.longest + 1
    edge = np.full(len(chars) * wide, -1, np.int32)
    edge[start * wide + length] = piece
    within = np.nonzero(unit >= 0)[0]
    sizes = np.bincount(unit[within])
    done_at, done_end = [], []
    for u in np.nonzero(sizes >= LONG)[0]:
        low = int(np.searchsorted(unit[within], u)) if len(sizes) > 1 else 0
        starts, ends = relax_long(vocabulary.rank, edge.reshape(-1, wide)[within[low] :][: sizes[u]])
        done_at.append(starts + within[low])
        done_end.append(ends + within[low])
    at = within[sizes[unit[within]] < LONG]
    end, of = at + 1, unit[at]
    while len(at):
        joined = np.concatenate([end[1:], [0]]) - at
        beside = np.concatenate([of[1:] == of[:-1], [False]]) & (joined < wide)
        found = np.where(beside, edge[at * wide + np.where(beside, joined, 0)], -1)
        order = np.where(found >= 0, vocabulary.rank[found], NONE)
        first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
        least = np.minimum.reduceat(order, first)
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        again = np.repeat(least < NONE, sizes)
        done_at.append(at[~again])
        done_end.append(end[~again])
        # The leftmost of the best edges of each unit; its right symbol goes.
        best = np.nonzero(again & (order == np.repeat(least, sizes)))[0]
        best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if len(best) else best
        end = end.copy()
        end[best] = end[np.minimum(best + 1, len(end) - 1)]
        again[np.minimum(best + 1, len(end) - 1)] = False
        at, end, of = at[again], end[again], of[again]
    at, end = np.concatenate(done_at or [at]), np.concatenate(done_end or [end])
    by_place = np.argsort(at)
    at, end = at[by_place], end[by_place]
    return at, edge[at * wide + (end - at)] if len(at) else np.empty(0, np.int32)


def relax_long(rank: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the symbols of one unit, given its piece per start and length, in n log n steps."""
    n, wide = edge.shape
    piece_at, rank_of = memoryview(np.ascontiguousarray(edge).ravel()), memoryview(np.ascontiguousarray(rank))
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
    first = np.nonzero(edge[: n - 1, 2] >= 0)[0] if wide > 2 else np.empty(0, np.int64)
    heap = [(r, a, a + 2) for r, a in zip(rank[edge[first, 2]].tolist(), first.tolist())]
    heapq.heapify(heap)

    def offer(a: int, e: int) -> None:
        if e - a < wide and (piece := piece_at[a * wide + e - a]) >= 0:
            heapq.heappush(heap, (rank_of[piece], a, e))

    while heap:
        _, a, e = heapq.heappop(heap)
        b = end[a]
        # Only if the edge still lies over two neighbouring symbols.
        if not alive[a] or b >= n or end[b] != e:
            continue
        alive[b], end[a] = 0, e
        if e < n:
            before[e] = a
            offer(a, end[e])
        if before[a] >= 0:
            offer(before[a], e)
    starts = np.nonzero(np.frombuffer(alive, np.uint8))[0]
    return starts, np.array(end)[starts]


def encode_units(vocabulary: Vocabulary, units: list[str]) -> list[bytes]:
    """Ids of each unit as little-endian 32-bit numbers."""
    sizes = np.array([len(u) for u in units])
    text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(text)) + np.repeat(np.arange(len(units)), sizes)
    chars = np.full(len(text) + len(units), STOP, np.uint32)
    chars[place] = text
    unit = np.full(len(chars), -1)
    unit[place] = np.repeat(np.arange(len(units)), sizes)
    at, piece = relax(vocabulary, chars, unit)
    out, count = [], np.ones(len(at), np.int64)
    ids = np.where(piece >= 0, vocabulary.ids[piece], -1)
    for i in np.nonzero(piece < 0)[0]:
        raw = chr(chars[at[i]]).encode("utf-8", "surrogatepass")
        out.append((i, [vocabulary.bytes[b] for b in raw]))
        count[i] = len(raw)
    full = np.repeat(ids, count)
    first = np.cumsum(count) - count
    for i, raw in out:
        full[first[i] : first[i] + len(raw)] = raw
    per_unit = np.bincount(unit[at], weights=count, minlength=len(units)).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(per_unit)]) * 4
    joined = full.astype("<i4").tobytes()
    return [joined[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def bounded(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, a bounded number of characters at once, or one longer text."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t or "") > SPLIT:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield some


class Encoder:
    """Encodes batches of texts; remembers the first units it meets, up to a bound."""

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.known: dict[str, bytes] = {}

    def learn(self, units: Iterable[str]) -> dict[str, bytes]:
        """The ids of new units, a bounded number of characters at a time."""
        found, new, size = {}, [], 0
        for u in units:
            new.append(u)
            size += len(u) + 1
            if size >= JOINED:
                found.update(zip(new, encode_units(self.vocabulary, new)))
                new, size = [], 0
        if new:
            found.update(zip(new, encode_units(self.vocabulary, new)))
        return found

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return [ids for some in bounded(texts) for ids in self._encode(some)]

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = self.learn(dict.fromkeys(u for units in split for u in units if u not in self.known))
        if len(self.known) + len(found) <= CACHE:
            self.known.update(found)
            found = {}
        known = self.known.get
        if not found:
            return [np.frombuffer(b"".join(map(self.known.__getitem__, units)), "<i4") for units in split]
        return [np.frombuffer(b"".join([known(u) or found[u] for u in units]), "<i4") for units in split]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, rows: Sequence[np.ndarray]) -> list[str]:
        """The text of each row of ids; their bytes lie side by side in what Arrow takes for all rows."""
        taken = pc.take(self.vocabulary.raw_of_id, pa.array(np.concatenate([np.empty(0, np.int64), *rows])))
        if taken.null_count:
            raise KeyError("an id without text")
        if not len(taken):
            return [""] * len(rows)
        _, ends, data = taken.buffers()
        cuts = np.frombuffer(ends, np.int64, len(taken) + 1)[np.cumsum([0, *map(len, rows)])].tolist()
        joined = data.to_pybytes()
        out = (joined[s + (joined[s : s + 1] == b" " and s < e) : e] for s, e in zip(cuts[:-1], cuts[1:]))
        return [raw.decode("utf-8", "replace") for raw in out]


_encoders: dict[str, Encoder] = {}


def _encoder(call: str, model: bytes) -> Encoder:
    """Built once per worker and call; keeps the units it has met from task to task, but not for later calls."""
    if call not in _encoders:
        _encoders.clear()
        _encoders[call] = Encoder(model)
    return _encoders[call]


def sent_model(df: DataFrame, vocabulary: str | None = None):
    """A name for this call and the content of a model file, sent out once."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as file:
        return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, file.read()))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text and ids of every row."""
    sent = sent_model(docs, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(*sent.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts), dtype=object)

    return docs.select("doc_id", "text", ids(text_or_empty()).alias("ids"))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`encoded` with the text of its ids as `decoded`."""
    sent = sent_model(encoded, vocabulary)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series(_encoder(*sent.value).decode_all([np.asarray(x, np.int64) for x in rows]), dtype=object)

    return encoded.withColumn("decoded", text("ids"))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, n_ids, ids_crc32 (see `crc32_of`) and decoded of every row, for checks of whole tables.

    Texts are encoded and their ids decoded by one worker, so that ids don't go through the JVM.
    """
    sent = sent_model(docs, vocabulary)

    @F.pandas_udf("n_ids long, ids_crc32 long, decoded string")
    def both_ways(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*sent.value)
        for texts in batches:
            out = []
            for some in bounded(texts):
                rows = encoder.encode(some)
                out += zip(map(len, rows), (zlib.crc32(x.tobytes()) for x in rows), encoder.decode_all(rows))
            yield pd.DataFrame(out, columns=["n_ids", "ids_crc32", "decoded"])

    return docs.select("doc_id", "text", both_ways(text_or_empty()).alias("found")).select("doc_id", "text", "found.*")


def crc32_of(ids):
    """Unsigned CRC-32 of an array column of ids as little-endian 32-bit numbers."""

    @F.pandas_udf("long")
    def crc(rows: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(x, "<i4").tobytes()) for x in rows], dtype="int64")

    return crc(ids)
