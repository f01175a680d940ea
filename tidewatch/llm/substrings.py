"""Removal of long repeated byte strings with a sparse suffix array.

A byte goes if a string of `length` bytes over it also starts anywhere else. All starts can't be sorted
together at scale, so they are brought together by content first: each window of `length` bytes is given to its
anchor, the byte n-gram with the least hash in it (the leftmost of several). Equal windows have equal anchors
at equal offsets, so a window has to be compared only with windows of the same anchor n-gram and offset.

1. Anchors of all documents, as hashes; only n-grams that occur twice go on, and with them their documents.
2. The windows of one anchor lie in one stretch of text, its context. Equal contexts (128-bit hash) of an n-gram
   are one class with a count; a class of two or more occurrences is repeated as a whole.
3. Contexts of different classes of an n-gram meet in one task, which sorts the suffixes at their windows: a
   merge sort whose comparisons find the common extension of two suffixes by bisection over polynomial
   prefix hashes. Neighbours that share `length` bytes are compared byte by byte before they count as equal.
   An n-gram with very many contexts is not gathered: strips of its windows are grouped by their hashes.
4. What is repeated goes back to the occurrences of each class, and per document the spans are joined.

Null text counts as empty; texts below `length` bytes lose nothing; a null doc_id is kept; repeated rows repeat
each other's text, so a long one loses all of it; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import row_hash, text_or_empty
from tidewatch.session import stage

LENGTH = 400
GRAM = 64
# Window starts looked at together; a chunk's positions must fit below PLACE bits.
CHUNK = 1 << 22
PLACE = np.uint64(24)
# Contexts of an n-gram compared in one task, and windows and bytes of contexts sorted at once.
GATHERED = 1024
SORTED, SORTED_BYTES = 200_000, 1 << 20
# Bytes of contexts that a worker collects before it hands them on; objects around them take about as much again.
HANDED_ON = 1 << 21
# Offsets of a strip of windows, where contexts are too many for one task.
STRIP_WIDTHS = (64, 32, 16, 4, 1)

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def hashes_at(prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Polynomial hashes of strings, independent of where they start."""
    return (prefix[start + size] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from least values before and after the ends of blocks."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hash, place, first and last window start of every anchor of a text."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part) - gram + 1
        prefix = prefix_hashes(part)
        grams = mixed((prefix[gram:] - prefix[:-gram]) * powers(INVERSE, len(prefix))[:n])
        keys = (grams >> PLACE << PLACE) | np.arange(n, dtype=np.uint64)
        place = (sliding_least(keys, length - gram + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        first = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
        last = np.concatenate([first[1:], [len(place)]]) - 1
        out.append((grams[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchor_hashes(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2, g, n = [], [], [], []
            for a, b, text in zip(batch.k1, batch.k2, batch.text):
                found, times = np.unique(anchors(_bytes(text), length, gram)[0], return_counts=True)
                g.append(found)
                n.append(times)
                k1.append(np.full(len(found), a))
                k2.append(np.full(len(found), b))
            if g:
                columns = zip(("k1", "k2", "g", "n"), (k1, k2, g, n))
                yield pd.DataFrame({c: np.concatenate(x).astype(np.int64) for c, x in columns})

    return run


OCCURRENCES = "k1 long, k2 long, place long, g long, c1 long, c2 long, off int, context binary"


def _occurrences(length: int, gram: int):
    names = [c.split()[0] for c in OCCURRENCES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, seen, held = [], set(), 0
            for k1, k2, text, shared in zip(batch.k1, batch.k2, batch.text, batch.shared):
                data = _bytes(text)
                raw = data.tobytes()
                g, place, first, last = anchors(data, length, gram)
                for i in np.nonzero(np.isin(g, shared))[0]:
                    context = raw[first[i] : last[i] + length]
                    off = int(place[i] - first[i])
                    digest = xxhash.xxh3_128_digest(context, off)
                    # The context itself goes along once per batch.
                    new = (mark := (int(g[i]), digest)) not in seen
                    out.append((k1, k2, int(place[i]), mark[0], *np.frombuffer(digest, np.int64).tolist(), off, context if new else None))
                    seen.add(mark)
                    held += len(context) if new else 0
                    if held > HANDED_ON:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return run


class Suffixes:
    """Suffixes of joined contexts, ordered by their first `length` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: int):
        self.data, self.start, self.length = data, start, length
        self.prefix = prefix_hashes(data)
        self.whole = hashes_at(self.prefix, start, length)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that pairs of suffixes share, up to `length`, by bisection over prefix hashes."""
        out = np.full(len(a), self.length)
        rest = np.nonzero(self.whole[a] != self.whole[b])[0]
        sa, sb = self.start[a[rest]], self.start[b[rest]]
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.length - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = hashes_at(self.prefix, sa, middle) == hashes_at(self.prefix, sb, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[rest] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b."""
        shared = self.common(a, b)
        ends = shared >= self.length
        inside = np.where(ends, 0, shared)
        return np.where(ends, or_equal, self.data[self.start[a] + inside] < self.data[self.start[b] + inside])

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes within segments (numbers in ascending order): merge sort from the bottom up."""
        order = np.arange(len(segment))
        first = np.concatenate([[True], segment[1:] != segment[:-1]])
        begin = np.maximum.accumulate(np.where(first, order, 0))
        ends = np.concatenate([np.nonzero(first)[0][1:], [len(segment)]])
        end = ends[np.cumsum(first) - 1] if len(segment) else order
        width, widest = 1, int((end - begin).max(initial=0))
        while width < widest:
            at = np.arange(len(order))
            run = (at - begin) // width
            other = begin + (run ^ 1) * width
            low = np.minimum(other, end)
            high = np.minimum(other + width, end)
            right_run = (run & 1).astype(bool)
            base = low.copy()
            # Bisection of each suffix into the neighbouring run; left ones win ties.
            while (open_ := np.nonzero(low < high)[0]).size:
                middle = (low[open_] + high[open_]) // 2
                smaller = self.before(order[middle], order[open_], right_run[open_])
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            pair = begin + (run >> 1) * 2 * width
            new = pair + (at - begin - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[new] = order
            order, width = merged, 2 * width
        return order

    def repeated(self, segment: np.ndarray) -> np.ndarray:
        """Which suffixes share `length` bytes with another one of their segment."""
        out = np.zeros(len(segment), bool)
        order = self.sort(segment)
        a, b = order[:-1], order[1:]
        near = (segment[a] == segment[b]) & (self.whole[a] == self.whole[b])
        a, b = a[near], b[near]
        inside = np.arange(self.length)
        wrong = set()
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            same = (self.data[self.start[x][:, None] + inside] == self.data[self.start[y][:, None] + inside]).all(axis=1)
            out[x[same]] = out[y[same]] = True
            wrong |= set(segment[x[~same]].tolist())
        for s in wrong:  # different strings of one hash: this segment is compared as it is
            members = np.nonzero(segment == s)[0]
            texts = [self.data[self.start[i] : self.start[i] + self.length].tobytes() for i in members]
            times = pd.Series(texts).value_counts()
            out[members] = [times[t] > 1 for t in texts]
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), (np.nonzero(edge == -1)[0] - 1).tolist()))


def compare(rows: pd.DataFrame, length: int) -> list[list[tuple[int, int]]]:
    """For classes ordered by n-gram: runs of repeated windows, as their places in the context."""
    sizes = np.array([len(c) for c in rows.context])
    count = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(rows.context), np.uint8)
    of = np.repeat(np.arange(len(rows)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    group = np.cumsum(np.concatenate([[False], rows.g.to_numpy()[1:] != rows.g.to_numpy()[:-1]]))
    key = group[of] * (length + 1) + rows.off.to_numpy()[of] - place
    order = np.argsort(key, kind="stable")
    repeated = np.zeros(len(of), bool)
    repeated[order] = Suffixes(data, (base[of] + place)[order], length).repeated(key[order])
    repeated |= (rows.times.to_numpy() > 1)[of]
    return [_runs(x) for x in np.split(repeated, np.cumsum(count)[:-1])]


RUNS = "g long, c1 long, c2 long, runs array<struct<first:int,last:int>>"


def _comparer(length: int):
    def resolved(rows: pd.DataFrame) -> pd.DataFrame:
        names = ("first", "last")
        runs = [[dict(zip(names, r)) for r in found] for found in compare(rows, length)]
        out = rows[["g", "c1", "c2"]].assign(runs=pd.Series(runs, index=rows.index, dtype=object))
        return out[out.runs.map(len) > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by n-gram; whole n-grams are compared, a bounded number of windows at once."""
        waiting: list[pd.DataFrame] = []
        windows = size = 0
        for batch in batches:
            for _, rows in batch.groupby(batch.g.diff().ne(0).cumsum(), sort=False):
                if waiting and (windows > SORTED or size > SORTED_BYTES) and waiting[-1].g.iloc[-1] != rows.g.iloc[0]:
                    yield resolved(pd.concat(waiting, ignore_index=True))
                    waiting, windows, size = [], 0, 0
                waiting.append(rows)
                here = int(rows.context.map(len).sum())
                windows, size = windows + here - (length - 1) * len(rows), size + here
        if waiting:
            yield resolved(pd.concat(waiting, ignore_index=True))

    return run


STRIPS = "g long, c1 long, c2 long, times long, low int, first int, last int, m1 long, m2 long, f1 long, f2 long"


def _strips(length: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hashes of what all windows of a strip share, and of the whole strip."""
        for batch in batches:
            out = []
            for r in batch.itertuples():
                n, raw = len(r.context) - length + 1, r.context
                lowest = r.off - n + 1
                lows = range(lowest // width * width, r.off + 1, width) if r.lows is None else r.lows
                for parent in lows:
                    for low in range(parent, parent + (width if r.lows is None else r.wide), width):
                        least, most = max(low, lowest), min(low + width - 1, r.off)
                        if least > most:
                            continue
                        shared = raw[r.off - low :][: max(0, length - width + 1)]
                        full = raw[r.off - most : r.off - least + length]
                        marks = xxhash.xxh3_128_digest(shared, low) + xxhash.xxh3_128_digest(full, least * length + most)
                        out.append((r.g, r.c1, r.c2, r.times, low, r.off - most, r.off - least, *np.frombuffer(marks, np.int64)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STRIPS.split(", ")])

    return run


def _crowded(classes: DataFrame, length: int) -> DataFrame:
    """Repeated windows of n-grams with very many contexts, without a row for each window.

    Windows at neighbouring offsets form a strip. If what its windows share occurs in no other context, none
    of them does; if the whole strip occurs again, all of them do. Only strips of neither kind are cut
    and looked at again, down to single windows; these are the few around the ends of a passage.
    """
    key, found = ["g", "c1", "c2"], []
    parts = classes.select("*", F.lit(None).cast("array<int>").alias("lows"), F.lit(0).alias("wide"))
    for width in STRIP_WIDTHS:
        strips = stage(parts.mapInPandas(_strips(length, width), STRIPS), "strips")
        total = F.sum("times").alias("n")
        full = strips.groupBy("g", "low", "f1", "f2").agg(total).where("n > 1").drop("n")
        shared = strips.groupBy("g", "low", "m1", "m2").agg(total).where("n > 1").drop("n")
        found.append(strips.join(full, ["g", "low", "f1", "f2"], "left_semi").select(*key, "first", "last"))
        if width == 1:
            break
        open_ = strips.join(shared, ["g", "low", "m1", "m2"], "left_semi").join(full, ["g", "low", "f1", "f2"], "left_anti")
        open_ = stage(open_.select(*key, "low", "m1", "m2"), "open-strips")
        # A strip that is settled may still hold windows of an open one: one of its contexts stays for that.
        settled = strips.join(full, ["g", "low", "f1", "f2"], "left_semi").groupBy("g", "low", "m1", "m2", "f1", "f2")
        partner = settled.agg(F.min(F.struct("c1", "c2")).alias("c")).join(
            open_.select("g", "low", "m1", "m2").distinct(), ["g", "low", "m1", "m2"], "left_semi"
        )
        again = open_.select(*key, "low").unionAll(partner.select("g", "c.c1", "c.c2", "low"))
        lows = stage(again.groupBy(*key).agg(F.collect_set("low").alias("lows")), "next-strips")
        if lows.isEmpty():
            break
        parts = classes.join(lows, key).withColumn("wide", F.lit(width))
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionAll(more)
    return runs.groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))


CUT = T.StructType(
    [
        T.StructField("kept", T.BinaryType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def _cutter(length: int):
    @F.pandas_udf(CUT)
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, runs in zip(text, starts):
            raw = t.encode("utf-8", "surrogatepass")
            spans = [] if runs is None else _merged([(r["s"], r["e"] + length) for r in runs])
            out.append((_cut(raw, spans), [list(x) for x in spans]))
        return pd.DataFrame(out, columns=["kept", "spans"])

    return cut


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, gathered: int = GATHERED, texts: bool = True
) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes), kept (bytes) and kept_sha256 of every row.

    `texts=False` leaves `kept` null, and then texts that can't lose anything aren't written in between.
    """
    given = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"),
        row_hash().alias("k2"),
        text_or_empty().alias("text"),
    )
    key = ["k1", "k2"]
    found = given.select(*key, "text").where(F.octet_length("text") >= length)
    found = stage(found.mapInPandas(_anchor_hashes(length, gram), "k1 long, k2 long, g long, n long"), "anchors")
    again = found.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    shared = found.join(again, "g", "left_semi").groupBy(*key).agg(F.collect_set("g").alias("shared"))
    live = F.col("shared").isNotNull()
    rows = stage(
        given.join(shared, key, "left").select(
            "doc_id",
            *key,
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(live | F.lit(texts), F.col("text")).alias("text"),
            F.when(~live, F.sha2("text", 256)).alias("kept_sha256"),
            "shared",
        ),
        "repeat-rows",
    )
    some = rows.where("shared is not null").select(*key, "text", "shared")
    places = stage(some.mapInPandas(_occurrences(length, gram), OCCURRENCES), "occurrences")
    classes = stage(
        places.groupBy("g", "c1", "c2", "off").agg(
            F.count(F.lit(1)).alias("times"), F.first("context", ignorenulls=True).alias("context")
        ),
        "contexts",
    )
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("times").alias("n")).where("n > 1")
    sized = classes.join(sizes.select("g", "m"), "g")
    few = sized.where(F.col("m") <= gathered).drop("m").repartition("g").sortWithinPartitions("g")
    runs = few.mapInPandas(_comparer(length), RUNS)
    if not sizes.where(F.col("m") > gathered).isEmpty():
        crowded = stage(sized.where(F.col("m") > gathered).drop("m"), "crowded")
        runs = runs.unionByName(_crowded(crowded, length))
    runs = stage(runs, "repeat-runs")
    starts = (
        places.select(*key, "place", "off", "g", "c1", "c2")
        .join(runs, ["g", "c1", "c2"])
        .select(*key, (F.col("place") - F.col("off")).alias("from"), F.explode("runs").alias("run"))
        .groupBy(*key)
        .agg(F.collect_set(F.struct((F.col("from") + F.col("run.first")).alias("s"), (F.col("from") + F.col("run.last")).alias("e"))).alias("starts"))
    )
    hit = rows.where("shared is not null").join(starts, key, "left")
    hit = hit.withColumn("cut", _cutter(length)("text", "starts")).select(
        "doc_id",
        "n_bytes",
        F.col("cut.spans").alias("spans"),
        (F.col("cut.kept") if texts else F.lit(None).cast("binary")).alias("kept"),
        F.sha2("cut.kept", 256).alias("kept_sha256"),
    )
    clean = rows.where("shared is null").select(
        "doc_id",
        "n_bytes",
        F.array().cast("array<array<bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
        "kept_sha256",
    )
    return clean.unionByName(hit)
