"""Near duplicates by SimHash, found through a hierarchical index over fingerprints in Gray order.

Fingerprints: each word shingle is hashed with XXH64, and a bit is set if it is set in over half the hashes.
Equal fingerprints collapse to one row first. The rest is a search for pairs that differ in few bits:

* Two fingerprints within `distance` bits agree in one of `distance + 1` bit bands, so the top of the index
  is (band, its bits). Such a group is kept in the order of Gray ranks, where neighbours share many bits. A
  group of any size is cut into runs of bounded length along that order.
* A run is an upper node: a mask of the bits that all its members share, and their values. Pairs of runs of a
  group whose shared bits differ too often are dropped before any member is looked at.
* Within a pair of runs the same is repeated down a tree: a child adds only the bits that its parents did not
  share, differences are added up on the way, and whole subtrees are left out once they exceed the distance.
* A pair of runs reports a spanning forest of its links, never all pairs.

Components of these links are the groups. Null text counts as empty; no words give fingerprint zero, which
links like any other; a null doc_id never names a component unless all of it is null; repeated rows each get
a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import keep_rows, row_hash, text_or_empty
from tidewatch.llm.components import components
from tidewatch.operators.order import add_bucket, known_sizes
from tidewatch.session import stage

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
# Members of a run, the unit that one task compares with another of its group.
RUN = 8192
LEAF = 32
FAN_OUT = 8
# Leaf pairs compared at once.
CHUNK = 2048


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a text."""
    hashes = shingle_hashes(text or "")
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        counts += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return text.map(fingerprint, na_action=None).astype("int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _h and the fingerprint of every row."""
    return docs.select("doc_id", row_hash().alias("_h"), _fingerprints(text_or_empty()).alias("fp"))


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, as a bigint that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def band_masks(distance: int) -> list[int]:
    """Bit masks of `distance + 1` bands, as signed numbers."""
    edges = [BITS * i // (distance + 1) for i in range(distance + 2)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


class Tree:
    """Fingerprints in Gray order under nodes of shared bits; level 0 are the leaves."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        ones, zeros = codes, ~codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        step = LEAF
        while True:
            at = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones | zeros, ones))
            if len(ones) == 1:
                return
            step = FAN_OUT


def _children(parents: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each parent its children, and which parent each belongs to."""
    of = np.repeat(np.arange(len(parents)), FAN_OUT)
    child = parents[of] * FAN_OUT + np.tile(np.arange(FAN_OUT), len(parents))
    there = child < n
    return child[there], of[there]


def close_leaves(left: Tree, right: Tree, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose shared bits differ in at most `distance` places."""
    lower = min(len(left.levels), len(right.levels)) - 1
    a = np.arange(len(left.levels[lower][0]))
    b = np.arange(len(right.levels[lower][0]))
    a, b = np.repeat(a, len(b)), np.tile(b, len(a))
    known = np.zeros(len(a), np.uint64)
    apart = np.zeros(len(a), np.int64)
    for level in range(lower, -1, -1):
        (ma, va), (mb, vb) = left.levels[level], right.levels[level]
        if level < lower:
            a, of = _children(a, len(ma))
            b, known, apart = b[of], known[of], apart[of]
            b, of = _children(b, len(mb))
            a, known, apart = a[of], known[of], apart[of]
        shared = ma[a] & mb[b]
        apart = apart + np.bitwise_count((va[a] ^ vb[b]) & shared & ~known)
        keep = apart <= distance
        if same:
            keep &= a <= b
        a, b, known, apart = a[keep], b[keep], shared[keep], apart[keep]
    return a, b


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked places the least label among them, in place."""
    while len(x):
        lx, ly = label[x], label[y]
        apart = lx != ly
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label[:] = short


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the codes of a run, or between two runs (Gray order, unsigned)."""
    same = right is None
    ta = Tree(left)
    tb = ta if same else Tree(right)
    codes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(codes))
    la, lb = close_leaves(ta, tb, distance, same)
    inside = np.arange(LEAF)
    for at in range(0, len(la), CHUNK):
        x = la[at : at + CHUNK, None] * LEAF + inside
        y = lb[at : at + CHUNK, None] * LEAF + inside
        cx = left[np.minimum(x, len(left) - 1)][:, :, None]
        cy = tb.codes[np.minimum(y, len(tb.codes) - 1)][:, None, :]
        near = np.bitwise_count(cx ^ cy) <= distance
        near &= (x < len(left))[:, :, None] & (y < len(tb.codes))[:, None, :]
        k, i, j = np.nonzero(near)
        _merge(label, x[k, i], y[k, j] + shift)
    moved = np.nonzero(label != np.arange(len(codes)))[0]
    return codes[moved], codes[label[moved]]


def _gray_order(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return codes[np.argsort(rank, kind="stable")]


PAIR = ["band", "bits", "low", "high"]


def _searcher(distance: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pair of runs; a pair may span batches and is at most two runs long."""

        def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = rows[PAIR].to_numpy()
            new = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            codes, side = rows.fp.to_numpy().view(np.uint64), rows.side.to_numpy()
            out = []
            for s, e in zip([0, *new], [*new, len(rows)]):
                if e - s > 1:
                    first, second = codes[s:e][side[s:e] == 0], codes[s:e][side[s:e] == 1]
                    alone = keys[s][2] == keys[s][3]
                    out.append(forest(_gray_order(first), None if alone else _gray_order(second), distance))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pd.DataFrame({"a": a, "b": b})

        waiting = None
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[PAIR] == rows[PAIR].iloc[-1]).all(axis=1).to_numpy()
            begin = len(rows) - int(last[::-1].cumprod().sum())
            yield from links(rows.iloc[:begin]) if begin else ()
            waiting = rows.iloc[begin:]
        if waiting is not None and len(waiting):
            yield from links(waiting)

    return search


def links(codes: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Spanning links (a, b) of the distinct codes in column `fp` that are within `distance` bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in band_masks(distance)])
    banded = stage(
        codes.select("fp", F.posexplode(masks).alias("band", "mask")).select(
            "band", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), gray_rank(F.col("fp")).alias("rank"), "fp"
        ),
        "banded",
    )
    group = ["band", "bits"]
    sizes = banded.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    if (largest := known_sizes(sizes, "n")).largest <= run:
        cut = banded.withColumn("_bucket", F.lit(0))
    else:
        # Only groups beyond one run are cut; `add_bucket` aims at a tenth of the rows it is given.
        large = sizes.where(F.col("n") > run).select(*group, F.lit(True).alias("large"))
        marked = banded.join(large, group, "left")
        over = stage(marked.where("large").drop("large"), "large-groups")
        cut = marked.where("large is null").drop("large").withColumn("_bucket", F.lit(0)).unionByName(
            add_bucket(over, group, ["rank"], known_sizes(sizes.where(F.col("n") > run), "n"), run * 4)
        )
    cut = stage(cut, "runs") if largest.largest > run else cut
    nodes = cut.groupBy(*group, "_bucket").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros"))
    nodes = stage(nodes, "nodes") if largest.largest > run else nodes
    low = nodes.select(*group, F.col("_bucket").alias("low"), F.col("ones").alias("ones_l"), F.col("zeros").alias("zeros_l"))
    high = nodes.select(*group, F.col("_bucket").alias("high"), "ones", "zeros")
    differ = F.col("ones").bitwiseAND(F.col("zeros_l")).bitwiseOR(F.col("zeros").bitwiseAND(F.col("ones_l")))
    pairs = low.join(high, group).where((F.col("low") <= F.col("high")) & (F.bit_count(differ) <= distance))
    sides = pairs.select(*group, "low", "high", F.col("low").alias("_bucket"), F.lit(0).alias("side")).unionAll(
        pairs.where("low < high").select(*group, "low", "high", F.col("high").alias("_bucket"), F.lit(1).alias("side"))
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return (
        cut.join(sides, [*group, "_bucket"])
        .select(*PAIR, "side", "fp")
        .repartition(*PAIR)
        .sortWithinPartitions(*PAIR)
        .mapInPandas(_searcher(distance), schema)
    )


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, _h, fp, component (a fingerprint) and component_id (the least doc_id reachable) of every row."""
    found = stage(fingerprints(docs), "fingerprints")
    codes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    joined = components(links(codes.select("fp"), distance)).withColumnRenamed("node", "fp")
    member = codes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(member.join(ids, "component").select("fp", "component", "component_id"), "classes")
    return found.join(named, "fp").select("doc_id", "_h", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` that stay, one of each class, with all their columns."""
    found = classes(docs, distance)
    # A class may hold a doc_id more than once; of its texts the one with the least hash stays.
    rows = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_h")).alias("k"))
    return keep_rows(docs, rows.select("k.doc_id", "k._h"))
