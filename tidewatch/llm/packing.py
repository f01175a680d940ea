"""Packing of token sequences into windows by non-negative least squares on the histogram of lengths.

Documents become token pieces of at most a window. The histogram of piece lengths, which has one entry per
length and so the same size for any corpus, is what is solved on the driver: all combinations of up to three
lengths that fill a window exactly are the columns of a system whose right side is the histogram, and block
coordinate descent finds repeat counts that are not negative. The counts are rounded, as far as pieces are
there for them; what is left is packed greedily, longest first, each gap taking the longest piece that fits.

The plan gives every length intervals of ranks with their sequences and offsets. Pieces are ranked within
their length where they are written, partition by partition, and the pieces of earlier partitions are added,
so no length, however common, is ordered in one task.

Null text counts as empty and still has its closing token; a null doc_id is packed like any other; repeated
rows are packed once each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import text_or_empty
from tidewatch.session import stage

WINDOW = 2048
END = 1
DEPTH = 3
ROUNDS = 60
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all documents, staged: PIECES, and `ids` (little-endian 32-bit) if asked for.

    `vocabulary` is the path of a byte-level file of the tokenizers library; strings of its added tokens in a
    text become their ids, as that library has it. `place` counts the pieces of the same length before it in its partition.
    """
    with open(vocabulary or public_tokenizers.path(tokens.BYTES), "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.byte_tokenizer(sent.value).encode
        part, placed = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            out = []
            for doc, text in zip(batch.doc_id, batch.text):
                ids = encode(text)
                ids.append(END)
                ids = np.array(ids, "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n, raw = len(piece), piece.tobytes()
                    row = (doc, start, n, zlib.crc32(raw), len(ids), part, int(placed[n]))
                    out.append((*row, raw) if keep_ids else row)
                    placed[n] += 1
            names = [c.split()[0] for c in schema.split(", ")]
            found = pd.DataFrame(out, columns=names)
            found["doc_id"] = pd.array([None if d is None else int(d) for d in found["doc_id"]], "Int64")
            yield found

    schema = PIECES + (", ids binary" if keep_ids else "")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # As text, since pandas would turn ids of a batch with a null into floats.
    given = given.withColumn("doc_id", F.col("doc_id").cast("string"))
    return stage(given.mapInPandas(cut, schema), "pieces")


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """All ascending tuples of up to three of `lengths` with the sum `window`; unused places hold 0."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = [np.array([[0, 0, window]])] if there[window] else []
    if depth >= 2:
        a = lengths[lengths <= window // 2]
        a = a[there[window - a]]
        out.append(np.stack([0 * a, a, window - a], axis=1))
    if depth >= 3:
        for a in lengths[lengths <= window // 3]:
            b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
            b = b[there[window - a - b]]
            out.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def repeats(columns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Counts >= 0, one per column, that bring the sum of columns near the histogram in least squares.

    Each round takes columns of steepest descent that share no length, and sets each to its best value; the
    columns in use take turns too, and may shrink.
    """
    x = np.zeros(len(columns))
    rest = histogram.astype(float).copy()
    rest[0] = 0.0
    norm = sum((columns == c[:, None]).sum(axis=1) * (c > 0) for c in columns.T).astype(float)
    last = np.inf
    for _ in range(rounds):
        slope = rest[columns].sum(axis=1)
        gain = np.where((slope > 0) | (x > 0), np.abs(slope) / np.sqrt(norm), 0.0)
        gain = np.where(slope < 0, np.minimum(gain, x * np.sqrt(norm)), gain)
        top = np.argpartition(-gain, min(8192, len(gain) - 1))[:8192]
        used = np.zeros(len(rest), bool)
        for c in top[np.argsort(-gain[top], kind="stable")]:
            if gain[c] <= 0:
                break
            of = columns[c][columns[c] > 0]
            if used[of].any():
                continue
            used[of] = True
            new = max(0.0, x[c] + slope[c] / norm[c])
            np.subtract.at(rest, of, new - x[c])
            x[c] = new
        left = float(rest @ rest)
        if left >= last * (1 - 1e-4):
            break
        last = left
    return x


@dataclass
class Plan:
    """Sequences as (distinct lengths with their number, times this sequence is made)."""

    made: list[tuple[list[tuple[int, int]], int]]
    by_squares: int

    def slots(self) -> list[tuple[int, int, int, int, int, int]]:
        """length, ranks from and to, pieces of it per sequence, first sequence, offset of the first piece."""
        out, ranks, first = [], {}, 0
        for parts, times in self.made:
            offset = 0
            for length, per in parts:
                begin = ranks.get(length, 0)
                ranks[length] = begin + per * times
                out.append((length, begin, ranks[length], per, first, offset))
                offset += length * per
            first += times
        return out


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """How to pack pieces of which `histogram[n]` have the length n."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[list[tuple[int, int]], int]] = []
    columns = combinations(np.nonzero(left)[0], window, depth)
    if len(columns):
        x = repeats(columns, left)
        for c in np.argsort(-x, kind="stable"):
            if x[c] < 0.5:
                break
            lengths, per = np.unique(columns[c][columns[c] > 0], return_counts=True)
            times = int(min(np.rint(x[c]), (left[lengths] // per).min()))
            if times > 0:
                left[lengths] -= per * times
                made.append((list(zip(lengths[::-1].tolist(), per[::-1].tolist())), times))
    by_squares = sum(times for _, times in made)
    while (there := np.nonzero(left)[0]).size:
        gap, parts = window, []
        while gap > 0:
            at = int(np.searchsorted(there, gap, "right")) - 1
            if at < 0:
                break
            length = int(there[at])
            per = int(min(gap // length, left[length]))
            parts.append((length, per))
            gap -= length * per
            there = there[:at]
        times = int(min(left[length] // per for length, per in parts))
        for length, per in parts:
            left[length] -= per * times
        made.append((parts, times))
    return Plan(made, by_squares)


def pack(found: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """The staged pieces with their sequence_id and offset."""
    spark = found.sparkSession
    counts = stage(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    # One row per length, at most `window`.
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = plan(histogram, window, depth).slots()
    names = "of_length long, low long, high long, per long, first long, at long"
    # A few entries per length, whatever the number of pieces.
    intervals = F.broadcast(spark.createDataFrame(slots, names))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    fits = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    kept = [c for c in found.columns if c not in ("part", "place")]
    return ranked.join(intervals, fits).select(
        *kept,
        (F.col("first") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("length") * (turn % F.col("per"))).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """Whole windows of token ids from packed pieces with `ids`: sequence_id, tokens, ids."""

    def fill(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("offset")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in batch.ids]).astype(np.int64)
        full = window if len(ids) & (len(ids) - 1) else len(ids)
        padded = np.concatenate([ids, np.full(full - len(ids), pad)])
        return pd.DataFrame({"sequence_id": batch.sequence_id.iloc[:1], "tokens": [len(ids)], "ids": [padded.tolist()]})

    return packed.groupBy("sequence_id").applyInPandas(fill, "sequence_id long, tokens long, ids array<long>")
