"""Compression of vectors to codes of 8 bytes: integer product quantisation by member-resident Lloyd rounds.

Every vector is cut into equal consecutive parts; each position has a codebook of 16 entries. In the first
round all parts move to the owner of their nearest entry: a partition of (position, entry, salt), written
once. From then on members stay where they are. In each later round an owner looks which of its members are
nearer to another entry now, and only those go through the shuffle, to be written as members of their new
owner. Files of members are never written again: whether a member has left follows from the codebooks since
it arrived, which every task holds (a few numbers per entry). An entry's sum and count are carried on by what
arrived and what left, exactly, in integers. So a round reads the resident members and shuffles and writes
those that move; a lost executor costs the tasks it ran. At the end all vectors are encoded where they lie.

The salt deals the members of one entry to owners of a bounded size, so an entry that holds most parts (one
common vector) is no larger a task than others.

Vectors that are null or hold null or non-finite components are dropped. Vectors may differ in length: the
width is the longest one's, rounded up to a multiple of the positions, and missing components count as zero.
The first codebook is taken from the least ids, each once; of rows that repeat an id the least vector counts,
and a null id is never among them. With fewer ids than entries there are fewer entries; with none at all nothing
can be encoded, and the result is empty. Rows that repeat are
members and are encoded each. An empty table gives an empty result; further columns are ignored. A scaled
component must be small enough for squared distances to fit into a long, else the call is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ready
from tidewatch.session import shared_path, stage

POSITIONS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Members an owner holds at most, about.
OWNER_ROWS = 4096

MEMBERS = "position int, origin int, entry int, salt long, part array<long>"
# `origin` of a part that had no owner before.
NOWHERE = -1


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(lists: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Lists as rows of a matrix, missing places zero."""
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), kind)
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def scaled(lists: pa.Array, width: int) -> np.ndarray:
    return np.floor(SCALE * matrix(lists, width, np.float64)).astype(np.int64)


def as_lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def nearest(entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of `entries` for each of `parts`, ties to the lower one, and its squared distance."""
    best, least = np.zeros(len(parts), np.int32), None
    for i, entry in enumerate(entries):
        away = ((parts - entry) ** 2).sum(axis=1)
        if least is None:
            least = away
        else:
            nearer = away < least
            best[nearer], least = i, np.minimum(least, away)
    return best, least


def _nearest_by_position(codebook: np.ndarray, position: np.ndarray, parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts), np.int32)
    for p in np.unique(position):
        here = position == p
        out[here] = nearest(codebook[p], parts[here])[0]
    return out


def first_entries(vectors: DataFrame, width: int, positions: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the least ids: positions x entries x width of a part."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.empty(0, np.int64), np.empty((0, width), np.int64)
        for batch in batches:
            ids = np.concatenate([ids, np.asarray(batch.column("vec_id"))])
            rows = np.concatenate([rows, scaled(batch.column("embedding"), width)])
            order = np.lexsort((*rows.T[::-1], ids))
            ids, rows = ids[order], rows[order]
            new = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)
            ids, rows = ids[new][:entries], rows[new][:entries]
        yield pa.RecordBatch.from_arrays([pa.array(ids), as_lists(rows)], names=["vec_id", "whole"])

    few = vectors.where("vec_id is not null").select("vec_id", "embedding")
    found = few.mapInArrow(least, "vec_id long, whole array<long>").groupBy("vec_id").agg(F.min("whole").alias("whole"))
    rows = [r["whole"] for r in found.orderBy("vec_id").limit(entries).collect()]
    return np.array(rows, np.int64).reshape(len(rows), positions, width // positions).transpose(1, 0, 2)


def _arrivals(codebook: np.ndarray, width: int, positions: int, salts: int):
    """All parts as members of their first owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            parts = scaled(batch.column("embedding"), width).reshape(-1, width // positions)
            n = len(parts)
            position = np.tile(np.arange(positions, dtype=np.int32), n // positions)
            salt = (turn + np.arange(n, dtype=np.int64) // positions) % salts
            turn = (turn + n // positions) % salts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(position),
                    pa.array(np.full(n, NOWHERE, np.int32)),
                    pa.array(_nearest_by_position(codebook, position, parts)),
                    pa.array(salt),
                    as_lists(parts),
                ],
                names=["position", "origin", "entry", "salt", "part"],
            )

    return run


def _movers(codebooks: list[np.ndarray]):
    """Members for which the last codebook has a nearer entry than their owner's, with that as the new owner."""
    part_width = codebooks[0].shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            born = np.asarray(batch.column("born"))
            position, entry, salt = (np.asarray(batch.column(c)) for c in ("position", "entry", "salt"))
            parts = matrix(batch.column("part"), part_width)
            live, wants = np.ones(len(born), bool), entry.copy()
            for k in range(int(born.min(initial=len(codebooks))), len(codebooks)):
                asked = np.nonzero(live & (born <= k))[0]
                wants[asked] = _nearest_by_position(codebooks[k], position[asked], parts[asked])
                if k < len(codebooks) - 1:
                    live &= wants == entry
            go = np.nonzero(live & (wants != entry))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[go]) for x in (position, entry, wants, salt)] + [as_lists(parts[go])],
                names=["position", "origin", "entry", "salt", "part"],
            )

    return run


def _sums(positions: int, entries: int, part_width: int):
    """What the members of a file add to their new owner's count and sums and take from the old one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, part_width + 1), object)
        for batch in batches:
            parts = matrix(batch.column("part"), part_width)
            rows = np.concatenate([np.ones((len(parts), 1), np.int64), parts], axis=1)
            for column, sign in (("entry", 1), ("origin", -1)):
                at = np.asarray(batch.column(column))
                owner = np.asarray(batch.column("position")) * entries + at
                change = np.zeros(total.shape, np.int64)
                np.add.at(change, owner[at != NOWHERE], rows[at != NOWHERE])
                total += sign * change.astype(object)
        owners = np.nonzero((total != 0).any(axis=1))[0]
        # As text, since sums over a very large file may not fit into a long.
        values = pa.array([[str(x) for x in total[o]] for o in owners], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(owners.astype(np.int32)), values], names=["owner", "values"])

    return run


def _totals(members: DataFrame, positions: int, entries: int, part_width: int) -> np.ndarray:
    each = members.mapInArrow(_sums(positions, entries, part_width), "owner int, values array<string>")
    each = each.select("owner", F.posexplode("values").alias("place", "value"))
    out = np.zeros((positions * entries, part_width + 1), object)
    # One row per position, entry and component.
    for row in each.groupBy("owner", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("n")).collect():
        out[row["owner"], row["place"]] = int(row["n"])
    return out


def train(
    vectors: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS, owner_rows: int = OWNER_ROWS
) -> np.ndarray:
    """The codebooks after all rounds: positions x entries x width of a part, integers.

    `vectors` has vec_id and embedding. Fewer rounds run if one moves nothing, since nothing changes any more.
    """
    spark = ready(vectors.sparkSession)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")))
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), largest.alias("largest")).first()
    part_width = max(1, -(-(size["width"] or 0) // positions))
    if part_width * (2 * SCALE * (size["largest"] or 0.0) + 2) ** 2 >= 2**62:
        raise ValueError(f"components up to {size['largest']} give squared distances that don't fit into a long")
    codebooks = [first_entries(kept, part_width * positions, positions, entries)]
    entries = codebooks[0].shape[1]
    if not entries:
        return codebooks[0]
    totals = np.zeros((positions * entries, part_width + 1), object)
    members: list[DataFrame] = []
    salts = max(1, -(-size["n"] // owner_rows))
    for number in range(1, rounds + 1):
        if number == 1:
            arriving = kept.select("embedding").mapInArrow(
                _arrivals(codebooks[0], part_width * positions, positions, salts), MEMBERS
            )
        else:
            born = (m.withColumn("born", F.lit(i + 1)) for i, m in enumerate(members))
            arriving = reduce(DataFrame.unionAll, born).mapInArrow(_movers(codebooks), MEMBERS)
        path = shared_path(spark, f"members-{number}")
        arriving.repartition("position", "entry", "salt").write.parquet(path)
        members.append(spark.read.schema(MEMBERS).parquet(path))
        change = _totals(members[-1], positions, entries, part_width)
        if not change.any() and number > 1:
            break
        totals += change
        codebook = codebooks[-1].copy().reshape(positions * entries, part_width)
        for owner in np.nonzero(totals[:, 0])[0]:
            codebook[owner] = [int(x) // int(totals[owner, 0]) for x in totals[owner, 1:]]
        codebooks.append(codebook.reshape(positions, entries, part_width))
    return codebooks[-1]


def encode(vectors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """vec_id, label, code (one index per part, two hex digits each) and error of every usable vector."""
    positions, _, part_width = codebook.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = scaled(batch.column("embedding"), positions * part_width)
            code, error = np.zeros(len(whole), f"U{2 * positions}"), np.zeros(len(whole), np.int64)
            for p in range(positions):
                best, away = nearest(codebook[p], whole[:, p * part_width : (p + 1) * part_width])
                code, error = np.char.add(code, digits[best]), error + away
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return given.where(usable(F.col("embedding"))).mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def digest(codebook: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place, as decimal text joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in codebook.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    codebook = train(vectors)
    if not codebook.shape[1]:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    coded = stage(encode(vectors, codebook), "codes")
    # Written, so that the join goes by the true size of the labels: sent to all, or shuffled and split where skewed.
    of_label = stage(coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebook)).alias("codebooks_sha256")
    )
