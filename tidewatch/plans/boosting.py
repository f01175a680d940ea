"""Second-order boosted trees as Spark jobs: histograms of gradients over binned rows, level by level.

Rows are binned once: a number by cuts at its quantiles, a category by its index, and written. In each round the
rows taken and the columns taken follow from hashes. At a level of a tree every task adds up gradients and hessians per
node, feature and bin. For a number the sums run up to each bin and for a category over it alone, so every summed
cell is a split by itself; a category feature is split into one category against the others, and its first category
has no column. Missing numbers go to the side on which they gain more.

Rows that agree in bins, outcome and use have the same score throughout: they are a cell, which is scored, routed and
added up once, and a round only counts how many of its rows it takes. Cells with their scores and rows are held as
arrays in the partitions of a persisted RDD, cut along the cells but not by them, so that a very common one is spread
over partitions. A round draws its gradients from it, and a level is one job over these: each partition gives its sums, which are added up in the order of the partitions, so that the driver gets one histogram of
a level per partition. Behind each tree the scores are brought up to date in a new RDD, and every ten rounds this is
checkpointed, so that a lost executor costs the rounds since then. A table of at most TASK_ROWS rows needs
no job per level: the task that reads it goes through the rounds by itself, row by row, with the same histograms.

Where the sums are too many for the driver (categories of any size cost one cell per row), they go by key to tasks that
return the best split of each node they saw. There the rows are written with their score, and every ten rounds anew, so
that no job evaluates more than ten trees.

A round begins with the sums of all gradients and the loss of the rows that watch; training ends in the round
in which that loss had its least value long enough ago, and no later round is fitted.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_path, stage, temporary_tables
from tidewatch.sources import tables

BINS = 256
ACCURACY = 10_000
# The usual regularisation of a leaf, and the least sum of hessians in it.
LEAF_PENALTY, LEAST_HESSIAN = 1.0, 1.0
LEAST_GAIN = 1e-6
# Trees a task evaluates on top of the written scores, at most.
WRITTEN_EVERY = 10
# Rows up to which a single task goes through all rounds, about 100 bytes each.
TASK_ROWS = 1 << 20
# Rows of the state in a file, about; each file is read by a task of its own.
FILE_ROWS = 1 << 17
# Cells a task works on at once, rows of such a cell on average, and rows of a held partition, at most.
CHUNK_ROWS, CELL_ROWS, PART_ROWS = 1 << 16, 1 << 4, 1 << 23
# Rows whose hashes are made at once: so few that they stay in a processor's cache.
HASHED_ROWS = 1 << 14
# Bytes of sums that the driver gets at once, at most.
TOLD_BYTES = 1 << 25
# Cells up to which sums and routes have an array with all places.
DENSE = 1 << 20
# Columns up to which a round takes the exact share of them; beyond, a hash decides each one.
COUNTED_COLUMNS = 1 << 16
MISSING = -1
STATE = "row long, y double, weight double, watches boolean, bins array<int>, raw double"


@dataclass(frozen=True)
class Layout:
    """Where features lie: numbers first with their ascending cuts, then categories with their sizes."""

    cuts: list[np.ndarray]
    sizes: list[int]

    @property
    def width(self) -> int:
        return len(self.cuts) + sum(max(0, n - 1) for n in self.sizes)

    def column(self, feature: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Column of the prepared vector that a cell belongs to; -1 for the first category of a feature."""
        before = np.concatenate([[0], np.cumsum([max(0, n - 1) for n in self.sizes])]).astype(np.int64)
        numbers = len(self.cuts)
        category = np.maximum(feature - numbers, 0)
        of_category = np.where(place > 0, numbers + before[category] + place - 1, -1)
        return np.where(feature < numbers, feature, of_category)


@dataclass
class Tree:
    """Nodes by heap number from 1; a node without feature is a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 << self.depth
        self.feature, self.place = np.full(n, -1, np.int32), np.zeros(n, np.int64)
        self.missing_left, self.value, self.gain = np.zeros(n, bool), np.zeros(n), np.zeros(n)

    def route(self, bins: np.ndarray, numbers: int) -> np.ndarray:
        """The node each row ends in."""
        node = np.ones(len(bins), np.int64)
        going = np.arange(len(bins)) if self.feature[1] >= 0 else np.empty(0, np.int64)
        while len(going):
            self.step(bins, numbers, node, going)
            going = going[self.feature[node[going]] >= 0]
        return node

    def step(self, bins: np.ndarray, numbers: int, node: np.ndarray, going: np.ndarray) -> None:
        """Put the rows `going`, whose nodes are split, one level lower in `node`."""
        at = node[going]
        feature, place = self.feature[at], self.place[at]
        held = bins[going, feature]
        left = np.where(feature < numbers, held <= place, held != place)
        absent = (feature < numbers) & (held == MISSING)
        left = np.where(absent, self.missing_left[at], left)
        node[going] = 2 * at + ~left

    def below(self, numbers: int, width: int) -> np.ndarray:
        """The node one level lower by node and bin, a missing one first; leaves stay."""
        out = np.repeat(np.arange(len(self.feature))[:, None], width, axis=1)
        bins = np.arange(-1, width - 1)
        for node in np.nonzero(self.feature >= 0)[0].tolist():
            left = bins <= self.place[node] if self.feature[node] < numbers else bins != self.place[node]
            if self.feature[node] < numbers:
                left[0] = self.missing_left[node]
            out[node] = 2 * node + ~left
        return out


def _mixed(*parts: int | np.ndarray) -> np.ndarray:
    """A 64-bit hash of integers, the same in every task, as a share of 1."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            out = out ^ np.asarray(part).astype(np.int64).view(np.uint64)
            out = (out + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out / 2.0**64


@cache
def _first_beyond(share: float) -> int:
    """The least 64-bit hash that isn't below a share of 1, as `_mixed` gives it."""
    low, high = 0, 1 << 64
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if np.uint64(middle) / 2.0**64 < share else (low, middle)
    return low


def rows_taken(row: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which rows a round takes: those whose `_mixed(seed, -1 - number, row)` is below the share."""
    least = _first_beyond(share)
    if least == 1 << 64:
        return np.ones(len(row), bool)
    known, last = 0, (1 << 64) - 1
    for part in (seed, -1 - number):
        known = ((known ^ part & last) + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & last
        known = (known ^ known >> 27) * 0x94D049BB133111EB & last
        known ^= known >> 31
    out, row = np.empty(len(row), bool), row.view(np.uint64)
    for low in range(0, len(row), HASHED_ROWS):
        mixed = row[low : low + HASHED_ROWS] ^ np.uint64(known)
        mixed += np.uint64(0x9E3779B97F4A7C15)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        np.less(mixed, np.uint64(least), out=out[low : low + HASHED_ROWS])
    return out


def columns_taken(columns: np.ndarray, width: int, share: float, seed: int, number: int) -> np.ndarray:
    """Which columns a round uses: the share of them with the least hashes, at least one."""
    if share >= 1:
        return np.ones(len(columns), bool)
    least = share
    if width <= COUNTED_COLUMNS:
        least = np.sort(_mixed(seed, number, np.arange(width)))[max(1, int(share * width)) - 1]
    return _mixed(seed, number, columns) <= least


def find_cuts(rows: DataFrame, numbers: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending distinct values at the quantiles of each number, at most `bins` - 1; one aggregate over the rows."""
    if not numbers:
        return []
    shares = [i / bins for i in range(1, bins)]
    clean = [F.when(~F.isnan(n), F.col(n)) for n in numbers]
    row = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"c{i}") for i, c in enumerate(clean)]).first()
    return [np.unique(np.array(cuts or [], float)) for cuts in row]


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.asarray(batch.column("bins").flatten()).reshape(-1, features)


def _binned(rows: DataFrame, numbers: Sequence[str], codes: Sequence[str], layout: Layout, weight: float) -> DataFrame:
    """The first state: `rows` has the features, `y` and `watches`."""
    features = len(numbers) + len(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.full((batch.num_rows, features), MISSING, np.int32)
            for i, cuts in enumerate(layout.cuts):
                value = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float)
                bins[:, i] = np.where(np.isnan(value), MISSING, np.searchsorted(cuts, value, "left"))
            for i in range(len(codes)):
                code = batch.column(f"c{i}").fill_null(MISSING)
                bins[:, len(numbers) + i] = np.asarray(code)
            y = np.asarray(batch.column("y"))
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * features
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(y),
                    pa.array(np.where(y == 1, weight, 1.0)),
                    batch.column("watches"),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(bins.ravel())),
                    pa.array(np.zeros(batch.num_rows)),
                ],
                names=["row", "y", "weight", "watches", "bins", "raw"],
            )

    given = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("y").cast("double").alias("y"),
        F.coalesce("watches", F.lit(False)).alias("watches"),
        *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(numbers)],
        *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(codes)],
    )
    return given.where("y is not null").mapInArrow(run, STATE)


@dataclass
class _Round:
    """What the tasks of a round need; sent to them anew for each job."""

    layout: Layout
    number: int
    seed: int
    row_share: float
    column_share: float
    behind: list[Tree]
    tree: Tree | None = None
    # Nodes of the level at work with their sums of gradients and hessians.
    nodes: np.ndarray | None = None
    sums: np.ndarray | None = None

    @property
    def numbers(self) -> int:
        return len(self.layout.cuts)

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bins = _matrix(batch, self.numbers + len(self.layout.sizes))
        raw = np.asarray(batch.column("raw")).copy()
        for tree in self.behind:
            raw += tree.value[tree.route(bins, self.numbers)]
        return bins, raw

    def gradients(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins, gradients and hessians of the rows this round learns from."""
        bins, raw = self.scores(batch)
        taken = self.taken(np.asarray(batch.column("row")), _watches(batch))
        return bins[taken], *_gradients(raw[taken], *(np.asarray(batch.column(c))[taken] for c in ("y", "weight")))

    def taken(self, row: np.ndarray, watches: np.ndarray) -> np.ndarray:
        """Which rows this round learns from."""
        if self.row_share >= 1:
            return ~watches
        return ~watches & rows_taken(row, self.row_share, self.seed, self.number)


def _watches(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("watches").to_numpy(zero_copy_only=False))


def _gradients(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-raw))
    return weight * (p - y), weight * p * (1 - p)


def _log_loss(raw: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the log losses of so many rows each, and their number."""
    return np.array([(rows * np.logaddexp(0, np.where(y == 1, -raw, raw))).sum(), rows.sum()])


def _loss(of: _Round, batch: pa.RecordBatch) -> np.ndarray:
    """Log loss of the watching rows, and their number."""
    watches = _watches(batch)
    if not watches.any():
        return np.zeros(2)
    raw = of.scores(batch)[1][watches]
    return _log_loss(raw, np.asarray(batch.column("y"))[watches], np.ones(len(raw)))


def _begin(sent):
    """Sums of a round: gradient, hessian, loss of the watching rows and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        total = np.zeros(4)
        for batch in batches:
            _, g, h = of.gradients(batch)
            total += g.sum(), h.sum(), *_loss(of, batch)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=["g", "h", "loss", "n"])

    return run


CELLS = "node long, feature int, place long, g double, h double, g_missing double, h_missing double"
_CELL_NAMES = [c.split()[0] for c in CELLS.split(", ")]


class _Histogram:
    """Sums per node, feature and bin over some rows; for numbers, over all bins up to it."""

    def __init__(self, of: _Round):
        self.of, count = of, len(of.nodes)
        # Rows in nodes of other levels are counted behind those of this one, and left out.
        self.local = np.full(2 << of.tree.depth, count, np.int64)
        self.local[of.nodes] = np.arange(count)
        self.places = max([len(c) + 1 for c in of.layout.cuts], default=0)
        self.total = np.zeros((count, of.numbers, self.places + 1, 2))
        self.codes = {i: np.zeros((count, n + 1, 2)) for i, n in enumerate(of.layout.sizes) if (count + 1) * (n + 1) <= DENSE}
        self.sparse = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]

    def add(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray) -> None:
        """Rows, as one line of bins per feature, with their nodes."""
        of, count, places = self.of, len(self.of.nodes), self.places
        node = self.local[node]

        def summed(held: np.ndarray, width: int, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            key = start + held
            for k, x in enumerate((g, h)):
                yield k, np.bincount(key, x, (count + 1) * width).reshape(count + 1, -1)[:count]

        start = node * (places + 1) + 1
        for i in range(of.numbers):
            # Missing ones come first here, and last in the total.
            for k, sums in summed(bins[i], places + 1, start):
                self.total[:, i, :-1, k] += sums[:, 1:]
                self.total[:, i, -1, k] += sums[:, 0]
        for i, size in enumerate(of.layout.sizes):
            if i in self.codes:
                for k, sums in summed(bins[of.numbers + i], size + 1, node * (size + 1) + 1):
                    self.codes[i][:, :, k] += sums
            else:
                code = bins[of.numbers + i].astype(np.int64)
                some = np.nonzero((code > 0) & (node < count))[0]
                self.put(node[some] * len(of.layout.sizes) + i, code[some], g[some], h[some])

    def put(self, *sparse: np.ndarray) -> None:
        """Add sums of categories: owner (node and feature), code, gradients and hessians."""
        self.sparse = _summed([np.append(x, y) for x, y in zip(self.sparse, sparse)])

    def merge(self, total: np.ndarray, codes: dict[int, np.ndarray], sparse: list[np.ndarray]) -> None:
        """Add the sums of other rows."""
        self.total = self.total + total
        self.codes = {i: x + codes[i] for i, x in self.codes.items()}
        self.put(*sparse)

    def cells(self) -> list[np.ndarray]:
        of, total = self.of, self.total
        out = [np.empty(0)] * 7
        if of.numbers:
            run = total[:, :, :-1].cumsum(axis=2)
            there = np.broadcast_to(np.abs(total).sum(axis=(1, 2, 3))[:, None, None] > 0, run.shape[:3]).copy()
            for i, cuts in enumerate(of.layout.cuts):
                # The last bin holds all that isn't missing: a split only where something is.
                there[:, i, len(cuts) + 1 :] = False
            node, feature, place = np.nonzero(there)
            out = [of.nodes[node], feature, place, *run[node, feature, place].T, *total[node, feature, -1].T]
        for i, sums in self.codes.items():
            # Unknown categories are on the side of the others, the first one has no column.
            node, code = np.nonzero(sums[:, 2:].any(axis=2))
            self.put(node * len(of.layout.sizes) + i, code + 1, *sums[node, code + 2].T)
        self.codes = {}
        owner, code, g, h = self.sparse
        if len(owner):
            sizes, zero = len(of.layout.sizes), np.zeros(len(owner))
            more = [of.nodes[owner // sizes], of.numbers + owner % sizes, code, g, h, zero, zero]
            out = [np.append(x, y) for x, y in zip(out, more)]
        kinds = [np.int64, np.int32, np.int64, *[np.float64] * 4]
        return [x.astype(k) for x, k in zip(out, kinds)]


def _cells(sent):
    """The histogram of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        held = _Histogram(of)
        for batch in batches:
            bins, g, h = of.gradients(batch)
            held.add(bins.T, g, h, of.tree.route(bins, of.numbers))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.cells()], names=_CELL_NAMES)

    return run


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sums per pair of the first two columns."""
    a, b, *values = columns
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    at = np.nonzero(new)[0]
    return [a[new], b[new], *[np.add.reduceat(v[order], at) if len(at) else v for v in values]]


BEST = "node long, loss double, feature int, place long, missing_left boolean, g_left double, h_left double"
# A split as (minus its gain, feature, place, missing_left, g_left, h_left): the least is the best, so ties go to
# the lower feature and place, whatever the order of the cells.
Found = dict[int, tuple]


def _best_of(of: _Round, cells: Sequence[np.ndarray], held: Found) -> None:
    """Put the best split per node among summed cells into `held`."""
    node, feature, place, g, h, g_missing, h_missing = cells
    column = of.layout.column(feature, place)
    allowed = (column >= 0) & columns_taken(column, of.layout.width, of.column_share, of.seed, of.number)
    total = of.sums[np.searchsorted(of.nodes, node)]
    category = feature >= of.numbers
    for left in (False, True):
        # A category's own rows are the right side: its column is 1 there.
        g_left = np.where(category, total[:, 0] - g, g + left * g_missing)
        h_left = np.where(category, total[:, 1] - h, h + left * h_missing)
        gain = np.where(allowed, split_gain(g_left, h_left, total[:, 0], total[:, 1]), -np.inf)
        order = np.lexsort((place, feature, -gain, node))
        first = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])] if len(order) else order
        for i in first[gain[first] > LEAST_GAIN]:
            found = (-gain[i], int(feature[i]), int(place[i]), left, float(g_left[i]), float(h_left[i]))
            held[int(node[i])] = min(held.get(int(node[i]), found), found)


def _best(sent):
    """The best split of each node among the cells of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Found = {}
        for batch in batches:
            _best_of(sent.value, [np.asarray(batch.column(c)) for c in _CELL_NAMES], held)
        kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()]
        columns = zip(*((node, *found) for node, found in held.items())) if held else [()] * 7
        names = [c.split()[0] for c in BEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def split_gain(g_left, h_left, g, h):
    """What a split of a node with the sums (g, h) takes off the loss; nothing where a side is too light."""
    score = lambda a, b: a * a / (b + LEAF_PENALTY)
    gain = (score(g_left, h_left) + score(g - g_left, h - h_left) - score(g, h)) / 2
    gain = np.where((h_left >= LEAST_HESSIAN) & (h - h_left >= LEAST_HESSIAN), gain, -np.inf)
    # To nine digits: splits that gain the same remain a tie, in whatever order the sums were taken.
    part, power = np.frexp(gain)
    return np.ldexp(np.rint(part * 2.0**30), power - 30)


def _grow(of: _Round, g: float, h: float, depth: int, rate: float, best: Callable[[], Found]) -> Tree:
    """One tree, level by level as long as nodes split; `best` finds the splits of the level that `of` is at."""
    tree = of.tree = Tree(depth)
    sums = {1: (g, h)}
    for level in range(depth + 1):
        for node, (g_node, h_node) in sums.items():
            tree.value[node] = -rate * g_node / (h_node + LEAF_PENALTY)
        if level == depth or not sums:
            break
        of.nodes = np.array(sorted(sums), np.int64)
        of.sums = np.array([sums[n] for n in of.nodes.tolist()])
        below = {}
        for node, (loss, feature, place, left, g_left, h_left) in best().items():
            tree.feature[node], tree.place[node], tree.missing_left[node], tree.gain[node] = feature, place, left, -loss
            below[2 * node] = g_left, h_left
            below[2 * node + 1] = sums[node][0] - g_left, sums[node][1] - h_left
        sums = below
    return tree


def _level_by_jobs(state: DataFrame, of: _Round) -> Found:
    sent = state.sparkSession.sparkContext.broadcast(of)
    cells = state.mapInArrow(_cells(sent), CELLS).groupBy("node", "feature", "place")
    summed = cells.agg(*[F.sum(c).alias(c) for c in _CELL_NAMES[3:]])
    held: Found = {}
    # One row per node and task.
    for r in summed.mapInArrow(_best(sent), BEST).collect():
        node, *found = r
        held[node] = min(held.get(node, tuple(found)), tuple(found))
    sent.unpersist()
    return held


@dataclass
class _Progress:
    """The trees fitted so far, and the losses of the watching rows before the first one and after each."""

    params: object
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def ended(self, loss: float, watched: float) -> bool:
        """Note the loss behind the trees, and tell whether no tree is fitted any more."""
        if watched:
            self.losses.append(loss / watched)
        enough = len(self.trees) == self.params.rounds
        return enough or bool(self.losses) and int(np.argmin(self.losses)) + self.params.patience <= len(self.trees)


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in bytes, if they fit."""
    few = x.astype(np.int8)
    return few if np.array_equal(few, x) else x


class _Chunk:
    """Cells with their raw scores, and with their nodes in the tree that grows.

    `row` holds the rows of all cells side by side, `first` where those of each begin.
    """

    def __init__(self, *columns: np.ndarray):
        self.bins, self.first, self.row, self.y, self.weight, self.raw, self.watches = columns
        self.at, self.node = np.arange(len(self.first)), np.ones(len(self.first), np.int64)

    def __reduce__(self):
        return _Chunk, (self.bins, self.first, self.row, self.y, self.weight, self.raw, self.watches)

    def begin(self, of: _Round) -> np.ndarray:
        """Sums of the gradients, the hessians and the losses, and the number of rows that watch."""
        rows = np.diff(np.append(self.first, len(self.row)))
        taken = rows
        if of.row_share < 1:
            each = rows_taken(self.row, of.row_share, of.seed, of.number)
            # A sum over each cell costs more, and is of no use where all cells are single rows.
            before = np.append(0, np.cumsum(each, dtype=np.int32)) if len(rows) < len(each) else None
            taken = each if before is None else np.diff(before[np.append(self.first, len(each))])
        taken = np.where(self.watches, 0, taken)
        self.g, self.h = (taken * x for x in _gradients(self.raw, self.y, self.weight))
        loss = _log_loss(self.raw[self.watches], self.y[self.watches], rows[self.watches])
        return np.array([self.g[taken > 0].sum(), self.h[taken > 0].sum(), *loss])

    def follow(self, tree: Tree, numbers: int, below: np.ndarray | None) -> None:
        """Cells in nodes that are split go one level down."""
        if below is None:
            tree.step(self.bins.T, numbers, self.node, np.nonzero(tree.feature[self.node] >= 0)[0])
        else:
            line = np.maximum(tree.feature, 0).astype(np.int64) * len(self.at)
            held = self.bins.ravel()[line[self.node] + self.at]
            self.node = below.ravel()[self.node * below.shape[1] + 1 + held]

    def end(self, tree: Tree) -> None:
        self.raw = self.raw + tree.value[self.node]
        self.node = np.ones(len(self.at), np.int64)


class _Drawn(_Chunk):
    """What the levels of a round need of a chunk: its cells with their gradients, and its sums, without the rows."""

    def __init__(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, begun: np.ndarray):
        self.bins, self.g, self.h, self.begun = bins, g, h, begun
        self.at, self.node = np.arange(len(g)), np.ones(len(g), np.int64)

    def __reduce__(self):
        return _Drawn, (self.bins, self.g, self.h, self.begun)


def _width(layout: Layout) -> int:
    """Places of a bin: those of numbers or categories, and the missing one."""
    return max([*(len(c) + 1 for c in layout.cuts), *layout.sizes], default=0) + 1


def _cells_of(batch: pa.RecordBatch, features: int, kind: type, ordered: bool) -> list[np.ndarray]:
    """What a chunk has, for one batch: rows side by side that agree are a cell if they are in order, else each row is."""
    bins, watches = _matrix(batch, features).astype(kind), _watches(batch)
    row, *values = (np.asarray(batch.column(c)) for c in ("row", "y", "weight", "raw"))
    new = np.ones(len(row), bool)
    if ordered:
        new[1:] = (bins[1:] != bins[:-1]).any(axis=1)
        for x in (*values, watches):
            new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new).astype(np.int32)
    return [bins[first], first, row, *(x[first] for x in (*values, watches))]


def _chunks(batches: Iterator[pa.RecordBatch], layout: Layout, ordered: bool = False) -> Iterator[_Chunk]:
    kind, parts = np.int16 if _width(layout) < 1 << 15 else np.int32, []
    features = len(layout.cuts) + len(layout.sizes)

    def chunk() -> _Chunk:
        before = 0
        for x in parts:
            x[1] = x[1] + np.int32(before)
            before += len(x[2])
        bins, first, row, y, weight, raw, watches = (np.concatenate(x) for x in zip(*parts))
        return _Chunk(np.ascontiguousarray(bins.T), first, row, _small(y), _small(weight), raw, watches)

    for b in batches:
        parts.append(_cells_of(b, features, kind, ordered))
        if sum(len(x[1]) for x in parts) >= CHUNK_ROWS or sum(len(x[2]) for x in parts) >= CHUNK_ROWS * CELL_ROWS:
            yield chunk()
            parts = []
    if parts:
        yield chunk()


def _followed(chunk: _Chunk, tree: Tree, layout: Layout, levels: int, below: np.ndarray | None) -> _Chunk:
    for _ in range(levels):
        chunk.follow(tree, len(layout.cuts), below)
    return chunk


def _below(tree: Tree, layout: Layout) -> np.ndarray | None:
    return tree.below(len(layout.cuts), _width(layout)) if len(tree.feature) * _width(layout) <= DENSE else None


TREE = "number int, loss double, watched double, feature array<int>, place array<long>, missing_left array<boolean>, value array<double>, gain array<double>"
_TREE_NAMES = ("feature", "place", "missing_left", "value", "gain")


def _whole(sent):
    """All rounds over a small state, in the task that has read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, progress = sent.value
        params, told = progress.params, []
        chunks = list(_chunks(batches, layout))

        def follow(tree: Tree) -> None:
            below = _below(tree, layout)
            for chunk in chunks:
                _followed(chunk, tree, layout, 1, below)

        def best() -> Found:
            if of.nodes[0] > 1:
                follow(of.tree)
            histogram, held = _Histogram(of), {}
            for chunk in chunks:
                histogram.add(chunk.bins, chunk.g, chunk.h, chunk.node)
            _best_of(of, histogram.cells(), held)
            return held

        while True:
            of = _Round(layout, len(progress.trees), params.seed, params.row_share, params.column_share, [])
            g, h, loss, watched = sum((chunk.begin(of) for chunk in chunks), np.zeros(4)).tolist()
            told.append((loss, watched))
            if progress.ended(loss, watched):
                break
            tree = _grow(of, g, h, params.depth, params.rate, best)
            # Splits of the last level were not followed yet.
            follow(tree)
            for chunk in chunks:
                chunk.end(tree)
            progress.trees.append(tree)
        kinds = [getattr(Tree(0), name).dtype for name in _TREE_NAMES]
        cells = [[*(getattr(t, name).tolist() for t in progress.trees), None] for name in _TREE_NAMES]
        columns = [pa.array(range(len(told)), pa.int32()), *[pa.array(x, pa.float64()) for x in zip(*told)]]
        columns += [pa.array(x, pa.list_(pa.from_numpy_dtype(k))) for x, k in zip(cells, kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TREE.split(", ")])

    return run


def _fit_by_one_task(state: DataFrame, layout: Layout, progress: _Progress) -> None:
    sent = state.sparkSession.sparkContext.broadcast((layout, progress))
    # first() would end the Python worker before its time.
    found = state.coalesce(1).mapInArrow(_whole(sent), TREE).collect()
    sent.unpersist()
    for row in sorted(found, key=lambda r: r["number"]):
        if not progress.ended(row["loss"], row["watched"]):
            tree = Tree(progress.params.depth)
            for name in _TREE_NAMES:
                setattr(tree, name, np.array(row[name], getattr(tree, name).dtype))
            progress.trees.append(tree)


def _partitions(spark: SparkSession, rows: int, layout: Layout, depth: int) -> int:
    """How many partitions hold the rows; 0 if their sums would be too many for the driver."""
    cells = max(1, 1 << depth - 1) * (sum(len(c) + 2 for c in layout.cuts) + sum(layout.sizes))
    told = TOLD_BYTES // (16 * cells)
    least = max(2, -(-rows // PART_ROWS))
    files = -(-rows // FILE_ROWS)
    return max(least, min(files, spark.sparkContext.defaultParallelism, told)) if least <= told else 0


def _packed(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, layout, ordered=True):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chunk)], pa.binary())], names=["chunk"])

    return run


def _drawn(held: RDD, of: _Round) -> RDD:
    """The chunks as the levels of a round need them."""

    def run(chunks: Iterator[_Chunk]) -> Iterator[_Drawn]:
        for chunk in chunks:
            begun = chunk.begin(of)
            yield _Drawn(chunk.bins, chunk.g, chunk.h, begun)

    return held.mapPartitions(run, preservesPartitioning=True)


def _sums(drawn: RDD, of: _Round, levels: int) -> tuple[np.ndarray, _Histogram]:
    """Sums of a round as `_Chunk.begin` has them, and the histogram of the level that `of` is at."""

    def run(chunks: Iterator[_Drawn]) -> Iterator[tuple]:
        begun, histogram, below = np.zeros(4), _Histogram(of), _below(of.tree, of.layout)
        for chunk in chunks:
            begun += chunk.begun
            _followed(chunk, of.tree, of.layout, levels, below)
            histogram.add(chunk.bins, chunk.g, chunk.h, chunk.node)
        yield begun, histogram.total, histogram.codes, histogram.sparse

    begun, histogram = np.zeros(4), _Histogram(of)
    for more, *sums in drawn.mapPartitions(run).collect():
        begun += more
        histogram.merge(*sums)
    return begun, histogram


def _advance(held: RDD, tree: Tree, layout: Layout) -> RDD:
    """The rows with the scores behind one more tree."""

    def run(chunks: Iterator[_Chunk]) -> Iterator[_Chunk]:
        below = _below(tree, layout)
        for chunk in chunks:
            _followed(chunk, tree, layout, tree.depth, below).end(tree)
            yield chunk

    return held.mapPartitions(run, preservesPartitioning=True)


def _fit_held(state: DataFrame, layout: Layout, progress: _Progress, partitions: int) -> None:
    """All rounds by jobs over a persisted RDD of chunks; a round costs a pass over the cells, and a hash per row."""
    spark, params, trees = state.sparkSession, progress.params, progress.trees
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "boosting-checkpoint"))
    # Rows of a cell side by side, and all in their order, so that a partition that is built again adds up the same.
    order = [F.xxhash64("bins", "y", "watches"), F.col("row")]
    rows = state.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    held = rows.mapInArrow(_packed(layout), "chunk binary").rdd.map(lambda r: pickle.loads(bytes(r["chunk"])))
    held, before, behind = held.persist(StorageLevel.MEMORY_AND_DISK), None, None
    while True:
        of = _Round(layout, len(trees), params.seed, params.row_share, params.column_share, [])
        of.tree, of.nodes = Tree(params.depth), np.ones(1, np.int64)
        drawn = _drawn(held, of).persist(StorageLevel.MEMORY_AND_DISK)
        begun, root = _sums(drawn, of, 0)
        if before is not None:
            before.unpersist()
        g, h, loss, watched = begun.tolist()
        if progress.ended(loss, watched):
            drawn.unpersist()
            break

        def best() -> Found:
            level, found = int(of.nodes[0]).bit_length() - 1, {}
            _best_of(of, (_sums(drawn, of, level)[1] if level else root).cells(), found)
            return found

        tree = _grow(of, g, h, params.depth, params.rate, best)
        trees.append(tree)
        drawn.unpersist()
        before, held = held, _advance(held, tree, layout).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % WRITTEN_EVERY == 0:
            held.checkpoint()
            held.count()
            if behind:
                tables.drop_path(spark, behind)
            behind = held.getCheckpointFile()
    held.unpersist()
    if behind:
        tables.drop_path(spark, behind)


def _round_by_jobs(state: DataFrame, of: _Round, progress: _Progress) -> Tree | None:
    """A round by a job per level; none is started if the loss says that training ends."""
    sent = state.sparkSession.sparkContext.broadcast(of)
    begun = state.mapInArrow(_begin(sent), "g double, h double, loss double, n double")
    g, h, loss, watched = sum((np.array(list(r)) for r in begun.collect()), np.zeros(4))
    sent.unpersist()
    if progress.ended(loss, watched):
        return None
    return _grow(of, g, h, progress.params.depth, progress.params.rate, lambda: _level_by_jobs(state, of))


def _advanced(sent):
    """The state with the scores of the trees behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array(sent.value.scores(batch)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=batch.schema.names)

    return run


def _fit_by_jobs(state: DataFrame, layout: Layout, progress: _Progress) -> None:
    """All rounds by a job per level, over rows that are read anew in each."""
    spark, params, trees = state.sparkSession, progress.params, progress.trees
    written, behind = 0, None
    while True:
        of = _Round(layout, len(trees), params.seed, params.row_share, params.column_share, trees[written:])
        tree = _round_by_jobs(state, of, progress)
        if tree is None:
            break
        trees.append(tree)
        if len(trees) - written >= WRITTEN_EVERY:
            of = _Round(layout, len(trees), params.seed, 1.0, 1.0, trees[written:])
            sent, path = spark.sparkContext.broadcast(of), shared_path(spark, "boosting")
            state.mapInArrow(_advanced(sent), STATE).write.parquet(path)
            if behind:
                tables.drop_path(spark, behind)
            state, behind, written = spark.read.schema(STATE).parquet(path), path, len(trees)
    if behind:
        tables.drop_path(spark, behind)


@dataclass
class Ensemble:
    layout: Layout
    trees: list[Tree]
    # Loss of the watching rows before the first tree and after each one that was fitted.
    losses: list[float]

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees:
            out += tree.value[tree.route(bins, len(self.layout.cuts))]
        return out

    def as_spark(self, spark: SparkSession) -> GBTClassificationModel:
        """The same trees as a Spark ML model over the prepared vector, which scores without Python.

        Its vectors have no missing places, so the sides of missing values are not carried over.
        """
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        ml, width = jvm.org.apache.spark.ml, self.layout.width
        stats = gateway.new_array(gateway.jvm.double, 3)
        noted = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, 0)
        # Looked up once: each name of a package is a call of its own, and there are thousands of nodes.
        leaf, inner, continuous = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit

        def node(tree: Tree, at: int):
            if tree.feature[at] < 0:
                return leaf(float(tree.value[at]), 0.0, noted)
            feature, place = int(tree.feature[at]), int(tree.place[at])
            is_number = feature < len(self.layout.cuts)
            cuts = self.layout.cuts[feature] if is_number else None
            # The last bin has no cut above it: all that isn't missing goes left.
            threshold = (float(cuts[place]) if place < len(cuts) else float("inf")) if is_number else 0.5
            column = int(self.layout.column(np.array([feature]), np.array([place]))[0])
            split = continuous(column, threshold)
            left, right = node(tree, 2 * at), node(tree, 2 * at + 1)
            return inner(float(tree.value[at]), 0.0, float(tree.gain[at]), left, right, split, noted)

        trees = self.trees or [Tree(0)]
        kind = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        held, weights = gateway.new_array(kind, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
        for i, tree in enumerate(trees):
            held[i] = ml.regression.DecisionTreeRegressionModel(f"tree_{uuid.uuid4().hex[:12]}", node(tree, 1), width)
            # Spark's margin is half the log odds.
            weights[i] = 0.5
        uid = f"GBTClassificationModel_{uuid.uuid4().hex[:12]}"
        model = GBTClassificationModel(ml.classification.GBTClassificationModel(uid, held, weights, width, 2))
        model._resetUid(uid)
        return model


def fit(
    rows: DataFrame,
    numbers: Sequence[str],
    categories: dict[str, int],
    params,
    target: str,
    watching: str | None = None,
) -> Ensemble:
    """Fit on `rows`: columns of numbers (null for missing), and of category indices (null for unknown) with their sizes.

    `params` has rounds, depth, rate, row_share, column_share, positive_weight, patience and seed. `watching`
    names a boolean column; its rows are not learned from and decide when to stop. Rows without target are left out.
    """
    spark = rows.sparkSession
    given = rows.withColumn("y", F.col(target).cast("double")).withColumn("watches", F.col(watching) if watching else F.lit(False))
    given = given.where("y is not null")
    layout = Layout(find_cuts(given.where("not coalesce(watches, false)"), numbers), list(categories.values()))
    progress = _Progress(params)
    with temporary_tables(spark):
        binned = _binned(given, numbers, list(categories), layout, params.positive_weight)
        rows_given = given.count()
        state = stage(binned.repartition(max(1, -(-rows_given // FILE_ROWS)), "row"), "boosting")
        if rows_given <= TASK_ROWS:
            _fit_by_one_task(state, layout, progress)
        elif partitions := _partitions(spark, rows_given, layout, params.depth):
            _fit_held(state, layout, progress, partitions)
        else:
            _fit_by_jobs(state, layout, progress)
    trees, losses = progress.trees, progress.losses
    kept = int(np.argmin(losses)) if losses else len(trees)
    return Ensemble(layout, trees[: max(kept, 1)], losses)
