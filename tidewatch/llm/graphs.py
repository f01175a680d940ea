"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat arrays.

Vectors stay in the partitions they are read from; every run of up to SHARD rows of a partition becomes a
shard with a graph of its own, one row of the index table. Equal vectors of a shard are one node with all
their ids. A node's level is drawn from a geometric distribution, and nodes are ordered by falling level, so
that a layer is a prefix of them. In each layer a node chooses its neighbours among its nearest nodes there
and its nearest ones of the layer above: from near to far, it takes those that lie nearer to it than to any
neighbour taken before; then links run back, and a full list chooses again. The nearest nodes of a layer
come from matrix products over blocks of the shard, whose size is fixed, so building takes time in
proportion to the rows. All layers' neighbour lists stand one after the other in one integer array.

A search enters at the first node and keeps the best nodes found per layer (BEAM of them in the lowest),
following neighbour arrays until all of these have been followed, for a block of queries in step. If a beam can't
be filled, the shard is scanned for that query. Nodes found become rows, own rows are left out, and distances
are taken anew in double precision from the vectors as given. The shards' lists are merged by Spark.

Queries go out in blocks of a bounded number, each in one pass over the index and one written table.

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part.
Vectors may differ in length; missing components count as zero. Rows that repeat an id are candidates each,
none of them for queries of that id; of a query's rows the least vector is the query. Ties go to the smaller
id. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ready
from tidewatch.session import shared_path, stage

TOP = 10
SHARD = 8192
# Neighbours of a node in the lowest layer and in those above.
LINKS, UPPER_LINKS = 32, 16
# Nearest nodes of a layer, and of the one above, that a node chooses its neighbours from.
NEAR, ABOVE = 48, 8
# Best nodes kept while a layer is searched.
BEAM, UPPER_BEAM = 160, 16
# Nodes followed per query in a step, queries in step, and queries sent to the tasks at once.
FOLLOW, IN_STEP, BLOCK = 8, 256, 16384

INDEX = "ids array<long>, starts array<int>, width int, vectors binary, layers array<int>, neighbours array<int>"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of doubles, missing places zero."""
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), max(width, lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


class Graph:
    """Nodes with ids, vectors and neighbour lists, all of them flat arrays.

    ids[starts[n] : starts[n + 1]] are the ascending ids of node n; layer l holds the first layers[l] nodes,
    and its neighbour lists, filled up with -1, follow those of the layers below.
    """

    def __init__(self, ids, starts, vectors, layers, neighbours):
        self.ids, self.starts, self.vectors, self.layers, self.neighbours = ids, starts, vectors, layers, neighbours
        # Distances on the way are taken in single precision, scaled so that squares neither overflow nor vanish.
        most = float(np.abs(vectors).max(initial=0.0))
        self.scale = 2.0 ** -math.frexp(most)[1] if most else 1.0
        self.near = (vectors * self.scale).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.near, self.near)

    def links(self, layer: int) -> np.ndarray:
        before = sum(n * _links(k) for k, n in enumerate(self.layers[:layer]))
        n, width = int(self.layers[layer]), _links(layer)
        return self.neighbours[before : before + n * width].reshape(n, width)


def _links(layer: int) -> int:
    return UPPER_LINKS if layer else LINKS


def _nearest(near: np.ndarray, squares: np.ndarray, rows: np.ndarray, of: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` nearest of the first `of` nodes for each of `rows` (not itself), nearest first, and squared distances."""
    away = squares[:of] + squares[rows][:, None] - 2 * (near[rows] @ near[:of].T)
    own = rows < of
    away[np.nonzero(own)[0], rows[own]] = np.inf
    count = min(count, of)
    found = np.argpartition(away, count - 1, axis=1)[:, :count] if count < of else np.tile(np.arange(of), (len(rows), 1))
    away = np.take_along_axis(away, found, axis=1)
    order = np.argsort(away, axis=1, kind="stable")
    found, away = np.take_along_axis(found, order, axis=1), np.take_along_axis(away, order, axis=1)
    return np.where(np.isinf(away), -1, found), away


def choose(near: np.ndarray, found: np.ndarray, away: np.ndarray, count: int) -> np.ndarray:
    """Per row, up to `count` of the nodes `found` (ascending by `away`, -1 for none) that are nearer to the row
    than to any chosen before; places left go to the nearest of the others."""
    rows, width = found.shape
    taken = np.zeros((rows, width), bool)
    vectors = near[found]
    squares = np.einsum("ijk,ijk->ij", vectors, vectors)
    between = squares[:, :, None] + squares[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    there = found >= 0
    for c in range(width):
        blocked = (taken[:, :c] & (between[:, c, :c] <= away[:, c, None])).any(axis=1)
        taken[:, c] = there[:, c] & ~blocked & (taken[:, :c].sum(axis=1) < count)
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :count]
    out = np.take_along_axis(found, order, axis=1)
    return np.pad(out, ((0, 0), (0, max(0, count - width))), constant_values=-1)


def _both(first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of nodes with distances as one, without repeats, nearest first."""
    found, away = np.concatenate([first[0], second[0]], axis=1), np.concatenate([first[1], second[1]], axis=1)
    order = np.argsort(found, axis=1, kind="stable")
    found, away = np.take_along_axis(found, order, axis=1), np.take_along_axis(away, order, axis=1)
    again = np.concatenate([np.zeros((len(found), 1), bool), found[:, 1:] == found[:, :-1]], axis=1)
    found, away = np.where(again, -1, found), np.where(again | (found < 0), np.inf, away)
    order = np.argsort(away, axis=1, kind="stable")
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(away, order, axis=1)


def _layer(near: np.ndarray, squares: np.ndarray, size: int, above: int, count: int) -> np.ndarray:
    """Neighbour lists of the first `size` nodes, of which the first `above` are in the layer above too."""
    links = np.full((size, count), -1, np.int32)
    for start in range(0, size, 512):
        rows = np.arange(start, min(size, start + 512))
        found = _nearest(near, squares, rows, size, NEAR)
        if above:
            found = _both(found, _nearest(near, squares, rows, above, ABOVE))
        links[rows] = choose(near, *found, count)
    # Links back: a node's list gains those that chose it; if there are too many, it chooses among the nearest again.
    source, place = np.nonzero(links >= 0)
    target = links[source, place]
    away = squares[source] + squares[target] - 2 * np.einsum("ij,ij->i", near[source], near[target])
    node, other = np.concatenate([source, target]), np.concatenate([target, source])
    away = np.concatenate([away, away])
    _, first = np.unique(node.astype(np.int64) * size + other, return_index=True)
    node, other, away = node[first], other[first], away[first]
    order = np.lexsort((away, node))
    node, other, away = node[order], other[order], away[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    width = 2 * count
    kept = rank < width
    found, far = np.full((size, width), -1, np.int64), np.full((size, width), np.inf, np.float32)
    found[node[kept], rank[kept]], far[node[kept], rank[kept]] = other[kept], away[kept]
    for start in range(0, size, 2048):
        part = slice(start, start + 2048)
        links[part] = choose(near, found[part], far[part], count)
    return links


def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """The graph of a shard's rows; rows with the same vector share a node."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    firsts = np.nonzero(new)[0]
    n = len(firsts)
    # A fixed seed: a shard that is built again is the same.
    level = np.floor(-np.log(1 - np.random.default_rng(0).random(n)) / math.log(UPPER_LINKS)).astype(int)
    by_level = np.argsort(-level, kind="stable")
    sizes = np.diff(np.append(firsts, len(ids)))[by_level]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(firsts[by_level], sizes) + np.arange(len(ids)) - np.repeat(starts[:-1], sizes)
    layers = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
    graph = Graph(ids[rows], starts, vectors[firsts[by_level]], np.array(layers), np.empty(0, np.int32))
    lists = []
    for k, size in enumerate(layers):
        above = layers[k + 1] if k + 1 < len(layers) else 0
        lists.append(_layer(graph.near, graph.squares, size, above, _links(k)).ravel())
    graph.neighbours = np.concatenate(lists)
    return graph


def _follow(graph: Graph, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    """Per query, up to `beam` best nodes reached over `links` from the nodes `start`, nearest first; -1 for none."""
    q, n = len(queries), len(links)
    nodes, away = np.full((q, beam), -1, np.int32), np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    squares = np.einsum("ij,ij->i", queries, queries)

    def distance(who: np.ndarray, node: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", queries[who], graph.near[node])
        return squares[who] + graph.squares[node] - 2 * dots

    who, place = np.nonzero(start >= 0)
    fresh = start[who, place]
    stamp = np.empty(q * n, np.int32)
    while len(who):
        # Each node once per query: the last one to leave its mark stays.
        flat = who * n + fresh
        stamp[flat] = np.arange(len(flat))
        once = (stamp[flat] == np.arange(len(flat))) & ~seen.ravel()[flat]
        who, fresh = who[once], fresh[once]
        seen[who, fresh] = True
        found = distance(who, fresh)
        better = found < away[who, -1]
        who, fresh, found = who[better], fresh[better], found[better]
        if len(who):
            counts = np.bincount(who, minlength=q)
            touched = np.nonzero(counts)[0]
            offsets = np.cumsum(counts) - counts
            order = np.argsort(who, kind="stable")
            who, fresh, found = who[order], fresh[order], found[order]
            slot = np.arange(len(who)) - offsets[who]
            row = np.searchsorted(touched, who)
            shape = (len(touched), counts.max())
            more, far = np.full(shape, -1, np.int32), np.full(shape, np.inf, np.float32)
            more[row, slot], far[row, slot] = fresh, found
            all_nodes = np.concatenate([nodes[touched], more], axis=1)
            all_away = np.concatenate([away[touched], far], axis=1)
            all_done = np.concatenate([done[touched], more < 0], axis=1)
            best = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
            nodes[touched] = np.take_along_axis(all_nodes, best, axis=1)
            away[touched] = np.take_along_axis(all_away, best, axis=1)
            done[touched] = np.take_along_axis(all_done, best, axis=1)
        first = ~done & (np.cumsum(~done, axis=1) <= FOLLOW)
        who, place = np.nonzero(first)
        done[who, place] = True
        reached = links[nodes[who, place]]
        who = np.repeat(who, links.shape[1])
        fresh = reached.ravel()
        there = fresh >= 0
        who, fresh = who[there], fresh[there]
    return nodes


def search(graph: Graph, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Per query, the nodes found near it: queries x nodes, -1 for none."""
    out = []
    n = len(graph.vectors)
    for at in range(0, len(queries), IN_STEP):
        asked = (queries[at : at + IN_STEP] * graph.scale).astype(np.float32)
        if n <= beam:
            out.append(np.tile(np.arange(n, dtype=np.int32), (len(asked), 1)))
            continue
        found = np.zeros((len(asked), 1), np.int32)
        for layer in range(len(graph.layers) - 1, -1, -1):
            found = _follow(graph, graph.links(layer), asked, found, UPPER_BEAM if layer else beam)
        closed = np.nonzero(found[:, -1] < 0)[0]
        if len(closed):
            # The part of the graph that was entered has no way out: look at all nodes.
            away = graph.squares - 2 * (asked[closed] @ graph.near.T)
            found[closed] = np.argpartition(away, beam - 1, axis=1)[:, :beam]
        out.append(found)
    return np.concatenate(out) if out else np.empty((0, 0), np.int32)


def _rows_near(graph: Graph, query_id: int, query: np.ndarray, nodes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the `top` nearest rows of the given nodes, but those of the query's id."""
    nodes = nodes[nodes >= 0]
    away = np.sqrt(((graph.vectors[nodes] - query) ** 2).sum(axis=1))
    order = np.argsort(away, kind="stable")
    # Nodes at the same distance as the last one needed are all looked at, for the smaller ids.
    ids, far, last = [], [], np.inf
    for i in order:
        if away[i] > last:
            break
        own = graph.ids[graph.starts[nodes[i]] : graph.starts[nodes[i] + 1]]
        own = own[own != query_id][:top]
        ids.extend(own.tolist())
        far.extend([away[i]] * len(own))
        if len(ids) >= top:
            last = away[i]
    ids, far = np.array(ids, np.int64), np.array(far)
    order = np.lexsort((ids, far))[:top]
    return ids[order], far[order]


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        width = max(int(np.asarray(b.column("embedding").value_lengths()).max(initial=0)) for b in parts)
        graph = build(
            np.concatenate([np.asarray(b.column("vec_id")) for b in parts]),
            np.concatenate([matrix(b.column("embedding"), width) for b in parts]),
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array([graph.ids], pa.list_(pa.int64())),
                pa.array([graph.starts], pa.list_(pa.int32())),
                pa.array([width], pa.int32()),
                pa.array([graph.vectors.astype("<f8").tobytes()], pa.binary()),
                pa.array([graph.layers], pa.list_(pa.int32())),
                pa.array([graph.neighbours], pa.list_(pa.int32())),
            ],
            names=["ids", "starts", "width", "vectors", "layers", "neighbours"],
        )

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = SHARD - sum(b.num_rows for b in waiting)
            waiting.append(batch.slice(at, room))
            at += room
            if sum(b.num_rows for b in waiting) == SHARD:
                yield row(waiting)
                waiting = []
    if waiting:
        yield row(waiting)


def index(vectors: DataFrame) -> DataFrame:
    """The written index of `vectors` (vec_id, embedding): one row per shard."""
    ready(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return stage(given.where(usable(F.col("embedding"))).mapInArrow(_builder, INDEX), "shards")


def _searcher(sent, top: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name, i=i, batch=batch: np.asarray(batch.column(name)[i].values)
                width = batch.column("width")[i].as_py()
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<f8").reshape(-1, width)
                common = max(width, queries.shape[1])
                vectors = np.pad(vectors, ((0, 0), (0, common - width)))
                asked = np.pad(queries, ((0, 0), (0, common - queries.shape[1])))
                graph = Graph(value("ids"), value("starts"), vectors, value("layers"), value("neighbours"))
                nodes = search(graph, asked, beam)
                found = [_rows_near(graph, q, v, near, top) for q, v, near in zip(query_ids, asked, nodes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, [len(ids) for ids, _ in found])),
                        pa.array(np.concatenate([ids for ids, _ in found])),
                        pa.array(np.concatenate([far for _, far in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def nearest(shards: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """The `top` nearest found in a written index for each of `queries` (vec_id, embedding): query_id, rank, vec_id, score."""
    spark = ready(shards.sparkSession)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    asked = asked.where(usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stage(asked, "near-queries")
    blocks = -(-asked.count() // block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    path = shared_path(spark, "near-found")
    for number in range(blocks):
        of_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number
        rows = asked.where(of_block).orderBy("vec_id").toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast(
            (np.asarray(rows.column("vec_id")), matrix(rows.column("embedding").combine_chunks()))
        )
        shards.mapInArrow(_searcher(sent, top, max(beam, top + 1)), FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    merged = spark.read.schema(FOUND).parquet(path).withColumn("rank", place).where(F.col("rank") <= top)
    return merged.select("query_id", "rank", "vec_id", "score")
