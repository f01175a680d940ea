"""Exact top-k search by inner product: MaxScore over shards of integer vectors.

A component is a term and its integer value the weight of a posting. Vectors stay in the partitions they are
read from; a task turns each batch of them into a shard with one posting list and the largest and smallest
weight per term. For a query the terms are ordered by the most they can add. Terms whose bounds together can't
lift a vector to the score it must beat are not essential: the essential postings are traversed, and the
others are only probed, one after the other, for vectors that can still compete. What a query has found in
a shard is the bar for the next one; the shards' lists are merged at the end.

Queries go out in blocks of a bounded number, each in one pass over the vectors and one written table.

Components become floor(256 * x). A vector without id, null, or with a null or non-finite component takes no
part. Vectors may differ in length; missing components count as zero. Rows that repeat an id are candidates
each, none of them for queries of that id; of a query's rows the least vector is the query. Ties go to the
smaller id. Weights must give scores that fit into a long. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ready
from tidewatch.session import shared_path, stage

SCALE = 256
TOP = 5
# Queries sent to the tasks at once, and vectors of a shard.
BLOCK = 4096
SHARD = 4096
# Probed terms between two looks at which vectors still compete.
PROBES = 4
EXACT_FLOAT = 2**53


def integer_weights(vector: Column) -> Column:
    """Scaled integer components, or null if the vector takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as columns, one row per term."""
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), max(width, lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(lists.flatten())
    return np.ascontiguousarray(out.T)


class Shard:
    """Posting lists of a batch of vectors with their bounds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids = ids
        self.most, self.least = np.maximum(weights.max(axis=1), 0), np.minimum(weights.min(axis=1), 0)
        self.weights = weights

    def as_kind(self, kind: type) -> np.ndarray:
        if self.weights.dtype != kind:
            self.weights = self.weights.astype(kind)
        return self.weights


def search(shard: Shard, query_id: int, query: np.ndarray, bar: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of all vectors of the shard that reach the bar (any, if there is none), but the query's own."""
    query = query[: len(shard.most)]
    terms = np.nonzero(query)[0]
    bound = np.maximum(query[terms] * shard.most[terms], query[terms] * shard.least[terms])
    order = np.argsort(-bound, kind="stable")
    terms, bound = terms[order], bound[order]
    beyond = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])
    largest = np.abs(query[terms]) * np.maximum(shard.most[terms], -shard.least[terms])
    kind = np.float64 if largest.sum(dtype=float) < EXACT_FLOAT else np.int64
    weights, query = shard.as_kind(kind), query.astype(kind)
    essential = len(terms) if bar is None else int(np.searchsorted(-beyond[:-1], -bar, "right"))
    live = np.nonzero(shard.ids != query_id)[0]
    score = query[terms[:essential]] @ weights[terms[:essential]] if essential else np.zeros(len(shard.ids), kind)
    score = score[live]
    for at in range(essential, len(terms), PROBES):
        compete = score + beyond[at] >= bar
        live, score = live[compete], score[compete]
        some = terms[at : at + PROBES]
        score = score + query[some] @ weights[np.ix_(some, live)]
    if bar is not None:
        live, score = live[score >= bar], score[score >= bar]
    return shard.ids[live], score.astype(np.int64)


def best(ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest scores, ties to smaller ids."""
    if len(ids) > top:
        reach = score >= np.partition(score, len(score) - top)[len(score) - top]
        ids, score = ids[reach], score[reach]
    order = np.lexsort((ids, -score))[:top]
    return ids[order], score[order]


def _searcher(sent, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                shard = Shard(np.asarray(part.column("vec_id")), _matrix(part.column("weights"), queries.shape[1]))
                for q, (query_id, query) in enumerate(zip(query_ids, queries)):
                    ids, score = found[q]
                    more = search(shard, query_id, query, int(score[-1]) if len(ids) == top else None)
                    found[q] = best(np.concatenate([ids, more[0]]), np.concatenate([score, more[1]]), top)
        n = [len(ids) for ids, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, n)),
                pa.array(np.concatenate([x for x, _ in found])),
                pa.array(np.concatenate([x for _, x in found])),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return run


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The `top` best of `vectors` for each of `queries`; both have vec_id and embedding."""
    spark = ready(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), integer_weights(F.col("embedding")).alias("weights"))
        return rows.where("vec_id is not null and weights is not null")

    asked = usable(queries).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    blocks = -(-asked.count() // block)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = stage(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "top-queries")
    given, path = usable(vectors), shared_path(spark, "top-found")
    for number in range(blocks):
        rows = asked.where(F.col("block") == number).orderBy("vec_id").select("vec_id", "weights").toArrow()
        if not rows.num_rows:
            continue
        ids, weights = np.asarray(rows.column("vec_id")), _matrix(rows.column("weights").combine_chunks(), 0).T
        sent = spark.sparkContext.broadcast((ids, weights))
        given.mapInArrow(_searcher(sent, top), FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = spark.read.schema(FOUND).parquet(path).withColumn("rank", place).where(F.col("rank") <= top)
    return merged.select("query_id", "rank", "vec_id", "score")
