"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A text without white space is cut into blocks of a fixed number of bytes. The distinct blocks of all documents are
sorted into integer names; then the names of adjacent blocks are paired, the distinct pairs are sorted
into names again, and so on until each document has one name. Equal names at equal depth mean equal
texts, and unequal names unequal texts: there is nothing left to chance.

Blocks travel as two 64-bit hashes with different seeds, and the names follow the order of these. Whether
the hashes tell all blocks apart is checked on the blocks themselves, which are moved once for this; if
two blocks ever share both hashes, the next pair of seeds is taken.

Null text counts as empty; a null doc_id is a document of its own and is the last choice to stay; of rows
that agree in everything one stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keep_rows, name_in_order, row_hash, text_or_empty
from tidewatch.session import stage

BLOCK = 1024
SEED_PAIRS = 16


def normalised() -> Column:
    return F.regexp_replace(text_or_empty(), r"[\x20\x09-\x0D]", "")


def blocks_of(raw: Column, block: int) -> Column:
    """Fixed-size blocks of a text's bytes; an empty text has one empty block.

    `raw` must be a binary column of an earlier projection: a slice of bytes is taken by its place, while a
    string would be walked through, and an expression worked out anew, for every block.
    """
    last = F.greatest(F.ceil(F.octet_length(raw) / block), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block + 1, F.lit(block)))


def _hashed(block: Column, seed: int) -> Column:
    return F.struct(
        F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2")
    )


def block_names(docs: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Names of all distinct blocks, and the seed whose hashes tell them apart."""
    pieces = docs.select(normalised().cast("binary").alias("bare")).select(F.explode(blocks_of(F.col("bare"), block)).alias("block"))
    for seed in range(SEED_PAIRS):
        distinct = pieces.withColumn("h", _hashed(F.col("block"), seed)).select("h.h1", "h.h2", "block").distinct()
        hashes = stage(distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("blocks")), "blocks")
        if hashes.where("blocks > 1").isEmpty():
            return name_in_order(hashes, ["h1", "h2"], "name"), seed
    raise ValueError("no pair of seeds tells all blocks apart")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, _row, _h, points, text_sha256, depth, name.

    (depth, name) is the identity of the normalised text.
    """
    names, seed = block_names(docs, block)
    given = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        row_hash().alias("_h"),
        F.char_length(text_or_empty()).alias("points"),
        normalised().cast("binary").alias("bare"),
    )
    rows = stage(
        given.select(
            *given.columns[:-1],
            F.sha2("bare", 256).alias("text_sha256"),
            F.transform(blocks_of(F.col("bare"), block), lambda b: _hashed(b, seed)).alias("blocks"),
        ),
        "documents",
    )
    longest = rows.agg(F.max(F.size("blocks")).alias("n")).first()["n"] or 1
    level = (
        rows.select("_row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "h"))
        .select("_row", "n", "pos", F.col("h.h1"), F.col("h.h2"))
        .join(names, ["h1", "h2"])
        .select("_row", "n", "pos", "name")
    )
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("_row", F.lit(depth).alias("depth"), "name"))
        if longest <= 1:
            break
        # A left name without a right one keeps -1 there, so that it differs from every full pair.
        pairs = stage(
            level.where("n > 1")
            .groupBy("_row", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.ceil(F.first("n") / 2).alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        named = name_in_order(pairs.select("left", "right").distinct(), ["left", "right"], "name")
        level = pairs.join(named, ["left", "right"]).select("_row", "n", "pos", "name")
        longest, depth = -(-longest // 2), depth + 1
    ends = done[0]
    for more in done[1:]:
        ends = ends.union(more)
    return rows.drop("blocks").join(ends, "_row")


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document with its group: doc_id, keep_id, group_size, kept, text_sha256, _h."""
    named = stage(identities(docs, block), "identities")
    first = F.min(
        F.struct(
            (-F.col("points")).alias("order"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("_row")
        )
    )
    # Written, so that the join below reads both sides from a shuffle and adaptive execution can split a group of many copies.
    kept = stage(named.groupBy("depth", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "kept")
    return named.join(kept, ["depth", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first._row")).alias("kept"),
        "text_sha256",
        "_h",
    )


def deduplicate(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return keep_rows(docs, groups(docs, block).where("kept").select("doc_id", "_h"))
