"""What the operators of this package share: reading, row keys, durable names in sort order, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import prepare, shared_dir, stage

# Python workers get at most this many bytes of a column batch, so that long texts don't pile up.
BATCH_BYTES = "16m"
# monotonically_increasing_id() counts within a partition in its lower bits.
ROW_BITS = 33


def ready(spark: SparkSession) -> SparkSession:
    """The session with runtime settings; works without a shared folder only on a local master."""
    shared_dir(prepare(spark))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_hash(name: str = "text") -> Column:
    """Tells rows of one (possibly repeated or null) doc_id apart by their text."""
    return F.xxhash64(text_or_empty(name), F.col(name.replace("text", "doc_id")).isNull())


def name_in_order(distinct: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense integer names 0, 1, 2, ... by sort order, without ordering all rows in one task.

    The sorted rows are written once with their partition and place in it; the rows before each
    partition (one count per partition) are then added.
    """
    ident = F.monotonically_increasing_id()
    placed = stage(
        distinct.select(*order)
        .orderBy(*order)
        .select(
            *order,
            F.shiftright(ident, ROW_BITS).alias("_part"),
            ident.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_place"),
        ),
        f"names-{name}",
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort: a few thousand rows at most, whatever the number of names.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*order, (F.col("_before") + F.col("_place")).alias(name))


def discard(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def packed(docs: DataFrame) -> DataFrame:
    """Every row as one column `doc`, so that its columns can't clash with those of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def _rest_hash(docs: DataFrame) -> Column:
    """Tells rows of equal doc_id and text apart by their other columns, as far as Spark can hash these."""
    rest = [f.name for f in docs.schema if f.name not in ("doc_id", "text")]
    hashable = [c for c in rest if not any(t in docs.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(F.lit(0), *[F.col(f"doc.`{c}`") for c in hashable])


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of `docs` whose (doc_id, row hash) is in `kept`, once each, with their own columns.

    `kept` has the columns doc_id and _h, without repeats. Columns of `docs` may have any names. Of rows that
    agree in doc_id and text the one with the least hash of its other columns stays, in every run.
    """
    keys = kept.select(F.col("doc_id").alias("keep_id"), F.col("_h").alias("keep_h"))
    rows = packed(docs).select("doc", F.col("doc.doc_id"), row_hash("doc.text").alias("h"), _rest_hash(docs).alias("rest"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    once = rows.join(keys, same, "left_semi").groupBy("doc_id", "h").agg(F.min_by("doc", "rest").alias("doc"))
    return once.select("doc.*")
