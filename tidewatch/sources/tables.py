"""Reading and writing the tables of the monitoring loop."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources import schemas


class DataLoadError(Exception):
    """A source is absent or cannot be read."""


class DataValidationError(Exception):
    """A table does not have the columns it must have."""


def missing_columns(present: Iterable[str], required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(present))


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    """Check names against the schema only; no job runs."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise DataValidationError(f"{what} is missing columns: {missing}")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_TABLE) -> DataFrame:
    """Raw training file with a header. Columns are taken by name, whatever their order in the file."""
    if not path_exists(spark, path):
        raise DataLoadError(f"raw data not found: {path}")
    try:
        header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    except AnalysisException as error:
        raise DataLoadError(f"cannot read {path}: {error}") from error
    require_columns(header, schema.fieldNames(), "raw data")
    return header.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
        *[F.col(c) for c in header.columns if c not in schema.fieldNames()],
    )


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None when nothing has been written there yet."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def read_labelled(spark: SparkSession, path: str, target: str) -> DataFrame | None:
    """Labelled evaluation rows, or None when absent; it is an error if the target is missing."""
    df = read_table(spark, path)
    if df is None:
        return None
    return require_columns(df, [target], f"evaluation data {path}").withColumn(target, F.col(target).cast("int"))


def write_table(df: DataFrame | None, path: str, spark: SparkSession | None = None) -> None:
    """Replace a table; None removes the old one, which would be stale for the model being trained."""
    if df is None:
        drop_path(spark, path)
    else:
        df.write.mode("overwrite").parquet(path)


def append_committed(df: DataFrame, path: str, commit: str | None = None) -> bool:
    """Append `df` to a table of commits, all of it or nothing; False if `commit` is already there.

    The files go to a folder of their own below `data`, which nobody reads; then one manifest that names them
    is put under `commits` by a rename that refuses to replace. A job that stops before leaves no row to be
    seen, and a batch that comes again under its old name adds nothing.
    """
    spark = df.sparkSession
    commit = commit or uuid.uuid4().hex
    manifest = f"{path}/commits/{commit}.json"
    if path_exists(spark, manifest):
        return False
    folder = f"{path}/data/{commit}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    names = [s.getPath().getName() for s in _file_system(spark, folder).listStatus(_path(spark, folder))]
    files = [f"{folder.removeprefix(path).lstrip('/')}/{n}" for n in names if not n.startswith(("_", "."))]
    if _publish(spark, json.dumps({"commit": commit, "files": files}), manifest):
        return True
    drop_path(spark, folder)
    return False


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all commits of a table; files that no manifest names are not read."""
    commits = f"{path}/commits"
    if not path_exists(spark, commits):
        return spark.createDataFrame([], schema)
    manifests = spark.read.schema("commit string, files array<string>").json(commits, pathGlobFilter="*.json")
    # A list of files, as every scan of a folder has it on the driver.
    files = [f"{path}/{r['file']}" for r in manifests.select(F.explode("files").alias("file")).collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, content: str, path: str) -> bool:
    """Put a small file in place as a whole, unless one is there."""
    hadoop, draft = spark._jvm.org.apache.hadoop.fs, f"{path}.{uuid.uuid4().hex}.draft"
    out = _file_system(spark, draft).create(_path(spark, draft), False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    # Qualified, so that the path's own file system is taken and not the default one.
    draft_path, final_path = (_file_system(spark, p).makeQualified(_path(spark, p)) for p in (draft, path))
    context = hadoop.FileContext.getFileContext(draft_path.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft_path, final_path, keep)
        return True
    except Py4JJavaError as error:
        drop_path(spark, draft)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False


def append_predictions(records: DataFrame, path: str, commit: str | None = None) -> bool:
    """Append log rows with all required columns, all of them or none; a null in one of these fails the write.

    Under the name of a commit that is there already nothing is added; tells whether rows were.
    """
    required = [f.name for f in schemas.PREDICTION_LOG.fields if not f.nullable]
    require_columns(records, required, "prediction records")
    aligned = align_to_schema(records, schemas.PREDICTION_LOG)[0]
    checked = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} must not be null"))).otherwise(F.col(c)) for c in required}
    return append_committed(aligned.withColumns(checked), path, commit)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction log as committed so far."""
    return read_committed(spark, path, schemas.PREDICTION_LOG)


def append_drift_history(summary: DataFrame, path: str) -> None:
    """One JSON line per analysed window, kept for ever."""
    summary.withColumn("checked_at", F.current_timestamp()).write.mode("append").json(path)


def latest_drift(history: DataFrame, by: Iterable[str] = (), order: str = "checked_at") -> DataFrame:
    """The newest history row (per group), by aggregation rather than a sort."""
    by = list(by)
    newest = history.groupBy(*by).agg(F.max_by(F.struct(*history.columns), F.col(order)).alias("_row"))
    return newest.select("_row.*")


def align_to_schema(df: DataFrame, target: T.StructType) -> tuple[DataFrame, list[str]]:
    """Add the nullable columns of `target` that `df` lacks; return the frame and the names added.

    A missing column that must not be null is left out: rows already written have no value for it.
    Columns `df` has beyond the target are kept.
    """
    present = set(df.columns)
    added = [f for f in target.fields if f.name not in present and f.nullable]
    aligned = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return aligned, [f.name for f in added]


def unpack_features(log: DataFrame, schema: T.StructType, column: str = "features") -> DataFrame:
    """JSON features to columns of a known schema."""
    return log.withColumn("_f", F.from_json(column, schema)).select(
        *[c for c in log.columns if c != column], *[F.col("_f")[f.name].alias(f.name) for f in schema.fields]
    )


def unpack_open_features(log: DataFrame, types: dict[str, str], column: str = "features") -> DataFrame:
    """JSON features of any shape: keys that are absent or of another type become null."""
    parsed = log.withColumn("_v", F.try_parse_json(column))
    return parsed.select(
        *[c for c in log.columns if c != column],
        *[F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in types.items()],
    )


def feature_types(log: DataFrame, column: str = "features") -> dict[str, T.DataType]:
    """All keys of the JSON objects in the log with the type that holds every value, found in one pass.

    Numbers of different kinds become doubles; a key whose values have no type in common, or are always null,
    becomes text (objects and lists as JSON). Rows that hold no JSON object count for nothing.
    """
    parsed = log.select(F.try_parse_json(column).alias("v"))
    objects = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    found = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return {}
    # Names stand in backticks where they could be taken for something else.
    ddl = re.sub(r"`(?:[^`]|``)*`|\bOBJECT(?=<)", lambda m: "STRUCT" if m[0] == "OBJECT" else m[0], found)
    return {f.name: _plain_type(f.dataType) for f in T.DataType.fromDDL(ddl).fields}


def _plain_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType) and kind.fields:
        return T.StructType([T.StructField(f.name, _plain_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain_type(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType, T.StructType)) else kind


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def unpack_all_features(log: DataFrame, column: str = "features") -> DataFrame:
    """JSON features of any shape to one typed column per key found in the log, by name.

    A key that another column's name stands for already, in any case of letters, gets a number behind it.
    """
    kept = [c for c in log.columns if c != column]
    taken, out = {c.lower() for c in kept}, []
    for key, kind in sorted(feature_types(log, column).items()):
        if "'" in key and '"' in key:
            raise DataValidationError(f"feature name with both kinds of quotes: {key}")
        name, turn = key, 1
        while name.lower() in taken:
            turn += 1
            name = f"{key}_{turn}"
        taken.add(name.lower())
        path = f'$["{key}"]' if "'" in key else f"$['{key}']"
        out.append(F.try_variant_get("_v", path, _ddl(kind)).alias(name))
    return log.withColumn("_v", F.try_parse_json(column)).select(*[f"`{c}`" for c in kept], *out)


def feature_keys(log: DataFrame, column: str = "features") -> DataFrame:
    """The union of the JSON keys found in the log."""
    keys = log.select(F.explode(F.json_object_keys(column)).alias("feature"))
    return keys.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))


def pack_features(df: DataFrame, features: list[str], column: str = "features") -> DataFrame:
    """Feature columns to one JSON column."""
    return df.withColumn(column, F.to_json(F.struct(*features)))


def labelled_rows(log: DataFrame) -> DataFrame:
    return log.where(F.col("actual_label").isNotNull())


def pending_rows(log: DataFrame, limit: int) -> DataFrame:
    """The oldest rows not yet analysed, at most `limit` (a top-k, not a full sort)."""
    return log.where(~F.col("drift_analyzed")).orderBy("created_at", "id").limit(limit)


def recent_rows(log: DataFrame, limit: int = 5) -> DataFrame:
    """The newest log rows, shortened for display."""
    return (
        log.orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
        .select(
            F.concat(F.substring("request_id", 1, 8), F.lit("…")).alias("request_id"),
            "prediction",
            F.round("probability", 3).alias("probability"),
            "model_version",
            F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("created_at"),
        )
    )
