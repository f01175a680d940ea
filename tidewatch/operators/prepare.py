"""Feature preparation: fitted on one table, applied to any other.

`Preparation` holds short category lists and is a projection. `SparsePreparation` holds its categories as a
written table of any size, looks values up by join and gives sparse vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoderModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import order
from tidewatch.session import stage

# Fixed value: the text that stands for an absent category.
MISSING = "missing"


@dataclass(frozen=True)
class NumberParams:
    median: float
    mean: float
    scale: float


def _number(name: str) -> Column:
    raw = F.col(name).cast("double")
    return F.when(~F.isnan(raw), raw)


@dataclass(frozen=True)
class Preparation:
    """Fitted parameters: exact medians, population moments after imputation, sorted categories."""

    numbers: dict[str, NumberParams]
    categories: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        """Numbers first, then one column per category except the first of each feature."""
        encoded = [f"{name}_{value}" for name, values in self.categories.items() for value in values[1:]]
        return [*self.numbers, *encoded]

    def columns(self) -> list[Column]:
        out = [
            ((F.coalesce(_number(name), F.lit(p.median)) - p.mean) / p.scale).alias(name)
            for name, p in self.numbers.items()
        ]
        for name, values in self.categories.items():
            filled = _filled(name)
            out += [
                F.when(filled == value, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{name}_{value}")
                for value in values[1:]
            ]
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep` columns followed by the prepared features; everything else is dropped."""
        return df.select(*keep, *self.columns())

    def coded(self, df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], dict[str, int]]:
        """`keep` columns with prepared numbers and category indices (null for unknown ones); their names, and the sizes."""
        codes = {f"code_{i}": len(values) for i, values in enumerate(self.categories.values())}
        numbers = [f"number_{i}" for i in range(len(self.numbers))]
        cells = [c.alias(n) for c, n in zip(self.columns(), numbers)]
        for (name, values), code in zip(self.categories.items(), codes):
            known = F.array(*[F.lit(v) for v in values]).cast("array<string>")
            cells.append((F.nullif(F.array_position(known, _filled(name)), F.lit(0)) - 1).alias(code))
        return df.select(*keep, *cells), numbers, codes

    def sql(self) -> str:
        """The same projection as a statement, so that it can be saved inside an ML pipeline."""

        def quote(name: str) -> str:
            return "`" + name.replace("`", "``") + "`"

        def text(value: str) -> str:
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

        parts = []
        for name, p in self.numbers.items():
            raw = f"cast({quote(name)} as double)"
            value = f"coalesce(if(isnan({raw}), null, {raw}), {p.median!r}D)"
            parts.append(f"({value} - {p.mean!r}D) / {p.scale!r}D")
        for name, values in self.categories.items():
            filled = f"coalesce(cast({quote(name)} as string), {text(MISSING)})"
            parts += [f"if({filled} = {text(v)}, 1.0D, 0.0D)" for v in values[1:]]
        listed = ", ".join(f"{part} AS prepared_{i}" for i, part in enumerate(parts))
        return f"SELECT *, {listed} FROM __THIS__"

    def table(self, spark: SparkSession) -> DataFrame:
        """The parameters as a table, one row per feature."""
        rows = [(n, "num", p.median, p.mean, p.scale, None) for n, p in self.numbers.items()]
        rows += [(n, "cat", None, None, None, values) for n, values in self.categories.items()]
        return spark.createDataFrame(
            rows, "feature string, kind string, median double, mean double, scale double, categories array<string>"
        )

    @classmethod
    def from_table(cls, params: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> Preparation:
        rows = {r["feature"]: r for r in params.collect()}
        return cls(
            {n: NumberParams(rows[n]["median"], rows[n]["mean"], rows[n]["scale"]) for n in numbers},
            {n: list(rows[n]["categories"]) for n in categories},
        )


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


@dataclass(frozen=True)
class SparsePreparation:
    """Numbers as in `Preparation`; categories as a table (feature, value, index), of which only the sizes are known here."""

    numbers: dict[str, NumberParams]
    lookup: DataFrame
    sizes: dict[str, int]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(max(0, n - 1) for n in self.sizes.values())

    def names(self) -> DataFrame:
        """(position, name) of every feature of the vector."""
        spark = self.lookup.sparkSession
        out = spark.createDataFrame(list(enumerate(self.numbers)), "position long, name string")
        for name, offset in self._offsets().items():
            of = self.lookup.where((F.col("feature") == name) & (F.col("index") > 0))
            out = out.unionByName(of.select((F.col("index") + offset).alias("position"), F.concat(F.lit(f"{name}_"), "value").alias("name")))
        return out

    def _offsets(self) -> dict[str, int]:
        """What turns an index above 0 into a place in the vector."""
        out, at = {}, len(self.numbers)
        for name, n in self.sizes.items():
            out[name] = at - 1
            at += max(0, n - 1)
        return out

    def indexed(self, df: DataFrame, name: str, to: str) -> DataFrame:
        """Add the 0-based index of a feature's category, null where the category is unknown."""
        value, key = f"_value_{to}", f"_key_{to}"
        of = self.lookup.where(F.col("feature") == name).select(F.col("value").alias(value), F.col("index").alias(to))
        if self.sizes[name] <= order.BROADCAST_ROWS:
            of = F.broadcast(of)
        keyed = df.withColumn(key, _filled(name))
        return keyed.join(of, F.col(key) == F.col(value), "left").drop(value, key)

    def prepared_numbers(self) -> list[Column]:
        return Preparation(self.numbers, {}).columns()

    def coded(self, df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str], dict[str, int]]:
        """`keep` columns with prepared numbers and category indices (null for unknown ones); their names, and the sizes."""
        codes = {f"code_{i}": n for i, n in enumerate(self.sizes.values())}
        for name, code in zip(self.sizes, codes):
            df = self.indexed(df, name, code)
        numbers = [f"number_{i}" for i in range(len(self.numbers))]
        cells = [c.alias(n) for c, n in zip(self.prepared_numbers(), numbers)]
        return df.select(*keep, *cells, *codes), numbers, codes

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        """All columns of `df` and the features as one vector; the first category of a feature and unknown ones are zeros.

        The encoder leaves out the last category, so indices are turned by one: the first category and unknown
        ones come last.
        """
        columns, spread = df.columns, [name for name, n in self.sizes.items() if n > 1]
        turned = [f"_turned_{i}" for i in range(len(spread))]
        for name, to in zip(spread, turned):
            n = self.sizes[name]
            df = self.indexed(df, name, to).withColumn(to, F.pmod(F.coalesce(to, F.lit(0)) - 1, F.lit(n)).cast("double"))
        numbers = [f"_number_{i}" for i in range(len(self.numbers))]
        # A number that training never saw has no median, and so may still be absent here.
        df = df.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in zip(numbers, self.prepared_numbers())})
        parts = list(numbers)
        if spread:
            parts += [f"{to}_vector" for to in turned]
            df = _first_left_out([self.sizes[n] for n in spread], turned, parts[len(numbers) :]).transform(df)
        if not parts:
            return df.select(*columns, array_to_vector(F.array().cast("array<double>")).alias(output))
        return VectorAssembler(inputCols=parts, outputCol=output).transform(df).select(*columns, output)


def _first_left_out(sizes: list[int], inputs: list[str], outputs: list[str]) -> OneHotEncoderModel:
    """One-hot encoder for indices whose sizes are known, without a fit."""
    gateway = SparkSession.active().sparkContext._gateway
    held = gateway.new_array(gateway.jvm.int, len(sizes))
    for i, n in enumerate(sizes):
        held[i] = n
    uid = f"OneHotEncoderModel_{uuid.uuid4().hex[:12]}"
    model = OneHotEncoderModel(JavaParams._new_java_obj("org.apache.spark.ml.feature.OneHotEncoderModel", uid, held))
    model._resetUid(uid)
    return model.setInputCols(inputs).setOutputCols(outputs).setDropLast(True)


def fit_sparse(
    train: DataFrame, numbers: Sequence[str], categories: Sequence[str], rows_per_task: int | None = None
) -> SparsePreparation:
    """Fit on `train`; the categories stay in a table, numbered in their order without one task per feature."""
    known = Preparation.from_table(fit_table(train, numbers, [], rows_per_task), numbers, [])
    lookup = fit_lookup(train, categories, rows_per_task)
    counted = {r["feature"]: r["count"] for r in lookup.groupBy("feature").count().collect()}
    return SparsePreparation(known.numbers, lookup, {c: counted.get(c, 0) for c in categories})


def fit_lookup(train: DataFrame, categories: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """(feature, value, index): each distinct category with its place in the sorted order from 0, written once."""
    shape = "feature string, value string, index long"
    if not categories:
        return train.sparkSession.createDataFrame([], shape)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), _filled(c).alias("value")) for c in categories]))
    distinct = stage(train.select(cells).distinct(), "categories")
    ranked = order.rank_rows(distinct, ["feature"], ["value"], "_rank", rows_per_task)
    return stage(ranked.select("feature", "value", (F.col("_rank") - 1).cast("long").alias("index")), "category-index")


def fit(
    train: DataFrame, numbers: Sequence[str], categories: Sequence[str], rows_per_task: int | None = None
) -> Preparation:
    """Fit on `train`. All features go through one grouped count; medians are exact."""
    params = fit_table(train, numbers, categories, rows_per_task)
    return Preparation.from_table(params, numbers, categories)


def fit_table(
    train: DataFrame, numbers: Sequence[str], categories: Sequence[str], rows_per_task: int | None = None
) -> DataFrame:
    """The parameter table of `fit`, one row per feature."""
    spark = train.sparkSession
    shape = "feature string, kind string, median double, mean double, scale double, categories array<string>"
    out = spark.createDataFrame([], shape)
    if numbers:
        cells = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), _number(n).alias("v")) for n in numbers]))
        counts = stage(train.select(cells).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), "numbers")
        medians = order.quantiles(
            counts.where("v is not null"), ["feature"], "v", "n", {"median": 0.5}, rows_per_task
        )
        # Deviations from the median are small, so the moments do not cancel; imputed rows deviate by 0.
        off = F.coalesce(F.col("v") - F.col("median"), F.lit(0.0))
        moments = counts.join(stage(medians, "medians"), "feature").groupBy("feature").agg(
            F.first("median").alias("median"),
            (F.sum(F.col("n") * off) / F.sum("n")).alias("shift"),
            (F.sum(F.col("n") * off * off) / F.sum("n")).alias("square"),
        )
        spread = F.sqrt(F.greatest(F.col("square") - F.col("shift") * F.col("shift"), F.lit(0.0)))
        out = out.unionByName(
            moments.select(
                "feature",
                F.lit("num").alias("kind"),
                "median",
                (F.col("median") + F.col("shift")).alias("mean"),
                F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("scale"),
                F.lit(None).cast("array<string>").alias("categories"),
            )
        )
    if categories:
        cells = F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("v")
                    )
                    for c in categories
                ]
            )
        )
        distinct = stage(train.select(cells).distinct(), "categories")
        lists = distinct.groupBy("feature").agg(F.sort_array(F.collect_list("v")).alias("categories"))
        empty = F.lit(None).cast("double")
        out = out.unionByName(
            lists.select(
                "feature",
                F.lit("cat").alias("kind"),
                empty.alias("median"),
                empty.alias("mean"),
                empty.alias("scale"),
                "categories",
            )
        )
    return out
