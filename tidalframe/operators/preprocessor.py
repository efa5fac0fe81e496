"""A preprocessor that is fitted once and stored: numbers, time features and categories of any number.

Estimator and model are ordinary pipeline stages. The model keeps its numbers as parameters and its categories as a table,
so a table that arrives later is prepared by what was stored, never by its own mean, quartiles or values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidalframe.functions.timefeatures import month_cos, month_sin
from tidalframe.operators.dictionary import add_category_index, category_widths, number_categories
from tidalframe.operators.ordering import percentile_sketch, percentiles_between

TIME_FEATURES = ("month_sin", "month_cos", "year_norm")
_QUARTERS = (0.25, 0.5, 0.75)


def _free(name: str, columns: Sequence[str]) -> str:
    """A column name like this that the table does not have."""
    while name in columns:
        name = f"_{name}"
    return name


def _vectors(numbers: int, size: int) -> Callable[..., pa.Array]:
    """A function that makes a column of sparse vectors, as they are stored, from that many columns of numbers and the indices of categories."""

    def build(*columns: pa.Array) -> pa.Array:
        rows = len(columns[0])
        index, value = np.empty((rows, len(columns)), np.int64), np.ones((rows, len(columns)))
        filled = np.ones((rows, len(columns)), bool)
        for i, c in enumerate(columns):
            if i < numbers:
                index[:, i], value[:, i] = i, c.to_numpy(zero_copy_only=False)
            else:
                index[:, i], filled[:, i] = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)
        ends = np.zeros(rows + 1, np.int32)
        np.cumsum(filled.sum(axis=1), out=ends[1:])
        places, values = pa.array(index[filled]).cast(pa.int32()), pa.array(value[filled])
        parts = [np.zeros(rows, np.int8), np.full(rows, size, np.int32)]
        return pa.StructArray.from_arrays([*map(pa.array, parts), pa.ListArray.from_arrays(ends, places), pa.ListArray.from_arrays(ends, values)], names=["type", "size", "indices", "values"])

    return build


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "numbers to impute and scale", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "columns to encode", TypeConverters.toListString)
    yearCol = Param(Params._dummy(), "yearCol", "year of a row; empty for none", TypeConverters.toString)
    monthCol = Param(Params._dummy(), "monthCol", "month of a row; empty for none", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "feature vector", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(numeric=[], categorical=[], yearCol="", monthCol="", outputCol="features")


class ObservationPreprocessor(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Medians and quartiles of numbers, mean and deviation of the year, and numbered categories of a table."""

    @keyword_only
    def __init__(self, *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), yearCol: str = "", monthCol: str = "", outputCol: str = "features"):
        super().__init__()
        self._set(**{k: list(v) if k in ("numeric", "categorical") else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> ObservationPreprocessorModel:
        numeric, categorical, year = self.getOrDefault("numeric"), self.getOrDefault("categorical"), self.getOrDefault("yearCol")
        moments = [F.avg(year).alias("mean"), F.stddev_samp(year).alias("std")] if year else []
        # one pass for the year and the sketches of all numbers, one to refine them
        row = df.agg(F.count(F.lit(1)), *moments, *[percentile_sketch(c, _QUARTERS).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        sketches = {c: row[f"s{i}"] for i, c in enumerate(numeric)}
        empty = [c for c, s in sketches.items() if not s["n"]]
        if empty:
            raise ValueError(f"columns without a value to fit on: {empty}")
        quartiles = {r["stat"]: (r["p0"], r["p1"], r["p2"]) for r in percentiles_between(df, sketches, _QUARTERS).collect()} if numeric else {}
        spans = [quartiles[c][2] - quartiles[c][0] for c in numeric]
        dictionary = number_categories(df, categorical) if categorical else None
        model = ObservationPreprocessorModel(dictionary)
        self._copyValues(model)
        return model._set(
            medians=[quartiles[c][1] for c in numeric], spans=[s if s > 0 and s != float("inf") else 1.0 for s in spans],
            yearMean=row["mean"] if year and row["mean"] is not None else 0.0, yearStd=row["std"] if year and row["std"] else 0.0,
            widths=category_widths(dictionary, categorical) if categorical else [],
        )


class ObservationPreprocessorModel(Model, _Columns, MLReadable, MLWritable):
    """Adds the feature vector: scaled numbers, time features, and a one at the index of each category.

    A missing number is the stored median. A year is scaled by the stored mean and deviation (0 where that is 0), and a
    missing year or month is 0 in its features. Null is a category if the fitted table had it; a category that was not
    there adds nothing. All other columns stay.
    """

    medians = Param(Params._dummy(), "medians", "median of each number", TypeConverters.toListFloat)
    spans = Param(Params._dummy(), "spans", "distance of the quartiles of each number, 1 where it is 0", TypeConverters.toListFloat)
    yearMean = Param(Params._dummy(), "yearMean", "mean of the year", TypeConverters.toFloat)
    yearStd = Param(Params._dummy(), "yearStd", "sample deviation of the year, 0 where there is none", TypeConverters.toFloat)
    widths = Param(Params._dummy(), "widths", "number of categories of each column", TypeConverters.toListInt)

    def __init__(self, dictionary: DataFrame | None = None):
        super().__init__()
        self.dictionary = dictionary

    def _numbers(self) -> list[tuple[str, Column]]:
        out = []
        for c, median, span in zip(self.getOrDefault("numeric"), self.getOrDefault("medians"), self.getOrDefault("spans")):
            out.append((c, (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(median)) - median) / span))
        year, month = self.getOrDefault("yearCol"), self.getOrDefault("monthCol")
        if month:
            out += [("month_sin", F.coalesce(month_sin(F.col(month)), F.lit(0.0))), ("month_cos", F.coalesce(month_cos(F.col(month)), F.lit(0.0)))]
        if year:
            mean, std = self.getOrDefault("yearMean"), self.getOrDefault("yearStd")
            out.append(("year_norm", F.coalesce((F.col(year) - mean) / std, F.lit(0.0)) if std else F.lit(0.0)))
        return out

    def size(self) -> int:
        return len(self._numbers()) + sum(self.getOrDefault("widths"))

    def _placed(self, df: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
        """``df`` with the index of each category, the values of the numbers, and the position of each category or null."""
        numbers, places, columns = [v.cast("double") for _, v in self._numbers()], [], list(df.columns)
        begin = len(numbers)
        for i, (c, width) in enumerate(zip(self.getOrDefault("categorical"), self.getOrDefault("widths"))):
            name = _free(f"_ix{i}", columns)
            df = add_category_index(df, self.dictionary, c, name, width)
            places.append(F.col(name) + begin)
            begin += width
        return df, numbers, places

    def entries(self, df: DataFrame, out: str = "entries") -> DataFrame:
        """``df`` with the filled positions of the feature vector: array of (index, value), ascending."""
        columns = list(df.columns)
        df, numbers, places = self._placed(df)
        parts = [F.struct(F.lit(i).cast("bigint").alias("index"), v.alias("value")) for i, v in enumerate(numbers)]
        parts += [F.when(p.isNotNull(), F.struct(p.alias("index"), F.lit(1.0).alias("value"))) for p in places]
        return df.select(*columns, F.filter(F.array(*parts), lambda x: x.isNotNull()).alias(out))

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = list(df.columns)
        df, numbers, places = self._placed(df)
        # there is no built-in function that makes a sparse vector: its parts are put together a batch of rows at a time
        vector = F.arrow_udf(_vectors(len(numbers), self.size()), VectorUDT())(*numbers, *places)
        return df.select(*columns, vector.alias(self.getOrDefault("outputCol")))

    def feature_names(self, spark: SparkSession) -> DataFrame:
        """(idx, name) of every position; names need not differ, positions do."""
        named = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(self._numbers())], "idx bigint, name string")
        begin = named.count()
        for c, width in zip(self.getOrDefault("categorical"), self.getOrDefault("widths")):
            shown = F.concat(F.lit(f"{c}_"), F.when(F.col("key") == "~", "None").otherwise(F.substr("key", F.lit(2))))
            named = named.unionByName(self.dictionary.where(F.col("column") == c).select((F.col("index") + begin).alias("idx"), shown.alias("name")))
            begin += width
        return named

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: ObservationPreprocessorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        if self.instance.dictionary is not None:
            self.instance.dictionary.write.partitionBy("column").parquet(f"{path}/dictionary")


class _ModelReader(MLReader):
    def load(self, path: str) -> ObservationPreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        dictionary = None
        if metadata["paramMap"].get("categorical"):
            dictionary = self.sparkSession.read.schema("key STRING, index BIGINT, column STRING").parquet(f"{path}/dictionary")
        model = ObservationPreprocessorModel(dictionary)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
