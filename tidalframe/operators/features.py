"""Feature preparation: imputing, scaling, one-hot columns and the fitted preprocessor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.ordering import exact_percentiles

# What a null category is called while columns are encoded; sorts after ordinary names.
NULL_CATEGORY = "￿null"
# A category list ends up in the width of every feature vector, so it has to stay small.
MAX_CATEGORIES = 10_000

Quartiles = Mapping[str, tuple[float, float, float]]


def fit_quartiles(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(q1, median, q3) per column: one small row each."""
    rows = exact_percentiles(df, cols, (0.25, 0.5, 0.75)).collect()
    found = {r["stat"]: (r["p0"], r["p1"], r["p2"]) for r in rows}
    return {c: found.get(c, (None, None, None)) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str], quartiles: Quartiles | None = None) -> DataFrame:
    """Null becomes the column's exact median."""
    q = quartiles or fit_quartiles(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(q[c][1])) for c in cols})


def _scale(c: Column, quartiles: tuple[float, float, float]) -> Column:
    q1, median, q3 = quartiles
    if median is None:
        return c
    return (c - median) / ((q3 - q1) or 1.0)


def robust_scale(df: DataFrame, cols: Sequence[str], quartiles: Quartiles | None = None) -> DataFrame:
    """(x - median) / (q3 - q1); a column whose quartiles are equal is only centred."""
    q = quartiles or fit_quartiles(df, cols)
    return df.withColumns({c: _scale(F.col(c), q[c]) for c in cols})


def fit_categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str | None]]:
    """Alphabetical categories per column, null last when there is one. Collected lists are size-checked."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    distinct = df.select(F.inline(entries)).distinct()
    limit = MAX_CATEGORIES * len(cols)
    rows = distinct.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories in {list(cols)}")
    found: dict[str, list[str | None]] = {c: [] for c in cols}
    for r in rows:
        found[r["column"]].append(r["value"])
    return {c: sorted(v, key=lambda x: (x is None, x or "")) for c, v in found.items()}


def one_hot(
    df: DataFrame, cols: Sequence[str], categories: Mapping[str, Sequence[str | None]] | None = None
) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<category>``; an unseen category is all zeros."""
    lists = categories or fit_categories(df, cols)
    flags = {
        f"{c}_{v}": F.col(c).eqNullSafe(F.lit(v)).cast("double") for c in cols for v in lists[c]
    }
    return df.withColumns(flags).drop(*cols)


def fit_preprocessor(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] | None = (), out: str = "features",
    quartiles: Quartiles | None = None,
) -> PipelineModel:
    """Impute and scale numbers, one-hot encode categories, drop the rest except ``keep`` (None keeps all columns).

    The result is a plain ML pipeline model, so it can be saved, loaded and put before a classifier.
    Fitted numbers are literals of its first stage. ``df`` is the table to fit on: the training part,
    or all rows when training and test parts share one fit.
    """
    q = quartiles or fit_quartiles(df, numeric)
    parts = ["*"] if keep is None else [f"`{c}`" for c in keep]
    for c in numeric:
        q1, median, q3 = q[c]
        if median is None:
            raise ValueError(f"column {c} has no value to fit on")
        parts.append(f"(coalesce(`{c}`, {median!r}D) - {median!r}D) / {((q3 - q1) or 1.0)!r}D AS `num_{c}`")
    parts += [f"coalesce(`{c}`, '{NULL_CATEGORY}') AS `cat_{c}`" for c in categorical]
    first = SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__")
    stages = [first]
    if categorical:
        stages += [
            StringIndexer(
                inputCols=[f"cat_{c}" for c in categorical], outputCols=[f"ix_{c}" for c in categorical],
                stringOrderType="alphabetAsc", handleInvalid="keep",
            ),
            OneHotEncoder(
                inputCols=[f"ix_{c}" for c in categorical], outputCols=[f"oh_{c}" for c in categorical],
                dropLast=True, handleInvalid="error",
            ),
        ]
    assembled = [f"num_{c}" for c in numeric] + [f"oh_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=assembled, outputCol=out))
    made = [*[f"num_{c}" for c in numeric], *[f"{p}_{c}" for c in categorical for p in ("cat", "ix", "oh")]]
    last = f"* EXCEPT ({', '.join(f'`{c}`' for c in made)})" if keep is None else ", ".join([*[f"`{c}`" for c in keep], f"`{out}`"])
    stages.append(SQLTransformer(statement=f"SELECT {last} FROM __THIS__"))
    return Pipeline(stages=stages).fit(df)


def feature_name_list(model: PipelineModel) -> list[str]:
    """Names of the vector's positions: numeric columns, then ``column_category``."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    indexer = next((s for s in model.stages if hasattr(s, "labelsArray")), None)
    names = [c.removeprefix("num_") for c in assembler.getInputCols() if c.startswith("num_")]
    if indexer is not None:
        for c, labels in zip(indexer.getInputCols(), indexer.labelsArray):
            shown = ["None" if v == NULL_CATEGORY else v for v in labels]
            names += [f"{c.removeprefix('cat_')}_{v}" for v in shown]
    return names


def feature_names(model: PipelineModel, like: DataFrame) -> DataFrame:
    """(idx, name) of the preprocessor's output."""
    rows = list(enumerate(feature_name_list(model)))
    return like.sparkSession.createDataFrame(rows, "idx int, name string")
