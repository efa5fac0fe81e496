"""Logistic regressions of many settings and folds at once: every step is one pass over the rows for all of them.

A pass multiplies blocks of rows with the coefficients of all models and adds up, per model, the gradient and the matrix of
second derivatives; the sums are shuffled by model and position. Models at the same coefficients share their sums. Coordinate descent on that quadratic, which is as small as
the features are many, gives the next coefficients. Models that get worse by a step go back half of it, and models that stand still leave the passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalframe.operators.splitting import stratified_folds
from tidalframe.session import scratch_path

# The sums of a model have the square of this many numbers at most; they are what a pass sends to the driver.
MOST_FEATURES = 2_000
_ROWS = 4096
_PAIRED = 100
# Rows come as blocks of this size in row groups of some MB, as Spark's reader holds a whole row group of large values.
_BLOCK_BYTES, _GROUP_BYTES = 1 << 16, 8 << 20
# A step this small, by the largest coefficient, is near enough for others to start there.
_NEAR = 1e-3


def _blocks(batches: Iterator[pa.RecordBatch], columns: Sequence[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x with a column of ones first, label, fold) of some rows, from single rows or from ``folded_rows``; ``columns`` of x if given."""
    for batch in batches:
        for x, label, fold in _packed_rows(batch) if pa.types.is_binary(batch.schema.field("x").type) else _single_rows(batch):
            values = x if columns is None else x[:, columns]
            yield np.column_stack([np.ones(len(values)), values]), label, fold


def _single_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, _ROWS):
        part = batch.slice(at, _ROWS)
        x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield x, *[part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold")]


def _packed_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    waiting: dict[int, tuple[list[bytes], list[bytes], list[int]]] = {}

    def joined(f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xs, labels, _ = waiting.pop(f)
        y = np.frombuffer(b"".join(labels), np.float64)
        return np.frombuffer(b"".join(xs), np.float64).reshape(len(y), -1), y, np.full(len(y), f)

    for x, label, f in zip(batch.column("x"), batch.column("label"), batch.column("fold").to_pylist()):
        xs, labels, sizes = waiting.setdefault(f, ([], [], []))
        xs.append(x.as_py()), labels.append(label.as_py()), sizes.append(len(labels[-1]) // 8)
        if sum(sizes) >= _ROWS:
            yield joined(f)
    for f in list(waiting):
        yield joined(f)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, label, fold in _single_rows(batch):
            most = max(1, _BLOCK_BYTES // (8 * max(1, x.shape[1])))
            for f in np.unique(fold):
                own = np.flatnonzero(fold == f)
                for at in (own[i : i + most] for i in range(0, len(own), most)):
                    row = [x[at].tobytes()], [label[at].tobytes()], [int(f)], [x.shape[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["x", "label", "fold", "width"])


def _sums(rows: DataFrame, b: np.ndarray, out: np.ndarray, columns: Sequence[int] | None = None) -> np.ndarray:
    """Per model (column of ``b``): rows, loss, gradient and second derivatives, over the rows outside its fold ``out``.

    None of these knows the penalty: models at the same coefficients that leave out the same fold share them.
    """
    at = np.unique(np.column_stack([out, b.T]), axis=0, return_inverse=True)
    alike = at[0][:, 1:].T.copy(), at[0][:, 0].astype(int)
    return _sums_apart(rows, *alike, columns)[at[1].ravel()]


def _sums_apart(rows: DataFrame, b: np.ndarray, out: np.ndarray, columns: Sequence[int] | None) -> np.ndarray:
    d, m = b.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, upper = np.zeros((m, 2 + d + d * d)), np.triu_indices(d)
        paired = d <= _PAIRED and m > 8
        half = np.zeros((m, len(upper[0]) if paired else 0))
        for rows_x, rows_y, fold in _blocks(batches, columns):
            for f in np.unique(fold):
                alone = fold == f
                x, y = (rows_x, rows_y) if alone.all() else (rows_x[alone], rows_y[alone])
                used = np.flatnonzero(out != f)
                if not len(used):
                    continue
                z = x @ b[:, used]
                small = np.exp(-np.abs(z))
                more = 1 + small
                p = np.where(z < 0, small, 1.0) / more
                # more is 2 at most, so a product of 512 is far from any limit and takes one logarithm
                logs = np.log(np.multiply.reduceat(more, np.arange(0, len(x), 512), axis=0)).sum(axis=0)
                total[used, 0] += len(x)
                total[used, 1] += np.maximum(z, 0).sum(axis=0) + logs - y @ z
                total[used, 2 : 2 + d] += (x.T @ (p - y[:, None])).T
                weight = p * (1 - p)
                if paired:  # all products of two features once, for all models
                    half[used] += ((x[:, upper[0]] * x[:, upper[1]]).T @ weight).T
                else:
                    for k, j in enumerate(used):
                        total[j, 2 + d :] += (x.T @ (x * weight[:, k : k + 1])).ravel()
        if paired:
            whole = np.zeros((m, d, d))
            whole[:, upper[0], upper[1]] = whole[:, upper[1], upper[0]] = half
            total[:, 2 + d :] = whole.reshape(m, d * d)
        model, at = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (model, at, total)], names=["model", "at", "v"])

    found = rows.mapInArrow(part, "model int, at int, v double").groupBy("model", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((m, 2 + d + d * d))
    for r in found:
        total[r["model"], r["at"]] = r["v"]
    return total


def _within_signs(x: np.ndarray, g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Towards the least point over the positions that are not 0, as far as no sign changes."""
    free = np.flatnonzero((x != 0) | (np.arange(len(x)) == 0))
    slope = (g + h @ (x - b) + np.where(np.arange(len(x)) > 0, l2 * x + l1 * np.sign(x), 0.0))[free]
    step = -np.linalg.lstsq(h[np.ix_(free, free)] + np.diag(np.where(free > 0, l2, 0.0)), slope, rcond=None)[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = np.where((free > 0) & (x[free] * step < 0), -x[free] / step, np.inf)
    far = min(1.0, crossing.min())
    out = x.copy()
    out[free] = np.where(crossing <= far, 0.0, x[free] + far * step)
    return out


def _descend(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: float, l2: float, steps: int = 300) -> np.ndarray:
    """Least point of g (x - b) + (x - b) h (x - b) / 2 + l1 |x| + l2 x x / 2; the first position, the intercept, has no penalty."""
    if not l1:  # smooth: one solution of linear equations; the least norm where features say the same
        penalty = np.diag([0.0, *[l2] * (len(b) - 1)])
        return b - np.linalg.lstsq(h + penalty, g + penalty @ b, rcond=None)[0]
    x, slope = b.copy(), g.copy()
    for turn in range(steps):
        if turn % 4 == 3:  # features that nearly say the same would take very many turns: solve for all at once
            x = _within_signs(x, g, h, b, l1, l2)
            slope = g + h @ (x - b)
        most = 0.0
        for k in range(len(x)):
            curve = h[k, k] + (l2 if k else 0.0)
            if curve <= 1e-14:
                continue
            target = h[k, k] * x[k] - slope[k]
            new = (np.sign(target) * max(abs(target) - l1, 0.0) if k else target) / curve
            if new != x[k]:
                slope += h[:, k] * (new - x[k])
                most, x[k] = max(most, abs(new - x[k])), new
        if most < 1e-10:
            break
    return x


def fit_settings(
    rows: DataFrame, settings: Sequence[tuple[float, float]], out: Sequence[int], steps: int = 100, tolerance: float = 1e-7,
    columns: Sequence[int] | None = None,
) -> np.ndarray:
    """Coefficients (models x features + 1, intercept first) of every (c, l1_ratio) on the rows (x, label, fold) outside its fold.

    ``c`` is the inverse strength of the penalty of a summed loss. The rows are single ones or those of ``folded_rows``; with
    ``columns`` the models are on these features only. Of the models that leave out the same fold the one with the strongest
    penalty goes first, and the others start where it nearly stands still: most passes are for a few models.
    """
    size = F.col("width") if "width" in rows.columns else F.size("x")
    width = len(columns) if columns is not None else rows.select(size.alias("n")).first()["n"]
    if width > MOST_FEATURES:
        raise ValueError(f"{width} features; second derivatives are kept for {MOST_FEATURES} at most")
    d, m, held = width + 1, len(settings), np.array(out)
    c, ratio = np.array(settings, float).T
    b, last, best = np.zeros((d, m)), np.zeros((d, m)), np.full(m, np.inf)
    lead = np.array([min(np.flatnonzero(held == f), key=lambda j: (c[j], ratio[j])) for f in held])

    def towards(open_: np.ndarray, near: float, left: int) -> int:
        while len(open_) and left:
            total = _sums(rows, b[:, open_], held[open_]) if columns is None else _sums(rows, b[:, open_], held[open_], columns)
            still = []
            for at, j in enumerate(open_):
                n, x = total[at, 0], b[:, j].copy()
                l1, l2 = ratio[j] / (c[j] * n), (1 - ratio[j]) / (c[j] * n)
                value = total[at, 1] / n + l1 * np.abs(x[1:]).sum() + l2 * (x[1:] ** 2).sum() / 2
                if value > best[j] + 1e-10:
                    b[:, j] = (x + last[:, j]) / 2
                else:
                    best[j], last[:, j] = value, x
                    b[:, j] = _descend(total[at, 2 : 2 + d] / n, total[at, 2 + d :].reshape(d, d) / n, x, l1, l2)
                if np.abs(b[:, j] - x).max() > near * max(1.0, np.abs(x).max()):
                    still.append(j)
            open_, left = np.array(still, int), left - 1
        return left

    leads = np.unique(lead)
    left = towards(leads, _NEAR, steps) if len(leads) < m else steps
    others = np.setdiff1d(np.arange(m), leads)
    b[:, others] = b[:, lead[others]]
    towards(np.arange(m), tolerance, max(left, steps // 2))
    return b.T


def held_out_f1(rows: DataFrame, coefficients: np.ndarray, out: Sequence[int], columns: Sequence[int] | None = None) -> list[float]:
    """F1 of class 1 of every model on its own fold, in one pass."""
    b, held = coefficients.T, np.array(out)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held), 3), np.int64)
        for x, y, fold in _blocks(batches, columns):
            for f in np.unique(fold):
                own, alone = np.flatnonzero(held == f), fold == f
                hit, true = x[alone] @ b[:, own] > 0, y[alone][:, None] == 1
                for k, found in enumerate((hit & true, hit & ~true, ~hit & true)):
                    total[own, k] += found.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), *map(pa.array, total.T.copy())], names=["model", "tp", "fp", "fn"])

    counts = rows.mapInArrow(part, "model int, tp bigint, fp bigint, fn bigint").groupBy("model").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    found = {r["model"]: 2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1) for r in counts.collect()}
    return [found[j] for j in range(len(held))]


def folded_rows(train: DataFrame, key: str, folds: int = 3, label: str = "label", features: str = "features") -> DataFrame:
    """(x, label, fold, width) in the shared folder, with stratified folds: what every pass reads. Some rows of a fold are one block of doubles."""
    folded = stratified_folds(train, key, label, folds, "fold")
    path = scratch_path(train.sparkSession, "folded")
    single = folded.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
    single.mapInArrow(_pack, "x binary, label binary, fold int, width int").write.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    return train.sparkSession.read.parquet(path)


def search_and_fit(
    rows: DataFrame, settings: Sequence[Mapping[str, float]], folds: int = 3, columns: Sequence[int] | None = None, whole: bool = True
) -> tuple[list[float], np.ndarray]:
    """Mean F1 of every setting (c, and l1_ratio, 0 if there is none) over the folds of ``folded_rows``, and its coefficients on all rows."""
    each = [(float(s["c"]), float(s.get("l1_ratio", 0.0))) for s in settings for _ in range(folds)]
    out, n = [f for _ in settings for f in range(folds)], len(settings)
    found = fit_settings(rows, each + each[::folds] * whole, out + [-1] * n * whole, columns=columns)
    scores = held_out_f1(rows, found[: n * folds], out, columns)
    return [sum(scores[i * folds : (i + 1) * folds]) / folds for i in range(n)], found[n * folds :]


def search_settings(train: DataFrame, settings: Sequence[Mapping[str, float]], key: str, folds: int = 3, label: str = "label") -> list[float]:
    """Mean F1 of every setting (c, and l1_ratio, 0 if there is none) over stratified folds, all fitted together."""
    return search_and_fit(folded_rows(train, key, folds, label), settings, folds, whole=False)[0]
