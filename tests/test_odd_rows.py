"""Rows that earlier versions lost or misread."""

import pytest
from pyspark.sql import functions as F

from tidalframe.functions.missing import obs_year
from tidalframe.operators.history import concat_history, early_stop
from tidalframe.operators.profiling import site_year_distribution, years_per_site


def test_two_digit_years(spark):
    rows = spark.createDataFrame([("15-Sep-98",), ("15-Sep-05",), ("15-Sep-68",), ("15-Sep-69",), (None,)], "d string")
    assert [r.y for r in rows.select(obs_year(F.col("d")).alias("y")).collect()] == [1998, 2005, 2068, 1969, None]


def test_rows_without_a_site_are_no_site(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 2), ("b", 1)], "site string, year int")
    assert [tuple(r) for r in years_per_site(rows, "site", "year").collect()] == [("a", 2)]
    assert [tuple(r) for r in site_year_distribution(rows, "site", "year").collect()] == [(2, 1)]


def test_null_runs_stay(spark):
    phase = spark.createDataFrame([("r", 1, 0.1), (None, 1, 0.2), (None, 2, 0.3)], "run_id string, epoch int, val_accuracy double")
    joined = concat_history(phase, phase)
    assert sorted((r.run_id or "", r.epoch) for r in joined.collect()) == [("", 1), ("", 2), ("", 3), ("", 4), ("r", 1), ("r", 2)]
    assert {r.run_id: r.best_epoch for r in early_stop(joined).collect()} == {"r": 1, None: 2}


@pytest.mark.parametrize("bad", [float("nan"), None])
def test_a_diverged_epoch_is_not_the_best(spark, bad):
    rows = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.6), ("r", 3, bad), ("r", 4, 0.55)], "run_id string, epoch int, val_accuracy double")
    assert tuple(early_stop(rows, patience=2).first()) == ("r", 2, 4, True)
