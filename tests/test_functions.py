from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wellspring.functions.numeric import fill_missing, ieee_div, missing, strict_sum, sum_present
from wellspring.functions.series import complete_years, interpolate_linear
from wellspring.functions.text import code_pieces, drop_first, last_chars, lookup, name_piece

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "n, d, expected",
    [
        (1.0, 0.0, INF),
        (-1.0, 0.0, -INF),
        (0.0, 0.0, NAN),
        (NAN, 0.0, NAN),
        (None, 0.0, None),
        (1.0, None, None),
        (4.0, 2.0, 2.0),
        (1.0, NAN, NAN),
    ],
)
def test_division(spark, n, d, expected):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    got = df.select(ieee_div(F.col("n"), F.col("d"))).first()[0]
    assert got == expected or (got != got and expected != expected)


def test_sums(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None), ("c", NAN), ("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k")
    got = {
        r.k: (r.strict, r.present)
        for r in df.agg(
            strict_sum(F.col("v")).alias("strict"), sum_present(F.col("v")).alias("present")
        ).collect()
    }
    assert got["a"] == (3.0, 3.0)
    assert got["b"] == (None, 1.0)
    assert math.isnan(got["c"][0]) and got["c"][1] == 4.0
    assert got["d"] == (None, 0.0)


def test_missing_covers_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (NAN,), (INF,), (1.0,)], "v double")
    got = df.select(missing(F.col("v")), fill_missing(F.col("v"), 0.0)).collect()
    assert [tuple(r) for r in got] == [(True, 0.0), (True, 0.0), (False, INF), (False, 1.0)]


def test_names(spark):
    df = spark.createDataFrame([("N2O_AGR_AGR", "biofuel_FT_p2", "h2r1"), ("CH4", "x", "h")], "g string, s string, c string")
    got = df.select(
        drop_first(F.col("g"), "_AGR"),
        name_piece(F.col("s"), 1),
        name_piece(F.col("s"), 2),
        last_chars(F.col("s"), 2),
        *code_pieces(F.col("c"), (2,)),
        lookup(F.substring("c", 1, 2), {"h2": "two"}),
    ).collect()
    assert tuple(got[0]) == ("N2O_AGR", "FT", "p2", "p2", "h2", "r1", "two")
    assert tuple(got[1]) == ("CH4", None, None, "x", "h", "", None)


def test_interpolation(spark):
    rows = [
        ("inside", 2020, 1.0), ("inside", 2022, 3.0), ("inside", 2023, 0.0),
        ("late", 2022, 5.0), ("late", 2023, 6.0),
        ("single", 2021, 7.0),
        ("ties", 2020, 1.0), ("ties", 2020, 3.0), ("ties", 2022, 4.0),
        ("gap", 2020, 0.0), ("gap", 2021, NAN), ("gap", 2022, None), ("gap", 2023, 3.0),
        ("none", 2020, None),
        ("outside", 2020, 1.0), ("outside", 2021, 2.0), ("outside", 2030, 99.0),
    ]
    years = (2020, 2021, 2022, 2023)
    df = spark.createDataFrame(rows, "k string, year int, v double")
    out = interpolate_linear(complete_years(df, ["k"], "v", years), ["k"], "v")
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.year] = r.v
    got = {k: [v[y] for y in years] for k, v in got.items()}
    assert got["inside"] == [1.0, 2.0, 3.0, 0.0]
    assert got["late"] == [None, None, 5.0, 6.0]
    assert got["single"] == [None, 7.0, None, None]
    assert got["ties"] == [2.0, 3.0, 4.0, None]
    assert got["gap"] == [0.0, 1.0, 2.0, 3.0]
    assert got["none"] == [None] * 4
    assert got["outside"] == [1.0, 2.0, None, None]


def test_interpolation_shuffles_by_key_only_once_after_the_points(spark):
    df = spark.createDataFrame([("a", 2020, 1.0)], "k string, year int, v double")
    out = interpolate_linear(complete_years(df, ["k"], "v", (2020, 2021)), ["k"], "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
