"""Sums that are the same bits whatever the order and partitioning."""

from __future__ import annotations

import math
import random
from dataclasses import fields, replace
from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import functions as F
from test_plan import facts  # noqa: F401

from wellspring import LcaParams, LcaPlan
from wellspring.functions.exact import exact_sum, exact_sums
from wellspring.functions.numeric import strict_sum


def naive(values):
    return reduce(add, values, 0.0)  # the built-in sum compensates


def total(spark, values, partitions=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)
    return df.agg(exact_sum(F.col("x")).alias("s")).first().s


def test_sums_equal_exact_fractions(spark):
    rng = random.Random(1)
    for low, high in ((-3, 3), (-60, 20), (10, 60), (-20, -19)):
        values = [rng.uniform(-1, 1) * 2.0 ** rng.randint(low, high) for _ in range(400)]
        exact = float(sum(map(Fraction, values)))
        assert abs(total(spark, values) - exact) <= math.ulp(exact)
    tenths = [0.1] * 1000
    assert total(spark, tenths) == float(1000 * Fraction(0.1)) != naive(tenths)
    assert total(spark, [1e16, 1.0, -1e16]) == 1.0
    assert total(spark, [2.0**61, 2.0**-70, -(2.0**61)]) == 2.0**-70


def test_sums_of_special_terms(spark):
    assert total(spark, [None, None]) is None and total(spark, [None, 2.5]) == 2.5
    assert math.isnan(total(spark, [1.0, float("nan")]))
    assert total(spark, [1.0, float("inf")]) == float("inf")
    assert total(spark, [1e300, 1.0]) == 1e300 and total(spark, [-0.0]) == 0.0


def test_sums_are_the_same_bits_on_any_partitions(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 9) for _ in range(3000)]
    found = set()
    for partitions in (1, 8, 211):
        rng.shuffle(values)
        found.add(total(spark, values, partitions))
    assert len(found) == 1
    assert len({naive(sorted(values)), naive(values), naive(sorted(values, key=abs))}) > 1  # plain sums differ


def test_strict_sums_are_exact_inside_the_context_only(spark):
    df = spark.createDataFrame([(0.1,)] * 10 + [(1e16,), (-1e16,)], "x double")
    with exact_sums():
        exact = strict_sum(F.col("x"))
    assert df.agg(exact).first()[0] == 1.0
    nulls = spark.createDataFrame([(1.0,), (None,)], "x double")
    with exact_sums():
        assert nulls.agg(strict_sum(F.col("x"))).first()[0] is None
    assert "shiftright" not in str(strict_sum(F.col("x")))


def test_an_analysis_is_the_same_bits_on_any_partitions(spark, facts):  # noqa: F811
    """Facts cut into many rows and dealt anew: every unrounded step keeps its bits."""
    p = LcaParams(years=(2020, 2040, 2050))
    rng = random.Random(3)
    shares = F.array(*[F.lit(rng.random()) for _ in range(40)])
    seen = []
    for partitions in (1, 8, 211):
        dealt = {}
        for f in fields(facts):
            df = getattr(facts, f.name)
            if f.name in ("inputs_by_tech", "nonco2_by_tech"):  # many rows of each key
                df = df.withColumn("value", F.explode(F.transform(shares, lambda s: s * F.col("value"))))
            dealt[f.name] = df.repartition(partitions, F.rand(partitions))
        with exact_sums():
            plan = LcaPlan(replace(facts, **dealt), params=p, shared=False)
            rows = plan.inputs_sector.unionByName(plan.io_coefs_sector)
        seen.append({(r.scenario, r.sector, r.year, r.input, r.value) for r in rows.collect()})
    assert len(seen[0]) > 10 and seen[0] == seen[1] == seen[2]
