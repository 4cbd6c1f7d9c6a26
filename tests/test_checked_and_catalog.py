"""Rows that do not parse, functions for SQL, rounding, and narrowed reads."""

from __future__ import annotations

import math

import pytest
from frames import collected
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring import LcaParams, Mappings
from wellspring.functions import catalog, series
from wellspring.functions.numeric import ieee_div, round_nearest
from wellspring.operators.assemble import decode_scenario
from wellspring.sources import extract
from wellspring.sources.checked import read_checked
from wellspring.standin import tables

TITLE = "CO2 prices"


def written(folder, name, text):
    path = folder / "CO2_prices"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    written(
        tmp_path / "one", "a.csv",
        "Units,scenario,market,year,value\nx,s1,USACO2,2020,1.5\nx,s1,USACO2,20x5,2.5\nx,s2,USACO2,2030,n.d.\n"
        "x,s3,USACO2,2020\nx,s4,USACO2,2020,1,extra\nx,s5,USACO2,2020,NA\n",
    )
    written(tmp_path / "two", "b.csv", "value,year,market,scenario,Units\n7,2020,USACO2,s6,x\n,2020,USACO2,s7,x\n")
    read = read_checked(spark, [str(tmp_path / "one"), str(tmp_path / "two")], TITLE)
    good = collected(read.good.select("scenario", "year", "value"), "scenario")
    assert good == {"s1": (2020, 1.5), "s5": (2020, None), "s6": (2020, 7.0), "s7": (2020, None)}
    bad = sorted((r.reason, r.title, r.file.rsplit("/", 1)[1]) for r in read.quarantine.collect())
    assert bad == [("line", TITLE, "a.csv"), ("line", TITLE, "a.csv"), ("value", TITLE, "a.csv"), ("year", TITLE, "a.csv")]
    records = {r.record for r in read.quarantine.where("reason = 'line'").collect()}
    assert records == {"x,s3,USACO2,2020", "x,s4,USACO2,2020,1,extra"}
    counts = collected(read.counts().select("reason", "rows"), "reason")
    assert counts == {"line": 2, "value": 1, "year": 1}


def test_a_block_of_whole_rows_has_an_empty_quarantine_and_a_missing_column_is_named(spark, tmp_path):
    written(tmp_path, "a.csv", "Units,scenario,market,year,value\nx,s1,USACO2,2020,1.5\n")
    assert read_checked(spark, [str(tmp_path)], TITLE).quarantine.count() == 0
    written(tmp_path / "other", "a.csv", "Units,scenario,year,value\nx,s1,2020,1.5\n")
    with pytest.raises(ValueError, match="market"):
        read_checked(spark, [str(tmp_path / "other")], TITLE)


def nearest(x, digits):
    if math.isnan(x) or abs(x) >= 10.0 ** (15 - digits):
        return x
    scale, size = 10.0**digits, abs(x)
    below, above = math.floor(size * scale) / scale, math.ceil(size * scale) / scale
    even = math.floor(size * scale) % 2 == 0
    found = below if size - below < above - size or (size - below == above - size and even) else above
    return -found if x < 0 and found else found


def rounded(spark, values, digits):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "i int, x double")
    return [r.y for r in df.withColumn("y", round_nearest(F.col("x"), digits)).orderBy("i").collect()]


def test_rounding_takes_the_nearer_double_and_ties_to_the_even(spark):
    assert rounded(spark, [0.15, 0.25, 0.35, -0.15, 2.5], 1) == [0.1, 0.2, 0.3, -0.1, 2.5]
    assert rounded(spark, [0.5, 1.5, 2.5, -2.5, 3.5], 0) == [0.0, 2.0, 2.0, -2.0, 4.0]
    ties = [0.000005, 0.000015, 0.000025, 1.000005, 2.000015, 0.123455, 5.015625]
    assert rounded(spark, ties, 5) == [nearest(x, 5) for x in ties]
    assert rounded(spark, [0.0000050001, 0.0000149999], 5) == [1e-05, 1e-05]
    assert rounded(spark, [5.5 / 1e5, 6.5 / 1e5], 5) == [nearest(5.5 / 1e5, 5), nearest(6.5 / 1e5, 5)]


def test_rounding_of_special_and_large_numbers(spark):
    values = [None, float("nan"), float("inf"), -float("inf"), 1e300, 123456789012.345678, -0.0000001, 0.0]
    got = rounded(spark, values, 5)
    assert got[0] is None and math.isnan(got[1])
    assert got[2:] == [float("inf"), -float("inf"), 1e300, 123456789012.345678, 0.0, 0.0]
    assert math.copysign(1, got[6]) == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=50, max_size=200), st.integers(0, 6))
def test_rounding_equals_its_definition(spark, values, digits):
    assert rounded(spark, values, digits) == [nearest(v, digits) + 0.0 for v in values]


def test_sql_decodes_scenarios_like_the_operator(spark):
    m, p = Mappings.published(), LcaParams()
    assert "decode_scenario" in catalog.register(spark, m, p)
    codes = ["h1r1b1n1c1p1", "h4r3b2n2c2p3", "h9r1b1n1c1p2", "short", "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, scenario string")
    df.createOrReplaceTempView("codes")
    sql = spark.sql("SELECT i, c.scenario, d.* FROM codes c, LATERAL decode_scenario(c.scenario) d")
    want = decode_scenario(df, m, p)
    assert sql.columns == want.columns
    assert {tuple(r) for r in sql.collect()} == {tuple(r) for r in want.collect()}
    plan = sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert spark.sql("SELECT scenario_level('h2'), scenario_level('zz')").first()[:] == ("Green (Default cost)", None)


def test_names_with_quotes_are_kept(spark):
    base = Mappings.published()
    m = Mappings(base.fuel_techs, base.co2_ef, base.nonco2_gwp, base.fuel_delivery_cost, (("a1", "Tick ` name", "it's \\ so"),))
    catalog.register(spark, m, LcaParams(code_cuts=()))
    row = spark.sql("SELECT d.* FROM decode_scenario('a1') d").first()
    assert row.asDict() == {"Tick ` name": "it's \\ so"}
    with pytest.raises(ValueError, match="dimensions"):
        catalog.definitions(m, LcaParams())


def test_sql_interpolates_like_the_operator(spark):
    catalog.register(spark)
    rows = [("a", 2020, 1.0), ("a", 2020, 3.0), ("a", 2024, 6.0), ("a", 2026, None), ("a", 2028, float("nan")), ("a", 2030, 0.0)]
    rows += [("b", 2025, 4.0), ("c", 2020, None)]
    df = spark.createDataFrame(rows, "k string, year int, v double")
    df.createOrReplaceTempView("known")
    years = tuple(range(2019, 2032))
    want = collected(series.interpolate_linear(series.complete_years(df, ["k"], "v", years), ["k"], "v"), "k", "year")
    got = spark.sql(f"""SELECT k, year, interpolated(points, year) AS v
        FROM (SELECT k, collect_list(struct(year, v AS value)) AS points FROM known GROUP BY k)
        LATERAL VIEW explode(sequence({years[0]}, {years[-1]})) AS year""")
    assert collected(got, "k", "year") == want
    assert want["a", 2020] == 2.0 and want["a", 2022] == 4.0 and want["a", 2027] == 3.0 and want["b", 2026] is None


def test_sql_ratio_is_ieee_division(spark):
    catalog.register(spark)
    values = [None, 0.0, 1.0, -2.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "n double, d double")
    df = df.select(ieee_div(F.col("n"), F.col("d")).cast("string").alias("x"), F.expr("ratio(n, d)").cast("string").alias("y"))
    assert df.where("NOT x <=> y").count() == 0


def test_land_use_rows_by_region_keep_the_year_bounds(spark):
    rows = spark.createDataFrame([("s", "r", y, 1.0) for y in (2015, 2016, 2054, 2055, None)], "scenario string, region string, year int, value double")
    assert sorted(r.year for r in extract.land_use(rows).collect()) == [2016, 2054]


SF_DIR = "/root/testdata/sf0.001"


def test_wanted_scenarios_and_years_are_filtered_in_the_scans(spark):
    only = tables.Only("^m1p1$", (2001,))
    assert only.codes == [("AUTOMOBILE", 1)]
    plan = tables.base(spark, SF_DIR, only)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("c_mktsegment" in x and "AUTOMOBILE" in x for x in pushed) and any("2001-01-01" in x for x in pushed)
    assert "REPARTITION" not in plan
    with pytest.raises(ValueError, match="land-use"):
        tables.sums(spark, SF_DIR, [tables.LUC], only)


def test_a_hot_order_is_split_by_adaptive_execution(spark, monkeypatch, tmp_path):
    """Nine of ten lines of one order: the library's join of lines and orders reads it in parts."""
    lines = spark.range(80_000).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 1 ELSE id END AS l_orderkey", "id % 20 AS l_partkey", "id % 10 AS l_suppkey",
        "1D AS l_quantity", "rand(7) AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'A' AS l_returnflag",
    )
    orders = spark.range(80_000).selectExpr(
        "id AS o_orderkey", "id % 50 AS o_custkey", "'F' AS o_orderstatus",
        "CAST(TIMESTAMP_NTZ '1996-03-01 00:00:00' AS TIMESTAMP_NTZ) AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    lines.repartition(16).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("customer", "supplier", "part"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "256k",
    }
    kept = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = tables.base(spark, str(tmp_path)).select("l_orderkey", "policy", "l_extendedprice")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

