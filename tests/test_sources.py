from __future__ import annotations

import os

import pytest
from frames import SCENARIO, collected
from pyspark.sql import functions as F

from wellspring import FactTables, Mappings
from wellspring import fixed_values as fv
from wellspring.sources import extract, sinks, workspace
from wellspring.sources.schemas import FACTS, check_result
from wellspring.sources.tables import folder_of, read_blocks, read_fact


def fact(spark, title, *rows):
    return spark.createDataFrame(list(rows), FACTS[title])


def output_rows(spark, scenario, value):
    return fact(spark, "outputs by tech", ("EJ", scenario, "USA", "s", "b", "s", "t", 2020, value))


@pytest.fixture
def blocks(spark, tmp_path):
    """Two blocks of scenarios and one block of land-use runs with all query titles."""
    roots = []
    for block, scenarios in {"one": ("a1", "2020"), "two": ("b1",), "luc": ("biofuel_FT_p1",)}.items():
        root = str(tmp_path / block)
        for title, schema in FACTS.items():
            made = {"scenario": None, "region": "USA", "year": 2020, "value": 1.0}
            rows = [
                tuple(s if n == "scenario" else made.get(n, n[:1]) for n in schema.names)
                for s in scenarios
            ]
            sinks.save_fact(spark.createDataFrame(rows, schema), root, title)
        roots.append(root)
    return roots


def test_blocks_are_read_as_one_project(spark, blocks):
    tables = FactTables.read(spark, blocks[:2], blocks[2:])
    assert {r.scenario for r in tables.outputs_by_tech.collect()} == {"a1", "2020", "b1"}
    assert [r.scenario for r in tables.luc_by_region.collect()] == ["biofuel_FT_p1"]
    assert tables.co2_prices.columns == FACTS["CO2 prices"].names
    one = tables.scenario("b1")
    assert one.costs_by_tech.count() == 1 and one.luc_outputs_by_tech.count() == 1
    assert tables.scenarios_like("^[ab]").inputs_by_tech.count() == 2


def test_picking_a_scenario_prunes_partitions(spark, blocks):
    df = FactTables.read(spark, blocks[:2], blocks[2:]).scenario("a1").outputs_by_tech
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan
    assert len(df.inputFiles()) == 3 or "a1" in plan


def test_scenarios_are_saved_by_name_pattern(spark, blocks, tmp_path):
    df = read_fact(spark, blocks[:2], "CO2 prices")
    sinks.save_scenarios_like(df, "1$", str(tmp_path / "kept"), "CO2 prices")
    kept = read_fact(spark, [str(tmp_path / "kept")], "CO2 prices")
    assert sorted(r.scenario for r in kept.collect()) == ["a1", "b1"]
    assert {n for n in os.listdir(tmp_path / "kept" / folder_of("CO2 prices")) if "=" in n} == {
        "scenario=a1",
        "scenario=b1",
    }


def test_blocks_are_written_in_one_pass_and_picked_by_their_files(spark, blocks, tmp_path):
    df, folder = read_fact(spark, blocks[:2], "CO2 prices"), str(tmp_path / "together")
    sinks.save_blocks(df, {"one": "1$", "2": "^2020$"}, folder, "CO2 prices")
    assert sorted(r.scenario for r in read_fact(spark, [folder], "CO2 prices").collect()) == ["2020", "a1", "b1"]
    picked = read_blocks(spark, folder, "CO2 prices", ["one"], ["b1", "2020"])
    assert picked.columns == FACTS["CO2 prices"].names and [r.scenario for r in picked.collect()] == ["b1"]
    scan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "(block#" in scan.split("PartitionFilters", 1)[1]
    assert [r.scenario for r in read_blocks(spark, folder, "CO2 prices", ["2"]).collect()] == ["2020"]
    only = str(tmp_path / "only")
    sinks.save_blocks(df, {"b": "^b"}, only, "CO2 prices")
    assert [r.scenario for r in read_blocks(spark, only, "CO2 prices").collect()] == ["b1"]
    with pytest.raises(Exception, match="scenario .1 is in blocks x, y"):
        sinks.save_blocks(df, {"x": "1$", "y": "^[ab]"}, str(tmp_path / "twice"), "CO2 prices")


def test_missing_columns_are_named(spark, tmp_path):
    bad = fact(spark, "CO2 prices", ("", "a", "USACO2", 2020, 1.0)).drop("market", "year")
    sinks.save_fact(bad, str(tmp_path), "CO2 prices")
    with pytest.raises(ValueError, match="CO2 prices: missing column.* market, year"):
        read_fact(spark, [str(tmp_path)], "CO2 prices")


def test_csv_facts_and_csv_results(spark, tmp_path):
    df = fact(
        spark,
        "CO2 prices",
        ("", "a", "USACO2", 2020, None),
        ("", "a", "other", 2020, float("nan")),
        ("", "b", "USACO2", 2025, 1.5),
    )
    path = tmp_path / folder_of("CO2 prices")
    sinks.save_csv(df, str(path))
    text = "".join(f.read_text() for f in path.glob("*.csv"))
    assert ",NA" in text and ",NaN" in text and "Units,scenario,market,year,value" in text
    back = collected(read_fact(spark, [str(tmp_path)], "CO2 prices", "csv").drop("Units"), "scenario", "market", "year")
    assert back["a", "USACO2", 2020] is None and back["b", "USACO2", 2025] == 1.5
    assert back["a", "other", 2020] != back["a", "other", 2020]


def test_mappings_from_csv_equal_the_published_ones(spark, tmp_path):
    published = Mappings.published()
    for name in ("fuel_techs", "co2_ef", "nonco2_gwp", "fuel_delivery_cost", "scenario_definitions"):
        rows = published.records(name)
        lines = [",".join(rows[0]), *(",".join("" if v is None else str(v) for v in r.values()) for r in rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    assert Mappings.read_csv(spark, str(tmp_path)) == published


def test_published_mappings_have_the_expected_shape(m):
    assert len(m.fuel_techs) == 16 and len(set(m.column("fuel_techs", "reporting_fuel"))) == 12
    assert len(m.co2_ef) == 14 and len(m.scenario_definitions) == 16
    levels = {}
    for r in m.records("scenario_definitions"):
        levels.setdefault(r["variable_name"], []).append(r["string"])
    product = 1
    for names in levels.values():
        product *= len(names)
    assert product == 288
    assert len(fv.LUC_REGIONS) == len(set(fv.LUC_REGIONS)) == 32


def test_mapping_rules(m):
    twice = (*m.fuel_techs, m.fuel_techs[0])
    with pytest.raises(ValueError, match="listed once"):
        Mappings(twice, m.co2_ef, m.nonco2_gwp, m.fuel_delivery_cost, m.scenario_definitions)
    with pytest.raises(ValueError, match="at most"):
        Mappings(m.fuel_techs, m.co2_ef, m.nonco2_gwp, m.fuel_delivery_cost, (("p1", "P", "x"),) * 10_001)


def test_extraction_filters(spark):
    leaves = spark.createDataFrame(
        [("a", "USA", y, v) for y, v in [(2015, 1.0), (2016, 2.0), (2016, 3.0), (2054, 4.0), (2055, 5.0)]]
        + [("a", "Atlantis", 2016, 9.0)],
        "scenario string, region string, year int, value double",
    )
    df = extract.sum_land_leaves(extract.between_years(extract.in_regions(leaves, fv.LUC_REGIONS)))
    assert collected(df.select("year", "value"), "year") == {2016: 5.0, 2054: 4.0}
    gases = spark.createDataFrame([("CH4",), ("N2O_AGR",), ("SF6",)], "ghg string")
    assert {r.ghg for r in extract.emitted_gases(gases).collect()} == {"CH4", "N2O_AGR"}
    costs = spark.createDataFrame([("AgSupplySector",), ("supplysector",)], "sector_type string")
    assert extract.without_agricultural_supply(costs).count() == 1
    markets = spark.createDataFrame([("USACO2",), ("USACO2_LTG",), ("USAcoal",)], "market string")
    assert extract.carbon_markets(markets).count() == 2
    assert extract.in_region(leaves, "USA").count() == 5 and extract.in_region(leaves, None).count() == 6


def test_filters_reach_the_scan(spark, blocks, p):
    from wellspring.operators.flows import clean_outputs

    df = clean_outputs(read_fact(spark, blocks[:1], "outputs by tech"), p)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,USA)" in plan and "EqualTo(year,2020)" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "Units" not in read


class Session:
    """A session reduced to the settings that decide where tables are written."""

    def __init__(self, folder=None, checkpoint=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type(
            "Context", (), {"applicationId": "app", "getCheckpointDir": staticmethod(lambda: checkpoint)}
        )


def test_shared_folder_is_the_one_the_cluster_names():
    assert workspace.shared_folder(Session("hdfs:///shared/")) == "hdfs:///shared/wellspring-app"
    assert workspace.shared_folder(Session(checkpoint="hdfs:///cp")) == "hdfs:///cp/wellspring-app"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())


def test_tables_are_written_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda _: str(tmp_path))
    df = workspace.materialize(spark.range(3).withColumn("k", F.col("id") % 2), "x", by="k")
    assert sorted(tuple(r) for r in df.collect()) == [(0, 0), (1, 1), (2, 0)]
    assert all(f.startswith(f"file://{tmp_path}/x-") for f in df.inputFiles())


def test_bucketed_tables_are_written_and_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "shared_folder", lambda _: f"file://{tmp_path}/app")
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    df = workspace.materialize_buckets(rows, "x", 3, ["k"])
    assert sorted(tuple(r) for r in df.collect()) == [(i, i % 7) for i in range(100)]
    assert len(list((tmp_path / "app").glob("x-*/*.parquet"))) <= 3
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("wellspring_x_")}
    assert names
    workspace.release(spark)
    assert not (tmp_path / "app").exists()
    assert not names & {t.name for t in spark.catalog.listTables()}


def test_results_are_checked(spark):
    df = spark.createDataFrame([("a", "f", 2020, 1.0)], "scenario string, reporting_fuel string, year int, price_USDperGJ double")
    assert check_result(df, "fuels_prices") is df
    with pytest.raises(ValueError, match="fuels_prices: missing"):
        check_result(df.drop("year"), "fuels_prices")
    with pytest.raises(TypeError, match="year"):
        check_result(df.withColumn("year", F.col("year").cast("string")), "fuels_prices")
    assert SCENARIO
