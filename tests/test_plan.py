"""The composed analysis on a small project of facts."""

from __future__ import annotations

import pytest
from frames import collected
from pyspark.sql import functions as F

from wellspring import FactTables, LcaParams, LcaPlan
from wellspring.sources.schemas import FACTS

BASE, GREEN = "h1r1b1n1c1p1", "h2r1b1n1c1p1"
OIL = ("diesel", "oil refining", "oil refining")
BIO = ("diesel", "biomass liquids", "FT biofuels")
H2 = ("H2 MHDV", "onsite production", "electrolysis")
YEARS = (2020, 2040, 2050)


@pytest.fixture(scope="module")
def facts(spark):
    cells = [(s, y) for s in (BASE, GREEN) for y in YEARS]

    def fact(title, rows):
        return spark.createDataFrame(rows, FACTS[title])

    def techs(title, per_cell):
        return fact(
            title,
            [("", s, "USA", sec, sub, *([o] if o else []), tec, *([i] if i else []), y, v)
             for s, y in cells for sec, sub, o, tec, i, v in per_cell],
        )

    out = [(*k[:2], k[0], k[2], None, v) for k, v in [(OIL, 4.0), (BIO, 1.0), (H2, 2.0)]]
    out += [("elec", "hydro", "elec", "hydro", None, 3.0), ("elec", "coal", "elec", "coal", None, 1.0)]
    used = [
        (*OIL[:2], None, OIL[2], "regional oil", 5.0),
        (*BIO[:2], None, BIO[2], "biomass", 2.0),
        (*BIO[:2], None, BIO[2], "elec", 0.5),
        (*H2[:2], None, H2[2], "elec", 3.0),
        ("elec", "coal", None, "coal", "regional coal", 2.5),
        ("elec", "coal", None, "coal", "elec", 0.1),
        ("trn_freight_road", "truck", None, "liquids", "delivered diesel", 5.0),
    ]
    return FactTables(
        outputs_by_tech=techs("outputs by tech", out),
        inputs_by_tech=techs("inputs by tech", used),
        co2_sequestration_by_tech=techs("CO2 sequestration by tech", [(*BIO[:2], None, BIO[2], None, 0.2)]),
        nonco2_by_tech=techs(
            "NonCO2 GHG emissions by tech",
            [("elec", "coal", None, "coal", "CH4", 0.3), ("trn_freight_road", "truck", None, "liquids", "N2O_AGR", 0.01)],
        ),
        prices_by_sector=fact(
            "prices by sector",
            [("", s, "USA", k, y, v) for s, y in cells for k, v in [("diesel", 2.0), ("delivered diesel", 3.0)]],
        ),
        costs_by_tech=techs("costs by tech", [(*k[:2], None, k[2], None, 5.0) for k in (OIL, BIO, H2)]),
        co2_prices=fact("CO2 prices", [("", s, "USACO2", y, 10.0) for s, y in cells]),
        luc_by_region=fact(
            "LUC emissions by region",
            [("", f"biofuel_{b}_p1", "USA", y, v) for y in (2020, 2050) for b, v in [("base", 1.0), ("FT", 3.0)]],
        ),
        luc_outputs_by_tech=fact(
            "outputs by tech",
            [("", f"biofuel_{b}_p1", "USA", *BIO[:2], BIO[0], BIO[2], y, v)
             for y in (2020, 2050) for b, v in [("base", 1.0), ("FT", 2.0)]],
        ),
    )


@pytest.fixture(scope="module")
def plan(facts):
    return LcaPlan(facts, params=LcaParams(years=YEARS, sensitivity_depths=(0, 1, 8)))


def test_intensities_by_hand(plan):
    got = collected(
        plan.ghg.where((F.col("scenario") == BASE) & (F.col("year") == 2050)).select("fuel", "source", "kgCO2e_GJ"),
        "fuel",
        "source",
    )
    # Electricity takes 0.1/4 of itself, 2.5/4 coal and 0.3/4 CH4 per unit; ten steps are
    # one technology step and ten sector steps.
    chain = sum((0.1 / 4) ** i for i in range(10))
    coal, methane = 2.5 / 4 * chain * 100.1, 0.3 / 4 * chain * 30
    assert got["hydrogen", "Upstream CO2"] == pytest.approx(1.5 * coal, abs=1e-5)
    assert got["hydrogen", "Upstream CH4"] == pytest.approx(1.5 * methane, abs=1e-5)
    assert got["hydrogen", "Tailpipe CO2"] == 0.0
    assert got["petroleum diesel", "Upstream CO2"] == pytest.approx(5 / 4 * 71.867 - 71.867, abs=1e-5)
    luc = 2.0 * 31 * (44 / 12) / 31
    bio = 0.5 * coal - 0.2 * 3.667 - 71.867 + luc
    assert got["FT biofuels", "Upstream CO2"] == pytest.approx(bio, abs=1e-5)
    assert got["FT biofuels", "Tailpipe CO2"] == 71.867
    assert got["e-diesel", "Tailpipe N2O"] == pytest.approx(0.01 * 273 / 5, abs=1e-5)


def test_results_are_decoded_and_saved(spark, plan, tmp_path):
    plan.save(str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "fuels_prices"))
    assert {r["Hydrogen and Ammonia"] for r in back.collect()} == {"Default", "Green (Default cost)"}
    prices = collected(
        back.where((F.col("scenario") == BASE) & (F.col("year") == 2020)).select("reporting_fuel", "price_USDperGJ"),
        "reporting_fuel",
    )
    penalty = 10.0 * 1.772 / (44 / 12) / 1000
    assert prices["petroleum diesel"] == round(6.0 * 3.8 + 71.867 * penalty, 5)
    plan.save(str(tmp_path / "csv"), format="csv")
    lines = next((tmp_path / "csv" / "fuels_primary_energy").glob("*.csv")).read_text().splitlines()
    assert lines[0].startswith("fuel,scenario,Hydrogen and Ammonia,")


def test_depth_sensitivity_equals_separate_runs(plan, facts):
    got = collected(plan.depth_sensitivity(), "scenario", "fuel", "RD")
    for depth in (0, 1, 8):
        run = LcaPlan(facts, params=plan.p.with_(depth=depth, years=(2040,)))
        once = collected(
            run.ghg.where(~F.col("fuel").isin(*plan.p.sensitivity_excluded))
            .groupBy("scenario", "fuel")
            .agg(F.sum("kgCO2e_GJ")),
            "scenario",
            "fuel",
        )
        at_depth = {k[:2]: v for k, v in got.items() if k[2] == depth}
        assert at_depth.keys() == once.keys()
        assert all(at_depth[k] == pytest.approx(v, abs=1e-4) for k, v in once.items())


def test_reports_equal_filters_of_the_full_result(plan):
    from wellspring.operators import report

    pairs = [
        (plan.report_base_ghg(), report.base_ghg(plan.ghg, plan.p)),
        (plan.report_ghg_final_year(), report.final_year_ghg(plan.ghg, plan.p)),
        (plan.report_pe_scenarios(), report.contrasted_primary_energy(plan.primary_energy, plan.p)),
        (plan.report_pe_final_year(), report.final_year_primary_energy(plan.primary_energy, plan.p)),
    ]
    for narrow, full in pairs:
        rows = sorted(map(tuple, full.collect()), key=str)
        assert rows and sorted(map(tuple, narrow.collect()), key=str) == rows
    assert plan.report_prices().columns == ["scenario", "reporting_fuel", "year", "price_USDperGJ"]


def test_more_than_one_region_needs_the_region_filter(plan, facts):
    twice = facts.outputs_by_tech.unionByName(facts.outputs_by_tech.withColumn("region", F.lit("Canada")))
    fields = {f: getattr(facts, f) for f in facts.__dataclass_fields__} | {"outputs_by_tech": twice}
    run = LcaPlan(FactTables(**fields), params=plan.p)
    assert run.outputs_tech.count() == plan.outputs_tech.count()
