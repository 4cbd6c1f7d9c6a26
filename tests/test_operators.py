"""Hand-computed cases of every operator but the expansion."""

from __future__ import annotations

import pytest
from frames import SCENARIO, collected, inputs, outputs
from pyspark.sql import functions as F

from wellspring import LcaParams, Mappings
from wellspring.operators import assemble, flows, intensity, luc, prices, report, tailpipe
from wellspring.operators.upstream import fuel_production, upstream_expand

FACT = "Units string, scenario string, region string, sector string, subsector string"


def rounded(d, n=9):
    return {k: None if v is None else round(v, n) for k, v in d.items()}


# Flows


def raw_outputs(spark, rows):
    return spark.createDataFrame(
        [("EJ", SCENARIO, r, s, "b", o, t, y, v) for r, s, o, t, y, v in rows],
        FACT + ", output string, technology string, year int, value double",
    )


def test_outputs_keep_primary_products_of_the_region_and_years(spark, p):
    df = raw_outputs(
        spark,
        [
            ("USA", "s", "s", "t", 2020, 1.0),
            ("USA", "s", "byproduct", "t", 2020, 2.0),
            ("USA", "s", "s", "t", 2021, 4.0),
            ("Canada", "s", "s", "t", 2020, 8.0),
        ],
    )
    assert [r.value for r in flows.clean_outputs(df, p).collect()] == [1.0]
    both = flows.clean_outputs(df, p.with_(region=None))
    assert sorted(r.value for r in both.collect()) == [1.0, 8.0]


def test_inputs_are_assembled_from_four_sources(spark, p):
    tech = FACT + ", technology string"
    raw = spark.createDataFrame(
        [
            ("EJ", SCENARIO, "USA", "s", "b", "t", i, 2020, v)
            for i, v in [("coal", 1.0), ("water_td_x", 2.0), ("oil-credits", 3.0), (None, 4.0)]
        ],
        tech + ", input string, year int, value double",
    )
    out = outputs(spark, [("elec", "hydro", "hydro", 5.0), ("elec", "gas", "gas", 6.0)])
    stored = spark.createDataFrame(
        [("MtC", SCENARIO, "USA", "s", "b", "t", 2020, 7.0)], tech + ", year int, value double"
    )
    gases = spark.createDataFrame(
        [("Tg", SCENARIO, "USA", "s", "b", "t", g, 2020, v) for g, v in [("N2O_AGR", 8.0), ("CH4", 9.0)]],
        tech + ", ghg string, year int, value double",
    )
    got = flows.assemble_inputs(raw, out, stored, gases, p)
    assert collected(got.select("input", "value"), "input") == {
        "coal": 1.0,
        "hydropower": 5.0,
        "carbon-storage": 7.0,
        "N2O": 8.0,
        "CH4": 9.0,
    }


def test_sector_total_is_null_when_a_term_is(spark):
    df = inputs(spark, [("s", "b", "t", "i", 1.0), ("s", "b", "u", "i", None), ("s", "b", "t", "j", 2.0)])
    got = flows.sector_totals(df, "input").select("input", "value")
    assert collected(got, "input") == {"i": None, "j": 2.0}


# Intensities

HYDROGEN = [("H2 MHDV", "H2 delivery", "H2 pipeline"), ("H2 MHDV", "onsite production", "electrolysis")]


def analysed(spark, m, p, produced, used, sectors=()):
    out = outputs(spark, [*produced, *[(s, s, s, 1.0) for s, _, _ in sectors]])
    inp = inputs(spark, [*used, *[(s, s, s, i, v) for s, i, v in sectors]])
    absorbed = upstream_expand(out, inp, m, p.with_(depth=2), by_depth=False)
    return absorbed, fuel_production(out, m)


def test_capture_lowers_co2_and_is_no_primary_energy(spark, m, p):
    diesel = ("diesel", "oil refining", "oil refining")
    absorbed, made = analysed(
        spark,
        m,
        p,
        [(*diesel, 2.0)],
        [(*diesel, "regional oil", 3.0), (*diesel, "carbon-storage", 1.5), (*diesel, "CH4", 0.5)],
    )
    co2 = intensity.upstream_co2(absorbed, made, m)
    expected = (3.0 * 71.867 - 1.5 * 3.667) / 2.0 - 71.867
    assert collected(co2.select("fuel", "kgCO2_GJ"), "fuel") == {"petroleum diesel": pytest.approx(expected)}
    energy = intensity.primary_energy(absorbed, made, m, p)
    assert collected(energy.select("Primary_fuel", "IO"), "Primary_fuel") == {"Oil": 1.5}
    gas = intensity.upstream_nonco2(absorbed, made, m)
    assert collected(gas.select("GHG", "kgCO2e_GJ"), "GHG") == {"CH4": 0.5 * 30 / 2.0}


def test_denominator_counts_only_fuels_with_a_row(spark, m, p):
    absorbed, made = analysed(
        spark,
        m,
        p,
        [(*HYDROGEN[0], 1.0), (*HYDROGEN[1], 3.0)],
        [
            (*HYDROGEN[0], "regional coal", 2.0),
            (*HYDROGEN[1], "hydropower", 6.0),
            (*HYDROGEN[1], "N2O", 0.1),
        ],
    )
    energy = intensity.primary_energy(absorbed, made, m, p).select("Primary_fuel", "IO")
    assert collected(energy, "Primary_fuel") == {"Coal": 2.0, "Hydropower": 2.0}
    gas = intensity.upstream_nonco2(absorbed, made, m).select("GHG", "kgCO2e_GJ")
    assert rounded(collected(gas, "GHG")) == {"N2O": round(0.1 * 273 / 3.0, 9)}
    co2 = intensity.upstream_co2(absorbed, made, m).select("fuel", "kgCO2_GJ")
    assert rounded(collected(co2, "fuel")) == {"hydrogen": round(2.0 * 100.1 / 4.0, 9)}


def test_zero_output_technology_makes_its_group_nan(spark, m, p):
    absorbed, made = analysed(
        spark,
        m,
        p,
        [(*HYDROGEN[0], 0.0), (*HYDROGEN[1], 3.0)],
        [(*HYDROGEN[0], "regional coal", 0.0), (*HYDROGEN[1], "regional coal", 6.0)],
    )
    value = intensity.upstream_co2(absorbed, made, m).first()["kgCO2_GJ"]
    assert value != value


def test_missing_sector_output_makes_the_group_null(spark, m, p):
    fuel = HYDROGEN[0]
    out = outputs(spark, [(*fuel, 1.0)])
    inp = inputs(spark, [(*fuel, "x", 1.0), ("x", "x", "x", "regional coal", 1.0)])
    absorbed = upstream_expand(out, inp, m, p.with_(depth=1), by_depth=False)
    rows = intensity.upstream_co2(absorbed, fuel_production(out, m), m).collect()
    assert [r["kgCO2_GJ"] for r in rows] == [None]


# Tailpipe


def test_tailpipe_co2_covers_every_fuel_scenario_and_year(spark, m):
    p = LcaParams(years=(2020, 2025))
    out = outputs(spark, [("s", "b", "t", 1.0), ("s", "b", "u", 1.0)], "x").unionByName(
        outputs(spark, [("s", "b", "t", 1.0)], "y")
    )
    df = tailpipe.tailpipe_co2(out, m, p)
    got = collected(df, "fuel", "scenario", "year")
    assert len(got) == 12 * 2 * 2
    assert got["petroleum diesel", "y", 2025] == 71.867 and got["LNG", "x", 2020] == 52.1
    assert "crossJoin" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tailpipe_nonco2_sums_over_pairs_of_energy_and_gas(spark, m, p):
    truck = ("trn_freight_road", "truck", "liquids")
    used = inputs(
        spark,
        [
            (*truck, "delivered diesel", 2.0),
            (*truck, "delivered diesel", 3.0),
            (*truck, "H2 MHDV", 5.0),
            ("trn_freight", "rail", "none", "elect_td_trn", 1.0),
            ("other", "x", "y", "delivered diesel", 100.0),
        ],
    )
    gases = inputs(
        spark, [(*truck, "CH4", 0.1), (*truck, "CH4", 0.3), (*truck, "N2O", 0.01), ("other", "x", "y", "CH4", 9.0)]
    )
    got = rounded(
        collected(
            tailpipe.tailpipe_nonco2(used, gases, m, p).select("fuel", "GHG", "kgCO2e_GJ"), "fuel", "GHG"
        )
    )
    # Pairs of two energy rows and two gas rows: energy (2+3)*2, mass (0.1+0.3)*2 rows.
    diesel = {"FT biofuels", "FT biofuels CCS", "renewable diesel", "e-diesel", "petroleum diesel"}
    assert {k[0] for k in got} == diesel | {"hydrogen"}
    assert got["e-diesel", "CH4"] == round(0.4 * 30 * 2 / (5.0 * 2), 9)
    assert got["e-diesel", "N2O"] == round(0.01 * 273 * 2 / 5.0, 9)
    assert got["hydrogen", "CH4"] == round(0.4 * 30 / (5.0 * 2), 9)


# Prices


def price_frames(spark, carbon=100.0, delivered=3.0):
    sector = "Units string, scenario string, region string, sector string, year int, value double"
    by_sector = [("diesel", 2.0), ("other", 9.0)] + ([("delivered diesel", delivered)] if delivered else [])
    markets = [("USACO2", carbon), ("USACO2_LTG", 7.0)] if carbon else []
    return (
        spark.createDataFrame([("", SCENARIO, "USA", s, 2020, v) for s, v in by_sector], sector),
        spark.createDataFrame(
            [("", SCENARIO, k, 2020, v) for k, v in markets],
            "Units string, scenario string, market string, year int, value double",
        ),
    )


def price_of(spark, m, p, costs, made, **kw):
    by_sector, co2 = price_frames(spark, **kw)
    costs = spark.createDataFrame(
        [("", SCENARIO, "USA", s, b, t, 2020, v) for s, b, t, v in costs],
        FACT + ", technology string, year int, value double",
    )
    df = prices.fuel_prices(
        costs, prices.delivery_costs(by_sector, m, p), prices.co2_penalties(co2, p), outputs(spark, made), m, p
    )
    return collected(df.select("reporting_fuel", "price_USDperGJ"), "reporting_fuel")


REFINING = ("diesel", "oil refining", "oil refining")


def test_price_adds_delivery_and_carbon(spark, m, p):
    got = price_of(spark, m, p, [(*REFINING, 4.0)], [(*REFINING, 2.0)])
    penalty = 100.0 * 1.772 / (44 / 12) / 1000
    assert got == {"petroleum diesel": round((4.0 + 1.0) * 3.8 + 71.867 * penalty, 5)}


def test_price_without_delivery_or_carbon(spark, m, p):
    got = price_of(spark, m, p, [(*REFINING, 4.0)], [(*REFINING, 2.0)], carbon=None, delivered=None)
    assert got == {"petroleum diesel": round(4.0 * 3.8, 5)}


def test_price_is_weighted_by_output_and_nan_without_any(spark, m, p):
    costs = [(*HYDROGEN[0], 10.0), (*HYDROGEN[1], 20.0), ("LNG", "LNG", "LNG", 5.0)]
    got = price_of(spark, m, p, costs, [(*HYDROGEN[0], 3.0), (*HYDROGEN[1], 1.0)], carbon=None)
    lng = got.pop("LNG")
    assert lng != lng
    assert got == {"hydrogen": round((10.0 * 3 + 20.0) / 4 * 3.8, 5)}


# Land-use change

RUNS = ("biofuel_base_p1", "biofuel_FT_p1")


def luc_frames(spark, years, carbon, fuel):
    by_region = spark.createDataFrame(
        [("MtC", s, r, y, carbon[s] / 2) for s in RUNS for r in ("USA", "Brazil") for y in years]
        + [("MtC", s, "Atlantis", y, 1e6) for s in RUNS for y in years],
        "Units string, scenario string, region string, year int, value double",
    )
    made = spark.createDataFrame(
        [
            ("EJ", s, "USA", "diesel", "biomass liquids", "diesel", "FT biofuels", y, fuel[s])
            for s in RUNS
            for y in years
        ],
        FACT + ", output string, technology string, year int, value double",
    )
    return by_region, made


def luc_of(spark, m, p, *frames):
    by_region, made = luc_frames(spark, *frames)
    df = luc.luc_intensity(luc.luc_interpolated(by_region, p), luc.biofuel_interpolated(made, m, p), m, p)
    return collected(df, "fuel", "Policy")


def test_luc_is_added_carbon_over_added_fuel(spark, m, p):
    got = luc_of(spark, m, p, (2020, 2030, 2050), dict(zip(RUNS, (10.0, 16.0))), dict(zip(RUNS, (1.0, 3.0))))
    assert rounded(got) == {("FT biofuels", "p1"): round(6.0 * 31 * (44 / 12) / (2.0 * 31), 9)}


def test_luc_of_uncovered_years_is_null_and_not_added(spark, m, p):
    got = luc_of(spark, m, p, (2025, 2050), dict(zip(RUNS, (10.0, 16.0))), dict(zip(RUNS, (1.0, 3.0))))
    assert got == {("FT biofuels", "p1"): None}
    up = spark.createDataFrame([("FT biofuels", SCENARIO, 2020, 5.0)], "fuel string, scenario string, year int, kgCO2e_GJ double")
    extra = spark.createDataFrame([("FT biofuels", "p1", None)], "fuel string, Policy string, LUC_kgCO2_GJ double")
    assert assemble.add_luc(up, extra, p).first()["kgCO2e_GJ"] == 5.0
    extra = spark.createDataFrame([("FT biofuels", "p1", 2.5), ("FT biofuels", "p2", 9.0)], extra.schema)
    assert assemble.add_luc(up, extra, p).first()["kgCO2e_GJ"] == 7.5


# Assembly


def co2_frame(spark, rows):
    return spark.createDataFrame(
        [(f, SCENARIO, 2020, v) for f, v in rows], "fuel string, scenario string, year int, kgCO2_GJ double"
    )


def test_greet_shift_leaves_the_total_unchanged(spark, m, p):
    rows = [("FT biofuels", 1.0), ("e-diesel", None), ("LNG", 2.0), ("petroleum diesel", 3.0)]
    up, tail = assemble.tag_co2(co2_frame(spark, rows), "Upstream"), assemble.tag_co2(co2_frame(spark, rows), "Tailpipe")
    moved = [
        collected(df.select("fuel", "kgCO2e_GJ"), "fuel")
        for df in assemble.greet_convention(up, tail, m, p)
    ]
    assert moved[0] == {"FT biofuels": 1.0 - 71.867, "e-diesel": None, "LNG": 2.0, "petroleum diesel": 3.0}
    assert moved[0]["FT biofuels"] + moved[1]["FT biofuels"] == 2.0
    assert assemble.greet_convention(up, tail, m, p.with_(greet_convention=False)) == (up, tail)


def test_all_sources_are_put_together_and_rounded(spark, m, p):
    gas = "fuel string, scenario string, year int, GHG string, kgCO2e_GJ double"
    nonco2 = spark.createDataFrame([("LNG", SCENARIO, 2020, "CH4", 1.23456789)], gas)
    luc_rows = spark.createDataFrame([], "fuel string, Policy string, LUC_kgCO2_GJ double")
    df = assemble.lca_ghg(
        co2_frame(spark, [("LNG", 2.0)]), nonco2, co2_frame(spark, [("LNG", 52.1)]), nonco2, luc_rows, m, p
    )
    assert df.columns == ["scenario", "fuel", "GHG", "source", "year", "kgCO2e_GJ"]
    assert collected(df.select("source", "kgCO2e_GJ"), "source") == {
        "Upstream CO2": 2.0,
        "Upstream CH4": 1.23457,
        "Tailpipe CO2": 52.1,
        "Tailpipe CH4": 1.23457,
    }


def test_codes_are_decoded_and_unknown_levels_are_null(spark, m, p):
    df = spark.createDataFrame([("f", SCENARIO, 1), ("f", "h4r9b2n2c2p3", 2)], "fuel string, scenario string, n int")
    out = assemble.decode_scenario(df, m, p)
    assert out.columns[:3] == ["fuel", "scenario", "Hydrogen and Ammonia"] and out.columns[-1] == "n"
    rows = {r.n: tuple(r)[2:8] for r in out.collect()}
    assert rows[1] == ("Default", "Default", "Default", "Default", "Default", "No policy")
    assert rows[2] == ("Blue", None, "Constrained", "Advanced cost", "Constrained", "Net Zero by 2050")


def test_level_defined_twice_takes_its_first_description(spark, p):
    base = Mappings.published()
    m = Mappings(
        base.fuel_techs,
        base.co2_ef,
        base.nonco2_gwp,
        base.fuel_delivery_cost,
        (("p1", "Policy", "first"), ("p1", "Policy", "second")),
    )
    df = spark.createDataFrame([("p1",)], "scenario string")
    assert assemble.decode_scenario(df, m, p.with_(code_cuts=())).first()["Policy"] == "first"


# Reports


def test_bar_totals_and_depth_totals(spark, p):
    ghg = spark.createDataFrame(
        [
            (SCENARIO, "hydrogen", 2050, "Upstream CO2", 1.0),
            (SCENARIO, "hydrogen", 2050, "Upstream CO2", 2.0),
            (SCENARIO, "hydrogen", 2050, "Tailpipe CO2", float("nan")),
            (SCENARIO, "LNG", 2020, "Upstream CO2", 4.0),
            ("h2r1b1n1c1p1", "ammonia", 2050, "Upstream CO2", 5.0),
        ],
        "scenario string, fuel string, year int, source string, kgCO2e_GJ double",
    )
    base = collected(report.base_ghg(ghg, p).select("label", "source", "kgCO2e_GJ"), "label", "source")
    assert base == {("hydrogen 2050", "Upstream CO2"): 3.0, ("LNG 2020", "Upstream CO2"): 4.0}
    assert report.highlighted_ghg(ghg, p).count() == 2
    assert collected(report.final_year_ghg(ghg, p), "fuel", "source") == {("hydrogen", "Upstream CO2"): 3.0}
    energy = ghg.select("scenario", "fuel", "year", F.col("source").alias("Primary_fuel"), F.col("kgCO2e_GJ").alias("IO"))
    assert report.final_year_primary_energy(energy, p).count() == 1
    assert collected(report.contrasted_primary_energy(energy, p).select("fuel", "IO"), "fuel") == {"ammonia": 5.0}
    deep = spark.createDataFrame(
        [
            (SCENARIO, f, 2040, d, v)
            for f, d, v in [("LNG", 4, 1.0), ("LNG", 4, 2.0), ("LNG", 5, None), ("e-methanol", 4, 9.0), (None, 4, 7.0)]
        ],
        "scenario string, fuel string, year int, RD int, kgCO2e_GJ double",
    )
    got = collected(report.depth_totals(deep, p).select("fuel", "RD", "kgCO2e_GJ"), "fuel", "RD")
    assert got == {("LNG", 4): 3.0, ("LNG", 5): None, (None, 4): 7.0}
