"""The registered queries: each operator over the stand-in facts of a data folder.

Values are rounded for comparison only; the operators round where the analysis does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions import catalog, series
from wellspring.functions.exact import exact_sum
from wellspring.functions.numeric import strict_sum
from wellspring.operators import assemble, flows, intensity, luc
from wellspring.params import LcaParams
from wellspring.plans.lca import LcaPlan
from wellspring.plans.update import update
from wellspring.sources import datasource, schemas, sinks
from wellspring.sources.checked import read_checked
from wellspring.sources.extract import carbon_markets, land_use
from wellspring.sources.mappings import Mappings
from wellspring.sources.project import Project
from wellspring.sources.tables import folder_of, read_blocks, read_fact, read_results
from wellspring.sources.workspace import new_folder
from wellspring.standin.config import MAPPINGS, PARAMS, SEGMENTS
from wellspring.standin.tables import FLOWS, LUC, OUTPUTS, PRICES, Only, base, facts, facts_lazily, named, table

Query = Callable[[SparkSession, str], DataFrame]
OUTPUTS_TITLE = "outputs by tech"


def _plan(spark: SparkSession, sf_dir: str, *need: str) -> LcaPlan:
    """Facts written once, for results that read them several times."""
    return LcaPlan(facts(spark, sf_dir, need), MAPPINGS, PARAMS)


def _single(spark: SparkSession, sf_dir: str, *need: str) -> LcaPlan:
    """Facts written once, for one result of the upstream expansion."""
    return LcaPlan(facts(spark, sf_dir, need), MAPPINGS, PARAMS, shared=False)


def _narrow(spark: SparkSession, sf_dir: str, only: Only) -> LcaPlan:
    """Flows of some scenarios and years, filtered in the scans of the star schema."""
    return LcaPlan(facts(spark, sf_dir, [FLOWS], only), MAPPINGS, PARAMS, shared=False)


def _lazy(spark: SparkSession, sf_dir: str, *need: str) -> LcaPlan:
    return LcaPlan(facts_lazily(spark, sf_dir, need), MAPPINGS, PARAMS, shared=False)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def outputs_tech(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, OUTPUTS).outputs_tech, 8, "value")


def outputs_sector(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, OUTPUTS).outputs_sector, 8, "value")


def inputs_tech(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS).inputs_tech, 10, "value")


def inputs_sector(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS).inputs_sector, 10, "value")


def io_coefs_tech(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS).io_coefs_tech, 8, "value")


def io_coefs_sector(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS).io_coefs_sector, 8, "value")


def upstream_absorbed(spark, sf_dir):
    """The technology step keeps the decimals of the data; later steps are products."""
    value = F.when(F.col("depth") == 0, F.round("value", 10)).otherwise(F.round("value", 8))
    return _plan(spark, sf_dir, FLOWS).expand().withColumn("value", value)


def primary_inputs(spark, sf_dir):
    plan = _plan(spark, sf_dir, FLOWS)
    return _rounded(intensity.primary_inputs(plan.expand(by_depth=False)), 7, "EJ_in")


def nonco2_emissions(spark, sf_dir):
    plan = _plan(spark, sf_dir, FLOWS)
    return _rounded(intensity.nonco2_emissions(plan.expand(by_depth=False)), 7, "TG")


def fuel_production(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, OUTPUTS).production, 8, "EJ_out")


def biofuel_interpolated(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, LUC).biofuel_interpolated, 9, "Fuel_EJ")


def upstream_co2(spark, sf_dir):
    return _rounded(_single(spark, sf_dir, FLOWS).upstream_co2, 7, "kgCO2_GJ")


def primary_energy(spark, sf_dir):
    plan = _single(spark, sf_dir, FLOWS)
    return plan.decode(plan.primary_energy)


def upstream_nonco2(spark, sf_dir):
    return _rounded(_single(spark, sf_dir, FLOWS).upstream_nonco2, 7, "kgCO2e_GJ")


def tailpipe_co2(spark, sf_dir):
    return _lazy(spark, sf_dir, OUTPUTS).tailpipe_co2


def tailpipe_nonco2(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS).tailpipe_nonco2, 7, "kgCO2e_GJ")


def delivery_costs(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, PRICES).delivery_costs, 8, "delivery_cost")


def co2_penalties(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, PRICES).co2_penalties, 8, "USD_kgCO2")


def _prices(spark, sf_dir):
    return LcaPlan(facts(spark, sf_dir, [PRICES]), MAPPINGS, PARAMS, shared=False)


def fuel_prices(spark, sf_dir):
    plan = _prices(spark, sf_dir)
    return plan.decode(plan.prices)


def luc_interpolated(spark, sf_dir):
    return _rounded(_lazy(spark, sf_dir, LUC).luc_interpolated, 9, "luc")


def luc_intensity(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, LUC).luc_intensity, 7, "LUC_kgCO2_GJ")


def greet_convention(spark, sf_dir):
    """Upstream and tailpipe CO2 after the shift, before land-use change."""
    plan = _single(spark, sf_dir, FLOWS)
    up, tail = assemble.greet_convention(
        assemble.tag_co2(plan.upstream_co2, "Upstream"),
        assemble.tag_co2(plan.tailpipe_co2, "Tailpipe"),
        plan.m,
        plan.p,
    )
    columns = ["fuel", "source", "scenario", "year", "kgCO2e_GJ"]
    return _rounded(up.select(columns).unionByName(tail.select(columns)), 5, "kgCO2e_GJ")


def lca_ghg(spark, sf_dir):
    plan = _plan(spark, sf_dir, FLOWS, LUC)
    return plan.decode(plan.ghg)


def decode_scenario(spark, sf_dir):
    plan = _lazy(spark, sf_dir, OUTPUTS)
    return _rounded(plan.decode(plan.outputs_sector), 8, "value")


def depth_sensitivity(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS, LUC).depth_sensitivity(), 6, "kgCO2e_GJ")


def report_base_ghg(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS, LUC).report_base_ghg(), 5, "kgCO2e_GJ")


def report_h2_nh3_ghg(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS, LUC).report_h2_nh3_ghg(), 5, "kgCO2e_GJ")


def report_ghg_final_year(spark, sf_dir):
    return _rounded(_plan(spark, sf_dir, FLOWS, LUC).report_ghg_final_year(), 5, "kgCO2e_GJ")


def report_pe_final_year(spark, sf_dir):
    only = Only(f"^{PARAMS.base_scenario}$", (PARAMS.final_year,))
    return _rounded(_narrow(spark, sf_dir, only).report_pe_final_year(), 5, "IO")


def report_pe_scenarios(spark, sf_dir):
    only = Only(PARAMS.contrasted_scenarios, (PARAMS.final_year,))
    return _rounded(_narrow(spark, sf_dir, only).report_pe_scenarios(), 5, "IO")


def report_prices(spark, sf_dir):
    return _prices(spark, sf_dir).report_prices()


def markets(spark, sf_dir):
    return _rounded(
        carbon_markets(_lazy(spark, sf_dir, PRICES).facts.co2_prices).select(
            "scenario", "market", "year", "value"
        ),
        8,
        "value",
    )


def scenario_block(spark, sf_dir):
    """Outputs of the scenarios whose name matches a pattern."""
    plan = LcaPlan(facts_lazily(spark, sf_dir, [OUTPUTS], Only("p2$")), MAPPINGS, PARAMS).only(like="p2$")
    return _rounded(plan.outputs_tech, 8, "value")


def _by_region(df, spark, sf_dir):
    """A stand-in fact whose region is that of the consuming nation."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    of = nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("sector"), "r_name")
    return df.join(of, "sector").withColumn("region", F.col("r_name")).drop("r_name")


def region_selected(spark, sf_dir):
    """Outputs of one region among five."""
    rows = _by_region(facts_lazily(spark, sf_dir, [OUTPUTS]).outputs_by_tech, spark, sf_dir)
    return _rounded(flows.clean_outputs(rows, PARAMS.with_(region="ASIA")), 8, "value")


def luc_regions_selected(spark, sf_dir):
    """Land-use change carbon of two regions among five."""
    rows = facts_lazily(spark, sf_dir, [LUC]).luc_by_region
    return _rounded(luc.luc_interpolated(rows, PARAMS.with_(luc_regions=("ASIA", "EUROPE"))), 9, "luc")


def gases_selected(spark, sf_dir):
    """Inputs of two of the three gases."""
    p = PARAMS.with_(emitted_gases=("CH4", "N2O_AGR"))
    return _rounded(flows.nonco2_inputs(facts(spark, sf_dir, [FLOWS]).nonco2_by_tech, p), 10, "value")


def prices_without_agriculture(spark, sf_dir):
    """Prices where the sector of two technologies is one of agricultural supply."""
    kind = F.when(F.col("sector") == "N2", "AgSupplySector").otherwise("supplysector")
    found = facts(spark, sf_dir, [PRICES])
    costs = found.costs_by_tech.withColumn("sector_type", kind)
    return LcaPlan(replace(found, costs_by_tech=costs), MAPPINGS, PARAMS).prices


def land_leaves_summed(spark, sf_dir):
    """Land-use rows by leaf (a technology stands in), within the year bounds, by region."""
    rows = _by_region(facts_lazily(spark, sf_dir, [LUC]).luc_outputs_by_tech, spark, sf_dir)
    leaves = rows.select("scenario", "region", (F.col("year") + 15).alias("year"), F.col("technology").alias("LandLeaf"), "value")
    return _rounded(land_use(leaves), 8, "value")


def project_blocks(spark, sf_dir):
    """Outputs written in two blocks of scenarios and read by their query title."""
    read = read_fact(spark, [_blocks(spark, sf_dir)], OUTPUTS_TITLE)
    return _rounded(flows.clean_outputs(read, PARAMS), 8, "value")


def _blocks(spark, sf_dir):
    """A folder with the outputs in two blocks of scenarios, by one pass over the star schema."""
    folder = new_folder(spark, "blocks")
    rows = facts_lazily(spark, sf_dir, [OUTPUTS]).outputs_by_tech
    sinks.save_blocks(rows, {policy: f"{policy}$" for policy in ("p1", "p2")}, folder, OUTPUTS_TITLE)
    return folder


def block_scenario_picked(spark, sf_dir):
    """The outputs of one scenario of one block, by its files alone."""
    read = read_blocks(spark, _blocks(spark, sf_dir), OUTPUTS_TITLE, ["p2"], ["m1p2"])
    return _rounded(flows.clean_outputs(read, PARAMS), 8, "value")


def scenario_block_saved(spark, sf_dir):
    """The scenarios whose name matches, saved as a block of headed CSV and read again."""
    title, folder = "outputs by tech", new_folder(spark, "block")
    rows = facts_lazily(spark, sf_dir, [OUTPUTS]).outputs_by_tech
    sinks.save_csv(rows.where(F.col("scenario").rlike("p2$")), f"{folder}/{folder_of(title)}")
    return _rounded(flows.clean_outputs(read_fact(spark, [folder], title, "csv"), PARAMS), 8, "value")


def results_reread(spark, sf_dir):
    """Decoded prices, saved and read again for reporting."""
    plan, folder = _prices(spark, sf_dir), new_folder(spark, "results")
    sinks.save_parquet(plan.decode(plan.prices), f"{folder}/fuels_prices")
    return read_results(spark, folder, "fuels_prices")


def mappings_csv(spark, sf_dir):
    """Tailpipe CO2 by mapping tables that were read from headed CSV files."""
    folder = new_folder(spark, "mappings")
    for name in schemas.MAPPINGS:
        sinks.save_csv(MAPPINGS.frame(spark, name), f"{folder}/{name}.csv")
    read = Mappings.read_csv(spark, folder)
    return LcaPlan(facts_lazily(spark, sf_dir, [OUTPUTS]), read, PARAMS).tailpipe_co2


def lca_ghg_standard(spark, sf_dir):
    """All sources without the convention for carbon-based fuels."""
    return LcaPlan(facts(spark, sf_dir, [FLOWS, LUC]), MAPPINGS, PARAMS.with_(greet_convention=False)).ghg


def outputs_sector_exact(spark, sf_dir):
    """Output by sector, summed exactly from single order lines: compared to the last bit."""
    rows = base(spark, sf_dir).where(F.col("l_returnflag") != "R")
    total = exact_sum(F.col("l_extendedprice")) / F.lit(1e6)
    return named(rows.groupBy("segment", "policy", "consumer", "year").agg(total.alias("value"))).select(
        "scenario", "sector", "year", "value"
    )


def land_use_by_region(spark, sf_dir):
    """Land-use rows that are by region already, within the year bounds."""
    rows = facts_lazily(spark, sf_dir, [LUC]).luc_by_region.withColumn("year", F.col("year") + 15)
    return _rounded(land_use(rows).select("scenario", "region", "year", "value"), 8, "value")


def _tied(spark, sf_dir):
    """Two values for each land-use run and year: its least and greatest technology's."""
    rows = facts_lazily(spark, sf_dir, [LUC]).luc_outputs_by_tech
    ends = rows.groupBy("scenario", "year").agg(F.array(F.min("value"), F.max("value")).alias("values"))
    return ends.select("scenario", "year", F.explode("values").alias("value"))


def ties_interpolated(spark, sf_dir):
    """A yearly series whose known years have two values each, which are averaged."""
    grid = series.complete_years(_tied(spark, sf_dir), ["scenario"], "value", PARAMS.luc_years)
    return _rounded(series.interpolate_linear(grid, ["scenario"], "value"), 10, "value")


def ties_interpolated_sql(spark, sf_dir):
    """The same by the function for SQL."""
    catalog.register(spark, MAPPINGS, PARAMS)
    _tied(spark, sf_dir).createOrReplaceTempView("tied_values")
    years = f"sequence({min(PARAMS.luc_years)}, {max(PARAMS.luc_years)})"
    return spark.sql(f"""
        SELECT scenario, year, round(interpolated(points, year), 10) AS value
        FROM (SELECT scenario, collect_list(struct(year, value)) AS points FROM tied_values GROUP BY scenario)
        LATERAL VIEW explode({years}) AS year""")


def _six_pieces(spark, sf_dir):
    """Customers by a scenario code of six pieces."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    digits = {"h": nation % 4, "r": nation % 3, "b": nation % 2, "n": key % 2, "c": F.floor(key / 2) % 2, "p": segment % 3}
    code = F.concat(*[x for k, d in digits.items() for x in (F.lit(k), (d + 1).cast("int").cast("string"))])
    return table(spark, sf_dir, "customer").groupBy(code.alias("scenario")).agg(F.count(F.lit(1)).alias("customers"))


def six_pieces_decoded(spark, sf_dir):
    """Scenario codes of six pieces, spelled out by the published definitions."""
    return assemble.decode_scenario(_six_pieces(spark, sf_dir), Mappings.published(), LcaParams())


def six_pieces_decoded_sql(spark, sf_dir):
    """The same by the table function for SQL."""
    catalog.register(spark, Mappings.published(), LcaParams())
    _six_pieces(spark, sf_dir).createOrReplaceTempView("customers_by_code")
    return spark.sql("SELECT c.scenario, d.*, c.customers FROM customers_by_code c, LATERAL decode_scenario(c.scenario) d")


def broken_rows_set_aside(spark, sf_dir):
    """Outputs from headed CSV in which some numbers do not parse: both kinds of rows."""
    folder = new_folder(spark, "broken")
    rows = facts_lazily(spark, sf_dir, [OUTPUTS]).outputs_by_tech
    value = F.when(F.col("technology") == "SMALL", F.lit("n.d.")).otherwise(F.col("value").cast("string"))
    year = F.when(F.col("technology") == "LARGE", F.concat(F.lit("Y"), F.col("year"))).otherwise(F.col("year").cast("string"))
    sinks.save_csv(rows.withColumns({"value": value, "year": year}), f"{folder}/{folder_of(OUTPUTS_TITLE)}")
    read = read_checked(spark, [folder], OUTPUTS_TITLE)
    keys = ["scenario", "sector", "technology", "output"]
    good = read.good.select(*keys, "year", F.round("value", 8).alias("value"), F.lit(None).cast("string").alias("reason"))
    raw = [F.get_json_object("record", f"$.{k}").alias(k) for k in keys]
    bad = read.quarantine.select(*raw, F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("value"), "reason")
    return good.unionByName(bad)


def upstream_converged(spark, sf_dir):
    """How deep each fuel has to be expanded, what is left open there, and its bound."""
    found = _plan(spark, sf_dir, FLOWS).converge(tolerance=1e-4, most=40)
    primary = found.absorbed.where(F.col("kind") == "primary")
    run = ["fuel", "scenario", "year"]
    totals = primary.groupBy(*run).agg(strict_sum(F.col("value")).alias("absorbed"))
    out = found.runs.join(totals, run, "left").select(*run, "depth", "first", "open", "bound", "absorbed")
    return _rounded(_rounded(_rounded(out, 10, "first"), 9, "open", "bound"), 7, "absorbed")


def _delivered(spark, sf_dir, name):
    """A project with the outputs in two blocks of scenarios; also the outputs themselves."""
    rows = facts(spark, sf_dir, [OUTPUTS]).outputs_by_tech
    project = Project(new_folder(spark, name))
    for policy in ("p1", "p2"):
        block = rows.where(F.col("scenario").rlike(f"{policy}$"))
        project.deliver(spark, {OUTPUTS_TITLE: block}, policy)
    return project, rows


def project_scenario(spark, sf_dir):
    """The outputs of one scenario, by the project data source."""
    project, _ = _delivered(spark, sf_dir, "project")
    datasource.register(spark)
    read = spark.read.format("lca_project").option("title", OUTPUTS_TITLE)
    return _rounded(flows.clean_outputs(read.option("scenario", "m1p2").load(project.root), PARAMS), 8, "value")


def block_redelivered(spark, sf_dir):
    """Outputs after two scenarios of a block came again, one came in another block."""
    project, rows = _delivered(spark, sf_dir, "redelivered")
    twice = rows.where(F.col("scenario").isin("m1p2", "m2p2")).withColumn("value", F.col("value") * 2)
    project.deliver(spark, {OUTPUTS_TITLE: twice}, "p2")
    moved = rows.where(F.col("scenario") == "m3p1").withColumn("value", F.col("value") * 3)
    project.deliver(spark, {OUTPUTS_TITLE: moved}, "p2", conflict="replace")
    return _rounded(flows.clean_outputs(project.read(spark, OUTPUTS_TITLE), PARAMS), 8, "value")


def results_published(spark, sf_dir):
    """All three results, published together and read again."""
    plan = LcaPlan(facts(spark, sf_dir, [FLOWS, PRICES, LUC]), MAPPINGS, PARAMS)
    project = plan.publish(new_folder(spark, "published"))
    parts = {
        "fuels_lca_ghg": ("fuel", F.concat_ws(" ", "GHG", "source"), "kgCO2e_GJ"),
        "fuels_primary_energy": ("fuel", F.col("Primary_fuel"), "IO"),
        "fuels_prices": ("reporting_fuel", F.lit(None).cast("string"), "price_USDperGJ"),
    }
    reread = [
        project.read(spark, name).select(
            F.lit(name).alias("result"), "scenario", F.col(fuel).alias("fuel"), "year", kind.alias("kind"),
            F.col("Market segment").alias("segment"), "Policy", F.col(value).alias("value"),
        )
        for name, (fuel, kind, value) in parts.items()
    ]
    return reduce(DataFrame.unionByName, reread)


def prices_updated(spark, sf_dir):
    """Prices of all scenarios after the costs of one have changed; only that one is computed."""
    found = facts(spark, sf_dir, [PRICES])
    project = Project(new_folder(spark, "updated"))
    update(LcaPlan(found, MAPPINGS, PARAMS), project, ["fuels_prices"])
    dearer = F.when(F.col("scenario") == "m2p1", F.col("value") * 2).otherwise(F.col("value"))
    later = replace(found, costs_by_tech=found.costs_by_tech.withColumn("value", dearer))
    update(LcaPlan(later, MAPPINGS, PARAMS), project, ["fuels_prices"])
    return project.read(spark, "fuels_prices")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        outputs_tech,
        outputs_sector,
        inputs_tech,
        inputs_sector,
        io_coefs_tech,
        io_coefs_sector,
        upstream_absorbed,
        fuel_production,
        primary_inputs,
        nonco2_emissions,
        upstream_co2,
        primary_energy,
        upstream_nonco2,
        tailpipe_co2,
        tailpipe_nonco2,
        delivery_costs,
        co2_penalties,
        fuel_prices,
        luc_interpolated,
        biofuel_interpolated,
        luc_intensity,
        greet_convention,
        lca_ghg,
        decode_scenario,
        depth_sensitivity,
        report_base_ghg,
        report_h2_nh3_ghg,
        report_ghg_final_year,
        report_pe_final_year,
        report_pe_scenarios,
        report_prices,
        region_selected,
        luc_regions_selected,
        gases_selected,
        prices_without_agriculture,
        land_leaves_summed,
        project_blocks,
        block_scenario_picked,
        scenario_block_saved,
        results_reread,
        mappings_csv,
        lca_ghg_standard,
        outputs_sector_exact,
        land_use_by_region,
        ties_interpolated,
        ties_interpolated_sql,
        six_pieces_decoded,
        six_pieces_decoded_sql,
        broken_rows_set_aside,
        upstream_converged,
        project_scenario,
        block_redelivered,
        results_published,
        prices_updated,
    )
} | {"carbon_markets": markets, "scenario_block": scenario_block}
