"""A life-cycle analysis from fact tables to results, with shared steps computed once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.operators import assemble, flows, intensity, luc, prices, report, tailpipe, upstream
from wellspring.params import LcaParams
from wellspring.sources import sinks
from wellspring.sources.mappings import Mappings
from wellspring.sources.project import Project
from wellspring.sources.schemas import RESULTS, check_result
from wellspring.sources.tables import FactTables
from wellspring.sources.workspace import materialize


class LcaPlan:
    """The DataFrames of one analysis. Each is declared on first use.

    Everything is lazy except the edge table inside the upstream expansion, and the primary
    outputs and absorbed flows, which several results share and which are written to the shared
    folder. With ``shared=False`` these two stay lazy, for a plan asked for one result only.
    """

    def __init__(
        self,
        facts: FactTables,
        mappings: Mappings | None = None,
        params: LcaParams | None = None,
        shared: bool = True,
    ):
        self.facts = facts
        self.m = mappings or Mappings.published()
        self.p = params or LcaParams()
        self.shared = shared

    # Flows and coefficients

    @cached_property
    def outputs_tech(self) -> DataFrame:
        return flows.clean_outputs(self.facts.outputs_by_tech, self.p)

    @cached_property
    def outputs(self) -> DataFrame:
        """``outputs_tech``, written once if the plan is shared: nearly every part reads them."""
        return materialize(self.outputs_tech, "outputs") if self.shared else self.outputs_tech

    @cached_property
    def outputs_sector(self) -> DataFrame:
        return flows.sector_totals(self.outputs_tech)

    @cached_property
    def inputs_tech(self) -> DataFrame:
        f = self.facts
        return flows.assemble_inputs(
            f.inputs_by_tech, self.outputs, f.co2_sequestration_by_tech, f.nonco2_by_tech, self.p
        )

    @cached_property
    def inputs_sector(self) -> DataFrame:
        return flows.sector_totals(self.inputs_tech, "input")

    @cached_property
    def nonco2_tech(self) -> DataFrame:
        return flows.nonco2_inputs(self.facts.nonco2_by_tech, self.p)

    @cached_property
    def io_coefs_tech(self) -> DataFrame:
        return flows.io_coefficients(self.inputs_tech, self.outputs_tech, flows.TECH_KEYS)

    @cached_property
    def io_coefs_sector(self) -> DataFrame:
        return flows.io_coefficients(self.inputs_sector, self.outputs_sector, flows.SECTOR_KEYS)

    # Upstream

    @cached_property
    def production(self) -> DataFrame:
        return upstream.fuel_production(self.outputs, self.m)

    def expand(self, by_depth: bool = True) -> DataFrame:
        return upstream.upstream_expand(
            self.outputs, self.inputs_tech, self.m, self.p, by_depth=by_depth
        )

    def converge(self, tolerance: float = 1e-6, most: int = 100, by_depth: bool = False) -> upstream.Converged:
        """The expansion carried on until little is left open, with what is left bounded."""
        return upstream.upstream_converge(
            self.outputs, self.inputs_tech, self.m, self.p, tolerance=tolerance, most=most, by_depth=by_depth
        )

    @cached_property
    def absorbed(self) -> DataFrame:
        absorbed = self.expand(by_depth=False)
        return materialize(absorbed, "absorbed") if self.shared else absorbed

    @cached_property
    def upstream_co2(self) -> DataFrame:
        return intensity.upstream_co2(self.absorbed, self.production, self.m)

    @cached_property
    def primary_energy(self) -> DataFrame:
        return intensity.primary_energy(self.absorbed, self.production, self.m, self.p)

    @cached_property
    def upstream_nonco2(self) -> DataFrame:
        return intensity.upstream_nonco2(self.absorbed, self.production, self.m)

    # Tailpipe, land-use change, prices

    @cached_property
    def tailpipe_co2(self) -> DataFrame:
        return tailpipe.tailpipe_co2(self.outputs, self.m, self.p)

    @cached_property
    def tailpipe_nonco2(self) -> DataFrame:
        return tailpipe.tailpipe_nonco2(self.inputs_tech, self.nonco2_tech, self.m, self.p)

    @cached_property
    def luc_interpolated(self) -> DataFrame:
        return luc.luc_interpolated(self.facts.luc_by_region, self.p)

    @cached_property
    def biofuel_interpolated(self) -> DataFrame:
        return luc.biofuel_interpolated(self.facts.luc_outputs_by_tech, self.m, self.p)

    @cached_property
    def luc_intensity(self) -> DataFrame:
        return luc.luc_intensity(self.luc_interpolated, self.biofuel_interpolated, self.m, self.p)

    @cached_property
    def delivery_costs(self) -> DataFrame:
        return prices.delivery_costs(self.facts.prices_by_sector, self.m, self.p)

    @cached_property
    def co2_penalties(self) -> DataFrame:
        return prices.co2_penalties(self.facts.co2_prices, self.p)

    @cached_property
    def prices(self) -> DataFrame:
        return prices.fuel_prices(
            self.facts.costs_by_tech,
            self.delivery_costs,
            self.co2_penalties,
            self.outputs,
            self.m,
            self.p,
        )

    # Results

    @cached_property
    def ghg(self) -> DataFrame:
        return assemble.lca_ghg(
            self.upstream_co2,
            self.upstream_nonco2,
            self.tailpipe_co2,
            self.tailpipe_nonco2,
            self.luc_intensity,
            self.m,
            self.p,
        )

    def decode(self, df: DataFrame) -> DataFrame:
        return assemble.decode_scenario(df, self.m, self.p)

    def results(self, names: Sequence[str] = tuple(RESULTS)) -> dict[str, DataFrame]:
        """The named ones of the three result tables with decoded scenarios."""
        tables = {
            "fuels_lca_ghg": lambda: self.ghg,
            "fuels_primary_energy": lambda: self.primary_energy,
            "fuels_prices": lambda: self.prices,
        }
        return {name: self.decode(check_result(tables[name](), name)) for name in names}

    def publish(self, folder: str, block: str = "results") -> Project:
        """Write all results and show them together: a reader sees all three or the former ones."""
        project = Project(folder)
        project.deliver(self.facts.spark, self.results(), block, "replace")
        return project

    def save(self, folder: str, format: str = "parquet") -> None:
        """Write the results, as Parquet by scenario or as headed CSV."""
        for name, df in self.results().items():
            path = f"{folder.rstrip('/')}/{name}"
            if format == "csv":
                sinks.save_csv(df, path)
            else:
                sinks.save_parquet(df, path)

    def depth_sensitivity(self) -> DataFrame:
        """Total intensity by recursion depth: scenario, fuel, RD, kgCO2e_GJ.

        One expansion to the greatest depth serves all depths, because the result at a
        depth is what was absorbed up to it. Only the reported year is expanded.
        """
        p = self.p.with_(
            years=(self.p.sensitivity_year,), depth=max(self.p.sensitivity_depths)
        )
        run, by = LcaPlan(self.facts, self.m, p), ("RD",)
        depths = F.array(*[F.lit(int(d)) for d in p.sensitivity_depths])
        reached = F.filter(depths, lambda d: d >= F.col("depth"))
        absorbed = materialize(
            run.expand().withColumn("RD", F.explode(reached)).drop("depth"), "absorbed"
        )
        ghg = assemble.lca_ghg(
            intensity.upstream_co2(absorbed, run.production, run.m, by),
            intensity.upstream_nonco2(absorbed, run.production, run.m, by),
            run.tailpipe_co2.withColumn("RD", F.explode(depths)),
            run.tailpipe_nonco2.withColumn("RD", F.explode(depths)),
            run.luc_intensity,
            run.m,
            p,
            by,
        )
        return report.depth_totals(ghg, p)

    # Narrower runs that give the same rows for the scenarios and years they keep

    def only(
        self,
        *,
        scenario: str | None = None,
        like: str | None = None,
        year: int | None = None,
        shared: bool = True,
    ) -> LcaPlan:
        """The same analysis on some scenarios or one year, pruned before any work is done."""
        facts = self.facts
        if scenario is not None:
            facts = facts.scenario(scenario)
        if like is not None:
            facts = facts.scenarios_like(like)
        p = self.p if year is None else self.p.with_(years=(year,))
        return LcaPlan(facts, self.m, p, shared)

    def report_base_ghg(self) -> DataFrame:
        return report.base_ghg(self.only(scenario=self.p.base_scenario).ghg, self.p)

    def report_h2_nh3_ghg(self) -> DataFrame:
        return report.highlighted_ghg(self.ghg, self.p)

    def report_ghg_final_year(self) -> DataFrame:
        run = self.only(scenario=self.p.base_scenario, year=self.p.final_year)
        return report.final_year_ghg(run.ghg, self.p)

    def report_pe_final_year(self) -> DataFrame:
        run = self.only(
            scenario=self.p.base_scenario, year=self.p.final_year, shared=False
        )
        return report.final_year_primary_energy(run.primary_energy, self.p)

    def report_pe_scenarios(self) -> DataFrame:
        run = self.only(
            like=self.p.contrasted_scenarios, year=self.p.final_year, shared=False
        )
        return report.contrasted_primary_energy(run.primary_energy, self.p)

    def report_prices(self) -> DataFrame:
        return report.price_lines(self.prices)
