"""Parameters of a life-cycle analysis."""

from __future__ import annotations

from dataclasses import dataclass, replace

from wellspring import fixed_values as fv


@dataclass(frozen=True)
class LcaParams:
    """Everything a run may vary, with the published analysis as default."""

    region: str | None = "USA"
    years: tuple[int, ...] = tuple(range(2020, 2051, 5))
    luc_years: tuple[int, ...] = tuple(range(2020, 2051))
    luc_regions: tuple[str, ...] | None = fv.LUC_REGIONS
    depth: int = 10
    digits: int = 5

    # Gases that are read from the emissions fact, and land-use years within two bounds.
    emitted_gases: tuple[str, ...] | None = fv.EMITTED_GASES
    ghgs: tuple[str, ...] = fv.NONCO2_GASES
    freight_sectors: tuple[str, ...] = fv.FREIGHT_SECTORS
    carbon_market: str = fv.CARBON_MARKET
    usd_1975_to_2020: float = fv.USD_1975_TO_2020
    usd_1990_to_2020: float = fv.USD_1990_TO_2020
    carbon_to_co2: float = fv.CARBON_TO_CO2
    luc_base: str = fv.BASE_LUC_LEVEL

    # Report CO2 taken up and released by carbon-based fuels as equal and opposite
    # upstream and tailpipe terms. The size is the fossil fuel's tailpipe factor.
    greet_convention: bool = True
    greet_sector: str = "diesel"
    greet_fossil_fuel: str = "petroleum diesel"

    # Cut positions of a scenario code, and how many characters name the policy.
    code_cuts: tuple[int, ...] = (2, 4, 6, 8, 10)
    policy_width: int = 2

    base_scenario: str = "h1r1b1n1c1p1"
    final_year: int = 2050
    highlighted_fuels: tuple[str, ...] = ("hydrogen", "ammonia")
    contrasted_scenarios: str = "h2|h4"
    sensitivity_year: int = 2040
    sensitivity_depths: tuple[int, ...] = tuple(range(4, 12))
    sensitivity_excluded: tuple[str, ...] = ("bio-methanol", "e-methanol", "liquefied hydrogen")

    def with_(self, **changes) -> LcaParams:
        return replace(self, **changes)
