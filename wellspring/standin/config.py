"""Mappings and parameters of the stand-in analysis."""

from __future__ import annotations

from wellspring import fixed_values as fv
from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings

YEARS = tuple(range(1995, 2002))
# Land-use runs lie on a grid of twice as many steps; between two known steps lies a gap.
LUC_YEARS = tuple(range(YEARS[0], YEARS[0] + 2 * len(YEARS) - 1))


def luc_year(year):
    """The step of the land-use grid on which a year of orders lies."""
    return 2 * year - YEARS[0]


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
URGENT = ("1-URGENT", "2-HIGH")
LUC_LEVELS = {"F": "base", "O": "FT", "P": "RD"}

MAPPINGS = Mappings(
    fuel_techs=(
        ("N2", "S2", "ECONOMY", "f1", "A", 0.0, "FT"),
        ("N2", "S2", "SMALL", "f2", "A", 0.0, "FT"),
        ("N2", "S2", "MEDIUM", "f3", "B", 71.867, None),
        ("N7", "S2", "LARGE", "f4", "C", 0.0, "RD"),
        ("N12", "S2", "STANDARD", "f5", "D", 52.1, None),
        ("N3", "S3", "hydro", "f6", "D2", 0.0, None),
    ),
    co2_ef=(
        ("N4", "Coal", 100.1),
        ("N9", "Natural Gas", 52.067),
        ("N14", "Oil", 71.867),
        ("N19", "Wind", 0.0),
        ("N24", "Wind", 0.0),
        ("hydropower", "Hydropower", 0.0),
        ("carbon-storage", None, -3.667),
    ),
    nonco2_gwp=fv.GWP,
    fuel_delivery_cost=(("N2", "delivered N2"),),
    scenario_definitions=(
        ("m1", "Market segment", "Automobile"),
        ("m2", "Market segment", "Building"),
        ("m3", "Market segment", "Furniture"),
        ("m4", "Market segment", "Household"),
        ("m5", "Market segment", "Machinery"),
        ("p1", "Policy", "Normal priority"),
        ("p2", "Policy", "High priority"),
    ),
)

PARAMS = LcaParams(
    years=YEARS,
    luc_years=LUC_YEARS,
    luc_regions=None,
    freight_sectors=("N20", "N21", "N22"),
    greet_sector="N2",
    greet_fossil_fuel="f3",
    code_cuts=(2,),
    base_scenario="m1p1",
    final_year=2001,
    highlighted_fuels=("C", "D"),
    contrasted_scenarios="m2|m4",
    sensitivity_year=2000,
    sensitivity_excluded=("D2",),
)
