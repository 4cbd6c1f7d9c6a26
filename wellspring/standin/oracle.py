"""The stand-in analysis as plain SQL, written independently of the DataFrame operators.

Each entry of ``CTES`` is one named subquery; ``statement`` prefixes a query with the
subqueries it reads, directly or through others.
"""

from __future__ import annotations

import re

from wellspring.sources.mappings import Mappings
from wellspring.standin.config import (
    LUC_LEVELS,
    MAPPINGS,
    PARAMS,
    SEGMENTS,
    URGENT,
)

P = PARAMS
ABSORBING = [*MAPPINGS.primary_commodities, *P.ghgs]
MAX_DEPTH = max(P.depth, *P.sensitivity_depths)
MOST_STEPS, TOLERANCE = 40, 1e-4


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return f"'{value}'" if isinstance(value, str) else repr(value)


def listed(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def values(table: str, columns: str) -> str:
    rows = ", ".join(listed(r) for r in getattr(MAPPINGS, table))
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


def strict(expr: str) -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN sum({expr}) END"


def rounded(expr: str, digits: int) -> str:
    """Rounded, with one form of NaN."""
    return f"CASE WHEN isnan({expr}) THEN 'nan'::DOUBLE ELSE round({expr}, {digits}) END"


def missing(expr: str) -> str:
    return f"({expr} IS NULL OR isnan({expr}))"


YEARS = listed(P.years)
TECH = "scenario, sector, subsector, technology, year"
LEVELS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LUC_LEVELS.items())

CTES: dict[str, str] = {
    "fuel_techs": values(
        "fuel_techs", "sector, subsector, technology, fuel, reporting_fuel, kgCO2_GJ, luc_fuel"
    ),
    "co2_ef": values("co2_ef", "sector, Primary_fuel, CO2_kgGJ"),
    "gwp": values("nonco2_gwp", "GHG, GWP"),
    "delivery": values("fuel_delivery_cost", "sector, delivery_cost"),
    "definitions": values("scenario_definitions", "string, variable_name, description"),
    # Star schema
    "base": f"""
        SELECT 'm' || list_position({list(SEGMENTS)}, c_mktsegment) || 'p'
                 || CASE WHEN o_orderpriority IN {listed(URGENT)} THEN 2 ELSE 1 END AS scenario,
               CASE WHEN o_orderpriority IN {listed(URGENT)} THEN 2 ELSE 1 END AS policy,
               'biofuel_' || CASE o_orderstatus {LEVELS} END || '_p'
                 || CASE WHEN o_orderpriority IN {listed(URGENT)} THEN 2 ELSE 1 END AS luc_run,
               CAST(year(o_orderdate) AS INTEGER) AS year,
               'N' || c_nationkey AS sector,
               'S' || (c_nationkey % 5) AS subsector,
               CASE WHEN p_type = 'PROMO' THEN 'hydro' ELSE p_type END AS technology,
               CASE s_nationkey WHEN 0 THEN 'water_td' WHEN 1 THEN 'oil-credits'
                 WHEN 5 THEN 'delivered N2' ELSE 'N' || s_nationkey END AS input,
               CASE WHEN l_returnflag = 'R' THEN 'byproduct' ELSE 'N' || c_nationkey END AS output,
               r_name, l_returnflag, l_extendedprice, l_discount, l_tax, l_quantity, p_retailprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey
        JOIN part ON l_partkey = p_partkey
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    # Facts
    "outputs_tech": f"""
        SELECT {TECH}, sum(l_extendedprice) / 1e6 AS value FROM base
        WHERE output = sector AND year IN {YEARS} GROUP BY ALL""",
    "nonco2_tech": f"""
        SELECT {TECH}, replace(ghg, '_AGR', '') AS input, value FROM (
            SELECT {TECH}, CASE l_returnflag WHEN 'A' THEN 'CH4' WHEN 'N' THEN 'N2O_AGR'
                     WHEN 'R' THEN 'H2' END AS ghg, sum(l_quantity) / 1e4 AS value
            FROM base WHERE year IN {YEARS} GROUP BY ALL)""",
    "inputs_tech": f"""
        SELECT {TECH}, input, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS value FROM base
        WHERE l_returnflag <> 'R' AND input NOT LIKE '%water%' AND input <> 'oil-credits'
          AND year IN {YEARS} GROUP BY ALL
        UNION ALL
        SELECT {TECH}, 'hydropower', value FROM outputs_tech WHERE technology = 'hydro'
        UNION ALL
        SELECT {TECH}, 'carbon-storage', sum(l_tax * l_extendedprice) / 1e6 FROM base
        WHERE l_tax >= 0.08 AND l_returnflag <> 'R' AND year IN {YEARS}
        GROUP BY {TECH}
        UNION ALL
        SELECT {TECH}, input, value FROM nonco2_tech""",
    "prices_by_sector": """
        WITH p AS (SELECT scenario, sector, year,
                          avg(l_extendedprice / l_quantity) / 1e3 AS value
                   FROM base GROUP BY ALL)
        SELECT * FROM p UNION ALL
        SELECT scenario, 'delivered N2', year, value * 1.1 FROM p WHERE sector = 'N2'""",
    "costs_by_tech": f"""
        SELECT {TECH}, sum(p_retailprice * l_extendedprice) / sum(l_extendedprice) / 1e3 AS value
        FROM base GROUP BY ALL""",
    "co2_prices": """
        SELECT scenario, market, year, value FROM (
            SELECT scenario, year, avg(l_extendedprice) / 1e3 AS value
            FROM base GROUP BY ALL)
        CROSS JOIN (VALUES ('USACO2'), ('USACO2_LTG')) AS m(market)""",
    # Coefficients
    "outputs_sector": f"""
        SELECT scenario, sector, year, {strict("value")} AS value
        FROM outputs_tech GROUP BY scenario, sector, year""",
    "inputs_sector": f"""
        SELECT scenario, sector, input, year, {strict("value")} AS value
        FROM inputs_tech GROUP BY scenario, sector, input, year""",
    "coefs_tech": f"""
        SELECT {TECH}, input, i.value / o.value AS value
        FROM inputs_tech i LEFT JOIN outputs_tech o USING ({TECH})""",
    "coefs_sector": """
        SELECT scenario, sector, year, input, i.value / o.value AS value
        FROM inputs_sector i LEFT JOIN outputs_sector o USING (scenario, sector, year)""",
    # Upstream expansion, one subquery per step
    "production": """
        SELECT fuel, scenario, year, value AS EJ_out
        FROM outputs_tech JOIN fuel_techs USING (sector, subsector, technology)""",
    "step0": f"""
        SELECT fuel, scenario, year, input AS commodity, {strict("o.value * c.value")} AS value
        FROM outputs_tech o JOIN fuel_techs USING (sector, subsector, technology)
        JOIN coefs_tech c USING ({TECH}) GROUP BY fuel, scenario, year, input""",
}
for _step in range(1, MAX_DEPTH + 1):
    CTES[f"step{_step}"] = f"""
        SELECT s.fuel, scenario, year, input AS commodity, {strict("s.value * c.value")} AS value
        FROM (SELECT *, commodity AS sector FROM step{_step - 1}
              WHERE commodity NOT IN {listed(ABSORBING)}) s
        JOIN coefs_sector c USING (scenario, sector, year) GROUP BY fuel, scenario, year, input"""


def absorbed_up_to(depth: int) -> str:
    steps = " UNION ALL ".join(
        f"SELECT *, {d} AS depth FROM step{d}" for d in range(depth + 1)
    )
    return f"""
        SELECT fuel, scenario, year, commodity,
               CASE WHEN commodity IN {listed(P.ghgs)} THEN 'ghg' ELSE 'primary' END AS kind,
               CAST(depth AS INTEGER) AS depth, value
        FROM ({steps}) WHERE commodity IN {listed(ABSORBING)}"""


def intensities(prefix: str, absorbed: str, by: str = "") -> dict[str, str]:
    """Reporting-fuel intensities over a table of absorbed flows, per extra column ``by``."""
    keys = "fuel, scenario, year" + by
    group = "reporting_fuel, scenario, year" + by
    return {
        f"{prefix}primary_in": f"""
            SELECT {keys}, commodity AS sector, {strict("value")} AS EJ_in
            FROM {absorbed} WHERE kind = 'primary' GROUP BY {keys}, commodity""",
        f"{prefix}upstream_co2": f"""
            SELECT p.reporting_fuel AS fuel, scenario, year{by},
                   MtCO2 / EJ_out - kgCO2_GJ AS kgCO2_GJ
            FROM (SELECT {group}, {strict("MtCO2")} AS MtCO2, {strict("EJ_out")} AS EJ_out
                  FROM (SELECT {keys}, {strict("EJ_in * CO2_kgGJ")} AS MtCO2
                        FROM {prefix}primary_in LEFT JOIN co2_ef USING (sector) GROUP BY {keys})
                  LEFT JOIN production USING (fuel, scenario, year)
                  LEFT JOIN (SELECT fuel, reporting_fuel FROM fuel_techs) USING (fuel)
                  GROUP BY {group}) p
            LEFT JOIN (SELECT DISTINCT reporting_fuel, kgCO2_GJ FROM fuel_techs)
              USING (reporting_fuel)""",
        f"{prefix}primary_energy": f"""
            SELECT reporting_fuel AS fuel, scenario, year{by}, Primary_fuel,
                   {strict("EJ_in")} / {strict("EJ_out")} AS IO
            FROM (SELECT {keys}, Primary_fuel, {strict("EJ_in")} AS EJ_in
                  FROM {prefix}primary_in JOIN co2_ef USING (sector)
                  WHERE Primary_fuel IS NOT NULL GROUP BY {keys}, Primary_fuel)
            LEFT JOIN production USING (fuel, scenario, year)
            LEFT JOIN (SELECT fuel, reporting_fuel FROM fuel_techs) USING (fuel)
            GROUP BY {group}, Primary_fuel""",
        f"{prefix}upstream_nonco2": f"""
            SELECT reporting_fuel AS fuel, scenario, year{by}, GHG,
                   {strict("TG * GWP")} / {strict("EJ_out")} AS kgCO2e_GJ
            FROM (SELECT {keys}, commodity AS GHG, {strict("value")} AS TG
                  FROM {absorbed} WHERE kind = 'ghg' GROUP BY {keys}, commodity)
            LEFT JOIN gwp USING (GHG)
            LEFT JOIN production USING (fuel, scenario, year)
            LEFT JOIN (SELECT fuel, reporting_fuel FROM fuel_techs) USING (fuel)
            GROUP BY {group}, GHG""",
    }


def all_sources(prefix: str, by: str = "", extra: str = "", convention: bool = True) -> str:
    """The four emission sources with the CO2 convention, land-use change and rounding."""
    shifted = listed(
        dict.fromkeys(
            r["reporting_fuel"]
            for r in MAPPINGS.records("fuel_techs")
            if r["sector"] == P.greet_sector and r["kgCO2_GJ"] == 0
        )
    )
    size = next(
        r["kgCO2_GJ"] for r in MAPPINGS.records("fuel_techs") if r["fuel"] == P.greet_fossil_fuel
    )
    size = size if convention else 0.0
    value = rounded("kgCO2e_GJ", P.digits)
    return f"""
        SELECT scenario, fuel, GHG, source, year{by}, {value} AS kgCO2e_GJ FROM (
            SELECT u.scenario, u.fuel, 'CO2' AS GHG, 'Upstream CO2' AS source, u.year{by},
                   kgCO2_GJ - CASE WHEN u.fuel IN {shifted} THEN {size} ELSE 0 END
                     + CASE WHEN {missing("LUC_kgCO2_GJ")} THEN 0 ELSE LUC_kgCO2_GJ END AS kgCO2e_GJ
            FROM {prefix}upstream_co2 u LEFT JOIN luc_intensity l
              ON u.fuel = l.fuel AND right(u.scenario, 2) = l.Policy
            UNION ALL
            SELECT scenario, fuel, GHG, 'Upstream ' || GHG, year{by}, kgCO2e_GJ
            FROM {prefix}upstream_nonco2
            UNION ALL
            SELECT scenario, fuel, 'CO2', 'Tailpipe CO2', year{by},
                   kgCO2_GJ + CASE WHEN fuel IN {shifted} THEN {size} ELSE 0 END
            FROM tailpipe_co2 {extra}
            UNION ALL
            SELECT scenario, fuel, GHG, 'Tailpipe ' || GHG, year{by}, kgCO2e_GJ
            FROM tailpipe_nonco2 {extra})"""


def interpolated(known: str, keys: str, value: str) -> str:
    """Every grid year between the nearest known years at or around it."""
    first, last = min(P.luc_years), max(P.luc_years)
    return f"""
        SELECT {keys}, b.year,
               CASE WHEN x0 = x1 THEN k0.{value}
                    ELSE k0.{value} + (k1.{value} - k0.{value}) * (b.year - x0) / (x1 - x0)
               END AS {value}
        FROM (SELECT {keys}, g.year,
                     max(k.year) FILTER (WHERE k.year <= g.year) AS x0,
                     min(k.year) FILTER (WHERE k.year >= g.year) AS x1
              FROM (SELECT DISTINCT {keys}, CAST(y AS INTEGER) AS year
                    FROM {known} CROSS JOIN range({first}, {last + 1}) AS r(y)) g
              JOIN {known} k USING ({keys}) GROUP BY ALL) b
        LEFT JOIN (SELECT {keys}, year AS x0, {value} FROM {known}) k0 USING ({keys}, x0)
        LEFT JOIN (SELECT {keys}, year AS x1, {value} FROM {known}) k1 USING ({keys}, x1)"""


DEPTHS = ", ".join(f"({d})" for d in P.sensitivity_depths)
CTES |= {
    "absorbed": absorbed_up_to(P.depth),
    "absorbed_rd": f"""
        SELECT a.*, RD FROM ({absorbed_up_to(max(P.sensitivity_depths))}) a
        JOIN (VALUES {DEPTHS}) AS d(RD) ON a.depth <= RD
        WHERE year = {P.sensitivity_year}""",
    **intensities("", "absorbed"),
    **intensities("rd_", "absorbed_rd", ", RD"),
    "tailpipe_co2": f"""
        SELECT reporting_fuel AS fuel, scenario, y AS year, kgCO2_GJ
        FROM (SELECT DISTINCT reporting_fuel, kgCO2_GJ FROM fuel_techs)
        CROSS JOIN (SELECT DISTINCT scenario FROM outputs_tech)
        CROSS JOIN (VALUES {", ".join(f"({y})" for y in P.years)}) AS t(y)""",
    "tailpipe_nonco2": f"""
        SELECT reporting_fuel AS fuel, scenario, year, GHG, MtCO2e / fuel_EJ AS kgCO2e_GJ
        FROM (SELECT e.scenario, coalesce(d.sector, e.input) AS category, e.year, n.input AS GHG,
                     {strict("e.value")} AS fuel_EJ, {strict("n.value * GWP")} AS MtCO2e
              FROM inputs_tech e LEFT JOIN delivery d ON e.input = d.delivery_cost
              JOIN nonco2_tech n ON e.scenario = n.scenario AND e.sector = n.sector
                AND e.subsector = n.subsector AND e.technology = n.technology AND e.year = n.year
              LEFT JOIN gwp ON n.input = gwp.GHG
              WHERE e.sector IN {listed(P.freight_sectors)}
                AND (e.input IN (SELECT sector FROM fuel_techs)
                     OR e.input IN (SELECT delivery_cost FROM delivery))
              GROUP BY e.scenario, category, e.year, n.input)
        LEFT JOIN (SELECT DISTINCT sector, reporting_fuel FROM fuel_techs) ON category = sector""",
    # Prices
    "delivery_costs": f"""
        SELECT p.scenario, p.sector, p.year, q.value - p.value AS delivery_cost
        FROM prices_by_sector p JOIN delivery d ON p.sector = d.sector
        LEFT JOIN prices_by_sector q
          ON q.scenario = p.scenario AND q.year = p.year AND q.sector = d.delivery_cost
        WHERE p.year IN {YEARS}""",
    "co2_penalties": f"""
        SELECT scenario, year,
               value * {P.usd_1990_to_2020} / {P.carbon_to_co2!r} / 1000 AS USD_kgCO2
        FROM co2_prices WHERE market = {lit(P.carbon_market)}""",
    "fuel_prices": f"""
        SELECT scenario, reporting_fuel, year, {strict("price * quantity")} / {strict("quantity")}
                 AS price_USDperGJ
        FROM (SELECT scenario, reporting_fuel, year,
                     (c.value + CASE WHEN {missing("delivery_cost")} THEN 0 ELSE delivery_cost END)
                       * {P.usd_1975_to_2020}
                       + kgCO2_GJ * CASE WHEN {missing("USD_kgCO2")} THEN 0 ELSE USD_kgCO2 END AS price,
                     CASE WHEN {missing("o.value")} THEN 0 ELSE o.value END AS quantity
              FROM costs_by_tech c JOIN fuel_techs USING (sector, subsector, technology)
              LEFT JOIN delivery_costs USING (scenario, sector, year)
              LEFT JOIN co2_penalties USING (scenario, year)
              LEFT JOIN outputs_tech o USING ({TECH}) WHERE year IN {YEARS})
        GROUP BY scenario, reporting_fuel, year""",
    # Land-use change
    "luc_known": f"""
        SELECT luc_run AS scenario, 2 * year - {P.years[0]} AS year, sum(l_extendedprice) / 1e6 AS luc
        FROM base GROUP BY ALL""",
    "luc_series": interpolated("luc_known", "scenario", "luc"),
    "biofuel_known": f"""
        SELECT luc_run AS scenario, reporting_fuel, luc_fuel, 2 * year - {P.years[0]} AS year,
               sum(l_extendedprice) / 1e6 AS Fuel_EJ
        FROM base JOIN fuel_techs USING (sector, subsector, technology)
        WHERE output = sector AND luc_fuel IS NOT NULL GROUP BY ALL""",
    "biofuel_series": interpolated("biofuel_known", "scenario, reporting_fuel, luc_fuel", "Fuel_EJ"),
    "luc_carbon": f"""
        SELECT split_part(scenario, '_', 2) AS luc_fuel, split_part(scenario, '_', 3) AS Policy,
               {strict("luc")} AS luc FROM luc_series GROUP BY scenario""",
    "luc_biofuel": """
        SELECT reporting_fuel, split_part(scenario, '_', 2) AS luc_fuel,
               split_part(scenario, '_', 3) AS Policy, coalesce(sum(Fuel_EJ), 0) AS Fuel_EJ
        FROM biofuel_series GROUP BY scenario, reporting_fuel, luc_fuel""",
    "luc_intensity": f"""
        SELECT c.reporting_fuel AS fuel, c.Policy, LUC_MtCO2e / Fuel_EJ AS LUC_kgCO2_GJ
        FROM (SELECT m.reporting_fuel, a.Policy, (a.luc - b.luc) * {P.carbon_to_co2!r} AS LUC_MtCO2e
              FROM luc_carbon a
              LEFT JOIN (SELECT DISTINCT reporting_fuel, luc_fuel FROM fuel_techs) m
                ON a.luc_fuel = m.luc_fuel
              LEFT JOIN luc_carbon b ON b.Policy = a.Policy AND b.luc_fuel = 'base'
              WHERE a.luc_fuel <> 'base') c
        LEFT JOIN (SELECT a.reporting_fuel, a.Policy, a.Fuel_EJ - b.Fuel_EJ AS Fuel_EJ
                   FROM luc_biofuel a
                   JOIN (SELECT DISTINCT reporting_fuel, luc_fuel FROM fuel_techs) m
                     ON a.reporting_fuel = m.reporting_fuel AND a.luc_fuel = m.luc_fuel
                   LEFT JOIN luc_biofuel b ON b.Policy = a.Policy
                     AND b.reporting_fuel = a.reporting_fuel AND b.luc_fuel = 'base'
                   WHERE a.luc_fuel <> 'base') f
          ON c.reporting_fuel = f.reporting_fuel AND c.Policy = f.Policy""",
    # Expansion to convergence
    "open_flow": f"""
        WITH RECURSIVE f AS (
            SELECT fuel, scenario, year, commodity, value, 0 AS step FROM step0
            WHERE commodity NOT IN {listed(ABSORBING)}
            UNION ALL
            SELECT f.fuel, f.scenario, f.year, c.input, {strict("f.value * c.value")}, min(f.step) + 1
            FROM f JOIN coefs_sector c ON f.scenario = c.scenario AND f.year = c.year AND f.commodity = c.sector
            WHERE c.input NOT IN {listed(ABSORBING)} AND f.step < {MOST_STEPS}
            GROUP BY f.fuel, f.scenario, f.year, c.input)
        SELECT * FROM f""",
    "open_sums": f"""
        SELECT fuel, scenario, year, step, {strict("abs(value)")} AS open
        FROM open_flow GROUP BY fuel, scenario, year, step""",
    "run_steps": f"""
        SELECT r.*, CASE WHEN s.step IS NULL THEN 0 ELSE s.open END AS open
        FROM (SELECT fuel, scenario, year, open AS first, unnest(range({MOST_STEPS + 1})) AS step
              FROM open_sums WHERE step = 0) r
        LEFT JOIN open_sums s USING (fuel, scenario, year, step)""",
    "run_ends": f"""
        SELECT fuel, scenario, year, first, coalesce(min(step) FILTER (
                 WHERE {missing("open")} OR {missing("first")} OR open <= first * {TOLERANCE!r}), {MOST_STEPS}) AS depth
        FROM run_steps GROUP BY fuel, scenario, year, first""",
    "sector_sums": f"""
        SELECT scenario, year, sector,
               {strict(f"CASE WHEN input IN {listed(ABSORBING)} THEN 0 ELSE abs(value) END")} AS onward,
               {strict(f"CASE WHEN input IN {listed(MAPPINGS.primary_commodities)} THEN abs(value) ELSE 0 END")} AS stopping
        FROM coefs_sector c WHERE sector NOT IN {listed(ABSORBING)} AND (scenario, year, sector) IN (
            SELECT (scenario, year, input) FROM coefs_sector
            WHERE sector NOT IN {listed(ABSORBING)} AND input NOT IN {listed(ABSORBING)})
        GROUP BY scenario, year, sector""",
    "run_bounds": """
        SELECT scenario, year, CASE WHEN count(onward) = count(*) AND count(stopping) = count(*) AND max(onward) < 1
               THEN max(stopping) / (1 - max(onward)) END AS factor
        FROM sector_sums GROUP BY scenario, year""",
    "run_absorbed": f"""
        SELECT fuel, scenario, year, {strict("value")} AS absorbed FROM (
            SELECT fuel, scenario, year, value FROM step0 WHERE commodity IN {listed(MAPPINGS.primary_commodities)}
            UNION ALL
            SELECT f.fuel, f.scenario, f.year, f.value * c.value
            FROM open_flow f JOIN run_ends e ON f.fuel = e.fuel AND f.scenario = e.scenario AND f.year = e.year AND f.step < e.depth
            JOIN coefs_sector c ON f.scenario = c.scenario AND f.year = c.year AND f.commodity = c.sector
            WHERE c.input IN {listed(MAPPINGS.primary_commodities)})
        GROUP BY fuel, scenario, year""",
    "no_luc": "SELECT NULL::VARCHAR AS fuel, NULL::VARCHAR AS Policy, NULL::DOUBLE AS LUC_kgCO2_GJ",
    # Results
    "ghg": all_sources(""),
    "ghg_standard": all_sources("", convention=False),
    "ghg_rd": all_sources("rd_", ", RD", f"CROSS JOIN (VALUES {DEPTHS}) AS d(RD)"),
}


def statement(query: str) -> str:
    """The query behind the subqueries it needs, in the order they depend on each other."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(query)
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered)
    return f"WITH {parts}\n{query}" if parts else query


def decoded(columns: str, table: str) -> str:
    variables = list(dict.fromkeys(MAPPINGS.column("scenario_definitions", "variable_name")))
    cuts = [0, *P.code_cuts]
    selected, joins = [], []
    for i, variable in enumerate(variables):
        width = f", {cuts[i + 1] - cuts[i]}" if i + 1 < len(cuts) else ""
        selected.append(f'd{i}.description AS "{variable}"')
        joins.append(
            f"LEFT JOIN definitions d{i} ON d{i}.string = substr(t.scenario, {cuts[i] + 1}{width})"
        )
    return f"SELECT t.scenario, {', '.join(selected)}, {columns} FROM {table} t {' '.join(joins)}"


def bars(value: str, keys: str, table: str, where: str) -> str:
    return f"""SELECT {keys}, {rounded(f"sum({value})", 5)} AS {value} FROM {table}
        WHERE NOT {missing(value)} AND {where} GROUP BY ALL"""


def queries() -> dict[str, str]:
    base, final = f"scenario = {lit(P.base_scenario)}", f"year = {P.final_year}"
    fuels = f"fuel IN {listed(P.highlighted_fuels)}"
    flow = "scenario, sector, subsector, technology, year"
    energy = f"(SELECT * REPLACE ({rounded('IO', P.digits)} AS IO) FROM primary_energy)"
    text = {
        "outputs_tech": f"SELECT {flow}, {rounded('value', 8)} AS value FROM outputs_tech",
        "outputs_sector": f"SELECT scenario, sector, year, {rounded('value', 8)} AS value FROM outputs_sector",
        "inputs_tech": f"SELECT {flow}, input, {rounded('value', 10)} AS value FROM inputs_tech",
        "inputs_sector": f"SELECT scenario, sector, input, year, {rounded('value', 10)} AS value FROM inputs_sector",
        "io_coefs_tech": f"SELECT {flow}, input, {rounded('value', 8)} AS value FROM coefs_tech",
        "io_coefs_sector": f"SELECT scenario, sector, year, input, {rounded('value', 8)} AS value FROM coefs_sector",
        "upstream_absorbed": f"""SELECT fuel, scenario, year, commodity, kind, depth,
            CASE WHEN depth = 0 THEN {rounded('value', 10)} ELSE {rounded('value', 8)} END AS value
            FROM absorbed""",
        "fuel_production": f"""SELECT fuel, scenario, year, {rounded('EJ_out', 8)} AS EJ_out
            FROM production""",
        "primary_inputs": f"""SELECT fuel, scenario, year, sector, {rounded('EJ_in', 7)} AS EJ_in
            FROM primary_in""",
        "nonco2_emissions": f"""SELECT fuel, scenario, year, commodity AS GHG,
            {rounded(strict("value"), 7)} AS TG
            FROM absorbed WHERE kind = 'ghg' GROUP BY fuel, scenario, year, commodity""",
        "biofuel_interpolated": f"""SELECT scenario, reporting_fuel, luc_fuel, year,
            {rounded('Fuel_EJ', 9)} AS Fuel_EJ FROM biofuel_series""",
        "upstream_co2": f"SELECT fuel, scenario, year, {rounded('kgCO2_GJ', 7)} AS kgCO2_GJ FROM upstream_co2",
        "primary_energy": decoded(
            f"fuel, year, Primary_fuel, {rounded('IO', P.digits)} AS IO", "primary_energy"
        ),
        "upstream_nonco2": f"""SELECT fuel, scenario, year, GHG, {rounded('kgCO2e_GJ', 7)}
            AS kgCO2e_GJ FROM upstream_nonco2""",
        "tailpipe_co2": "SELECT fuel, scenario, year, kgCO2_GJ FROM tailpipe_co2",
        "tailpipe_nonco2": f"""SELECT fuel, scenario, year, GHG, {rounded('kgCO2e_GJ', 7)}
            AS kgCO2e_GJ FROM tailpipe_nonco2""",
        "delivery_costs": f"""SELECT scenario, sector, year, {rounded('delivery_cost', 8)}
            AS delivery_cost FROM delivery_costs""",
        "co2_penalties": f"SELECT scenario, year, {rounded('USD_kgCO2', 8)} AS USD_kgCO2 FROM co2_penalties",
        "fuel_prices": decoded(
            f"reporting_fuel, year, {rounded('price_USDperGJ', P.digits)} AS price_USDperGJ",
            "fuel_prices",
        ),
        "luc_interpolated": f"SELECT scenario, year, {rounded('luc', 9)} AS luc FROM luc_series",
        "luc_intensity": f"SELECT fuel, Policy, {rounded('LUC_kgCO2_GJ', 7)} AS LUC_kgCO2_GJ FROM luc_intensity",
        "lca_ghg": decoded("fuel, GHG, source, year, kgCO2e_GJ", "ghg"),
        "decode_scenario": decoded(f"sector, year, {rounded('value', 8)} AS value", "outputs_sector"),
        "depth_sensitivity": f"""
            SELECT scenario, fuel, CAST(RD AS INTEGER) AS RD,
                   {rounded(strict("kgCO2e_GJ"), 6)} AS kgCO2e_GJ
            FROM ghg_rd WHERE year = {P.sensitivity_year}
              AND fuel NOT IN {listed(P.sensitivity_excluded)} GROUP BY scenario, fuel, RD""",
        "report_base_ghg": bars(
            "kgCO2e_GJ", "fuel || ' ' || year AS label, fuel, year, source", "ghg", base
        ),
        "report_h2_nh3_ghg": bars("kgCO2e_GJ", "scenario, fuel, year, source", "ghg", fuels),
        "report_ghg_final_year": bars("kgCO2e_GJ", "fuel, source", "ghg", f"{base} AND {final}"),
        "report_pe_final_year": bars("IO", "fuel, Primary_fuel", energy, f"{base} AND {final}"),
        "report_pe_scenarios": bars(
            "IO",
            "scenario, fuel, Primary_fuel",
            energy,
            f"regexp_matches(scenario, {lit(P.contrasted_scenarios)}) AND {final} AND {fuels}",
        ),
        "report_prices": f"""SELECT scenario, reporting_fuel, year,
            {rounded('price_USDperGJ', P.digits)} AS price_USDperGJ FROM fuel_prices""",
    }
    convention = all_sources("").replace("LEFT JOIN luc_intensity l", "LEFT JOIN no_luc l")
    text["greet_convention"] = f"""SELECT fuel, source, scenario, year, kgCO2e_GJ
        FROM ({convention}) WHERE GHG = 'CO2'"""
    text["carbon_markets"] = f"""SELECT scenario, market, year, {rounded('value', 8)} AS value
        FROM co2_prices WHERE contains(market, 'CO2')"""
    text["scenario_block"] = f"""SELECT {flow}, {rounded('value', 8)} AS value
        FROM outputs_tech WHERE regexp_matches(scenario, 'p2$')"""
    by_sector = "FROM outputs_tech JOIN (SELECT DISTINCT sector, r_name FROM base) USING (sector)"
    known = """(SELECT luc_run AS scenario, 2 * year - {first} AS year, sum(l_extendedprice) / 1e6 AS luc
        FROM base WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY ALL)""".format(first=P.years[0])
    priced = CTES["fuel_prices"].replace("FROM costs_by_tech c", "FROM (SELECT * FROM costs_by_tech WHERE sector <> 'N2') c")
    grid = f"2 * year - {P.years[0]} + 15"
    text |= {
        "region_selected": f"SELECT {flow}, {rounded('value', 8)} AS value {by_sector} WHERE r_name = 'ASIA'",
        "luc_regions_selected": f"SELECT scenario, year, {rounded('luc', 9)} AS luc FROM ({interpolated(known, 'scenario', 'luc')})",
        "gases_selected": f"SELECT {flow}, input, {rounded('value', 10)} AS value FROM nonco2_tech WHERE input <> 'H2'",
        "prices_without_agriculture": f"""SELECT scenario, reporting_fuel, year,
            {rounded('price_USDperGJ', P.digits)} AS price_USDperGJ FROM ({priced})""",
        "land_leaves_summed": f"""SELECT luc_run AS scenario, r_name AS region, {grid} AS year,
            round(sum(l_extendedprice) / 1e6, 8) AS value FROM base
            WHERE {grid} > 2015 AND {grid} < 2055 GROUP BY ALL""",
        "project_blocks": text["outputs_tech"],
        "scenario_block_saved": text["scenario_block"],
        "results_reread": text["fuel_prices"],
        "mappings_csv": text["tailpipe_co2"],
        "lca_ghg_standard": "SELECT scenario, fuel, GHG, source, year, kgCO2e_GJ FROM ghg_standard",
    }
    # whole units and their 2**52nd parts are whole numbers, which add without error
    text["outputs_sector_exact"] = f"""SELECT scenario, sector, year,
        (sum(trunc(x)::HUGEINT) * (1::HUGEINT << 52) + sum(((x - trunc(x)) * 4503599627370496)::HUGEINT))::DOUBLE
          / 4503599627370496 / 1e6 AS value
        FROM (SELECT scenario, sector, year, l_extendedprice::DOUBLE AS x FROM base
              WHERE l_returnflag <> 'R' AND year IN {YEARS}) GROUP BY ALL"""
    text["land_use_by_region"] = text["land_leaves_summed"]
    tied = f"""(SELECT luc_run AS scenario, 2 * year - {P.years[0]} AS year, (min(value) + max(value)) / 2 AS value FROM (
        SELECT luc_run, year, sum(l_extendedprice) / 1e6 AS value
        FROM base GROUP BY luc_run, year, sector, technology, output) GROUP BY luc_run, year)"""
    text["ties_interpolated"] = f"""SELECT scenario, year, {rounded('value', 10)} AS value
        FROM ({interpolated(tied, 'scenario', 'value')})"""
    text["ties_interpolated_sql"] = text["ties_interpolated"]
    code = f"""'h' || (c_nationkey % 4 + 1) || 'r' || (c_nationkey % 3 + 1) || 'b' || (c_nationkey % 2 + 1)
        || 'n' || (c_custkey % 2 + 1) || 'c' || (c_custkey // 2 % 2 + 1)
        || 'p' || (list_position({list(SEGMENTS)}, c_mktsegment) % 3 + 1)"""
    published = Mappings.published()
    levels = ", ".join(listed(r) for r in published.scenario_definitions)
    variables = list(dict.fromkeys(published.column("scenario_definitions", "variable_name")))
    spelled = ", ".join(
        f"(SELECT description FROM (VALUES {levels}) AS l(string, name, description) WHERE string = substr(scenario, {2 * i + 1}, 2)) AS \"{v}\"" for i, v in enumerate(variables)
    )
    text["six_pieces_decoded"] = f"""SELECT scenario, {spelled}, customers
        FROM (SELECT {code} AS scenario, count(*) AS customers FROM customer GROUP BY ALL)"""
    text["six_pieces_decoded_sql"] = text["six_pieces_decoded"]
    text["broken_rows_set_aside"] = """SELECT scenario, sector, technology, output,
        CASE WHEN reason IS NULL THEN year END AS year, CASE WHEN reason IS NULL THEN value END AS value, reason FROM (
            SELECT *, CASE technology WHEN 'SMALL' THEN 'value' WHEN 'LARGE' THEN 'year' END AS reason FROM (
                SELECT scenario, sector, technology, output, year, round(sum(l_extendedprice) / 1e6, 8) AS value
                FROM base GROUP BY ALL))"""
    segment, policy = ('"Market segment"', '"Policy"')
    text["upstream_converged"] = f"""SELECT fuel, scenario, year, CAST(depth AS INTEGER) AS depth,
        {rounded('first', 10)} AS first, {rounded('open', 9)} AS open, {rounded('open * factor', 9)} AS bound,
        {rounded('absorbed', 7)} AS absorbed
        FROM run_ends JOIN (SELECT fuel, scenario, year, step AS depth, open FROM run_steps) USING (fuel, scenario, year, depth)
        LEFT JOIN run_bounds USING (scenario, year) LEFT JOIN run_absorbed USING (fuel, scenario, year)"""
    text["project_scenario"] = f"{text['outputs_tech']} WHERE scenario = 'm1p2'"
    text["block_scenario_picked"] = text["project_scenario"]
    times = "CASE WHEN scenario IN ('m1p2', 'm2p2') THEN 2 WHEN scenario = 'm3p1' THEN 3 ELSE 1 END"
    text["block_redelivered"] = f"SELECT {flow}, {rounded(f'value * {times}', 8)} AS value FROM outputs_tech"
    dearer = CTES["fuel_prices"].replace(
        "FROM costs_by_tech c", "FROM (SELECT * REPLACE (CASE WHEN scenario = 'm2p1' THEN value * 2 ELSE value END AS value) FROM costs_by_tech) c"
    )
    text["prices_updated"] = decoded(
        f"reporting_fuel, year, {rounded('price_USDperGJ', P.digits)} AS price_USDperGJ", f"({dearer})"
    )
    parts = {
        "fuels_lca_ghg": ("fuel", "GHG || ' ' || source", "kgCO2e_GJ", text["lca_ghg"]),
        "fuels_primary_energy": ("fuel", "Primary_fuel", "IO", text["primary_energy"]),
        "fuels_prices": ("reporting_fuel", "NULL::VARCHAR", "price_USDperGJ", text["fuel_prices"]),
    }
    text["results_published"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS result, scenario, {fuel} AS fuel, year, {kind} AS kind, {segment} AS segment,
        {policy} AS "Policy", {value} AS value FROM ({sql})"""
        for name, (fuel, kind, value, sql) in parts.items()
    )
    return {name: statement(q) for name, q in text.items()}
