"""The analysis' functions for SQL: temporary functions of a session, without Python workers.

    register(spark, mappings, params)
    SELECT t.*, d.* FROM results t, LATERAL decode_scenario(t.scenario) d
    SELECT interpolated(points, 2033), ratio(inputs, outputs), scenario_level('h2') …

Their bodies are SQL expressions, which the optimizer puts in the place of each call.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings

_POINTS = "ARRAY<STRUCT<year: INT, value: DOUBLE>>"
_KNOWN = "p -> p.year IS NOT NULL AND p.value IS NOT NULL AND NOT isnan(p.value)"


def _text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(value: str) -> str:
    return "`" + value.replace("`", "``") + "`"


def definitions(m: Mappings, p: LcaParams) -> dict[str, str]:
    """Signature to body of every function."""
    records = m.records("scenario_definitions")
    levels: dict[str, str | None] = {}
    for r in records:  # a level defined twice takes its first description
        levels.setdefault(r["string"], r["description"])
    variables = list(dict.fromkeys(r["variable_name"] for r in records))
    if len(variables) != len(p.code_cuts) + 1:
        raise ValueError(f"{len(p.code_cuts)} cuts do not give {len(variables)} dimensions")
    whens = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in levels.items())
    begins = (0, *p.code_cuts)
    pieces = [
        f"substring(scenario, {a + 1}, {b - a})" for a, b in zip(begins, p.code_cuts)
    ] + [f"substring(scenario, {begins[-1] + 1})"]
    columns = ", ".join(f"{_name(v)} STRING" for v in variables)
    selected = ", ".join(f"scenario_level({piece})" for piece in pieces)
    return {
        "scenario_level(code STRING) RETURNS STRING": f"CASE code {whens} END" if whens else "CAST(NULL AS STRING)",
        f"decode_scenario(scenario STRING) RETURNS TABLE({columns})": f"SELECT {selected}",
        "ratio(n DOUBLE, d DOUBLE) RETURNS DOUBLE": """
            CASE WHEN n IS NULL OR d IS NULL THEN CAST(NULL AS DOUBLE)
                 WHEN d <> 0 OR isnan(d) THEN try_divide(n, d)
                 WHEN isnan(n) OR n = 0 THEN double('NaN')
                 WHEN n > 0 THEN double('Infinity') ELSE double('-Infinity') END""",
        f"known_points(points {_POINTS}) RETURNS {_POINTS}": f"filter(points, {_KNOWN})",
        # the mean of the values of one year
        f"value_in(points {_POINTS}, at INT) RETURNS DOUBLE": """
            try_divide(aggregate(filter(points, p -> p.year = at), 0D, (s, p) -> s + p.value),
                       CAST(size(filter(points, p -> p.year = at)) AS DOUBLE))""",
        f"year_before(points {_POINTS}, at INT) RETURNS INT":
            "array_max(transform(filter(points, p -> p.year <= at), p -> p.year))",
        f"year_after(points {_POINTS}, at INT) RETURNS INT":
            "array_min(transform(filter(points, p -> p.year >= at), p -> p.year))",
        "line_between(x0 INT, y0 DOUBLE, x1 INT, y1 DOUBLE, at INT) RETURNS DOUBLE":
            "CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * try_divide(CAST(at - x0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE)) END",
        f"interpolated(points {_POINTS}, at INT) RETURNS DOUBLE": """
            line_between(
                year_before(known_points(points), at), value_in(known_points(points), year_before(known_points(points), at)),
                year_after(known_points(points), at), value_in(known_points(points), year_after(known_points(points), at)), at)""",
    }


def register(spark: SparkSession, m: Mappings | None = None, p: LcaParams | None = None) -> list[str]:
    """Create the functions, or replace those of other mappings; returns their names.

    ``interpolated`` averages values of one year, leaves NULL and NaN out, and is NULL outside
    the known years, like ``functions/series.py``; ``decode_scenario`` gives a column for each
    dimension, like ``assemble.decode_scenario``.
    """
    made = definitions(m or Mappings.published(), p or LcaParams())
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in made]
