"""Short constructors of small frames."""

from __future__ import annotations

TECH = "scenario string, sector string, subsector string, technology string, year int"
SCENARIO = "h1r1b1n1c1p1"


def outputs(spark, rows, scenario=SCENARIO, year=2020):
    """Rows of (sector, subsector, technology, value)."""
    return spark.createDataFrame(
        [(scenario, s, b, t, year, v) for s, b, t, v in rows], TECH + ", value double"
    )


def inputs(spark, rows, scenario=SCENARIO, year=2020):
    """Rows of (sector, subsector, technology, input, value)."""
    return spark.createDataFrame(
        [(scenario, s, b, t, year, i, v) for s, b, t, i, v in rows],
        TECH + ", input string, value double",
    )


def graph(spark, fuel, edges, produced=1.0, scenario=SCENARIO, year=2020):
    """Outputs and inputs of a sector graph behind the fuel technology ``(s, b, t)``.

    ``edges`` maps a sector to {input: coefficient}; each sector has one technology and unit
    output. The fuel technology has its own inputs under the key ``None``.
    """
    outs = [(*fuel, produced)]
    ins = [(*fuel, i, c * produced) for i, c in edges[None].items()]
    for sector, into in edges.items():
        if sector is not None:
            outs.append((sector, sector, sector, 1.0))
            ins += [(sector, sector, sector, i, c) for i, c in into.items()]
    return outputs(spark, outs, scenario, year), inputs(spark, ins, scenario, year)


def collected(df, *keys):
    """Rows as a dictionary from key columns to the remaining values."""
    rest = [c for c in df.columns if c not in keys]
    found = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]
        assert key not in found, f"duplicate {key}"
        found[key] = tuple(r[c] for c in rest) if len(rest) > 1 else r[rest[0]]
    return found
