"""Upstream expansion of fuels through the input-output coefficients.

One technology step leads from a fuel to its immediate inputs; each further step replaces
a sector by its own inputs. Primary commodities and non-CO2 gases are absorbed when they
are reached. All fuels, scenarios and years advance together, and after every step the
flows of a fuel into one commodity are summed, so the working set is bounded by fuels x
scenarios x years x commodities however many paths lead to a commodity.

Only flows that are still open take part in the steps. What is absorbed follows from them
at the end, in one join of the open flows of all steps with the edges that stop.

The edges are written once, bucketed and sorted by scenario, year, sector and cell, and never
move again. A step joins them with the flows, which one exchange by the same key has placed;
that exchange serves the sum of the flows too. No scenario, year or fuel is a unit of work,
and neither is a sector: one that holds more edges than its share, or that more edges lead to
than its share, is cut into cells (``heavy_sectors``). Its edges are dealt to ``parts`` by
their target, and each flow goes to every part; flows into it are dealt to ``slots`` by fuel
and origin, and each slot has its own copy of the edges. A flow is then summed only within its
slot, which is sound because every step is linear in the flows.

Flows are written after every ``STEPS_PER_TABLE`` steps. ``upstream_converge`` goes on until
what is still open is a small share of what each fuel set out with.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wellspring.functions.numeric import missing, strict_sum
from wellspring.operators.flows import SECTOR_KEYS, TECH_KEYS, io_coefficients, sector_totals
from wellspring.params import LcaParams
from wellspring.sources.mappings import Mappings
from wellspring.sources.workspace import materialize, materialize_buckets

PRIMARY, GHG = "primary", "ghg"

CELL = ["scenario", "year"]
FLOW = ["fuel", "scenario", "year", "commodity"]
PLACE = [*CELL, "commodity", "cell"]
RUN = ["fuel", *CELL]

STEPS_PER_TABLE = 4
#: A sector is cut where it has more than this part of one bucket's share of all edges.
SHARE = 0.25
#: A cell's number is part * _PARTS + slot.
_PARTS = 1 << 16


def fuel_technologies(df: DataFrame, m: Mappings) -> DataFrame:
    """The rows of a technology table that belong to a fuel technology."""
    techs = m.frame(df.sparkSession, "fuel_techs", "sector", "subsector", "technology")
    return df.join(techs, ["sector", "subsector", "technology"], "left_semi")


def fuel_production(outputs_tech: DataFrame, m: Mappings) -> DataFrame:
    """Output of each fuel by scenario and year."""
    techs = m.frame(
        outputs_tech.sparkSession, "fuel_techs", "sector", "subsector", "technology", "fuel"
    )
    return outputs_tech.join(techs, ["sector", "subsector", "technology"]).select(
        "fuel", "scenario", "year", F.col("value").alias("EJ_out")
    )


def upstream_expand(
    outputs_tech: DataFrame,
    inputs_tech: DataFrame,
    m: Mappings,
    p: LcaParams,
    *,
    by_depth: bool = True,
) -> DataFrame:
    """Absorbed flows as fuel, scenario, year, commodity, kind, depth, value.

    ``depth`` is the step at which a flow was absorbed, 0 being the technology step. With
    ``by_depth=False`` all steps are summed, the rows are fewer, and depth is NULL.
    """
    absorbing = [*m.primary_commodities, *p.ghgs]
    edges = written_edges(outputs_tech, inputs_tech, absorbing)
    first = first_step(outputs_tech, inputs_tech, m)
    # A flow of step d is absorbed at step d + 1, so the flows of the last step are not needed.
    tables = [
        open_flows
        for open_flows, _ in _steps(_open(first, absorbing), edges, max(p.depth, 1), lazy_end=True)
    ]
    at_once = _taken(first, absorbing).withColumn("step", F.lit(-1))
    parts = [at_once] if p.depth < 1 else [at_once, _stopped(reduce(DataFrame.unionByName, tables), edges)]
    return _absorbed(reduce(DataFrame.unionByName, parts), p, by_depth)


def _absorbed(rows: DataFrame, p: LcaParams, by_depth: bool) -> DataFrame:
    """Flows with the step they come from, summed by where and when they are absorbed."""
    depth = (F.col("step") + 1).cast("int") if by_depth else F.lit(None).cast("int")
    kind = F.when(F.col("commodity").isin(*p.ghgs), GHG).otherwise(PRIMARY)
    summed = _collapse(rows.withColumn("depth", depth), *FLOW, "depth")
    return summed.select(*FLOW, kind.alias("kind"), "depth", "value")


def first_step(outputs_tech: DataFrame, inputs_tech: DataFrame, m: Mappings) -> DataFrame:
    """Flows into the fuel technologies themselves: production x coefficient.

    Both tables are narrowed to the fuel technologies before they are shuffled, and repeated
    inputs of a technology are summed, so that no technology brings many rows to the joins.
    """
    spark = outputs_tech.sparkSession
    techs = m.frame(spark, "fuel_techs", "sector", "subsector", "technology", "fuel")
    own_outputs = fuel_technologies(outputs_tech, m)
    own_inputs = _collapse(fuel_technologies(inputs_tech, m), *TECH_KEYS, "input")
    own_coefs = io_coefficients(own_inputs, own_outputs, TECH_KEYS)
    return (
        own_coefs.withColumnRenamed("value", "_coef")
        .join(own_outputs, TECH_KEYS)
        .join(techs, ["sector", "subsector", "technology"])
        .where(F.col("input").isNotNull())
        .select(
            "fuel",
            "scenario",
            "year",
            F.col("input").alias("commodity"),
            (F.col("value") * F.col("_coef")).alias("value"),
        )
    )


def sector_edges(
    outputs_tech: DataFrame, inputs_tech: DataFrame, absorbing: list[str]
) -> DataFrame:
    """Sector coefficients that a step can follow: scenario, year, via, next, stops, coef.

    ``stops`` tells that the next commodity is absorbed.
    """

    def open_sectors(df: DataFrame) -> DataFrame:
        return df.where(~F.col("sector").isin(*absorbing))

    coefs = io_coefficients(
        sector_totals(open_sectors(inputs_tech), "input"),
        sector_totals(open_sectors(outputs_tech)),
        SECTOR_KEYS,
    )
    return coefs.where(F.col("input").isNotNull()).select(
        *CELL,
        F.col("sector").alias("via"),
        F.col("input").alias("next"),
        F.col("input").isin(*absorbing).alias("stops"),
        F.col("value").alias("coef"),
    )


@dataclass(frozen=True)
class Edges:
    """The written edges: bucketed by scenario, year, via and cell, and their heavy sectors.

    An edge has besides ``next_parts`` and ``next_slots``, into how many its target is cut.
    """

    table: DataFrame
    heavy: DataFrame
    buckets: int


def written_edges(outputs_tech: DataFrame, inputs_tech: DataFrame, absorbing: list[str]) -> Edges:
    """Edges written in buckets; written anew, in cells, only if some sector is heavy."""
    spark = outputs_tech.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = sector_edges(outputs_tech, inputs_tech, absorbing)
    whole = {"cell": F.lit(0), "next_parts": F.lit(1), "next_slots": F.lit(1)}
    keys = [*CELL, "via", "cell"]
    table = materialize_buckets(edges.withColumns(whole), "edges", buckets, keys)
    rows = heavy_sectors(table, buckets).collect()  # bounded, see there
    heavy = F.broadcast(spark.createDataFrame(rows, "scenario string, year int, commodity string, parts int, slots int"))
    if rows:
        table = materialize_buckets(in_cells(table.drop(*whole), heavy), "edges", buckets, keys)
    return Edges(table, heavy, buckets)


def heavy_sectors(edges: DataFrame, buckets: int) -> DataFrame:
    """scenario, year, commodity, parts, slots of the sectors that are cut.

    A sector weighs the edges that leave it (parts) and the open edges that lead to it
    (slots), each against ``SHARE`` of an even bucket. All edges together make
    ``buckets / SHARE`` such units, so at most twice as many sectors are heavy, however many
    edges there are. Parts and slots together make no more cells than there are units.
    """
    units = int(buckets / SHARE)
    out = edges.groupBy(*CELL, F.col("via").alias("commodity")).agg(F.count("*").alias("out"), F.lit(0).cast("long").alias("in"))
    into = edges.where(~F.col("stops")).groupBy(*CELL, F.col("next").alias("commodity"))
    into = into.agg(F.lit(0).cast("long").alias("out"), F.count("*").alias("in"))
    # the least unit keeps a handful of edges together
    unit = max(edges.count() / units, _LEAST_UNIT)
    ends = out.unionByName(into).groupBy(*CELL, "commodity").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    parts = F.least(F.ceil(F.col("out") / unit), F.lit(units)).cast("int")
    slots = F.greatest(F.least(F.ceil(F.col("in") / unit), F.floor(F.lit(units) / F.col("parts"))), F.lit(1)).cast("int")
    cut = ends.where("out > 0").withColumn("parts", parts).withColumn("slots", slots)
    return cut.where("parts > 1 OR slots > 1").select(*CELL, "commodity", "parts", "slots")


#: Edges that are not worth cutting apart.
_LEAST_UNIT = 1_000


def _number(of: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.col(of)).cast("int")


def in_cells(edges: DataFrame, heavy: DataFrame) -> DataFrame:
    """Edges dealt to the parts of their sector and copied to each of its slots."""

    def sizes(prefix: str, key: str) -> DataFrame:
        return heavy.select(
            F.col("scenario"), F.col("year"), F.col("commodity").alias(key),
            F.col("parts").alias(f"{prefix}parts"), F.col("slots").alias(f"{prefix}slots"),
        )

    found = edges.join(sizes("", "via"), [*CELL, "via"], "left").join(sizes("next_", "next"), [*CELL, "next"], "left")
    found = found.fillna(1, ["parts", "slots", "next_parts", "next_slots"])
    slot = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    copied = found.select("*", slot.alias("slot"))
    cell = _number("parts", "next") * _PARTS + F.col("slot")
    return copied.select(*CELL, "via", "next", "stops", "coef", cell.alias("cell"), "next_parts", "next_slots")


def _cells(parts: str, slots: str, *origin: str) -> Column:
    """The cells a flow goes to: its slot in every part."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda p: p * _PARTS + _number(slots, *origin))


def _collapse(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(strict_sum(F.col("value")).alias("value"))


def _taken(first: DataFrame, absorbing: list[str]) -> DataFrame:
    return first.where(F.col("commodity").isin(*absorbing)).select(*FLOW, "value")


def _open(first: DataFrame, absorbing: list[str]) -> DataFrame:
    return first.where(~F.col("commodity").isin(*absorbing)).select(*FLOW, "value")


def _follows(edges: DataFrame) -> tuple[DataFrame, Column]:
    renamed = edges.withColumnsRenamed({"scenario": "edge_scenario", "year": "edge_year", "cell": "edge_cell"})
    return renamed, (
        (F.col("scenario") == F.col("edge_scenario"))
        & (F.col("year") == F.col("edge_year"))
        & (F.col("commodity") == F.col("via"))
        & (F.col("cell") == F.col("edge_cell"))
    )


def _steps(
    start: DataFrame, edges: Edges, steps: int, lazy_end: bool = False
) -> Generator[tuple[DataFrame, int], DataFrame | None, None]:
    """Tables of the open flows of ``steps`` steps (FLOW, cell, value, step) and each one's last step.

    Step 0 is ``start``. Each table is written, unless it is the last and ``lazy_end``. Who
    takes a table may send back the runs (fuel, scenario, year) that go on.
    """
    onward, follows = _follows(edges.table.where(~F.col("stops")))

    def summed(rows: DataFrame) -> DataFrame:
        return _collapse(rows.repartition(edges.buckets, *PLACE), "fuel", *PLACE)

    def ahead(flow: DataFrame) -> DataFrame:
        cell = F.explode(_cells("next_parts", "next_slots", "fuel", "via")).alias("cell")
        value = (F.col("value") * F.col("coef")).alias("value")
        return summed(flow.join(onward, follows).select("fuel", *CELL, F.col("next").alias("commodity"), cell, value))

    sized = start.join(edges.heavy, [*CELL, "commodity"], "left").fillna(1, ["parts", "slots"])
    flow, step = summed(sized.select(*FLOW, F.explode(_cells("parts", "slots", "fuel")).alias("cell"), "value")), 0
    while True:
        here = [flow.withColumn("step", F.lit(step))]
        while len(here) < STEPS_PER_TABLE and step + 1 < steps:
            flow, step = ahead(flow), step + 1
            here.append(flow.withColumn("step", F.lit(step)))
        table, ended = reduce(DataFrame.unionByName, here), step + 1 >= steps
        if not (ended and lazy_end):
            table = materialize(table, "flow")
        going = yield table, step
        if ended:
            return
        flow = table.where(F.col("step") == step).drop("step")
        if going is not None:
            flow = flow.join(going, RUN, "left_semi")
        flow, step = ahead(flow.repartition(edges.buckets, *PLACE)), step + 1


def _stopped(flows: DataFrame, edges: Edges) -> DataFrame:
    """What the open flows of every step bring to absorbed commodities one step on."""
    ends, follows = _follows(edges.table.where(F.col("stops")))
    placed = flows.repartition(edges.buckets, *PLACE)
    return placed.join(ends, follows).select(
        "fuel", *CELL, F.col("next").alias("commodity"), (F.col("value") * F.col("coef")).alias("value"), "step"
    )


@dataclass(frozen=True)
class Converged:
    """``absorbed`` as by ``upstream_expand``; ``runs``: how far each run went and what is left.

    ``runs`` has fuel, scenario, year, depth, first, open, bound: the depth that absorbed
    flows include, the open flow after the technology step and at that depth, and the most
    that any greater depth could add to the absorbed primary commodities (NULL where the
    coefficients do not bound it). ``steps`` tells for each written table its last step and
    how many runs were still open.
    """

    absorbed: DataFrame
    runs: DataFrame
    steps: list[tuple[int, int]]


def upstream_converge(
    outputs_tech: DataFrame,
    inputs_tech: DataFrame,
    m: Mappings,
    p: LcaParams,
    *,
    tolerance: float = 1e-6,
    most: int = 100,
    by_depth: bool = False,
) -> Converged:
    """Expand every fuel, scenario and year until its open flow is a small share of its first.

    A run ends at the first step whose open flow is at most ``tolerance`` times that of step
    0, or is missing (an unknown flow cannot shrink), or at step ``most``. After each written
    table the ended runs are set aside and only the others go on; that table's write observes
    how many there are, so the loop needs no further job to decide.
    """
    absorbing = [*m.primary_commodities, *p.ghgs]
    edges = written_edges(outputs_tech, inputs_tech, absorbing)
    first = first_step(outputs_tech, inputs_tech, m)
    steps = _steps(_open(first, absorbing), edges, most + 1)
    flows, ended, going, seen = [], [], None, []
    table, last = next(steps)
    while True:
        flows.append(table)
        marked = _ends(table, seen[-1][0] + 1 if seen else 0, last, tolerance, going, last >= most)
        counted = Observation(f"open runs at step {last}")
        state = materialize(marked.observe(counted, F.count_if(~F.col("over")).alias("open")), "runs")
        ended.append(state.where("over"))
        seen.append((last, counted.get["open"]))
        if not seen[-1][1]:
            break
        going = state.where(~F.col("over")).select(*RUN, "first")
        try:
            table, last = steps.send(going)
        except StopIteration:
            break
    runs = reduce(DataFrame.unionByName, ended).select(*RUN, "depth", "first", "open")
    kept = reduce(DataFrame.unionByName, flows).join(runs.select(*RUN, F.col("depth").alias("_depth")), RUN)
    kept = kept.where(F.col("step") < F.col("_depth")).drop("_depth")
    at_once = _taken(first, absorbing).withColumn("step", F.lit(-1))
    absorbed = _absorbed(at_once.unionByName(_stopped(kept, edges)), p, by_depth)
    return Converged(absorbed, _bounded(runs, edges, p), seen)


def _ends(table: DataFrame, low: int, last: int, tolerance: float, before: DataFrame | None, forced: bool) -> DataFrame:
    """Runs with their first and open flow, whether they are over, and at which depth.

    ``table`` has the steps from ``low`` to ``last``. A flow may lie in several parts, each of
    them whole; part 0 is counted. A run that has no flow at a step has an open flow of 0 there.
    """
    whole = table.where(F.col("cell") < _PARTS)
    sums = whole.groupBy(*RUN, "step").agg(strict_sum(F.abs("value")).alias("open"))
    by_step = F.map_from_entries(F.collect_list(F.struct("step", "open")))
    packed = sums.groupBy(*RUN).agg(by_step.alias("by_step"))
    if before is not None:  # a run without any flow in this table is over as well
        packed = before.join(packed, RUN, "left")
    else:
        packed = packed.withColumn("first", F.try_element_at("by_step", F.lit(0)))
    at = F.sequence(F.lit(low), F.lit(last))

    def open_at(step: Column) -> Column:
        present = F.coalesce(F.array_contains(F.map_keys("by_step"), step), F.lit(False))
        return F.when(present, F.try_element_at("by_step", step)).otherwise(0.0)

    states = F.transform(at, lambda s: F.struct(s.alias("step"), open_at(s).alias("open")))
    small = F.filter(states, lambda s: missing(s["open"]) | missing(F.col("first")) | (s["open"] <= F.col("first") * tolerance))
    over = F.size(small) > 0
    chosen = F.when(over, F.get(small, F.lit(0))).otherwise(F.element_at(states, -1))
    return packed.select(
        *RUN, "first", chosen["open"].alias("open"), chosen["step"].alias("depth"), (over | F.lit(forced)).alias("over")
    )


def _bounded(runs: DataFrame, edges: Edges, p: LcaParams) -> DataFrame:
    """Add the bound: open x greatest stopping sum / (1 - greatest onward sum) of any sector.

    Each step multiplies the sum of open flows by at most the greatest sum of a sector's
    onward coefficients; below 1, all steps to come make a geometric series. Only sectors that
    some sector needs count.
    """
    size = F.abs("coef")
    onward = ~F.col("stops")
    primary = F.col("stops") & ~F.col("next").isin(*p.ghgs)
    # the edges of a heavy sector are copied to its slots; slot 0 has each once
    once = edges.table.where(F.pmod("cell", F.lit(_PARTS)) == 0)
    # after a step, flows are open only where an edge leads to
    reached = edges.table.where(onward).select(*CELL, F.col("next").alias("via"))
    once = once.join(reached, [*CELL, "via"], "left_semi")
    sectors = once.groupBy(*CELL, "via").agg(
        strict_sum(F.when(onward, size).otherwise(0.0)).alias("onward"),
        strict_sum(F.when(primary, size).otherwise(0.0)).alias("stopping"),
    )
    unknown = F.max(missing(F.col("onward")) | missing(F.col("stopping")))
    most = sectors.groupBy(*CELL).agg(
        F.max("onward").alias("_onward"), F.max("stopping").alias("_stopping"), unknown.alias("_unknown")
    )
    bound = F.col("open") * F.col("_stopping") / (1 - F.col("_onward"))
    found = runs.join(most, CELL, "left")
    no_edges = F.col("_onward").isNull() & F.col("_unknown").isNull()
    value = F.when(missing(F.col("open")) | F.col("_unknown") | (F.col("_onward") >= 1), None).otherwise(bound)
    return found.select(*RUN, "depth", "first", "open", F.when(no_edges, 0.0).otherwise(value).alias("bound"))
