"""Results that are recomputed only for the scenarios whose facts have changed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.plans.lca import LcaPlan
from wellspring.sources import fingerprint
from wellspring.sources.project import Project
from wellspring.sources.schemas import RESULTS
from wellspring.sources.tables import LUC_TABLES
from wellspring.sources.workspace import materialize


def fingerprints(plan: LcaPlan) -> DataFrame:
    """scenario, fingerprint of everything that a scenario's results depend on.

    That is the scenario's own rows in the main tables, and for every scenario the land-use
    runs, the mappings and the parameters.
    """
    tables = {f.name: getattr(plan.facts, f.name) for f in fields(plan.facts) if getattr(plan.facts, f.name) is not None}
    shared = [fingerprint.of_table(tables[n]) for n in LUC_TABLES if n in tables]
    common = hashlib.sha256(repr([shared, plan.m, plan.p]).encode()).hexdigest()
    main = {n: df for n, df in tables.items() if n not in LUC_TABLES}
    return fingerprint.by_scenario(main, F.lit(common))


def update(plan: LcaPlan, results: Project, names: Sequence[str] = tuple(RESULTS)) -> DataFrame:
    """Bring the named results of a project up to date; returns the scenarios computed anew.

    A scenario is kept, neither joined nor rewritten, if every named result of it was made
    from the same fingerprint. The others are computed from their own facts alone, and one
    commit shows them and drops scenarios that the facts no longer have.
    """
    spark = plan.facts.spark
    now = materialize(fingerprints(plan), "fingerprints")
    held = results.manifest(spark).where(F.col("title").isin(*names))
    same = held.groupBy("scenario", "fingerprint").agg(F.countDistinct("title").alias("n"))
    kept = same.where(F.col("n") == len(names)).drop("n")
    changed = materialize(now.join(kept, ["scenario", "fingerprint"], "left_anti"), "changed")
    gone = held.select("scenario").distinct().join(now, "scenario", "left_anti")
    if changed.isEmpty():
        if not gone.isEmpty():
            results.withdraw(spark, gone)
        return changed
    run = LcaPlan(plan.facts.of_scenarios(changed), plan.m, plan.p, plan.shared)
    made = run.results(names)
    results.deliver(spark, made, f"run-{uuid.uuid4().hex}", "replace", changed, gone)
    return changed
