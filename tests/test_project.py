"""Projects delivered in blocks, the data source over them, and recomputation by change."""

from __future__ import annotations

import os
import shutil

import pytest
from frames import collected
from pyspark.sql import functions as F
from test_plan import facts  # noqa: F401

from wellspring import LcaParams, LcaPlan
from wellspring.plans.update import fingerprints, update
from wellspring.sources import datasource, fingerprint
from wellspring.sources.project import Project, ScenarioConflict

TITLE, OTHER = "CO2 prices", "prices by sector"


def prices(spark, rows):
    full = [("", s, "USACO2", y, v) for s, y, v in rows]
    return spark.createDataFrame(full, "Units string, scenario string, market string, year int, value double")


@pytest.fixture
def project(spark, tmp_path):
    p = Project(str(tmp_path / "project"))
    p.deliver(spark, {TITLE: prices(spark, [("a", 2020, 1.0), ("a", 2025, 2.0), ("b", 2020, 3.0)])}, "one")
    p.deliver(spark, {TITLE: prices(spark, [("2020", 2020, 4.0), ("d:x/y", 2020, 5.0)])}, "two")
    return p


def seen(spark, project, title=TITLE):
    return collected(project.read(spark, title).select("scenario", "year", "value"), "scenario", "year")


BEFORE = {("a", 2020): 1.0, ("a", 2025): 2.0, ("b", 2020): 3.0, ("2020", 2020): 4.0, ("d:x/y", 2020): 5.0}


def test_blocks_are_read_together_and_names_stay_text(spark, project):
    assert seen(spark, project) == BEFORE
    assert project.read(spark, TITLE).schema["scenario"].dataType.simpleString() == "string"


def test_a_block_delivered_again_replaces_what_it_brings(spark, project):
    project.deliver(spark, {TITLE: prices(spark, [("a", 2030, 7.0), ("e", 2020, 8.0)])}, "one")
    kept = {k: v for k, v in BEFORE.items() if k[0] != "a"}
    assert seen(spark, project) == kept | {("a", 2030): 7.0, ("e", 2020): 8.0}


def test_a_scenario_of_another_block_is_refused_or_taken_over(spark, project):
    again = prices(spark, [("b", 2020, 9.0), ("f", 2020, 1.0)])
    with pytest.raises(ScenarioConflict, match="b of CO2 prices is in block one"):
        project.deliver(spark, {TITLE: again}, "two")
    assert seen(spark, project) == BEFORE
    project.deliver(spark, {TITLE: again}, "two", conflict="replace")
    assert seen(spark, project) == BEFORE | {("b", 2020): 9.0, ("f", 2020): 1.0}
    blocks = collected(project.manifest(spark).select("scenario", "block"), "scenario")
    assert blocks["b"] == "two" and blocks["a"] == "one"


def test_a_delivery_that_fails_at_its_second_table_shows_nothing(spark, project):
    good = prices(spark, [("a", 2020, 100.0)])
    bad = prices(spark, [("a", 2020, 1.0)]).withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        project.deliver(spark, {TITLE: good, OTHER: bad}, "one")
    assert seen(spark, project) == BEFORE
    project.deliver(spark, {TITLE: good, OTHER: good}, "one")
    assert seen(spark, project)["a", 2020] == 100.0 and seen(spark, project, OTHER) == {("a", 2020): 100.0}


def test_two_commits_at_once_do_not_both_hold(spark, project, monkeypatch):
    stale = Project._current(project, spark)
    project.deliver(spark, {TITLE: prices(spark, [("g", 2020, 1.0)])}, "three")
    monkeypatch.setattr(Project, "_current", lambda self, s: stale)
    with pytest.raises(RuntimeError, match="someone else"):
        project.deliver(spark, {TITLE: prices(spark, [("h", 2020, 1.0)])}, "four")
    monkeypatch.undo()
    assert seen(spark, project) == BEFORE | {("g", 2020): 1.0}


def test_rows_without_a_scenario_and_unknown_rules_are_refused(spark, project):
    with pytest.raises(ValueError, match="no scenario"):
        project.deliver(spark, {TITLE: prices(spark, [(None, 2020, 1.0)])}, "one")
    with pytest.raises(ValueError, match="conflict"):
        project.deliver(spark, {TITLE: prices(spark, [("a", 2020, 1.0)])}, "one", conflict="both")
    with pytest.raises(ValueError, match="delivered"):
        project.read(spark, OTHER)
    assert seen(spark, project) == BEFORE


def test_vacuum_and_withdrawal(spark, project):
    project.deliver(spark, {TITLE: prices(spark, [("a", 2020, 6.0), ("b", 2020, 6.0)])}, "one")
    assert project.vacuum(spark, [TITLE, OTHER]) == 1
    assert seen(spark, project)["a", 2020] == 6.0
    project.withdraw(spark, spark.createDataFrame([("a",), ("b",)], "scenario string"))
    assert {k[0] for k in seen(spark, project)} == {"2020", "d:x/y"}
    assert project.vacuum(spark, [TITLE]) == 1 and len(project.commits(spark)) == 4


def load(spark, project, title=TITLE, **options):
    datasource.register(spark)
    return spark.read.format("lca_project").option("title", title).options(**options).load(project.root)


def test_data_source_reads_what_the_project_holds(spark, project):
    project.deliver(spark, {TITLE: prices(spark, [("a", 2030, 7.0)])}, "one")
    got = collected(load(spark, project).select("scenario", "year", "value"), "scenario", "year")
    assert got == seen(spark, project)
    blocks = collected(load(spark, project).select("scenario", "block").distinct(), "scenario")
    assert blocks == {"a": "one", "b": "one", "2020": "two", "d:x/y": "two"}
    assert load(spark, project).where("block = 'two' AND year = 2020 AND value > 4").count() == 1


def test_data_source_opens_only_the_files_of_the_wanted_scenario(spark, project):
    for folder, _, files in os.walk(project.root):  # other scenarios' files cannot be read
        if folder.endswith(("scenario=a", "scenario=2020")):
            for f in files:
                if f.endswith(".parquet"):
                    with open(os.path.join(folder, f), "wb") as out:
                        out.write(b"broken")
    assert load(spark, project, scenario="b").count() == 1
    assert load(spark, project, scenario='["b", "d:x/y"]').count() == 2
    assert load(spark, project, like="^d").count() == 1
    assert load(spark, project, scenario="unknown").count() == 0
    with pytest.raises(Exception, match="[Pp]arquet"):
        load(spark, project).count()


def test_options_choose_files_and_conditions_do_not_stick(spark, project):
    schema = datasource.ProjectSource({"path": project.root, "title": TITLE}).schema()

    def chosen(**options):
        parts = datasource.ProjectReader(project.root, TITLE, schema, **options).partitions()
        assert all(f"scenario={p.scenario}" in path.replace("%3A", ":").replace("%2F", "/") for p in parts for path in p.paths)
        return sorted(p.scenario for p in parts)

    assert chosen(scenario="a") == ["a"] and chosen(scenario='["a", "b", "z"]') == ["a", "b"]
    assert chosen(like="^d", block="one") == [] and chosen(block="two") == ["2020", "d:x/y"]
    assert chosen() == ["2020", "a", "b", "d:x/y"]
    rows = load(spark, project)
    assert [rows.where("scenario = 'b'").count(), rows.count(), rows.where("year = 2025").count()] == [1, 5, 1]
    assert rows.where("scenario = 'b'").unionByName(rows.where("scenario = 'a'")).count() == 3


def test_unknown_title_and_empty_project(spark, tmp_path):
    with pytest.raises(Exception, match="is none of"):
        load(spark, Project(str(tmp_path)), "nothing").count()
    assert load(spark, Project(str(tmp_path / "new"))).count() == 0


def test_fingerprints_do_not_depend_on_order_or_layout(spark):
    rows = [("a", k, float(k % 7)) for k in range(200)] + [("b", 1, None), ("b", 1, None)]
    df = prices(spark, rows)
    other = prices(spark, rows[::-1]).repartition(7).select("value", "year", "market", "scenario", "Units")
    prints = lambda d: collected(fingerprint.by_scenario({"t": d}), "scenario")
    assert prints(df) == prints(other)
    for changed in (rows[:-1], rows + rows[:1], [("a", 0, 0.5), *rows[1:]], [("a", 0, None), *rows[1:]]):
        assert prints(prices(spark, changed)) != prints(df)
    assert prints(prices(spark, rows[:-1]))["a"] == prints(df)["a"]
    apart = fingerprint.by_scenario({"t": df, "u": df})
    assert collected(apart, "scenario")["a"] != prints(df)["a"]


P = LcaParams(years=(2020, 2040, 2050), luc_years=tuple(range(2020, 2051)))


def test_only_changed_scenarios_are_computed_anew(spark, facts, tmp_path):  # noqa: F811
    results, names = Project(str(tmp_path / "results")), ["fuels_prices"]
    first = {r.scenario for r in update(LcaPlan(facts, params=P), results, names).collect()}
    assert len(first) == 2
    held = collected(results.manifest(spark).select("scenario", "delivery"), "scenario")
    before = collected(results.read(spark, "fuels_prices").select("scenario", "reporting_fuel", "year", "price_USDperGJ"), "scenario", "reporting_fuel", "year")
    assert update(LcaPlan(facts, params=P), results, names).isEmpty() and len(results.commits(spark)) == 1

    one = sorted(first)[0]
    value = F.when(F.col("scenario") == one, F.col("value") * 2).otherwise(F.col("value"))
    later = facts.__class__(**{**facts.__dict__, "costs_by_tech": facts.costs_by_tech.withColumn("value", value)})
    assert [r.scenario for r in update(LcaPlan(later, params=P), results, names).collect()] == [one]
    now = collected(results.manifest(spark).select("scenario", "delivery"), "scenario")
    assert {s for s in now if now[s] != held[s]} == {one}
    whole = LcaPlan(later, params=P).results(names)["fuels_prices"]
    key = ("scenario", "reporting_fuel", "year")
    after = collected(results.read(spark, "fuels_prices").select(*key, "price_USDperGJ"), *key)
    assert after == collected(whole.select(*key, "price_USDperGJ"), *key)
    assert {k for k in after if after[k] != before[k]} == {k for k in after if k[0] == one}
    # the new delivery holds the changed scenario alone
    folder = os.path.join(results.root, "fuels_prices", f"delivery={now[one]}")
    assert [d for d in os.listdir(folder) if d.startswith("scenario=")] == [f"scenario={one}"]

    gone = later.where(F.col("scenario") != one)
    assert update(LcaPlan(gone, params=P), results, names).isEmpty()
    assert {r.scenario for r in results.manifest(spark).collect()} == first - {one}
    shutil.rmtree(os.path.join(results.root, "fuels_prices", f"delivery={now[one]}"))
    assert results.read(spark, "fuels_prices").count() > 0


def test_parameters_and_land_use_change_every_fingerprint(spark, facts):  # noqa: F811
    base = collected(fingerprints(LcaPlan(facts, params=P)), "scenario")
    other = collected(fingerprints(LcaPlan(facts, params=P.with_(depth=9))), "scenario")
    luc = facts.luc_by_region.withColumn("value", F.col("value") + 1)
    moved = facts.__class__(**{**facts.__dict__, "luc_by_region": luc})
    shifted = collected(fingerprints(LcaPlan(moved, params=P)), "scenario")
    assert base.keys() == other.keys() == shifted.keys()
    assert all(len({base[s], other[s], shifted[s]}) == 3 for s in base)


def test_three_results_are_published_together(spark, facts, tmp_path):  # noqa: F811
    project = LcaPlan(facts, params=P).publish(str(tmp_path / "out"))
    for name in ("fuels_lca_ghg", "fuels_primary_energy", "fuels_prices"):
        assert project.read(spark, name).count() > 0
    assert len(project.commits(spark)) == 1
