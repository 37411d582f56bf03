"""Registry of cells, and what a change reaches."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import scoring, smoothing
from driftline.plans import batch, reach
from driftline.plans.catalogue import ORACLES, QUERIES
from driftline.sources import provenance

SCHEMA = "family string, cell_id string, calendar_group string, series array<double>, start int, stop int"


def cell(family, name, group, n, start=0, stop=None):
    return (family, name, group, [float(i % 7) for i in range(n)], start, start + n if stop is None else stop)


def test_cells_are_recorded_read_back_and_merged(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [cell("1", "a", "g1", 60), cell("1", "b", "g1", 60), cell("1", "few", "g9", 10), ("1", "holes", "g4", [None, float("nan")] * 30 + [1.0] * 55, 5, 60)]
    provenance.record_cells(spark.createDataFrame(rows, SCHEMA), path)
    provenance.record_cells(spark.createDataFrame([cell("2", "c", "g2", 60), cell("2", "d", "g3", 60, 7)], SCHEMA), path)
    provenance.record_cells(spark.createDataFrame([cell("3", "x", "g", 60)], SCHEMA), path, enabled=False)
    back = provenance.load_cells(spark, path)
    assert {(r["family"], r["cell_id"]) for r in back.collect()} == {("1", "a"), ("1", "b"), ("1", "holes"), ("2", "c"), ("2", "d")}
    got = {r["cell_id"]: (r["calendar_group"], r["n"]) for r in provenance.harvest(back, ("1", "2")).collect()}
    assert got == {"a": ("g1+g2", 60), "b": ("g1+g2", 60), "c": ("g1+g2", 60), "d": ("g3", 60), "holes": ("g4", 55)}
    provenance.record_cells(spark.createDataFrame([cell("2", "e", "g2", 61)], SCHEMA), path)  # replaces family 2, leaves 1
    assert {r["cell_id"] for r in provenance.load_cells(spark, path).collect()} == {"a", "b", "holes", "e"}
    with pytest.raises(ValueError, match="no cells of"):
        provenance.harvest(back, ("1", "7"))


def test_ragged_groups_are_refused(spark):
    c = spark.createDataFrame([cell("1", "a", "g", 60), cell("1", "b", "g", 61)], SCHEMA)
    with pytest.raises(ValueError, match="several lengths"):
        provenance.harvest(c)
    same = spark.createDataFrame([cell("1", "a", "g", 60), cell("1", "b", "h", 60)], SCHEMA).withColumn("start", F.lit(None).cast("int")).withColumn("stop", F.lit(None).cast("int"))
    assert {r["calendar_group"] for r in provenance.harvest(same).collect()} == {"g+h"}


def test_a_change_reaches_what_is_made_from_it(spark, tmp_path):
    g = reach.inputs(QUERIES, ORACLES, ("lineitem", "orders", "events"))
    way = reach.affected(g, ["operators.walkforward.position"])
    assert {"walk_forward_one", "walk_forward_rate", "walk_forward_mean", "estimation_cost", "walk_masked_one"} <= set(way)
    assert not {"skill", "ljung_box", "bars_daily", "auc_bootstrap"} & set(way)
    assert way["walk_forward_one"][0] == "operators.walkforward.position" and way["walk_forward_one"][-1] == "walk_forward_one"
    for name, path in way.items():  # each step is a direct reference
        assert all(a in g[b] for a, b in zip(path, path[1:]))
    assert {"structure_stability"} == set(reach.affected(g, ["operators.scoring.structure_stability"])) & set(QUERIES)
    module = set(reach.affected(g, ["operators.filters"])) & set(QUERIES)
    assert module == {"filter_vintages", "live_filter", "walk_filtered", "walk_factor_filter"}
    assert "bars_daily" in reach.affected(g, ["lineitem"])
    with pytest.raises(KeyError):
        reach.affected(g, ["no.such.thing"])
    only = {q: (lambda s, d: s.range(3)) for q in module}
    assert sorted(batch.run(spark, "", str(tmp_path), only, sorted(module))) == sorted(module)


def test_stored_reports_are_compared_without_what_may_vary(spark, tmp_path):
    for name, lines in (("old", ["data folder: /a", "skill  0.51  [0.4,0.6]", "runtime 3 s", "note"]), ("new", ["  data folder: /b", "skill  0.51  [0.4,0.6]  ", "runtime 9 s", "note changed"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "report.txt").write_text("\n".join(lines))
    old, new = (provenance.golden_lines(spark, str(tmp_path / n)) for n in ("old", "new"))
    assert {(r["side"], r["line"]) for r in provenance.differences(old, new).collect()} == {("first", "note"), ("second", "note changed")}
    n = provenance.numbers(old).collect()
    assert [(r["file"], r["key"], r["tokens"]) for r in n] == [("report.txt", "skill", ["0.51", "0.4", "0.6"])]


def test_a_panel_is_read_only_with_its_digest(spark, tmp_path):
    import hashlib

    path = tmp_path / "panel.csv"
    path.write_text("month,NY,LA\n2020-01-01,100.5,n/a\n2020-02-01,101,99\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    got = {(str(r["date"]), r["series_id"]): r["level"] for r in provenance.checked_panel(spark, str(path), digest).collect()}
    assert got == {("2020-01-01", "NY"): 100.5, ("2020-01-01", "LA"): None, ("2020-02-01", "NY"): 101.0, ("2020-02-01", "LA"): 99.0}
    with pytest.raises(ValueError):
        provenance.checked_panel(spark, str(path), "0" * 64)


def test_appraised_marks_and_near_equality(spark):
    df = spark.createDataFrame([("s", 0, 10.0), ("s", 1, 20.0), ("s", 2, None), ("s", 3, 30.0)], "series_id string, t int, v double")
    got = [r["ewma"] for r in smoothing.partial_adjustment(df, "v", 0.25).orderBy("t").collect()]
    assert got[0] == 10.0 and abs(got[1] - 12.5) < 1e-12 and abs(got[2] - 12.5) < 1e-12 and abs(got[3] - 16.875) < 1e-12
    pairs = spark.createDataFrame([(1.0, 1.0 + 1e-14), (1.0, 1.1), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in pairs.select(scoring.same(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
