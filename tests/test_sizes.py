"""What a task holds and what is dealt out does not grow with the input."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from budgetlens.operators import aggregates as A
from budgetlens.operators import forest as FO
from budgetlens.operators import quality as Q
from budgetlens.plans.inspect import plan_text
from budgetlens.session import SMALL_METHODS, SMALL_TASKS, scratch_path, settings
from budgetlens.sources import commits as C
from budgetlens.sources import star
from budgetlens.sources import zones as Z
from tests.conftest import make_facts

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_a_task_of_the_build_has_a_bounded_share(spark):
    before = {k: spark.conf.get(k, None) for k in (*SMALL_TASKS, "spark.sql.shuffle.partitions")}
    for gigabytes in (1, 6):
        with star.build_settings(spark, gigabytes << 30):
            assert spark.conf.get(ADVISORY) == "16m"
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= gigabytes * 6 * 32
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_settings_return_after_an_error(spark):
    try:
        with settings(spark, SMALL_METHODS):
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(*SMALL_METHODS, None) is None


def test_the_duplicate_check_does_not_deal_out_the_facts(spark):
    f = make_facts(spark, [{"Project_ID": p} for p in ("", "", "A", "A", "B")]).withColumn("Project_ID", F.nullif("Project_ID", F.lit("")))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        checked = Q.checked_rows(f)
        assert "SortMergeJoin" not in plan_text(checked)
        got = sorted((r.Project_ID or "", r.reasons) for r in checked.collect())
    assert got == [("", ["missing Project_ID"])] * 2 + [("A", ["duplicate Project_ID"])] * 2 + [("B", [])]


def test_a_load_writes_its_rows_once(spark, monkeypatch):
    root, written = scratch_path(spark, "t"), []
    real = C.write_facts
    monkeypatch.setattr(C, "write_facts", lambda df, path, **kw: written.append((df.count(), path)) or real(df, path, **kw))
    rows = [{"Project_ID": f"P{i}", "Department": d, "Year": y} for i, (d, y) in enumerate(
        [("Health", 2020), (None, 2020), ("Roads", 2021), ("", 1500), (None, 1500), ("Roads", 1500)])]
    load = C.load_facts(make_facts(spark, rows), root)
    assert (load.good, load.bad) == (3, 3) and [n for n, _ in written] == [6]   # good and bad rows in one write
    bad = {r.Project_ID: r.Department for r in spark.read.parquet(f"{root}/{load.rejects}").collect()}
    assert bad == {"P3": "", "P4": None, "P5": "Roads"}
    good = {r.Project_ID: r.Department for r in C.read_version(spark, root).collect()}
    assert good == {"P0": "Health", "P1": None, "P2": "Roads"}
    fs, folder = C._fs(spark, f"{root}/staging")
    assert list(fs.listStatus(folder)) == []


def test_the_dense_axis_reads_the_facts_once(spark):
    f = make_facts(spark, [{"Project_ID": "A", "Year": 2020, "Quarter": "Q1"}, {"Project_ID": "B", "Year": 2020, "Quarter": "Q3"}])
    axis = A.development_axis(f)
    assert "Utilization_Percentage" not in plan_text(axis)
    assert [(r.Quarter, r.records, r.quarters_old) for r in axis.collect()] == [("Q1", 1, 0), ("Q2", 0, 1), ("Q3", 1, 0)]


def test_draws_are_tested_in_batches(spark):
    ids = [f"P{i}" for i in range(700)] + [None]
    rows = spark.createDataFrame([("D", p, 1.0, 2.0) for p in ids], "Department string, Project_ID string, x0 double, x1 double")
    drawn = FO.drawn_rows(rows, rows.groupBy("Department").agg(F.count("*").alias("total")), 3, 16, 42)
    assert "MapInArrow" in plan_text(drawn)

    def key(p, t):
        digest = hashlib.md5(f"42-{p}".encode()).hexdigest()
        return (int(digest[:13], 16) + t * int(digest[13:26], 16)) % FO.SPAN

    want = {(t, k, p) for t in range(3) for k, p in sorted((key(p, t), p) for p in ids if p)[:16]}
    assert {(r.tree, r.key, r.Project_ID) for r in drawn.collect()} == want


def test_zones_are_written_with_small_methods(spark, monkeypatch):
    used, real = [], Z.settings
    monkeypatch.setattr(Z, "settings", lambda s, values: used.append(values) or real(s, values))
    f = make_facts(spark, [{"Project_ID": f"P{i}", "Year": 2000 + i % 7} for i in range(50)])
    path = Z.write_zones(f, scratch_path(spark, "zones"))
    assert used == [SMALL_METHODS] and Z.lookup(spark, path, Year=2003).count() == 7
