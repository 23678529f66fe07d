"""S4 + S7: staged loads, the switch by one rename, refused and killed loads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from budgetlens.schema import FACT_COLUMNS
from budgetlens.session import scratch_path
from budgetlens.sources import commits as C
from tests.conftest import make_facts


def good(spark, n, department="Health"):
    return make_facts(spark, [{"Project_ID": f"{department}{i}", "Department": department} for i in range(n)])


def with_bad(spark, n, bad):
    return make_facts(spark, [{"Project_ID": f"B{i}", "Year": 1500 if i < bad else 2020} for i in range(n)])


def departments(spark, root):
    return sorted((r.Department, r["count"]) for r in C.read_version(spark, root).groupBy("Department").count().collect())


def test_accepted_and_refused_loads(spark):
    root = scratch_path(spark, "t")
    with pytest.raises(FileNotFoundError):
        C.read_version(spark, root)
    first = C.load_facts(good(spark, 5), root)
    assert (first.accepted, first.version, first.good, first.bad) == (True, 1, 5, 0)
    refused = C.load_facts(with_bad(spark, 10, 4), root, max_bad=3)
    assert (refused.accepted, refused.version, refused.bad, refused.data) == (False, 1, 4, None) and "4 of 10" in refused.reason
    assert departments(spark, root) == [("Health", 5)]
    # the bad rows are kept with their reasons
    kept = spark.read.parquet(f"{root}/{refused.rejects}")
    assert kept.count() == 4 and kept.select(F.explode("reasons")).distinct().collect()[0][0] == "Year out of range"
    allowed = C.load_facts(with_bad(spark, 10, 4), root, max_bad_share=0.4)
    assert (allowed.accepted, allowed.version, allowed.good) == (True, 2, 6)
    assert C.read_version(spark, root).columns == FACT_COLUMNS and C.read_version(spark, root).count() == 6
    assert C.read_version(spark, root, 1).count() == 5
    missing = C.load_facts(good(spark, 3).drop("Year"), root)
    assert not missing.accepted and missing.reason == "missing columns: Year" and missing.version == 2
    assert [r.version for r in C.versions(spark, root).collect()] == [1, 2]
    empty = C.load_facts(good(spark, 3).where("1 = 0"), root)
    assert empty.accepted and C.read_version(spark, root).count() == 0


def test_a_load_killed_between_stage_and_switch_changes_nothing(spark, monkeypatch):
    root = scratch_path(spark, "t")
    C.load_facts(good(spark, 5), root)

    class Killed(BaseException):
        pass

    def die(*_, **__):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(C, "_switch", die)
        with pytest.raises(Killed):
            C.load_facts(good(spark, 9, "Roads"), root)
    # the staged rows are there, no reader sees them
    assert departments(spark, root) == [("Health", 5)]
    with monkeypatch.context() as m:  # dies while the good rows are being written
        m.setattr(C, "write_facts", die)
        with pytest.raises(Killed):
            C.load_facts(good(spark, 9, "Ports"), root)
    assert departments(spark, root) == [("Health", 5)] and C.version_info(spark, root)["version"] == 1
    gone = C.vacuum(spark, root, older_than_hours=0)
    assert {g.split("/")[0] for g in gone} == {"data", "rejects", "staging"}
    assert departments(spark, root) == [("Health", 5)]
    assert C.load_facts(good(spark, 2, "Rail"), root).version == 2
    assert departments(spark, root) == [("Rail", 2)]


def test_a_reader_keeps_its_version_and_vacuum_keeps_the_newest(spark):
    root = scratch_path(spark, "t")
    C.load_facts(good(spark, 3), root)
    reader = C.read_version(spark, root)
    C.load_facts(good(spark, 7, "Roads"), root)
    assert reader.count() == 3 and C.read_version(spark, root).count() == 7
    C.load_facts(good(spark, 8, "Rail"), root)
    assert C.vacuum(spark, root, keep=2) == []  # nothing is old enough
    C.vacuum(spark, root, keep=2, older_than_hours=0)
    assert [r.version for r in C.versions(spark, root).collect()] == [2, 3]
    assert C.read_version(spark, root, 2).count() == 7
    with pytest.raises(FileNotFoundError):
        C.read_version(spark, root, 1)


def test_two_loads_cannot_take_one_version(spark):
    root = scratch_path(spark, "t")
    one = C.load_facts(good(spark, 3), root)
    info = {"data": "data/none", "rejects": "rejects/none"}
    with pytest.raises(C.CommitConflict):
        C._switch(spark, root, one.version, info)
    assert C.read_version(spark, root).count() == 3
    fs, folder = C._fs(spark, f"{root}/versions")
    assert sorted(f.getPath().getName() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(".")) == ["000000000001.json"]
