"""Look-ups over the zone layout: right rows, few zones, spread of a hot value."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from budgetlens.plans.inspect import partition_filters
from budgetlens.schema import FACT_COLUMNS, FACT_SCHEMA
from budgetlens.session import scratch_path
from budgetlens.sources.zones import (Between, ZONE_TABLE, equal_cuts, lookup, part_of, write_zones,
                                      zones_for)
from tests.conftest import make_facts

SF_LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stored(spark):
    from budgetlens.sources.star import facts
    f = facts(spark, SF_LARGE)
    return f, write_zones(f, scratch_path(spark, "zones"))


def n_files(spark, path, zones=None):
    """Files of the table, or of the given zones."""
    of = [int(re.search(r"/zone=(\d+)/", f)[1]) for f in spark.read.parquet(path).inputFiles()]
    return sum(zones is None or z in zones for z in of)


def test_lookups_return_the_rows_and_open_few_files(spark, stored):
    f, path = stored
    every = n_files(spark, path)
    one, other = f.orderBy("Project_ID").first(), f.orderBy(F.desc("Project_ID")).first()
    asked = [({"State": one.State, "Utilization_Percentage": Between(None, 30)}, 0.15),
             ({"State": one.State, "Year": one.Year}, 0.25), ({"Utilization_Percentage": Between(150, None)}, 0.35),
             ({"Department": one.Department, "State": [one.State, other.State]}, 0.50),
             ({"District": one.District, "Ministry": one.Ministry}, 0.50)]
    for wanted, most in asked:
        df = lookup(spark, path, **wanted)
        want = f
        for c, v in wanted.items():
            if isinstance(v, Between):
                want = want.where((F.col(c) >= v.low) if v.low is not None else (F.col(c) <= v.high))
            else:
                want = want.where(F.col(c).isin(v if isinstance(v, list) else [v]))
        assert df.count() == want.count() > 0
        assert df.exceptAll(want.select(*FACT_COLUMNS)).count() == 0
        # the zones reach the scan as a partition filter, and few files are opened
        zones = zones_for(spark, path, **wanted)
        assert "zone#" in partition_filters(df)[0] and all(re.search(rf"\b{z}\b", partition_filters(df)[0]) for z in zones[:5])
        print(wanted, len(zones), every)
        assert n_files(spark, path, zones) <= most * every, (wanted, len(zones), every)


def test_zone_table_is_true_and_zones_are_even(spark, stored):
    f, path = stored
    table = spark.read.parquet(f"{path}/{ZONE_TABLE}")
    rows = table.collect()
    total = f.count()
    assert sum(r.rows for r in rows) == total and len(rows) > 100
    assert max(r.rows for r in rows) < 20 * total / len(rows)
    data = spark.read.parquet(path)
    wrong = data.join(table, "zone").where((F.col("State") < F.col("State_lo")) | (F.col("State") > F.col("State_hi"))
                                           | (F.col("Utilization_Percentage") > F.col("Utilization_Percentage_hi")))
    assert wrong.isEmpty()


def test_a_hot_department_spans_many_zones(spark):
    n = 6000
    f = spark.range(n).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("Project_ID"), (F.lit(2018) + F.col("id") % 5).cast("int").alias("Year"),
        F.concat(F.lit("S"), (F.col("id") * 7 % 23).cast("string")).alias("State"),
        F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("Dep"), (F.col("id") % 40).cast("string"))).alias("Department"),
        (F.col("id") * 13 % 181).cast("decimal(9,2)").alias("Utilization_Percentage"))
    missing = [c for c in FACT_COLUMNS if c not in f.columns]
    f = f.withColumns({c: F.lit(None).cast(FACT_SCHEMA[c].dataType) for c in missing}).select(*FACT_COLUMNS)
    path = write_zones(f, scratch_path(spark, "hot"), zones=64, file_bytes=64 << 10, size_bytes=2 << 20)
    data = spark.read.parquet(path)
    held = data.where("Department = 'Hot'").groupBy("zone").count().collect()
    assert len(held) > 16 and max(r["count"] for r in held) < n / 3 / 4
    assert lookup(spark, path, Department="Hot").count() == n / 3
    assert n_files(spark, path) >= 64 and data.where("zone = 5").count() > 0
    assert n_files(spark, write_zones(f, scratch_path(spark, "hot"), zones=8, file_bytes=64 << 10, size_bytes=2 << 20)) >= 32  # files by size


def test_nulls_empty_table_and_unknown_values(spark):
    f = make_facts(spark, [{"State": None, "Utilization_Percentage": None}, {"State": "A"}, {"State": "A"}, {"State": "zz", "Year": None}])
    path = write_zones(f, scratch_path(spark, "small"))
    assert lookup(spark, path, State=None).count() == 1
    assert lookup(spark, path, State="A").count() == 2
    assert lookup(spark, path, State="B").count() == 0
    assert lookup(spark, path, Year=None).count() == 1
    assert lookup(spark, path, Utilization_Percentage=Between()).count() == 3
    assert lookup(spark, path, Anomaly_Tag="Normal").count() == 4  # a column without cuts excludes no zone
    empty = write_zones(f.where("1 = 0"), scratch_path(spark, "empty"))
    assert lookup(spark, empty, State="A").count() == 0 and zones_for(spark, empty, State="A") == []


def test_cuts():
    assert equal_cuts([("a", 1), ("b", 1), ("c", 1), ("d", 1)], 2) == ["c"]
    assert equal_cuts([("a", 100), ("b", 1), ("c", 1)], 4) in (["b"], [])
    assert equal_cuts([], 4) == []


def test_part_of_counts_cuts(spark):
    rows = spark.createDataFrame([(i,) for i in [None, -1, 0, 1, 5, 9, 10, 11]], "v int")
    cuts = [0, 2, 5, 7, 10]
    got = [r[0] for r in rows.select(part_of(F.col("v"), cuts)).collect()]
    assert got == [0] + [sum(c <= v for c in cuts) for v in (-1, 0, 1, 5, 9, 10, 11)]
    assert re.match("CASE", str(part_of(F.col("v"), [1])).split("'")[1])
