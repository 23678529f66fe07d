"""The full allocation against a two-pointer walk."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from budgetlens.operators import allocation as AL
from budgetlens.plans.inspect import plan_text

SCHEMA = "State string, District string, Department string, Scheme_Name string, utilization double, side string, amount decimal(38,4)"


def walk(rows):
    """Two pointers per department."""
    out = defaultdict(Decimal)
    for dept in {r[2] for r in rows}:
        lists = {s: sorted(([-r[6], r[0] or "", r[1], r[3], r] for r in rows if r[2] == dept and r[5] == s), key=lambda x: x[:4]) for s in ("under", "over")}
        left = {s: [[x[4], x[4][6]] for x in lists[s]] for s in lists}
        i = j = 0
        while i < len(left["under"]) and j < len(left["over"]):
            u, o = left["under"][i], left["over"][j]
            m = min(u[1], o[1])
            out[dept, u[0][:2] + u[0][3:4], o[0][:2] + o[0][3:4]] += m
            u[1] -= m
            o[1] -= m
            i += u[1] == 0
            j += o[1] == 0
    return dict(out)


def got(spark, rows):
    df = AL.transfers(AL.laid_out(spark.createDataFrame(rows, SCHEMA)))
    out = defaultdict(Decimal)
    for r in df.collect():
        key = (r.under.Department, (r.under.State, r.under.District, r.under.Scheme_Name), (r.over.State, r.over.District, r.over.Scheme_Name))
        assert key not in out
        out[key] = r.amount
    return dict(out)


def random_rows(seed, n, departments, small=False):
    rng = random.Random(seed)
    return [(f"S{i}", f"D{i % 7}", rng.choice(departments), f"scheme {i}", 1.0, rng.choice(["under", "over"]),
             Decimal(rng.randint(1, 5 if small else 10**9)) / (1 if small else 10**4)) for i in range(n)]


@pytest.mark.parametrize("seed,small", [(1, False), (2, True), (3, True)])
def test_equals_a_two_pointer_walk(spark, seed, small):
    """One department has most rows, so it lies in several ranges; small whole
    amounts make many intervals end at the same place."""
    rows = random_rows(seed, 500, ["Hot"] * 8 + ["A", "B", None], small)
    assert got(spark, rows) == walk(rows)


def test_one_sided_departments_and_empty_input(spark):
    rows = [("S", "D", "A", "x", 1.0, "under", Decimal(5)), ("S", "D", "B", "y", 1.0, "over", Decimal(5))]
    assert got(spark, rows) == {} and got(spark, []) == {}
    rows = [("S", "D", "A", "x", 1.0, "under", Decimal("1000000000000.0001"))] + [
        (f"S{i}", "D", "A", "y", 1.0, "over", Decimal("0.0001")) for i in range(300)]
    assert got(spark, rows) == walk(rows) and len(walk(rows)) == 300


def test_sums_are_conserved_and_no_scheme_gives_more_than_it_has(spark, small_facts):
    groups = AL.sides(AL.scheme_groups(small_facts), 40, 130)
    total = {(r.Department, r.side): r.s for r in groups.groupBy("Department", "side").agg(F.sum("amount").alias("s")).collect()}
    moved = AL.transfers(AL.laid_out(groups))
    per = {r.d: r.s for r in moved.groupBy(F.col("under.Department").alias("d")).agg(F.sum("amount").alias("s")).collect()}
    want = {d: min(total[d, "under"], total[d, "over"]) for d, s in total if s == "under" and (d, "over") in total}
    assert per == want and len(per) > 3
    for side in ("under", "over"):
        over = moved.groupBy(F.col(f"{side}.State"), F.col(f"{side}.District"), F.col(f"{side}.Department"), F.col(f"{side}.Scheme_Name")).agg(
            F.sum("amount").alias("moved"), F.max(f"{side}.amount").alias("has")).where("moved > has")
        assert over.isEmpty()
    # rank pairing moves less
    from budgetlens.operators.reallocate import reallocate_within_department
    assert sum(per.values()) > reallocate_within_department(small_facts, 10**6).agg(F.sum("suggested_amount")).first()[0]


def test_windows_over_rows_run_inside_ranges(spark, small_facts):
    """Only the one-row-per-range tables have a window over a whole department."""
    text = plan_text(AL.transfers(AL.laid_out(AL.sides(AL.scheme_groups(small_facts), 40, 130))))
    tree = text.split("\n\n")[0]
    assert tree.count("Window (") == 2  # in the ranges; over the heads
    assert "CartesianProduct" not in text and "NestedLoop" not in text
