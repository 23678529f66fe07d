"""W3 on gaps, and S1 headers with line breaks."""

from __future__ import annotations

import pytest

from budgetlens.operators import aggregates as A
from budgetlens.sources.csv import csv_headers, read_budget
from tests.conftest import make_facts

AXIS = [(2020, "Q3", 10), (2020, "Q4", 20), (2021, "Q2", 50), (2021, "Q2", 70), (2022, "Q1", 5)]


def facts_of(spark, extra=()):
    return make_facts(spark, [{"Year": y, "Quarter": q, "Utilization_Percentage": u} for y, q, u in [*AXIS, *extra]])


def test_change_is_null_after_a_gap_or_as_of(spark):
    f = facts_of(spark)
    got = [(r.Year, r.Quarter, r.utilization_change) for r in A.development_trend(f).collect()]
    assert got == [(2020, "Q3", None), (2020, "Q4", 10.0), (2021, "Q2", None), (2022, "Q1", None)]
    as_of = [r.utilization_change for r in A.development_trend(f, after_gap="as_of").collect()]
    assert as_of == [None, 10.0, 40.0, -55.0]
    with pytest.raises(ValueError):
        A.development_trend(f, after_gap="zero")


def test_axis_is_dense_and_carries_the_last_value(spark):
    f = facts_of(spark, [(None, "Q1", 1), (2021, "H1", 1)])
    got = [(r.Year, r.Quarter, r.records, r.utilization_as_of, r.quarters_old) for r in A.development_axis(f).collect()]
    assert got == [(2020, "Q3", 1, 10.0, 0), (2020, "Q4", 1, 20.0, 0), (2021, "Q1", 0, 20.0, 1), (2021, "Q2", 2, 60.0, 0),
                   (2021, "Q3", 0, 60.0, 1), (2021, "Q4", 0, 60.0, 2), (2022, "Q1", 1, 5.0, 0)]
    odd = {(r.Year, r.Quarter): r.utilization_change for r in A.development_trend(f).collect()}
    assert odd[None, "Q1"] is None and odd[2021, "H1"] is None and odd[2020, "Q4"] == 10.0
    assert A.development_axis(f.where("1 = 0")).collect() == []


@pytest.mark.parametrize("multi_line", [True, False])
def test_header_with_line_breaks_in_quotes(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text('"Project ID","Allocated\nBudget (Cr)",State,"No ""quoted"", name"\nP1,12.5,Goa,x\nP2,7,Kerala,y\n')
    (tmp_path / "b.csv").write_text('\ufeffState,Project ID\nPunjab,P3\n')
    (tmp_path / "c.csv").write_text("")
    headers = csv_headers(spark, [str(tmp_path)])
    assert {h for h in headers} == {("Project ID", "Allocated\nBudget (Cr)", "State", 'No "quoted", name'), ("State", "Project ID")}
    rows = {r.Project_ID: r for r in read_budget(spark, str(tmp_path), multi_line=multi_line).collect()}
    assert set(rows) == {"P1", "P2", "P3"}
    assert float(rows["P1"].Allocated_Budget_Cr) == 12.5 and rows["P2"].State == "Kerala" and rows["P3"].State == "Punjab"


def test_header_without_a_declared_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        read_budget(spark, str(tmp_path))


def test_a_stray_quote_does_not_swallow_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Project ID,5" pipe\nP1,2\nP2,3\n')
    assert [h for h in csv_headers(spark, [str(tmp_path)])] == [("Project ID", '5" pipe')]


def test_many_files_are_grouped_by_header(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"f{i:03}.csv").write_text(("Project ID,State" if i % 2 else "State,Project ID") + f"\nP{i},S\n")
    headers = csv_headers(spark, [str(tmp_path)])
    assert sorted(len(v) for v in headers.values()) == [50, 50]
