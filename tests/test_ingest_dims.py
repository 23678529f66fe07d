"""S1-S3 CSV ingest, S7 checks and quarantine, S8 profile, D4-D6 dimension ops."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from budgetlens.operators import dims as DM
from budgetlens.operators import quality as Q
from budgetlens.session import scratch_path
from budgetlens.sources.csv import clean_name, first_existing, raw_name, read_budget
from tests.conftest import make_facts


def _csv(spark, text):
    import os
    path = scratch_path(spark, "csv")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(f"{local}/budget.csv", "w") as fh:
        fh.write(text)
    return path


def test_clean_and_raw_names():
    assert clean_name(" Allocated Budget (Cr) ") == "Allocated_Budget_Cr"
    assert raw_name("Allocated_Budget_Cr") == "Allocated Budget (Cr)"
    assert clean_name(raw_name("Utilization_Percentage")) == "Utilization_Percentage"


def test_read_budget_na_tokens_blanks_and_headers(spark):
    path = _csv(spark, "\n".join([
        "Project_ID,Year,State,Allocated Budget (Cr),Delay_Days,Anomaly_Tag,Extra Col",
        "P1,2022,Kerala,10.5,NA,None,x",
        "P2,2023,  ,None,12,Normal,y",
        "P3,,Goa,,   ,NaN,z",
        "P4,20x3,Goa,abc,7,High Risk,w",
    ]) + "\n")
    df = read_budget(spark, path, with_source=True, keep_extra=True)
    rows = {r["Project_ID"]: r for r in df.collect()}
    assert rows["P1"]["Allocated_Budget_Cr"] == Decimal("10.50")
    assert rows["P1"]["Delay_Days"] is None and rows["P1"]["Anomaly_Tag"] is None
    assert rows["P2"]["State"] is None and rows["P2"]["Allocated_Budget_Cr"] is None
    assert rows["P3"]["Year"] is None and rows["P3"]["Delay_Days"] is None
    assert rows["P4"]["Year"] is None and rows["P4"]["Allocated_Budget_Cr"] is None
    assert rows["P1"]["Month"] is None          # declared column absent from the file
    assert rows["P1"]["Extra_Col"] == "x" and rows["P1"]["Source_File"] == "budget.csv"
    assert first_existing(spark, ["/no/such/file.csv", f"{path}/*.csv"]) == f"{path}/*.csv"


def test_check_columns_found_similar_missing(spark):
    df = spark.createDataFrame([(1, "a", "b")], "Year int, `State Name` string, Dept string")
    got = {r["column"]: (r["status"], r["similar"]) for r in
           Q.check_columns(df, ["Year", "State", "Department"]).collect()}
    assert got == {"Year": ("found", None), "State": ("similar", "State Name"),
                   "Department": ("missing", None)}


def test_quarantine_rules(spark):
    f = make_facts(spark, [
        {"Project_ID": "ok"},
        {"Project_ID": "dup"}, {"Project_ID": "dup"},
        {"Project_ID": "neg", "Allocated_Budget_Cr": -5, "Actual_Spending_Cr": 1},
        {"Project_ID": "old", "Year": 1800},
    ])
    good, bad = Q.validate_rows(f)
    assert [r["Project_ID"] for r in good.collect()] == ["ok"]
    reasons = {(r["Project_ID"], tuple(r["reasons"])) for r in bad.collect()}
    assert ("dup", ("duplicate Project_ID",)) in reasons
    assert ("old", ("Year out of range",)) in reasons
    # utilization derived from a negative allocation is negative too
    assert ("neg", ("negative Allocated_Budget_Cr", "negative Utilization_Percentage")) in reasons
    summary = {r["reason"]: r["records"] for r in Q.quarantine_summary(f).collect()}
    assert summary["ok"] == 1 and summary["duplicate Project_ID"] == 2


def test_profile_matches_pandas(spark, small_facts):
    prof = {r["column"]: r for r in Q.profile_numeric(
        small_facts, ["Utilization_Percentage", "Delay_Days"]).collect()}
    pdf = small_facts.select("Utilization_Percentage", "Delay_Days").toPandas().astype(float)
    for c in ("Utilization_Percentage", "Delay_Days"):
        s = pdf[c].dropna()
        assert prof[c]["count"] == len(s)
        assert prof[c]["mean"] == pytest.approx(s.mean(), rel=1e-12)
        assert prof[c]["std"] == pytest.approx(s.std(), rel=1e-9)
        for q, k in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            assert prof[c][k] == pytest.approx(float(np.percentile(s, q * 100)), abs=1e-9)


USERS = ("username string, email string, full_name string, role string, "
         "department string, disabled boolean")


def test_upsert_insert_or_replace_named_columns(spark):
    t = spark.createDataFrame([("a", "a@x", "A", "admin", None, False)], USERS)
    c = spark.createDataFrame([("a", "new@x", "A2", "public", None, True),
                               ("b", "b@x", "B", "public", None, False)], USERS)
    got = {r["username"]: r for r in DM.upsert(t, c, ["username"], ["full_name"]).collect()}
    assert got["a"]["full_name"] == "A2" and got["a"]["email"] == "a@x"
    assert got["a"]["role"] == "admin" and got["b"]["email"] == "b@x"


def test_update_where_in(spark):
    t = spark.createDataFrame([("a", None, None, "admin", None, False),
                               ("b", None, None, "public", None, False)], USERS)
    assert [r["disabled"] for r in
            DM.update_where_in(t, "username", ["b"], "disabled", True).orderBy("username")
            .collect()] == [False, True]
    keys = spark.createDataFrame([("a",), ("a",)], "k string")
    got = DM.update_where_in(t, "username", keys, "disabled", True).orderBy("username").collect()
    assert [r["disabled"] for r in got] == [True, False] and len(got) == 2


def test_append_new_rejects(spark):
    t = spark.createDataFrame([("admin", "admin@x", None, "admin", None, False)], USERS)
    new = spark.createDataFrame([
        ("admin", "other@x", None, "public", None, False),   # username taken
        ("u1", "admin@x", None, "public", None, False),      # email taken
        ("u2", None, None, "public", None, False),           # NULL email ok
        ("u3", None, None, "public", None, False),           # second NULL email ok
        ("u4", "d@x", None, "public", None, False),
        ("u4", "e@x", None, "public", None, False),          # repeated in batch
    ], USERS)
    snap, rej = DM.append_new(t, new)
    assert sorted(r["username"] for r in snap.collect()) == ["admin", "u2", "u3", "u4"]
    reasons = {(r["username"], r["email"]): r["reason"] for r in rej.collect()}
    assert reasons == {("admin", "other@x"): "username already registered",
                       ("u1", "admin@x"): "email already registered",
                       ("u4", "e@x"): "username repeated in batch"}


def test_entitlements_from_facts(spark, small_facts):
    ents = DM.entitlements_from_facts(small_facts)
    roles = {r["role"]: r["n"] for r in ents.groupBy("role").agg(F.count("*").alias("n"))
             .collect()}
    assert roles == {"department": 6, "admin": 2, "public": 1}


def test_read_budget_many_files_and_globs(spark):
    import os
    path = _csv(spark, "Project_ID,Year\nA1,2021\nA2,2022\n")
    local = path[len("file:"):] if path.startswith("file:") else path
    with open(f"{local}/more.csv", "w") as fh:
        fh.write("Project_ID,Year\nB1,2023\n")
    with open(f"{local}/notes.txt", "w") as fh:          # not a CSV: skipped
        fh.write("Project_ID,Year\nX,1\n")
    os.makedirs(f"{local}/sub")
    with open(f"{local}/sub/late.csv", "w") as fh:
        fh.write("Project_ID,Year\nC1,2024\n")
    df = read_budget(spark, [path, f"{path}/sub/*.csv"], with_source=True)
    got = {r["Project_ID"]: (r["Year"], r["Source_File"]) for r in df.collect()}
    assert got == {"A1": (2021, "budget.csv"), "A2": (2022, "budget.csv"),
                   "B1": (2023, "more.csv"), "C1": (2024, "late.csv")}


def _file(text):
    import os
    import tempfile
    folder = tempfile.mkdtemp(prefix="budgetlens-csv-")
    with open(os.path.join(folder, "a.csv"), "w") as fh:
        fh.write(text)
    return folder


def test_csv_whole_numbers_quotes_and_line_breaks(spark):
    path = _file('Project_ID,Year,Delay_Days,Population_Covered,District,State\n'
                 'P1,2022.0,45.0,1000.0,"Say ""hi"", ok", NA \n'
                 'P2, 2023 ,4.5,1e3,"two\nlines",NA\n')
    rows = {r["Project_ID"]: r for r in read_budget(spark, path).collect()}
    assert set(rows) == {"P1", "P2"}
    assert (rows["P1"]["Year"], rows["P1"]["Delay_Days"], rows["P1"]["Population_Covered"]) == (2022, 45, 1000)
    assert rows["P1"]["District"] == 'Say "hi", ok' and rows["P1"]["State"] == " NA "
    assert (rows["P2"]["Year"], rows["P2"]["Delay_Days"], rows["P2"]["Population_Covered"]) == (2023, None, 1000)
    assert rows["P2"]["District"] == "two\nlines" and rows["P2"]["State"] is None


def test_csv_files_with_other_column_order(spark):
    a, b = _file("Project_ID,State,Year\nP1,North,2020\n"), _file("State,Project_ID\nSouth,P2\n")
    empty = _file("")
    got = {r["Project_ID"]: (r["State"], r["Year"]) for r in read_budget(spark, [a, b, empty]).collect()}
    assert got == {"P1": ("North", 2020), "P2": ("South", None)}
    assert read_budget(spark, empty, with_source=True).collect() == []


def test_append_is_one_row_after_another(spark):
    t = spark.createDataFrame([("admin", "admin@x", None, "admin", None, False)], USERS)
    row = lambda u, e, n: (u, e, n, "public", None, False)
    new = spark.createDataFrame([row("u0", "z@x", "0"), row("u0", "z@x", "0"),          # identical
                                 row("u1", "a@x", "1"), row("u1", "b@x", "2"),          # username repeated
                                 row("u2", "b@x", "3"),                                 # its e-mail was in a rejected row
                                 row("u3", "a@x", "4")], USERS)
    snap, rej = DM.append_new(t, new, order=["full_name"])
    assert sorted(r["username"] for r in snap.collect()) == ["admin", "u0", "u1", "u2"]
    assert sorted((r["username"], r["reason"]) for r in rej.collect()) == [
        ("u0", "username repeated in batch"), ("u1", "username repeated in batch"), ("u3", "email repeated in batch")]


def test_profile_types_and_large_means(spark):
    df = spark.createDataFrame([(0.000012, 10**15, 10**9, float("nan")), (0.000049, 10**15 + 2, 10**9 + 1, 1.0), (0.000031, None, 10**9 + 2, 3.0)],
                               "small double, big long, far long, holes double")
    p = {r["column"]: r for r in Q.profile_numeric(df).collect()}
    assert p["small"]["min"] == 0.000012 and p["small"]["p50"] == 0.000031
    assert p["big"]["max"] == 10**15 + 2 and p["big"]["std"] == pytest.approx(2**0.5)
    assert p["far"]["std"] == 1.0 and p["far"]["mean"] == 10**9 + 1
    assert p["holes"]["count"] == 2 and p["holes"]["p50"] == 2.0
    none = Q.profile_numeric(df.where("small > 1")).collect()
    assert all(r["count"] == 0 and r["p50"] is None for r in none)


def test_health_probe_can_fail(spark, tmp_path):
    ok = Q.health(spark, spark.range(3).toDF("x")).first()
    assert (ok["status"], ok["records"], ok["table_exists"], ok["error"]) == ("healthy", 3, True, None)
    for bad in (None, str(tmp_path / "nothing")):
        r = Q.health(spark, bad).first()
        assert r["status"] == "unhealthy" and not r["table_exists"] and r["error"]


def test_nan_is_null_in_output_and_records(spark):
    from budgetlens.functions.numeric import to_output
    from budgetlens.sources.sinks import to_records
    df = spark.createDataFrame([(float("nan"), 1.5, float("inf"))], "a double, b double, c double")
    assert tuple(to_output(df).first()) == (None, 1.5, None)
    assert to_records(df).first()["record"] == '{"a":null,"b":1.5,"c":null}'


def test_head_is_ordered(spark):
    f = make_facts(spark, [{"Project_ID": x} for x in ("c", "a", "b")])
    assert [r["Project_ID"] for r in Q.head(f, 2).collect()] == ["a", "b"]
