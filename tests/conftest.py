from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from budgetlens.schema import FACT_COLUMNS, FACT_SCHEMA  # noqa: E402
from budgetlens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="budgetlens-tests")
    yield s
    s.stop()


_DEFAULTS = {
    "Year": 2022, "Quarter": "Q1", "Month": 1, "State": "S1", "District": "D1",
    "Ministry": "M1", "Department": "Health", "Scheme_Name": "Scheme A",
    "Allocated_Budget_Cr": Decimal("100.00"), "Revised_Budget_Cr": Decimal("100.0000"),
    "Actual_Spending_Cr": Decimal("50.0000"), "Remaining_Budget_Cr": Decimal("50.0000"),
    "Utilization_Percentage": Decimal("50.00"), "Population_Covered": 1000,
    "Beneficiary_Count": 100, "District_Development_Index": Decimal("0.50"),
    "Delay_Days": 10, "Anomaly_Tag": "Normal",
}


def _dec(v, scale):
    if v is None or isinstance(v, Decimal):
        return v
    return Decimal(str(v)).quantize(Decimal(1).scaleb(-scale))


def make_facts(spark, rows):
    """Fact rows from dicts; unspecified columns take defaults. Money given as
    numbers is made consistent (remaining = allocated - spent,
    utilization = 100 * spent / allocated) unless given explicitly."""
    out = []
    for i, r in enumerate(rows):
        d = dict(_DEFAULTS)
        d["Project_ID"] = r.get("Project_ID", f"P{i:05d}")
        d.update(r)
        if "Allocated_Budget_Cr" in r or "Actual_Spending_Cr" in r:
            a = _dec(d["Allocated_Budget_Cr"], 2)
            s = _dec(d["Actual_Spending_Cr"], 4)
            d["Allocated_Budget_Cr"], d["Actual_Spending_Cr"] = a, s
            if "Remaining_Budget_Cr" not in r and a is not None and s is not None:
                d["Remaining_Budget_Cr"] = _dec(a - s, 4)
            if "Utilization_Percentage" not in r and a and s is not None:
                d["Utilization_Percentage"] = _dec(s * 100 / a, 2)
        for c, sc in (("Allocated_Budget_Cr", 2), ("Revised_Budget_Cr", 4),
                      ("Actual_Spending_Cr", 4), ("Remaining_Budget_Cr", 4),
                      ("Utilization_Percentage", 2), ("District_Development_Index", 2)):
            d[c] = _dec(d[c], sc)
        out.append(tuple(d[c] for c in FACT_COLUMNS))
    return spark.createDataFrame(out, FACT_SCHEMA)


@pytest.fixture(scope="session")
def small_facts(spark):
    from budgetlens.sources.star import facts
    return facts(spark, SF_SMALL)
