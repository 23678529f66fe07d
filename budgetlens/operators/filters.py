"""Row filters, projections and role scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens import schema as S
from budgetlens.functions.bands import tagged
from budgetlens.functions.numeric import to_output


def for_department(f: DataFrame, department: str) -> DataFrame:
    """equality filter; on the S5 layout this is a partition filter."""
    return f.filter(F.col("Department") == F.lit(department))


def for_state(f: DataFrame, state: str) -> DataFrame:
    """equality filter; pushed to Parquet row-group statistics."""
    return f.filter(F.col("State") == F.lit(state))


HIGH_RISK_COLUMNS = ["State", "District", "Ministry", "Department", "Scheme_Name",
                     "Project_ID", "Allocated_Budget_Cr", "Utilization_Percentage",
                     "Delay_Days", "Anomaly_Tag"]


def high_risk(f: DataFrame, threshold: float = S.HIGH_RISK_THRESHOLD,
              delay: int = S.HIGH_RISK_DELAY, n: int = S.HIGH_RISK_LIMIT) -> DataFrame:
    """F2 + F3: projects under the utilization threshold or late beyond
    ``delay`` days (SQL three-valued OR), lowest utilization first, then
    longest delay, top ``n``. The OR is pushed to the Parquet scan."""
    cond = (F.col("Utilization_Percentage") < F.lit(threshold)) | \
           (F.col("Delay_Days") > F.lit(delay))
    out = (f.filter(cond).select(*HIGH_RISK_COLUMNS)
           .orderBy(F.col("Utilization_Percentage").asc_nulls_first(),
                    F.col("Delay_Days").desc_nulls_last(), F.col("Project_ID"))
           .limit(n))
    return to_output(out)


def tagged_anomalies(f: DataFrame, department: str | None = None) -> DataFrame:
    """F10 + F6: rows whose tag, NULL read as 'Normal' and upper-cased, is not
    'NORMAL' (so 'NORMAL' and 'normal' are normal here, unlike the SQL test)."""
    if department is not None:
        f = for_department(f, department)
    return f.filter(tagged("Anomaly_Tag"))


# ---------------------------------------------------------------------------
# F5 role scope

# Which roles may read which dataset.
#   public datasets: everyone, signed in or not
#   "any user": every active (not disabled) user
#   "department": admins see all rows, department users their department only
#   "admin": admins only
DATASET_ACCESS = {
    "summary": "public", "states": "public", "districts": "public",
    "ministries": "public", "departments": "public", "state": "public",
    "department_summary": "any user",
    "anomalies": "department",
    "leakage": "admin", "reallocate": "admin", "high_risk": "admin",
}


def user_entitlement(entitlements: DataFrame, username: str | None):
    """The one entitlement row of ``username`` (usernames are unique), or None.

    An access decision, like the reference's login lookup: at most two rows
    reach the driver, and two means the dimension is broken.
    """
    if username is None:
        return None
    rows = (entitlements.filter(F.col("username") == F.lit(username))
            .select("username", "role", "department", "disabled").limit(2).collect())
    if len(rows) > 1:
        raise ValueError(f"username {username!r} is not unique in entitlements")
    return rows[0] if rows else None


def scope_rows(f: DataFrame, entitlements: DataFrame, username: str | None,
               dataset: str = "anomalies") -> DataFrame:
    """the rows ``username`` may read of ``dataset``.

    The entitlement decides one plain filter, so a department user's read is
    a partition-pruned scan of that department's files.
    """
    access = DATASET_ACCESS.get(dataset, "admin")
    if access == "public":
        return f
    ent = user_entitlement(entitlements, username)
    nothing = f.filter(F.lit(False))
    if ent is None or bool(ent["disabled"]):
        return nothing
    role = ent["role"]
    if access == "any user" or role == "admin":
        return f
    if access == "department" and role == "department" and ent["department"] is not None:
        return for_department(f, ent["department"])
    return nothing


def scope_counts(f: DataFrame, entitlements: DataFrame,
                 dataset: str = "anomalies") -> DataFrame:
    """F5 for every user at once: how many rows each user may read.

    Facts are reduced to one row per department first. Department users get
    their department's count by an equi-join; users who see everything get the
    total as a scalar subquery (one value), so no user is paired with every
    department.
    """
    access = DATASET_ACCESS.get(dataset, "admin")
    per_dept = f.groupBy("Department").agg(F.count(F.lit(1)).alias("n"))
    total = per_dept.agg(F.sum("n")).scalar()   # shares the per-department exchange
    users = entitlements.select("username", "role", F.col("department").alias("user_dept"),
                                F.coalesce(F.col("disabled"), F.lit(False)).alias("disabled"))
    active = ~F.col("disabled")
    if access == "public":
        sees_all, sees_dept = F.lit(True), F.lit(False)
    elif access == "any user":
        sees_all, sees_dept = active, F.lit(False)
    elif access == "department":
        sees_all = active & (F.col("role") == "admin")
        sees_dept = active & (F.col("role") == "department")
    else:
        sees_all, sees_dept = active & (F.col("role") == "admin"), F.lit(False)
    joined = users.join(per_dept, users["user_dept"] == per_dept["Department"], "left")
    visible = (F.when(sees_all, total)
               .when(sees_dept, F.coalesce(F.col("n"), F.lit(0)))
               .otherwise(F.lit(0)))
    return (joined.select("username", visible.cast("bigint").alias("visible_rows"))
            .orderBy("username"))
