"""Reports as SQL text over named views, with bound parameters.

The text names views and parameters (``:name``) only; values are bound by Spark
after parsing, so a value that holds quotes or semicolons is a value and nothing
else. ``sql_report`` runs a report of ``REPORTS`` or a text of the caller's.

Each report equals its DataFrame form (decimal sums, total orders) and is planned
the same way: filters on parameters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from budgetlens import schema as S
from budgetlens.functions.numeric import to_output

_MEAN_UTIL = "try_divide(CAST(SUM(Utilization_Percentage) AS DOUBLE), CAST(COUNT(Utilization_Percentage) AS DOUBLE))"
_MEAN_DELAY = "try_divide(CAST(SUM(Delay_Days) AS DOUBLE), CAST(COUNT(Delay_Days) AS DOUBLE))"

#: Report name -> (SQL over the view ``facts``, parameters with their defaults;
#: ``...`` where the caller must give the value).
REPORTS: dict[str, tuple[str, dict]] = {
    "leakage": (f"""
        SELECT State, District, Ministry, Department, Scheme_Name,
               SUM(Allocated_Budget_Cr) AS total_allocated, SUM(Actual_Spending_Cr) AS total_spent,
               {_MEAN_UTIL} AS avg_utilization, SUM(Remaining_Budget_Cr) AS unspent_amount,
               {_MEAN_DELAY} AS avg_delay, COUNT(*) AS record_count
        FROM facts
        GROUP BY State, District, Ministry, Department, Scheme_Name
        HAVING avg_utilization < CAST(:min_utilization AS DOUBLE)
        ORDER BY unspent_amount DESC NULLS LAST, State, District, Ministry, Department, Scheme_Name
        LIMIT :n""", {"min_utilization": S.LEAKAGE_MIN_UTILIZATION, "n": S.LEAKAGE_LIMIT}),
    "high_risk": ("""
        SELECT State, District, Ministry, Department, Scheme_Name, Project_ID, Allocated_Budget_Cr,
               Utilization_Percentage, Delay_Days, Anomaly_Tag
        FROM facts
        WHERE Utilization_Percentage < :threshold OR Delay_Days > :delay
        ORDER BY Utilization_Percentage ASC NULLS FIRST, Delay_Days DESC NULLS LAST, Project_ID
        LIMIT :n""", {"threshold": S.HIGH_RISK_THRESHOLD, "delay": S.HIGH_RISK_DELAY, "n": S.HIGH_RISK_LIMIT}),
    "department": (f"""
        SELECT State, District, SUM(Allocated_Budget_Cr) AS total_allocated, SUM(Actual_Spending_Cr) AS total_spent,
               {_MEAN_UTIL} AS avg_utilization, SUM(Remaining_Budget_Cr) AS total_remaining,
               {_MEAN_DELAY} AS avg_delay, COUNT(CASE WHEN Anomaly_Tag != :normal THEN 1 END) AS anomaly_count
        FROM facts
        WHERE Department = :department
        GROUP BY State, District
        ORDER BY avg_utilization ASC NULLS FIRST, State, District""",
                   {"department": ..., "normal": S.NORMAL_TAG}),
}


def name_views(**tables: DataFrame) -> None:
    """Name DataFrames as views of their session for ``sql_report``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql_report(spark: SparkSession, report: str, **args) -> DataFrame:
    """A report of ``REPORTS`` by name, or a SELECT text of the caller's, with
    ``args`` bound to its parameters. A parameter that the report does not know,
    or one left out that has no default, is an error."""
    if report not in REPORTS:
        return to_output(spark.sql(report, args=args))
    text, defaults = REPORTS[report]
    unknown = sorted(set(args) - set(defaults))
    if unknown:
        raise ValueError(f"report {report} has no parameters {unknown}")
    bound = {**defaults, **args}
    missing = sorted(k for k, v in bound.items() if v is ...)
    if missing:
        raise ValueError(f"report {report} needs {missing}")
    return to_output(spark.sql(text, args=bound))
