"""Declared schema of the budget fact table and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Fact columns and their types inside the engine. Money and percentages are
# decimals so sums do not depend on partition order; results are cast to
# double on output (see ``to_output``).
FACT_SCHEMA = T.StructType([
    T.StructField("Project_ID", T.StringType(), False),
    T.StructField("Year", T.IntegerType()),
    T.StructField("Quarter", T.StringType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("State", T.StringType()),
    T.StructField("District", T.StringType()),
    T.StructField("Ministry", T.StringType()),
    T.StructField("Department", T.StringType()),
    T.StructField("Scheme_Name", T.StringType()),
    T.StructField("Allocated_Budget_Cr", T.DecimalType(18, 2)),
    T.StructField("Revised_Budget_Cr", T.DecimalType(18, 4)),
    T.StructField("Actual_Spending_Cr", T.DecimalType(18, 4)),
    T.StructField("Remaining_Budget_Cr", T.DecimalType(18, 4)),
    T.StructField("Utilization_Percentage", T.DecimalType(9, 2)),
    T.StructField("Population_Covered", T.LongType()),
    T.StructField("Beneficiary_Count", T.LongType()),
    T.StructField("District_Development_Index", T.DecimalType(3, 2)),
    T.StructField("Delay_Days", T.IntegerType()),
    T.StructField("Anomaly_Tag", T.StringType()),
])

FACT_COLUMNS = [f.name for f in FACT_SCHEMA.fields]

# --- Fixed values (must equal the reference's for the same results) ---------
# Columns the CSV profiler expects, in its order.
EXPECTED_COLUMNS = ["Year", "Quarter", "Month", "State", "District", "Ministry",
                    "Department", "Scheme_Name", "Allocated_Budget_Cr"]
# The tag that means "no anomaly" in the SQL reports (case-sensitive compare).
NORMAL_TAG = "Normal"
# Report thresholds and caps, as the reference's endpoints default them.
CRITICAL_UNDERSPEND = 50       # summary: util < 50
CRITICAL_OVERSPEND = 150       # summary: util > 150
LEAKAGE_MIN_UTILIZATION = 50   # leakage HAVING mean util < 50
LEAKAGE_LIMIT = 50
UNDER_UTILIZATION = 40         # reallocation: under side mean util < 40
OVER_UTILIZATION = 130         # reallocation: over side mean util > 130
REALLOCATION_CANDIDATES = 10
HIGH_RISK_THRESHOLD = 30       # high risk: util < 30 OR delay > 90
HIGH_RISK_DELAY = 90
HIGH_RISK_LIMIT = 50
ANOMALY_LIMIT = 20
ANOMALY_MIN_ROWS = 10
FOREST_CONTAMINATION = 0.1
FOREST_SEED = 42
FOREST_TREES = 100
FOREST_MAX_SAMPLES = 256
ALERT_THRESHOLD = 30
ALERT_ROWS = 3
ALERT_VIEW_ROWS = 50
# UI bands: utilization below 50 is low, above 120 high; delay above 90 late.
BAND_LOW_UTILIZATION = 50
BAND_HIGH_UTILIZATION = 120
BAND_LATE_DELAY = 90
# Risk-score bands shown by the web client.
RISK_SCORE_HIGH = 0.7
RISK_SCORE_MEDIUM = 0.4
# Alert severities, highest first.
SEVERITIES = ["high", "medium", "low"]
# pandas' default CSV missing-value tokens (read_csv na_values default).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# -----------------------------------------------------------------------------
