"""DuckDB oracle SQL per registered query, over the driver's tables.

Each statement rebuilds the fact table from the driver tables with the same
mapping (``FACTS_CTE``) and then states the report in plain SQL. Conventions
that keep both engines equal: sums in decimal then DOUBLE, means as
DOUBLE sum / count, counts as BIGINT, explicit NULLS FIRST/LAST, total orders.
"""

from __future__ import annotations

FACTS_CTE = """
WITH base AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
         l.l_extendedprice, l.l_shipdate, o.o_orderdate, o.o_orderpriority,
         n.n_name, p.p_brand, p.p_type, p.p_size,
         CAST(c.c_custkey % 7 AS INTEGER) AS k7,
         CAST(trunc(l.l_quantity) AS INTEGER) + 22 * CAST(c.c_custkey % 7 AS INTEGER) AS u,
         CASE WHEN l.l_linenumber = 7 THEN NULL
              ELSE CAST(abs(date_diff('day', CAST(o.o_orderdate AS DATE),
                                      CAST(l.l_shipdate AS DATE))) % 121 AS INTEGER) END AS dl,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS alloc,
         CAST(100 + CAST(round(l.l_tax * 100) AS INTEGER) AS DECIMAL(5,0)) AS rev
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
), facts AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
      CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
      strftime(l_shipdate, '%Y%m%d') AS Project_ID,
    CAST(year(o_orderdate) AS INTEGER) AS Year,
    'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS Quarter,
    CAST(month(o_orderdate) AS INTEGER) AS Month,
    n_name AS State,
    'D' || CAST(k7 AS VARCHAR) AS District,
    p_brand AS Ministry,
    p_type AS Department,
    o_orderpriority AS Scheme_Name,
    alloc AS Allocated_Budget_Cr,
    CAST(alloc * rev / 100 AS DECIMAL(18,4)) AS Revised_Budget_Cr,
    CAST(alloc * CAST(u AS DECIMAL(5,0)) / 100 AS DECIMAL(18,4)) AS Actual_Spending_Cr,
    CAST(alloc - CAST(alloc * CAST(u AS DECIMAL(5,0)) / 100 AS DECIMAL(18,4))
         AS DECIMAL(18,4)) AS Remaining_Budget_Cr,
    CAST(u AS DECIMAL(9,2)) AS Utilization_Percentage,
    CAST(p_size AS BIGINT) * 1000 AS Population_Covered,
    CAST(l_quantity * 100 AS BIGINT) AS Beneficiary_Count,
    CAST((k7 + 2) / 10 AS DECIMAL(3,2)) AS District_Development_Index,
    dl AS Delay_Days,
    CASE WHEN l_quantity = 50 THEN NULL
         WHEN u < 30 THEN 'Underspending'
         WHEN u > 150 THEN 'Overspending'
         WHEN dl > 90 THEN 'Delayed Release'
         WHEN l_linenumber = 6 THEN 'NORMAL'
         ELSE 'Normal' END AS Anomaly_Tag
  FROM base
)
"""

MEAN_UTIL = ("CAST(SUM(Utilization_Percentage) AS DOUBLE) / "
             "COUNT(Utilization_Percentage)")
MEAN_DELAY = "CAST(SUM(Delay_Days) AS DOUBLE) / COUNT(Delay_Days)"
SQL_ANOMALY = "Anomaly_Tag != 'Normal'"
TAGGED = "upper(coalesce(Anomaly_Tag, 'Normal')) != 'NORMAL'"


def fixed1(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,1)) AS VARCHAR)"


def _q(body: str) -> str:
    return FACTS_CTE + body


ORACLES: dict[str, str] = {}

ORACLES["budget_facts"] = _q("""
SELECT Project_ID, Year, Quarter, Month, State, District, Ministry, Department,
       Scheme_Name,
       CAST(Allocated_Budget_Cr AS DOUBLE) AS Allocated_Budget_Cr,
       CAST(Revised_Budget_Cr AS DOUBLE) AS Revised_Budget_Cr,
       CAST(Actual_Spending_Cr AS DOUBLE) AS Actual_Spending_Cr,
       CAST(Remaining_Budget_Cr AS DOUBLE) AS Remaining_Budget_Cr,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage,
       Population_Covered, Beneficiary_Count,
       CAST(District_Development_Index AS DOUBLE) AS District_Development_Index,
       Delay_Days, Anomaly_Tag
FROM facts
""")

ORACLES["leakage"] = _q(f"""
SELECT State, District, Ministry, Department, Scheme_Name,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS total_spent,
       {MEAN_UTIL} AS avg_utilization,
       CAST(SUM(Remaining_Budget_Cr) AS DOUBLE) AS unspent_amount,
       {MEAN_DELAY} AS avg_delay,
       CAST(COUNT(*) AS BIGINT) AS record_count
FROM facts
GROUP BY State, District, Ministry, Department, Scheme_Name
HAVING {MEAN_UTIL} < 50
ORDER BY SUM(Remaining_Budget_Cr) DESC NULLS LAST, State NULLS FIRST,
         District NULLS FIRST, Ministry NULLS FIRST, Department NULLS FIRST,
         Scheme_Name NULLS FIRST
LIMIT 50
""")

ORACLES["summary"] = _q(f"""
SELECT CAST(COUNT(DISTINCT State) AS BIGINT) AS total_states,
       CAST(COUNT(DISTINCT District) AS BIGINT) AS total_districts,
       CAST(COUNT(DISTINCT Ministry) AS BIGINT) AS total_ministries,
       CAST(COUNT(DISTINCT Department) AS BIGINT) AS total_departments,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_allocated_cr,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS total_spent_cr,
       {MEAN_UTIL} AS avg_utilization,
       CAST(SUM(CASE WHEN Utilization_Percentage < 50 THEN 1 ELSE 0 END) AS BIGINT)
         AS critical_underspend,
       CAST(SUM(CASE WHEN Utilization_Percentage > 150 THEN 1 ELSE 0 END) AS BIGINT)
         AS critical_overspend,
       CAST(SUM(Allocated_Budget_Cr) - SUM(Actual_Spending_Cr) AS DOUBLE) AS total_waste_cr
FROM facts
""")

ORACLES["department_summary"] = _q(f"""
SELECT Department, State, District,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS total_spent,
       {MEAN_UTIL} AS avg_utilization,
       CAST(SUM(Remaining_Budget_Cr) AS DOUBLE) AS total_remaining,
       {MEAN_DELAY} AS avg_delay,
       CAST(COUNT(CASE WHEN {SQL_ANOMALY} THEN 1 END) AS BIGINT) AS anomaly_count
FROM facts
GROUP BY Department, State, District
""")

_SCHEME_GROUPS = f"""
, g AS (
  SELECT State, District, Department, Scheme_Name,
         SUM(Allocated_Budget_Cr) AS allocated,
         {MEAN_UTIL} AS utilization,
         SUM(Remaining_Budget_Cr) AS surplus,
         SUM(Actual_Spending_Cr) - SUM(Allocated_Budget_Cr) AS deficit
  FROM facts GROUP BY State, District, Department, Scheme_Name
)
"""
_KEYS_ORDER = ("State NULLS FIRST, District NULLS FIRST, Department NULLS FIRST, "
               "Scheme_Name NULLS FIRST")

ORACLES["underutilized"] = _q(_SCHEME_GROUPS + f"""
SELECT State, District, Department, Scheme_Name,
       CAST(allocated AS DOUBLE) AS allocated, utilization,
       CAST(surplus AS DOUBLE) AS surplus
FROM g WHERE utilization < 40
ORDER BY g.surplus DESC NULLS LAST, {_KEYS_ORDER}
LIMIT 10
""")

ORACLES["overutilized"] = _q(_SCHEME_GROUPS + f"""
SELECT State, District, Department, Scheme_Name,
       CAST(allocated AS DOUBLE) AS allocated, utilization,
       CAST(deficit AS DOUBLE) AS deficit
FROM g WHERE utilization > 130
ORDER BY g.deficit DESC NULLS LAST, {_KEYS_ORDER}
LIMIT 10
""")

_REALLOC_AMOUNT = ("CAST(round(least(u.surplus * 0.7, CASE WHEN o.deficit > 0 "
                   "THEN o.deficit * 0.5 ELSE u.surplus * 0.3 END), 2) AS DOUBLE)")

ORACLES["reallocate"] = _q(_SCHEME_GROUPS + f"""
, u AS (
  SELECT *, row_number() OVER (ORDER BY surplus DESC NULLS LAST, {_KEYS_ORDER}) AS rk
  FROM (SELECT * FROM g WHERE utilization < 40
        ORDER BY surplus DESC NULLS LAST, {_KEYS_ORDER} LIMIT 10)
), o AS (
  SELECT *, row_number() OVER (ORDER BY deficit DESC NULLS LAST, {_KEYS_ORDER}) AS rk
  FROM (SELECT * FROM g WHERE utilization > 130
        ORDER BY deficit DESC NULLS LAST, {_KEYS_ORDER} LIMIT 10)
)
SELECT CAST(u.rk AS INTEGER) AS rank,
       coalesce(u.District, 'None') || ', ' || coalesce(u.State, 'None') AS from_location,
       coalesce(o.District, 'None') || ', ' || coalesce(o.State, 'None') AS to_location,
       u.Department AS department,
       u.Scheme_Name AS scheme,
       {fixed1('u.utilization')} || '%' AS current_utilization_from,
       {fixed1('o.utilization')} || '%' AS current_utilization_to,
       {_REALLOC_AMOUNT} AS suggested_amount_cr,
       'Reallocate from underutilized (' || {fixed1('u.utilization')} ||
         '%) to overburdened (' || {fixed1('o.utilization')} || '%) scheme' AS reason
FROM u JOIN o ON u.rk = o.rk AND u.Department = o.Department
""")

ORACLES["reallocate_within_department"] = _q(_SCHEME_GROUPS + f"""
, u AS (
  SELECT *, row_number() OVER (PARTITION BY Department ORDER BY surplus DESC NULLS LAST,
         State NULLS FIRST, District NULLS FIRST, Scheme_Name NULLS FIRST) AS rk
  FROM g WHERE utilization < 40
), o AS (
  SELECT *, row_number() OVER (PARTITION BY Department ORDER BY deficit DESC NULLS LAST,
         State NULLS FIRST, District NULLS FIRST, Scheme_Name NULLS FIRST) AS rk
  FROM g WHERE utilization > 130
)
SELECT u.Department AS Department, CAST(u.rk AS INTEGER) AS rank,
       u.District AS from_district, u.State AS from_state,
       o.District AS to_district, o.State AS to_state,
       u.Scheme_Name AS from_scheme, o.Scheme_Name AS to_scheme,
       u.utilization AS from_utilization, o.utilization AS to_utilization,
       {_REALLOC_AMOUNT} AS suggested_amount,
       'Reallocate from underutilized (' || {fixed1('u.utilization')} ||
         '%) to overburdened (' || {fixed1('o.utilization')} || '%) scheme' AS reason
FROM u JOIN o ON u.Department = o.Department AND u.rk = o.rk
WHERE u.rk <= 10 AND o.rk <= 10
""")

ORACLES["state_summary"] = _q(f"""
SELECT State, District, Department,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS spent,
       {MEAN_UTIL} AS utilization,
       {MEAN_DELAY} AS avg_delay
FROM facts GROUP BY State, District, Department
""")

ORACLES["department_rollup"] = _q(f"""
, r AS (
  SELECT State, District, Department,
         SUM(Allocated_Budget_Cr) AS allocated, SUM(Actual_Spending_Cr) AS spent,
         {MEAN_UTIL} AS utilization
  FROM facts GROUP BY State, District, Department
)
SELECT State, Department,
       CAST(round(SUM(allocated), 1) AS DOUBLE) AS allocated,
       CAST(round(SUM(spent), 1) AS DOUBLE) AS spent,
       CAST(CAST(SUM(coalesce(utilization, 0.0)) / COUNT(*) AS DECIMAL(18,1)) AS DOUBLE)
         AS utilization,
       CAST(COUNT(*) AS BIGINT) AS district_rows
FROM r GROUP BY State, Department
""")

ORACLES["conditional_counts"] = _q(f"""
SELECT Department,
       CAST(SUM(CASE WHEN {SQL_ANOMALY} THEN 1 ELSE 0 END) AS BIGINT) AS sum_case,
       CAST(COUNT(CASE WHEN {SQL_ANOMALY} THEN 1 END) AS BIGINT) AS count_case,
       CAST(COUNT(*) AS BIGINT) AS records
FROM facts GROUP BY Department
""")

ORACLES["spend_share"] = _q("""
, t AS (
  SELECT CAST(coalesce(SUM(Actual_Spending_Cr), 0) AS DOUBLE) AS spent,
         CAST(coalesce(SUM(Allocated_Budget_Cr) - SUM(Actual_Spending_Cr), 0) AS DOUBLE)
           AS unspent
  FROM facts
)
SELECT 'Spent' AS name, spent AS value, spent / (spent + unspent) AS share FROM t
UNION ALL
SELECT 'Unspent' AS name, unspent AS value, unspent / (spent + unspent) AS share FROM t
""")

ORACLES["anomaly_counts"] = _q("""
SELECT Anomaly_Tag, CAST(COUNT(*) AS BIGINT) AS records FROM facts GROUP BY Anomaly_Tag
""")

ORACLES["anomaly_tag_kpis"] = _q(f"""
SELECT Department, CAST(COUNT(*) AS BIGINT) AS total_records,
       CAST(COUNT(CASE WHEN {TAGGED} THEN 1 END) AS BIGINT) AS tagged_anomalies
FROM facts GROUP BY Department
""")

ORACLES["breakdown"] = _q(f"""
SELECT Ministry, Department, Quarter,
       CAST(GROUPING(Ministry, Department, Quarter) AS INTEGER) AS level,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS spent,
       {MEAN_UTIL} AS avg_utilization,
       CAST(COUNT(*) AS BIGINT) AS records
FROM facts GROUP BY ROLLUP (Ministry, Department, Quarter)
""")

ORACLES["leakage_by_location"] = _q(f"""
SELECT State, District,
       CAST(SUM(Remaining_Budget_Cr) AS DOUBLE) AS unspent_amount,
       {MEAN_UTIL} AS avg_utilization,
       CAST(COUNT(*) AS BIGINT) AS records
FROM facts GROUP BY State, District
""")

ORACLES["context_stats"] = _q(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS records,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_allocated_cr,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS total_spent_cr,
       {MEAN_UTIL} AS avg_utilization,
       CAST(COUNT(CASE WHEN {SQL_ANOMALY} THEN 1 END) AS BIGINT) AS anomaly_count,
       CAST(COUNT(DISTINCT Department) AS BIGINT) AS departments
FROM facts
""")

# a calendar of its own: all quarters of the facts' years for every district
_TREND = f"""
, g AS (
  SELECT State, District, Year, Quarter,
         CAST(SUM(District_Development_Index) AS DOUBLE) / COUNT(District_Development_Index)
           AS avg_index,
         {MEAN_UTIL} AS avg_utilization,
         CAST(COUNT(*) AS BIGINT) AS records
  FROM facts GROUP BY State, District, Year, Quarter
), calendar AS (
  SELECT y AS Year, 'Q' || CAST(q AS VARCHAR) AS Quarter, row_number() OVER (ORDER BY y, q) AS k
  FROM (SELECT unnest(generate_series((SELECT min(Year) FROM facts), (SELECT max(Year) FROM facts))) AS y),
       (SELECT unnest([1, 2, 3, 4]) AS q)
), axis AS (
  SELECT p.State, p.District, c.Year, c.Quarter, c.k, g.avg_index, g.avg_utilization, g.records
  FROM (SELECT DISTINCT State, District FROM g) p CROSS JOIN calendar c
  LEFT JOIN g ON g.State = p.State AND g.District = p.District AND g.Year = c.Year AND g.Quarter = c.Quarter
)
"""
ORACLES["development_trend"] = _q(_TREND + """
SELECT a.State, a.District, CAST(a.Year AS INTEGER) AS Year, a.Quarter, a.avg_index, a.avg_utilization, a.records,
       a.avg_utilization - b.avg_utilization AS utilization_change, a.avg_index - b.avg_index AS index_change
FROM axis a LEFT JOIN axis b ON b.State = a.State AND b.District = a.District AND b.k = a.k - 1
WHERE a.records > 0
""")
ORACLES["development_axis"] = _q(_TREND + """
, ends AS (SELECT State, District, min(k) AS lo, max(k) AS hi FROM axis WHERE records > 0 GROUP BY State, District),
known AS (SELECT a.State, a.District, a.Year, a.Quarter, a.k, a.records, max(b.k) AS at
          FROM axis a JOIN ends e ON e.State = a.State AND e.District = a.District AND a.k BETWEEN lo AND hi
          JOIN axis b ON b.State = a.State AND b.District = a.District AND b.k <= a.k AND b.records > 0
          GROUP BY a.State, a.District, a.Year, a.Quarter, a.k, a.records)
SELECT x.State, x.District, CAST(x.Year AS INTEGER) AS Year, x.Quarter, CAST(coalesce(x.records, 0) AS BIGINT) AS records,
       v.avg_index AS index_as_of, v.avg_utilization AS utilization_as_of, CAST(x.k - x.at AS INTEGER) AS quarters_old
FROM known x JOIN axis v ON v.State = x.State AND v.District = x.District AND v.k = x.at
""")

ORACLES["list_states"] = _q("SELECT DISTINCT State FROM facts")
ORACLES["list_ministries"] = _q("SELECT DISTINCT Ministry FROM facts")
ORACLES["list_departments"] = _q("SELECT DISTINCT Department FROM facts")
ORACLES["list_districts"] = _q("SELECT DISTINCT State, District FROM facts")

ORACLES["page_more"] = _q("""
, s AS (SELECT State, District, Department FROM facts GROUP BY State, District, Department)
SELECT CAST(COUNT(*) AS BIGINT) AS total,
       CAST(least(COUNT(*), 20) AS BIGINT) AS shown,
       CAST(greatest(COUNT(*) - 20, 0) AS BIGINT) AS more
FROM s
""")

ORACLES["high_risk"] = _q("""
SELECT State, District, Ministry, Department, Scheme_Name, Project_ID,
       CAST(Allocated_Budget_Cr AS DOUBLE) AS Allocated_Budget_Cr,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage,
       Delay_Days, Anomaly_Tag
FROM facts
WHERE Utilization_Percentage < 30 OR Delay_Days > 90
ORDER BY Utilization_Percentage ASC NULLS FIRST, Delay_Days DESC NULLS LAST, Project_ID
LIMIT 50
""")

ORACLES["tagged_anomalies"] = _q(f"""
SELECT Department, Project_ID, Anomaly_Tag,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage, Delay_Days
FROM facts WHERE {TAGGED}
""")

ORACLES["top_per_department"] = _q("""
SELECT Department, Project_ID, State, District,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage, Delay_Days,
       CAST(rk AS INTEGER) AS rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY Department ORDER BY
         Utilization_Percentage ASC NULLS FIRST, Delay_Days DESC NULLS LAST, Project_ID) AS rk
  FROM facts
) WHERE rk <= 5
""")

ORACLES["anomaly_gate"] = _q("""
SELECT Department, CAST(COUNT(*) AS BIGINT) AS total_records,
       COUNT(*) >= 10 AS eligible,
       CASE WHEN COUNT(*) < 10 THEN 'Not enough data for ML detection' END AS message
FROM facts GROUP BY Department
""")

RISK_SCORE = f"""
  (CAST(0.5 AS DOUBLE) * coalesce(least(greatest((CAST(30.0 AS DOUBLE)
       - CAST(Utilization_Percentage AS DOUBLE)) / CAST(30.0 AS DOUBLE), 0.0::DOUBLE),
       1.0::DOUBLE), 0.0::DOUBLE)
   + CAST(0.3 AS DOUBLE) * coalesce(least(greatest(CAST(Delay_Days AS DOUBLE)
       / CAST(180.0 AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE))
   + CAST(0.2 AS DOUBLE) * (CASE WHEN {TAGGED} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
"""

ORACLES["risk_score"] = _q(f"""
, s AS (SELECT Department, Project_ID, {RISK_SCORE} AS risk_score FROM facts)
SELECT Department, Project_ID, risk_score,
       CASE WHEN risk_score > 0.7 THEN 'high' WHEN risk_score > 0.4 THEN 'medium'
            ELSE 'low' END AS risk_band
FROM s
""")

ORACLES["flag_by_contamination"] = _q(f"""
, s AS (SELECT Department, Project_ID, {RISK_SCORE} AS risk_score FROM facts)
, t AS (SELECT Department, quantile_cont(risk_score, 0.9) AS thr FROM s GROUP BY Department)
SELECT s.Department AS Department, s.Project_ID AS Project_ID, s.risk_score AS risk_score
FROM s JOIN t ON s.Department = t.Department
WHERE s.risk_score > t.thr
""")

ORACLES["bands"] = _q("""
SELECT Project_ID,
       CASE WHEN Utilization_Percentage < 50 THEN 'low'
            WHEN Utilization_Percentage > 120 THEN 'high'
            WHEN Utilization_Percentage IS NOT NULL THEN 'ok' END AS utilization_band,
       CASE WHEN Delay_Days > 90 THEN 'late'
            WHEN Delay_Days IS NOT NULL THEN 'on_time' END AS delay_band
FROM facts
""")

ORACLES["risk_level"] = _q("""
, c AS (
  SELECT Project_ID,
         coalesce(Utilization_Percentage > 150 OR Utilization_Percentage < 30, false) AS money,
         coalesce(Delay_Days > 90, false) AS late
  FROM facts
)
SELECT Project_ID, CASE WHEN money AND late THEN 'High' WHEN money OR late THEN 'Medium'
                        ELSE 'Low' END AS risk_level
FROM c
""")

ORACLES["label_truncate"] = _q("""
, n AS (SELECT DISTINCT concat_ws(' / ', Department, Scheme_Name) AS name FROM facts)
SELECT name, CASE WHEN length(name) > 15 THEN substr(name, 1, 15) || '…' ELSE name END
         AS label
FROM n
""")


def _compact_sql(x: str) -> str:
    c = f"CAST({x} AS DECIMAL(30,4))"
    arms = []
    for step, unit, recip in ((10_000_000, "Cr", "0.0000001"), (100_000, "L", "0.00001"),
                              (1_000, "T", "0.001")):
        scaled = f"{c} * CAST('{recip}' AS DECIMAL({len(recip) - 2},{len(recip) - 2}))"
        arms.append(f"WHEN abs({c}) >= {step} THEN {fixed1(scaled)} || '{unit}'")
    return ("CASE " + " ".join(arms) +
            f" ELSE CAST(CAST({c} AS DECIMAL(38,0)) AS VARCHAR) END")


ORACLES["compact_amount"] = _q(f"""
, g AS (SELECT State, SUM(Allocated_Budget_Cr) AS cr, COUNT(*) AS n FROM facts GROUP BY State)
SELECT State,
       {_compact_sql('cr * 10000000')} AS total_text,
       {_compact_sql('n')} AS projects_text,
       {fixed1("CAST(cr AS DECIMAL(30,4)) * CAST('0.001' AS DECIMAL(3,3))")} || 'K Cr'
         AS total_k_cr
FROM g
""")

# S1, S3, S4 round trips return the fact table itself
ORACLES["ingest_csv"] = ORACLES["budget_facts"]
ORACLES["clean_columns"] = ORACLES["budget_facts"]
ORACLES["ingest_roundtrip"] = ORACLES["budget_facts"]

ORACLES["ingest_stats"] = _q("""
SELECT CAST(COUNT(*) AS BIGINT) AS records,
       CAST(COUNT(DISTINCT State) AS BIGINT) AS states,
       CAST(COUNT(DISTINCT District) AS BIGINT) AS districts,
       CAST(COUNT(DISTINCT Ministry) AS BIGINT) AS ministries,
       MIN(Year) AS min_year, MAX(Year) AS max_year,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_budget
FROM facts
""")

ORACLES["quarantine"] = _q("""
, d AS (SELECT Project_ID FROM facts WHERE Project_ID IS NOT NULL
        GROUP BY Project_ID HAVING COUNT(*) > 1)
, r AS (
  SELECT list_filter([
      CASE WHEN f.Project_ID IS NULL THEN 'missing Project_ID' END,
      CASE WHEN Allocated_Budget_Cr < 0 THEN 'negative Allocated_Budget_Cr' END,
      CASE WHEN Revised_Budget_Cr < 0 THEN 'negative Revised_Budget_Cr' END,
      CASE WHEN Actual_Spending_Cr < 0 THEN 'negative Actual_Spending_Cr' END,
      CASE WHEN Utilization_Percentage < 0 THEN 'negative Utilization_Percentage' END,
      CASE WHEN Year < 1900 OR Year > 2100 THEN 'Year out of range' END,
      CASE WHEN d.Project_ID IS NOT NULL THEN 'duplicate Project_ID' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM facts f LEFT JOIN d ON f.Project_ID = d.Project_ID
)
SELECT 'ok' AS reason, CAST(COUNT(*) AS BIGINT) AS records FROM r WHERE len(reasons) = 0
UNION ALL
SELECT reason, CAST(COUNT(*) AS BIGINT) AS records
FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
""")

_PROFILE_COLUMNS = ["Year", "Month", "Allocated_Budget_Cr", "Revised_Budget_Cr",
                    "Actual_Spending_Cr", "Remaining_Budget_Cr", "Utilization_Percentage",
                    "Population_Covered", "Beneficiary_Count", "District_Development_Index",
                    "Delay_Days"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DECIMAL(18,4)) AS value FROM facts"
    for c in _PROFILE_COLUMNS)

ORACLES["profile_numeric"] = _q(f"""
, long AS ({_LONG})
, m AS (
  SELECT "column", COUNT(value) AS cnt, SUM(value) AS s1,
         CAST(MIN(value) AS DOUBLE) AS mn, CAST(MAX(value) AS DOUBLE) AS mx
  FROM long GROUP BY "column"
)
-- deviations from the mean's integer part, as exact decimals
, dev AS (
  SELECT "column", SUM(x) AS a, SUM(CAST(x AS DECIMAL(38,4)) * CAST(x AS DECIMAL(38,4))) AS b
  FROM (SELECT "column", CAST(value - CAST(floor(CAST(s1 AS DOUBLE) / CAST(cnt AS DOUBLE)) AS DECIMAL(18,0)) AS DECIMAL(18,4)) AS x
        FROM long JOIN m USING ("column") WHERE value IS NOT NULL)
  GROUP BY "column"
)
-- quartiles by their definition (linear interpolation between order
-- statistics) in exact decimal arithmetic, cast to DOUBLE once
, r AS (
  SELECT "column", value,
         row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS i,
         COUNT(*) OVER (PARTITION BY "column") AS cnt
  FROM long WHERE value IS NOT NULL
)
, k AS (
  SELECT DISTINCT "column", cnt,
         CAST(0.25 AS DECIMAL(3,2)) * (cnt - 1) AS k25,
         CAST(0.50 AS DECIMAL(3,2)) * (cnt - 1) AS k50,
         CAST(0.75 AS DECIMAL(3,2)) * (cnt - 1) AS k75
  FROM r
)
, q AS (
  SELECT r."column",
    CAST(max(CASE WHEN i = floor(k25) THEN value END)
         + (max(CASE WHEN i = least(floor(k25) + 1, k.cnt - 1) THEN value END)
            - max(CASE WHEN i = floor(k25) THEN value END)) * max(k25 - floor(k25))
         AS DOUBLE) AS p25,
    CAST(max(CASE WHEN i = floor(k50) THEN value END)
         + (max(CASE WHEN i = least(floor(k50) + 1, k.cnt - 1) THEN value END)
            - max(CASE WHEN i = floor(k50) THEN value END)) * max(k50 - floor(k50))
         AS DOUBLE) AS p50,
    CAST(max(CASE WHEN i = floor(k75) THEN value END)
         + (max(CASE WHEN i = least(floor(k75) + 1, k.cnt - 1) THEN value END)
            - max(CASE WHEN i = floor(k75) THEN value END)) * max(k75 - floor(k75))
         AS DOUBLE) AS p75
  FROM r JOIN k ON r."column" = k."column"
  GROUP BY r."column"
)
SELECT m."column" AS "column", CAST(cnt AS BIGINT) AS count,
       CAST(s1 AS DOUBLE) / CAST(cnt AS DOUBLE) AS mean,
       sqrt((CAST(dev.b AS DOUBLE) - CAST(dev.a AS DOUBLE) * CAST(dev.a AS DOUBLE) / CAST(cnt AS DOUBLE))
            / (CAST(cnt AS DOUBLE) - 1.0)) AS std,
       mn AS min, p25, p50, p75, mx AS max
FROM m LEFT JOIN q ON m."column" = q."column" LEFT JOIN dev ON m."column" = dev."column"
""")

ORACLES["health"] = _q("""
SELECT 'healthy' AS status, CAST(COUNT(*) AS BIGINT) AS records, true AS table_exists,
       CAST(NULL AS VARCHAR) AS error
FROM facts
""")

_ALERTS = """
  SELECT Project_ID, 'critical_underspend' AS type, 'high' AS severity,
         'Critical Underspend: ' || coalesce(District, 'None') AS title,
         coalesce(Department, 'None') || ' in ' || coalesce(District, 'None') || ', ' ||
           coalesce(State, 'None') || ' — allocated ₹' ||
           coalesce(CAST(CAST(Allocated_Budget_Cr AS DECIMAL(38,1)) AS VARCHAR), 'None') ||
           'Cr but spent only ₹' ||
           coalesce(CAST(CAST(Actual_Spending_Cr AS DECIMAL(38,1)) AS VARCHAR), 'None') ||
           'Cr' AS message,
         CAST(make_date(Year, Month, 1) AS TIMESTAMP) AS ts
  FROM facts WHERE Utilization_Percentage < 30
"""

ORACLES["alert_candidates"] = _q(f"""
, a AS ({_ALERTS})
SELECT Project_ID, type, severity, title, message FROM a
""")

ORACLES["alert_view"] = _q(f"""
, a AS ({_ALERTS})
SELECT Project_ID, type, severity, title, message,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, Project_ID AS alert_id
FROM a ORDER BY ts DESC NULLS LAST, Project_ID LIMIT 50
""")

ORACLES["alert_unread"] = _q(f"""
, a AS ({_ALERTS})
SELECT CAST(COUNT(*) AS BIGINT) AS unread, CAST(COUNT(*) AS BIGINT) AS alerts FROM (SELECT * FROM a LIMIT 50)
""")

ORACLES["alert_stream"] = _q(f"""
, a AS ({_ALERTS})
, b AS (SELECT *, ('0x' || substr(md5(Project_ID), 1, 8))::BIGINT % 4 AS batch_id FROM a)
, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id
                                     ORDER BY md5('42-' || batch_id || '-' || Project_ID), Project_ID) AS k FROM b)
SELECT Project_ID, type, severity, title, message, batch_id || '-' || Project_ID AS alert_id, batch_id
FROM r WHERE k <= 3
""")

ORACLES["json_records"] = ORACLES["leakage"]

_SLUG = "lower(regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g'))"
_USERS = f"""
, users AS (
  SELECT {_SLUG.format(c='Department')} || '_dept' AS username,
         {_SLUG.format(c='Department')} || '_dept@gov.in' AS email,
         upper(substr(lower(Department), 1, 1)) || substr(lower(Department), 2) || ' Officer'
           AS full_name,
         'department' AS role, Department AS department, false AS disabled
  FROM (SELECT DISTINCT Department FROM facts WHERE Department IS NOT NULL)
  UNION ALL SELECT 'admin', 'admin@gov.in', 'Admin User', 'admin', NULL, false
  UNION ALL SELECT 'public_user', 'public@citizen.in', 'Public User', 'public', NULL, false
  UNION ALL SELECT 'retired_admin', NULL, 'Retired Admin', 'admin', NULL, true
)
"""

ORACLES["scoped_rows"] = _q("""
SELECT Project_ID, Department, State,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage
FROM facts WHERE Department = (SELECT min(Department) FROM facts)
""")

ORACLES["scope_counts"] = _q(_USERS + """
, per AS (SELECT Department, COUNT(*) AS n FROM facts GROUP BY Department)
SELECT u.username AS username, CAST(coalesce(SUM(p.n), 0) AS BIGINT) AS visible_rows
FROM users u LEFT JOIN per p
  ON NOT coalesce(u.disabled, false) AND (u.role = 'admin' OR
     (u.role = 'department' AND u.department = p.Department))
GROUP BY u.username
""")

ORACLES["dim_upsert"] = _q(_USERS + f"""
, ch AS (
  SELECT username, email,
         upper(substr(lower(department), 1, 1)) || substr(lower(department), 2) || ' Head'
           AS full_name, role, department, disabled
  FROM users WHERE role = 'department'
  UNION ALL
  SELECT {_SLUG.format(c='Ministry')} || '_min', NULL, Ministry, 'public', NULL, false
  FROM (SELECT DISTINCT Ministry FROM facts)
)
SELECT coalesce(t.username, c.username) AS username,
       CASE WHEN t.username IS NOT NULL THEN t.email ELSE c.email END AS email,
       CASE WHEN c.username IS NOT NULL THEN c.full_name ELSE t.full_name END AS full_name,
       CASE WHEN t.username IS NOT NULL THEN t.role ELSE c.role END AS role,
       CASE WHEN t.username IS NOT NULL THEN t.department ELSE c.department END AS department,
       CASE WHEN t.username IS NOT NULL THEN t.disabled ELSE c.disabled END AS disabled
FROM users t FULL OUTER JOIN ch c ON t.username = c.username
""")

ORACLES["dim_update"] = _q(_USERS + f"""
, k AS (SELECT {_SLUG.format(c='Department')} || '_dept' AS username FROM facts
        GROUP BY Department HAVING SUM(Remaining_Budget_Cr) < 0)
SELECT u.username, u.email, u.full_name, u.role, u.department,
       CASE WHEN k.username IS NOT NULL THEN true ELSE u.disabled END AS disabled
FROM users u LEFT JOIN k ON u.username = k.username
""")

_ORDER_ALL = ("username NULLS FIRST, email NULLS FIRST, full_name NULLS FIRST, "
              "role NULLS FIRST, department NULLS FIRST, disabled NULLS FIRST")

ORACLES["dim_append"] = _q(_USERS + f"""
, nw AS (
  SELECT {_SLUG.format(c='Ministry')} || '_min' AS username,
         {_SLUG.format(c='Ministry')} || '.' || {_SLUG.format(c='Scheme_Name')} || '@gov.in'
           AS email,
         Ministry AS full_name, 'public' AS role, CAST(NULL AS VARCHAR) AS department,
         false AS disabled
  FROM (SELECT DISTINCT Ministry, Scheme_Name FROM facts)
  UNION ALL
  SELECT {_SLUG.format(c='Department')} || '_dept', NULL, Department, 'department',
         Department, false
  FROM (SELECT DISTINCT Department FROM facts)
  UNION ALL
  SELECT {_SLUG.format(c='State')} || '_public', 'public@citizen.in', State, 'public',
         NULL, false
  FROM (SELECT DISTINCT State FROM facts)
  UNION ALL SELECT * FROM (VALUES
    ('zz_twin', 'twin@gov.in', 'Twin', 'public', NULL, false), ('zz_twin', 'twin@gov.in', 'Twin', 'public', NULL, false),
    ('admin', 'chain@gov.in', 'Chain', 'public', NULL, false), ('zz_chain', 'chain@gov.in', 'Chain', 'public', NULL, false),
    ('zz_late', 'twin@gov.in', 'Late', 'public', NULL, false))
)
-- one row after another: what is taken so far decides on the next row
, numbered AS (SELECT *, row_number() OVER (ORDER BY {_ORDER_ALL}) AS i FROM nw)
, ins AS (
  SELECT 0::BIGINT AS i, (SELECT list(username) FROM users WHERE username IS NOT NULL) AS u0,
         (SELECT list(email) FROM users WHERE email IS NOT NULL) AS e0,
         []::VARCHAR[] AS u, []::VARCHAR[] AS e, NULL::VARCHAR AS reason
  UNION ALL
  SELECT i, u0, e0,
         CASE WHEN why IS NULL AND username IS NOT NULL THEN list_append(u, username) ELSE u END,
         CASE WHEN why IS NULL AND email IS NOT NULL THEN list_append(e, email) ELSE e END, why
  FROM (SELECT n.i, u0, e0, u, e, n.username, n.email,
          CASE WHEN list_contains(u0, n.username) THEN 'username already registered'
               WHEN list_contains(e0, n.email) THEN 'email already registered'
               WHEN list_contains(u, n.username) THEN 'username repeated in batch'
               WHEN list_contains(e, n.email) THEN 'email repeated in batch' END AS why
        FROM ins JOIN numbered n ON n.i = ins.i + 1)
)
SELECT username, email, full_name, role, department, disabled,
       CAST(NULL AS VARCHAR) AS reason FROM users
UNION ALL
SELECT n.username, n.email, n.full_name, n.role, n.department, n.disabled, ins.reason
FROM ins JOIN numbered n ON n.i = ins.i
""").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES["department_one"] = _q(f"""
SELECT State, District,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS total_allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS total_spent,
       {MEAN_UTIL} AS avg_utilization,
       CAST(SUM(Remaining_Budget_Cr) AS DOUBLE) AS total_remaining,
       {MEAN_DELAY} AS avg_delay,
       CAST(COUNT(CASE WHEN {SQL_ANOMALY} THEN 1 END) AS BIGINT) AS anomaly_count
FROM facts WHERE Department = (SELECT min(Department) FROM facts)
GROUP BY State, District
""")

ORACLES["state_one"] = _q(f"""
SELECT District, Department,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS allocated,
       CAST(SUM(Actual_Spending_Cr) AS DOUBLE) AS spent,
       {MEAN_UTIL} AS utilization,
       {MEAN_DELAY} AS avg_delay
FROM facts WHERE State = (SELECT min(State) FROM facts)
GROUP BY District, Department
""")

ORACLES["first_projects"] = ORACLES["budget_facts"] + "ORDER BY Project_ID LIMIT 5\n"

ORACLES["ingest_many_csv"] = _q("""
SELECT Year, State, CAST(COUNT(*) AS BIGINT) AS projects,
       CAST(SUM(Allocated_Budget_Cr) AS DOUBLE) AS allocated,
       CAST(COUNT(*) AS BIGINT) AS with_source
FROM facts GROUP BY Year, State
""")


def _forest_sql(trees: int = 100, rows: int = 256, seed: int = 42, levels: int = 8) -> str:
    """CTEs that fit and score the isolation forest: every tree's draw of rows,
    eight levels of splits, and the walk of every distinct point."""
    span = 2**52 - 47
    sql = f"""
, feats AS (
  SELECT Department, Project_ID, coalesce(CAST(Utilization_Percentage AS DOUBLE), 0.0) AS x0,
         coalesce(CAST(Delay_Days AS DOUBLE), 0.0) AS x1,
         ('0x' || substr(md5('{seed}-' || Project_ID), 1, 13))::BIGINT AS a,
         ('0x' || substr(md5('{seed}-' || Project_ID), 14, 13))::BIGINT AS b
  FROM facts)
, dept AS (
  SELECT Department, least(COUNT(*), {rows}) AS psi, ceil(log2(least(COUNT(*), {rows})))::INT AS deepest
  FROM feats GROUP BY Department HAVING COUNT(*) >= 10)
, c AS (
  SELECT n, CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0
    ELSE 2.0 * (ln(n - 1.0) + 0.5772156649015329::DOUBLE) - 2.0 * (n - 1.0) / n END::DOUBLE AS c FROM range(1, {rows + 1}) t(n))
, r0 AS (
  SELECT Department, tree, 1 AS node, x0, x1 FROM (
    SELECT f.*, t.tree, (f.a + t.tree * f.b) % {span} AS key FROM feats f JOIN dept USING (Department), range({trees}) t(tree))
  QUALIFY row_number() OVER (PARTITION BY Department, tree ORDER BY key, Project_ID, x0, x1) <= {rows})
, p0 AS (
  SELECT q.*, t.tree, 1 AS node FROM (SELECT DISTINCT Department, x0, x1 FROM feats JOIN dept USING (Department)) q, range({trees}) t(tree))"""
    for d in range(levels + 1):
        sql += f"""
, g{d} AS (
  SELECT Department, tree, node, COUNT(*) AS n, min(x0) AS lo0, max(x0) AS hi0, min(x1) AS lo1, max(x1) AS hi1,
         md5('{seed}-' || Department || '-' || tree || '-' || node) AS m
  FROM r{d} GROUP BY ALL)
, s{d} AS (
  SELECT Department, tree, node, f, CASE WHEN lo + u * (hi - lo) >= hi THEN lo ELSE lo + u * (hi - lo) END AS t FROM (
    SELECT *, CASE WHEN f = 0 THEN lo0 ELSE lo1 END AS lo, CASE WHEN f = 0 THEN hi0 ELSE hi1 END AS hi FROM (
      SELECT *, CASE WHEN hi0 > lo0 AND hi1 > lo1 THEN ('0x' || substr(m, 1, 8))::BIGINT % 2 WHEN hi0 > lo0 THEN 0 ELSE 1 END AS f,
             ('0x' || substr(m, 9, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM g{d} JOIN dept USING (Department) WHERE {d} < deepest AND n > 1 AND (hi0 > lo0 OR hi1 > lo1))))
, r{d + 1} AS (
  SELECT r.Department, r.tree, r.node * 2 + (CASE WHEN s.f = 0 THEN x0 ELSE x1 END > s.t)::INT AS node, x0, x1
  FROM r{d} r JOIN s{d} s USING (Department, tree, node))
, v{d} AS (
  SELECT p.Department, p.x0, p.x1, {d} + c.c AS value
  FROM p{d} p JOIN g{d} g USING (Department, tree, node) JOIN c ON c.n = g.n
       ANTI JOIN s{d} s ON s.Department = p.Department AND s.tree = p.tree AND s.node = p.node)
, p{d + 1} AS (
  SELECT p.Department, p.x0, p.x1, p.tree, p.node * 2 + (CASE WHEN s.f = 0 THEN x0 ELSE x1 END > s.t)::INT AS node
  FROM p{d} p JOIN s{d} s USING (Department, tree, node))"""
    values = " UNION ALL ".join(f"SELECT * FROM v{d}" for d in range(levels + 1))
    return sql + f"""
, scored AS (
  SELECT Department, x0, x1, round(pow(2.0, -round(sum(value) / {trees}, 9) / any_value(c.c)), 9) AS anomaly_score
  FROM ({values}) JOIN dept USING (Department) JOIN c ON c.n = psi GROUP BY Department, x0, x1)
, rated AS (
  SELECT f.Department, f.Project_ID, s.anomaly_score
  FROM feats f JOIN scored s ON f.Department = s.Department AND f.x0 = s.x0 AND f.x1 = s.x1)
, limits AS (SELECT Department, quantile_cont(anomaly_score, 0.9) AS threshold FROM rated GROUP BY Department)
, ml AS (
  SELECT r.Department, r.Project_ID, r.anomaly_score FROM rated r JOIN limits USING (Department)
  WHERE r.anomaly_score > threshold)
"""


_FOREST = _forest_sql()

ORACLES["ml_anomalies"] = _q(_FOREST + """
SELECT ml.Department, ml.Project_ID, State, District,
       CAST(Utilization_Percentage AS DOUBLE) AS Utilization_Percentage, Delay_Days, anomaly_score
FROM ml JOIN facts USING (Project_ID)
""")

ORACLES["anomaly_kpis"] = _q(_FOREST + f"""
, k AS (SELECT Department, COUNT(*) AS found FROM ml GROUP BY Department)
SELECT f.Department, CAST(COUNT(*) AS BIGINT) AS total_records,
       CAST(coalesce(any_value(found), 0) AS BIGINT) AS ml_anomalies_found,
       CAST(COUNT(CASE WHEN {TAGGED} THEN 1 END) AS BIGINT) AS tagged_anomalies,
       CAST(coalesce(any_value(found), 0) AS DOUBLE) / COUNT(*) AS anomaly_rate
FROM facts f LEFT JOIN k USING (Department) GROUP BY f.Department
""")

ORACLES["all_anomalies"] = _q(_FOREST + f"""
, both_lists AS (
  SELECT Department, Project_ID, 0 AS source, anomaly_score FROM ml
  UNION ALL SELECT Department, Project_ID, 1, NULL FROM facts WHERE {TAGGED})
SELECT Department, Project_ID, source, anomaly_score,
       CAST(row_number() OVER (PARTITION BY Department ORDER BY source, Project_ID) AS INT) AS position
FROM both_lists QUALIFY position <= 20
""")

_LOOKUPS = {
    "state and utilization": "State = (SELECT min(State) FROM facts) AND Utilization_Percentage <= 30",
    "department and year": "Department = (SELECT min(Department) FROM facts) AND Year = (SELECT max(Year) FROM facts)",
    "district and ministry": "District = (SELECT max(District) FROM facts) AND Ministry = (SELECT min(Ministry) FROM facts)",
    "high utilization": "Utilization_Percentage >= 150",
    "two states in a year": "State IN (SELECT min(State) FROM facts UNION ALL SELECT max(State) FROM facts) AND Year = (SELECT min(Year) FROM facts)",
}
ORACLES["zone_lookups"] = _q(" UNION ALL ".join(f"""
SELECT '{name}' AS lookup, count(*) AS projects, count(DISTINCT Project_ID) AS project_ids,
       CAST(sum(Allocated_Budget_Cr) AS DOUBLE) AS allocated,
       CAST(min(Utilization_Percentage) AS DOUBLE) AS lowest, CAST(max(Utilization_Percentage) AS DOUBLE) AS highest
FROM facts WHERE {where}""" for name, where in _LOOKUPS.items()))

ORACLES["commit_loads"] = _q("""
, every AS (SELECT count(*) AS n, sum(Actual_Spending_Cr) AS spent, max(Year) AS y FROM facts),
bad_year AS (SELECT count(*) AS b FROM facts, every WHERE Year = y),
few AS (SELECT count(*) AS b, sum(Actual_Spending_Cr) AS spent FROM facts, every
        WHERE Year = y AND Quarter = 'Q1' AND State = (SELECT min(State) FROM facts)),
l AS (
  SELECT 'facts' AS load, 1 AS k, n AS records, CAST(0 AS BIGINT) AS bad, CAST(0 AS DECIMAL(38,4)) AS lost FROM every
  UNION ALL SELECT 'a bad year', 2, n, b, NULL FROM every, bad_year
  UNION ALL SELECT 'no column', 3, NULL, NULL, NULL
  UNION ALL SELECT 'a few bad rows', 4, n, b, coalesce(few.spent, 0) FROM every, few),
judged AS (SELECT l.*, coalesce(bad <= 0.02 * records, false) AS accepted FROM l),
seen AS (SELECT a.load, a.accepted, a.records, a.bad, CAST(count(b.k) AS BIGINT) AS version, max(b.k) AS at
         FROM judged a JOIN judged b ON b.k <= a.k AND b.accepted GROUP BY a.load, a.accepted, a.records, a.bad)
SELECT seen.load, seen.accepted, seen.version, coalesce(seen.records, 0) AS records, coalesce(seen.bad, 0) AS bad,
       of.records - of.bad AS rows_seen, CAST(every.spent - of.lost AS DOUBLE) AS spent_seen,
       CASE WHEN of.bad < (SELECT b FROM bad_year) OR of.k = 1 THEN y ELSE y - 1 END AS last_year
FROM seen JOIN judged of ON of.k = seen.at, every
""")

ORACLES["allocate_surplus"] = _q(_SCHEME_GROUPS + """
, amounts AS (
  SELECT State, District, Department, Scheme_Name, utilization,
         CASE WHEN utilization < 40 THEN 'under' WHEN utilization > 130 THEN 'over' END AS side,
         CAST(CASE WHEN utilization < 40 THEN surplus ELSE deficit END AS DECIMAL(38,4)) AS amount
  FROM g),
laid AS (
  SELECT *, sum(amount) OVER (PARTITION BY Department, side
              ORDER BY amount DESC, State NULLS FIRST, District NULLS FIRST, Scheme_Name NULLS FIRST ROWS UNBOUNDED PRECEDING) AS hi
  FROM amounts WHERE side IS NOT NULL AND amount > 0)
SELECT u.Department, u.District AS from_district, u.State AS from_state, u.Scheme_Name AS from_scheme,
       o.District AS to_district, o.State AS to_state, o.Scheme_Name AS to_scheme,
       u.utilization AS from_utilization, o.utilization AS to_utilization,
       CAST(u.hi - u.amount AS DOUBLE) AS from_offset,
       CAST(least(u.hi, o.hi) - greatest(u.hi - u.amount, o.hi - o.amount) AS DOUBLE) AS amount,
       CAST(o.amount - (least(u.hi, o.hi) - greatest(u.hi - u.amount, o.hi - o.amount)) AS DOUBLE) AS other_need
FROM laid u JOIN laid o ON u.Department IS NOT DISTINCT FROM o.Department AND u.side = 'under' AND o.side = 'over'
  AND u.hi - u.amount < o.hi AND o.hi - o.amount < u.hi
""")

# kept up to date by deliveries, the reports equal the full ones
ORACLES["incremental_summary"] = ORACLES["summary"]
ORACLES["incremental_departments"] = ORACLES["department_summary"]
ORACLES["incremental_states"] = ORACLES["state_summary"]
ORACLES["incremental_context"] = ORACLES["context_stats"]

# the same reports stated as SQL with bound parameters
ORACLES["sql_leakage"] = ORACLES["leakage"]
ORACLES["sql_high_risk"] = ORACLES["high_risk"]
ORACLES["sql_department"] = ORACLES["department_one"]

ORACLES["sketch_distincts"] = FACTS_CTE + " UNION ALL ".join(
    f"""
SELECT Department, '{c}' AS counted, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS exact, true AS within
FROM facts GROUP BY Department""" for c in ("Project_ID", "State", "District", "Ministry", "Scheme_Name"))

# readings of a key with less than 150 days between them make a session; inside it
# only readings under 30 or from 40 on decide, and a change of side is an event.
# What is open at the end of a session expires once the time is known to be over
# (the newest reading less a day).
ORACLES["alert_lifecycle"] = _q(f"""
, r AS (SELECT State, District, Scheme_Name, {MEAN_UTIL} AS utilization,
               make_date(Year, CAST(substr(Quarter, 2, 1) AS INTEGER) * 3 - 2, 1) AS moment
        FROM facts GROUP BY State, District, Scheme_Name, Year, Quarter)
, ended AS (SELECT max(moment) - 1 AS known FROM r WHERE utilization IS NOT NULL)
, gaps AS (SELECT *, CASE WHEN moment - lag(moment) OVER k >= 150 THEN 1 ELSE 0 END AS starts FROM r WHERE utilization IS NOT NULL
           WINDOW k AS (PARTITION BY State, District, Scheme_Name ORDER BY moment))
, sessions AS (SELECT *, sum(starts) OVER (PARTITION BY State, District, Scheme_Name ORDER BY moment) AS session FROM gaps)
, lasts AS (SELECT State, District, Scheme_Name, session, max(moment) AS last_at FROM sessions GROUP BY ALL)
, sides AS (SELECT *, lag(utilization < 30) OVER (PARTITION BY State, District, Scheme_Name, session ORDER BY moment) AS before
            FROM sessions WHERE utilization < 30 OR utilization >= 40)
, turns AS (SELECT * FROM sides WHERE (utilization < 30) != coalesce(before, false))
, told AS (SELECT *, lag(moment) OVER w AS opened_at, lead(moment) OVER w AS closed_at FROM turns
           WINDOW w AS (PARTITION BY State, District, Scheme_Name, session ORDER BY moment))
, events AS (
  SELECT State, District, Scheme_Name, 'opened' AS kind, moment, moment AS since, utilization FROM told WHERE utilization < 30
  UNION ALL
  SELECT State, District, Scheme_Name, 'recovered', moment, opened_at, utilization FROM told WHERE utilization >= 40
  UNION ALL
  SELECT t.State, t.District, t.Scheme_Name, 'expired', l.last_at + 150, t.moment, NULL
  FROM told t JOIN lasts l ON l.State IS NOT DISTINCT FROM t.State AND l.District IS NOT DISTINCT FROM t.District
       AND l.Scheme_Name IS NOT DISTINCT FROM t.Scheme_Name AND l.session = t.session, ended
  WHERE t.utilization < 30 AND t.closed_at IS NULL AND l.last_at + 150 <= ended.known)
SELECT State, District, Scheme_Name, kind, strftime(moment, '%Y-%m-%d') AS "at", strftime(since, '%Y-%m-%d') AS since, utilization
FROM events
""")
