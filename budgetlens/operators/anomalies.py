"""Anomaly reports over all departments in one job.

The reference fits one model per request for one department; here every
department with enough rows is fitted and scored at once (see ``forest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens import schema as S
from budgetlens.functions.bands import tagged
from budgetlens.functions.numeric import to_output
from budgetlens.operators.forest import feature_rows, fit_forest, score_points
from budgetlens.operators.quantiles import exact_percentiles
from budgetlens.session import SMALL_METHODS, broadcast_if_small, materialize, settings

GATE_MESSAGE = "Not enough data for ML detection"


def department_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("Department").agg(F.count(F.lit(1)).alias("total"))


def anomaly_gate(f: DataFrame, min_rows: int = S.ANOMALY_MIN_ROWS) -> DataFrame:
    """M2: departments under ``min_rows`` rows get no model and a message."""
    return (department_counts(f)
            .select("Department", F.col("total").alias("total_records"),
                    (F.col("total") >= min_rows).alias("eligible"),
                    F.when(F.col("total") < min_rows, F.lit(GATE_MESSAGE)).alias("message"))
            .orderBy("Department"))


def flag_by_contamination(df: DataFrame, group_cols: list[str], score_col: str,
                          contamination: float = S.FOREST_CONTAMINATION,
                          weight_col: str | None = None) -> DataFrame:
    """M3: flag rows whose score is strictly above the group's
    (1 - contamination) percentile (linear interpolation over all rows,
    ``weight_col`` = rows per distinct value). Adds ``threshold`` and
    ``is_anomaly``."""
    thr = exact_percentiles(df, group_cols, score_col, [1.0 - contamination],
                            weight_col=weight_col).select(
        *group_cols, F.col("p_0").alias("threshold"))
    # one row per group: broadcast behind a row check
    out = df.join(broadcast_if_small(thr), group_cols, "left")
    return out.withColumn("is_anomaly", F.coalesce(
        F.col(score_col) > F.col("threshold"), F.lit(False)))


def scored_points(f: DataFrame, contamination: float = S.FOREST_CONTAMINATION,
                  seed: int = S.FOREST_SEED, trees: int = S.FOREST_TREES,
                  max_samples: int = S.FOREST_MAX_SAMPLES,
                  min_rows: int = S.ANOMALY_MIN_ROWS) -> DataFrame:
    """M1 + M3 + M4 on distinct points: (Department, x0, x1, n, anomaly_score,
    threshold, is_anomaly) for every eligible department.

    The scored points are written to the shared folder and read back: the
    percentile and the flag both read them, and the Python scoring runs once.
    """
    rows = feature_rows(f)
    # counts and points are read several times each
    counts = materialize(department_counts(f).filter(F.col("total") >= min_rows), "forest-counts")
    model = fit_forest(rows, counts, trees=trees, max_samples=max_samples, seed=seed)
    points = materialize(rows.groupBy("Department", "x0", "x1").agg(F.count(F.lit(1)).alias("n"))
                         .join(counts.select("Department"), "Department", "left_semi"), "forest-points")
    with settings(f.sparkSession, SMALL_METHODS):
        scored = materialize(score_points(points, model), "forest-scores")
    return flag_by_contamination(scored, ["Department"], "anomaly_score",
                                 contamination, weight_col="n")


def ml_anomalies(f: DataFrame, scored: DataFrame | None = None, **kw) -> DataFrame:
    """M1: the fact rows the forest flags, with their anomaly score (M4).
    ``scored``: points scored before (``scored_points``), to share one fit."""
    flagged = (scored if scored is not None else scored_points(f, **kw)).filter("is_anomaly").select(
        "Department", "x0", "x1", "anomaly_score")
    flagged = broadcast_if_small(flagged, 500_000)
    rows = f.select("Department", "Project_ID", "State", "District",
                    "Utilization_Percentage", "Delay_Days",
                    F.coalesce(F.col("Utilization_Percentage").cast("double"),
                               F.lit(0.0)).alias("x0"),
                    F.coalesce(F.col("Delay_Days").cast("double"), F.lit(0.0)).alias("x1"))
    out = rows.join(flagged, ["Department", "x0", "x1"]).drop("x0", "x1")
    return to_output(out)


def anomaly_kpis(f: DataFrame, scored: DataFrame | None = None, **kw) -> DataFrame:
    """Per department total rows, ML anomalies, tagged anomalies, rate."""
    ml = ((scored if scored is not None else scored_points(f, **kw)).groupBy("Department")
          .agg(F.sum(F.when(F.col("is_anomaly"), F.col("n")).otherwise(0))
               .cast("bigint").alias("ml_anomalies_found")))
    base = f.groupBy("Department").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(tagged("Anomaly_Tag"), 1)).alias("tagged_anomalies"))
    out = base.join(ml, "Department", "left").select(
        "Department", "total_records",
        F.coalesce(F.col("ml_anomalies_found"), F.lit(0).cast("bigint"))
        .alias("ml_anomalies_found"),
        "tagged_anomalies",
        F.try_divide(F.coalesce(F.col("ml_anomalies_found"), F.lit(0)).cast("double"),
                     F.col("total_records").cast("double")).alias("anomaly_rate"))
    return out.orderBy("Department")


def all_anomalies(f: DataFrame, n: int = S.ANOMALY_LIMIT, scored: DataFrame | None = None, **kw) -> DataFrame:
    """D3: ML anomalies then tagged anomalies, duplicates kept, first ``n`` per
    department by (source, Project_ID). The per-department limit is a
    ``WindowGroupLimit`` before the shuffle."""
    ml = ml_anomalies(f, scored, **kw).select(
        "Department", "Project_ID", F.lit(0).alias("source"), "anomaly_score")
    tg = (f.filter(tagged("Anomaly_Tag"))
          .select("Department", "Project_ID", F.lit(1).alias("source"),
                  F.lit(None).cast("double").alias("anomaly_score")))
    w = Window.partitionBy("Department").orderBy("source", "Project_ID")
    both = ml.unionByName(tg)
    return (both.withColumn("position", F.row_number().over(w))
            .filter(F.col("position") <= n)
            .withColumn("position", F.col("position").cast("int"))
            .orderBy("Department", "position"))
