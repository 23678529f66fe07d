"""Bands, risk levels, severity ranks and the risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetlens import schema as S


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def utilization_band(col: str | Column) -> Column:
    """'low' under 50, 'high' over 120, else 'ok'; NULL stays NULL."""
    c = _c(col)
    return (F.when(c < S.BAND_LOW_UTILIZATION, "low")
            .when(c > S.BAND_HIGH_UTILIZATION, "high")
            .when(c.isNotNull(), "ok"))


def delay_band(col: str | Column) -> Column:
    """'late' over 90 days, else 'on_time'; NULL stays NULL."""
    c = _c(col)
    return F.when(c > S.BAND_LATE_DELAY, "late").when(c.isNotNull(), "on_time")


def with_bands(df: DataFrame, util: str = "Utilization_Percentage",
               delay: str = "Delay_Days") -> DataFrame:
    return df.withColumn("utilization_band", utilization_band(util)) \
             .withColumn("delay_band", delay_band(delay))


def risk_level(util: str | Column = "Utilization_Percentage",
               delay: str | Column = "Delay_Days") -> Column:
    """F8: money off by far (util > 150 or < 30) and late (delay > 90):
    both -> High, one -> Medium, none -> Low. NULL counts as not met."""
    u, d = _c(util), _c(delay)
    money = F.coalesce((u > S.CRITICAL_OVERSPEND) | (u < S.HIGH_RISK_THRESHOLD), F.lit(False))
    late = F.coalesce(d > S.HIGH_RISK_DELAY, F.lit(False))
    return (F.when(money & late, "High")
            .when(money | late, "Medium")
            .otherwise("Low"))


def severity_rank(col: str | Column) -> Column:
    """high 3, medium 2, low 1, anything else (or NULL) 0."""
    c = F.lower(_c(col))
    expr = None
    for i, sev in enumerate(S.SEVERITIES):
        rank = len(S.SEVERITIES) - i
        expr = F.when(c == sev, rank) if expr is None else expr.when(c == sev, rank)
    return expr.otherwise(0)


def tagged(tag: str | Column = "Anomaly_Tag") -> Column:
    """F10 test: NULL -> 'Normal', upper-cased, anomalous unless 'NORMAL'."""
    return F.upper(F.coalesce(_c(tag), F.lit(S.NORMAL_TAG))) != F.lit("NORMAL")


def risk_score(util: str | Column = "Utilization_Percentage",
               delay: str | Column = "Delay_Days",
               tag: str | Column = "Anomaly_Tag") -> Column:
    """M5: 0.5 * underspend + 0.3 * lateness + 0.2 * tagged, each part in [0, 1].

    underspend = clamp((30 - util) / 30, 0, 1), lateness = min(delay / 180, 1);
    a NULL input contributes 0.
    """
    u = _c(util).cast("double")
    d = _c(delay).cast("double")
    under = F.coalesce(F.least(F.greatest((F.lit(30.0) - u) / F.lit(30.0), F.lit(0.0)),
                               F.lit(1.0)), F.lit(0.0))
    late = F.coalesce(F.least(F.greatest(d / F.lit(180.0), F.lit(0.0)), F.lit(1.0)),
                      F.lit(0.0))
    tag_part = F.when(tagged(tag), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.lit(0.5) * under + F.lit(0.3) * late + F.lit(0.2) * tag_part


def risk_score_band(score: str | Column) -> Column:
    """M5 bands shown by the web client: > 0.7 high, > 0.4 medium, else low."""
    s = _c(score)
    return (F.when(s > S.RISK_SCORE_HIGH, "high")
            .when(s > S.RISK_SCORE_MEDIUM, "medium").otherwise("low"))
