"""R4 in full: every unit of a department's surplus goes to a deficit until one
of the two is used up.

Inside each department the under-utilised schemes are laid end to end, largest
surplus first, and the over-utilised ones likewise by deficit: each scheme is
an interval of money, and a transfer is the overlap of a surplus interval with
a deficit interval. (Pairing equal ranks, as ``reallocate_within_department``
does, leaves most schemes without a partner.)

No department meets in one task, however many schemes it has. Running sums and
"the next interval of the other side" are both taken along a global order:
rows are range-partitioned in that order and written, a window runs inside each
range only, and one row per range, department and side carries the sum (or the
first interval) on to the ranges before or after it. No pairs are tried: the
overlap that ends where an interval ends belongs to the interval and to the
first one of the other side that ends there or later, so there are at most as
many transfers as intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens import schema as S
from budgetlens.operators.aggregates import SCHEME_KEYS, scheme_groups
from budgetlens.session import materialize

MONEY = "decimal(38,4)"
OTHER_KEYS = [k for k in SCHEME_KEYS if k != "Department"]


def _ranges(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` written in ranges of ``order``, with the number of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), name)


def sides(groups: DataFrame, under_threshold: float, over_threshold: float) -> DataFrame:
    """Scheme groups that have something to give ('under') or lack it ('over'),
    with the amount."""
    side = (F.when(F.col("utilization") < F.lit(float(under_threshold)), F.lit("under"))
            .when(F.col("utilization") > F.lit(float(over_threshold)), F.lit("over")))
    amount = F.when(F.col("side") == "under", F.col("surplus")).otherwise(F.col("deficit")).cast(MONEY)
    return (groups.withColumn("side", side).withColumn("amount", amount).where("side is not null and amount > 0")
            .select(*SCHEME_KEYS, "utilization", "side", "amount"))


def laid_out(rows: DataFrame) -> DataFrame:
    """``rows`` (Department, side, amount, ...) with ``start`` and ``end`` of
    their interval, largest amount first (ties by the scheme's keys)."""
    order = [F.col("amount").desc(), *OTHER_KEYS]
    ranged = _ranges(rows, "allocation-order", "Department", "side", *order)
    inside = Window.partitionBy("range", "Department", "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("Department", "side").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, department and side
    offsets = (ranged.groupBy("range", "Department", "side").agg(F.sum("amount").cast(MONEY).alias("held"))
               .withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0)).cast(MONEY)).drop("held"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("range", "Department", "side")]
    out = ranged.withColumn("run", F.sum("amount").over(inside)).alias("r").join(offsets.alias("o"), same[0] & same[1] & same[2])
    end = (F.col("run") + F.col("offset")).cast(MONEY)
    return out.select(*[f"r.{c}" for c in rows.columns], (end - F.col("amount")).cast(MONEY).alias("start"), end.alias("end"))


def transfers(intervals: DataFrame) -> DataFrame:
    """(under, over, amount): the overlaps of the two sides' intervals per
    department; under and over are the rows as structs."""
    row = F.struct(*intervals.columns)
    ranged = _ranges(intervals.withColumn("own", row), "allocation-ends", "Department", "end")
    # peers included: the other side may end at the same amount
    onward = Window.partitionBy("range", "Department").orderBy("end").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy("Department").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    of = {s: F.when(F.col("side") == s, F.col("own")) for s in ("under", "over")}
    here = ranged.withColumns({f"next_{s}": F.first(of[s], ignorenulls=True).over(onward) for s in of})
    # the first interval of each side in a range, and in the ranges after it: one row per range and department
    heads = ranged.groupBy("range", "Department").agg(*[F.min_by(of[s], F.when(F.col("side") == s, F.col("end"))).alias(f"head_{s}") for s in of])
    heads = heads.select(F.col("range").alias("r"), F.col("Department").alias("d"),
                         *[F.first(f"head_{s}", ignorenulls=True).over(later).alias(f"after_{s}") for s in of])
    both = here.join(heads, (F.col("range") == F.col("r")) & F.col("Department").eqNullSafe(F.col("d")))
    under = F.when(F.col("side") == "under", F.col("own")).otherwise(F.coalesce("next_under", "after_under"))
    over = F.when(F.col("side") == "over", F.col("own")).otherwise(F.coalesce("next_over", "after_over"))
    out = both.select("side", under.alias("under"), over.alias("over")).where("under is not null and over is not null")
    # where both end at the same amount the surplus side states the transfer
    out = out.where((F.col("side") == "under") | (F.col("under.end") != F.col("over.end")))
    amount = F.least("under.end", "over.end") - F.greatest("under.start", "over.start")
    return out.select("under", "over", amount.cast(MONEY).alias("amount")).where("amount > 0")


def allocate_surplus(f: DataFrame, under_threshold: float = S.UNDER_UTILIZATION,
                     over_threshold: float = S.OVER_UTILIZATION) -> DataFrame:
    """All transfers inside each department. Per department they sum to the
    smaller of its surplus and its deficit; no scheme gives or gets more than
    it has or lacks."""
    moved = transfers(laid_out(sides(scheme_groups(f), under_threshold, over_threshold)))
    return moved.select(
        F.col("under.Department").alias("Department"),
        F.col("under.District").alias("from_district"), F.col("under.State").alias("from_state"), F.col("under.Scheme_Name").alias("from_scheme"),
        F.col("over.District").alias("to_district"), F.col("over.State").alias("to_state"), F.col("over.Scheme_Name").alias("to_scheme"),
        F.col("under.utilization").alias("from_utilization"), F.col("over.utilization").alias("to_utilization"),
        F.col("under.start").cast("double").alias("from_offset"), F.col("amount").cast("double").alias("amount"),
        (F.col("over.amount") - F.col("amount")).cast("double").alias("other_need"))
