"""Load verification, column check, row validation, profile, health."""

from __future__ import annotations

import math
from decimal import ROUND_FLOOR, Decimal, localcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.operators.quantiles import KEY_DIGITS, column_quantiles, exact_percentiles
from budgetlens.schema import EXPECTED_COLUMNS
from budgetlens.session import broadcast_if_small, materialize


def ingest_stats(f: DataFrame) -> DataFrame:
    """The loader's verification row: count, distincts, year range, total.

    Distinct counts run over one row per (State, District, Ministry) group,
    not over every fact.
    """
    g = f.groupBy("State", "District", "Ministry").agg(
        F.count(F.lit(1)).alias("n"), F.min("Year").alias("y0"),
        F.max("Year").alias("y1"), F.sum("Allocated_Budget_Cr").alias("a"))
    return g.agg(
        F.sum("n").cast("bigint").alias("records"),
        F.countDistinct("State").alias("states"),
        F.countDistinct("District").alias("districts"),
        F.countDistinct("Ministry").alias("ministries"),
        F.min("y0").alias("min_year"), F.max("y1").alias("max_year"),
        F.sum("a").cast("double").alias("total_budget"))


def check_columns(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Per expected column: 'found', 'similar' (case-insensitive
    containment of the expected name in an actual one) or 'missing'.
    Schema work only: builds a small DataFrame from ``df.columns``."""
    expected = EXPECTED_COLUMNS if expected is None else expected
    actual = list(df.columns)
    rows = []
    for pos, col in enumerate(expected):
        if col in actual:
            rows.append((pos, col, "found", None))
        else:
            similar = [c for c in actual if col.lower() in c.lower()]
            rows.append((pos, col, "similar" if similar else "missing",
                         ", ".join(similar) if similar else None))
    schema = T.StructType([
        T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType()),
        T.StructField("status", T.StringType()), T.StructField("similar", T.StringType())])
    return df.sparkSession.createDataFrame(rows, schema)


MONEY_COLUMNS = ["Allocated_Budget_Cr", "Revised_Budget_Cr", "Actual_Spending_Cr"]


def _repeated(f: DataFrame) -> DataFrame:
    """(Project_ID, _dup) of the projects with several rows. All rows are counted
    by a hash; only those of a hash that comes again are counted by Project_ID,
    and the facts themselves are dealt out only where many repeat."""
    ids = f.where(F.col("Project_ID").isNotNull()).select("Project_ID")
    again = materialize(ids.groupBy(F.xxhash64("Project_ID").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
                        .filter(F.col("_n") > 1).select("_h"), "repeated-hashes")
    return (ids.join(broadcast_if_small(again), F.xxhash64("Project_ID") == F.col("_h"), "left_semi")
            .groupBy("Project_ID").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
            .select("Project_ID", F.lit(True).alias("_dup")))


def checked_rows(f: DataFrame, min_year: int = 1900, max_year: int = 2100) -> DataFrame:
    """Facts with a ``reasons`` array (empty when the row is good)."""
    checked = f.join(broadcast_if_small(_repeated(f)), "Project_ID", "left")
    rules = [
        (F.col("Project_ID").isNull(), "missing Project_ID"),
        *[(F.col(c) < 0, f"negative {c}") for c in MONEY_COLUMNS],
        (F.col("Utilization_Percentage") < 0, "negative Utilization_Percentage"),
        ((F.col("Year") < min_year) | (F.col("Year") > max_year), "Year out of range"),
        (F.coalesce(F.col("_dup"), F.lit(False)), "duplicate Project_ID"),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg))
                                 for cond, msg in rules]), lambda x: x.isNotNull())
    return checked.withColumn("reasons", reasons).drop("_dup").select(*f.columns, "reasons")


def validate_rows(f: DataFrame, min_year: int = 1900,
                  max_year: int = 2100) -> tuple[DataFrame, DataFrame]:
    """Split facts into (good, bad); bad rows carry ``reasons``.

    Rules [ours]: Project_ID present; allocated, revised and actual money not
    negative; utilization not negative; Year in range; Project_ID unique.
    Duplicates are found by a grouped count (map-side combined, so a key
    repeated on a third of the rows is no hot task) joined back on the key.
    The checked rows are written once to the shared folder; both outputs read
    them.
    """
    checked = materialize(checked_rows(f, min_year, max_year), "checked-facts")
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    bad = checked.filter(F.size("reasons") > 0)
    return good, bad


def quarantine_summary(f: DataFrame) -> DataFrame:
    """Rows per reason, plus the 'ok' rows, in one pass over the checked
    rows (a good row counts once as 'ok')."""
    checked = checked_rows(f)
    reason = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("ok")))
                       .otherwise(F.col("reasons")))
    return (checked.select(reason.alias("reason")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("records")).orderBy("reason"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(
        f.dataType, (T.DecimalType, T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                     T.DoubleType, T.FloatType))]


#: Units of a column's spread that deviations are counted in: their squares are
#: summed exactly (38 digits hold 10**14 rows of them).
SPREAD = 10**12


def _scale(kind: T.DataType) -> int | None:
    """Digits after the point of a column whose values are exact; None for floating ones."""
    if isinstance(kind, T.DecimalType):
        return kind.scale
    return None if isinstance(kind, (T.DoubleType, T.FloatType)) else 0


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, stddev (sample), min, exact
    quartiles (linear interpolation, as pandas ``describe``) and max.

    One aggregate over the columns gives count, sum, min and max; a second one
    the squared deviations from the mean. For decimals and integers these are
    exact decimals in the column's own last digit, or where its range has more
    than ``SPREAD`` of those, in the smallest power of ten of them that leaves
    at most ``SPREAD``: large means lose nothing and the order of rows does not
    matter; ``stddev_samp`` for floating columns. Quartiles of all columns are
    selected together (see ``quantiles``), in passes over the rows that read
    only what a quartile can still be. NaN counts as missing.
    """
    columns = columns or numeric_columns(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scale = {c: _scale(kinds[c]) for c in columns}
    col = {c: F.col(f"`{c}`") for c in columns}
    value = {c: F.when(~F.isnan(col[c]), col[c]).cast("double") if scale[c] is None else
             col[c] if isinstance(kinds[c], T.DecimalType) else col[c].cast("decimal(20,0)") for c in columns}
    first = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(value[c]).alias(f"n{i}"), F.sum(value[c]).alias(f"s{i}"), F.min(value[c]).alias(f"lo{i}"),
        F.max(value[c]).alias(f"hi{i}"))]).first()
    unit, second = {}, []
    for i, c in enumerate(columns):
        if not first[f"n{i}"]:
            continue
        if scale[c] is None:
            second.append(F.stddev_samp(value[c]).alias(f"d{i}"))
            continue
        with localcontext() as exact:
            exact.prec = 80
            spread = int((first[f"hi{i}"] - first[f"lo{i}"]).scaleb(scale[c]))
            over = max(0, len(str(spread // SPREAD)) if spread >= SPREAD else 0)
            unit[c] = Decimal(1).scaleb(over - scale[c])
            whole = max(Decimal(1), unit[c]) if spread >= 10 ** scale[c] else unit[c]
            base = (first[f"s{i}"] / first[f"n{i}"] / whole).to_integral_value(ROUND_FLOOR) * whole
        away = F.round((value[c] - F.lit(base)).cast(f"decimal(38,{scale[c]})") * F.lit(Decimal(1).scaleb(scale[c])), 0).cast("decimal(38,0)")
        away = F.floor(away / F.lit(Decimal(10) ** over)).cast("decimal(14,0)") if over else away.cast("decimal(14,0)")
        second += [F.sum(away).alias(f"a{i}"), F.sum((away * away).cast("decimal(28,0)")).alias(f"b{i}")]
    more = df.agg(*second).first().asDict() if second else {}
    rows = []
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        if not n:
            rows.append((c, 0, None, None, None, None))
            continue
        if c in unit:
            with localcontext() as exact:
                exact.prec = 80
                a, b = float(more[f"a{i}"] * unit[c]), float(more[f"b{i}"] * unit[c] * unit[c])
            std = math.sqrt(max(0.0, (b - a * a / n) / (n - 1))) if n > 1 else None
        else:
            std = more[f"d{i}"]
        rows.append((c, n, float(first[f"s{i}"]) / n, std, float(first[f"lo{i}"]), float(first[f"hi{i}"])))
    shares = [0.25, 0.5, 0.75]
    keyed = [c for c in columns if scale[c] is None or not isinstance(kinds[c], T.DecimalType) or kinds[c].precision <= KEY_DIGITS]
    quartiles = column_quantiles(df, keyed, shares)
    for c in (c for c in columns if c not in quartiles):
        q = exact_percentiles(df.select(col[c].alias("value")), [], "value", shares).first()
        quartiles[c] = [None] * 3 if q is None else [q.p_0, q.p_1, q.p_2]
    rows = [(*r[:5], *quartiles[r[0]], r[5]) for r in rows]  # one row per column
    return df.sparkSession.createDataFrame(
        rows, "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double").orderBy("column")


def profile_schema(df: DataFrame) -> DataFrame:
    """Column list with position and type (schema work only)."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, nullable boolean")


def head(df: DataFrame, n: int = 5, order: str = "Project_ID") -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(order).limit(n)


def health(spark: SparkSession, table: DataFrame | str | None) -> DataFrame:
    """Status, record count, whether the table is there, and the error.
    ``table`` is a path of Parquet facts (read here, so a missing or broken
    table is found) or a DataFrame; None is no table."""
    schema = "status string, records bigint, table_exists boolean, error string"
    try:
        if table is None:
            raise FileNotFoundError("no table")
        f = spark.read.parquet(table) if isinstance(table, str) else table
        row = ("healthy", f.count(), True, None)
    except Exception as e:  # noqa: BLE001  whatever the probe meets is its result
        row = ("unhealthy", None, False, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}")
    return spark.createDataFrame([row], schema)
