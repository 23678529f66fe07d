"""Look-ups by State, District, Ministry, Department, Year and Utilization.

The reference keeps a secondary index for each of these columns. On Parquet the
same look-ups are served by where a row lies: every column is cut into up to
2**b parts of about equal weight, the parts' bits are interleaved into one key
(Z-order), and rows are range-partitioned by that key into files of about equal
size; one or several neighbouring files make a zone, a folder of the table. A
zone holds rows that are close in all columns, so each has a narrow range in
several.
The zone table (rows, smallest, largest and number of NULLs of each column per
zone) lies beside the data and turns a predicate into a list of zones, which
reaches the scan as a partition filter: other zones are not even listed.

A frequent value of one column is spread by the others: a department with a
third of all rows lies in many zones. Rows with the very same key are split over
files by a hash of the project. The cuts decide where rows lie, never what a
look-up returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.schema import FACT_COLUMNS, FACT_SCHEMA
from budgetlens.session import SMALL_METHODS, settings

#: Bits of each look-up column in the key, the columns asked most first.
LOOKUP_BITS = {"Utilization_Percentage": 5, "State": 5, "Department": 4, "Year": 3, "District": 3, "Ministry": 3}
#: A table has a zone (a folder) for each ZONE_BYTES, LEAST_ZONES to MOST_ZONES
#: of them; files of a zone are at most about FILE_BYTES.
ZONE_BYTES, LEAST_ZONES, MOST_ZONES, FILE_BYTES = 128 << 10, 16, 4096, 128 << 20
#: Bytes taken for a row where the planner knows no size; most files of a table.
ROW_BYTES, MOST_FILES = 100, 1 << 20
#: Distinct values of a text column that the driver reads to choose its cuts;
#: of more, those with the smallest hashes stand for all.
MAX_VALUES = 50_000
ZONE_TABLE = "_zones"


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def column_cuts(df: DataFrame, bits: dict[str, int]) -> dict[str, list]:
    """For each column at most ``2**bits - 1`` ascending values that cut the
    rows into parts of about equal weight (a value is never cut)."""
    texts = [c for c in bits if _is_text(df, c)]
    numbers = [c for c in bits if c not in texts]
    cuts: dict[str, list] = {}
    if numbers:
        shares = {c: [i / 2 ** bits[c] for i in range(1, 2 ** bits[c])] for c in numbers}
        row = df.agg(*[F.percentile_approx(c, shares[c], 10_000).alias(c) for c in numbers]).first()
        cuts |= {c: sorted(set(row[c] or [])) for c in numbers}
    for c in texts:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
        counts = counts.orderBy(F.xxhash64("value")).limit(MAX_VALUES)
        rows = sorted((r.value, r.n) for r in counts.collect())
        cuts[c] = equal_cuts(rows, 2 ** bits[c])
    return cuts


def equal_cuts(counts: list[tuple], parts: int) -> list:
    """First values of parts 2, 3, ... of ascending (value, rows): a new part
    begins with the value whose middle lies in the next share of the rows."""
    total, run, cuts, last = sum(n for _, n in counts), 0, [], 0
    for value, n in counts:
        part = int(parts * (run + n / 2) // total)
        if part > last and run:
            cuts.append(value)
        last = max(last, part)
        run += n
    return cuts


def part_of(column: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are <= the value (NULL: 0), as a
    balanced tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def interleaved(parts: dict[str, Column], bits: dict[str, int]) -> Column:
    """Z-order key: the highest bit of every column, then the next ones."""
    order = [(c, b - 1 - i) for i in range(max(bits.values())) for c, b in bits.items() if i < b]
    key = F.lit(0).cast("long")
    for place, (c, bit) in enumerate(reversed(order)):
        key = key + F.shiftleft(F.shiftright(parts[c].cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), place)
    return key


def write_zones(df: DataFrame, path: str, bits: dict[str, int] | None = None, zones: int | None = None,
                file_bytes: int = FILE_BYTES, size_bytes: int | None = None) -> str:
    """Write ``df`` (a stored table: it is read a few times) to ``path`` in
    zones, with the zone table beside them. ``size_bytes`` is the size of the
    data, for the number of files; by default the planner's estimate."""
    bits = LOOKUP_BITS if bits is None else bits
    cuts = column_cuts(df, bits)
    # the parts of a column with few values are spread over all its bits
    parts = {c: F.floor(part_of(F.col(c), cuts[c]) * 2 ** bits[c] / (len(cuts[c]) + 1)) for c in bits}
    keyed = df.withColumns({f"_part_{c}": parts[c] for c in bits}).withColumn("_key", interleaved({c: F.col(f"_part_{c}") for c in bits}, bits))
    if size_bytes is None:
        size_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size_bytes >= 1 << 60:  # not known to the planner
            size_bytes = ROW_BYTES * df.count()
    if zones is None:
        zones = max(LEAST_ZONES, min(MOST_ZONES, size_bytes // ZONE_BYTES))
    # ranges of equal size; the hash splits rows with the very same key
    ranges = min(MOST_FILES, max(zones, -(-size_bytes // file_bytes)))
    zone = F.floor(F.spark_partition_id() * F.lit(zones) / F.lit(ranges)).cast("int")
    with settings(df.sparkSession, SMALL_METHODS):
        (keyed.repartitionByRange(ranges, "_key", F.xxhash64("Project_ID"))
         .sortWithinPartitions(*list(bits)[:2]).withColumn("zone", zone).select(*df.columns, "zone")
         .write.mode("overwrite").partitionBy("zone").parquet(path))
    written = df.sparkSession.read.schema(_stored(df.schema)).parquet(path)
    (written.groupBy("zone").agg(F.count("*").alias("rows"), *[x for c in bits for x in (
        F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls"))])
     .repartition(1).write.mode("overwrite").parquet(f"{path}/{ZONE_TABLE}"))  # as many rows as zones
    return path


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("zone", T.IntegerType())])


@dataclass(frozen=True)
class Between:
    """Values from ``low`` to ``high``, both included; None is open."""

    low: object = None
    high: object = None


def _matches(wanted: dict) -> Column:
    """Rows that the look-up asks for."""
    out = F.lit(True)
    for name, v in wanted.items():
        c = F.col(name)
        if isinstance(v, Between):
            out = out & c.isNotNull()
            if v.low is not None:
                out = out & (c >= F.lit(v.low))
            if v.high is not None:
                out = out & (c <= F.lit(v.high))
        elif isinstance(v, (list, tuple, set)):
            out = out & c.isin(list(v))
        else:
            out = out & (c.isNull() if v is None else c == F.lit(v))
    return out


def _may_hold(wanted: dict) -> Column:
    """Zones in which a row can match."""
    out = F.lit(True)
    for c, v in wanted.items():
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        if isinstance(v, Between):
            out = out & lo.isNotNull()
            if v.low is not None:
                out = out & (hi >= F.lit(v.low))
            if v.high is not None:
                out = out & (lo <= F.lit(v.high))
        elif isinstance(v, (list, tuple, set)):
            some = F.lit(False)
            for x in v:
                some = some | ((lo <= F.lit(x)) & (hi >= F.lit(x)))
            out = out & some
        elif v is None:
            out = out & (F.col(f"{c}_nulls") > 0)
        else:
            out = out & (lo <= F.lit(v)) & (hi >= F.lit(v))
    return F.coalesce(out, F.lit(False))


def zones_for(spark: SparkSession, path: str, **wanted) -> list[int]:
    """Zones that a look-up opens (columns without a range in the zone table
    exclude nothing)."""
    table = spark.read.parquet(f"{path}/{ZONE_TABLE}")
    known = {c: v for c, v in wanted.items() if f"{c}_lo" in table.columns}
    return sorted(r.zone for r in table.where(_may_hold(known)).select("zone").collect())


def lookup(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Facts that match every given column: a value, None (is NULL), a list of
    values, or ``Between(low, high)``. Only zones that can hold a match are
    listed and read."""
    stored = spark.read.schema(_stored(FACT_SCHEMA)).parquet(path)
    return stored.where(F.col("zone").isin(zones_for(spark, path, **wanted))).where(_matches(wanted)).select(*FACT_COLUMNS)
