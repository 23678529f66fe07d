"""Exact weighted percentiles per group without one task per group.

``percentile`` keeps every distinct value of a group in one aggregation
buffer; for a money column or a model score that is as many values as rows.
Here the values at the wanted positions are found by radix selection. Every
value gets a 64-bit key of the same order (a double its bits, an integer or a
decimal of up to 18 digits its unscaled value). A bracket is a range of keys
that holds a position; a pass counts the weights per next ``DIGIT`` bits below
what its smallest and largest key have in common (map-side combined) and
narrows it to the part that holds the position, tightened to the keys that are
there. So there are at most ``ceil(64 / DIGIT)`` passes whatever the values are,
infinities and subnormal numbers included, and fewer where few values lie close
together. Only values inside a bracket are read on; a pass shuffles at most
2**DIGIT rows per task and bracket. (Decimals of more digits have no 64-bit key;
their brackets are cut into equal parts by value, which also ends.) The result
is the exact value of the linear-interpolation definition (numpy ``linear``, SQL
``percentile_cont``): index k = q * (N - 1) over the N weighted rows, value
between x[floor(k)] and x[floor(k) + 1] at fraction k - floor(k).
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from budgetlens.session import broadcast_if_small, materialize, ship_package

#: Bits of a pass: per group (counted by Spark), and over several columns (in numpy arrays).
DIGIT, COLUMN_DIGIT = 16, 11
#: Decimal digits that fit a 64-bit key.
KEY_DIGITS = 18
_LOWEST = -(1 << 63)


def _keyed(df: DataFrame, group_cols: list[str], value_col: str, w: Column) -> DataFrame:
    """(groups, v: a key, value: a decimal or double, w) of the rows that have a
    value. The bits of doubles are taken in Arrow batches, once."""
    kind, v = df.schema[value_col].dataType, F.col(value_col)
    if isinstance(kind, T.DecimalType):
        key = v if kind.precision > KEY_DIGITS else (v * F.lit(Decimal(10) ** kind.scale)).cast("long")
        return df.where(v.isNotNull()).select(*group_cols, key.alias("v"), v.alias("value"), w.alias("w")).where("w > 0")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return df.where(v.isNotNull()).select(*group_cols, v.cast("long").alias("v"), v.cast("double").alias("value"), w.alias("w")).where("w > 0")
    ship_package(df.sparkSession)
    d = df.where(v.isNotNull() & ~F.isnan(v)).select(*group_cols, (v.cast("double") + F.lit(0.0)).alias("value"), w.alias("w")).where("w > 0")

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_arrow_keys(batch.column("value")))], [*batch.schema.names, "v"])

    return materialize(d.mapInArrow(keys, T.StructType([*d.schema.fields, T.StructField("v", T.LongType())])), "quantile-keys")


def exact_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                      quantiles: list[float], weight_col: str | None = None) -> DataFrame:
    """One row per group: ``group_cols`` + ``p_<i>`` (double) per quantile + ``n``.

    NULL values are ignored (as SQL does), NaN too; weights are row counts
    (>= 0). Infinities are values like others (between them and a finite value
    lies an infinity; between both of them NULL). ``df`` is read once per pass,
    so a costly ``df`` should be a written table.
    """
    g, kind = list(group_cols), df.schema[value_col].dataType
    w = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    wide = isinstance(kind, T.DecimalType) and kind.precision > KEY_DIGITS
    state = _selected(_keyed(df, g, value_col, w), g, quantiles, isinstance(kind, T.DecimalType), by_bits=not wide)
    return _pick(state, g, quantiles, isinstance(kind, T.DecimalType))


def _selected(d: DataFrame, g: list[str], quantiles: list[float], is_decimal: bool, by_bits: bool = True) -> DataFrame:
    """(group, _n, target, lo): the value at each wanted position of ``d``
    (group, v, value, w); ``v`` is a key, or with ``by_bits`` off a decimal."""
    n = materialize(d.groupBy(*g).agg(F.sum("w").alias("_n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("value").alias("value"))
                    .where("_n > 0"), "quantile-groups")
    # the wanted positions: two per group and quantile
    wanted = []
    for q in quantiles:
        i0, _ = _position(q, is_decimal)
        wanted += [i0, F.least(i0 + 1, F.col("_n") - 1)]
    targets = n.select(*g, "_n", "lo", "hi", "value", F.posexplode(F.array(*wanted)).alias("target", "k"),
                       F.lit(0).cast("bigint").alias("before"))
    columns = [*g, "_n", "lo", "hi", "value", "target", "k", "before", "done"]
    state = materialize(targets.withColumn("done", F.col("lo") == F.col("hi")).select(*columns), "quantile-brackets")
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(g)]
    same = F.lit(True)
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    lifted = lambda c: F.col(c).bitwiseXOR(F.lit(_LOWEST))  # noqa: E731  as unsigned
    while not state.where("not done").isEmpty():
        # brackets that several positions share are read once; as many rows as groups x positions
        open_ = state.where("not done").select(*keys, "lo", "hi").distinct()
        if by_bits:
            differ = F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi"))))
            open_ = open_.withColumn("shift", F.greatest(F.lit(0), differ - DIGIT))
            above = lambda c: F.call_function("shiftrightunsigned", lifted(c), F.col("shift"))
            part = above("v") - above("lo")
        else:
            share = (F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
            # the largest value has a part of its own, so every pass makes a bracket smaller
            part = F.when(F.col("v") == F.col("hi"), 1 << DIGIT).otherwise(F.least(F.floor(share * (1 << DIGIT)), F.lit((1 << DIGIT) - 1)))
        inside = d.join(broadcast_if_small(open_, 1_000_000), same & F.col("v").between(F.col("lo"), F.col("hi")))
        parts = inside.groupBy(*[f"_g{i}" for i in range(len(g))], "lo", "hi", part.alias("part")).agg(
            F.sum("w").alias("w"), F.min("v").alias("lo2"), F.max("v").alias("hi2"), F.min("value").alias("value2"))
        run = Window.partitionBy(*[f"_g{i}" for i in range(len(g))], "lo", "hi").orderBy("part")
        parts = parts.withColumn("upto", F.sum("w").over(run)).withColumnsRenamed({"lo": "l", "hi": "h"})
        found = (state.where("not done").join(parts, same & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")))
                 .where((F.col("k") < F.col("before") + F.col("upto"))
                        & (F.col("k") >= F.col("before") + F.col("upto") - F.col("w")))
                 .select(*g, "_n", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("value2").alias("value"), "target", "k",
                         (F.col("before") + F.col("upto") - F.col("w")).alias("before"),
                         (F.col("lo2") == F.col("hi2")).alias("done")))
        state = materialize(state.where("done").unionByName(found), "quantile-brackets")
    return state.select(*g, "_n", "target", F.col("value").alias("lo"))


def column_quantiles(df: DataFrame, columns: list[str], quantiles: list[float]) -> dict[str, list]:
    """The quantiles of several columns with 64-bit keys at once: one pass over
    the rows narrows all columns' brackets by ``COLUMN_DIGIT`` bits. Tasks count in
    numpy; the driver reads at most 2**COLUMN_DIGIT rows per column and position."""
    ship_package(df.sparkSession)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = (_LOWEST, -_LOWEST - 1)
    brackets = {c: {whole} for c in columns}
    places: dict[str, list] = {}  # per column and position: [bracket, weight before it]
    total: dict[str, int] = {}
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    while any(lo < hi for open_ in brackets.values() for lo, hi in open_):
        asked = [sorted(b for b in brackets[c] if b[0] < b[1]) for c in columns]
        counts = (rows.mapInArrow(_digit_counts(asked), "c int, bracket int, part int, w long, lo long, hi long")
                  .groupBy("c", "bracket", "part").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())
        found: dict[tuple, list] = {}
        for r in sorted(counts, key=lambda r: (r.c, r.bracket, r.part)):
            found.setdefault((columns[r.c], asked[r.c][r.bracket]), []).append((r.w, (r.lo, r.hi)))
        for c in columns:
            if c not in total:
                total[c] = n = sum(w for w, _ in found.get((c, whole), ()))
                at = [int(_place(q, n, _floating(kinds[c]))) for q in quantiles] if n else []
                places[c] = [[k, whole, 0] for i in at for k in (i, min(i + 1, n - 1))]
            for place in places[c]:
                k, bracket, before = place
                for w, narrow in found.get((c, bracket), ()):
                    if k < before + w:
                        place[1:] = narrow, before
                        break
                    before += w
            brackets[c] = {b for _, b, _ in places[c]}
    return {c: [_between(*(_value(b[0], kinds[c]) for _, b, _ in places[c][2 * i:2 * i + 2]), q, total[c], _floating(kinds[c]))
                for i, q in enumerate(quantiles)] if total[c] else [None] * len(quantiles) for c in columns}


def _digit_counts(asked: list[list[tuple[int, int]]]):
    """Map: per column, bracket and part the rows, the smallest and the largest key."""
    digit, lift = COLUMN_DIGIT, np.uint64(1 << 63)

    def run(batches):
        held = {}
        for batch in batches:
            for i, open_ in enumerate(asked):
                keys = _arrow_keys(batch.column(i)) if open_ else None
                for j, (lo, hi) in enumerate(open_):
                    inside = keys[(keys >= lo) & (keys <= hi)]
                    shift = np.uint64(max(0, (lo ^ hi).bit_length() - digit) if (lo < 0) == (hi < 0) else 64 - digit)
                    first = (np.array([lo]).view(np.uint64) ^ lift) >> shift
                    part = (((inside.view(np.uint64) ^ lift) >> shift) - first).astype(np.int64)
                    w, low, high = held.setdefault((i, j), (np.zeros(1 << digit, np.int64), np.full(1 << digit, np.iinfo(np.int64).max), np.full(1 << digit, np.iinfo(np.int64).min)))
                    w += np.bincount(part, minlength=1 << digit)
                    np.minimum.at(low, part, inside)
                    np.maximum.at(high, part, inside)
        for (i, j), (w, low, high) in held.items():
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)) for x in (i, j)] + [pa.array(at.astype(np.int32))]
                                             + [pa.array(x[at]) for x in (w, low, high)], ["c", "bracket", "part", "w", "lo", "hi"])

    return run


def _arrow_keys(column: pa.Array) -> np.ndarray:
    """64-bit keys of the values that are there and not NaN."""
    column = column.drop_null()
    if pa.types.is_decimal(column.type):
        raw = np.frombuffer(column.buffers()[1], np.int64) if len(column) else np.zeros(0, np.int64)
        return raw[2 * column.offset:2 * (column.offset + len(column)):2]
    if pa.types.is_floating(column.type):
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bits = (x[~np.isnan(x)] + 0.0).view(np.int64)
        return np.where(bits >= 0, bits, bits ^ np.int64((1 << 63) - 1))
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _place(q: float, n: int, floating: bool):
    """k = q (n - 1), exact but for doubles (as ``_position``)."""
    return q * (n - 1) if floating else Fraction(Decimal(repr(float(q)))) * (n - 1)


def _value(key: int, kind: T.DataType):
    if _floating(kind):
        return float(np.array([key if key >= 0 else key ^ ((1 << 63) - 1)], np.int64).view(np.float64)[0])
    return Fraction(key, 10**kind.scale if isinstance(kind, T.DecimalType) else 1)


def _between(x0, x1, q: float, n: int, floating: bool) -> float | None:
    """As ``_pick``, on the driver."""
    k = _place(q, n, floating)
    t = k - int(k)
    if not floating:
        return float(x0 + (x1 - x0) * t)
    if t == 0 or x0 == x1:
        return x0
    if abs(x0) == float("inf") or abs(x1) == float("inf"):
        return None if x0 + x1 != x0 + x1 else x0 if abs(x0) == float("inf") else x1
    if abs(x1 - x0) == float("inf"):
        return x0 * (1.0 - t) + x1 * t
    return x0 + (x1 - x0) * t if t < 0.5 else x1 - (x1 - x0) * (1.0 - t)


def _position(q: float, is_decimal: bool):
    """(floor(k), k - floor(k)) of k = q (n - 1); exact for decimals."""
    if is_decimal:
        # with q = num / den, floor(k) and the fraction are integer arithmetic
        frac = Fraction(Decimal(repr(float(q))))
        num, den = frac.numerator, frac.denominator
        return (F.expr(f"(_n - 1) * {num} div {den}"),
                (F.expr(f"pmod((_n - 1) * {num}, {den})").cast("decimal(20,0)") / F.lit(Decimal(den))).cast("decimal(17,16)"))
    k = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
    i0 = F.floor(k).cast("bigint")
    return i0, k - i0


def _pick(state: DataFrame, g: list[str], quantiles: list[float], is_decimal: bool) -> DataFrame:
    """Interpolate between x[floor(k)] and x[floor(k)+1] of each quantile.

    Decimal values interpolate in exact decimal arithmetic (k and its
    fraction too) and are cast to double once, so the result is the correctly
    rounded value. Double values use numpy's two-sided linear interpolation
    (x0 + d t below t = 0.5, x1 - d (1 - t) from there), bit for bit.
    """
    at = [F.max(F.when(F.col("target") == i, F.col("lo"))).alias(f"_x{i}") for i in range(2 * len(quantiles))]
    res = state.groupBy(*g).agg(F.max("_n").alias("_n"), *at)
    outs = []
    for i, q in enumerate(quantiles):
        x0, x1, (_, t) = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), _position(q, is_decimal)
        if is_decimal:
            val = F.when(x0 == x1, x0.cast("double")).otherwise((x0 + (x1 - x0) * t).cast("double"))
        else:
            diff = x1 - x0
            val = F.when(t < 0.5, x0 + diff * t).otherwise(x1 - diff * (F.lit(1.0) - t))
            # beside an infinity: the value itself, or the infinity between; between both: nothing
            odd = F.when((t == 0) | (x0 == x1), x0).when(F.isnan(x0 + x1), F.lit(None)).otherwise(F.when(F.abs(x0) == float("inf"), x0).otherwise(x1))
            val = F.when(F.abs(diff) < float("inf"), val).when(F.greatest(F.abs(x0), F.abs(x1)) == float("inf"), odd).otherwise(x0 * (F.lit(1.0) - t) + x1 * t)
        outs.append(val.alias(f"p_{i}"))
    return res.select(*g, *outs, F.col("_n").alias("n"))
