"""Vector code compression: product codes by active-entry Lloyd rounds.

A vector is made of integers ``floor(1024 * x)`` and cut into 4 equal parts;
each part position has a codebook of up to 256 entries, at first the parts of
the 256 smallest vec_ids. A round assigns every part to its nearest entry
(squared distance, ties to the lower index), then moves each used entry to the
componentwise ``floor(sum / count)`` of its parts.

Rows carry their four codes and exact distances from round to round. A part
whose entry did not move compares only the entries that did move with its
stored distance: all others are as far as before, hence not nearer (equal ones
lost by index then and lose now). Other parts rescan the codebook. One map per
round writes the new state and, per task and entry, the sums and counts of its
parts, which Spark adds up; the driver reads at most 4 x 256 sums and sends
the codebooks (256 times the dimension integers) to the tasks.

Distances are exact: float64 products while every sum stays below 2**53, else
64-bit integers. Defined cases: rows whose vector is null or holds null or
non-finite components are dropped; a vector shorter than the longest (its
length rounded up to a multiple of 4) is filled with zeros, an empty one is all
zeros; components whose integer is beyond ``LIMIT`` count as ``LIMIT``, so that
distances fit 64 bits; of rows that repeat a vec_id the smallest vector can
start an entry, and all are coded; rows without vec_id are coded and start no
entry unless all lack it; fewer than 256 ids give fewer entries; an empty table
gives no rows; other columns are kept (one with the name of a made column is
replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import fresh, prepare, read_table, release, table
from budgetlens.session import broadcast_if_small, drop_scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest size of a component's integer.
LIMIT = 1 << 24
#: Rows whose distances to a codebook are in memory at once.
BLOCK = 4096


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integer vectors."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * top) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for i in range(x.shape[1]):
        step = x[:, i:i + 1].astype(np.int64) - entries[None, :, i]
        out += step * step
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, ties to the lower index."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        d = distances(x[lo:lo + BLOCK], entries)
        c = d.argmin(1)
        code[lo:lo + BLOCK], far[lo:lo + BLOCK] = c, d[np.arange(len(c)), c]
    return code, far


def renewed(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, from the codes and distances before the entries flagged
    in ``moved`` changed."""
    code, far = code.copy(), far.copy()
    lost = moved[code]
    if lost.any():
        code[lost], far[lost] = nearest(x[lost], entries)
    stays, active = np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(active) and len(stays):
        c, d = nearest(x[stays], entries[active])
        c = active[c]
        better = (d < far[stays]) | ((d == far[stays]) & (c < code[stays]))
        code[stays[better]], far[stays[better]] = c[better], d[better]
    return code, far


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose vector is there and finite, first component and length of
    each row, all components)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
    have = np.maximum(lengths, 0)
    first = np.cumsum(have) - have
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    return np.flatnonzero((lengths >= 0) & (bad[first + have] == bad[first])), first, have, flat


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows to keep, their integer vectors filled up to ``dim``)."""
    good, first, have, flat = _flat(column)
    n = have[good]
    spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.floor(np.clip(flat[np.repeat(first[good], n) + spot], -LIMIT, LIMIT) * SCALE)
    out = np.zeros((len(good), dim), dtype=np.int32)
    out[np.repeat(np.arange(len(good)), n), spot] = np.clip(value, -LIMIT, LIMIT)
    return good, out


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value per row of an array."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize if data.ndim > 1 else 0)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Back from ``_bytes``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _heads(vector: str, vec_id: str):
    """Map: per task the ``ENTRIES`` smallest ids of kept vectors, and the longest of these vectors."""
    def run(batches):
        ids, longest, blank = [], -1, False
        for batch in batches:
            good = _flat(batch.column(vector))[0]
            if len(good):
                kept = batch.take(pa.array(good))
                longest = max(longest, pc.max(pc.list_value_length(kept.column(vector))).as_py())
                blank = blank or kept.column(vec_id).null_count > 0
                ids = sorted({*ids, *kept.column(vec_id).drop_null().to_pylist()})[:ENTRIES]
            kind = batch.schema.field(vec_id).type
        if longest >= 0:
            ids = ids + [None] * blank
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([longest] * len(ids), pa.int32())], ["id", "longest"])
    return run


def start_entries(df: DataFrame, vec_id: str, vector: str) -> tuple[int, np.ndarray]:
    """(dimension, integer vectors of the ``ENTRIES`` smallest kept vec_ids).
    Tasks send their smallest ids only; vectors are read for the ids chosen."""
    df = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    heads = table(df.mapInArrow(_heads("v", "id"), T.StructType([df.schema["id"], T.StructField("longest", T.IntegerType())])), "heads")
    longest = heads.agg(F.max("longest")).first()[0] or 0
    dim = max(PARTS, -(-longest // PARTS) * PARTS)
    ids = [r.id for r in heads.where("id is not null").select("id").distinct().orderBy("id").limit(ENTRIES).collect()]
    wanted = F.col("id") <= F.lit(ids[-1]).cast(df.schema["id"].dataType) if ids else F.col("id").isNull()
    wide = F.transform("v", lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = df.where(wanted & whole).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").toArrow()
    return dim, _integers(first.column("v").combine_chunks(), dim)[1].astype(np.int64)


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(the columns of ``vectors`` but the vector, with ``codes`` (4 bytes) and
    ``error`` (long: final squared distances, summed over parts); the final
    codebooks, one array of entries per part)."""
    spark = vectors.sparkSession
    prepare(spark)
    dim, start = start_entries(vectors, vec_id, vector)
    width = dim // PARTS
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(PARTS)]
    kept = [f for f in vectors.schema.fields if f.name != vector and f.name.lower() not in ("codes", "error")]
    names = [f.name for f in kept]
    ints, far, part, entry, sums, count = fresh(vectors, "__ints", "__far", "__part", "__entry", "__sums", "__count")
    state = [ints, "codes", far, "error"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept],
                           *[T.StructField(c, T.LongType() if c == "error" else T.BinaryType()) for c in state],
                           T.StructField(part, T.IntegerType()), T.StructField(entry, T.IntegerType()),
                           T.StructField(sums, T.ArrayType(T.LongType())), T.StructField(count, T.LongType())])
    state_kinds = [pa.int64() if c == "error" else pa.binary() for c in state]
    sum_kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]

    def assign(told, first: bool):
        """Map of a round: state rows, then a row of sums for each entry used."""
        def run(batches):
            books, moved = told.value
            total, n = [np.zeros((len(b), width), np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
            kinds = []
            for batch in batches:
                kinds = [batch.schema.field(c).type for c in names]
                if first:
                    good, x = _integers(batch.column(vector), dim)
                    batch = batch.take(pa.array(good))
                else:
                    x = _rows(batch.column(ints), np.int32, dim)
                    codes, fars = _rows(batch.column("codes"), np.uint8, PARTS), _rows(batch.column(far), np.int64, PARTS)
                if not len(x):
                    continue
                new_codes, new_fars = np.zeros((len(x), PARTS), np.uint8), np.zeros((len(x), PARTS), np.int64)
                for p in range(PARTS):
                    piece = x[:, p * width:(p + 1) * width]
                    c, d = nearest(piece, books[p]) if first else renewed(piece, books[p], moved[p], codes[:, p].astype(np.int64), fars[:, p])
                    new_codes[:, p], new_fars[:, p] = c, d
                    order = np.argsort(c, kind="stable")
                    used, at = np.unique(c[order], return_index=True)
                    total[p][used] += np.add.reduceat(piece[order].astype(np.int64), at, axis=0)
                    n[p] += np.bincount(c, minlength=len(books[p]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], _bytes(x), _bytes(new_codes), _bytes(new_fars), pa.array(new_fars.sum(1)),
                     *[pa.nulls(len(x), t) for t in sum_kinds]], schema.names)
            for p in range(PARTS):
                used = np.flatnonzero(n[p])
                if len(used):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(total[p][used].ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.nulls(len(used), t) for t in [*kinds, *state_kinds]], pa.array(np.full(len(used), p, np.int32)),
                         pa.array(used.astype(np.int32)), lists, pa.array(n[p][used])], schema.names)
            release()
        return run

    now, old, moved = vectors.select(*names, vector), None, [np.ones(len(b), bool) for b in books]
    for r in range(rounds + 1):
        told = spark.sparkContext.broadcast((books, moved))
        out = table(now.mapInArrow(assign(told, r == 0), schema), f"codes{r}")
        if old is not None:
            drop_scratch(old)
        old, now = out, out.where(F.col(count).isNull()).select(*names, *state)
        if r == rounds:
            break
        added = (out.where(F.col(count).isNotNull()).groupBy(part, entry)
                 .agg(F.sum(count).alias("n"), *[F.sum(F.col(sums)[i]).alias(f"s{i}") for i in range(width)]).collect())
        before, books = books, [b.copy() for b in books]
        for p, e, n, *s in added:
            books[p][e] = [v // n for v in s]
        moved = [(a != b).any(1) for a, b in zip(books, before)]
    return now.select(*names, "codes", "error"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """Hex digest of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def op12_active_lloyd(spark, sf_dir):
    coded, books = compressed(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    by_label = broadcast_if_small(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    floor_div = "(s - ((s % n) + n) % n) // n"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, v, best // {ENTRIES} AS far, best % {ENTRIES} AS e
  FROM (SELECT x.vec_id, any_value(x.label) AS label, x.p, any_value(x.v) AS v,
               min(CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * {ENTRIES} + c.e) AS best
        FROM parts x JOIN c{r} c ON x.p = c.p GROUP BY x.vec_id, x.p))""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, e, list(CAST({floor_div} AS DOUBLE) ORDER BY i) AS v
    FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v
  FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (
  SELECT p, e, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{", ".join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(e AS INT))), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
          FROM a{ROUNDS} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
           FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM c{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE = _oracle()
