"""Helpers shared by the operators: word and shingle hashes of whole texts,
size-bounded slices of Arrow batches, reading tables, union-find in Spark."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.session import materialize, ship_package

#: Bytes of text that a Python task holds unpacked at once (one document may be longer).
SLICE_BYTES = 4 << 20
#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
#: Odd base of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


#: Rows and bytes of the Arrow batches that go to Python (texts can be long).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def prepare(spark: SparkSession) -> None:
    """Make the package importable on the workers, and Arrow batches small
    where the application does not set their size itself."""
    ship_package(spark)
    given = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not given.contains(key):
            spark.conf.set(key, value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, after ``prepare``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df, name)


# buffers of a finished batch go back to the system at once
pa.set_memory_pool(pa.system_memory_pool())


def steady() -> None:
    """Have the C library give arrays of a megabyte and more back as soon as
    they are freed (its limit otherwise grows with what is freed), and trim
    what lies free. For tasks that make large arrays group after group."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its
    task, beside whatever runs next on the executor."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches, column: str, max_bytes: int = SLICE_BYTES):
    """Cut Arrow batches into slices whose ``column`` holds at most
    ``max_bytes`` bytes (a longer single value is a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has columns of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_made(df: DataFrame, column: str, made: list[T.StructField], compute, max_bytes: int = SLICE_BYTES,
              done=None) -> DataFrame:
    """``df`` with the columns ``made``, whose arrays ``compute(slice)`` returns
    for slices bounded by the bytes of ``column``; columns of ``df`` that have
    the name of a made one are replaced. A narrow map; ``done`` is called at
    the end of a task."""
    names = [f.name for f in made]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]

    def run(batches):
        for part in slices(batches, column, max_bytes):
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *compute(part)], [*[f.name for f in kept], *names])
        if done is not None:
            done()
        release()

    prepare(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*kept, *made]))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def _hash_buffer(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _power_tables(len(buf) + 1)
    total = np.concatenate((np.zeros(1, np.uint64),
                            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])))
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts: list[bytes], lower: bool = True, piece: int = 1 << 20):
    """64-bit hashes of all words of ``texts`` in order, and per text the index
    of its first word (one more entry at the end). Work memory is bounded by
    ``piece`` (or the longest word), whatever the length of a text."""
    out, first, n = [], np.zeros(len(texts) + 1, dtype=np.int64), 0
    group: list[bytes] = []
    at: list[int] = []

    def flush():
        nonlocal n
        if not group:
            return
        joined = b" ".join(group)
        buf = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        hashes, starts = _hash_buffer(buf)
        bounds = np.cumsum([0] + [len(g) + 1 for g in group])
        counts = np.diff(np.searchsorted(starts, bounds))
        for i, c in zip(at, counts.tolist()):
            first[i + 1] += c
        out.append(hashes)
        n += len(hashes)
        group.clear()
        at.clear()

    held = 0
    for i, t in enumerate(texts):
        lo = 0
        while len(t) - lo > piece:  # cut a long text after a white space
            cut = max(t.rfind(c, lo, lo + piece) for c in (b" ", b"\n", b"\t"))
            if cut <= lo:
                cut = min((x for x in (t.find(c, lo + piece) for c in (b" ", b"\n", b"\t")) if x >= 0),
                          default=len(t))
            if cut >= len(t):
                break
            flush()
            group.append(t[lo:cut])
            at.append(i)
            flush()
            lo, held = cut + 1, 0
        if held + len(t) - lo > piece:
            flush()
            held = 0
        group.append(t[lo:] if lo else t)
        at.append(i)
        held += len(t) - lo
    flush()
    np.cumsum(first, out=first)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of the ``k``-word shingles of each text, in order, with repeats:
    (hashes, first shingle per text). A text of 1 to k-1 words has one shingle,
    the whole sequence; a text without words has none."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(n)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    pos = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first[:-1], n)
    short = np.repeat(np.where(counts < k, counts, k), n)
    h = np.zeros(len(pos), dtype=np.uint64)
    last = len(words) - 1
    for i in range(k):
        step = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(pos + i, last)])
        h = np.where(short > i, step, h)
    return mix64(h + short.astype(np.uint64)), begin


def distinct_per_text(values: np.ndarray, first: np.ndarray):
    """Sorted distinct uint64 values of each text and the new firsts."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(first)))


#: Ids that stand for further texts of a doc_id begin here.
FURTHER = 1 << 62


def one_per_text(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat a doc_id and its text (the smallest
    row stays), and with a long column ``key`` that tells rows apart: the
    doc_id, or for the second and further texts of a doc_id a number from
    ``FURTHER`` on. Rows without doc_id stay, with a null key. Texts are shuffled
    only where a doc_id repeats."""
    twice = table(docs.where("doc_id is not null").groupBy(F.col("doc_id")).count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    row, digest = fresh(docs, "__row", "__digest")
    again = docs.join(twice, "doc_id", "left_semi").withColumn(digest, F.concat(F.col(text).isNull().cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    rows = again.groupBy(F.col("doc_id").alias("of"), digest).agg(F.min(F.struct(*docs.columns)).alias(row))
    low = rows.groupBy("of").agg(F.min(digest).alias("low"))
    # numbered once and written, so that the numbers stay
    numbered = table(rows.join(low, "of").select(
        f"{row}.*", F.when(F.col(digest) == F.col("low"), F.col("of").cast("long")).otherwise(F.lit(FURTHER) + F.monotonically_increasing_id()).alias(key)), "texts")
    return docs.join(twice, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").cast("long").alias(key)).unionByName(numbered)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (two long columns): (node, component),
    component the smallest node reachable. Union-find by alternating stars:
    in each round every node points its larger neighbours at the smallest node
    next to it (large star), then the smaller ones too (small star), until the
    edges are stars. Each round is grouped minima and joins, written to the
    shared folder; no component meets in one task. Raises if ``max_rounds``
    do not suffice (rounds grow with the logarithm of a component)."""
    e = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u <> v").distinct(), "edges")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct())
        e = table(small, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
