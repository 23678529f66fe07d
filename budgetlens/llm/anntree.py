"""Approximate nearest neighbours by largest inner product: a hierarchical
k-means tree searched best bin first.

The inner product becomes a distance by one more component,
``sqrt(M^2 - |x|^2)`` with ``M`` the largest norm (0 for a query): the nearest
vector then is the one with the largest inner product. The tree is fitted on
a bounded sample (``SAMPLE`` rows with the smallest hash of their id), every
row is indexed at the leaf it falls into. A query walks the tree with a
priority queue of nodes by distance to their centre and visits leaves in the
order in which they come out. How many leaves, is calibrated: for
``CALIBRATION`` queries the exact neighbours among all rows are found by brute
force, and visits widen until ``RECALL`` of them lie in visited leaves; a walk
goes on beyond that while its leaves hold fewer than ``k`` other ids.

Rows are dealt by leaf into bins of about ``BIN`` rows (neighbouring leaves
share a bin, a large leaf is split by a hash of the row) and queries go to the
bins of their leaves; a hot bin's queries are split into blocks. A task
compares one block of queries with the leaves of one bin that they visit and
returns the best; scores are sums in double precision in the order of the components.

Defined cases: rows whose id or vector is null, whose vector is zero, holds a
null or non-finite component or has another length than most (ties: the
shorter), take no part; rows that repeat a vec_id count once, with the best
score; equal scores go to the smaller vec_id; fewer candidates than ``k`` give
fewer rows; no valid rows or queries give an empty table; other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.llm.common import prepare, read_table, table

SAMPLE, BRANCH, ITERATIONS, DEPTH = 16384, 8, 8, 12
LEAF_ROWS = 96
CALIBRATION, RECALL = 128, 0.95
BIN, QUERY_BLOCK = 2048, 4096


def valid_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, v) of the rows that take part; v is array<float> where the
    column is one, else array<double>."""
    v = F.col(embedding)
    kind = "array<float>" if "float" in vectors.schema[embedding].dataType.simpleString() else "array<double>"
    fine = (F.col(vec_id).isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast(kind).alias("v"))
    widths = (rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect())
    return _once(rows.where(F.size("v") == (widths[0]["d"] if widths else 0)))


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, v) without repeats of a whole row. Vectors are shuffled
    only where a vec_id repeats."""
    twice = table(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "twice")
    if twice.isEmpty():
        return rows
    return (rows.join(twice, "vec_id", "left_anti").select("vec_id", "v")
            .unionByName(rows.join(twice, "vec_id", "left_semi").select("vec_id", "v").distinct()))


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


class Tree:
    """Centres and children of the nodes; leaves are numbered in tree order."""

    def __init__(self, centres, children, leaf_of):
        self.centres, self.children, self.leaf_of = centres, children, leaf_of
        self.n_leaves = 1 + max(leaf_of)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``, descending to the nearest child."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            near = np.argmin(_distances(x[rows], self.centres[kids]), axis=1)
            todo += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int, held: dict[int, int] | None = None, need: int = 0) -> list[list[int]]:
        """The first ``visits`` leaves of a best-bin-first walk per query, and
        more until the leaves hold ``need`` rows by ``held`` (leaf: rows)."""
        to = _distances(q, self.centres)
        out = []
        for d in to:
            heap, leaves, got = [(0.0, 0)], [], 0
            while heap and (len(leaves) < visits or got < need):
                _, node = heapq.heappop(heap)
                if not self.children[node]:
                    leaves.append(self.leaf_of[node])
                    got += held.get(leaves[-1], 0) if held else 0
                for kid in self.children[node]:
                    heapq.heappush(heap, (float(d[kid]), kid))
            out.append(leaves)
        return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def build_tree(x: np.ndarray, leaf_sample: int, seed: int = 11) -> Tree:
    """Hierarchical k-means over the sample ``x``."""
    rng = np.random.default_rng(seed)
    centres, children, leaf_of = [x.mean(0)], [[]], [-1]
    leaves = 0
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        parts = []
        if len(rows) > leaf_sample and depth < DEPTH:
            own = x[rows]
            c = own[rng.choice(len(rows), min(BRANCH, len(rows)), replace=False)]
            for _ in range(ITERATIONS):
                near = np.argmin(_distances(own, c), axis=1)
                c = np.array([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            near = np.argmin(_distances(own, c), axis=1)
            parts = [(c[i], rows[near == i]) for i in range(len(c)) if (near == i).any()]
        if len(parts) < 2:
            leaf_of[node] = leaves
            leaves += 1
            continue
        for centre, members in parts:
            children[node].append(len(centres))
            centres.append(centre)
            children.append([])
            leaf_of.append(-1)
        todo += [(kid, members, depth + 1) for kid, (_, members) in reversed(list(zip(children[node], parts)))]
    return Tree(np.array(centres, np.float64), children, leaf_of)


def _matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as float64, with the added component 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.zeros((len(flat), d + 1))
    x[:, :d] = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)
    return x


def _augment(x: np.ndarray, top: float) -> np.ndarray:
    x[:, -1] = np.sqrt(np.maximum(top - (x[:, :-1] ** 2).sum(1), 0))
    return x


def _best(q_ids, q, x_ids, x, k: int, hidden=None):
    """(query row, row, score) of the ``k`` best per query, exact scores, each
    vec_id once; pairs that are ``hidden`` (queries x rows) do not count."""
    s = q @ x.T
    s[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if hidden is not None:
        s[hidden] = -np.inf
    by_id = np.argsort(x_ids, kind="stable")
    first = np.flatnonzero(np.diff(x_ids[by_id], prepend=x_ids[by_id[:1]] - 1))
    top = s if len(first) == len(x_ids) else np.maximum.reduceat(s[:, by_id], first, axis=1)  # of each vec_id
    if top.shape[1] > k:
        edge = -np.partition(-top, k - 1, axis=1)[:, k - 1]
    else:
        edge = np.full(len(s), -np.inf)
    # a margin above the rounding of the matrix product keeps all ties
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
    row, col = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
    score = np.zeros(len(row))
    for i in range(q.shape[1]):
        score += q[row, i] * x[col, i]
    if top is not s:
        order = np.lexsort((-score, x_ids[col], row))
        row, col, score = row[order], col[order], score[order]
        once = np.ones(len(row), dtype=bool)
        once[1:] = (row[1:] != row[:-1]) | (x_ids[col[1:]] != x_ids[col[:-1]])
        row, col, score = row[once], col[once], score[once]
    order = np.lexsort((x_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
    keep = place < k
    return row[keep], col[keep], score[keep]


def fit(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS):
    """(tree, width, largest squared norm, number of rows) from a bounded sample."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top, d = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return None, 0, 0.0, 0
    chosen = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "v").limit(sample).drop("h").toArrow()
    x = _augment(_matrix(chosen.column("v"), d), top)
    share = min(n, sample) / n
    return build_tree(x, max(8, int(leaf_rows * share))), d, float(top), n


def index(rows: DataFrame, tree: Tree, d: int, top: float) -> DataFrame:
    """Every row with its leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # at most SAMPLE / 8 leaves

    def run(batches):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(_augment(_matrix(b.column("v"), d), top))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], [*b.schema.names, "leaf"])

    return rows.mapInArrow(run, f"vec_id long, v {_kind(rows)}, leaf long")


def calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, d: int, k: int,
              recall: float = RECALL, n: int = CALIBRATION) -> int:
    """Leaf visits after which ``recall`` of the exact neighbours of ``n``
    queries (smallest hashes) lie in visited leaves."""
    some = queries.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "v").limit(n).drop("h").toArrow()
    if not some.num_rows:
        return 1
    q_ids, q = some.column("vec_id").to_numpy(), _matrix(some.column("v"), d)
    shared = indexed.sparkSession.sparkContext.broadcast((q_ids, q[:, :d]))

    def brute(batches):
        ids, x = shared.value
        held = None  # the best so far of this task, at most n * k rows
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), d)[:, :d]
            vec, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            row, col, score = _best(ids, x, vec, v, k)
            new = pd.DataFrame({"q": row, "vec_id": vec[col], "score": score, "leaf": leaf[col]})
            held = (pd.concat([held, new]).sort_values(["q", "score", "vec_id", "leaf"], ascending=[True, False, True, True])
                    .drop_duplicates(["q", "vec_id"]).groupby("q").head(k))
        if held is not None:
            yield pa.RecordBatch.from_pandas(held.astype({"q": "int64", "leaf": "int64"}), preserve_index=False)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    true = (indexed.mapInArrow(brute, "q long, vec_id long, score double, leaf long")
            .groupBy("q", "vec_id").agg(F.max("score").alias("score"), F.max_by("leaf", F.struct("score", -F.col("leaf"))).alias("leaf"))
            .withColumn("r", place).where(F.col("r") <= k).select("q", "leaf").toPandas())  # at most n * k rows
    if not len(true):
        return 1
    walks = tree.best_bins(q, tree.n_leaves)
    position = [{leaf: i for i, leaf in enumerate(w)} for w in walks]
    visits = np.sort([position[i][leaf] + 1 for i, leaf in zip(true["q"], true["leaf"])])
    return int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))) - 1)])


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
           embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row that
    ``is_query`` (a condition on vec_id), among all other rows."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    prepare(spark)
    rows = valid_rows(vectors, vec_id, embedding)
    tree, d, top, n = fit(rows)
    if tree is None:
        return spark.createDataFrame([], out)
    indexed = table(index(rows, tree, d, top), "vectors")
    queries = rows.where(is_query)
    visits = calibrate(indexed, queries, tree, d, k, recall)
    # leaves in tree order to bins: (first bin, bins); as many rows as the tree has leaves
    sizes = {r[0]: r[1] for r in indexed.groupBy("leaf").count().collect()}
    bins, held, nxt = {}, 0, 0
    for leaf in range(tree.n_leaves):
        size = sizes.get(leaf, 0)
        if not size:
            continue
        if size > BIN:
            nxt += held > 0
            bins[leaf] = (nxt, -(-size // BIN))
            nxt, held = nxt + bins[leaf][1], 0
            continue
        if held + size > BIN:
            nxt, held = nxt + 1, 0
        bins[leaf] = (nxt, 1)
        held += size
    plan = F.broadcast(spark.createDataFrame([(a, *b) for a, b in bins.items()], "leaf long, first long, n_bins long"))
    # each vec_id at the first of its leaves: what visited leaves hold of distinct ids, at least
    homes = {r[0]: r[1] for r in indexed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()}
    shared = spark.sparkContext.broadcast((tree, bins, homes))

    def walk(batches):
        tree, bins, homes = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            to = []
            for leaves in tree.best_bins(_matrix(b.column("v"), d), visits, homes, k + 1):
                of_bin: dict[int, list[int]] = {}
                for leaf in leaves:
                    first, m = bins.get(leaf, (0, 0))
                    for i in range(first, first + m):
                        of_bin.setdefault(i, []).append(leaf)
                to.append([{"bin": i, "leaves": x} for i, x in of_bin.items()])
            kind = pa.list_(pa.struct([("bin", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, kind)], ["query_id", "v", "bins"])

    asked = table(queries.mapInArrow(walk, f"query_id long, v {_kind(rows)}, "
                                           "bins array<struct<bin:long,leaves:array<long>>>"), "walks")
    asked = asked.select("query_id", "v", F.explode("bins").alias("b")).select("query_id", "v", "b.bin", "b.leaves")
    blocks = asked.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    left = (asked.join(blocks, "bin").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
            .select("bin", "block", "query_id", "v", "leaves"))
    right = (indexed.join(plan, "leaf")
             .withColumn("bin", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("n_bins")))
             .join(blocks, "bin").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("bin", "block", "vec_id", "leaf", "v"))

    def compare(key, q, x):
        if not q.num_rows or not x.num_rows:
            return _packed(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)))
        q_ids, qv = q.column("query_id").to_numpy(), _matrix(q.column("v"), d)[:, :d]
        x_ids, xv, at = x.column("vec_id").to_numpy(), _matrix(x.column("v"), d)[:, :d], x.column("leaf").to_numpy()
        visited = q.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(q_ids)), visited.value_lengths().to_numpy(zero_copy_only=False))
        leaves = visited.flatten().to_numpy()
        # only queries that visit a leaf see its rows
        own, of_row = np.unique(at, return_inverse=True)
        here = np.isin(leaves, own)
        visits_here = np.zeros((len(q_ids), len(own)), dtype=bool)
        visits_here[owner[here], np.searchsorted(own, leaves[here])] = True
        row, col, score = _best(q_ids, qv, x_ids, xv, k, ~visits_here[:, of_row])
        return _packed(*_pruned(q_ids[row], x_ids[col], score, k))

    found = (left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block"))
             .applyInArrow(compare, _PACKED))

    def merge(batches):
        held = None  # the best so far of this task's queries
        for b in batches:
            new = _unpacked(b)
            held = _pruned(*(np.concatenate(p) for p in zip(held, new)), k) if held else _pruned(*new, k)
        if held is not None and len(held[0]):
            yield from _packed(*held).to_batches()

    def rows_out(batches):
        for b in merge(batches):
            q, vec, score = _unpacked(b)
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rank, pa.int32()), pa.array(vec), pa.array(score)],
                                             ["query_id", "rank", "vec_id", "score"])

    # each task merges what its bins gave before the shuffle by query, and after it
    return found.mapInArrow(merge, _PACKED).repartition("query_id").mapInArrow(rows_out, out)


_PACKED = "query_id long, vecs array<long>, scores array<double>"


def _pruned(q, vec, score, k: int):
    """The ``k`` best of each query, each vec_id once; sorted by query and rank."""
    order = np.lexsort((-score, vec, q))
    q, vec, score = q[order], vec[order], score[order]
    once = np.ones(len(q), dtype=bool)
    once[1:] = (q[1:] != q[:-1]) | (vec[1:] != vec[:-1])
    q, vec, score = q[once], vec[once], score[once]
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], vec[keep], score[keep]


def _packed(q, vec, score) -> pa.Table:
    """One row per query (sorted) with arrays of its candidates."""
    ids, first = np.unique(q, return_index=True)
    cuts = pa.array(np.concatenate((first, [len(q)])), pa.int32())
    return pa.table({"query_id": pa.array(ids, pa.int64()), "vecs": pa.ListArray.from_arrays(cuts, pa.array(vec, pa.int64())),
                     "scores": pa.ListArray.from_arrays(cuts, pa.array(score, pa.float64()))})


def _unpacked(b):
    counts = b.column("vecs").value_lengths().to_numpy(zero_copy_only=False)
    return (np.repeat(b.column("query_id").to_numpy(), counts), b.column("vecs").flatten().to_numpy(),
            b.column("scores").flatten().to_numpy())


def op2_ann_tree(spark, sf_dir):
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
