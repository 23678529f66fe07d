"""M1, M4: isolation forest per department, fitted and scored as Spark jobs.

Behaviour (Liu, Ting and Zhou, 2008, with the common library defaults):
100 trees, each grown on psi = min(256, n) rows drawn without replacement;
at each node a random feature that is not constant in the node and a split
point uniform between its min and max (rows <= split go left); depth limit
ceil(log2 psi); path length of a leaf = depth + c(leaf size); score
2 ** (-mean path length / c(psi)), with c(n) = 2 (ln(n - 1) + Euler's gamma)
- 2 (n - 1) / n, c(2) = 1, c(1) = 0.

Spark plan:
  fit   - every tree draws its own ``psi`` rows from all rows of its department:
          the rows with the smallest keys, a tree's key of a row being integer
          arithmetic on two lanes of one md5 of its Project_ID. The department
          counts (broadcast behind a row check) turn into a bound per department,
          so a row is tested for all trees where it is read, and only rows
          that are candidates of a tree are shuffled (about 2 psi per tree);
          the exact ``psi`` smallest are kept per (department, tree). Trees are
          grown in blocks by ``applyInPandas`` (numpy), splits drawn from md5 per node. The model is a
          DataFrame: one row per (department, tree) with node arrays.
  score - the score depends only on the (department, features) point, so the
          distinct points are scored, not the rows. Points are split into
          hash buckets sized from each department's point count; the model rows
          of a department are replicated to its buckets and
          ``cogroup.applyInPandas`` walks all trees vectorised per bucket.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.session import broadcast_if_small, ship_package

EULER_GAMMA = 0.5772156649015329
#: Decimals of mean path lengths and scores.
DIGITS = 9

MODEL_SCHEMA = T.StructType([
    T.StructField("Department", T.StringType()),
    T.StructField("tree", T.IntegerType()),
    T.StructField("psi", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.ArrayType(T.DoubleType())),
])

SCORE_SCHEMA = T.StructType([
    T.StructField("Department", T.StringType()),
    T.StructField("x0", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("anomaly_score", T.DoubleType()),
])


def c_factor(n):
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    nb = np.where(big, n, 3.0)
    out = np.where(big, 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb, out)
    return out


def node_draws(seed: int, department, tree: int):
    """The random draws of one tree: per node (root 1, children 2i and 2i + 1)
    an integer that picks the feature and a fraction in [0, 1) that picks the
    split point, both from one md5, so that any engine can repeat them."""
    def draw(node: int) -> tuple[int, float]:
        digest = hashlib.md5(f"{seed}-{department}-{tree}-{node}".encode()).hexdigest()
        return int(digest[:8], 16), int(digest[8:21], 16) / 2**52
    return draw


def grow_tree(X: np.ndarray, draw, max_depth: int):
    """One isolation tree over the rows of X; returns node arrays. ``draw``
    gives the random numbers of a node (``node_draws``)."""
    feature, threshold, left, right, value = [], [], [], [], []
    c_of = c_factor(np.arange(X.shape[0] + 1)).tolist()   # leaf sizes <= rows

    def new_node():
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(0.0)
        return len(feature) - 1

    root = new_node()
    stack = [(root, 1, np.arange(X.shape[0]), 0)]
    while stack:
        node, place, idx, depth = stack.pop()
        n = idx.shape[0]
        if depth >= max_depth or n <= 1:
            value[node] = depth + c_of[n]
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            value[node] = depth + c_of[n]
            continue
        pick, u = draw(place)
        f = int(candidates[pick % candidates.size])
        t = float(lo[f]) + u * (float(hi[f]) - float(lo[f]))
        if t >= hi[f]:
            t = float(lo[f])
        go_left = sub[:, f] <= t
        feature[node] = f
        threshold[node] = t
        li, ri = new_node(), new_node()
        left[node], right[node] = li, ri
        stack.append((ri, 2 * place + 1, idx[~go_left], depth + 1))
        stack.append((li, 2 * place, idx[go_left], depth + 1))
    return feature, threshold, left, right, value


def fit_trees(drawn: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Grow the trees of one department whose drawn rows are in ``drawn``.

    Tree ``t`` splits by draws that depend on (seed, department, t, node) only,
    so the model does not depend on how trees are spread over tasks.
    """
    rows = []
    for t, own in drawn.groupby("tree"):
        own = own.sort_values(["key", "Project_ID", "x0", "x1"], kind="mergesort")
        department = own["Department"].iloc[0]
        X = own[["x0", "x1"]].to_numpy(dtype=np.float64)
        psi = X.shape[0]
        depth = int(math.ceil(math.log2(max(psi, 2))))
        rows.append((department, int(t), psi, *grow_tree(X, node_draws(seed, department, int(t)), depth)))
    return pd.DataFrame(rows, columns=[f.name for f in MODEL_SCHEMA.fields])


def path_lengths(X: np.ndarray, model: pd.DataFrame) -> np.ndarray:
    """Mean path length of every row of X over the trees in ``model``."""
    m = X.shape[0]
    total = np.zeros(m)
    ar = np.arange(m)
    for feat, thr, le, ri, val in zip(model["feature"], model["threshold"], model["left"],
                                      model["right"], model["value"]):
        feat = np.asarray(feat, dtype=np.int64)
        thr = np.asarray(thr, dtype=np.float64)
        le = np.asarray(le, dtype=np.int64)
        ri = np.asarray(ri, dtype=np.int64)
        val = np.asarray(val, dtype=np.float64)
        node = np.zeros(m, dtype=np.int64)
        while True:
            f = feat[node]
            inner = f >= 0
            if not inner.any():
                break
            go_left = X[ar, np.maximum(f, 0)] <= thr[node]
            node = np.where(inner, np.where(go_left, le[node], ri[node]), node)
        total += val[node]
    return total / max(len(model), 1)


def scores(mean_path: np.ndarray, psi: int) -> np.ndarray:
    """Scores from mean path lengths; both rounded to DIGITS, so that the order
    of summation does not show."""
    return np.round(np.power(2.0, -np.round(mean_path, DIGITS) / float(c_factor(psi))), DIGITS)


def score_bucket(points: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """cogroup side: score one bucket of a department's distinct points."""
    cols = [f.name for f in SCORE_SCHEMA.fields]
    if points.empty or model.empty:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in cols})
    model = model.sort_values("tree")
    X = points[["x0", "x1"]].to_numpy(dtype=np.float64)
    psi = int(model["psi"].iloc[0])
    score = scores(path_lengths(X, model), psi)
    return pd.DataFrame({
        "Department": points["Department"].to_numpy(),
        "x0": points["x0"].to_numpy(dtype=np.float64),
        "x1": points["x1"].to_numpy(dtype=np.float64),
        "n": points["n"].to_numpy(dtype=np.int64),
        "anomaly_score": score,
    })


# ---------------------------------------------------------------------------
# Spark side

def feature_rows(f: DataFrame) -> DataFrame:
    """Project the two model features, NULL -> 0."""
    return f.select(
        "Department", "Project_ID",
        F.coalesce(F.col("Utilization_Percentage").cast("double"), F.lit(0.0)).alias("x0"),
        F.coalesce(F.col("Delay_Days").cast("double"), F.lit(0.0)).alias("x1"))


#: Keys of the trees lie in [0, SPAN); candidates per tree in units of its rows.
SPAN, HEADROOM = 2**52 - 47, 2


def drawn_rows(rows: DataFrame, counts: DataFrame, trees: int, max_samples: int, seed: int) -> DataFrame:
    """(Department, tree, key, Project_ID, x0, x1): each tree's rows, the
    ``max_samples`` smallest keys of all rows of its department (all rows of a
    smaller one). With HEADROOM 2 a tree of 256 has fewer candidates than it
    needs with probability below 1e-30."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("Project_ID")))
    lane = [F.conv(F.substring(digest, at, 13), 16, 10).cast("bigint") for at in (1, 14)]
    bound = F.when(F.col("total") <= HEADROOM * max_samples, F.lit(SPAN)).otherwise(
        F.floor(F.lit(float(SPAN)) * HEADROOM * max_samples / F.col("total")))
    small = broadcast_if_small(counts.select("Department", "total"))
    tested = rows.join(small, "Department").select(
        "Department", "Project_ID", "x0", "x1", bound.cast("bigint").alias("bound"), lane[0].alias("a"), lane[1].alias("b"))

    def candidates(batches):  # all rows of a batch are tested for a tree together
        for batch in batches:
            a, b, bound = (batch.column(c).to_numpy() for c in ("a", "b", "bound"))
            key, step, found, keys = a % SPAN, b % SPAN, [], []
            for _ in range(trees):  # the key of tree t is (a + t * b) mod SPAN
                found.append(np.flatnonzero(key < bound))
                keys.append(key[found[-1]])
                key = key + step
                key -= SPAN * (key >= SPAN)
            at = pa.array(np.concatenate(found))
            department, project, x0, x1 = (batch.column(c).take(at) for c in ("Department", "Project_ID", "x0", "x1"))
            tree = pa.array(np.repeat(np.arange(trees, dtype=np.int32), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([department, tree, pa.array(np.concatenate(keys), pa.int64()), project, x0, x1],
                                             ["Department", "tree", "key", "Project_ID", "x0", "x1"])

    # rows without a Project_ID have no keys
    cand = tested.where("a is not null").mapInArrow(
        candidates, "Department string, tree int, key long, Project_ID string, x0 double, x1 double")
    from pyspark.sql.window import Window
    w = Window.partitionBy("Department", "tree").orderBy("key", "Project_ID", "x0", "x1")
    return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_samples).drop("_r")


def fit_forest(rows: DataFrame, counts: DataFrame, trees: int = 100,
               max_samples: int = 256, seed: int = 42, trees_per_block: int = 25,
               partitions: int | None = None) -> DataFrame:
    """Model DataFrame (MODEL_SCHEMA) for every department in ``counts``.

    ``rows``: Department, Project_ID, x0, x1. ``counts``: Department, total
    (only eligible departments).
    """
    ship_package(rows.sparkSession)
    drawn = drawn_rows(rows, counts, trees, max_samples, seed)
    # the explicit repartition keeps the CPU-heavy groups spread over tasks
    # (AQE would merge them by byte size)
    spread = (drawn.withColumn("block", F.floor(F.col("tree") / trees_per_block).cast("int"))
              .repartition(partitions or
                           int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                           "Department", "block"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_trees(pdf, seed)

    return spread.groupBy("Department", "block").applyInPandas(fit, MODEL_SCHEMA)


def score_points(points: DataFrame, model: DataFrame,
                 points_per_bucket: int = 250_000, partitions: int | None = None) -> DataFrame:
    """Score distinct points (Department, x0, x1, n) with ``model``.

    Both cogroup sides are hash-partitioned explicitly on (Department, bucket)
    with the same partition count, so the cogroup needs no further exchange
    and AQE cannot merge the CPU-heavy groups into a few tasks.
    """
    ship_package(points.sparkSession)
    parts = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_dept = points.groupBy("Department").agg(F.count(F.lit(1)).alias("_p"))
    nb = per_dept.select("Department", F.greatest(
        F.lit(1), F.ceil(F.col("_p") / F.lit(points_per_bucket)).cast("int")).alias("_nb"))
    nb = broadcast_if_small(nb)
    pts = (points.join(nb, "Department")
           .withColumn("bucket", F.pmod(F.xxhash64("x0", "x1"), F.col("_nb").cast("long"))
                       .cast("int"))
           .drop("_nb"))
    mdl = (model.join(nb, "Department")
           .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
           .drop("_nb"))
    pts = pts.repartition(parts, "Department", "bucket")
    mdl = mdl.repartition(parts, "Department", "bucket")
    return (pts.groupBy("Department", "bucket")
            .cogroup(mdl.groupBy("Department", "bucket"))
            .applyInPandas(score_bucket, SCORE_SCHEMA))
