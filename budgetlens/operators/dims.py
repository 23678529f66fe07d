"""Table operations on the user dimension, and the entitlement table.

The dimension is plain (username, email, full_name, role, department,
disabled); no secrets. Every operation returns a new snapshot DataFrame;
writing it back is the caller's ``write_facts``-style overwrite.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from budgetlens.session import drop_scratch, materialize, ship_package

USER_DDL = ("username string, email string, full_name string, role string, "
            "department string, disabled boolean")

# The standing accounts besides one user per department.
STANDING_USERS = [
    ("admin", "admin@gov.in", "Admin User", "admin", None, False),
    ("public_user", "public@citizen.in", "Public User", "public", None, False),
    ("retired_admin", None, "Retired Admin", "admin", None, True),
]


def department_username(department: str | Column) -> Column:
    d = F.col(department) if isinstance(department, str) else department
    return F.concat(F.lower(F.regexp_replace(d, "[^A-Za-z0-9]+", "_")), F.lit("_dept"))


def entitlements_from_facts(f: DataFrame) -> DataFrame:
    """The entitlement table: one department user per Department in the facts
    plus the standing accounts (admin, public, one disabled admin)."""
    depts = f.select("Department").distinct().filter(F.col("Department").isNotNull())
    users = depts.select(
        department_username("Department").alias("username"),
        F.concat(department_username("Department"), F.lit("@gov.in")).alias("email"),
        F.concat(F.initcap(F.col("Department")), F.lit(" Officer")).alias("full_name"),
        F.lit("department").alias("role"),
        F.col("Department").alias("department"),
        F.lit(False).alias("disabled"))
    standing = f.sparkSession.createDataFrame(STANDING_USERS, USER_DDL)
    return users.unionByName(standing)


def _first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``. A grouped ``min`` of a
    struct, combined map-side, so a key repeated on many rows is no hot task."""
    first = F.min(F.struct(*order, *[c for c in df.columns if c not in keys and c not in order]))
    picked = df.groupBy(*keys).agg(first.alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c)
                                  for c in df.columns if c not in keys]).select(*df.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str],
           update_cols: list[str]) -> DataFrame:
    """Insert new keys; on a key conflict replace only ``update_cols``
    (INSERT .. ON CONFLICT DO UPDATE SET col = excluded.col).

    One full outer join on the keys. ``changes`` is reduced to one row per key
    first (the smallest by all its columns), so a repeated key cannot fan out.
    """
    cols = target.columns
    changes = _first_per_key(changes.select(*cols), keys, [c for c in cols if c not in keys])
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols if c not in keys],
                      F.lit(True).alias("_in_t"))
    c = changes.select(*keys, *[F.col(x).alias(f"_c_{x}") for x in cols if x not in keys],
                       F.lit(True).alias("_in_c"))
    j = t.join(c, keys, "full_outer")
    out = []
    for col in cols:
        if col in keys:
            out.append(F.col(col))
        elif col in update_cols:
            out.append(F.when(F.col("_in_c"), F.col(f"_c_{col}"))
                       .otherwise(F.col(f"_t_{col}")).alias(col))
        else:
            out.append(F.when(F.col("_in_t"), F.col(f"_t_{col}"))
                       .otherwise(F.col(f"_c_{col}")).alias(col))
    return j.select(*out)


def update_where_in(df: DataFrame, key: str, keys: DataFrame | list, column: str,
                    value) -> DataFrame:
    """Set ``column`` to ``value`` on the rows whose ``key`` is listed.

    A Python list becomes an ``isin`` filter; a DataFrame of keys is matched by
    a left join on distinct keys (the planner broadcasts it when it is small).
    """
    if isinstance(keys, list):
        hit = F.col(key).isin(keys)
        return df.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
    marks = keys.select(F.col(keys.columns[0]).alias(key)).distinct() \
                .withColumn("_hit", F.lit(True))
    return (df.join(marks, key, "left")
            .withColumn(column, F.when(F.coalesce(F.col("_hit"), F.lit(False)), F.lit(value))
                        .otherwise(F.col(column)))
            .drop("_hit").select(*df.columns))


#: Most rows of a clash component that one task settles in order.
COMPONENT_ROWS = 100_000


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``edges`` (a, b: bigint, a > b), root being the
    smallest node of its component.

    Alternating stars: each node hands its larger neighbours to the smallest one it
    knows, then its smaller ones, until nothing changes; about log(nodes) times,
    one written table each. Grouped minima joined back, so a node with very many
    neighbours is no hot task (map-side minimum, AQE splits the join)."""
    def digest(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.distinct(), "clash-edges")
    before = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "clash-edges")
        drop_scratch(edges)
        edges, now = after, digest(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("_node"), F.col("b").alias("_root"))


def _settle(unique: list[str]):
    """Settles one component in order: rows that are in, then the others one
    after another."""
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_seq", kind="stable")
        taken: list[set] = [set() for _ in unique]
        values = [rows[f"_u{i}"].tolist() for i in range(len(unique))]
        inside, why = rows["_in"].tolist(), []
        for r, accepted in enumerate(inside):
            mine = [v[r] for v in values]
            clash = None if accepted else next(
                (unique[i] for i, v in enumerate(mine) if v is not None and v in taken[i]), None)
            why.append(None if clash is None else f"{clash} repeated in batch")
            if clash is None:
                for i, v in enumerate(mine):
                    if v is not None:
                        taken[i].add(v)
        return pd.DataFrame({"_id": rows["_id"], "_told": why}).astype({"_told": object})
    return settle


def _settle_components(work: DataFrame, unique: list[str], largest: int) -> DataFrame:
    """Decide the open rows of all clash components of at most ``largest`` rows.

    Two rows clash where they share a value; of the rows that are in, at most one
    holds a value, and it comes before every open row that does. A component is
    settled in order by one task; those that are larger stay open."""
    live = work.where("_why is null").select(
        "_id", "_place", "_in", *[F.col(c).cast("string").alias(f"_u{i}") for i, c in enumerate(unique)])
    edges = None
    for i in range(len(unique)):
        held = live.where(F.col(f"_u{i}").isNotNull()).select("_id", "_in", F.col(f"_u{i}").alias("_v"))
        first = held.groupBy("_v").agg(F.min("_id").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_in").alias("settled"))
        one = held.join(first.where("n > 1 and not settled"), "_v").where(F.col("_id") > F.col("b")).select(F.col("_id").alias("a"), "b")
        edges = one if edges is None else edges.unionByName(one)
    roots = _components(edges)
    named = live.join(roots, live["_id"] == roots["_node"], "left").withColumn("_root", F.coalesce("_root", "_id")).drop("_node")
    # rows that are in and clash with nothing open are components of their own
    sizes = named.groupBy("_root").agg(F.count(F.lit(1)).alias("n"), F.min("_in").alias("settled")).where(
        (F.col("n") <= largest) & ~F.col("settled")).select("_root")
    chosen = named.join(sizes, "_root", "left_semi").withColumn(
        "_seq", F.row_number().over(Window.partitionBy("_root").orderBy(F.col("_in").desc(), "_place")))
    told = chosen.drop("_place").groupBy("_root").applyInPandas(_settle(unique), "_id bigint, _told string").withColumn("_done", F.lit(True))
    joined = work.join(told, "_id", "left")
    return joined.select(*[c for c in work.columns if c not in ("_why", "_in")], F.coalesce("_why", "_told").alias("_why"),
                         (F.col("_in") | (F.coalesce("_done", F.lit(False)) & F.col("_told").isNull())).alias("_in"))


def append_new(target: DataFrame, new: DataFrame, unique: list[str] | None = None,
               order: list[str] | None = None, largest: int = COMPONENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Insert rows whose unique columns are not taken; return
    (snapshot, rejected-with-reason).

    The rows of ``new`` are inserted one after another by ``order`` (rows that
    are equal there, one after another too): a row is rejected for the first
    unique column (in the order given) whose value is in ``target`` or was
    taken by an earlier row that was itself accepted; NULL never clashes.

    First two rounds over the open rows: a row whose value is taken by an
    accepted row is rejected, a row that is the first open one for each of its
    values is accepted. That settles all but chains of clashes, a value repeated on
    very many rows included. What is still open falls into components of rows that
    share values: each of at most ``largest`` rows is settled in order by one task,
    all of them at once, however long the chain. Larger ones go on by rounds, and
    what they fall into is settled the same way every eight rounds. Each check is a
    grouped minimum joined back on one column (AQE splits a hot value); each round
    is written once to the shared folder.
    """
    unique = unique or ["username", "email"]
    order = order or [c for c in new.columns]
    ship_package(target.sparkSession)
    # equal rows get places of their own; the written table fixes them
    work = materialize(new.select(*target.columns, F.monotonically_increasing_id().alias("_id"), F.struct(*order).alias("_place"))
                       .withColumn("_place", F.struct(F.col("_place").alias("o"), F.col("_id").alias("i")))
                       .withColumn("_why", F.lit(None).cast("string")).withColumn("_in", F.lit(False)), "append")
    for col in unique:  # values that the target holds
        taken = target.select(F.col(col)).where(F.col(col).isNotNull()).distinct().withColumn("_t", F.lit(True))
        work = work.join(taken, col, "left").withColumn(
            "_why", F.coalesce("_why", F.when(F.col("_t"), F.lit(f"{col} already registered")))).drop("_t")
    work = materialize(work, "append")
    rounds = 0
    while not work.where("_why is null and not _in").isEmpty():
        if rounds % 8 == 2:
            settled = _settle_components(work, unique, largest)
        else:
            settled = _round(work, unique)
        done, work, rounds = work, materialize(settled, "append"), rounds + 1
        drop_scratch(done)
    accepted = work.where("_in").select(*target.columns)
    rejected = work.where("not _in").select(*target.columns, F.col("_why").alias("reason"))
    return target.unionByName(accepted), rejected


def _round(work: DataFrame, unique: list[str]) -> DataFrame:
    """Reject what accepted rows clash with, accept what is first everywhere."""
    columns = [c for c in work.columns if c not in ("_why", "_in")]
    is_first = F.lit(True)
    for col in unique:
        by_value = work.where((F.col("_why").isNull()) & F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(
            F.max("_in").alias(f"_got_{col}"), F.min(F.when(~F.col("_in"), F.col("_place"))).alias(f"_next_{col}"))
        work = work.join(by_value, F.col(col) == F.col("_v"), "left").drop("_v")
        is_first = is_first & (F.col(col).isNull() | (F.col(f"_next_{col}") == F.col("_place")))
    open_ = F.col("_why").isNull() & ~F.col("_in")
    # a column counts once the earlier ones are settled: the row is the first open one there
    why, settled = F.lit(None).cast("string"), F.lit(True)
    for c in unique:
        why = F.coalesce(why, F.when(settled & F.col(f"_got_{c}"), F.lit(f"{c} repeated in batch")))
        settled = settled & (F.col(c).isNull() | (F.col(f"_next_{c}") == F.col("_place")))
    return work.select(*columns, F.when(open_, why).otherwise(F.col("_why")).alias("_why"),
                       (F.col("_in") | (open_ & why.isNull() & is_first)).alias("_in"))
