"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only. Each document has a hash; the documents of a source
below a threshold of the hash space are taken once more. Thresholds are found
without sorting: sizes are summed by source and hash bucket (the top 12 bits),
the running sums of a source's buckets tell the bucket in which its budget
ends, and only that boundary bucket is refined by the next 12 bits, until the
hash (60 bits) is used up. Thresholds are nested: a larger budget of a source
takes all that a smaller one takes.

A source's target divided by its size is the number of full passes over it
plus a fraction; the fraction is what the threshold takes. At the end of the
refinement one hash value is left; it is taken if that comes nearer the target.

Defined cases: null text has size 0; a null source is a source of its own
(last in order); documents of size 0 are never taken (``times`` 0 or the full passes);
rows that repeat a doc_id and text share a hash and stay together; extra
columns are kept; empty input gives empty output. Targets of sources without
words are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.llm.common import read_table, table
from budgetlens.session import broadcast_if_small

#: Bits of hash per refinement and number of refinements.
BITS, LEVELS = 12, 5
WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str | Column) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(*columns: str) -> Column:
    """60 bits of md5 over the columns, as a long."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame, partitions: int = 16) -> DataFrame:
    """(source, source_size, weight): weights by position of the source in code
    point order, null last. The order is a range partitioning with a number
    inside each part and the parts' offsets; no task sees all sources."""
    named = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # UTF-8 strings compare by bytes, which is code point order
    parts = table(named.withColumn("missing", F.col("source").isNull())
                  .repartitionByRange(partitions, "missing", "source")
                  .withColumn("part", F.spark_partition_id())
                  .withColumn("place", F.row_number().over(
                      Window.partitionBy("part").orderBy("missing", "source"))), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # at most `partitions` rows
    other = counts.select(F.col("part").alias("p"), "n")
    offsets = (counts.select("part").join(F.broadcast(other), F.col("p") < F.col("part"), "left")
               .groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before")))
    k = (F.col("before") + F.col("place") - 1) % len(WEIGHTS)
    weight = F.when(k == 0, WEIGHTS[0]).when(k == 1, WEIGHTS[1]).otherwise(WEIGHTS[2])
    return (parts.join(F.broadcast(offsets), "part")
            .select("source", "source_size", weight.cast("double").alias("weight")))


def targets(sources: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``sources`` with ``target``: ``share`` of all sizes by weight, each at
    most ``ceiling`` times its source, the excess reshared by weight among the
    others until none is above. A loop of one aggregate each; it ends because
    every round caps one source more at least."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * ceiling
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        n, taken, weight = sources.agg(F.count_if(above), F.sum(F.when(above, cap)),
                                       F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, level = n, (total * share - (taken or 0.0)) / weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap))


def source_plan(base: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Per source: source_size, target, full (passes over all of it) and cut
    (hashes below it are taken once more). ``base``: (source, size, h) of every document."""
    goal = table(targets(ranked_sources(base), share, ceiling)
                 .withColumn("full", F.when(F.col("source_size") > 0,
                                            F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
                 .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size")), "targets")
    # cut: hashes below it are taken; left: budget still open above it
    cut = goal.select("source", F.lit(0).cast("long").alias("cut"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        step = F.shiftright(F.col("h"), low)
        inside = base.where("size > 0")
        if level:
            inside = (inside.join(cut.select("source", "cut").withColumnRenamed("source", "s"),
                                  F.col("source").eqNullSafe(F.col("s")))
                      .where(F.shiftright("h", low + BITS) == F.shiftright("cut", low + BITS)))
        histogram = inside.groupBy("source", step.alias("bucket")).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
        edge = (histogram.withColumn("before", before)
                .join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
                .where("before <= left")
                .groupBy("source").agg(F.max_by(F.struct("bucket", "before", "left", "words"), "bucket").alias("e")))
        last = level == LEVELS - 1
        found = F.shiftleft("e.bucket", low)
        rest = F.col("e.left") - F.col("e.before")
        # the last boundary value is taken if that comes nearer the budget
        whole = (rest * 2 >= F.col("e.words")).cast("long") if last else F.lit(0).cast("long")
        cut = table(cut.select(F.col("source").alias("s"), F.col("cut").alias("old"), F.col("left").alias("open"))
                    .join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
                    .select(F.col("s").alias("source"), F.coalesce(found + whole, "old").alias("cut"),
                            F.coalesce(rest, "open").alias("left")), f"cut{level}")
    return table(goal.withColumnRenamed("source", "s")
                 .join(cut.select(F.col("source").alias("c"), "cut"), F.col("s").eqNullSafe(F.col("c")))
                 .select(F.col("s").alias("source"), "source_size", "target", "full", "cut"), "plan")


def with_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, h, ...) with source_size, target and ``times``."""
    times = F.col("full") + ((F.col("size") > 0) & (F.col("h") < F.col("cut"))).cast("long")
    # one row per source; beyond a million sources the join is shuffled
    plan = broadcast_if_small(plan.withColumnRenamed("source", "__s"), 1_000_000)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("__s")))
            .withColumn("times", times.cast("long")).drop("__s", "full", "cut"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.col("source").cast("string").alias("source"), size_of("text").alias("size"), hash_of("doc_id", "text").alias("h"))


def mix(docs: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """doc_id, source, size, h, source_size, target and ``times`` (how often the
    mix takes the document) per row of ``docs`` (doc_id, text, source)."""
    base = table(_keyed(docs, "doc_id"), "sizes")  # words are counted once; all passes read this small table
    return with_times(base, source_plan(base.select("source", "size", "h"), share, ceiling))


def mixed_documents(docs: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them."""
    plan = source_plan(table(_keyed(docs), "sizes"), share, ceiling)
    rows = with_times(_keyed(docs, F.struct(*docs.columns).alias("__row")), plan).where("times > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("__row.*")


def op4_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR || chr(31) || text), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0::DOUBLE, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(w * (SELECT arg_min(level, cap / w) FILTER (WHERE w * level <= cap) FROM o), cap) AS target FROM o),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_times FROM t),
b AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before
  FROM (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h)),
c AS (
  SELECT g.source, max(b.h) AS h, arg_max(b.before, b.h) AS before, arg_max(b.words, b.h) AS words,
    any_value(g.target - g.full_times * g.source_size) AS budget
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
  WHERE b.before <= g.target - g.full_times * g.source_size GROUP BY g.source)
SELECT d.doc_id, d.size, g.source_size::BIGINT AS source_size, g.target,
  (d.size * (g.full_times + CASE WHEN d.h < c.h + (2 * (c.budget - c.before) >= c.words)::BIGINT THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
