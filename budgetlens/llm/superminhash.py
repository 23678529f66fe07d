"""Near-duplicate documents by SuperMinHash.

Per document the set of distinct 5-word shingles gets a SuperMinHash
signature: every shingle walks its own random permutation of the ``SLOTS``
slots, and its j-th step offers rank ``j`` plus a random fraction to the slot
it stands on; a slot keeps the smallest offer. Because an offer of step j is
below every offer of step j + 1, all shingles of a document take step j
together and the document stops after the step that leaves no slot empty.

1. Documents with the same shingle set are one class (grouped by a 128-bit
   digest of the set; only its smallest doc_id goes on).
2. ``BANDS`` bands of ``ROWS`` slots give buckets. In each bucket, every
   member is compared with the smallest one; verified links are joined by
   union-find.
3. In buckets whose members are still in several components, the members are
   dealt into blocks; a task compares two blocks, first by signatures, then by
   full sets, and returns links between different components only. No bucket
   meets in one task, nothing is capped, no list of pairs is written.
4. Verification is exact: the intersection of the full shingle sets.

A pair of similarity 0.75 shares no band with probability below 1e-5 and its
signature estimate is more than 5 standard deviations above ``FLOOR``.

Defined cases: null or empty texts and texts without words have no shingles
and are linked with nothing; shorter texts have one shingle, all their words;
of rows that repeat a doc_id with different texts one set (smallest digest)
stands for the document, and all its rows get its component; a null doc_id
takes no part in grouping and is kept;
extra columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import (components, distinct_per_text, fresh, mix64, one_per_text, prepare, read_table, release,
                                   shingle_hashes, slices, table, texts_of, word_hashes)
from budgetlens.session import broadcast_if_small

SHINGLE = 5
SLOTS, BANDS, ROWS = 128, 32, 4
#: Verified links have 100 * intersection >= 75 * union.
THRESHOLD = 75
#: Signature estimate below which a pair is not verified.
FLOOR = 0.55
#: Members of a bucket per block in step 3.
BLOCK = 512


def signatures(values: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (documents x slots, uint64: step in the high 32
    bits, fraction in the low ones) of the sets ``values[first[i]:first[i+1]]``.
    Empty sets have the largest value everywhere."""
    n = len(first) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * slots, empty)
    owner = np.repeat(np.arange(n), np.diff(first))
    x = values
    perm = None
    for j in range(slots):
        if not len(x):
            break
        r = mix64(x + np.uint64((j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        step = ((r >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64) + j
        rows = np.arange(len(x))
        if perm is None:
            slot = step
        else:
            slot = perm[rows, step].astype(np.int64)
        offer = np.uint64(j << 32) | (r & np.uint64(0xFFFFFFFF))
        at = owner * slots + slot
        order = np.lexsort((offer, at))
        at_sorted = at[order]
        head = np.ones(len(order), dtype=bool)
        head[1:] = at_sorted[1:] != at_sorted[:-1]
        best = order[head]
        out[at[best]] = np.minimum(out[at[best]], offer[best])
        open_docs = (out.reshape(n, slots) == empty).any(axis=1)
        go = open_docs[owner]
        if not go.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(go.sum()), 1))
        else:
            perm = perm[go]
        x, owner, step = x[go], owner[go], step[go]
        rows = np.arange(len(x))
        # the j-th step swapped places j and step of the permutation
        swapped = perm[rows, step].copy()
        perm[rows, step] = perm[rows, j]
        perm[rows, j] = swapped
    return out.reshape(n, slots)


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """Sorted distinct shingle hashes of each text: (values, first)."""
    return distinct_per_text(*shingle_hashes(*word_hashes(texts), k))


def digests(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128-bit digest of each set; None for an empty one."""
    cut = first.tolist()
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut, cut[1:])]


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null when empty), bands (array
    of bucket keys), sig (one byte per slot)."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"

    def run(batches):
        for part in slices(batches, text, 2 << 20):
            values, first = shingle_sets(texts_of(part.column(text)))
            sig = signatures(values, first)
            n = np.diff(first)
            keys = np.zeros((len(n), BANDS), np.uint64)
            for i in range(ROWS):
                keys = mix64(keys + sig.reshape(len(n), BANDS, ROWS)[:, :, i])
            keys = mix64(keys + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            small = (mix64(sig) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests(values, first), pa.binary()),
                pa.array([k if c else None for k, c in zip(keys, n)], pa.list_(pa.int64())),
                pa.array([s.tobytes() if c else None for s, c in zip(small, n)], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "bands", "sig"])
        release()

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def sets_of(docs: DataFrame, ids: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, shingles: sorted array of long) of the documents in ``ids``
    (doc_id, digest): their texts with that digest."""
    def run(batches):
        for part in slices(batches, text, 2 << 20):
            values, first = shingle_sets(texts_of(part.column(text)))
            keep = pa.array([a == b for a, b in zip(digests(values, first), part.column("digest").to_pylist())])
            sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(keep), sets.filter(keep)], ["doc_id", "shingles"])

    # up to a million ids (8 MB) the texts are filtered where they are read; beyond, they are shuffled
    wanted = (docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias(text))
              .join(broadcast_if_small(ids, 1_000_000), "doc_id"))
    # rows that repeat a doc_id and text give the same set
    return wanted.mapInArrow(run, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"])


def likely(pairs: DataFrame) -> DataFrame:
    """The pairs (a, sa, na, b, sb, nb, ...) whose sizes and signatures allow the threshold."""
    low = int(FLOOR * SLOTS)

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sa", "sb"))
            keep = (x == y).sum(axis=1) >= low
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    sizes = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * THRESHOLD)
    return pairs.where(sizes).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) linked by their full shingle sets. Sets are made anew
    from the texts of the documents in ``pairs`` only; ``known`` has their
    digests."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(known, "doc_id"), "ids")
    sets = table(sets_of(docs, ids), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * THRESHOLD).select("a", "b")


def block_links(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between members of one bucket that lie in
    different components; one link per member and other component is enough
    and returned. ``members``: (key, doc_id, component, n, sig). Each bucket is
    dealt into blocks by a hash; a task compares two blocks: sizes, then
    signatures, then the full sets."""
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = (members.join(counts, "key")
             .withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = (both.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                        "mine", "doc_id", "component", "n", "sig").join(sets, "doc_id"))
    low = int(FLOOR * SLOTS)

    def compare(key, batch):
        i, j = key[1].as_py(), key[2].as_py()
        batch = batch.combine_chunks()
        ids, comp, n, mine = (batch.column(c).to_numpy() for c in ("doc_id", "component", "n", "mine"))
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
        lists = batch.column("shingles").combine_chunks()
        values = lists.flatten().to_numpy().view(np.uint64)
        first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = [], []
        for k in left.tolist():
            to = right[right > k] if i == j else right
            to = to[(comp[to] != comp[k]) & (np.minimum(n[to], n[k]) * 100 >= np.maximum(n[to], n[k]) * THRESHOLD)]
            to = to[(sig[to] == sig[k]).sum(axis=1) >= low]
            if not len(to):
                continue
            own = values[first[k]:first[k + 1]]
            theirs = np.concatenate([values[first[x]:first[x + 1]] for x in to.tolist()])
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            common = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(n[to])[:-1])), dtype=np.int64)
            to = to[common * 100 >= (n[to] + n[k] - common) * THRESHOLD]
            to = to[np.unique(comp[to], return_index=True)[1]]
            a += [ids[k]] * len(to)
            b += ids[to].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs``."""
    made = table(sketch(docs, text), "sketch")
    # one set per doc_id, one class per set, named by its smallest doc_id
    one = made.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = table(one.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    known = classes.select(F.col("rep").alias("doc_id"), "digest")
    reps = table(made.select("doc_id", "digest", "n_shingles", "bands", "sig").join(known, ["doc_id", "digest"])
                 .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sig"), "reps")
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("members")).where("members > 1")
    shared = table(keyed.join(first, "key"), "buckets")  # only buckets with two members and more
    sig = reps.select("rep", "n_shingles", "sig")

    def with_signatures(pairs):
        return (pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b"))

    stars = shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    links = table(verified(docs.select("doc_id", text), table(likely(with_signatures(stars)), "pairs"), known), "links")
    found = table(components(links, "a", "b"), "components")
    # buckets of three and more whose members are not in one component yet
    placed = (shared.where("members > 2").join(found.toDF("rep", "c"), "rep", "left")
              .withColumn("component", F.coalesce("c", "rep")))
    split = (placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
             .where("x <> y").select("key"))
    members = (placed.join(split, "key").join(sig, "rep")
               .select("key", F.col("rep").alias("doc_id"), "component", F.col("n_shingles").alias("n"), "sig"))
    members = table(members, "members")
    sets = table(sets_of(docs.select("doc_id", text), table(members.select("doc_id").distinct().join(known, "doc_id"), "ids")), "sets")
    more = table(block_links(members, sets), "links")
    final = components(links.unionByName(more), "a", "b")
    named = (one.join(classes.join(final.toDF("rep", "component"), "rep", "left")
                      .select("digest", F.coalesce("component", "rep").alias("component")), "digest")
             .select(F.col("doc_id").alias("id"), "component"))
    return (made.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates (the one
    with the smallest doc_id). Different texts of one doc_id are documents of
    their own, behind all others in that order; of rows that repeat a doc_id
    and its text one stays."""
    key, gone = fresh(docs, "__key", "__gone")
    rows = one_per_text(docs, key, text)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    out = table(found.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return rows.join(broadcast_if_small(out, 1_000_000), F.col(key) == F.col(gone), "left_anti").select(*docs.columns)


def op3_superminhash(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Equal sets are one class; classes that share one of their rarest shingles (as many
#: as a pair of similarity 0.75 cannot miss) are compared in full, then joined up.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, CAST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS VARCHAR[]) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))) END AS s
  FROM words
), classes AS (
  SELECT s, min(doc_id) AS a, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), held AS (
  SELECT a, n, unnest(s) AS x FROM classes
), rare AS (
  SELECT a, n, x, row_number() OVER (PARTITION BY a ORDER BY df, x) AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM held)
), firsts AS (
  SELECT a, n, x FROM rare WHERE r <= n - ceil(n * 0.75) + 1
), cand AS (
  SELECT DISTINCT p.a, q.a AS b FROM firsts p JOIN firsts q ON p.x = q.x AND p.a < q.a
  WHERE 4 * least(p.n, q.n) >= 3 * greatest(p.n, q.n)
), links AS (
  SELECT c.a, c.b FROM cand c JOIN classes p ON p.a = c.a JOIN classes q ON q.a = c.b
  WHERE 100 * len(list_intersect(p.s, q.s)) >= 75 * (p.n + q.n - len(list_intersect(p.s, q.s)))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, a AS b FROM classes
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), roots AS (
  SELECT a, min(b) AS root FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
       CAST(coalesce(r.root, d.doc_id) AS BIGINT) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN roots r ON r.a = c.a
"""
