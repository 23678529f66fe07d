"""Spelling variant grouping by a relational trie frontier.

Words meet in tries that are tables of edges, and a table of states (word,
position, node, edits) moves down one level per round by a join with the edges
of that level. Words that differ by one code point agree on the first or the
last half, so the edit is looked for in the other half only: there is a trie
for each direction, word length and half of that length (its root), and a word
enters the trie of its own length (one code point replaced) and of one less
(one of its own deleted); an insertion is the deletion seen from the other word.

A state without an edit meets all edges of its node: an equal label moves on
unchanged, another label uses up the edit at this first difference, where it
must be if there is one. A state with its edit follows the equal label only. A
state with one edit at the end of the trie (or with one code point left) is a
pair of neighbours. How far a node spreads is bounded by the letters that follow
it, not by how many words share its half.

Labels are one code point, for words of more than ``DEPTH`` of them a
piece of 1/``DEPTH`` of the word, so the number of rounds is bounded (equal or
one edit apart is then asked of the piece). Nodes are named by 64-bit hashes of
their path; pairs are compared as strings in the end, so a collision adds
nothing. Frequencies come from per-task sums and one grouped sum.

Defined cases: null and empty texts have no runs; runs of any length are whole;
rows that repeat count again; a null doc_id is written as nothing in front of
the colon; a run of one code point that is deleted is no word; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import prepare, read_table, release, slices, table

#: A run's crc32 that this divides loses one code point.
NOISE = 31
SHORTEST, LEAST = 7, 2
#: A near word of this many times the occurrences can be a word's form.
TIMES = 10
#: Levels of a trie, twice (only half of a word is walked).
DEPTH = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def noisy(doc_id: str, run: str) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct noisy runs of at least ``SHORTEST`` code points
    that occur at least ``LEAST`` times."""
    find = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST).findall

    def count(batches):
        for part in slices(batches, "text"):
            total: Counter = Counter()
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                if t:
                    for run, n in Counter(find(t.translate(_LOWER).decode())).items():
                        total[noisy(i or "", run)] += n
            words = [w for w in total if len(w) >= SHORTEST]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
        release()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    prepare(rows.sparkSession)
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _node(side, size, path):
    """Name of the node at the end of ``path`` in the trie of (side, size)."""
    return F.xxhash64(side, size, path)


def _both_sides(words: DataFrame) -> DataFrame:
    """Each word read forwards (side 0) and backwards (side 1)."""
    return words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word")),
                                          F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))).alias("s"), "n").select("s.*", "n")


def _half(size):
    return F.floor(size / 2).cast("int")


def _piece(size):
    return F.greatest(F.lit(1), F.ceil(size / DEPTH)).cast("int")


def trie_edges(words: DataFrame) -> DataFrame:
    """(level, node, label, child, leaf, leaf_n) of all tries; leaf is the word
    that ends at the child, read in the direction of its trie."""
    w = _both_sides(words).withColumn("size", F.length("word")).where("size > 0")
    w = w.withColumn("half", _half(F.col("size"))).withColumn("step", _piece(F.col("size")))
    w = w.select("*", F.posexplode(F.sequence(F.col("half"), F.col("size") - 1, F.col("step"))).alias("level", "at"))
    here = F.substring("word", F.lit(1), F.col("at"))
    label = F.substring("word", F.col("at") + 1, F.col("step"))
    end = F.col("at") + F.col("step") >= F.col("size")
    return w.select(
        "level", _node(F.col("side"), F.col("size"), here).alias("node"), label.alias("label"),
        _node(F.col("side"), F.col("size"), F.substring("word", F.lit(1), F.col("at") + F.col("step"))).alias("child"),
        F.when(end, F.col("word")).alias("leaf"), F.when(end, F.col("n")).alias("leaf_n"),
    ).groupBy("level", "node", "label", "child").agg(F.max(F.struct("leaf", "leaf_n")).alias("end")).select("level", "node", "label", "child", "end.*")


def entry_states(words: DataFrame) -> DataFrame:
    """States at the roots: (word, n, side, position, node, edits, size), size
    the length of the words of the trie."""
    w = _both_sides(words).withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    return w.select("word", "n", "side", _half(F.col("size")).alias("position"),
                    _node(F.col("side"), F.col("size"), F.substring("word", F.lit(1), _half(F.col("size")))).alias("node"),
                    F.lit(0).alias("edits"), "size")


def advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``states`` one level further down ``edges`` (of that level)."""
    e = edges.select("node", "label", "child", "leaf", "leaf_n")
    wide = F.length("label")
    ahead = F.substring("word", F.col("position") + 1, wide)
    longer = F.substring("word", F.col("position") + 1, wide + 1)
    own = F.length("word") == F.col("size")
    same = ahead == F.col("label")
    # the edit is used at the first difference: replaced in a word of the same length, else deleted
    replaced = own & (F.levenshtein(ahead, F.col("label")) == 1)
    deleted = ~own & (F.length(longer) == wide + 1) & (F.levenshtein(longer, F.col("label")) == 1)
    clean = (states.where("edits = 0").join(e, "node").where(same | replaced | deleted)
             .withColumn("edits", F.when(same, 0).otherwise(1))
             .withColumn("position", F.col("position") + wide + F.when(same | own, 0).otherwise(1)))
    used = (states.where("edits = 1").withColumnRenamed("node", "at").join(e, (F.col("at") == F.col("node")) & same)
            .withColumn("position", F.col("position") + wide))
    out = [d.select("word", "n", "side", "position", F.col("child").alias("node"), "edits", "size", "leaf", "leaf_n") for d in (clean, used)]
    return out[0].unionByName(out[1])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): the pairs of distinct ``words`` (word, n), none
    empty, that differ by one code point, both ways round."""
    edges = table(trie_edges(words).sortWithinPartitions("level"), "edges")  # a round reads the pages of its level
    levels = edges.agg(F.max("level")).first()[0]
    states, ends = entry_states(words), []
    for level in range(-1 if levels is None else levels + 1):
        states = table(advanced(states, edges.where(F.col("level") == level)), f"frontier{level}")
        # at the end of the trie with one edit, or with one code point too many
        ends.append(states.where("leaf is not null and (edits = 1 or length(word) = size + 1)"))
        states = states.where("leaf is null").drop("leaf", "leaf_n")
        if states.isEmpty():
            break
    if not ends:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    plain = [F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c)) for c in ("word", "leaf")]
    found = (found.where(F.levenshtein("word", "leaf") == 1)
             .select(plain[0].alias("word"), "n", plain[1].alias("near"), F.col("leaf_n").alias("near_n")))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))).distinct()


def variants(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, form, form_n and root."""
    words = table(words, "words")
    near = (near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top")))
    w = words.join(near, "word", "left").withColumn("strong", -F.col("top.less") >= TIMES * F.col("n"))
    w = table(w.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                       F.when(F.col("strong"), F.col("top.near")).alias("form"), F.when(F.col("strong"), -F.col("top.less")).alias("form_n")), "formed")
    # a form has TIMES the occurrences, so chains are short: each round doubles the steps taken
    links = w.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = links.join(links.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        further = table(further.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")), "roots")
        links = further.select("word", "to")
        if further.where("more").isEmpty():
            break
    return (w.join(links.withColumnRenamed("to", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_trie_frontier(spark, sf_dir):
    return variants(word_counts(read_table(spark, sf_dir, "documents")))


ORACLE = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
held AS (SELECT doc_id, r, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs WHERE length(r) >= {SHORTEST} GROUP BY doc_id, r),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2),
    lambda i: CAST(16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM held, tab),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {NOISE} = 0 THEN left(r, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
one AS (SELECT cut.word AS a, w.word AS b FROM cut JOIN w ON cut.d = w.word),
near AS MATERIALIZED (SELECT a, b FROM one UNION SELECT b, a FROM one
  UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.d = y.d AND x.word <> y.word AND length(x.word) = length(y.word)),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-w.n, b)) AS form, max(w.n) AS form_n FROM near JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n
  FROM w LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS at, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(chain.at, k) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN chain ON chain.word = f.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
