"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters
beyond ASCII. Patterns are the windows of the test strings: 10 consecutive
words, or all words of a shorter string. One search per pattern length:

* shift table: for each slot of hashed blocks of two words, how far a window
  may move without passing the end of a pattern (the smallest over patterns);
* where the shift is 0, the hash of the whole window (its suffix of full
  length) is looked up in a bit table; what passes is a candidate;
* suffix-hash buckets are the partitions of a join of candidates with the
  windows, on the window's words: equal strings confirm an occurrence.

Only the two tables of fixed size reach every task (at most ``SLOTS`` bytes and
``BITS`` bits per pattern length, whatever the number of test strings); the
test strings themselves are joined. Beyond some millions of windows the tables
fill and more candidates go to the join; the result is the same. All places
of a slice of texts advance together, each by its own shift.

Documents that hit the same windows share one list of items, which is made
once. Defined cases: null and empty texts have no words and no hits; texts of
any length are searched whole; rows that repeat a doc_id are rows of their own;
test strings without words have no window; a test string without id is searched
but not listed; equal item_ids count once; empty tables give no rows or no
hits; other columns are kept (one with the name of a made column is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import fresh, mix64, prepare, read_table, release, slices, table, texts_of, word_hashes

WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Slots of the shift table and bits of the window table: full windows, shorter test strings.
SLOTS, SHORT_SLOTS = 1 << 20, 1 << 16
BITS, SHORT_BITS = 1 << 25, 1 << 20
#: Words that one cursor searches.
STRETCH = 128
#: Lower-cases A-Z; what is neither letter, digit nor beyond ASCII becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9FB21C651E98DF25)


def folded(texts: pa.Array) -> list[bytes]:
    """The words of each text, between spaces."""
    return [t.translate(_FOLD) for t in texts_of(texts)]


def _sizes(m: int) -> tuple[int, int]:
    return (SLOTS, BITS) if m == WINDOW else (SHORT_SLOTS, SHORT_BITS)


def _block_slots(words: np.ndarray, last: np.ndarray, m: int) -> np.ndarray:
    """Slots of the blocks that end at ``last``."""
    h = words[last]
    if m >= BLOCK:
        h = mix64(words[last - 1] * _STEP + h)
    return (h & np.uint64(_sizes(m)[0] - 1)).astype(np.int64)


def _window_bits(words: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """Bit numbers of the windows that begin at ``start``."""
    h = np.zeros(len(start), dtype=np.uint64)
    for i in range(m):
        h = mix64(h * _STEP + words[start + i])
    return (h & np.uint64(_sizes(m)[1] - 1)).astype(np.int64)


class Search:
    """Shift and bit table of one pattern length."""

    def __init__(self, m: int, slots, shifts, places, bits):
        n_slots, n_bits = _sizes(m)
        self.m = m
        self.shift = np.full(n_slots, m - min(BLOCK, m) + 1, dtype=np.uint8)
        self.shift[slots] = shifts
        self.bits = np.zeros(n_bits // 64, dtype=np.uint64)
        self.bits[places] = np.asarray(bits, dtype=np.int64).view(np.uint64)

    def find(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of windows that may be patterns, in texts whose words begin at ``first``."""
        m = self.m
        ends = np.diff(first) - m + 1
        parts = np.where(ends > 0, -(-ends // STRETCH), 0)
        owner = np.repeat(np.arange(len(ends)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[owner] + m - 1 + nth * STRETCH
        stop = np.minimum(at + STRETCH, first[owner + 1])
        found = []
        while len(at):
            step = self.shift[_block_slots(words, at, m)]
            start = at[step == 0] - m + 1
            if len(start):
                bit = _window_bits(words, start, m)
                found.append(start[self.bits[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _of_length(first: np.ndarray, m: int) -> np.ndarray:
    """Texts whose windows have ``m`` words."""
    n = np.diff(first)
    return np.flatnonzero(n >= WINDOW if m == WINDOW else n == m)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, ... (n of them) for each entry."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


_TABLES = "kind int, m int, place long, value long"


def _table_rows(batches):
    """Shifts (kind 0) and bits (kind 1) of test strings, reduced per slice."""
    for part in slices(batches, "text"):
        words, first = word_hashes(folded(part.column("text")), lower=False)
        for m in range(1, WINDOW + 1):
            own = _of_length(first, m)
            if not len(own):
                continue
            n, b = np.diff(first)[own], min(BLOCK, m)
            last = _spread(first[own] + b - 1, n - b + 1)
            nth = last - np.repeat(first[own] + b - 1, n - b + 1)
            slots, shifts = _block_slots(words, last, m), np.maximum(m - b - nth, 0)
            order = np.lexsort((shifts, slots))
            slots, shifts = slots[order], shifts[order]
            head = np.concatenate(([True], slots[1:] != slots[:-1]))
            yield _arrow_table(0, m, slots[head], shifts[head])
            bit = np.unique(_window_bits(words, _spread(first[own], n - m + 1), m))
            place, at = np.unique(bit >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at).view(np.int64)
            yield _arrow_table(1, m, place, value)
    release()


def _arrow_table(kind: int, m: int, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    n = len(place)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, m, np.int32)),
                                       pa.array(place.astype(np.int64)), pa.array(value.astype(np.int64))],
                                      ["kind", "m", "place", "value"])


def searches(strings: DataFrame) -> list[Search]:
    """The searches for a column ``text`` of test strings. The driver reads
    tables of fixed size, not the strings."""
    rows = strings.select("text").mapInArrow(_table_rows, _TABLES)
    tables = rows.groupBy("kind", "m", "place").agg(F.min("value").alias("least"), F.bit_or("value").alias("bits")).toArrow()
    col = {c: tables.column(c).to_numpy() for c in ("kind", "m", "place", "least", "bits")}
    out = []
    for m in np.unique(col["m"]).tolist():
        s, b = ((col["m"] == m) & (col["kind"] == k) for k in (0, 1))
        out.append(Search(m, col["place"][s], col["least"][s], col["place"][b], col["bits"][b]))
    return out


def windows_of(strings: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(words, class) per distinct window and (class, items) per distinct list
    of the items that hold a window."""
    kept = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.StringType())])

    def cut(batches):
        for part in slices(batches, "text", 1 << 20):
            ids, windows = [], []
            for i, t in zip(part.column("item").to_pylist(), folded(part.column("text"))):
                words = t.split()
                m = min(len(words), WINDOW)
                for s in range(len(words) - m + 1 if m else 0):
                    ids.append(i)
                    windows.append(b" ".join(words[s:s + m]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary()).cast(pa.string())], ["item", "words"])
        release()

    held = (strings.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, kept)
            .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .withColumn("class", F.sha2(F.to_json(F.struct("items")), 256)))
    held = table(held, "windows")
    return held.select("words", "class"), held.groupBy("class").agg(F.any_value("items").alias("items"))


def contamination(docs: DataFrame, strings: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all but the text, unless given) with n_words,
    n_hit (words inside any occurrence), ``hits`` (first and last word of each
    occurrence), n_items, ``items`` (sorted as strings), their digest and
    ``contaminated``."""
    spark = docs.sparkSession
    prepare(spark)
    found = spark.sparkContext.broadcast(searches(strings.select(F.col(item_text).alias("text"))))
    windows, classes = windows_of(strings, item, item_text)
    made = {"n_words", "n_hit", "hits", "n_items", "items", "items_sha256", "contaminated"}
    columns = [c for c in (columns if columns is not None else [c for c in docs.columns if c != text]) if c.lower() not in made]
    row, spot, searched = fresh(docs, "__row", "__spots", "__text")
    fields = [f for c in columns for f in docs.schema.fields if f.name == c]
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()),
                        T.StructField(spot, T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.StringType())])))])
    spots = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string())]))

    def scan(batches):
        for part in slices(batches, searched):
            texts = folded(part.column(searched))
            words, first = word_hashes(texts, lower=False)
            candidates: list[list] = [[] for _ in texts]
            cut: dict[int, list[bytes]] = {}
            for search in found.value:
                starts = search.find(words, first)
                owners = np.searchsorted(first, starts, side="right") - 1
                for i, s in zip(owners.tolist(), (starts - first[owners]).tolist()):
                    if i not in cut:
                        cut = {i: texts[i].split()}
                    candidates[i].append({"first": s, "words": b" ".join(cut[i][s:s + search.m]).decode()})
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(np.diff(first)), pa.array(candidates, spots)],
                                             [*columns, "n_words", spot])
        release()

    scanned = table(docs.select(*columns, F.col(text).alias(searched)).mapInArrow(scan, out)
                    .withColumn(row, F.monotonically_increasing_id()), "scanned")
    spot_rows = scanned.where(F.size(spot) > 0).select(F.col(row).alias("row"), F.explode(spot).alias("s")).select("row", "s.first", "s.words")
    reach = F.size(F.split("words", " ")) - 1
    hit = (spot_rows.join(windows, "words").groupBy("row")
           .agg(F.sort_array(F.collect_list(F.struct("first", (F.col("first") + reach).alias("last")))).alias("hits"),
                F.sort_array(F.collect_set("class")).alias("classes")))
    hit = table(hit.withColumn("n_hit", F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"] - 1, a["upto"]))).alias("n"),
                              F.greatest(a["upto"], x["last"]).alias("upto")),
        lambda a: a["n"])).withColumn("set", F.sha2(F.concat_ws(",", "classes"), 256)), "hit")
    sets = hit.groupBy("set").agg(F.any_value("classes").alias("classes"))
    lists = (sets.select("set", F.explode("classes").alias("class")).join(classes, "class")
             .select("set", F.explode_outer("items").alias("item"))
             .groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
             .select("set", "items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.size("items").cast("long").alias("n_items")))
    hit = hit.join(lists, "set").select(F.col("row").alias(row), "n_hit", "hits", "n_items", "items", "items_sha256")
    return scanned.join(hit, row, "left").select(
        *columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hits", F.array().cast("array<struct<first:int,last:int>>")).alias("hits"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, strings: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of a test string."""
    row, = fresh(docs, "__whole")
    whole = docs.select(F.struct(*docs.columns).alias(row), F.col(text).alias("text"))
    found = contamination(whole, strings, "text", item, item_text, [row])
    return found.where("not contaminated").select(f"{row}.*")


def op11_wu_manber(spark, sf_dir):
    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9a-z\x{80}-\x{10FFFF}]+')")
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS t
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s
        FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS t
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS MATERIALIZED (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, t)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
