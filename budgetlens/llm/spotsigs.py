"""Document fingerprints by SpotSigs.

A spot signature is a common word (an antecedent) with the chain of the
``CHAIN`` content words that follow it; antecedents are no content words. The
set of a text's signatures (32 bits each) is its fingerprint, written as the
base64 text of the sorted set. Likeness of two fingerprints is the Jaccard
similarity of the sets; ``likeness`` deals pairs into partitions of similar set
length and compares only pairs whose lengths allow the asked similarity.

Words are runs of characters other than white space and ASCII punctuation,
A-Z lower-cased.

Defined cases: null text is empty and has the empty set; a text without an
antecedent that a content word follows gets the chains that start at each of
its words, one without words the hash of the text itself; two empty sets have
likeness 1, an empty and another one 0. In ``with_next`` documents are ordered
by doc_id (ties by text), after the last comes the first; rows without doc_id
have no place in the order, their next text is empty; one document alone is
its own next. Extra columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import distinct_per_text, mix64, prepare, read_table, word_hashes

CHAIN = 3
#: Common words that anchor the signatures (fixed values, by language).
ANTECEDENTS = {
    "en": "the a an and of to in is was be it that for on with as at by this are from or have not there said",
    "de": "der die das den dem und in zu ist nicht ein eine einen von mit auf für im sich es auch als des",
    "fr": "le la les de des du et un une en est que qui dans pour par sur au avec ne pas plus ce il elle",
    "es": "el la los las de del y en un una que es por con para se no su al lo como más pero",
}
#: Bytes of text per range of documents that a task works through at once.
RANGE_BYTES = 8 << 20
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_anchors = np.unique(word_hashes([" ".join(ANTECEDENTS.values()).encode()])[0])


def spot_sets(texts: list[str]):
    """Sorted distinct signatures of each text: (values uint32, first)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, first = word_hashes([t.translate(_PUNCTUATION) for t in raw])
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(first))
    anchor = np.isin(words, _anchors)
    content = np.flatnonzero(~anchor)

    def chains(starts: np.ndarray, nth: np.ndarray, line: np.ndarray):
        """Hash of each start with the next CHAIN places of ``line`` from its
        nth on, within the text; and whether there is one at all."""
        h = mix64(words[starts])
        some = np.zeros(len(starts), dtype=bool)
        for i in range(CHAIN):
            at = np.minimum(nth + i, len(line) - 1)
            ok = (nth + i < len(line)) & (owner[line[at]] == owner[starts])
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + np.where(ok, words[line[at]], np.uint64(0)))
            some |= ok
        return h, some

    values, owners = [], []
    spots = np.flatnonzero(anchor)
    if len(spots) and len(content):
        h, some = chains(spots, np.searchsorted(content, spots), content)
        values.append(h[some])
        owners.append(owner[spots[some]])
    got = np.bincount(owners[0], minlength=n) > 0 if owners else np.zeros(n, dtype=bool)
    rest = np.flatnonzero(~got[owner]) if len(owner) else np.zeros(0, np.int64)
    if len(rest):
        every = np.arange(len(words))
        values.append(chains(rest, rest + 1, every)[0])
        owners.append(owner[rest])
    bare = [i for i in range(n) if raw[i] and first[i] == first[i + 1]]
    if bare:
        values.append(np.array([int.from_bytes(hashlib.blake2b(raw[i], digest_size=8).digest(), "little") for i in bare], np.uint64))
        owners.append(np.array(bare))
    if not values:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    v, o = np.concatenate(values) >> np.uint64(32), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    v, begin = distinct_per_text(v[order], np.searchsorted(o[order], np.arange(n + 1)))
    return v.astype(np.uint32), begin


def likeness(a, b, threshold: float = 0.0) -> np.ndarray:
    """Jaccard similarity of the pairs (i-th set of a, i-th set of b), both
    (values, first); 0 for pairs below ``threshold``. Pairs are dealt into
    partitions by the length of the longer set (a factor of 2 each); pairs
    whose lengths cannot reach the threshold are not compared."""
    (av, af), (bv, bf) = a, b
    na, nb = np.diff(af), np.diff(bf)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    long, short = np.maximum(na, nb), np.minimum(na, nb)
    may = (short > 0) & (short >= threshold * long)
    part = np.frexp(long.astype(float))[1]
    for p in np.unique(part[may]):
        pairs = np.flatnonzero(may & (part == p))
        x, xo = _take(av, af, pairs)
        y, yo = _take(bv, bf, pairs)
        both = np.intersect1d(xo << 32 | x, yo << 32 | y, assume_unique=True)
        common = np.bincount(both >> 32, minlength=len(pairs))
        j = common / (na[pairs] + nb[pairs] - common)
        out[pairs] = np.where(j >= threshold, j, 0.0)
    return out


def _take(values, first, rows):
    """Values of some sets and the position of the set in ``rows``."""
    n = first[rows + 1] - first[rows]
    own = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
    return values[at].astype(np.int64), own.astype(np.int64)


def fingerprint_strings(sets) -> list[str]:
    values, first = sets
    cut = first.tolist()
    return [base64.b64encode(values[a:b].astype("<u4").tobytes()).decode() for a, b in zip(cut, cut[1:])]


def with_next(docs: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, ghost, doc_id, text) sorted by part, ghost, doc_id, text inside
    the partitions: each part is a range of doc_ids, followed by a copy
    (``ghost``) of the row that comes after it. Texts are shuffled once; the
    ranges come from quantiles of the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(n_bytes / range_bytes))
    cuts = [int(x) for x in rows.where("doc_id is not null").stat.approxQuantile(
        "doc_id", [i / n for i in range(1, n)], 1 / (8 * n))] if n > 1 else []
    cuts = sorted(set(cuts))
    line = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else None
    if cuts:  # binary search: how many cuts are <= doc_id
        def half(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = (s["lo"] < s["hi"]) & (F.element_at(line, F.least(mid + 1, F.lit(len(cuts)))) <= F.col("doc_id"))
            return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"),
                            F.when((s["lo"] < s["hi"]) & ~right, mid).otherwise(s["hi"]).alias("hi"))
        steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
        part = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), half, lambda s: s["lo"])
    else:
        part = F.lit(0)
    alone = -1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), alone).otherwise(part))
    firsts = sorted((r[0], r[1]) for r in rows.where("part >= 0").groupBy("part").agg(F.min("doc_id")).collect())
    copies = [(p, first, firsts[i - 1][0]) for i, (p, first) in enumerate(firsts)]
    here = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    if copies:
        ids = F.array(*[F.lit(c[1]).cast("long") for c in copies])
        before = F.array(*[F.lit(c[2]) for c in copies])
        k = F.array_position(ids, F.col("doc_id")).cast("int")
        there = F.struct(F.element_at(before, F.greatest(k, F.lit(1))).alias("part"), F.lit(True).alias("ghost"))
        at = F.explode(F.when(k > 0, F.array(here, there)).otherwise(F.array(here)))
    else:
        at = F.explode(F.array(here))
    return (rows.select("doc_id", "text", at.alias("at")).select("at.part", "at.ghost", "doc_id", "text")
            .repartition(n, "part").sortWithinPartitions("part", "ghost", "doc_id", "text"))


SCHEMA = ("doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprints(docs: DataFrame, text: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last quarter
    replaced by the start of the next document), and their likeness."""
    def run(batches):
        held: list[tuple] = []
        size, part = 0, None

        def flush(following: str):
            texts = [t for _, t in held]
            after = [*texts[1:], following] if part >= 0 else [""] * len(texts)
            quarter = [len(t) // 4 for t in texts]
            edited = [t[: len(t) - q] + x[:q] for t, q, x in zip(texts, quarter, after)]
            own, next_, new = spot_sets(texts), spot_sets(after), spot_sets(edited)
            return pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in held], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(edited, pa.string()),
                pa.array(fingerprint_strings(own), pa.string()), pa.array(fingerprint_strings(new), pa.string()),
                pa.array(likeness(own, new)), pa.array(likeness(own, next_))],
                ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for p, ghost, i, t in zip(*(b.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text"))):
                if held and (p != part or ghost or size > slice_bytes):
                    yield flush(t if p == part else "")
                    held, size = [], 0
                part = p
                if not ghost:
                    held.append((i, t))
                    size += len(t)
        if held:
            yield flush("")

    prepare(docs.sparkSession)
    return with_next(docs, text).mapInArrow(run, SCHEMA)


def op7_spotsigs(spark, sf_dir):
    made = fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")
