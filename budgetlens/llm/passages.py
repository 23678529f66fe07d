"""Passages that repeat across documents, exactly or nearly: collinear chaining.

1. Seeds: of every ``WINDOW`` consecutive ``K``-word shingles the one with the
   smallest hash (a run of K + WINDOW - 1 equal words always shares a seed).
   In text that repeats with a period of up to ``WINDOW`` words the number of
   the repeat belongs to the key.
2. A seed that several documents share is matched with its first occurrence in
   the smallest of them (the anchor document), so n occurrences make
   fewer than n matches.
3. The matches of a document with one anchor document are chained in order in
   both texts: a chain's score is ``K`` per seed less ``GAP`` per word skipped
   on either side, found in one pass with a Fenwick tree of prefix maxima.
4. Chains are aligned on the words: seeds are extended to both sides, words
   between seeds are aligned; a passage is kept with at least ``MIN_WORDS``
   words and ``IDENTITY`` of them equal. A chain that is no passage as a whole
   is cut into those parts of it that are, with the most equal words.

5. What chains leave out (each seed has one partner) is looked up exactly: of
   the seeds outside passages whose ``LONG`` words an earlier document holds,
   all runs of ``MIN_WORDS`` words around them are matched with the first
   document that holds them. So no exact repeat of ``MIN_WORDS`` words is left;
   edited ones may be, where other documents hold their seeds first.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in whole texts.

Defined cases: null, empty and short texts (under ``MIN_WORDS`` words) hold no
passage and stay as they are; rows without doc_id take no part and stay; of
rows that repeat a doc_id only those with the smallest text take part, the
others stay as they are; the first occurrence (smallest doc_id) of a passage
stays; repeats inside one document stay; extra columns are kept; an empty
table gives an empty one. A document all of which repeats earlier ones keeps
its row with an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import FURTHER, fresh, mix64, one_per_text, prepare, read_table, release, shingle_hashes, slices, table, texts_of, with_made, word_hashes
from budgetlens.session import broadcast_if_small

K, WINDOW = 8, 16
GAP = 0.1
#: Seeds inside a run of a repeated word or short line lie about this many words apart.
STRIDE = 8
MIN_WORDS, IDENTITY = 50, 0.8
#: Every run of MIN_WORDS words holds a seed with this many words from its start.
LONG = MIN_WORDS - WINDOW + 1
#: Words to both sides of a chain in which its ends are extended.
PAD = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _repeats(s: np.ndarray, owner: np.ndarray):
    """For text with a period of up to ``WINDOW`` words (a line again and
    again): how often the run held each shingle before, which belongs into its
    key, the places that can be seeds, and the places in runs. Where a window holds more than one
    period, only every so many periods can, about ``STRIDE`` words apart."""
    place = np.arange(len(s))
    times, kept, free = np.zeros(len(s), np.int64), np.ones(len(s), dtype=bool), np.ones(len(s), dtype=bool)
    run = np.zeros(len(s), dtype=bool)
    for d in range(1, WINDOW + 1):  # the smallest period counts
        inner = np.zeros(len(s), dtype=bool)
        inner[d:] = (s[d:] == s[:-d]) & (owner[d:] == owner[:-d])
        if not inner.any():
            continue
        run |= inner
        run[:-d] |= inner[d:]
        begin = np.maximum.accumulate(np.where(inner, 0, place + 1))
        new = np.flatnonzero(inner & free)
        free[new] = False
        times[new] = (new - begin[new]) // d + 1
        every = -(-STRIDE // d)
        if (every + 1) * d - 1 <= WINDOW:  # any window holds all places of a period that can be seeds
            kept[new] = times[new] % every == 0
    return times, kept, run


def seeds_of(texts: list[bytes]):
    """(owner, kmer hash, word position, hash of ``LONG`` words, words up to the
    end or ``MIN_WORDS``, whether text repeats there) of the seeds of each text."""
    words, first = word_hashes(texts)
    s, begin = shingle_hashes(words, first, K)
    n = np.diff(begin)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(s) < WINDOW:
        return (*(np.zeros(0, np.int64),) * 5, np.zeros(0, bool))
    times, kept, run = _repeats(s, owner)
    rank = np.where(kept, s, np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.lib.stride_tricks.sliding_window_view(rank, WINDOW).argmin(axis=1) + np.arange(len(s) - WINDOW + 1)
    inside = (owner[: len(at)] == owner[WINDOW - 1:]) & (np.diff(first)[owner[: len(at)]] >= MIN_WORDS)
    at = np.unique(at[inside])
    key = np.where(times[at] > 0, mix64(s[at] + times[at].astype(np.uint64)), s[at])
    pos = at - begin[owner[at]]
    room = np.minimum(np.diff(first)[owner[at]] - pos, MIN_WORDS)
    long = _runs(words, first[owner[at]] + pos, LONG)
    return owner[at], key.astype(np.int64), pos.astype(np.int32), long, room.astype(np.int32), run[at]


def _runs(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place (of fewer at the end)."""
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(at + i, len(words) - 1)])
    return h.astype(np.int64)


def seeds(docs: DataFrame) -> DataFrame:
    """(kmer, doc, pos, long, room, run) of documents (doc, text)."""
    def run(batches):
        for part in slices(batches, "text", 2 << 20):
            own, kmer, pos, long, room, run_ = seeds_of(texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), part.column("doc").take(pa.array(own)), pa.array(pos, pa.int32()),
                                              pa.array(long, pa.int64()), pa.array(room, pa.int32()), pa.array(run_, pa.bool_())],
                                             ["kmer", "doc", "pos", "long", "room", "run"])
        release()

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, "kmer long, doc long, pos int, long long, room int, run boolean")


def chain(p: np.ndarray, q: np.ndarray, weight: float = K, gap: float = GAP) -> list[list[int]]:
    """Chains of matches (positions ``p`` ascending, ``q``), best first, as
    lists of indices; every match is in one chain at most."""
    n = len(p)
    rank = np.unique(q, return_inverse=True)[1].tolist()
    base = (gap * (p.astype(float) + q)).tolist()
    top, who = [-np.inf] * (n + 1), [-1] * (n + 1)  # Fenwick tree of prefix maxima
    score, before = [0.0] * n, [-1] * n
    for j in range(n):
        i, best, prev = rank[j], -np.inf, -1
        while i > 0:  # matches that end before q[j]
            if top[i] > best:
                best, prev = top[i], who[i]
            i -= i & -i
        gain = best - base[j]
        if gain > 0:
            score[j], before[j] = weight + gain, prev
        else:
            score[j] = weight
        value, i = score[j] + base[j], rank[j] + 1
        while i <= n:
            if value > top[i]:
                top[i], who[i] = value, j
            i += i & -i
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        members = []
        while j >= 0 and not used[j]:
            used[j] = True
            members.append(j)
            j = before[j]
        if len(members) > 1:
            out.append(members[::-1])
    return out


def chains(matches: DataFrame) -> DataFrame:
    """(doc, anchor, p, q): chains of two seeds and more of the matches (doc,
    anchor, pos, apos). Rows stream sorted; a task holds the matches of one
    pair of documents."""
    def run(batches):
        names = ("doc", "anchor", "pos", "apos")
        left = None
        out = {"doc": [], "anchor": [], "p": [], "q": []}

        def work(cols, cut):
            for a, b in zip(cut, cut[1:]):
                if b - a < 2:
                    continue
                p, q = cols[2][a:b], cols[3][a:b]
                for c in chain(p, q):
                    out["doc"].append(int(cols[0][a]))
                    out["anchor"].append(int(cols[1][a]))
                    out["p"].append(p[c])
                    out["q"].append(q[c])

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("doc", "anchor") else pa.list_(pa.int32()))
                                               for k, v in out.items()], list(out))
            for v in out.values():
                v.clear()
            return made

        for b in batches:
            cols = [b.column(c).to_numpy() for c in names]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            work(cols, [0, *new.tolist()])
            last = new[-1] if len(new) else 0
            left = [c[last:] for c in cols]
            yield batch()
        if left is not None:
            work(left, [0, len(left[0])])
            yield batch()
        release()

    return (matches.select("doc", "anchor", "pos", "apos").repartition("doc")
            .sortWithinPartitions("doc", "anchor", "pos").mapInArrow(run, "doc long, anchor long, p array<int>, q array<int>"))


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence (equal places if that is most)."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and 2 * (same := int((a == b).sum())) >= len(a):
        return same
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _extend(same: np.ndarray, cost: int) -> tuple[int, int]:
    """How far (words, equal ones) to extend over ``same``: the best prefix
    with 1 for an equal word and -``cost`` for another."""
    if not len(same):
        return 0, 0
    total = np.cumsum(np.where(same, 1, -cost))
    best = int(np.argmax(total))
    return (best + 1, int(same[: best + 1].sum())) if total[best] > 0 else (0, 0)


def _most_common(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of ``common_words``: words of both, whatever their order."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def _blocks(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[list[int]]:
    """[start, end, start in b, end in b, equal words] of the seeds; seeds with
    only equal words between them are one block, and the equal words at the
    ends of what lies between two blocks belong to them."""
    out: list[list[int]] = []
    for x, y in zip(p.tolist(), q.tolist()):
        if out:
            last = out[-1]
            over = max(0, last[1] - x, last[3] - y)  # seeds may overlap
            if over >= K:
                continue
            s, t = x + over, y + over
            n = min(s - last[1], t - last[3])
            same = a[last[1]:last[1] + n] == b[last[3]:last[3] + n]
            right = n if same.all() else int(np.argmin(same))
            last[1], last[3], last[4] = last[1] + right, last[3] + right, last[4] + right
            if last[1] == s and last[3] == t:
                last[1], last[3], last[4] = x + K, y + K, last[4] + K - over
                continue
            n -= right
            same = (a[s - n:s] == b[t - n:t])[::-1]
            left = n if same.all() else int(np.argmin(same))
            out.append([s - left, x + K, t - left, y + K, K - over + left])
        else:
            out.append([x, x + K, y, y + K, K])
    return out


def _ends(a, b, part: list[int], low: tuple[int, int], high: tuple[int, int]) -> list[int] | None:
    """``part`` with its ends extended up to ``PAD`` words inside the bounds, if
    that is a passage. The second try never lowers the share of equal words."""
    s, e, t, f, equal = part
    for cost in (2, 4):
        n = min(PAD, high[0] - e, high[1] - f)
        right, r_equal = _extend(a[e:e + n] == b[f:f + n], cost)
        n = min(PAD, s - low[0], t - low[1])
        left, l_equal = _extend((a[s - n:s] == b[t - n:t])[::-1], cost)
        made = [s - left, e + right, t - left, f + right, equal + r_equal + l_equal]
        if _is_passage(*made):
            return made
    return None


def _is_passage(s, e, t, f, equal) -> bool:
    return e - s >= MIN_WORDS and equal >= IDENTITY * max(e - s, f - t)


def align(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[list[int]]:
    """[start, end, start in b, end in b, equal words] of the passages that a
    chain of seeds (positions p in ``a``, q in ``b``) holds: the whole chain if
    it is one, else the parts of it with the most equal words."""
    blocks = _blocks(a, b, p, q)
    own = sum(x[4] for x in blocks)
    gaps = [(a[x[1]:y[0]], b[x[3]:y[2]]) for x, y in zip(blocks, blocks[1:])]
    most = [_most_common(g, h) for g, h in gaps]
    # no passage spans a gap that lacks more words than all others can make up for
    least = (1 - IDENTITY) / IDENTITY * (own + sum(most) + 2 * PAD)
    cut = [i + 1 for i, ((g, h), n) in enumerate(zip(gaps, most)) if max(len(g), len(h)) - n > least]
    out = []
    for lo, hi in zip([0, *cut], [*cut, len(blocks)]):
        within = [common_words(*gaps[i]) for i in range(lo, hi - 1)]
        low = (blocks[lo - 1][1], blocks[lo - 1][3]) if lo else (0, 0)
        high = (blocks[hi][0], blocks[hi][2]) if hi < len(blocks) else (len(a), len(b))
        out += _parts(a, b, blocks[lo:hi], within, low, high)
    return out


def _parts(a, b, blocks, within, low, high) -> list[list[int]]:
    """The passages of consecutive blocks with ``within`` equal words between
    them, inside the bounds ``low`` and ``high``."""
    whole = _ends(a, b, [blocks[0][0], blocks[-1][1], blocks[0][2], blocks[-1][3],
                         sum(x[4] for x in blocks) + sum(within)], low, high)
    if whole or len(blocks) == 1:
        return [whole] if whole else []
    n = len(blocks)
    # each block with its ends as far as they never lower the share of equal words
    wide = []
    for i, (s, e, t, f, _) in enumerate(blocks):
        x, y = (blocks[i - 1][1], blocks[i - 1][3]) if i else low
        m = min(PAD, s - x, t - y)
        left = _extend((a[s - m:s] == b[t - m:t])[::-1], 4)
        x, y = (blocks[i + 1][0], blocks[i + 1][2]) if i + 1 < n else high
        m = min(PAD, x - e, y - f)
        wide.append((left, _extend(a[e:e + m] == b[f:f + m], 4)))
    start, left = np.array([[x[0] - w[0][0], x[2] - w[0][0]] for x, w in zip(blocks, wide)]), np.array([w[0][1] for w in wide])
    total = np.concatenate(([0], np.cumsum([x[4] + c for x, c in zip(blocks, [*within, 0])])))
    best, came = np.zeros(n + 1, np.int64), [0] * (n + 1)
    came[0] = -1
    for j in range(n):  # most equal words in parts that end with block j at the latest
        _, e, _, f, _ = blocks[j]
        (more, r_equal), c = wide[j][1], (within[j] if j < n - 1 else 0)
        equal = total[j + 1] - c - total[: j + 1] + left[: j + 1] + r_equal
        long = np.maximum(e + more - start[: j + 1, 0], f + more - start[: j + 1, 1])
        fine = (e + more - start[: j + 1, 0] >= MIN_WORDS) & (equal >= IDENTITY * long)
        gain = np.where(fine, best[: j + 1] + equal, -1)
        i = int(np.argmax(gain))
        best[j + 1], came[j + 1] = (gain[i], i) if gain[i] > best[j] else (best[j], -1)
    out, j = [], n
    while j > 0:
        i = came[j]
        if i < 0:
            j -= 1
            continue
        s, e = blocks[i], blocks[j - 1]
        (l_n, l_eq), (r_n, r_eq) = wide[i][0], wide[j - 1][1]
        inner = int(total[j] - total[i]) - (within[j - 1] if j < n else 0)
        out.append([s[0] - l_n, e[1] + r_n, s[2] - l_n, e[3] + r_n, inner + l_eq + r_eq])
        j = i
    return out[::-1]


def participants(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, text, doc_id): rows with a doc_id and a text, one per doc_id and
    text; ``doc`` is the doc_id, or stands for its second and further texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(
        "doc_id is not null and text is not null")
    return one_per_text(rows, "doc").select("doc", "text", "doc_id")


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per passage of a document that an earlier one holds: doc_id,
    text_hash, start_word, end_word (exclusive), first_doc_id, first_start,
    first_end, identity. Different texts of one doc_id are documents of their
    own, behind all others."""
    rows = participants(docs, text)
    found = _passages(rows.select("doc", "text"))
    names = table(rows.where(F.col("doc") >= FURTHER).select("doc", "doc_id"), "further")
    if names.isEmpty():
        return found
    columns = found.columns
    for column in ("doc_id", "first_doc_id"):  # back from the numbers that stand for further texts
        found = (found.join(names.toDF("__doc", "__id"), F.col(column) == F.col("__doc"), "left")
                 .withColumn(column, F.coalesce("__id", column)).drop("__doc", "__id"))
    return found.select(*columns)


def _passages(rows: DataFrame) -> DataFrame:
    """``repeated_passages`` of rows (doc, text) with distinct docs."""
    made = table(seeds(rows), "seeds")
    anchors = table(made.groupBy("kmer").agg(F.min("doc").alias("anchor"), F.max("doc").alias("last"))
                    .where("anchor < last").select("kmer", "anchor"), "anchors")
    shared = table(made.join(anchors, "kmer"), "shared")
    there = shared.where("doc = anchor").groupBy("kmer").agg(F.min("pos").alias("apos"))
    matches = shared.where("doc <> anchor").join(there, "kmer")
    found = table(chains(matches), "chains")
    ids = table(found.select(F.explode(F.array("doc", "anchor")).alias("doc")).distinct(), "ids")

    def hashed(batches):
        for part in slices(batches, "text", 2 << 20):
            words, first = word_hashes(texts_of(part.column("text")))
            low, cut = (words & np.uint64(0xFFFFFFFF)).astype("<u4"), first.tolist()
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("h"), pa.array(
                [low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["doc", "h", "w"])
        release()

    # the words of documents with chains: up to a million ids filter where the texts are read
    words = table(rows.join(broadcast_if_small(ids, 1_000_000), "doc", "left_semi")
                  .withColumn("h", F.xxhash64("text")).mapInArrow(hashed, "doc long, h long, w binary"), "words")

    def part(column, at):  # the words of a chain and PAD to both sides
        low = F.greatest(F.element_at(at, 1) - PAD, F.lit(0))
        high = F.element_at(at, -1) + K + PAD
        return F.substring(column, low * 4 + 1, (high - low) * 4), low

    a, a0 = part(F.col("w"), F.col("p"))
    with_a = found.join(words, "doc").select("doc", "h", "anchor", "p", "q", a.alias("a"), a0.alias("a0"))
    b, b0 = part(F.col("w"), F.col("q"))
    both = (with_a.join(words.select(F.col("doc").alias("anchor"), "w"), "anchor")
            .select("doc", "h", "anchor", "p", "q", "a", "a0", b.alias("b"), b0.alias("b0")))

    def aligned(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "text_hash", "start_word", "end_word", "first_doc_id", "first_start", "first_end", "identity")}
            for doc, h, anchor, p, q, x, x0, y, y0 in zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "anchor", "p", "q", "a", "a0", "b", "b0"))):
                for s, e, t, f, equal in align(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), np.array(p) - x0, np.array(q) - y0):
                    share = equal / max(e - s, f - t)
                    for k, v in zip(out, (doc, h, s + x0, e + x0, anchor, t + y0, f + y0, min(1.0, share))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if k == "identity" else pa.int64())
                                              for k, v in out.items()], list(out))
        release()

    chained = table(both.mapInArrow(aligned, PASSAGE), "passages")
    longs = shared.select("long", "doc", "pos", "room").unionByName(made.where("run").select("long", "doc", "pos", "room"))
    return chained.unionByName(exact_rest(rows, longs.where(F.col("room") >= LONG), chained))


PASSAGE = ("doc_id long, text_hash long, start_word long, end_word long, "
           "first_doc_id long, first_start long, first_end long, identity double")


def _merged(spans) -> list[list[int]]:
    """Sorted (start, end) without overlaps."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def exact_cover(pos: Sequence[int], anchor: Sequence[int], apos: Sequence[int], spans: list[list[int]]) -> list[tuple]:
    """(start, end, anchor, start there): few exact passages that hold all words
    outside ``spans`` (merged) of the equal runs of ``MIN_WORDS`` words at
    ``pos``, one match each."""
    blocks: list[list[int]] = []
    for p, a, q in sorted(zip(pos, anchor, apos)):
        last = blocks[-1] if blocks else None
        if last and last[2] == a and q - p == last[3] - last[0] and p <= last[1]:
            last[1] = p + MIN_WORDS
        else:
            blocks.append([p, p + MIN_WORDS, a, q])
    out, best, i, k, reach = [], None, 0, 0, 0
    while True:
        while k < len(spans) and spans[k][0] <= reach:
            reach = max(reach, spans[k][1])
            k += 1
        while i < len(blocks) and blocks[i][0] <= reach:
            best = blocks[i] if best is None or blocks[i][1] > best[1] else best
            i += 1
        if best is not None and best[1] > reach:
            out.append(tuple(best))
            reach = best[1]
        elif i < len(blocks):
            reach = blocks[i][0]
        else:
            return out


def exact_rest(rows: DataFrame, longs: DataFrame, passages: DataFrame) -> DataFrame:
    """Exact passages of the documents (doc, text) that earlier ones hold and
    that are not inside ``passages``; ``longs`` (long, doc, pos, room) are seeds
    with the hash of their ``LONG`` words."""
    groups = table(longs.groupBy("long").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("long", "low"), "groups")
    places = table(longs.join(groups, "long"), "places")
    spans = table(passages.groupBy(F.col("doc_id").alias("doc")).agg(
        F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans")), "spans")
    later = places.where("doc > low").groupBy("doc").agg(F.collect_list(F.struct("pos", "room", "long")).alias("seeds"))

    def uncovered(batches):  # seeds in a run of MIN_WORDS words that is not inside a passage
        for b in batches:
            out = []
            for found, held in zip(b.column("seeds").to_pylist(), b.column("spans").to_pylist()):
                held = np.array(_merged((x["s"], x["e"]) for x in held or []), np.int64).reshape(-1, 2)
                pos, room, long = (np.array([x[c] for x in found], np.int64) for c in ("pos", "room", "long"))
                k = np.searchsorted(held[:, 0], np.maximum(pos - WINDOW + 1, 0), side="right") - 1
                end = held[np.maximum(k, 0), 1] if len(held) else np.zeros(len(pos), np.int64)
                out.append(np.unique(long[(k < 0) | (end < pos + room)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], ["long"])
        release()

    asked = table(later.join(spans, "doc", "left").select("seeds", "spans").mapInArrow(uncovered, "long long").distinct(), "asked")
    around = table(places.join(asked, "long", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("at")), "around")

    def hashed(batches):  # one row per different run of a document: its first place, and the places outside passages
        for part in slices(batches, "text", 2 << 20):
            words, first = word_hashes(texts_of(part.column("text")))
            for i, (at, held) in enumerate(zip(part.column("at").to_pylist(), part.column("spans").to_pylist())):
                start = np.unique(np.array(at, np.int64)[:, None] - np.arange(WINDOW))
                start = start[(start >= 0) & (start <= first[i + 1] - first[i] - MIN_WORDS)]
                held = np.array(_merged((x["s"], x["e"]) for x in held or []), np.int64).reshape(-1, 2)
                k = np.searchsorted(held[:, 0], start, side="right") - 1
                end = held[np.maximum(k, 0), 1] if len(held) else np.zeros(len(start), np.int64)
                key, at_first, of = np.unique(_runs(words, first[i] + start, MIN_WORDS), return_index=True, return_inverse=True)
                free = np.flatnonzero((k < 0) | (end < start + MIN_WORDS))
                free = free[np.argsort(of[free], kind="stable")]
                own = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([
                    pa.array(key, pa.int64()), part.column("doc").take(own), part.column("h").take(own), pa.array(start[at_first], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of[free], np.arange(len(key) + 1)), pa.int32()), pa.array(start[free], pa.int32()))],
                    ["key", "doc", "h", "pos", "open"])
        release()

    runs = table(rows.join(broadcast_if_small(around.select("doc"), 1_000_000), "doc", "left_semi").join(around, "doc").join(spans, "doc", "left").withColumn("h", F.xxhash64("text"))
                 .mapInArrow(hashed, "key long, doc long, h long, pos int, open array<int>"), "runs")
    firsts = table(runs.groupBy("key").agg(F.min(F.struct("doc", "pos")).alias("a"), F.max("doc").alias("last"))
                   .where("a.doc < last").select("key", F.col("a.doc").alias("anchor"), F.col("a.pos").alias("apos")), "firsts")
    # runs inside a passage found before can be the first of others, but ask for nothing themselves
    matches = (runs.where("size(open) > 0").join(firsts, "key").where("doc > anchor").groupBy("doc", "h")
               .agg(F.collect_list(F.struct("open", "anchor", "apos")).alias("runs")))

    def covering(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "text_hash", "start_word", "end_word", "first_doc_id", "first_start", "first_end")}
            for doc, h, found, held in zip(*(b.column(c).to_pylist() for c in ("doc", "h", "runs", "spans"))):
                pos, anchor, apos = zip(*((p, x["anchor"], x["apos"]) for x in found for p in x["open"]))
                for s, e, a, t in exact_cover(pos, anchor, apos, _merged((x["s"], x["e"]) for x in held or [])):
                    for k, v in zip(out, (doc, h, s, e, a, t, t + e - s)):
                        out[k].append(v)
            made = [pa.array(v, pa.int64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*made, pa.array(np.ones(len(made[0])))], [*out, "identity"])
        release()

    return matches.join(spans, "doc", "left").select("doc", "h", "runs", "spans").mapInArrow(covering, PASSAGE)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space after them."""
    raw = text.encode()
    starts = [m.start() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for s, e in sorted(spans):
        lo = starts[s] if s < len(starts) else len(raw)
        hi = starts[e] if e < len(starts) else len(raw)
        if hi > at:
            kept.append(raw[at:max(at, lo)])
            at = hi
    return b"".join([*kept, raw[at:]]).decode()


def remove_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the given passages; ``n_chars``, where it is a column,
    follows the new text."""
    spans = passages.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"))).alias("spans"))
    of, hashed, cut = fresh(docs, "__id", "__hash", "__spans")
    # passages are proportional to the documents that repeat: broadcast only when a count shows few
    spans = broadcast_if_small(table(spans.toDF(of, hashed, cut), "spans"), 500_000)
    joined = docs.join(spans, (F.col("doc_id") == F.col(of)) & (F.xxhash64(text) == F.col(hashed)), "left").drop(of, hashed)

    def compute(part):
        return [pa.array([t if not x or t is None else cut_words(t, [(s["s"], s["e"]) for s in x])
                          for t, x in zip(part.column(text).to_pylist(), part.column(cut).to_pylist())], pa.string())]

    out = with_made(joined, text, [T.StructField(text, T.StringType())], compute).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length(text), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op9_chained_passages(spark, sf_dir):
    return repeated_passages(read_table(spark, sf_dir, "documents")).drop("text_hash")
