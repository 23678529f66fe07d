"""Quality classifier: perplexity under an interpolated modified Kneser-Ney
n-gram model of trusted text, with thresholds per language.

The tokens are characters (order ``ORDER``), so the model covers words never
seen. An n-gram is one long: ``BITS`` bits per character, the first character
on top (characters from 3072 on share 1024 codes). All counts are over whole
texts of all trusted documents.

1. Each task counts the n-grams of its trusted texts; counts go to shards by
   the last two characters of the context. All n-grams of one context, their
   continuation counts of orders 3 to 5 and the counts of counts then meet in
   one shard; orders 1 and 2 are summed over the shards (at most 2**24 pairs of
   codes).
2. Documents are dealt into blocks by a hash of their id, packed (compressed).
   A block asks the shards for its distinct n-grams only (``_asks``); a shard
   joins what the blocks ask with its counts and answers log probabilities.
3. Answers are joined with the packed blocks: perplexity per document.
4. A fifth of the trusted documents (by a hash of their text) is held out of
   training. Per language and length class, the quantile ``HIGH`` of their bits
   per character (rounded to ``STEP``), widened by ``WIDEN`` of its distance
   from the median, bounds what is kept; with fewer than ``ENOUGH`` of them the bound of the language holds,
   then that of all.

Short texts: the bits of a text are averaged with ``PRIOR`` characters at the
language's mean, so that a few characters do not decide alone.

Defined cases: null and empty texts (no character) have null perplexity and
are rejected; a null language is a language of its own; a language without
held-out documents takes the bound of all together; without trusted text all
documents with text are kept (perplexity is that of a uniform model). Repeated
rows each get their row; extra columns are ignored by ``scores`` and kept by
``keep_good``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.llm.common import fresh, mix64, prepare, read_table, release, slices, steady, table
from budgetlens.session import broadcast_if_small

ORDER, BITS = 5, 12
MASK = (1 << BITS) - 1
HIGH, STEP, WIDEN = 0.999, 0.001, 0.5
PRIOR = 50
HELD = 5
#: Held-out documents that a bound of its own needs, and the sizes (characters) between the length classes.
ENOUGH, LENGTHS = 40, (256, 1024, 4096)
#: Bytes of text per block, packed at once by a task, and characters worked on at once.
BLOCK_BYTES, PACK_BYTES, PIECE = 6 << 20, 16 << 20, 1 << 19
_codec = pa.Codec("zstd", compression_level=6)


def codes_of(texts: list[str]):
    """Character codes of the texts, each with ORDER - 1 start codes (0) before
    and an end code (1) behind, and the first code of each text."""
    n = ORDER - 1
    # start codes are set below; any character holds their place
    joined = "".join(["\x00" * n + t + "\x01" for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) + n + 1 for t in texts]))).astype(np.int64)
    out = np.where(code < 3072, np.maximum(code, 2), 3072 + code % 1024).astype(np.int64)
    for i in range(n):
        out[first[:-1] + i] = 0
    out[first[1:] - 1] = 1
    return out, first


def ngrams(texts: list[str]):
    """(n-gram of every character and end, first n-gram of each text)."""
    code, first = codes_of(texts)
    key = np.zeros(max(0, len(code) - ORDER + 1), np.int64)
    for i in range(ORDER):
        key = (key << BITS) | code[i:len(code) - ORDER + 1 + i]
    at = np.arange(len(key))
    text = np.searchsorted(first, at, side="right") - 1
    keep = at + ORDER - 1 < first[text + 1]  # the window ends inside its text
    counts = np.diff(first) - ORDER + 1
    return key[keep], np.concatenate(([0], np.cumsum(counts)))


def pieces(texts: list[str]):
    """Lists of texts of at most PIECE characters (or one longer text)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the last two characters of the context."""
    return (mix64(((keys >> BITS) & ((1 << 2 * BITS) - 1)).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _compress(data) -> bytes:
    return _codec.compress(data, asbytes=True)


def _decompress(data, size: int) -> bytes:
    return _codec.decompress(data, size, asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + _compress(x.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(_decompress(blob[4:], n * np.dtype(kind).itemsize), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.int64))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int):
    """Keys (sorted) in order of shard, then key; bounds of the shards."""
    s = shard_of(keys, shards)
    order = np.argsort(s, kind="stable")
    return order, np.searchsorted(s[order], np.arange(shards + 1))


def count_ngrams(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, counts): packed n-gram counts of each task's texts."""
    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            u, c = _merged(keys, counts)
            order, cut = _by_shard(u, shards)
            some = np.flatnonzero(np.diff(cut))
            parts = [order[cut[s]:cut[s + 1]] for s in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_pack_keys(u[p]) for p in parts], pa.binary()),
                                               pa.array([_pack(c[p]) for p in parts], pa.binary())], ["shard", "keys", "counts"])

        for part in slices(batches, "text", PIECE):
            u, c = np.unique(ngrams(part.column("text").to_pylist())[0], return_counts=True)
            keys.append(u)
            counts.append(c)
            held += len(u)
            if held > 4_000_000:  # merge; what stays large goes out
                u, c = _merged(keys, counts)
                keys, counts, held = [u], [c], len(u)
                if held > 2_000_000:
                    yield flush()
                    keys, counts, held = [], [], 0
        if keys:
            yield flush()
        keys, counts = [], []
        release()

    return texts.select("text").mapInArrow(run, "shard long, keys binary, counts binary")


class Level:
    """Counts of one order: sorted n-grams, their counts, and per context the
    sum and the numbers of n-grams with count 1, 2 and more."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts
        context = grams >> BITS
        self.contexts, at = np.unique(context, return_inverse=True)
        n = len(self.contexts)
        self.total = np.bincount(at, weights=counts, minlength=n)
        self.ones, self.twos, self.more = (np.bincount(at, weights=x, minlength=n) for x in (counts == 1, counts == 2, counts > 2))

    def below(self):
        """The next lower order: n-grams without their first character, with
        the number of characters that precede them."""
        order = int(self.order_bits) - BITS
        return np.unique(self.grams & ((1 << order) - 1), return_counts=True)

    def probability(self, keys: np.ndarray, lower: np.ndarray, discount: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of n-grams ``keys`` given those of the lower order."""
        if not len(self.grams):
            return lower
        i = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        c = np.where(self.grams[i] == keys, self.counts[i], 0)
        j = np.minimum(np.searchsorted(self.contexts, keys >> BITS), len(self.contexts) - 1)
        seen = self.contexts[j] == keys >> BITS
        total = np.where(seen, self.total[j], 1)
        left = discount[1] * self.ones[j] + discount[2] * self.twos[j] + discount[3] * self.more[j]
        p = np.maximum(c - discount[np.minimum(c, 3)], 0) / total + left / total * lower
        return np.where(seen, p, lower)


def level(grams, counts, order: int) -> Level:
    x = Level(grams, counts)
    x.order_bits = order * BITS
    return x


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    """Numbers of n-grams with count 1, 2, 3, 4."""
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


def discounts(n) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more (modified Kneser-Ney)."""
    n1, n2, n3, n4 = (max(int(x), 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def upper_levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, Level]:
    """Levels 5, 4 and 3 of a shard from its n-gram counts."""
    out = {ORDER: level(keys, counts, ORDER)}
    for order in range(ORDER - 1, 2, -1):
        out[order] = level(*out[order + 1].below(), order)
    return out


def fit(texts: DataFrame, shards: int):
    """(model table (shard, keys, counts), the part shared by all shards): the
    n-gram counts of ``texts`` (a column text) and what orders 1 and 2 need."""
    def merge(key, t):
        if not t.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        u, c = _merged([_unpack_keys(b) for b in t.column("keys").to_pylist()], [_unpack(b, np.int64) for b in t.column("counts").to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([_pack_keys(u)], pa.binary()),
                         "counts": pa.array([_pack(c)], pa.binary())})

    model = table(count_ngrams(texts, shards).groupBy("shard").applyInArrow(merge, "shard long, keys binary, counts binary"), "ngrams")

    def shared(batches):  # kind 2: pairs and how many characters precede them; kind -order: counts of counts
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                levels = upper_levels(_unpack_keys(k), _unpack(c, np.int64))
                pair, n = levels[3].below()
                kind = [2] * len(pair)
                key, value = pair.tolist(), n.tolist()
                for order, x in levels.items():
                    kind += [-order] * 4
                    key += [1, 2, 3, 4]
                    value += count_of_counts(x.counts).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (kind, key, value)], ["kind", "key", "value"])

    rows = (model.mapInArrow(shared, "kind long, key long, value long").groupBy("kind", "key")
            .agg(F.sum("value").alias("value")).toArrow())  # at most 2**24 pairs of codes and 12 rows
    kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
    pairs = kind == 2
    order = np.argsort(key[pairs])
    two = level(key[pairs][order], value[pairs][order], 2)
    one = level(*two.below(), 1)
    n = {o: [int(value[(kind == -o) & (key == k)].sum()) for k in (1, 2, 3, 4)] for o in range(3, ORDER + 1)}
    n[2], n[1] = count_of_counts(two.counts), count_of_counts(one.counts)
    return model, {"two": two, "one": one, "discounts": {o: discounts(x) for o, x in n.items()}}


def probabilities(keys: np.ndarray, upper: dict[int, Level] | None, common: dict) -> np.ndarray:
    """Interpolated probability of the last character of each n-gram."""
    d = common["discounts"]
    p = np.full(len(keys), 1.0 / (len(common["one"].grams) + 1))
    p = common["one"].probability(keys & MASK, p, d[1])
    p = common["two"].probability(keys & ((1 << 2 * BITS) - 1), p, d[2])
    for order in range(3, ORDER + 1) if upper else ():
        p = upper[order].probability(keys & ((1 << order * BITS) - 1), p, d[order])
    return p


def packed_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, size, data): rows (doc_id, h, lang, text) dealt by a hash of the
    id (without id: of the text), many to a compressed piece."""
    by = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id"))  # xxhash64 of null is not null
    rows = docs.select("doc_id", "h", "lang", "text", F.pmod(by, F.lit(blocks)).alias("block"))
    columns = ["doc_id", "h", "lang", "text"]

    def run(batches):
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).sort_by("block")
            block = t.column("block").to_numpy()
            found, first = np.unique(block, return_index=True)
            out = {"block": [], "size": [], "data": []}
            for k, a, b in zip(found.tolist(), first, [*first[1:], len(block)]):
                sink = pa.BufferOutputStream()
                part = t.select(columns).slice(a, b - a)
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                raw = sink.getvalue()
                for name, v in zip(out, (k, raw.size, _compress(raw))):
                    out[name].append(v)
            return pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["size"], pa.int64()),
                                               pa.array(out["data"], pa.binary())], list(out))

        for part in slices(batches, "text"):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size > PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held.clear()
        release()

    return rows.mapInArrow(run, "block long, size long, data binary")


def _rows(packed: pa.Table):
    for n, data in zip(packed.column("size").to_pylist(), packed.column("data")):
        yield pa.ipc.open_stream(_decompress(data.as_buffer(), n)).read_all()


def scores(docs: DataFrame, model: DataFrame, common: dict, blocks: int, shards: int) -> DataFrame:
    """(doc_id, h, lang, chars, bits): negative log2 probability of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    packed = packed_blocks(docs, blocks)

    def _asks(key, t):
        steady()
        texts = [x or "" for rows in _rows(t) for x in rows.column("text").to_pylist()]
        u = np.unique(np.concatenate([np.unique(ngrams(part)[0]) for part in pieces(texts)]))
        del texts
        order, cut = _by_shard(u, shards)
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"shard": pa.array(some, pa.int64()), "block": pa.array([key[0].as_py()] * len(some), pa.int64()),
                         "asked": pa.array([_pack_keys(u[order[cut[s]:cut[s + 1]]]) for s in some], pa.binary())})

    asked = table(packed.groupBy("block").applyInArrow(_asks, "shard long, block long, asked binary"), "asked")

    def answer(key, m, t):
        steady()
        upper = None
        if m.num_rows:
            upper = upper_levels(_unpack_keys(m.column("keys")[0].as_py()), _unpack(m.column("counts")[0].as_py(), np.int64))
        found = [_pack(np.log2(probabilities(_unpack_keys(x), upper, shared.value)).astype(np.float32))
                 for x in t.column("asked").to_pylist()]
        return pa.table({"block": t.column("block").cast(pa.int64()), "shard": t.column("shard").cast(pa.int64()), "found": pa.array(found, pa.binary())})

    answers = table(model.groupBy("shard").cogroup(asked.groupBy("shard"))
                    .applyInArrow(answer, "block long, shard long, found binary"), "answers")

    def total(key, t, a):
        steady()
        out = {"doc_id": [], "h": [], "lang": [], "chars": [], "bits": []}
        work, keys, texts = [], [], []
        for rows in _rows(t):
            for c in ("doc_id", "h", "lang"):
                out[c] += rows.column(c).to_pylist()
            texts += [x or "" for x in rows.column("text").to_pylist()]
        for part in pieces(texts):
            k, first = ngrams(part)
            u, place = np.unique(k, return_inverse=True)
            keys.append(u)
            out["chars"] += [len(x) for x in part]
            work.append((u, place.astype(np.int32), first))
        del texts
        u = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        order, cut = _by_shard(u, shards)
        logp = np.zeros(len(u), np.float32)
        for s, found in zip(a.column("shard").to_pylist(), a.column("found").to_pylist()):
            logp[order[cut[s]:cut[s + 1]]] = _unpack(found, np.float32)
        for own, place, first in work:
            value = logp[np.searchsorted(u, own)].astype(np.float64)[place]
            run = np.concatenate(([0.0], np.cumsum(value)))
            out["bits"] += (-(run[first[1:]] - run[first[:-1]])).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "h": pa.array(out["h"], pa.int64()), "lang": pa.array(out["lang"], pa.string()),
                         "chars": pa.array(out["chars"], pa.int64()), "bits": pa.array(out["bits"], pa.float64())})

    return (packed.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(total, "doc_id long, h long, lang string, chars long, bits double"))


def classify(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), lang, perplexity, bits_per_char, bound and ``keep`` of every row of
    ``docs`` (doc_id, text, lang); ``trusted`` has the doc_ids of trusted text."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang")).withColumn("h", F.xxhash64("text"))
    good = table(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    shards = max(16, blocks)
    held = F.pmod(F.col("h"), F.lit(HELD)) == 0
    # up to a million ids the trusted texts are picked where they are read; beyond, by a shuffled join
    texts = rows.where(~held & F.col("text").isNotNull() & (F.col("text") != "")).join(broadcast_if_small(good, 1_000_000), "doc_id", "left_semi")
    model, common = fit(texts.select("text"), shards)
    made = table(scores(rows, model, common, blocks, shards), "scores")
    sized = made.withColumn("length", sum((F.col("chars") >= x).cast("int") for x in LENGTHS))
    flagged = table(sized.where("chars > 0").where(held).join(good, "doc_id", "left_semi"), "held")
    mean = lambda df: df.agg((F.sum("bits") / F.sum("chars")).alias("mean"))
    overall = mean(flagged).first()[0]
    # one row per language: smoothing is towards its mean
    means = mean(flagged.groupBy("lang")).select(F.col("lang").alias("l"), "mean")

    def smoothed(df):
        m = F.coalesce("mean", F.lit(overall), F.lit(0.0))
        return (df.join(means, F.col("lang").eqNullSafe(F.col("l")), "left")
                .withColumn("rate", (F.col("bits") + PRIOR * m) / (F.col("chars") + PRIOR)).drop("l", "mean"))

    steps = table(smoothed(flagged).groupBy("lang", "length", F.ceil(F.col("rate") / STEP).cast("long").alias("step")).count(), "steps")
    fine = quantile_bounds(steps, ["lang", "length"]).where(F.col("n") >= ENOUGH).select(F.col("lang").alias("l1"), F.col("length").alias("s1"), F.col("high").alias("h1"))
    by_lang = quantile_bounds(steps, ["lang"]).where(F.col("n") >= ENOUGH).select(F.col("lang").alias("l2"), F.col("high").alias("h2"))
    every = quantile_bounds(steps.withColumn("all", F.lit(1)), ["all"]).first()
    largest = every["high"] if every else None
    found = (smoothed(sized)
             .join(fine, F.col("lang").eqNullSafe(F.col("l1")) & (F.col("length") == F.col("s1")), "left")
             .join(by_lang, F.col("lang").eqNullSafe(F.col("l2")), "left")
             .withColumn("bound", F.coalesce("h1", "h2", F.lit(largest).cast("double"))))
    inside = F.coalesce(F.col("rate") <= F.col("bound"), F.lit(True))
    return found.select("doc_id", "h", "lang", F.when(F.col("chars") > 0, F.pow(2.0, F.col("bits") / F.col("chars"))).alias("perplexity"),
                        F.col("rate").alias("bits_per_char"), "bound", ((F.col("chars") > 0) & inside).alias("keep"))


def quantile_bounds(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, high) from rows with step and count: the HIGH quantile of the
    stepped values, widened by WIDEN of its distance from the median (few
    documents do not show how far good text reaches). A group has as many rows
    as distinct steps."""
    steps = steps.groupBy(*by, "step").agg(F.sum("count").alias("count"))
    w = Window.partitionBy(*by)
    run = steps.withColumn("run", F.sum("count").over(w.orderBy("step"))).withColumn("total", F.sum("count").over(w))
    at = lambda q: F.min(F.when(F.col("run") >= F.col("total") * q, F.col("step")))
    return run.groupBy(*by).agg(F.max("total").alias("n"), ((at(HIGH) + (at(HIGH) - at(0.5)) * WIDEN) * STEP).alias("high"))


def trusted_of(labels: DataFrame) -> DataFrame:
    """Documents that all their labels call good and none toxic."""
    return (labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where("q = 1 and coalesce(t, 0) = 0").select("doc_id"))


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    of, hashed = fresh(docs, "__id", "__hash")
    bad = table(classify(docs, trusted).where("not keep").select(F.col("doc_id").alias(of), F.col("h").alias(hashed)).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col(of)) & F.xxhash64("text").eqNullSafe(F.col(hashed))
    return docs.join(broadcast_if_small(bad, 500_000), same, "left_anti")


def op1_kneser_ney(spark, sf_dir):
    return classify(read_table(spark, sf_dir, "documents"), trusted_of(read_table(spark, sf_dir, "labels"))).drop("h")
