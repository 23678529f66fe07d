"""Language identification in two steps: family, then language within it.

Features of a text are the shares of its hashed character n-grams (1 to 3
letters; case folded, everything that is not a letter is one separator). A
linear support vector machine per family (one against the rest) picks the
family; inside it one machine per pair of languages votes. All machines are
trained in Spark tasks, one machine a task, by dual coordinate descent.

Training uses a bounded sample: at most ``SAMPLE`` labelled texts per language
(those with the smallest hash of their text, so that reruns agree). Prediction
reads whole texts and nothing but the text: a narrow map with the small model
(machines x ``DIM`` weights; the number of languages bounds it).

Defined cases: a null text or one without a letter is ``und`` with score 0; a
null language is not learned from; without any labelled text everything is
``und``; with one language everything that has a letter is that language;
equal votes go to the language with the larger sum of margins, then to the
smaller name; equal texts get equal predictions.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import mix64, prepare, read_table, table, with_made
from budgetlens.session import broadcast_if_small

SAMPLE = 1000
DIM = 1 << 14
#: Bits of the hash prefixes that are counted to find the sample.
PREFIX = 16
#: Characters whose features are made at once (bounds a task's memory).
PIECE = 1 << 18
ORDERS = (1, 2, 3)
EPOCHS, COST = 12, 10.0
#: Slope of the logistic curve that turns a margin into a score.
SLOPE = 4.0
#: Families of language codes (fixed values); a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only:{lang}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: its lower-case letter, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0]) if low else c
    return out


def _grams(texts: list[str]):
    """(hashed n-gram, owner text) arrays and whether each text has a letter."""
    joined = "\x00".join(texts) + "\x00"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # by position, not by the zero character, which texts may hold
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate(([-1], ends))))
    mapped = _letters()[code]
    letters = np.bincount(owner, weights=mapped != 32, minlength=len(texts)) > 0
    keep = np.ones(len(mapped), dtype=bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
    keep[:1] = mapped[:1] != 32  # as behind the end of another text: separators before the first letter count nowhere
    mapped, owner = mapped[keep].astype(np.uint64), owner[keep]
    features, owners = [], []
    key = np.zeros(len(mapped), np.uint64)
    for n in ORDERS:
        key = key[: len(mapped) - n + 1] * np.uint64(1 << 21) + mapped[n - 1:] if n > 1 else mapped
        own = owner[: len(key)]
        same = own == owner[n - 1:]
        some = (key != 32) & same if n == 1 else same
        features.append((mix64(key[some] + np.uint64(n << 60)) % np.uint64(DIM)).astype(np.int32))
        owners.append(own[some])
    return features, owners, letters


def _shares(texts: list[str]):
    """Rows of sparse features: per text (indices, values)."""
    features, owners, _ = _grams(texts)
    f, o = np.concatenate(features), np.concatenate(owners)
    key, n = np.unique(o * DIM + f, return_counts=True)
    row, col = key // DIM, (key % DIM).astype(np.int32)
    total = np.maximum(np.bincount(o, minlength=len(texts)), 1)
    value = np.sqrt(n / total[row])  # unit length: squares of the values sum to 1
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(col[a:b], value[a:b].astype(np.float32)) for a, b in zip(cuts, cuts[1:])]


def _parts(texts: list[str], chars: int = PIECE):
    """The texts in lists of at most ``chars`` characters (or one longer text)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > chars:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7):
    """Linear machine with hinge loss, balanced cost: (weights, bias)."""
    w, alpha = np.zeros(DIM + 1), np.zeros(len(rows))
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    cost = np.array([COST * len(rows) / (2 * share[int(s)]) for s in y])
    idx = [np.concatenate((i, [DIM])) for i, _ in rows]
    val = [np.concatenate((v, [1.0])) for _, v in rows]
    norm = np.array([float(v @ v) for v in val])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, v = idx[k], val[k]
            g = y[k] * float(w[i] @ v) - 1.0
            new = min(max(alpha[k] - g / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * v
                alpha[k] = new
    return w[:DIM].astype(np.float32), float(w[DIM])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> list[dict]:
    """The machines, from a bounded sample of the rows of ``docs`` with a
    language. The model (not the sample) comes to the driver."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    # equal texts count once; a histogram of hash prefixes (at most 2**PREFIX rows per
    # language) finds the bucket of the last one taken, and only hashes up to it are ranked
    hashes = labelled.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("b", F.shiftright("h", 64 - PREFIX))
    upto = Window.partitionBy("lang").orderBy("b")
    last = (hashes.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < sample)
            .groupBy("lang").agg(F.max("b").alias("last")))
    top = (hashes.join(broadcast_if_small(last, 10_000), "lang").where("b <= last")
           .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
           .groupBy("lang").agg(F.max("h").alias("top")))
    chosen = table(labelled.withColumn("h", F.xxhash64("text")).join(broadcast_if_small(top, 10_000), "lang").where("h <= top")
                   .dropDuplicates(["lang", "h"]).select("lang", "text", "h"), "sample")
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())  # one row per language
    families = sorted({family_of(x) for x in langs})
    machines = [("family", f, "") for f in families] if len(families) > 1 else []
    machines += [("pair", a, b) for a in langs for b in langs if a < b and family_of(a) == family_of(b)]
    model = {"langs": langs, "machines": []}
    if not machines:
        return model
    spark = docs.sparkSession
    prepare(spark)
    wanted = spark.createDataFrame([(k, a, b, m) for k, a, b in machines
                                    for m in (langs if k == "family" else (a, b))],
                                   "kind string, a string, b string, lang string")

    def fit(key, pdf):
        kind, a, b = key
        pdf = pdf.sort_values(["lang", "h"], kind="stable")
        y = np.where((pdf["lang"].map(family_of) == a) if kind == "family" else (pdf["lang"] == a), 1, -1)
        w, bias = train_svm([r for part in _parts(pdf["text"].tolist()) for r in _shares(part)], y)
        return pd.DataFrame({"kind": [kind], "a": [a], "b": [b], "bias": [bias], "w": [w.tobytes()]})

    rows = (chosen.join(F.broadcast(wanted), "lang").groupBy("kind", "a", "b")
            .applyInPandas(fit, "kind string, a string, b string, bias double, w binary").collect())
    model["machines"] = sorted((r.kind, r.a, r.b, r.bias, bytes(r.w)) for r in rows)
    return model


class Predictor:
    def __init__(self, model: dict):
        self.langs, self.machines = model["langs"], model["machines"]
        self.weights = np.array([np.frombuffer(m[4], np.float32) for m in self.machines], np.float32).T.copy() \
            if self.machines else np.zeros((DIM, 0), np.float32)
        self.bias = np.array([m[3] for m in self.machines])
        self.column = {m[:3]: i for i, m in enumerate(self.machines)}
        self.members: dict[str, list[str]] = {}
        for x in self.langs:
            self.members.setdefault(family_of(x), []).append(x)

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        features, owners, letters = _grams(texts)
        f, o = np.concatenate(features), np.concatenate(owners)
        key, n = np.unique(o * DIM + f, return_counts=True)
        row, col = key // DIM, key % DIM
        total = np.maximum(np.bincount(o, minlength=len(texts)), 1)
        value = np.sqrt(n / total[row])
        out = np.empty((len(texts), len(self.machines)))
        for m in range(len(self.machines)):
            out[:, m] = np.bincount(row, weights=self.weights[col, m] * value, minlength=len(texts)) + self.bias[m]
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not texts:
            return [], []
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        m, letters = self.margins(texts)
        sure = 1 / (1 + np.exp(-np.clip(SLOPE * m, -30, 30)))
        families = sorted(self.members)
        if len(families) > 1:
            columns = [self.column[("family", f, "")] for f in families]
            best = np.argmax(m[:, columns], axis=1)
            base = sure[np.arange(len(texts)), np.array(columns)[best]]
        else:
            best, base = np.zeros(len(texts), int), np.ones(len(texts))
        langs, scores = [], []
        for k in range(len(texts)):
            if not letters[k]:
                langs.append("und")
                scores.append(0.0)
                continue
            members = self.members[families[best[k]]]
            votes = {x: [0, 0.0, 0.0] for x in members}
            for i, a in enumerate(members):
                for b in members[i + 1:]:
                    c = self.column[("pair", a, b)]
                    margin = m[k, c]
                    votes[a if margin > 0 else b][0] += 1
                    votes[a][1] += margin
                    votes[b][1] -= margin
                    votes[a][2] += sure[k, c]
                    votes[b][2] += 1 - sure[k, c]
            pick = min(members, key=lambda x: (-votes[x][0], -votes[x][1], x))
            langs.append(pick)
            scores.append(float(base[k] * (votes[pick][2] / (len(members) - 1) if len(members) > 1 else 1.0)))
        return langs, scores


_predictors: dict = {}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the model travels as a broadcast."""
    prepare(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def compute(part):
        if not (p := _predictors.get(name)):  # a worker lives on: the last model's predictor may be there
            _predictors.clear()
            p = _predictors[name] = Predictor(shared.value)
        langs, scores = p.predict([t or "" for t in part.column(text).to_pylist()])
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return with_made(docs, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute, PIECE)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
