"""The Kneser-Ney model against a plain implementation with dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from budgetlens.llm import kneserney as K
from tests.conftest import SF_SMALL


def plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: p(context, char)."""
    n = K.ORDER
    seqs = [[0] * (n - 1) + [max(2, ord(c)) if ord(c) < 3072 else 3072 + ord(c) % 1024 for c in t] + [1] for t in texts]
    counts = {n: Counter(tuple(s[i:i + n]) for s in seqs for i in range(len(s) - n + 1))}
    for o in range(n - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    disc = {o: K.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for o, c in counts.items()}
    ctx = {o: defaultdict(list) for o in counts}
    for o, c in counts.items():
        for g, v in c.items():
            ctx[o][g[:-1]].append(v)

    def p(gram):
        q = 1 / (len(counts[1]) + 1)
        for o in range(1, n + 1):
            g = gram[n - o:]
            seen = ctx[o].get(g[:-1])
            if seen:
                d, c = disc[o], counts[o].get(g, 0)
                left = sum(d[min(v, 3)] for v in seen)
                q = max(c - d[min(c, 3)], 0) / sum(seen) + left / sum(seen) * q
        return q
    return seqs, counts, p


def bits(texts, p):
    n = K.ORDER
    for t in texts:
        s = [0] * (n - 1) + [max(2, ord(c)) if ord(c) < 3072 else 3072 + ord(c) % 1024 for c in t] + [1]
        yield -sum(math.log2(p(tuple(s[i:i + n]))) for i in range(len(s) - n + 1))


TRAIN = ["the cat sat on the mat", "a cat and a hat", "the end of the text 中文", "über die Katze", "aa", ""]


def test_scores_equal_the_plain_model(spark, make_docs):
    asked = ["the cat", "zzz", "", "a hat on the mat\x00", "中文 text", "the cat"]
    _, _, p = plain_model(TRAIN)
    texts = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    model, common = K.fit(texts, 4)
    from pyspark.sql import functions as F
    docs = make_docs([(i, t) for i, t in enumerate(asked)]).withColumn("h", F.xxhash64("text"))
    got = {r.doc_id: (r.chars, r.bits) for r in K.scores(docs, model, common, 3, 4).collect()}
    for i, want in enumerate(bits(asked, p)):
        assert got[i][0] == len(asked[i]) and got[i][1] == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    model, common = K.fit(texts, 1)
    r = model.first()
    upper = K.upper_levels(K._unpack_keys(bytes(r["keys"])), K._unpack(bytes(r["counts"]), np.int64))
    seen = common["one"].grams
    for context in (0, K.ngrams(["the c"])[0][4] >> K.BITS, 12345678):
        total = K.probabilities((context << K.BITS) | seen, upper, common).sum() + K.probabilities(
            np.array([(context << K.BITS) | 4000]), upper, common)[0]
        assert total == pytest.approx(1.0, abs=1e-9)


def test_edge_rows(spark, make_docs):
    import random
    rng = random.Random(7)
    words = "the cat sat on a mat of this house and dogs ran over there".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))
    rows = [(i, text(), "en") for i in range(200)]
    known = " ".join(words * 3)
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "### $$$ @@@ ^^^ ~~~ ||| === ### $$$ @@@" * 5, "en"), (1003, known, None),
             (1004, known, "xx"), (None, known, "en"), rows[7]]
    docs = make_docs(rows, extra=True)
    trusted = K.trusted_of(spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted(r.doc_id for r in trusted.where("doc_id is not null").collect()) == [i for i in range(200) if i not in (3, 4)]
    got = [(r.doc_id, r.keep) for r in K.classify(docs, trusted).collect()]
    assert len(got) == len(rows)
    out = {i for i, k in got if not k}
    assert {1000, 1001, 1002} <= out and len(out) <= 5 and not out & {1003, 1004, None}
    kept = K.keep_good(docs, trusted)
    assert kept.columns == docs.columns and kept.count() == sum(k for _, k in got)
    assert K.classify(docs.limit(0), trusted).collect() == []
    assert all(r.keep for r in K.classify(docs, trusted.limit(0)).collect() if r.perplexity is not None)


def test_query_keeps_clean_and_rejects_noise(spark):
    import duckdb
    labels = dict((a, (b, c)) for a, b, c in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF_SMALL}/labels.parquet'").fetchall())
    rows = K.op1_kneser_ney(spark, SF_SMALL).collect()
    clean = [r.keep for r in rows if labels.get(r.doc_id) == (1, 0)]
    bad = [r.keep for r in rows if labels.get(r.doc_id, (1, 0))[0] == 0]
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert np.mean(clean) > 0.95 and np.mean(bad) < 0.6


def test_rows_without_id_are_dealt_to_many_blocks(make_docs):
    from pyspark.sql import functions as F
    docs = make_docs([(None, f"text {i}") for i in range(200)] + [(i, "text") for i in range(200)]).withColumn("h", F.xxhash64("text"))
    blocks = {r.block for r in K.packed_blocks(docs.where("doc_id is null"), 8).collect()}
    assert blocks == set(range(8))
    assert {r.block for r in K.packed_blocks(docs.where("doc_id is not null"), 8).collect()} == set(range(8))
