"""Language identification: held-out accuracy, machines, edge rows."""

import itertools
import math
import re

import numpy as np
from pyspark.sql import functions as F

from budgetlens.llm import langid as L
from budgetlens.llm.common import mix64, table
from tests.conftest import SF_SMALL


def test_query_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = L.op6_language_id(spark, SF_SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_machine_separates():
    rows = [(np.array([0], np.int32), np.array([1.0], np.float32)), (np.array([1], np.int32), np.array([1.0], np.float32))] * 5
    w, bias = L.train_svm(rows, np.array([1, -1] * 5))
    assert w[0] + bias > 0 > w[1] + bias


def test_edge_rows_and_unlearnable(make_docs):
    rows = [(i, "the cat and the dog", "en") for i in range(12)] + [(20 + i, "der hund und die katze", "de") for i in range(12)]
    rows += [(40 + i, "le chat et le chien", "fr") for i in range(12)] + [(60, "zażółć gęślą jaźń", "xx")]
    docs = make_docs([*rows, (70, "something", None)])
    model = L.train(docs)
    assert model["langs"] == ["de", "en", "fr", "xx"]
    asked = make_docs([(1, None), (2, "123 !?"), (3, ""), (4, "the dog"), (4, "the dog"), (5, "und die katze"), (6, "le chien\x00")], extra=True)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(asked, model).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "fr")]
    none = L.train(make_docs([(1, "text", None)]))
    assert L.predict(make_docs([(1, "text")]), none).first().lang_pred == "und"
    only = L.train(make_docs([(1, "text", "en")]))
    assert L.predict(make_docs([(1, "other"), (2, "5")]), only).collect()[0].lang_pred == "en"
    assert L.predict(docs.limit(0), model).collect() == []


def test_features_do_not_depend_on_neighbours_or_case():
    a = L._shares(["Ab c", "Çé ß", "x" * 1000])
    b = L._shares(["aB  c"])
    c = L._shares(["-- ab c.", "-- ab c."])  # the first text of a slice is read like the others
    assert all((x[0] == a[0][0]).all() and np.allclose(x[1], a[0][1]) for x in c)
    assert (a[0][0] == b[0][0]).all() and np.allclose(a[0][1], b[0][1]) and abs(float((a[1][1] ** 2).sum()) - 1) < 1e-5


def _plain_prediction(text, model):
    """Family, then votes of the pairs, from the weights and plain counts."""
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")
    if not folded.strip():
        return "und", 0.0
    folded = re.sub(" +", " ", folded + " ").lstrip(" ")  # separators before the first letter count nowhere
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            gram = folded[i:i + n]
            if gram == " ":
                continue
            key = 0
            for c in gram:
                key = key << 21 | ord(c)
            slot = int(mix64(np.array([(key + (n << 60)) % 2**64], np.uint64))[0]) % L.DIM
            counts[slot] = counts.get(slot, 0) + 1
    total = sum(counts.values())
    margin = {}
    for kind, a, b, bias, w in model["machines"]:
        w = np.frombuffer(w, np.float32)
        margin[kind, a, b] = bias + sum(float(w[k]) * math.sqrt(n / total) for k, n in counts.items())
    sure = lambda m: 1 / (1 + math.exp(-max(-30, min(30, L.SLOPE * m))))
    members = {}
    for x in model["langs"]:
        members.setdefault(L.family_of(x), []).append(x)
    best, base = next(iter(members)), 1.0
    if len(members) > 1:
        best = max(sorted(members), key=lambda f: margin["family", f, ""])
        base = sure(margin["family", best, ""])
    votes = {x: [0, 0.0, 0.0] for x in members[best]}
    for a, b in itertools.combinations(members[best], 2):
        m = margin["pair", a, b]
        votes[a if m > 0 else b][0] += 1
        for x, sign, share in ((a, 1, sure(m)), (b, -1, 1 - sure(m))):
            votes[x][1] += sign * m
            votes[x][2] += share
    pick = min(votes, key=lambda x: (-votes[x][0], -votes[x][1], x))
    return pick, base * (votes[pick][2] / (len(votes) - 1) if len(votes) > 1 else 1.0)


def test_query_equals_plain_margins(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = L.train(docs.where(~L.held_out()))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = L.op6_language_id(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = _plain_prediction(texts[r.doc_id], model)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r.doc_id


def test_sample_is_the_smallest_hashes_and_a_long_text_is_read(spark, make_docs, monkeypatch):
    texts = [f"word number {i} of many" for i in range(400)]
    docs = make_docs([(i, t, "en") for i, t in enumerate(texts)] + [(500 + i, t, "en") for i, t in enumerate(texts[:50])]
                     + [(900, "le mot", "fr"), (901, "el perro", "es")], extra=True)
    kept = {}
    monkeypatch.setattr(L, "table", lambda df, name: kept.setdefault(name, table(df, name)))
    L.train(docs, sample=37)
    hashes = sorted({r.h for r in docs.where("lang = 'en'").select(F.xxhash64("text").alias("h")).collect()})
    got = kept["sample"].collect()
    assert sorted(r.h for r in got if r.lang == "en") == hashes[:37]
    assert {r.lang for r in got} == {"en", "fr", "es"}
    monkeypatch.undo()
    # a text far above the size of a piece whose letters come last
    model = L.train(make_docs([(i, "the cat and the dog", "en") for i in range(5)] + [(9 + i, "le chat et le chien", "fr") for i in range(5)]))
    long = make_docs([(1, "1 " * 400_000 + "le chien et le chat"), (2, "the dog and the cat " * 40_000)])
    assert {r.doc_id: r.lang_pred for r in L.predict(long, model).collect()} == {1: "fr", 2: "en"}
