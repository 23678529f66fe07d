"""The pipeline stage by stage, each against a plain check of its own input."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from budgetlens.llm import bpe, kneserney, mixing  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402
from tests.llm.test_superminhash import brute  # noqa: E402


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs
    out = []
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, before, SF_SMALL).write.parquet(str(tmp_path / str(i)))
        out.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < len(C.STAGES) - 1:
            assert out[i].columns == columns and out[i].dtypes == docs.dtypes
        before = out[i]
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in out]
    keep = kneserney.op1_kneser_ney(spark, SF_SMALL).where("keep").collect()
    assert ids[0] == sorted(r.doc_id for r in keep)
    groups = brute([(r.doc_id, r.text) for r in out[0].collect()])
    assert ids[1] == sorted(i for i, v in groups.items() if v[2])
    assert ids[2] == ids[1]
    seen = set()
    for r in out[2].orderBy("doc_id").collect():  # no passage of 50 words twice, runs of one word apart
        w = r.text.encode().lower().split()
        grams = {tuple(w[k:k + 50]) for k in range(len(w) - 49)}
        assert not [g for g in grams & seen if len(set(g)) > 10]
        seen |= grams
    times = {r.doc_id: r.times for r in mixing.mix(out[2]).collect()}
    assert ids[3] == sorted(i for i, n in times.items() for _ in range(n))
    texts = {r.doc_id: r.text for r in out[3].collect()}
    codec = bpe.codec(*bpe.default_vocabulary())
    for r in out[4].collect():
        assert bytes(r.ids) == codec.encode_packed(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert ids[4] == ids[3]


def test_empty_and_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "some words here"), (3, "some words here"), (None, "no id")]
    for docs in (make_docs([]), make_docs(rows, extra=True)):
        for name, stage in C.STAGES[:-1]:
            docs_out = stage(spark, docs, SF_SMALL)
            assert docs_out.columns == docs.columns, name
            docs_out.collect()
        assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
