"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random
import struct

import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from budgetlens.llm import bpe  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402


@pytest.fixture(scope="module")
def encoding():
    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_codec_equals_library_on_random_texts(encoding):
    codec, rng = bpe.Codec(*bpe.default_vocabulary(), cache=50), random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice("ab c  \n\t'sreü中😀▁　_-!?09\x00\x7fxyzZ") for _ in range(rng.randint(0, 60)))
        assert codec.encode_packed(s) == packed(encoding.encode_ordinary(s))
        assert codec.decode_packed(codec.encode_packed(s)) == s.encode()


def test_every_printable_token_and_long_runs(encoding):
    codec = bpe.codec(*bpe.default_vocabulary())
    for t in list(codec.ranks)[::7]:
        try:
            s = t.decode()
        except UnicodeDecodeError:
            continue
        assert codec.encode_packed(s) == packed(encoding.encode_ordinary(s))
    for s in ("a" * 20_000, " " * 5_000 + "x", "ab" * 9_000):
        assert codec.encode_packed(s) == packed(encoding.encode_ordinary(s))


def test_edge_rows(make_docs):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id")]
    got = {(r.doc_id, r.n_tokens) for r in bpe.bpe_digests(make_docs(rows, extra=True)).collect()}
    assert (1, 0) in got and (2, 0) in got and len(bpe.bpe_digests(make_docs(rows)).collect()) == 5
    assert bpe.bpe_digests(make_docs([])).collect() == []
    both = bpe.encode(make_docs([(1, "a b")], extra=True))
    assert both.first().n_tokens == 2 and both.columns.count("ids") == 1


def test_query_equals_library(spark, encoding):
    got = {r.doc_id: r for r in bpe.op8_byte_bpe(spark, SF_SMALL).collect()}
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = packed(encoding.encode_ordinary(d.text or ""))
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_ranks_must_cover_bytes():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0})
