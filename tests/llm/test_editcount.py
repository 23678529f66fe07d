import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from budgetlens.llm import editcount as E  # noqa: E402
from budgetlens.llm.bpe import default_vocabulary, read_ranks  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402


@pytest.fixture(scope="module")
def encoding():
    path, pattern = default_vocabulary()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def test_random_edits_equal_a_full_count(encoding):
    c, rng = E.Counter(*default_vocabulary(), cache=500), random.Random(3)
    for _ in range(400):
        alphabet = rng.choice(["ab c  \n\t'sreü中!?0", "ab ", "' stvelm ", "a  \n", " ."])
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 800])))
        tree = E.CountTree(text, c)
        for _ in range(6):
            at, n = rng.randint(0, len(text) + 2), rng.choice([0, 1, 2, 10, 100])
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 30, 300])))
            at_ = min(at, len(text))
            text = text[:at_] + new + text[at_ + n:]
            tree.edit(at, n, new)
            assert tree.text == text and tree.n_tokens == len(encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_small_edit_encodes_little():
    tree = E.CountTree("word and more " * 5000, E.Counter(*default_vocabulary()))
    tree.edit(30_000, 3, "xyz")
    assert tree.encoded < 60


def test_edge_rows_and_log(spark, make_docs, encoding):
    docs = make_docs([(1, None), (2, ""), (3, "some text here"), (3, "some text here")], extra=True)
    log = spark.createDataFrame([(3, 2, 0, 4, "any"), (3, 1, 4, 0, "!!"), (2, 1, None, None, "new"), (1, 0, -5, 99, None)],
                                "doc_id long, seq long, start long, length long, text string")
    got = {r.doc_id: r for r in E.count_with_edits(docs.join(E.edits_of(log), "doc_id", "left")).collect()}
    assert (got[1].n_tokens, got[1].edited_text) == (0, "")
    assert (got[2].edited_text, got[2].edited_n_tokens) == ("new", 1)
    assert got[3].edited_text == "any!! text here" and got[3].edited_n_tokens == len(encoding.encode_ordinary("any!! text here"))


def test_query_equals_full_counts(spark, encoding):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = E.op10_edit_counts(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    import hashlib
    for r in rows:
        t = docs[r.doc_id]
        n = len(t)
        new = t[:n // 3] + " inserted words" + t[n // 3:]
        new = new[:2 * n // 3] + new[2 * n // 3 + 10:]
        new = new[:min(n, len(new))] + "'ll end\n\n" + new[min(n, len(new)) + 5:]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.n_tokens, r.edited_n_tokens) == (len(encoding.encode_ordinary(t)), len(encoding.encode_ordinary(new)))
