"""SuperMinHash and the near-duplicate grouping against brute force."""

import random

import numpy as np
import pytest

from budgetlens.llm import superminhash as S
from budgetlens.llm.common import components, word_hashes
from tests.conftest import SF_SMALL


def brute(docs):
    sets = {}
    for i, x in docs:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_word_hashes_cut_long_texts_alike():
    text = (" ".join(f"w{i % 97}" for i in range(5000)) + "\n\t tail").encode()
    a, b = word_hashes([text, b"", b"A b"]), word_hashes([text, b"", b"a B"], piece=1000)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[1].tolist() == [0, 5001, 5001, 5003]


def test_signature_walks_each_slot_once_and_estimates():
    one = S.signatures(np.array([5], np.uint64), np.array([0, 1]))
    assert sorted((one >> np.uint64(32)).ravel().tolist()) == list(range(S.SLOTS))
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        base = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = base[:350], base[50:]
        s = S.signatures(np.concatenate((a, b)), np.array([0, 350, 700]))
        errors.append((s[0] == s[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (0.75 * 0.25 / S.SLOTS) ** 0.5


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert as_dict(S.op3_superminhash(spark, SF_SMALL)) == brute(docs)


def test_chains_of_links_large_groups_and_edge_rows(make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[i:i + 60])) for i in range(0, 60, 3)]  # neighbours are linked, ends are not
    base = [rng.choice(words) for _ in range(80)]
    for i in range(100, 160):  # near copies of one text, more and less edited
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE two"), (205, "one two three")]
    rows += [(300 + i, "exact copy of a text " * 3) for i in range(40)]
    docs = make_docs(rows, extra=True)
    assert as_dict(S.near_duplicates(docs)) == brute(rows)
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, v in brute(rows).items() if v[2])


def test_repeated_ids_null_ids_and_empty(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words of the same id here"), (None, "a b c d e f"), (2, "A B C D E F")])
    got = [(r.doc_id, r.component_id, r.kept) for r in S.near_duplicates(docs).collect()]
    assert len(got) == 5 and (None, None, True) in got and all(c == 1 for i, c, _ in got if i == 1)
    assert S.near_duplicates(docs.limit(0)).collect() == []
    assert sorted((r.doc_id or -1) for r in S.deduplicated(docs).collect())[:2] == [-1, 1]


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5, 5), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts(make_docs, n):
    r = S.near_duplicates(make_docs([(1, " ".join("abcdef"[:n]))])).first()
    assert r.n_shingles == {0: 0, 1: 1, 4: 1, 5: 1, 6: 2}[n] and r.kept


def test_the_text_that_stays_is_the_one_compared(make_docs):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(0, 40, 2):  # i + 1 has a text of its own and a copy of that of i
        copy, own = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(40)) for _ in range(2))
        rows += [(i, copy), (i + 1, copy), (i + 1, own)]
        want |= {i: copy, i + 1: own}  # the copy goes, the text of its own stays
    out = S.deduplicated(make_docs(rows)).collect()
    assert len(out) == len(want) and {r.doc_id: r.text for r in out} == want


def test_different_texts_of_one_doc_id_are_documents(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, c), (3, b), (3, c), (5, a + " x"), (None, a), (None, a), (4, None), (4, "")]
    out = sorted(((r.doc_id, r.text) for r in S.deduplicated(make_docs(rows, extra=True)).collect()), key=str)
    kept = [t for i, t in out if i is not None]
    # each text once (of near ones the earliest), nothing else is lost
    assert sorted(t[0] for t in kept if t) == ["a", "b", "c"] and kept.count(None) == 1 and kept.count("") == 1
    assert [t for i, t in out if i is None] == [a, a]
    assert (2, c) in out and len({i for i, _ in out}) == 5
