import base64
import hashlib

import numpy as np

from budgetlens.llm import spotsigs as S
from tests.conftest import SF_SMALL


def brute_set(text):
    """Signatures as tuples (anchor, following content words)."""
    import string
    table = str.maketrans(string.punctuation, " " * len(string.punctuation))
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in text.translate(table).split(" ") for w in w.split()]
    common = set(" ".join(S.ANTECEDENTS.values()).split())
    out = set()
    for i, w in enumerate(words):
        if w in common:
            chain = [x for x in words[i + 1:] if x not in common][:S.CHAIN]
            if chain:
                out.add((w, *chain))
    return out


def test_signature_sets_equal_brute_force():
    texts = ["The cat, and a dog in the house of cards!", "x q z", "the the", "Der Hund ist nicht im Haus der Katze", ""]
    values, first = S.spot_sets(texts)
    sizes = np.diff(first).tolist()
    assert sizes[0] == len(brute_set(texts[0])) and sizes[3] == len(brute_set(texts[3]))
    assert sizes[1] == 3 and sizes[2] > 0 and sizes[4] == 0


def test_likeness_equals_jaccard_and_prunes():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 50, n)).astype(np.uint32) for n in (0, 0, 5, 40, 30, 10)]
    b = [np.unique(rng.integers(0, 50, n)).astype(np.uint32) for n in (0, 4, 5, 40, 3, 10)]
    pack = lambda x: (np.concatenate(x), np.concatenate(([0], np.cumsum([len(i) for i in x]))))
    want = [1.0 if not len(x) and not len(y) else len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(a, b)]
    assert np.allclose(S.likeness(pack(a), pack(b)), want)
    assert np.allclose(S.likeness(pack(a), pack(b), 0.5), [w if w >= 0.5 else 0 for w in want])


def check(rows, got):
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want = []
    for i, (doc, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        want.append((doc, len(t), t[:len(t) - q] + nxt[:q]))
    assert sorted((r.doc_id, r.n_chars, r.edited_text) for r in got if r.doc_id is not None) == sorted(want)


def test_next_document_across_ranges_and_edge_rows(make_docs):
    rows = [((i * 37) % 211 - 50, f"the text {i} of a document é😀 " * (i % 9)) for i in range(211)]
    rows += [(500, None), (501, ""), (7000, "the last one of all the texts"), (7000, "the last one of all the texts"), (None, "no id of the text")]
    docs = make_docs(rows, extra=True)
    for size in (1 << 20, 2000, 300):
        parts = S.with_next(docs, range_bytes=size)
        assert parts.where("not ghost").count() == len(rows)
    import budgetlens.llm.spotsigs as module
    old = module.with_next.__defaults__
    module.with_next.__defaults__ = ("text", 1500)
    try:
        got = S.fingerprints(docs, slice_bytes=200).collect()
    finally:
        module.with_next.__defaults__ = old
    assert len(got) == len(rows)
    check(rows, got)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert S.fingerprints(docs.limit(0)).collect() == []
    alone = S.fingerprints(make_docs([(1, "the only text of all")])).first()
    assert alone.edited_text == "the only text o" + "the o"


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = S.op7_spotsigs(spark, SF_SMALL).collect()
    order = sorted(docs)
    after = dict(zip(order, [*order[1:], order[0]]))
    assert len(rows) == len(docs)
    for r in rows:
        t, x = docs[r.doc_id], docs[after[r.doc_id]]
        q = len(t) // 4
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - q] + x[:q]).encode()).hexdigest()
        values = S.spot_sets([t])[0]
        assert r.fingerprint == base64.b64encode(values.astype("<u4").tobytes()).decode()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9
