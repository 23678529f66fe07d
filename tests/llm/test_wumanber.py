"""Wu-Manber decontamination against a brute-force search over word lists."""

import hashlib
import random
import re

import numpy as np

from budgetlens.llm import wumanber
from budgetlens.llm.common import word_hashes

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(len(w), wumanber.WINDOW)
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s:s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[x]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items, make_docs, extra=False):
    strings = spark.createDataFrame(items, "item_id long, text string")
    df = wumanber.contamination(make_docs(docs, extra=extra), strings)
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def random_case(rng, vocabulary, n_docs, n_items):
    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "-", ", "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = words_of(rng.choice(items)[1])
            lo = rng.randint(0, max(0, len(w) - 12))
            parts += [" ".join(w[lo:lo + rng.randint(8, 14)]).upper(), text(rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    return docs, items


def test_equals_brute_force(spark, make_docs):
    rng = random.Random(5)
    for vocabulary in (["a", "b"], [f"w{i}é" for i in range(30)] + ["Ñandú", "x1"]):
        docs, items = random_case(rng, vocabulary, 60, 25)
        assert got(spark, docs, items, make_docs) == brute(docs, items)


def test_edge_rows(spark, make_docs):
    long = " ".join(f"q{i % 977}" for i in range(200_000))
    items = [(1, "one two three four five six seven eight nine ten"), (2, "Solo"), (2, "one TWO three four five six seven eight nine ten eleven"),
             (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10"), (3, None), (4, " -- "), (10, "one two three four five six seven eight nine ten")]
    docs = [(1, None), (2, ""), (3, "... --"), (4, "say one two-three four five six seven eight nine ten!"), (4, "say one two-three four five six seven eight nine ten!"),
            (None, "SOLO flight"), (5, long), (6, "onetwo three four five six seven eight nine ten"), (7, "\x00one\x01two three four five six seven eight nine ten eleven solo")]
    want = brute(docs, items)
    assert got(spark, docs, items, make_docs, extra=True) == want
    assert got(spark, [], items, make_docs) == []
    assert all(r[2:4] == (0, 0) and not r[5] for r in got(spark, docs, [], make_docs))


def test_many_documents_and_items_share_a_passage(spark, make_docs):
    """A passage that a third of all documents and half of the test strings hold."""
    passage = " ".join(f"p{i}" for i in range(25))
    items = [(i, f"{passage} tail{i} a{i} b{i}") for i in range(200)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(12))) for i in range(200)]
    docs = [(i, f"intro{i} {passage} end{i}" if i % 3 == 0 else f"clean text number {i} without any of it at all here") for i in range(900)]
    found = got(spark, docs, items, make_docs)
    assert found == brute(docs, items)
    assert sum(r[5] for r in found) == 300


def test_decontaminated_keeps_rows_and_columns(spark, make_docs):
    strings = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    docs = make_docs([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i"), (2, None)], extra=True)
    kept = wumanber.decontaminated(docs, strings)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, "a b c d e f g h i")] and kept.count() == 2


def test_shift_table_skips_and_misses_nothing():
    """On text without any block of the pattern a window moves by nine words."""
    pattern = [b" ".join(b"p%d" % i for i in range(10))]
    words, first = word_hashes(pattern, lower=False)
    last = np.arange(1, 10)
    search = wumanber.Search(10, wumanber._block_slots(words, last, 10), 9 - last, *_bits(words))
    assert search.find(words, first).tolist() == [0]
    assert sorted(set(search.shift.tolist())) == list(range(10))
    other, at = word_hashes([b" ".join(b"x%d" % i for i in range(5000))], lower=False)
    assert not len(search.find(other, at))


def _bits(words):
    bit = wumanber._window_bits(words, np.array([0]), 10)
    return bit >> 6, (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64)
