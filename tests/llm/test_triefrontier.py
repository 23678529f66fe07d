"""Spelling variants by the trie frontier against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from budgetlens.llm import triefrontier as tf

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute(n):
    form, count = {}, {}
    for w in n:
        best = sorted((-n[v], v) for v in n if near(w, v))
        count[w] = len(best)
        form[w] = best[0][1] if best and -best[0][0] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] is not None else None))
    return sorted(out)


def brute_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in RUNS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: c for w, c in total.items() if c >= 2}


def got(spark, n):
    return sorted(tuple(r) for r in tf.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect())


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.choice("idr")
    if kind == "i":
        return word[:i] + rng.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + word[i + 1:] if kind == "d" else word[:i] + rng.choice(letters) + word[i + 1:]


def test_all_pairs_over_few_letters(spark):
    """Two letters: nearly every state survives; repeated letters make one word
    reachable by several deletions."""
    rng = random.Random(3)
    n = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))): rng.choice([2, 3, 20, 40, 500]) for _ in range(300)}
    assert got(spark, n) == brute(n)


def test_all_pairs_and_chains_of_forms(spark):
    rng, n = random.Random(8), {}
    for _ in range(60):
        word = "".join(rng.choice("abcdeñéß") for _ in range(rng.randint(7, 16)))
        n[word] = rng.choice([50, 9000])
        for _ in range(8):
            other = edited(rng, word, "abcñé")
            n.setdefault(other, rng.choice([2, 5, 50, 900]))
            n.setdefault(edited(rng, other, "abcñé"), 2)
    n |= {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000}
    out = got(spark, n)
    assert out == brute(n)
    assert ("aaaaaaaa", "aaaaaaab", "aaaabbbb", 2, brute(n)[0][4], 20) in out


def test_long_words_and_a_half_that_all_share(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abc") for _ in range(700))
    n = {base: 100, base[:350] + "z" + base[350:]: 3, base[:10] + base[11:]: 2, base[:-1]: 4, "x" + base: 5, base[:699] + "é": 6,
         base[:200] + "q" + base[201:]: 7, base[::-1]: 8, "a" * 130: 2, "a" * 131: 30, "a" * 64 + "b" + "a" * 65: 400}
    for _ in range(400):
        n["commonhalf" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 4)))] = rng.choice([2, 25, 300])
    assert got(spark, n) == brute(n)


def test_words_of_documents(spark, make_docs):
    rng = random.Random(6)
    vocabulary = ["Straßenbahn", "información", "Übermorgen", "overwhelming", "overwhelm", "ÀÉÎÕÜÿñ", "aaaaaaaa", "AAAAAAAAA"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(80)) + rng.choice(["", "×÷sieben7siebenzig", "東京overwhelming"])) for i in range(120)]
    docs += [(3, None), (4, ""), (5, "short words only"), (None, "overwhelming information"), (None, "overwhelming information"), (7, "y" * 100_000), (8, "y" * 100_000),
             (9, "y" * 99_999 + "z"), (10, "y" * 99_999 + "z")]
    words = tf.word_counts(make_docs(docs, extra=True))
    want = brute_counts(docs)
    assert {r.word: r.n for r in words.collect()} == want
    assert sorted(tuple(r) for r in tf.variants(words).collect()) == brute(want)


def test_empty_tables(spark, make_docs):
    assert tf.variants(tf.word_counts(make_docs([]))).collect() == []
    assert tf.variants(tf.word_counts(make_docs([(1, None), (2, "a b")]))).collect() == []
    assert got(spark, {"lonely": 4}) == [("lonely", None, "lonely", 4, 0, None)]
