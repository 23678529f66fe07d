"""Repeated passages against brute force (every 50-word run of an earlier text)."""

import random

import numpy as np

from budgetlens.llm import passages as P
from tests.conftest import SF_SMALL


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_chain_follows_the_best_diagonal():
    p, q = np.array([0, 10, 20, 30, 40]), np.array([5, 100, 25, 35, 45])
    assert P.chain(p, q) == [[0, 2, 3, 4]]
    assert P.chain(np.array([0, 500]), np.array([0, 500])) == []  # too far apart
    assert P.chain(np.array([0, 5, 100, 105]), np.array([0, 5, 0, 5])) == [[0, 1], [2, 3]]  # a passage twice


def test_planted_passages_are_found_and_clean_texts_are_not(make_docs):
    rng = random.Random(2)
    passage = prose(rng, 70)
    edited = list(passage)
    for i in (12, 33, 50):
        edited[i] = "changed"
    del edited[40]
    rows = [(i, " ".join(prose(rng, 200))) for i in range(30)]
    plant = {40: passage, 41: [w.upper() for w in passage], 42: edited}
    for i, words in plant.items():
        rows.append((i, " ".join([*prose(rng, 30), *words, *prose(rng, 45)])))
    docs = make_docs(rows, extra=True)
    found = P.repeated_passages(docs)
    got = covered(found)
    assert set(got) == {41, 42} and got[41] == set(range(30, 100)) and len(got[42] & set(range(30, 99))) >= 66
    assert all(r.first_doc_id == 40 for r in found.collect())
    out = P.remove_passages(docs, found)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[41].text.split() == rows[31][1].split()[:30] + rows[31][1].split()[100:]
    assert texts[41].n_chars == len(texts[41].text)
    assert all(texts[i].text == t for i, t in rows if i not in (41, 42))


def test_copies_runs_and_edge_rows(make_docs):
    rng = random.Random(4)
    text = " ".join(prose(rng, 300))
    rows = [(i, text) for i in range(20)] + [(30, "junk " * 400), (31, "junk " * 300), (40, None), (41, ""), (42, "few words")]
    rows += [(None, text), (50, " ".join(prose(rng, 80))), (50, text)]
    docs = make_docs(rows)
    got = covered(P.repeated_passages(docs))
    assert all(got[i] == set(range(300)) for i in range(1, 20)) and 0 not in got
    assert len(got[31]) >= 250 and 40 not in got and 42 not in got
    out = P.remove_passages(docs, P.repeated_passages(docs))
    assert out.count() == len(rows)
    assert {r.text for r in out.where("doc_id between 1 and 19").collect()} == {""}
    assert out.where("doc_id is null").first().text == text
    assert P.repeated_passages(docs.limit(0)).collect() == []


def test_query_covers_exact_repeats(spark):
    got = covered(P.op9_chained_passages(spark, SF_SMALL))
    seen, need, hit = set(), 0, 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        w = (r.text or "").encode().lower().split()
        grams = [tuple(w[k:k + 50]) for k in range(len(w) - 49)]
        places = {p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)}
        need += len(places)
        hit += len(places & got.get(r.doc_id, set()))
        seen.update(grams)
    # what may be missed are runs that repeat one or two words over and over
    assert need and hit >= 0.97 * need


def test_cut_words_keeps_white_space():
    assert P.cut_words(" a b  c\nd ", [(1, 3)]) == " a d "
    assert P.cut_words("ä b c", [(0, 1), (2, 3)]) == "b "
    assert P.cut_words("a b", [(0, 2)]) == ""
    assert P.cut_words("a b c d", [(0, 2), (1, 3)]) == "d"


def test_two_passages_of_a_pair_and_an_inserted_paragraph(make_docs):
    rng = random.Random(7)
    x, y, z = prose(rng, 60), prose(rng, 60), prose(rng, 200)
    rows = [(1, " ".join([*prose(rng, 30), *x, *prose(rng, 100), *y, *prose(rng, 30)])),
            (2, " ".join([*prose(rng, 20), *x, *prose(rng, 100), *y, *prose(rng, 50)])),
            (3, " ".join([*prose(rng, 30), *z, *prose(rng, 20)])),
            (4, " ".join([*prose(rng, 10), *z[:100], *prose(rng, 150), *z[100:], *prose(rng, 10)]))]
    got = covered(P.repeated_passages(make_docs(rows)))
    assert set(got) == {2, 4}
    assert got[2] == {*range(20, 80), *range(180, 240)}
    assert got[4] == {*range(10, 110), *range(260, 360)}


def test_a_chain_is_cut_only_where_it_must_be():
    a = np.arange(300)
    seeds_at = np.array([0, 20, 40, 92, 200, 240, 292])
    assert P.align(a, a, seeds_at, seeds_at) == [[0, 300, 0, 300, 300]]
    b = a.copy()
    b[60:75] += 1000  # 95 % are equal: one passage
    assert P.align(a, b, seeds_at, seeds_at) == [[0, 300, 0, 300, 285]]
    b[100:190] += 1000
    assert P.align(a, b, seeds_at, seeds_at) == [[0, 100, 0, 100, 85], [190, 300, 190, 300, 110]]


def test_lines_that_repeat_over_and_over(make_docs):
    rng = random.Random(9)
    rows, n = [], {}
    for d in range(2, 17):
        line = prose(rng, d)
        for k, (before, times) in enumerate(((17, 100), (4, 100), (31, 90))):
            i = 10 * d + k
            rows.append((i, " ".join([*prose(rng, before), *line * times, *prose(rng, 12)])))
            n[i] = set(range(before, before + d * times))
    got = covered(P.repeated_passages(make_docs(rows)))
    assert set(got) == {i for i in n if i % 10}
    assert all(n[i] <= got[i] and len(got[i] - n[i]) < 5 for i in got)


def test_frequent_lines_inside_a_shared_passage(make_docs):
    rng = random.Random(11)
    rows = []
    for n in range(6):  # passage of 60 words, each half of it and its middle in other documents before
        x, i = prose(rng, 60), 100 * n
        for k, part in enumerate((x[:30], x[30:], x[10:52], x[:44], x[16:])):
            rows.append((i + k, " ".join([*prose(rng, 40), *part, *prose(rng, 40)])))
        rows.append((i + 10, " ".join([*prose(rng, 25), *x, *prose(rng, 40)])))
        rows.append((i + 20, " ".join([*prose(rng, 35), *x, *prose(rng, 20)])))
    found = P.repeated_passages(make_docs(rows))
    got = covered(found)
    assert set(got) == {100 * n + 20 for n in range(6)}
    assert all(s == set(range(35, 95)) for s in got.values())


def test_longer_runs_than_the_first_and_lines_in_another_place(make_docs):
    rng = random.Random(12)
    line, x = prose(rng, 11), prose(rng, 55)
    rows = [(1, " ".join([*line * 20, *prose(rng, 30)])), (2, " ".join([*prose(rng, 30), *line * 70])),
            (3, " ".join([*x[20:45], *prose(rng, 40), *x[:25], *prose(rng, 40), *x])), (4, " ".join([*prose(rng, 30), *x]))]
    got = covered(P.repeated_passages(make_docs(rows)))
    assert got == {2: set(range(30, 800)), 4: set(range(30, 85))}


def test_a_pair_of_words_again_and_again_is_looked_up_once_a_document(make_docs, monkeypatch):
    written, kept = P.table, {}

    def table(df, name):
        kept[name] = written(df, name)
        return kept[name]

    monkeypatch.setattr(P, "table", table)
    rng = random.Random(13)
    pair, n = prose(rng, 2), 12
    made = [(prose(rng, 30), prose(rng, 30)) for _ in range(n)]
    sizes = []
    for times in (100, 400):
        rows = [(i, " ".join([*a, *pair * (times // 2 if i == 0 else times), *b])) for i, (a, b) in enumerate(made)]
        got = covered(P.repeated_passages(make_docs(rows)))
        assert set(got) == set(range(1, n))
        assert all(set(range(30, 30 + 2 * times)) <= s and len(s) < 2 * times + 5 for s in got.values())
        sizes.append(kept["runs"].count())
    assert sizes[0] > 0 and sizes[1] <= sizes[0] + 2 * n  # not with the times a document repeats it


def test_query_covers_every_exact_repeat(spark):
    got = covered(P.op9_chained_passages(spark, SF_SMALL))
    seen, missed = set(), 0
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        w = (r.text or "").encode().lower().split()
        grams = [tuple(w[k:k + 50]) for k in range(len(w) - 49)]
        missed += len({p for k, g in enumerate(grams) if g in seen for p in range(k, k + 50)} - got.get(r.doc_id, set()))
        seen.update(grams)
    assert not missed


def test_a_further_text_of_a_doc_id_is_searched(make_docs):
    shared = " ".join(f"s{i}" for i in range(120))
    other = " ".join(f"o{i}" for i in range(150))
    docs = make_docs([(1, shared), (2, other), (2, "zz first " + shared), (2, "zz first " + shared), (3, "after " + other)])
    found = [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in P.repeated_passages(docs).collect()]
    # one of doc 2's texts is behind all others: the copy is found in it, or in doc 3
    assert len(found) == 2 and (2, 2, 122, 1) in found and {(3, 1, 151, 2), (2, 0, 150, 3)} & set(found)
    out = P.remove_passages(docs, P.repeated_passages(docs))
    left = [r.text for r in out.collect()]
    assert len(left) == 5 and left.count("zz first ") == 2 and sum("o149" in t for t in left) == 1
