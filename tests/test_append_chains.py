"""Insert-if-absent with chains of clashes, against one row after another."""

from __future__ import annotations

import random

import pytest

from budgetlens.operators import dims as DM
from budgetlens.session import _SCRATCH, scratch_scope

COLS = "username string, email string, n int"


def _plain(target, new):
    """One row after another, in the order of n (then as they stand)."""
    held = [{r[i] for r in target if r[i] is not None} for i in (0, 1)]
    names, taken, ins, outs = ("username", "email"), [set(), set()], [], []
    for r in sorted(new, key=lambda r: r[2]):
        why = next((f"{names[i]} already registered" for i in (0, 1) if r[i] in held[i]), None)
        why = why or next((f"{names[i]} repeated in batch" for i in (0, 1) if r[i] in taken[i]), None)
        if why is None:
            for i in (0, 1):
                if r[i] is not None:
                    taken[i].add(r[i])
            ins.append(r)
        else:
            outs.append((*r, why))
    return sorted(target + ins, key=str), sorted(outs, key=str)


def _run(spark, target, new, **kw):
    made = []
    original = DM.materialize

    def counted(df, name):
        made.append(name)
        return original(df, name)

    DM.materialize = counted
    try:
        t = spark.createDataFrame(target, COLS)
        snapshot, rejected = DM.append_new(t, spark.createDataFrame(new, COLS), order=["n"], **kw)
        return (sorted(map(tuple, snapshot.collect()), key=str), sorted(map(tuple, rejected.collect()), key=str)), len(made)
    finally:
        DM.materialize = original


@pytest.mark.parametrize("seed", [1, 2])
def test_random_clashes_equal_one_after_another(spark, seed):
    rnd = random.Random(seed)
    pick = lambda c, k: None if rnd.random() < 0.1 else f"{c}{rnd.randrange(k)}"
    target = [(f"u{i}", f"e{i}", -1) for i in range(3)]
    new = [(pick("u", 150), pick("e", 150), i) for i in range(300)] + [("hot", f"h{i % 90}", 300 + i) for i in range(150)]
    rnd.shuffle(new)
    want = _plain(target, new)
    got, _ = _run(spark, target, new)
    assert got == want
    got, _ = _run(spark, target, new, largest=20)  # larger components go on by rounds
    assert got == want


def test_chain_of_ten_thousand_in_few_tables(spark):
    # row i shares its name with i - 1 and its e-mail with i + 1, in turn
    n = 10_000
    new = [(f"u{(i + 1) // 2}", f"e{i // 2}", i) for i in range(n)]
    with scratch_scope(spark):
        before = len(_SCRATCH)
        got, tables = _run(spark, [], new)
        assert len(_SCRATCH) - before <= 3  # tables that were read for the last time are gone
    assert got == _plain([], new)
    assert len(got[0]) == n // 2
    assert tables <= 25


def test_no_rows(spark):
    (snapshot, rejected), _ = _run(spark, [("a", None, 1)], [])
    assert snapshot == [("a", None, 1)] and rejected == []
