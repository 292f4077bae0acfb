import re

import numpy as np

from corvine.llm import mixing
from tests.llm.conftest import prose, table


def shares(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and w[s] * rest / open_ > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else w[s] * rest / open_ for s in names}
        full |= over


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 40)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, int(rng.integers(1, 60))), "en", rng.choice(["a", "b", "B", "é", "tiny"], p=[0.6, 0.2, 0.1, 0.09, 0.01])) for i in range(800)]
    rows = [(i, t, l, None if i % 50 == 0 else str(s)) for i, t, l, s in rows]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = shares(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in got) and len(got) == 800
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_rounding_keeps_the_sum_and_the_expectation():
    sizes, part = np.array([5.0, 3, 8, 2, 9, 4]), np.full(6, 0.4)
    seen = np.zeros(6)
    for seed in range(3000):
        got, left = mixing.pivot(sizes, part, np.random.default_rng(seed))
        assert abs(got @ sizes - part @ sizes) < 1e-6
        assert all(g in (0, 1) for i, g in enumerate(got) if i != left)
        seen += got
    assert np.allclose(seen / 3000, part, atol=0.04)


def test_odd_and_empty_tables(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.size == 0)
    taken = mixing.take(odd)
    assert [c for c in odd.columns if c not in ("size", "copies")] == taken.columns[:-5] and taken.filter("copies < 1").count() == 0
    assert mixing.mix(none).count() == 0


def test_rows_with_a_null_id_are_taken_too(spark):
    rows = [(None if i % 3 else i, prose(i, 5 + i % 4), "en", None if i % 2 else "a") for i in range(60)]
    docs = table(spark, rows)
    taken = mixing.take(docs).collect()
    plan = mixing.mix(docs).filter("copies > 0").collect()
    assert sum(r.taken for r in taken) == sum(r.taken for r in plan) and len(taken) == len(plan)
    assert sum(r.doc_id is None for r in taken) == sum(r.doc_id is None for r in plan) > 0
    assert len({r.text for r in taken}) == len(taken)
