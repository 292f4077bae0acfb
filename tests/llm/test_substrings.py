import hashlib
import random

import numpy as np
import pytest

from corvine.llm import substrings
from tests.llm.conftest import table


def brute(rows, length=50):
    first, out = {}, []
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, x in rows:
        for p in range(len(x) - length + 1):
            k = x[p : p + length]
            first[k] = min(first.get(k, i), i)
    for i, x in rows:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize(("chunk", "hot"), [(1 << 24, 64), (700, 64), (700, 2), (700, 0)])
def test_equals_brute_force(spark, chunk, hot):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.choice([49, 50, 51, 70, 120]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(parts), "".join(rng.choice("abcé ") for _ in range(30))]) for _ in range(rng.randint(0, 6))), "en", "s") for i in range(60)]
    rows += [(60, None, "en", "s"), (61, "", "en", "s"), (5, rows[5][1], "en", "s"), (62, rows[20][1] + rows[20][1], "en", "s")]
    assert result(substrings.strip(table(spark, rows), chunk_bytes=chunk, counted_bytes=chunk, sorted_bytes=chunk, hot=hot)) == brute([r[:2] for r in rows])


def test_suffix_buckets_and_long_ties(monkeypatch):
    rng = random.Random(2)
    for bucket in (4, 100, 1 << 18):
        monkeypatch.setattr(substrings, "BUCKET", bucket)
        for _ in range(12):
            parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([20, 50, 80, 130]))) for _ in range(6)]
            texts = [t for t in (b"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(12)) if len(t) >= 50] + [b"a" * 200, b"ab" * 80]
            first = np.array([rng.randint(0, 5) for _ in texts])
            least = {}
            for t, f in zip(texts, first, strict=True):
                for i in range(len(t) - 49):
                    least[t[i : i + 50]] = min(least.get(t[i : i + 50], f), f)
            want = [least[t[i : i + 50]] if i + 50 <= len(t) else f for t, f in zip(texts, first, strict=True) for i in range(len(t))]
            offsets = np.cumsum([0, *map(len, texts)])
            assert substrings.least_ids(np.frombuffer(b"".join(texts), np.uint8), offsets, first).tolist() == want


def test_any_two_suffixes_share_a_sample_offset():
    for r in range(substrings.V):
        for s in range(substrings.V):
            assert {(c - r) % substrings.V for c in substrings.COVER} & {(c - s) % substrings.V for c in substrings.COVER}


def test_equal_texts_touching_runs_and_the_kept_rest(spark):
    a, b = "".join(chr(97 + i % 23) for i in range(50)), "".join(chr(65 + i * 7 % 25) for i in range(60))
    rows = [(1, a, "", ""), (2, b, "", ""), (3, a + b, "", ""), (4, "-" + a + "-" + b[:49], "", "")]
    got = {r.doc_id: r for r in substrings.strip(table(spark, rows), texts=True).collect()}
    assert (got[3].n_removed, got[3].n_spans, bytes(got[3].kept)) == (110, 1, b"")
    # The tail of 49 bytes alone is too short, but a string over it starts in document 3.
    assert (got[4].starts, got[4].ends) == ([1], [51]) and bytes(got[4].kept).decode() == "--" + b[:49]


def test_odd_and_empty_tables(odd, none):
    got = result(substrings.strip(odd.filter("doc_id IS NOT NULL")))
    assert got == brute([(r.doc_id, r.text) for r in odd.filter("doc_id IS NOT NULL").collect()])
    lone = substrings.strip(odd.filter("doc_id IS NULL")).collect()
    assert len(lone) == 1 and lone[0].n_removed == 0
    assert result(substrings.strip(none)) == []


def test_names_survive_the_coding():
    rng = np.random.default_rng(1)
    for n, top in ((1, 10), (1000, 2**20), (1000, 2**63), (300, 300), (2, 2**63)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (substrings.decode(substrings.encode(x)) == x).all()
