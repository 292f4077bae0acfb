import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.llm import neardup, textops
from tests.llm.conftest import prose, table


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_distance_equals_the_full_matrix():
    rng = random.Random(3)
    pairs, limits = [], []
    for _ in range(400):
        a = [rng.randint(0, 30) for _ in range(rng.randint(0, 90))]
        b = a[:]
        for _ in range(rng.randint(0, 30)):
            k, i = rng.randint(0, 2), rng.randint(0, len(b))
            if k == 0:
                b.insert(i, rng.randint(0, 30))
            elif b:
                b[i % len(b)] = rng.randint(0, 30)
                if k == 1:
                    b.pop(i % len(b))
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        limits.append(rng.randint(0, 40))
    got = neardup.distance(pairs, np.array(limits))
    for (a, b), limit, d in zip(pairs, limits, got, strict=True):
        true = edits(list(a), list(b))
        assert d == true if true <= limit else d > limit


def altered(text, share, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
    return " ".join(words)


def test_classes_of_exact_and_near_copies(spark):
    rows = [(i, prose(100 + i, 150), "en", "s") for i in range(20)]
    rows += [(30 + i, altered(rows[3][1], 0.05, i), "en", "s") for i in range(25)]
    rows += [(60, rows[7][1].upper() + "!", "en", "s"), (61, altered(rows[9][1], 0.6, 1), "en", "s")]
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert all(got[30 + i] == 3 for i in range(25)) and got[60] == 7 and got[61] == 61
    assert all(got[i] == i for i in range(20))
    kept = sorted(r.doc_id for r in neardup.dedupe(table(spark, rows)).collect())
    assert kept == [*range(20), 61]


def test_shared_passages_do_not_link_and_buckets_empty(spark):
    passage = prose(7, 60)
    rows = [(i, prose(500 + i, 90) + " " + passage, "en", "s") for i in range(60)]
    got = [r.class_id for r in neardup.classes(table(spark, rows)).collect()]
    assert sorted(got) == list(range(60))


def test_linked_members_still_meet_the_unlinked(spark):
    # 1 leads the bucket of all three and links 2; 3 is near 2 only.
    words = prose(11, 100).split()
    two = [f"x{i}" if 40 <= i < 55 else w for i, w in enumerate(words)]
    three = [f"y{i}" if 60 <= i < 75 else w for i, w in enumerate(two)]
    rows = [(i, " ".join(w), "en", "s") for i, w in ((1, words), (2, two), (3, three))]
    reps = spark.createDataFrame([(i, [5]) for i in (1, 2, 3)], "id long, sketch array<long>")
    assert sorted((r.a, r.b) for r in neardup.links(table(spark, rows), reps)[0].collect()) == [(2, 1), (3, 2)]


def test_drifted_copies_around_a_late_original(spark):
    original = prose(13, 200).split()
    rows = [(i, " ".join(f"c{i}x{k}" if k in drift else w for k, w in enumerate(original)), "en", "s") for i in range(60) for drift in [set(random.Random(i).sample(range(200), 24))]]
    rows.append((60, " ".join(original), "en", "s"))
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_pairs_at_the_limit_meet(spark):
    rows, rng = [], random.Random(5)
    for i, n in enumerate([5, 6, 7, 8, 9, 10, 12, 15, 20, 24] * 8 + [60, 120, 240] * 30):
        words = prose(9000 + i, n).split()
        rows.append((2 * i, " ".join(f"{w}{i}" for w in words), "en", "s"))
        drift = set(rng.sample(range(n), n // 5))
        rows.append((2 * i + 1, " ".join("new" if k in drift else f"{w}{i}" for k, w in enumerate(words)), "en", "s"))
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert sum(got[2 * i + 1] == got[2 * i] for i in range(len(rows) // 2)) >= 0.97 * len(rows) / 2


@pytest.mark.parametrize("spacing", ["random", "even"])
def test_texts_at_any_similarity_from_the_limit_share_a_sketch(spacing):
    rng = np.random.default_rng(1)
    for n in (5, 6, 7, 8, 10, 12, 15, 20, 30, 31, 50, 100, 200, 1000):
        for share in (0.05, 0.1, 0.15, 0.2):
            k, met, tries = int(share * n + 1e-9), 0, 100 if n < 1000 else 20
            for _ in range(tries if k else 0):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                b = a.copy()
                b[rng.choice(n, k, replace=False) if spacing == "random" else np.arange(k) * n // k + n // k // 2] = rng.integers(0, 2**63, k).astype(np.uint64)
                met += len(np.intersect1d(neardup.sketches(a), neardup.sketches(b))) > 0
            assert not k or met >= 0.93 * tries, (n, share)


def test_classes_equal_those_of_all_pairs(spark):
    rng = random.Random(21)
    rows, at = [], 0
    for family in range(14):
        words = prose(2000 + family, rng.choice([6, 12, 30, 80, 150])).split()
        for _ in range(rng.randint(1, 7)):
            mine = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 4))):
                k, i = rng.random(), rng.randrange(len(mine))
                if k < 0.6:
                    mine[i] = f"n{rng.randint(0, 9)}"
                elif k < 0.8 and len(mine) > 4:
                    mine.pop(i)
                else:
                    mine.insert(i, f"m{rng.randint(0, 9)}")
            rows.append((at, " ".join(mine) + ("!" if at % 3 else ""), "en", "s"))
            at += 1
    rng.shuffle(rows)
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    split = {i: [w.strip("!") for w in t.split()] for i, t, *_ in rows}
    for i, a in split.items():
        for j, b in split.items():
            if j < i and edits(a, b) <= (1 - neardup.SIMILAR) * max(len(a), len(b)) + 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in root}


def test_bags_never_overstate_the_edits():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.integers(0, 60, rng.integers(1, 200)).astype(np.uint64)
        b = a[rng.random(len(a)) > 0.2]
        b = np.insert(b, rng.integers(0, len(b) + 1, 5), rng.integers(0, 60, 5).astype(np.uint64))
        x, y = (np.frombuffer(neardup.bag(textops.mix64(z)), np.uint8) for z in (a, b))
        least = min(len(x), len(y))
        assert neardup.surplus(neardup.folded([x], least), neardup.folded([y], least))[0] <= edits(list(a), list(b))


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 6)
    monkeypatch.setattr(neardup, "LARGE", 12)
    monkeypatch.setattr(neardup, "PER_TASK", 5)
    passage = prose(7, 60)
    rows = [(i, prose(500 + i, 25) + " " + passage, "en", "s") for i in range(60)]
    rows += [(100 + i, altered(rows[i][1], 0.05, i), "en", "s") for i in range(0, 60, 3)]
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    assert all(got[100 + i] == got[i] for i in range(0, 60, 3)) and len(set(got.values())) == len({got[i] for i in range(60)})


def hashed(text):
    return textops.words(*textops.utf8(pa.array([text]), lower=True))[3]


def test_pairs_of_a_large_bucket_meet_without_another_sketch(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "LARGE", 2)
    pairs, seed = [], 0
    while len(pairs) < 3:  # at the limit, and sketches drawn afresh would not meet
        seed += 1
        a = [f"{w}{seed}x{i}" for i, w in enumerate(prose(seed, 30).split())]
        pair = " ".join(a), " ".join("new" if i % 5 == 2 else w for i, w in enumerate(a))
        if not len(np.intersect1d(*(neardup.sketches(hashed(x), 1) for x in pair))):
            pairs.append(pair)
    # As many edits again by length alone: texts of 16 to 20, 40 to 50 and 200 to 250 words.
    pairs += [(prose(7000 + n, n), prose(7000 + n, n) + " more" * (n // 4)) for n in (16, 40, 200)]
    texts = [prose(6999, 60), *(x for pair in pairs for x in pair)]
    rows = [(i, x, "en", "s") for i, x in enumerate(texts)]
    reps = spark.createDataFrame([(i, [5]) for i in range(len(rows))], "id long, sketch array<long>")
    near, roots = neardup.links(table(spark, rows), reps)
    assert sorted((r.a, r.b) for r in near.collect()) == [(2 * i + 2, 2 * i + 1) for i in range(len(pairs))]
    assert {r.id: r.root for r in roots.collect()} == {2 * i + k: 2 * i + 1 for i in range(len(pairs)) for k in (1, 2)}


def test_repeated_ids_have_one_text(spark):
    a, b = prose(40, 60), prose(41, 60)
    rows = [(1, max(a, b), "", ""), (5, a, "", ""), (5, b, "", ""), (5, None, "", ""), (5, b, "", ""), (9, min(a, b), "", "")]
    for some in (rows, rows[::-1]):
        docs = table(spark, some).repartition(3)
        assert sorted((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()) == [(1, 1), (5, 5), (5, 5), (5, 5), (5, 5), (9, 5)]
        assert sorted((r.doc_id, r.text) for r in neardup.dedupe(docs).collect()) == [(1, max(a, b)), (5, min(a, b))]


def test_long_words_do_not_part_copies(spark):
    word = "x" * 1_500_000
    rows = [(1, "a " + word + " " + prose(3, 20), "", ""), (2, prose(4, 30), "", ""), (3, "a " + word + " " + prose(3, 20), "", "")]
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows).coalesce(1)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_odd_and_empty_tables(odd, none):
    got = Counter((r.doc_id, r.class_id) for r in neardup.classes(odd).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 2, (3, 3): 1, (4, 4): 1, (5, 5): 1, (6, 6): 1, (7, 7): 1, (8, 7): 1, (None, None): 1, (9, 9): 1, (10, 10): 1})
    kept = neardup.dedupe(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "None", "9", "10"])
    assert neardup.classes(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50)], "a long, b long")
    for broadcast_rows in (1000, 0):
        got = {r.id: r.root for r in neardup.components(edges, broadcast_rows).collect()}
        assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50}


def test_cuts_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in files.split("\n") if "shuffle_" in x}

    before = shuffled()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    pairs = rows.join(rows.withColumnRenamed("count", "other").hint("merge"), "k")
    got = neardup.cut(pairs)
    until = time.time() + 10
    while shuffled() - before and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffled() - before
    assert got.count() == pairs.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
