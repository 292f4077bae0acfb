import itertools
import random
import textwrap
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.llm import ann, decontaminate, license, queries, urlfilter
from tests.llm.conftest import prose, table

# Spaced seeds


def test_passages_are_found_with_substitutions(spark):
    passages = [(i, prose(900 + i, n)) for i, n in enumerate([15, 30, 60, 8, 3])] + [(7, None), (8, "")]
    bench = spark.createDataFrame(passages, "item_id long, text string")
    words = passages[2][1].split()
    for i in (9, 21, 33, 45):
        words[i] = "other"
    rows = [
        (1, prose(1, 100) + " " + passages[0][1].upper() + ", " + prose(2, 50), "", ""), (2, prose(3, 60) + " " + " ".join(words) + " " + prose(4, 9), "", ""), (3, prose(5, 300), "", ""),
        (4, passages[3][1], "", ""), (5, "and " + passages[4][1], "", ""), (6, " ".join(passages[1][1].split()[:12]), "", ""), (7, None, "", ""), (8, " ".join(passages[1][1].split()[10:24]), "", ""),
    ]
    docs = table(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (4, 3), (8, 1)}
    assert (got[1, 0].first_token, got[1, 0].last_token, got[1, 0].score) == (100, 114, 15)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    bench = [(i, prose(i, rng.randint(15, 40))) for i in range(12)]
    rows = []
    for i in range(40):
        words = prose(300 + i, 80).split()
        if i % 2:
            item = rng.choice(bench)[1].split()
            for _ in range(rng.randint(0, 5)):
                item[rng.randrange(len(item))] = "zz"
            words[30:30] = item
        rows.append((i, " ".join(words), "", ""))

    def best(a, b):
        top = 0
        for shift in range(-len(b), len(a)):
            now = 0
            for j in range(len(b)):
                if 0 <= shift + j < len(a):
                    now = max(0, now + (1 if a[shift + j] == b[j] else -decontaminate.PENALTY))
                    top = max(top, now)
        return top

    want = {(i, j): s for i, t, _, _ in rows for j, p in bench if (s := best(t.split(), p.split())) >= decontaminate.LEAST}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.overlaps(table(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want


def test_contaminated_equals_brute_force_of_the_statement(spark):
    rng = random.Random(9)
    bench = [(i, prose(700 + i, n)) for i, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 16, 20, 20, 25, 25, 33, 40, 60])]
    rows = []
    for i in range(200):
        words = prose(5000 + i, 40).split()
        item = bench[i % len(bench)][1].split()
        for k in rng.sample(range(len(item)), rng.randint(0, len(item) // 4)):
            item[k] = f"zz{k}"
        words[20:20] = item
        rows.append((i, " ".join(words), "", ""))

    def meets(a, b):
        for shift in range(1 - len(b), len(a)):
            same = [a[shift + j] == w for j, w in enumerate(b) if 0 <= shift + j < len(a)]
            if len(b) < 13:
                if 5 * sum(same) >= 4 * len(b):
                    return True
                continue
            for x in range(len(same)):
                agree = 0
                for y in range(x, len(same)):
                    agree += same[y]
                    if agree >= 13 and 5 * (y - x + 1 - agree) <= y - x + 1:
                        return True
        return False

    want = {(i, j) for i, t, _, _ in rows for j, p in bench if meets(t.split(), p.split())}
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = table(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == sorted(set(range(200)) - {i for i, _ in want})


def test_contaminated_rows_with_a_null_id_go(spark):
    docs = table(spark, [(None, prose(1, 30) + " " + prose(2, 30), "", ""), (None, prose(3, 40), "", ""), (1, prose(2, 30), "", ""), (None, None, "", "")])
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, prose(2, 30))], "item_id long, text string"))
    assert sorted(str(r.text) for r in kept.collect()) == sorted([prose(3, 40), "None"])


def test_more_passes_find_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(40 + i, 30)) for i in range(9)], "item_id long, text string")
    docs = table(spark, [(i, prose(90 + i, 20) + " " + prose(40 + i, 30), "", "") for i in range(9)])
    monkeypatch.setattr(decontaminate, "PASS_TOKENS", 70)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == {(i, i) for i in range(9)}


def test_decontamination_of_odd_and_empty_tables(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(odd, empty).count() == odd.count() and decontaminate.clean(none, empty).count() == 0
    assert decontaminate.overlaps(odd, spark.createDataFrame([(1, prose(2, 200))], empty.schema)).count() == 2


def test_a_long_text_of_hits_keeps_no_copy_of_itself_for_each(spark):
    # 40,000 tokens, 160,000 hits: 51 GB if each had all hashes of the text.
    item = [f"tok{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, " ".join((item + ["gap"]) * 800))], "doc_id long, text string")
    (got,) = decontaminate.contaminated(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert (got.doc_id, got.item_id, got.score, got.first_token, got.last_token) == (1, 5, 50, 0, 49)


# URLs


def test_rules_by_host_path_and_length(spark):
    rules = [urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"), urlfilter.Rule("block", "", "/raw"), urlfilter.Rule("block", "a.b+c.org", "/x.y/")]
    urls = ["http://www.EXAMPLE.com/en/71?x", "http://example.com/en/6", "https://notexample.com/en/7#f", "http://com/en/", "http://xcom/en/", "ftp://q/raw/1", "http://a.b+c.org/x.y/z", "http://aab+c.org/x.y/", "http://a.b+c.org/xzy/", None, "none", "x://", "http://h?a/b://c/en/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in urlfilter.judge(pages, rules).collect()}
    assert [got[i].rule for i in range(13)] == ["example.com/en/7", "com/en/", "com/en/", "com/en/", None, "/raw", "a.b+c.org/x.y/", None, None, None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 4, 9)] == ["allow", "block", "allow", "allow"]
    assert (got[0].host, got[0].path, got[9].host, got[12].host, got[12].path) == ("www.example.com", "/en/71", "", "h", "")
    assert got[7].candidates == 1  # the rule without a token alone


def test_registered_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://w.shop.net/de/1", "http://example.net/de/81", "http://example.net/de/7", "http://a.org/es/", "http://a.org/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]
    assert [(r.rule, r.verdict) for r in queries.op5_urls(spark, str(tmp_path)).orderBy("page_id").collect()] == want
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert con.sql(f"SELECT rule, verdict FROM ({queries.ORACLES['op5_urls']}) ORDER BY page_id").fetchall() == want


def test_rules_in_parts_and_none(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "PART", 3)
    rules = [urlfilter.Rule("block", f"h{i}.net", "/a/" if i % 2 else "/") for i in range(10)]
    pages = spark.createDataFrame([(i, f"http://w.h{i}.net/a/b") for i in range(12)], "page_id long, url string")
    got = {r.page_id: r.rule for r in urlfilter.judge(pages, rules).collect()}
    assert got == {i: (rules[i].text if i < 10 else None) for i in range(12)}
    assert {r.verdict for r in urlfilter.judge(pages, [], "block").collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


# Licenses


def test_licenses_in_other_dress(spark, odd, none):
    mit = dict(license.KNOWN)["MIT"]
    rows = [(1, "Copyright (c) 2020 Ann\n" + mit, "", ""), (2, mit.upper().replace(",", " ;"), "", ""), (3, mit.replace("sublicense", "sub-licence"), "", ""), (4, mit + " more", "", ""), (5, "  released under\nthe MIT licence", "", ""), (6, None, "", ""), (7, "", "", "")]
    got = {r.doc_id: r.license for r in license.scan(table(spark, rows), license.digests(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "MIT-notice", 6: None, 7: None}
    assert license.scan(odd, license.digests(spark), broadcast_rows=1).count() == odd.count() and license.scan(none, license.digests(spark)).count() == 0


def test_known_texts_wrapped_at_any_width(spark):
    texts = [(k, "Copyright (c) 2020 Ann\n\n" + textwrap.fill(t, width)) for k, t in license.KNOWN for width in range(20, 101)]
    rows = [(i, t, "", "") for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license for r in license.scan(table(spark, rows), license.digests(spark)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(texts)}


# Neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    return {i: sorted(((-float(np.add.accumulate(q * x)[-1]), j) for j, x in ok if j != i))[:k] for i, q in ok if i % 20 == 0}


@pytest.mark.parametrize("unit", [True, False])
def test_recall_and_exact_scores(spark, unit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) if unit else 1
    x[40] = x[41]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = brute(rows, 20)
    got = {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all([g[0] for g in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({g[1] for g in got[q]} & {j for _, j in want[q]}) / 20 for q in want]) >= 0.9
    for q, v in got.items():
        true = x[[g[1] for g in sorted(v)]].astype(float) @ np.array(rows[q][1])
        assert np.allclose([g[2] for g in sorted(v)], true, atol=1e-12)


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 90)] + [(100, [0.0, 0.0, 0.0]), (120, None), (140, [1.0, None, 0.0]), (160, [float("nan"), 1.0, 0.0]), (180, [float("inf"), 0.0, 0.0]), (200, [0.0, 1.0, 0.0]), (201, [0.5, 0.5, 0.0])]
    got = {}
    for r in ann.search(vectors(spark, rows + rows[:3]), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert {q: [(i + 1, j, -s) for i, (s, j) in enumerate(v)] for q, v in want.items()} == {q: sorted(v) for q, v in got.items()}


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [-1.0, 0.5])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(vectors(spark, [(0, None)]), F.col("vec_id") % 20 == 0).count() == 0


def test_an_outlier_among_clusters_is_compared_with_all(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    x = centre + 0.05 * rng.normal(size=(700, 16))
    x[40] = -centre
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    want, got = brute(rows, 20), {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}
    assert sorted(got[40]) == want[40]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_an_id_with_several_vectors_counts_with_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.0]), (2, [0.0, 0.8]), (2, [0.7, 0.0]), (3, [-1.0, 0.0])]
    for some in (rows, rows[::-1]):
        got = [(r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(vectors(spark, some), F.col("vec_id") % 20 == 0, k=2).orderBy("rank").collect()]
        assert got == [(1, 1, 0.9), (2, 2, 0.8)]


def test_two_polytopes_a_table(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1200)] + 0.1 * rng.normal(size=(1200, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    want, got = brute(rows, 20), {}
    for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, probes=40, polytopes=2).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)
    y = rng.normal(size=(5, 8))
    every = ann.buckets(y, 3, 10**6, 2)
    assert every.shape == (5, 256) and all(len(set(r)) == 256 for r in every.tolist())
    assert (ann.buckets(y, 3, 9, 2) == every[:, :9]).all()


def test_fitted_probes_grow_no_dearer(monkeypatch):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 900)] + 0.05 * rng.normal(size=(900, 12))
    norm = float(np.linalg.norm(x, axis=1).max())
    monkeypatch.setattr(ann, "BLOCK", 8)
    few, many = ann.fit_probes(x, norm, 20, 100), ann.fit_probes(x, norm, 20, 10**7)
    assert few[0] == 1 and many[0] == 2 and many[1] < 32 * 32


def test_odd_urls(spark):
    long = "http://h.net/a/" + "x" * 200_000
    rows = [(1, long), (1, long), (None, "http://h.net/a/b"), (2, None), (3, "no scheme"), (None, None)]
    pages = spark.createDataFrame([(*r, "h", "p", 3) for r in rows], "page_id long, url string, host string, path string, size int")
    got = sorted((str(r.page_id), r.host, len(r.path), r.rule, r.verdict) for r in urlfilter.judge(pages, [urlfilter.Rule("block", "net", "/a/")]).collect())
    assert got == sorted([("1", "h.net", 200_003, "net/a/", "block")] * 2 + [("None", "h.net", 4, "net/a/", "block"), ("2", "", 0, None, "allow"), ("3", "", 0, None, "allow"), ("None", "", 0, None, "allow")])


def test_license_lines_and_whole_files(spark):
    mit = dict(license.KNOWN)["MIT"]
    rows = [(1, "Copyright 2020 Ann\nAll rights reserved.\n\n" + mit, "", ""), (2, "(c) 2020 Ann\n  ALL RIGHTS RESERVED\n" + mit, "", ""), (3, "All rights reserved by Ann\n" + mit, "", "")]
    files = Path("/usr/share/common-licenses")
    named = {"GPL-3.0": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"} if files.is_dir() else {}
    rows += [(10 + i, (files / f).read_text().replace("\n", "\r\n").upper(), "", "") for i, f in enumerate(named.values())]
    got = {r.doc_id: r.license for r in license.scan(table(spark, rows), license.digests(spark)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None} | {10 + i: k for i, k in enumerate(named)}
    assert license.scan(table(spark, rows), license.digests(spark, [], [])).filter("license IS NOT NULL").count() == 0


def test_masks_meet_any_few_substitutions_of_the_least_length():
    """Wherever up to three of the tokens of the least stretch that scores LEAST differ, a mask or a run lies between."""
    seeds = decontaminate.MASKS + (tuple(range(4)),)
    for k in range(4):
        n = max(decontaminate.LEAST, decontaminate.PENALTY * k) + k
        for differ in itertools.combinations(range(n), k):
            assert any(not any(i + p in differ for p in m) for m in seeds for i in range(n - max(m)))
