import hashlib
import os

import numpy as np
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corvine import catalog
from corvine.functions import hashed
from corvine.functions import text as tx
from corvine.functions import vector as vec
from corvine.operators import chunking, evaluation, fusion, lexical, losses, matching, mining, ordering, tokens, topk, vectors
from corvine.plans import corpus, rag, search
from corvine.sources import files
from corvine.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [("spin_lock_irqsave", ["spin", "lock", "irqsave"]), ("kmemLeakScan", ["kmem", "leak", "scan"]), ("A1B2", ["a1", "b2"]), ("HTTPServer", ["httpserver"]), ("", []), ("é naïve 😀", ["na", "ve"])],
)
def test_identifier_tokens(spark, text, want):
    assert one(spark, text, tx.identifier_tokens) == want


def test_text_expressions(spark):
    assert one(spark, "\u00a0\t a \n", tx.strip) == "a"
    assert one(spark, "a/b/c.h", tx.subsystem) == "a/b" and one(spark, "a.h", tx.subsystem) == "a.h"
    assert one(spark, "f" * 100 + "\nx", tx.snippet) == "f" * 96
    d = one(spark, "  #define A\n\n#define B\nint x;\n\t\n", lambda x: tx.line_density(x, "#define"))
    assert (d.n, round(d.ratio, 6)) == (3, 0.666667)
    assert one(spark, "", lambda x: tx.line_density(x, "#define")).ratio == 0.0
    assert one(spark, "cosine_MRR@10", tx.metric_name) == "mrr@10"


def test_density_limits_are_inclusive(spark):
    body = lambda n, m: "#define X\n" * m + "int y;\n" * (n - m)
    got = [one(spark, body(n, m), corpus.generated) for n, m in ((499, 499), (500, 300), (500, 299))]
    assert got == [False, True, False]


def test_tree_scan(spark, tmp_path):
    for name, data in {"a.c": b"int x;", "_b.c": b"x\xff\xfe", ".c.c": b"", "_gen/d.h": b"a" * 9000 + b"\0", "n.c": b"a\0", "E.C": b"", "t.txt": b"", ".git/x.c": b"", "big.c": b"a" * (4 << 20), "bigger.c": b"a" * ((4 << 20) + 1), "gen.h": b"#define A\n" * 600}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "a.c", tmp_path / "link.c")
    got = {r.path: r for r in corpus.judged(files.scan_tree(spark, str(tmp_path))).collect()}
    assert {k: v.disposition for k, v in got.items()} == {"a.c": "kept", "_b.c": "kept", ".c.c": "kept", "_gen/d.h": "kept", "n.c": "binary", "big.c": "kept", "bigger.c": "oversized", "gen.h": "generated"}
    assert got["_b.c"].text == b"x\xff\xfe".decode(errors="replace") and got["n.c"].text is None
    assert {r.path for r in files.scan_store(spark, str(tmp_path)).collect()} >= {"a.c", "n.c", "big.c"}


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é\n"), ("b", "")], files.CORPUS)
    files.write_jsonl(rows.coalesce(1), str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("part-*")
    assert "é" in part.read_text()
    part.write_text(part.read_text() + "\n  \n")
    (tmp_path / "j" / f".{part.name}.crc").unlink()
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), files.CORPUS).collect())) == [("a", "é\n"), ("b", "")]
    part.write_text("{bad\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|Malformed"):
        files.read_jsonl(spark, str(tmp_path / "j"), files.CORPUS).collect()


def test_documents_of_either_shape(spark):
    rows = spark.createDataFrame([(2, "p", "n", None, "", "late"), (1, "p", "n", "struct", "code", "x"), (3, "p", "m", None, None, "pos")], "ord long, path string, name string, kind string, code string, positive string")
    assert sorted(map(tuple, files.load_documents(rows, "ord").collect())) == [("p", "m", "function", 0, "pos"), ("p", "n", "struct", 0, "code")]


def test_index_rejects_unpaired_vectors(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "p", "c"), (1, "p", "d")], "chunk_id long, path string, code string")
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "chunk_id long, embedding array<float>")
    files.write_index(chunks, v, str(tmp_path / "i"), code=False)
    index = spark.read.parquet(str(tmp_path / "i"))
    assert "code" not in index.columns and tuple(files.index_info(index).first()) == (2, 1, 8)
    with pytest.raises(Exception, match="differ"):
        files.write_index(chunks, v.filter("chunk_id = 0"), str(tmp_path / "k"))


def test_windows_equal_a_loop(spark):
    for n, size, stride in ((1, 6, 4), (6, 6, 4), (7, 6, 4), (23, 6, 4), (200, 60, 45)):
        rows = [str(i) if i % 7 else "" for i in range(n)]
        rows[: min(n, 8)] = [" "] * min(n, 8)
        got = [(r.line, r.code) for r in chunking.window_chunks(spark.createDataFrame([("d/f.c", "\n".join(rows))], files.CORPUS), size, stride).orderBy("line").collect()]
        want = []
        for s in range(0, max(n - 1, 1), stride):
            block = rows[s : s + size]
            if any(x.strip() for x in block):
                want.append((s + 1, "\n".join(block)))
                if s + size >= n:
                    break
        assert got == want


def test_chunks_fall_back_to_windows(spark):
    rows = [("d/f.c", "int f(int long_parameter_name)\n{\n\treturn long_parameter_name + 1;\n}\nint tail;\n"), ("d/m.h", "#define A_LONG_MACRO_NAME 1\n" * 4), ("d/s.h", "int x;\n"), ("d/t.c", "int f(void)\n{\n}\n")]
    got = {(r.path, r.kind) for r in chunking.chunk(spark.createDataFrame(rows, files.CORPUS)).collect()}
    assert got == {("d/f.c", "function"), ("d/m.h", "window")}


def test_bm25_counts_repeats_and_fills_up(spark):
    docs = lexical.tokenized(spark.createDataFrame([(0, "a b"), (1, "b b c"), (2, "")], "doc_id long, text string"))
    asked = spark.createDataFrame([(0, ["b", "b"]), (1, ["zzz"]), (2, ["c"])], "query_id long, tokens array<string>")
    got = lexical.bm25_topk(docs, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 1), (0, 0), (1, 0), (1, 1), (2, 1), (2, 0)]
    idf, mean = max(np.log((3 - 2 + 0.5) / 2.5 + 1), 1e-6), 5 / 3
    assert got[0].score == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))) and got[2].score == 0


def test_fusion_ties_follow_the_first_ranking(spark):
    r = lambda rows: spark.createDataFrame([(0, d, k) for d, k in rows], "query_id long, doc_id long, rank int")
    got = fusion.fused([r([(1, 1), (2, 2), (3, 3)]), r([(2, 1), (1, 2), (9, 3)])], 4).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [1, 2, 3, 9] and got[0].rrf == pytest.approx(1 / 61 + 1 / 62)


def test_metrics_of_known_ranks(spark):
    ranks = spark.createDataFrame([(1,), (3,), (11,), (None,)], "rank int")
    m = evaluation.closed(ranks).first()
    assert (m.accuracy_at_1, m.accuracy_at_5, m.recall_at_10) == (0.25, 0.5, 0.5)
    assert m.mrr_at_10 == pytest.approx((1 + 1 / 3) / 4) and m.ndcg_at_10 == pytest.approx((1 + 0.5) / 4)
    o = evaluation.open_corpus(ranks).first()
    assert (o.recall_at_50, o.median_rank) == (0.75, 3) and o.mrr == pytest.approx((1 + 1 / 3 + 1 / 11) / 4)
    wide = evaluation.compare([evaluation.long(evaluation.closed(ranks), "x"), evaluation.long(spark.createDataFrame([(1.0,)], "recall_at_10 double"), "y")], ["x", "y"])
    assert {r.metric: r.delta for r in wide.collect()}["recall_at_10"] == 0.5 and np.isnan({r.metric: r.y for r in wide.collect()}["accuracy_at_1"])


def test_budget_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(0, 1, "x" * 50), (0, 2, "y" * 50), (0, 3, "z" * 30), (1, 1, "x" * 500), (1, 2, ""), (2, 1, "x" * 60), (2, 2, "y" * 40)], "query_id long, rank int, block string")
    assert sorted((r.query_id, r["rank"]) for r in rag.within_budget(hits, 100).collect()) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)]
    assert {r.query_id: r.context for r in rag.context(hits, 100).collect()}[2] == "x" * 60 + "\n" + "y" * 40


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scores(spark, a, c, ga=None, gc=None):
    ga, gc = (a, c) if ga is None else (ga, gc)
    f = lambda x: [float(v) for v in x]
    left = spark.createDataFrame([(0, i, f(a[i]), f(ga[i])) for i in range(len(a))], "batch long, i long, a array<double>, ga array<double>")
    right = spark.createDataFrame([(0, j, f(c[j]), f(gc[j])) for j in range(len(c))], "batch long, j long, c array<double>, gc array<double>")
    return losses.pair_scores(left, right)


def nce(s, keep=None):
    s = 20 * s if keep is None else np.where(keep, 20 * s, -np.inf)
    return float(np.mean(np.log(np.exp(s).sum(1)) - np.diag(s)))


def test_loss_identities(spark):
    rng = np.random.default_rng(0)
    a, p, n = unit(rng, 4, 8), unit(rng, 4, 8), unit(rng, 4, 8)
    s = scores(spark, a, p)
    assert losses.infonce(s).first().loss == pytest.approx(nce(a @ p.T))
    assert losses.total(s, w_gist=0.0, w_infonce=1.0).first().total == pytest.approx(nce(a @ p.T))
    wide = scores(spark, a, np.concatenate([p, n]))
    assert wide.count() == 32 and losses.infonce(wide).first().loss == pytest.approx(nce(a @ np.concatenate([p, n]).T))
    assert losses.infonce(wide).first().loss > nce(a @ p.T)
    t = losses.total(scores(spark, a, p, unit(rng, 4, 8), unit(rng, 4, 8))).first()
    assert t.total == pytest.approx(0.6 * t.gist + 0.4 * t.infonce)


def test_false_negatives_are_masked_and_the_diagonal_stays(spark):
    a, p = np.array([[1.0, 0], [0, 1]]), np.array([[0.7071, 0.7071], [1, 0]])
    t = losses.total(scores(spark, a, p)).first()
    assert t.gist < t.infonce
    ones = np.ones((6, 8)) / np.sqrt(8)
    assert np.isfinite(losses.total(scores(spark, unit(np.random.default_rng(1), 6, 8), unit(np.random.default_rng(2), 6, 8), ones, ones)).first().gist)


def test_vocabularies(spark):
    v = lambda *rows: spark.createDataFrame(rows, "token string, id int")
    assert tuple(losses.same_vocabulary(v(("a", 0)), v(("a", 0))).first()) == (0, True)
    assert tuple(losses.same_vocabulary(v(("a", 0)), v(("b", 1))).first()) == (2, False)


def test_negatives_are_siblings_of_another_name(spark):
    rows = [(1, "x/y/a.c", "f"), (2, "x/y/a.c", "g"), (3, "x/y/b.c", "h"), (4, "x/y/c.c", "f"), (5, "x/y/c.c", "f"), (6, "q/lone.c", "z"), (7, "r/s/t.c", "k"), (8, "r/s/t.c", "k")]
    df = spark.createDataFrame([(*r, f"code {r[0]}") for r in rows], "i long, path string, name string, positive string")
    got = {r.i: r for r in mining.hard_negatives(df).collect()}
    by = {r[0]: r for r in rows}
    assert set(got) == {1, 2, 3, 4, 5} and [got[i].tier for i in sorted(got)] == [0, 0, 1, 1, 1]
    assert all(by[r.j][2] != by[i][2] and r.negative == f"code {r.j}" for i, r in got.items()) and got[1].j == 2


def test_batches_lose_no_row(spark):
    rows = [(100 * g + k, f"g{g}") for g, n in enumerate((0, 7, 8, 9, 16)) for k in range(n)]
    got = mining.grouped_batches(spark.createDataFrame(rows, "i long, g string"), "g", 8).collect()
    assert sorted(r.i for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for r in got:
        sizes.setdefault((r.full, r.batch), []).append(r.place)
    assert sum(f for f, _ in sizes) == 4 and all(sorted(p) == list(range(len(p))) for p in sizes.values()) and sorted(len(p) for (f, _), p in sizes.items() if not f) == [8]
    texts = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)], "i long, text string")
    batches = {}
    for r in mining.distinct_batches(texts, "text", 4).join(texts, "i").collect():
        batches.setdefault(r.batch, []).append(r.text)
    assert sum(map(len, batches.values())) == 40 and all(len(b) == len(set(b)) <= 4 for b in batches.values())


def test_splits(spark):
    paths = ["a.c", "lib/x.h", "é"]
    got = [r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select(mining.blake2b_number("p").alias("n")).collect()]
    assert got == [int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") % 1_000_000 for p in paths]
    many = spark.range(4000).select(F.col("id").cast("string").alias("p"))
    assert [many.filter(tx.in_validation(F.col("p"), f)).count() for f in (0, 1)] == [0, 4000] and 10 < many.filter(tx.in_validation(F.col("p"), 0.01)).count() < 90


def test_positions_and_sums(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, i % 5) for i in range(101)], "i long, k long, n long").repartition(5)
    rows = sorted(ordering.placed(df, [F.col("k")], F.col("n")).collect(), key=lambda r: r.k)
    assert [r.pos for r in rows] == list(range(101)) and [r.start for r in rows] == list(np.cumsum([0] + [r.n for r in rows])[:-1])
    assert ordering.evenly_spaced(10, 4) == [0, 3, 6, 9] and ordering.evenly_spaced(3, 9) == [0, 1, 2] and ordering.evenly_spaced(5, 1) == [0]


@pytest.mark.parametrize("lengths", [[2, 1], [3, 3, 4], [30], [0, 0, 5, 0]])
def test_token_windows_cut_the_stream(spark, lengths):
    docs = spark.createDataFrame([(i, [100 * i + 5 + k for k in range(n)]) for i, n in enumerate(lengths)], "doc_id long, ids array<int>")
    stream = [t for r in docs.orderBy("doc_id").collect() for t in [*r.ids, tokens.SEP]]
    got = {r.window: r.ids for r in tokens.token_windows(tokens.pack_offsets(docs, [F.col("doc_id")]), 7).collect()}
    assert got == {w: stream[7 * w : 7 * w + 7] for w in range(len(stream) // 7)}


def test_masking_spares_specials(spark):
    rows = spark.createDataFrame([(w, [3] + list(range(5, 132))) for w in range(40)], "window long, ids array<int>")
    got = tokens.mlm_mask(rows).collect()
    drawn = sum(x != -100 for r in got for x in r.labels)
    assert all(r.input_ids[0] == 3 and r.labels[0] == -100 for r in got) and 0.12 < drawn / (40 * 127) < 0.18
    masked = sum(a == tokens.MASK for r in got for a, b in zip(r.input_ids, r.labels, strict=True) if b != -100)
    assert 0.74 < masked / drawn < 0.86 and all(a == i for r in got for a, b, i in zip(r.input_ids, r.labels, [3, *range(5, 132)], strict=True) if b == -100)


def test_bpe_equals_the_public_trainer(spark):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["a\u00a0b  c\n\n d's 12ab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merges = tokens.train_bpe(tokens.pretoken_counts(docs), 700)
    theirs = Tokenizer(models.BPE())
    theirs.pre_tokenizer, theirs.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    theirs.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=700, min_frequency=2, special_tokens=list(tokens.SPECIALS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    ours = tokens.vocabulary(merges)
    assert len(set(ours) & set(theirs.get_vocab())) / len(ours) > 0.99
    encode = tokens.encoder(merges)
    back = {i: t for t, i in ours.items()}
    letters = {c: b for b, c in enumerate(tokens.byte_letters())}
    for r in docs.select("text", encode(F.col("text")).alias("ids")).collect():
        assert bytes(letters[c] for i in r.ids for c in back[i]).decode() == r.text


def test_registered_bpe_learns_past_a_small_vocabulary(spark):
    from corvine import catalog

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = catalog.bpe_merges(spark, "/root/testdata/sf0.001").orderBy("rank").collect()
    assert [(r.left, r.right) for r in got] == tokens.train_bpe(tokens.pretoken_counts(docs), 32_768)
    assert len(got) > 1_500


def test_template(spark):
    row = spark.createDataFrame([([7, 8], [9])], "a array<int>, b array<int>").select(tokens.template(F.col("a")).alias("x"), tokens.template(F.col("a"), F.col("b")).alias("y")).first()
    assert (row.x, row.y) == ([2, 7, 8, 3], [2, 7, 8, 3, 9, 3])
    with pytest.raises(ValueError, match="16 bits"):
        tokens.vocabulary([(str(i), "x") for i in range(66_000)])


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(vec.normalize(F.col("a")).alias("n"), vec.normalize(F.col("z")).alias("z"), vec.cosine(F.col("a"), F.col("a")).alias("c"), vec.quantize(F.col("a")).alias("q")).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.z == [0, 0] and row.c == pytest.approx(1) and row.q.codes == [95, 127]


def test_stream_of_documents_is_chunked_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text(f'{{"path": "d/{k}.h", "text": "a\\nb\\nc"}}\n')
        ingest.chunk_stream(ingest.documents(spark, str(src)), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["d/0.h", "d/1.h"]


def test_every_query_has_rows_on_small_tables(spark):
    for name in ("knn_lsh", "kdoc_mine", "extract_definitions", "chunk_with_fallback", "scan_tree", "hash_split_blake2b", "bm25_topk"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("mode", ["dense", "hybrid", "rerank"])
def test_search_finds_the_chunk_that_holds_the_words(spark, mode):
    rows = [(i, "a/b.c", f"n{i}", "function", 1, f"alpha{i} beta{i} gamma{i} common\nrest") for i in range(30)]
    index = spark.createDataFrame(rows, "chunk_id long, path string, name string, kind string, line int, code string").withColumn("embedding", search.hashed_vector(F.col("code"), 256))
    asked = spark.createDataFrame([(1, "beta7 gamma7"), (2, "common alpha12")], "query_id long, text string").withColumn("embedding", search.hashed_vector(F.col("text"), 256))
    hits = search.search(index, asked, 3, mode)
    got = {(r.query_id, r["rank"]): r for r in hits.collect()}
    assert len(got) == 6 and got[1, 1].chunk_id == 7 and got[2, 1].chunk_id == 12 and got[1, 1].snippet.startswith("alpha7") and "\n" not in got[1, 1].snippet
    with pytest.raises(ValueError, match="mode"):
        search.search(index, asked, 3, "x")


def test_token_files_hold_16_bits(spark, tmp_path):
    w = spark.createDataFrame([(1, [7, 65535]), (0, [3, 256])], "window long, ids array<int>")
    assert {r.window: bytes(r.data) for r in files.token_bytes(w).collect()} == {0: b"\x03\x00\x00\x01", 1: b"\x07\x00\xff\xff"}
    files.write_tokens(w, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_one_call_entries(spark, tmp_path):
    from corvine.operators import evaluation, tokens
    from corvine.plans import corpus, rag, search
    from corvine.sources import files

    root = tmp_path / "tree"
    (root / "lib").mkdir(parents=True)
    (root / "lib/a.c").write_text("int f(int a)\n{\n\treturn a;\n}\n" * 3)
    (root / "lib/b.h").write_text("#define X 1\n" * 600)
    got = {r.disposition: r.n for r in corpus.build(spark, str(root), str(tmp_path / "corpus")).collect()}
    kept = files.read_jsonl(spark, str(tmp_path / "corpus"), files.CORPUS)
    assert got == {"kept": 1, "generated": 1} and [r.path for r in kept.collect()] == ["lib/a.c"]

    docs = spark.createDataFrame([(f"d/{i}.c", "static int value = 3;\nint other(void);\n" * (i + 1)) for i in range(12)], files.CORPUS)
    merges = tokens.train_bpe(tokens.pretoken_counts(docs), 300)
    files.write_merges(spark, merges, str(tmp_path / "merges"))
    assert files.read_merges(spark, str(tmp_path / "merges")) == merges
    parts = tokens.pack(docs, merges, 0.5, 16)
    windows = {k: v.collect() for k, v in parts.items()}
    assert all(len(r.ids) == 16 for rows in windows.values() for r in rows) and windows["train"] and windows["val"]

    vector = search.hashed_vector(F.col("code"))
    index = docs.select(F.xxhash64("path").alias("chunk_id"), "path", F.lit("n").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line"), F.col("text").alias("code")).withColumn("embedding", vector)
    asked = spark.createDataFrame([(1, "static value"), (2, "other")], "query_id long, text string").withColumn("embedding", search.hashed_vector(F.col("text")))
    prompts = {r.query_id: r for r in rag.ask(index, asked, 3, "hybrid", 500).collect()}
    assert set(prompts) == {1, 2} and all("Question: " in r.prompt and r.n_blocks >= 1 for r in prompts.values())

    files.upsert_index(index, str(tmp_path / "index"), 1)
    files.upsert_index(index.limit(2).withColumn("name", F.lit("new")), str(tmp_path / "index"), 2)
    assert sorted(r.name for r in files.read_index(spark, str(tmp_path / "index")).collect()) == ["n"] * 10 + ["new"] * 2

    gold = spark.createDataFrame([(1, 7), (2, 8)], "query_id long, doc_id long")
    ranking = spark.createDataFrame([(1, 7, 1), (2, 9, 1), (2, 8, 2)], "query_id long, doc_id long, rank int")
    table = {r.metric: (r.a, r.b) for r in evaluation.evaluate({"a": ranking, "b": ranking.filter("rank = 1")}, gold).collect()}
    assert table["accuracy_at_1"] == (0.5, 0.5) and table["mrr_at_10"] == (0.75, 0.5)


def test_metric_names_and_accumulation(spark):
    from corvine.functions import text as tx
    from corvine.operators import evaluation, losses

    rows = spark.createDataFrame([("dev_cosine_Accuracy@1", 0.5), ("dev_cosine_ndcg@10", 0.25), ("loss", 3.0), ("x_recall@100", 1.0)], "key string, value double")
    assert {r.metric: r.value for r in evaluation.picked(rows).collect()} == {"accuracy@1": 0.5, "ndcg@10": 0.25}
    assert sorted(r.key for r in rows.filter(tx.is_reported(F.col("key"))).collect()) == ["dev_cosine_Accuracy@1", "dev_cosine_ndcg@10", "x_recall@100"]
    assert [r[0] for r in rows.filter("key = 'loss'").select(losses.accumulated(F.col("value"), 4)).collect()] == [0.75]


def test_containing_equals_plain_search(spark):
    from corvine.operators import matching

    docs = [(1, "one two three four five six seven eight nine"), (2, "xone two three four five six seveny"), (3, "a,b,c"), (4, None), (5, "zebra-crossing here"), (6, "")]
    items = [(1, "two three four five six seven"), (2, "one two three four five six seven"), (3, "b"), (4, "zebra-crossing"), (5, "e"), (6, None), (7, "ne two three four five six seve"), (8, "a,b,c"), (9, "five six seven!")]
    got = matching.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    want = sorted((i, d) for i, p in items if p is not None for d, t in docs if t is not None and p in t)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == want


def test_bpe_equals_a_plain_trainer(spark):
    from collections import Counter

    from corvine.operators import tokens

    texts = ["the cat sat on the mat the cat", "a cat and a hat sat", "thé cât the cat", "hhhhh hhhh aaa"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {r.word: r.n for r in tokens.pretoken_counts(docs).collect()}
    letters = tokens.byte_letters()
    names = [*tokens.SPECIALS, *sorted(letters)]
    words = {w: [letters[b] for b in w.encode()] for w in counts}
    want = []
    while True:
        pairs = Counter()
        for w, parts in words.items():
            for p in zip(parts, parts[1:], strict=False):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], names.index(p[0]), names.index(p[1])))
        if pairs[best] < 2:
            break
        want.append(best)
        if best[0] + best[1] not in names:
            names.append(best[0] + best[1])
        for w, parts in words.items():
            out, i = [], 0
            while i < len(parts):
                two = tuple(parts[i : i + 2]) == best
                out.append("".join(best) if two else parts[i])
                i += 2 if two else 1
            words[w] = out
    merges = tokens.train_bpe(tokens.pretoken_counts(docs))
    assert merges == want
    ids = tokens.vocabulary(merges)
    back = {i: t for t, i in ids.items()}
    spell = {c: b for b, c in enumerate(letters)}
    for r in docs.select("text", tokens.encoder(merges)(F.col("text")).alias("ids")).collect():
        assert bytes(spell[c] for i in r.ids for c in back[i]).decode() == r.text


def test_text_batches(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(25)], "doc_id long, text string")
    got = list(files.text_batches(docs, 10))
    assert [len(b) for b in got] == [10, 10, 5] and sorted(int(x) for b in got for x in b) == list(range(25))


def test_lsh_recall(spark):
    import numpy as np

    from corvine.operators import vectors

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 600)] + 0.25 * rng.normal(size=(600, 16))).tolist()
    base = vectors.normalized(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).select("doc_id", "v")
    asked = base.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    exact, near = ({(r.query_id, r.doc_id) for r in f(base, asked, 10).collect()} for f in (vectors.knn, vectors.knn_lsh))
    assert len(exact & near) >= 0.9 * len(exact)


def _odd_vectors(spark):
    """Ties by copies, nulls, a null component, another size, no number, a null and a repeated id."""
    rng = np.random.default_rng(5)
    x = [v.tolist() for v in rng.normal(size=(40, 6))]
    rows = [(i, x[i % 25]) for i in range(60)] + [(70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (72, [1.0, 2.0]), (73, [float("nan")] * 6), (None, x[3]), (5, x[30]), (74, [0.0] * 6)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def test_vector_scores_equal_the_column_expressions(spark):
    base = vectors.normalized(_odd_vectors(spark))
    asked = base.filter("doc_id IN (5, 7, 70, 71, 72, 73)").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    plain = lambda df: sorted((repr(tuple(r)) for r in df.select("query_id", "doc_id", "score").collect()))
    ours, theirs = vectors.scores(base, asked), base.crossJoin(asked).select("query_id", "doc_id", vec.dot(F.col("v"), F.col("q")).alias("score"))
    assert plain(ours) == plain(theirs)
    assert "NestedLoop" not in ours._jdf.queryExecution().toString()
    one = asked.filter("query_id <> 5")
    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    for k in (1, 4, 30, 100):
        want = ordering.ranked(theirs.filter("query_id <> 5"), ["query_id"], order, k)
        got = vectors.knn(base, one, k)
        assert sorted(map(repr, got.select("query_id", "rank", "doc_id", F.round("score", 9)).collect())) == sorted(map(repr, want.select("query_id", "rank", "doc_id", F.round("score", 9)).collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_best_rounds_as_spark_does(spark):
    x = [0.1234567885, 0.1234567895, -0.1234567885, 2.5e-9, 3.5e-9, -2.5e-9, 0.3, 1 / 3, 123.0000000005, 0.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 9).alias("r")).orderBy("i").collect()
    assert (topk.rounded(np.array(x)) / 1e9).tolist() == [r.r for r in rows]
    rng = np.random.default_rng(1)
    best, score = topk.Best(3, 4), rng.integers(0, 9, (3, 50)) / 8
    for at in range(0, 50, 7):
        q, i = np.divmod(np.arange(3 * len(score[0, at : at + 7])), len(score[0, at : at + 7]))
        best.add(q, i + at, score[:, at : at + 7].ravel())
        best.merge()
    assert best.id.tolist() == [i for row in score for i in sorted(range(50), key=lambda i: (-row[i], i))[:4]]


def test_lsh_counts_pairs_of_a_bucket_without_listing_them(spark):
    base = vectors.normalized(_odd_vectors(spark).filter("vec_id < 70")).select("doc_id", "v").localCheckpoint()
    asked = base.filter("doc_id IN (7, 8)").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = vectors.knn_lsh(base, asked, 50, radius=1.2)
    assert "Generate" not in got._jdf.queryExecution().toString()
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", numHashTables=8, bucketLength=0.8, seed=42)
    left, right = base.select("doc_id", array_to_vector("v").alias("x")), asked.select("query_id", array_to_vector("q").alias("x"))
    want = model.fit(left).approxSimilarityJoin(left, right, 1.2, "d").select("datasetB.query_id", "datasetA.doc_id", (1 - F.col("d") * F.col("d") / 2).alias("score"))
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score").collect())) == sorted(map(tuple, want.collect()))


def test_bm25_streams_what_it_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(80)] + [(80, None), (None, "w1 w2"), (None, "w1 w3"), (7, "w1 w1 w5"), (7, "w5 w1 w9"), (7, "w9")]
    docs = lexical.tokenized(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    asked = spark.createDataFrame([(i, [*rng.choice(words, 5), "w1", "w1"]) for i in range(6)] + [(6, []), (7, None), (8, ["none"])], "query_id long, tokens array<string>")
    plain = lambda df: sorted(repr((r.query_id, r.doc_id, round(r.score, 9))) for r in df.collect())
    ours, best = lexical.bm25(docs, asked), {k: lexical.bm25_topk(docs, asked, k) for k in (1, 5, 100)}
    unique = docs.filter("doc_id <> 7")
    assert "Exchange" not in lexical.bm25(unique, asked)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(lexical, "BROADCAST_PAIRS", 0)
    assert plain(ours) == plain(lexical.bm25(docs, asked)) != []
    for k, got in best.items():
        assert plain(got) == plain(lexical.bm25_topk(docs, asked, k))


def test_containing_streams_what_it_joins(spark, monkeypatch):
    docs = [(1, "one two three four five six seven eight nine"), (2, "xone two three four five six seveny"), (3, "a,b,c"), (4, None), (5, "é zebra-crossing here é"), (5, ""), (6, "a,b,c d")]
    items = [(1, "two three four five six seven"), (3, "b"), (4, "zebra-crossing"), (5, "e"), (5, "é"), (6, None), (7, ""), (8, "a,b,c"), (8, "three four five")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    ours = matching.containing(docs, items)
    assert "Join" not in ours._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, matching.containing(docs, items).collect())) != []


def test_hashes_of_tokens_equal_the_expressions(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "a"]), (1, []), (2, None), (3, ["é", "", "c"] * 50)], "i int, t array<string>")
    each = F.transform("t", lambda t: (tx.md5_number(t, 7) % 32).cast("int"))
    got = rows.select("i", hashed.md5_numbers(F.col("t"), 32).alias("n"), hashed.md5_counts(F.col("t"), 32).alias("c"), each.alias("want")).orderBy("i").collect()
    assert [r.n for r in got] == [r.want for r in got]
    assert [r.c for r in got] == [[None] * 32 if r.want is None else [float(r.want.count(b)) for b in range(32)] for r in got]


@pytest.mark.parametrize("text", ["HTTPServer2Go", "aB", "ABC", "a1B2c3D", "__x__Y1", "éÉaKKb İ", "", None])
def test_tokens_equal_the_rule_as_it_is_stated(spark, text):
    row = spark.createDataFrame([(text,)], "x string")
    apart = F.regexp_replace("x", "(?<=[a-z0-9])(?=[A-Z])", " ")
    want = F.transform(F.filter(F.split(apart, "[^A-Za-z0-9]+"), lambda x: x != ""), F.lower)
    got = row.select(tx.identifier_tokens(F.col("x")).alias("got"), want.alias("want")).first()
    assert got.got == got.want
