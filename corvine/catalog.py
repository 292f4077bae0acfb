"""The registered queries over the reference's operators, on the driver's tables.

documents stand for the corpus (path: source/lang/doc_id; kind: lang), benchmark for questions,
embeddings for the vector index; a question's vector is that of the embedding with its item_id, and a
document's that with its doc_id. Vector searches ask with every vec_id divisible by 100.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.catalog_sql import ORACLES
from corvine.functions import text as tx
from corvine.functions import vector as vec
from corvine.functions.hashed import md5_numbers
from corvine.functions.session import cut, shared_folder, small
from corvine.operators import chunking, csource, evaluation, fusion, lexical, losses, matching, mining, ordering, tokens, vectors
from corvine.plans import corpus, rag, search
from corvine.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MARK = "Re"  # documents hold no #define: lines with this beginning stand for them, with lower limits
DENSITY, LINES, WINDOW, STRIDE, BATCH, TOKENS = 0.1, 3, 6, 4, 16, 128


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Read once by each query: BM25 keeps the postings of query terms, not all tokens."""
    return lexical.tokenized(_docs(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return cut(_bench(spark, d).select(F.col("item_id").alias("query_id"), tx.identifier_tokens(F.col("text")).alias("tokens")))


def _base(spark: SparkSession, d: str) -> DataFrame:
    return cut(vectors.normalized(_vectors(spark, d)))


def _hundredth(base: DataFrame) -> DataFrame:
    return base.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))


def _dense(spark: SparkSession, d: str, pool: int) -> DataFrame:
    """Questions against documents that have a vector."""
    base = _base(spark, d)
    docs = base.join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    asked = base.join(_bench(spark, d).select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return cut(vectors.knn(docs, asked, pool))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """item_id, doc_id: the lowest document that holds a passage as it stands."""
    held = matching.containing(_docs(spark, d), _bench(spark, d).select("item_id", F.col("text").alias("passage")))
    return cut(held.groupBy("item_id").agg(F.min("doc_id").alias("doc_id")))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# Lexical retrieval


@query
def identifier_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.identifier_tokens(F.col("text"))).alias("n_tokens"), F.array_join(tx.identifier_tokens(F.col("text")), " ").alias("tokens"))


@query
def term_freq(spark, d):
    return lexical.term_freq(_tokens(spark, d))


@query
def doc_stats(spark, d):
    return lexical.doc_stats(_tokens(spark, d)).select("n_docs", "n_tokens", _r("avg_len"))


@query
def idf(spark, d):
    return lexical.idf(cut(_tokens(spark, d))).select("term", "df", _r("idf"))


@query
def bm25_scores(spark, d):
    return lexical.bm25(_tokens(spark, d), _asked(spark, d)).select("query_id", "doc_id", _r("score"))


@query
def bm25_topk(spark, d):
    return lexical.bm25_topk(_tokens(spark, d), _asked(spark, d), 10).select("query_id", "rank", "doc_id", _r("score"))


# Vector retrieval


@query
def l2_normalize(spark, d):
    return _base(spark, d).select(F.col("doc_id").alias("vec_id"), F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", _r("x"))


@query
def cosine_scores(spark, d):
    base = _base(spark, d)
    return vectors.scores(base, _hundredth(base)).select("query_id", "doc_id", _r("score"))


@query
def cosine_distance(spark, d):
    base = _base(spark, d)
    return vectors.scores(base, _hundredth(base)).select("query_id", "doc_id", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"))


@query
def knn_topk(spark, d):
    base = _base(spark, d)
    return vectors.knn(base, _hundredth(base), 10).select("query_id", "rank", "doc_id", _r("score"))


@query
def knn_with_metadata(spark, d):
    base = _base(spark, d)
    hits = vectors.knn(base, _hundredth(base), 10)
    return hits.join(_vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").select("query_id", "rank", "doc_id", "label", _r("score"))


@query
def topk_global(spark, d):
    return _docs(spark, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query
def topk_per_query(spark, d):
    return ordering.ranked(_docs(spark, d).select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query
def mean_pool(spark, d):
    return vectors.mean_pool(_vectors(spark, d), "label", "embedding").select("label", "pos", _r("mean"))


@query
def quantize_int8(spark, d):
    rows = _vectors(spark, d).select("vec_id", vec.quantize(F.col("embedding")).alias("z"))
    return rows.select("vec_id", F.round("z.scale", 9).alias("scale"), F.array_join(F.col("z.codes").cast("array<string>"), ",").alias("codes"))


@query
def knn_lsh(spark, d):
    base = _base(spark, d)
    return vectors.knn_lsh(base, _hundredth(base), 10).select("query_id", "rank", "doc_id", _r("score"))


def _index(spark, d):
    docs = _docs(spark, d)
    return docs.select(F.col("doc_id").alias("chunk_id"), "path", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("kind"), F.lit(1).alias("line"), F.col("text").alias("code"), search.hashed_vector(F.col("text")).alias("embedding"))


def _questions(spark, d):
    return cut(_bench(spark, d).select(F.col("item_id").alias("query_id"), "text", search.hashed_vector(F.col("text")).alias("embedding")))


@query
def search_dense(spark, d):
    return search.search(_index(spark, d), _questions(spark, d), 10, "dense").select("query_id", "rank", "chunk_id", "path", "snippet", _r("score"))


@query
def search_hybrid(spark, d):
    return search.search(_index(spark, d), _questions(spark, d), 10, "hybrid").select("query_id", "rank", "chunk_id", "path", "snippet", _r("score"))


@query
def search_rerank(spark, d):
    return search.search(_index(spark, d), _questions(spark, d), 10, "rerank").select("query_id", "rank", "chunk_id", "path", "snippet", _r("score"))


# Fusion


@query
def rrf(spark, d):
    docs = _docs(spark, d).select(F.col("lang").alias("query_id"), "doc_id", "n_chars", F.size(tx.lines(F.col("text"))).alias("n_lines"))
    one = ordering.ranked(docs, ["query_id"], [F.desc("n_chars"), F.col("doc_id")], 100)
    two = ordering.ranked(docs, ["query_id"], [F.desc("n_lines"), F.col("doc_id")], 100)
    return fusion.rrf([one, two]).select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"))


@query
def hybrid_independent(spark, d):
    return fusion.hybrid_independent(_dense(spark, d, 200), _tokens(spark, d), _asked(spark, d), 10).select("query_id", "rank", "doc_id", F.round("rrf", 9).alias("rrf"))


@query
def hybrid_rerank(spark, d):
    return fusion.hybrid_rerank(_dense(spark, d, 200), _tokens(spark, d), _asked(spark, d), 10).select("query_id", "rank", "doc_id", F.round("rrf", 9).alias("rrf"))


# Evaluation


@query
def gold_lookup(spark, d):
    return _gold(spark, d).join(_docs(spark, d).select("doc_id", "path"), "doc_id").select("item_id", "doc_id", "path")


@query
def resolvable_queries(spark, d):
    return _bench(spark, d).join(_gold(spark, d), "item_id", "left_semi").orderBy("item_id").limit(400).select("item_id", F.length("text").alias("n"))


@query
def eval_corpus_layout(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    first = turns.filter("turn = 0").select("conv_id", F.col("text").alias("positive"))
    second = turns.filter("turn = 1").select("conv_id", F.col("text").alias("negative"))
    placed = ordering.placed(first.join(second, "conv_id"), [F.col("conv_id"), F.md5("positive"), F.md5("negative")])
    return placed.select(F.concat(F.lit("q"), F.col("pos")).alias("query_id"), F.stack(F.lit(2), F.lit("p"), 2 * F.col("pos"), F.md5("positive"), F.lit("n"), 2 * F.col("pos") + 1, F.md5("negative")).alias("side", "doc", "digest"))


def _closed_ranks(spark, d):
    ranking = cut(lexical.bm25_topk(_tokens(spark, d), _asked(spark, d), 10))
    return cut(evaluation.gold_ranks(ranking, _gold(spark, d).withColumnRenamed("item_id", "query_id")))


@query
def ir_metrics_closed(spark, d):
    m = evaluation.closed(_closed_ranks(spark, d))
    return m.select(*(_r(c) for c in m.columns))


def _label_ranks(spark, d, k):
    """For each query vector the rank of the nearest other vector of its label."""
    base = _base(spark, d)
    labels = _vectors(spark, d).select("vec_id", "label")
    hits = vectors.knn(base, _hundredth(base), k + 1).filter("query_id <> doc_id")
    hits = ordering.ranked(hits.drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    good = hits.join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(own, "query_id").filter("label = wanted").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return cut(_hundredth(base).select("query_id").join(good, "query_id", "left"))


@query
def ir_metrics_dense(spark, d):
    m = evaluation.closed(_label_ranks(spark, d, 10))
    return m.select(*(_r(c) for c in m.columns))


@query
def ir_metrics_open(spark, d):
    m = evaluation.open_corpus(_label_ranks(spark, d, 500))
    return m.select(*(_r(c) if c != "median_rank" else c for c in m.columns))


@query
def metric_filter(spark, d):
    keys = F.concat("source", F.lit("_"), F.col("lang"), F.lit("_"), F.element_at(F.array(*(F.lit(m) for m in ("Accuracy@1", "MRR@10", "loss", "recall@100", "NDCG@10", "steps"))), (F.col("doc_id") % 6 + 1).cast("int")))
    scores = _docs(spark, d).select(keys.alias("key"), F.col("n_chars").alias("value")).filter(tx.is_reported(F.col("key")))
    return evaluation.picked(scores.groupBy("key").agg(F.max("value").alias("value")))


@query
def rag_ask(spark, d):
    asked = rag.ask(_index(spark, d), _questions(spark, d), 10, "rerank")
    return asked.select("query_id", "n_blocks", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query
def metric_pivot(spark, d):
    bm25 = evaluation.long(evaluation.closed(_closed_ranks(spark, d)), "bm25")
    dense = evaluation.long(evaluation.closed(_label_ranks(spark, d, 10)), "dense")
    m = evaluation.compare([bm25, dense], ["bm25", "dense"])
    return m.select("metric", _r("bm25"), _r("dense"), _r("delta"))


# Corpus


@query
def line_density(spark, d):
    x = tx.line_density(F.col("text"), MARK)
    return _docs(spark, d).select("doc_id", F.round(x["ratio"], 9).alias("ratio"), x["n"].alias("n"))


@query
def drop_generated(spark, d):
    return _docs(spark, d).filter(~corpus.generated(F.col("text"), MARK, DENSITY, LINES)).select("doc_id")


def _judged(spark, d):
    docs = _docs(spark, d)
    state = corpus.disposition(F.col("text").isNull(), F.octet_length("text"), F.col("text").cast("binary"), F.col("text"), max_bytes=10_000, prefix=MARK, density=DENSITY, least=LINES)
    return docs.select("doc_id", "text", state.alias("disposition"))


@query
def corpus_disposition(spark, d):
    return _judged(spark, d).select("doc_id", "disposition")


@query
def corpus_summary(spark, d):
    return corpus.summary(_judged(spark, d))


@query
def min_length_filter(spark, d):
    return _docs(spark, d).filter(F.length("text") >= 60).select("doc_id", F.length("text").alias("n"))


@query
def kind_counts(spark, d):
    return _docs(spark, d).groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


@query
def subsystem_key(spark, d):
    return _docs(spark, d).select("doc_id", tx.subsystem(F.col("path")).alias("subsystem"))


@query
def snippet(spark, d):
    return _docs(spark, d).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query
def val_span(spark, d):
    return _docs(spark, d).filter(tx.in_validation(F.col("path"), 0.1)).select(F.split("path", "/")[0].alias("top")).distinct().orderBy("top")


@query
def load_documents(spark, d):
    rows = _docs(spark, d).select(F.col("source").alias("path"), F.md5(F.lower("text")).alias("name"), F.col("text").alias("positive"), "doc_id")
    return files.load_documents(rows, "doc_id").select("path", "name", "kind", "line", F.md5("code").alias("code_md5"))


@query
def index_info(spark, d):
    return files.index_info(_vectors(spark, d))


@query
def dedup_prefix(spark, d):
    return mining.dedup_anchors(_docs(spark, d), "text", [F.col("doc_id")]).select("doc_id")


@query
def hash_split_md5(spark, d):
    return _docs(spark, d).select("doc_id", tx.in_validation(F.col("path"), 0.01).alias("val"))


@query
def hash_split_blake2b(spark, d):
    return _docs(spark, d).select("doc_id", mining.blake2b_split(F.col("path"), 0.01).alias("val"))


@query
def split_summary(spark, d):
    rows = _docs(spark, d).select(tx.in_validation(F.col("path"), 0.1).alias("val"), "source", "n_chars")
    return rows.groupBy("val").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_top"), F.sum("n_chars").alias("chars"))


@query
def positional_split(spark, d):
    return mining.positional_split(_docs(spark, d).select("doc_id"), [mining.seeded(42, "doc_id"), F.col("doc_id")], 200).select("doc_id", "pos", "held_out")


@query
def seeded_shuffle(spark, d):
    return ordering.placed(_docs(spark, d).select("doc_id"), [mining.seeded(7, "doc_id"), F.col("doc_id")]).select("doc_id", "pos")


# Chunks and context


@query
def window_chunks(spark, d):
    w = chunking.window_chunks(_docs(spark, d).select("path", "text"), WINDOW, STRIDE)
    return w.select("path", "name", "kind", "line", F.md5("code").alias("code_md5"))


@query
def truncate_lines(spark, d):
    cut_ = F.substring(tx.head_lines(F.col("text"), 8), 1, 6000)
    return _docs(spark, d).select("doc_id", F.length(cut_).alias("n"), F.md5(cut_).alias("digest"))


def _hits(spark, d):
    best = lexical.bm25_topk(_tokens(spark, d), _asked(spark, d), 8)
    rows = small(best).join(_docs(spark, d), "doc_id").select("query_id", "rank", "path", F.lit(1).alias("line"), F.col("lang").alias("kind"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("code"))
    return rows.select("query_id", "rank", rag.excerpt().alias("block"))


@query
def context_budget(spark, d):
    return rag.within_budget(_hits(spark, d)).select("query_id", "rank", "used")


@query
def rag_prompt(spark, d):
    asked = _bench(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return rag.prompt(rag.context(_hits(spark, d)), asked, "Answer from the excerpts alone.").select("query_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


# Training data


@query
def hard_negatives(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("i"), F.concat_ws("/", "source", "lang").alias("path"), F.substring("text", 1, 20).alias("name"), F.col("text").alias("positive"))
    return mining.hard_negatives(rows).select("i", "j", "tier", F.md5("negative").alias("negative_md5"))


@query
def grouped_batches(spark, d):
    return mining.grouped_batches(_docs(spark, d).select(F.col("doc_id").alias("i"), tx.subsystem(F.col("path")).alias("g")), "g", BATCH)


@query
def distinct_batches(spark, d):
    return mining.distinct_batches(_docs(spark, d).select(F.col("doc_id").alias("i"), "text"), "text", BATCH)


def _scores(spark, d):
    """Anchor 2n, positive 2n + 1, in batches of 16 pairs; the guide sees the first half of the dimensions."""
    v = _base(spark, d).select(F.col("doc_id").alias("id"), "v", vec.normalize(F.slice("v", 1, 32)).alias("g"))
    n = F.floor(F.col("id") / 2)
    rows = v.withColumn("i", n).withColumn("batch", F.floor(n / 16))
    anchors = rows.filter("id % 2 = 0").select("batch", "i", F.col("v").alias("a"), F.col("g").alias("ga"))
    others = rows.filter("id % 2 = 1").select("batch", F.col("i").alias("j"), F.col("v").alias("c"), F.col("g").alias("gc"))
    return cut(losses.pair_scores(anchors, others))


@query
def infonce(spark, d):
    return losses.infonce(_scores(spark, d).select("batch", "i", "j", "s")).select(_r("loss"))


@query
def infonce_hard(spark, d):
    """The negative of anchor n is the vector 2n + 3, at the end of a batch its own positive."""
    v = _base(spark, d).select(F.col("doc_id").alias("id"), "v").withColumn("i", F.floor(F.col("id") / 2)).withColumn("batch", F.floor(F.col("i") / 16))
    positives = v.filter("id % 2 = 1").select("batch", "i", F.col("v").alias("c"))
    negatives = positives.select("batch", (F.col("i") - 1).alias("i"), "c").filter(F.floor(F.col("i") / 16) == F.col("batch"))
    scores = losses.pair_scores(v.filter("id % 2 = 0").select("batch", "i", F.col("v").alias("a")), losses.candidates(positives, negatives))
    return losses.infonce(scores).select(F.round(losses.accumulated(F.col("loss"), 4), 6).alias("loss"))


@query
def gist_loss(spark, d):
    return losses.total(_scores(spark, d)).select(_r("infonce"), _r("gist"), _r("total"))


@query
def perplexity(spark, d):
    return losses.perplexity(_docs(spark, d).select((F.col("n_chars") % 97 / 100).alias("loss"))).select(_r("loss"), _r("perplexity"))


@query
def vocab_equality(spark, d):
    def words(source):
        rows = _docs(spark, d).filter(F.col("source") == source).select(F.explode(tx.identifier_tokens(F.col("text"))).alias("token")).distinct()
        return rows.withColumn("id", tx.md5_number(F.col("token"), 7))

    return losses.same_vocabulary(words("src0"), words("src1"))


def _packed(spark, d):
    ids = F.transform(md5_numbers(tx.identifier_tokens(F.col("text")), 32_763), lambda x: x + 5)
    return tokens.pack_offsets(_docs(spark, d).select("doc_id", ids.alias("ids")), [F.col("doc_id")])


@query
def pack_offsets(spark, d):
    return _packed(spark, d).select("doc_id", F.size("ids").alias("n"), "start")


def _as_text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query
def token_windows(spark, d):
    w = tokens.token_windows(_packed(spark, d), TOKENS)
    return w.select("window", F.size(F.filter(tokens.special_mask(F.col("ids")), lambda x: x)).alias("n_special"), _as_text("ids"))


@query
def mlm_mask(spark, d):
    return tokens.mlm_mask(tokens.token_windows(_packed(spark, d), TOKENS)).select("window", _as_text("input_ids"), _as_text("labels"))


@query
def linspace_sample(spark, d):
    w = cut(tokens.token_windows(_packed(spark, d), TOKENS).select("window", F.element_at("ids", 1).alias("first_id")))
    at = spark.createDataFrame([(i,) for i in sorted(set(ordering.evenly_spaced(w.count(), 64)))], "window long")
    return w.join(F.broadcast(at), "window")


@query
def pretoken_counts(spark, d):
    return tokens.pretoken_counts(_docs(spark, d))


@query
def bpe_merges(spark, d):
    merges = tokens.train_bpe(tokens.pretoken_counts(_docs(spark, d)))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query
def encode_docs(spark, d):
    docs = _docs(spark, d)
    encode = tokens.encoder(tokens.train_bpe(tokens.pretoken_counts(docs)))
    return docs.select("doc_id", F.concat(encode(F.col("text")), F.array(F.lit(tokens.SEP))).alias("ids")).select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


# C sources: the tables hold none, so documents are dressed as such, in four forms by doc_id

C_FORMS = {
    0: "/**\n * fn{id} - {words}\n * @a: value number {n}\n */\nstatic int fn{id}(int a)\n{{\n\treturn a + {n};\n}}\n",
    1: "int proto{id}(int a);\n\n// {words}\nstruct pair *\nmake{id}(struct pair *p)\n{{\n\tchar *s = \"}}\";\n\treturn p; /* }} */\n}}\n",
    2: "{words}\n{words}\n\n",
    3: "typedef struct node{id} {{\n\tint x;\n\tchar c;\n}} node{id}_t;\n#define F{id}(x) {{ x }}\n",
}


def _c_corpus(spark, d):
    words = F.trim(F.substring(F.regexp_replace("text", "[^a-z]+", " "), 1, 60))
    form = F.lit("")
    for k, body in C_FORMS.items():
        whole = F.lit(body.format(id="<id>", words="<words>", n="<n>"))
        for name, value in (("<id>", F.col("doc_id").cast("string")), ("<words>", words), ("<n>", F.col("n_chars").cast("string"))):
            whole = F.replace(whole, F.lit(name), value)
        form = F.when(F.col("doc_id") % 4 == k, whole).otherwise(form)
    return _docs(spark, d).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".c")).alias("path"), form.alias("text"))


#: Files for the scan of a tree, which only a file system holds.
C_SOURCES = {
    "lib/ring.c": "int ring_push(struct ring *r, int x)\n{\n\treturn 0;\n}\n",
    "lib/_hidden.h": "struct ring {\n\tint n;\n};\n",
    "lib/table.h": "".join(f"#define VALUE_{i} {i}\n" for i in range(500)),
    "lib/table_short.h": "".join(f"#define VALUE_{i} {i}\n" for i in range(499)),
    "lib/nul.c": "int x;\n\0\n",
    "lib/empty.c": "",
    "lib/notes.txt": "not a source\n",
    ".git/a.c": "int skipped;\n",
}


def _tree(spark):
    """The sources as files in the folder all executors share, which must be mounted: a tree is scanned where it lies."""
    shared = re.sub("^file:/*", "/", shared_folder(spark))
    if not os.path.isdir(shared):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"no mounted folder {shared}")
        shared = None
    root = tempfile.mkdtemp(prefix="tree-", dir=shared)
    for name, body in C_SOURCES.items():
        Path(root, name).parent.mkdir(parents=True, exist_ok=True)
        Path(root, name).write_text(body)
    os.chmod(root, 0o755)
    return root


@query
def scan_tree(spark, d):
    return corpus.judged(files.scan_tree(spark, _tree(spark))).select("path", "disposition", "length")


@query
def extract_definitions(spark, d):
    return csource.extract_definitions(_c_corpus(spark, d))


@query
def kdoc_mine(spark, d):
    return csource.mine_pairs(_c_corpus(spark, d))


@query
def chunk_with_fallback(spark, d):
    return chunking.chunk(_c_corpus(spark, d))


