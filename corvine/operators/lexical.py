"""BM25 over an inverted index of identifier tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.session import cut
from corvine.functions.text import identifier_tokens
from corvine.operators.ordering import ranked
from corvine.operators.topk import HELD, Best
from corvine.operators.vectors import BLOCK, WHOLE, few_tasks

K1, B = 1.5, 0.75
#: Query terms, and pairs of query and term, broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS, BROADCAST_PAIRS = 200_000, 2_000_000


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), identifier_tokens(F.col(text)).alias("tokens"))


def term_freq(tokens: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """by, term, tf: counted before the shuffle."""
    return tokens.select(*by, F.explode("tokens").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))


def doc_stats(tokens: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents, tokens and mean length, of all or of each pool."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avg_len"))


def idf_of(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1.0), F.lit(1e-6))


def idf(tokens: DataFrame) -> DataFrame:
    """term, df, idf of every term."""
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(doc_stats(tokens).select("n_docs"))).select("term", "df", idf_of(F.col("n_docs"), F.col("df")).alias("idf"))


def weight(tf: Column, idf_: Column, size: Column, mean: Column, times: Column) -> Column:
    return times * idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / F.greatest(mean, F.lit(1e-9))))


def bm25(tokens: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """tokens (doc_id, tokens), queries (query_id, tokens) -> query_id, doc_id, score of documents that share a term.

    A term repeated in a query adds again. Only the postings of query terms are built. With ``k`` a row may
    be missing if k others of its query come before it by rounded score and id.
    """
    asked = cut(queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    terms = cut(asked.select("term").distinct())
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few and asked.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        return _streamed(tokens, asked, terms, k)
    every = tokens.select("doc_id", F.size("tokens").alias("size"), F.explode("tokens").alias("term"))
    postings = every.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))
    # Counted for the document frequencies and read again for the scores.
    postings = cut(postings)
    known = _known(postings.groupBy("term").agg(F.count("*").alias("df")), doc_stats(tokens))
    return (
        postings.join(asked.join(known, "term"), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(weight(F.col("tf"), F.col("idf"), F.col("size"), F.col("avg_len"), F.col("times"))).alias("score"))
    )


def _known(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df -> term, idf, avg_len."""
    stats = F.broadcast(stats.select("n_docs", "avg_len"))  # one row
    return df.crossJoin(stats).select("term", idf_of(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")


def posted(tokens: DataFrame, terms: pa.Array) -> DataFrame:
    """tokens (doc_id, tokens) -> doc_id, size, and the places in ``terms`` of the document's terms with how often it has each.

    One row for each input row, nothing is shuffled.
    """
    sent = tokens.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            lo = offsets[0]
            found = pc.index_in(lists.values.slice(lo, offsets[-1] - lo), value_set=sent.value)
            held = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            doc = np.searchsorted(offsets, held + lo, side="right") - 1
            pair, tf = np.unique(doc * len(sent.value) + found.drop_null().to_numpy(), return_counts=True)
            doc, term = np.divmod(pair, max(1, len(sent.value)))
            cuts = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(cuts, pa.array(c.astype(np.int32))) for c in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), *columns], names=["doc_id", "size", "terms", "tfs"])

    rows = tokens.select("doc_id", F.size("tokens").alias("size"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return rows.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, size int, terms array<int>, tfs array<int>")


def _streamed(tokens: DataFrame, asked: DataFrame, terms: DataFrame, k: int | None) -> DataFrame:
    """``bm25`` with the queries broadcast: documents stream past them, first to count, then to score.

    Rows that share an id and a length are one document, and scores of an id's lengths add up: these few are
    put together by a shuffle, all others go on as they are.
    """
    context = tokens.sparkSession.sparkContext
    names = terms.toArrow().column("term").combine_chunks().cast(pa.string())
    rows = cut(posted(tokens, names))
    stats = cut(rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_len")))
    again = cut(rows.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")))
    single, several = rows, None
    if again.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        single = rows.join(again, same, "left_anti")
        each = rows.join(again, same, "left_semi").select("doc_id", "size", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
        each = each.groupBy("doc_id", "size", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").cast("int").alias("tf"))
        several = cut(each.groupBy("doc_id", "size").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")))
    df = (single if several is None else single.unionByName(several)).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    known = _known(df, stats).toArrow()
    idf_ = np.zeros(len(names))
    idf_[known.column("term").to_numpy()] = known.column("idf").to_numpy()
    mean = float(stats.first().avg_len)
    ask = asked.toArrow()
    ids = pa.table({"q": ask.column("query_id")}).group_by("q").aggregate([]).column("q").combine_chunks()
    place = (np.zeros(0, np.int64) if not len(ids) else pc.index_in(ask.column("query_id"), value_set=ids).to_numpy()).astype(np.int64)
    term = pc.index_in(ask.column("term").cast(pa.string()), value_set=names).to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))
    # For each term its queries and their share of the weight.
    part = ask.column("times").to_numpy()[order] * idf_[term[order]]
    sent = context.broadcast((ids, starts, place[order], part))
    kind = dict(asked.dtypes)["query_id"], dict(tokens.dtypes)["doc_id"]
    best_of = k is not None and kind[1] in WHOLE and len(ids) * k <= HELD

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows of some documents with their scores for every query, 0 without a shared term."""
        ids, starts, place, part = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, step := max(1, BLOCK // max(1, len(ids)))):
                batch = whole.slice(lo, step)
                offsets = batch.column("terms").offsets.to_numpy()
                term = batch.column("terms").values.to_numpy()[offsets[0] : offsets[-1]]
                offsets_ = batch.column("tfs").offsets.to_numpy()
                tf = batch.column("tfs").values.to_numpy()[offsets_[0] : offsets_[-1]].astype(np.float64)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.float64)[doc]
                factor = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1e-9)))
                many = starts[term + 1] - starts[term]
                ends = np.cumsum(many)
                total = np.zeros(batch.num_rows * len(ids))
                # Postings go to all queries of their term, so many together.
                at = 0
                while at < len(term):
                    upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * BLOCK)))
                    n = many[at:upto]
                    to = np.repeat(starts[term[at:upto]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    total += np.bincount(np.repeat(doc[at:upto] * len(ids), n) + place[to], part[to] * np.repeat(factor[at:upto], n), len(total))
                    at = upto
                yield batch, total.reshape(batch.num_rows, len(ids))

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches):
            d, q = np.nonzero(score)
            yield pa.RecordBatch.from_arrays([sent.value[0].take(pa.array(q)), batch.column("doc_id").take(pa.array(d)), pa.array(score[d, q])], names=["query_id", "doc_id", "score"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lowest = sent.value[0], np.iinfo(np.int64).min
        kept = Best(len(names), k)
        for batch, score in scored(batches):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(lowest).to_numpy()
            d, q = np.nonzero((score > 0) & (score >= kept.floor()))
            kept.add(q, ids[d], score[d, q])
        kept.merge()
        for lo in range(0, len(kept.id), BLOCK):
            q, i, x = (c[lo : lo + BLOCK] for c in (kept.query, kept.id, kept.score))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i, mask=i == lowest), pa.array(x)], names=["query_id", "doc_id", "score"])

    shape = f"query_id {kind[0]}, doc_id {{}}, score double"
    if best_of:
        out = few_tasks(single).mapInArrow(best, shape.format("long")).withColumn("doc_id", F.col("doc_id").cast(kind[1]))
    else:
        out = single.mapInArrow(all_of, shape.format(kind[1]))
    if several is not None:
        out = out.unionByName(several.mapInArrow(all_of, shape.format(kind[1])).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")))
    return out


def bm25_topk(tokens: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k best, ties and documents without a shared term by lower id.

    A query with under k scored documents is filled up from the k lowest ids; more can't be needed.
    """
    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    best = cut(ranked(bm25(tokens, queries, k), ["query_id"], order, k))
    short = cut(queries.select("query_id").join(best.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti"))
    if not short.limit(1).count():
        return best
    lowest = tokens.select("doc_id").orderBy("doc_id").limit(k)
    fill = short.crossJoin(F.broadcast(lowest)).join(best, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    more = ranked(best.drop("rank").join(short, "query_id", "left_semi").unionByName(fill), ["query_id"], order, k)
    return best.join(short, "query_id", "left_anti").unionByName(more)


def bm25_in_pools(pool: DataFrame, tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """pool (query_id, doc_id, ...) -> its rows with score; document counts and lengths are those of each pool."""
    # Only the texts of the pools are cut into tokens, once.
    local = cut(pool.join(tokens.join(pool.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id"))
    stats = doc_stats(local, ("query_id",)).select("query_id", "n_docs", "avg_len")
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = local.select("query_id", "doc_id", F.size("tokens").alias("size"), F.explode("tokens").alias("term")).join(asked, ["query_id", "term"]).groupBy("query_id", "doc_id", "size", "term", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    known = df.join(stats, "query_id").select("query_id", "term", idf_of(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")
    scores = tf.join(known, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(weight(F.col("tf"), F.col("idf"), F.col("size"), F.col("avg_len"), F.col("times"))).alias("score"))
    return pool.join(scores, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
