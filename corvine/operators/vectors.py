"""Exact and approximate vector search: numpy over Arrow buffers, queries broadcast, the base streamed past them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.vector import normalize, norm
from corvine.operators.ordering import ranked
from corvine.operators.topk import HELD, Best

#: Query rows that are broadcast at once, some 600 bytes each; more queries take more passes over the base.
QUERIES_AT_ONCE = 50_000
#: Pairs that are scored together, and rows sent back at once.
BLOCK = 500_000
WHOLE = ("tinyint", "smallint", "int", "bigint")
Batches = Iterator[pa.RecordBatch]


def normalized(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_).alias("doc_id"), normalize(F.col(embedding)).alias("v"), norm(F.col(embedding)).alias("norm"))


def by_size(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of components -> places of the arrays of so many, and these as a matrix. Arrays that are null or hold a null are left out."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    starts, size = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    empty = np.r_[0, np.cumsum(lists.values.is_null().to_numpy(zero_copy_only=False))]
    plain = lists.is_valid().to_numpy(zero_copy_only=False) & (empty[starts + size] == empty[starts])
    out = {}
    for n in np.unique(size[plain]):
        at = np.flatnonzero(plain & (size == n))
        out[int(n)] = at, flat[starts[at][:, None] + np.arange(n)]
    return out


def folded(terms: Callable[[int], np.ndarray], n: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``n`` terms from the first to the last, as a fold over the components adds them."""
    total = np.zeros(shape)
    for i in range(n):
        total += terms(i)
    return total


def parts(queries: DataFrame, n: int, most: int) -> list[DataFrame]:
    """The queries in parts of about ``most`` rows."""
    passes = max(1, -(-n // most))
    return [queries] if passes == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k) for k in range(passes)]


def together(many: list[DataFrame]) -> DataFrame:
    out = many[0]
    for one in many[1:]:
        out = out.unionByName(one)
    return out


def few_tasks(df: DataFrame) -> DataFrame:
    """In no more tasks than the cores take twice: each sends its own best on, so their number multiplies what is shuffled."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def scores(base: DataFrame, queries: DataFrame) -> DataFrame:
    """base (doc_id, v), queries (query_id, q), both normalised -> query_id, doc_id, score; null where a vector is null, holds a null or the sizes differ.

    The query set is stated by the caller: it is broadcast in parts of QUERIES_AT_ONCE rows at most, and
    the base streams past each part. Products are added from the first component to the last.
    """

    def one(part: DataFrame) -> DataFrame:
        asked = part.select("query_id", F.col("q").cast("array<double>")).toArrow()
        sent = part.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), by_size(asked.column("q"))))

        def run(batches: Batches) -> Batches:
            names, known = sent.value
            for batch in batches:
                for lo in range(0, batch.num_rows, step := max(1, BLOCK // max(1, len(names)))):
                    rows = batch.slice(lo, step)
                    out, found = np.zeros((rows.num_rows, len(names))), np.zeros((rows.num_rows, len(names)), bool)
                    for n, (at, v) in by_size(rows.column("v")).items():
                        if n in known:
                            to, q = known[n]
                            term, turned = np.empty((len(at), len(to))), np.ascontiguousarray(q.T)
                            out[np.ix_(at, to)] = folded(lambda i: np.multiply(v[:, i : i + 1], turned[i], out=term), n, term.shape)  # noqa: B023
                            found[np.ix_(at, to)] = True
                    ids = rows.column("doc_id").take(pa.array(np.repeat(np.arange(rows.num_rows), len(names))))
                    asked = pa.array(np.tile(np.arange(len(names)), rows.num_rows))
                    yield pa.RecordBatch.from_arrays([names.take(asked), ids, pa.array(out.ravel(), mask=None if found.all() else ~found.ravel())], names=["query_id", "doc_id", "score"])

        kind = dict(part.dtypes)["query_id"], dict(base.dtypes)["doc_id"]
        return base.select("doc_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"query_id {kind[0]}, doc_id {kind[1]}, score double")

    return together([one(part) for part in parts(queries, queries.count(), QUERIES_AT_ONCE)])


def knn(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank of the k nearest, ties by lower id; cut to k in each task before the shuffle.

    A task holds k rows for each query of a pass, HELD at most. Rows are weighed by one product of matrices;
    what can be among the best is scored as ``scores`` does.
    """
    order = [F.desc(F.round("score", 9)), F.col("doc_id")]
    if dict(base.dtypes)["doc_id"] not in WHOLE:
        return ranked(scores(base, queries), ["query_id"], order, k)
    rows = base.select("doc_id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    exact = lambda v, q, r, c: folded(lambda i: v[i][r] * q[i][c], len(v), r.shape)
    return ranked(_nearest(rows, asked, k, lambda v, q: v.T @ q, exact), ["query_id"], order, k)


def _nearest(base: DataFrame, queries: DataFrame, k: int, about: Callable, exact: Callable, agree: str = "") -> DataFrame:
    """base (doc_id, v), queries (query_id, q) -> query_id, doc_id, score: each task's k best of every query.

    ``about`` scores all rows and queries (a component in each row of a matrix) to better than the digits that
    are compared, ``exact`` the pairs of some. Pairs without a score come last. With ``agree``, a column of
    numbers on both sides, only pairs count that have one of these in common and a score that is a number.
    """

    def one(part: DataFrame) -> DataFrame:
        asked = part.toArrow()
        sides = {n: (at, np.ascontiguousarray(q.T)) for n, (at, q) in by_size(asked.column("q")).items()}
        marks = by_size(asked.column(agree)) if agree else {}
        sent = part.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), sides, marks))

        def run(batches: Batches) -> Batches:
            names, known, theirs = sent.value
            best, lowest, size = Best(len(names), k), np.iinfo(np.int64).min, np.full(len(names), -1)
            for n, (to, _) in known.items():
                size[to] = n
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64()).fill_null(lowest).to_numpy()
                own = by_size(batch.column(agree)) if agree else {}
                sized = by_size(batch.column("v"))
                for n in () if agree else (-1, *known):
                    short = np.flatnonzero((size == n) & np.isneginf(best.least))
                    apart = np.setdiff1d(np.arange(len(ids)), sized[n][0] if n in sized else [])
                    apart = apart[np.argsort(ids[apart], kind="stable")[:k]]
                    best.add(np.repeat(short, len(apart)), np.tile(ids[apart], len(short)), np.full(len(short) * len(apart), -np.inf))
                for n, (at, v) in sized.items():
                    if n not in known:
                        continue
                    (to, q), v = known[n], np.ascontiguousarray(v.T)
                    for lo in range(0, len(at), step := max(1, BLOCK // len(to))):
                        # Not below the floor: what is no number goes on.
                        r, c = np.nonzero(~(about(v[:, lo : lo + step], q) < best.floor()[to]))
                        r += lo
                        if agree:
                            met = np.zeros(len(r), bool)
                            for m in own:
                                if m in theirs:
                                    # All rows of a side have as many marks.
                                    for i in range(m):
                                        met |= own[m][1][at[r], i] == theirs[m][1][to[c], i]
                            r, c = r[met], c[met]
                        score = exact(v, q, r, c)
                        some = ~np.isnan(score) if agree else slice(None)
                        best.add(to[c[some]], ids[at[r[some]]], score[some])
            best.merge()
            for lo in range(0, len(best.id), BLOCK):
                q, i, s = (x[lo : lo + BLOCK] for x in (best.query, best.id, best.score))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(i, mask=i == lowest), pa.array(s, mask=np.isneginf(s))], names=["query_id", "doc_id", "score"])

        found = few_tasks(base).mapInArrow(run, f"query_id {dict(part.dtypes)['query_id']}, doc_id long, score double")
        return found.withColumn("doc_id", F.col("doc_id").cast(dict(base.dtypes)["doc_id"]))

    return together([one(part) for part in parts(queries, queries.count(), max(1, min(QUERIES_AT_ONCE, HELD // k)))])


def knn_lsh(base: DataFrame, queries: DataFrame, k: int, radius: float = 1.4, tables: int = 8, width: float = 0.8, seed: int = 42) -> DataFrame:
    """As ``knn`` over normalised vectors within Euclidean distance ``radius`` that share a random-projection bucket.

    Neighbours that share no bucket are missed; with a larger ``tables`` or ``width`` fewer are. Wide buckets
    hold most of the rows, so pairs are not listed by bucket: the base streams past the queries, and a pair
    counts if any of its buckets agree. Only each task's k best of a query are shuffled.
    """
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed)
    left = base.filter("v IS NOT NULL").select("doc_id", "v").distinct().withColumn("x", array_to_vector("v"))
    right = queries.filter("q IS NOT NULL").select("query_id", "q").distinct().withColumn("x", array_to_vector("q"))
    fitted = model.fit(base.filter("v IS NOT NULL").select(array_to_vector("v").alias("x")))
    buckets = F.array(*(vector_to_array(F.col("hashes")[i])[0] for i in range(tables))).alias("buckets")
    rows = fitted.transform(left).select("doc_id", F.col("v").cast("array<double>").alias("v"), buckets)
    asked = fitted.transform(right).select("query_id", F.col("q").cast("array<double>").alias("q"), buckets)

    def exact(v: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """By the distance as Spark adds it up; no number from the radius on."""
        d = np.sqrt(folded(lambda i: np.square(v[i][r] - q[i][c]), len(v), r.shape))
        return np.where(d < radius, 1 - d * d / 2, np.nan)

    about = lambda v, q: 1 - ((v * v).sum(0)[:, None] + (q * q).sum(0) - 2 * (v.T @ q)) / 2
    return ranked(_nearest(rows, asked, k, about, exact, "buckets"), ["query_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], k)


def mean_pool(rows: DataFrame, by: str, v: str) -> DataFrame:
    """by, pos, mean of each component over the group's vectors; summed before the shuffle."""
    return rows.select(by, F.posexplode(v).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
