"""Approximate nearest neighbours: cross-polytope hashing, multiprobe tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.tables import cut, frequent, spread_join

TABLES = 8
#: Probes for each table are the fewest that find this share of the true neighbours in a sample of SAMPLE rows and
#: ASKED of them as queries. A sample's neighbours are farther than those among all rows, so the share is then higher.
RECALL, SAMPLE, ASKED = 0.95, 4096, 128
#: Share by which lengths of unit vectors in single precision differ.
ROUNDING = 1e-6
#: Buckets broadcast at most, some 20 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of either side that one task compares at once, and comparisons that a shuffled probe costs about.
BLOCK, PROBE = 4096, 500


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation: three times random signs, then the fast Hadamard transform. Width is a power of two."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        step = 1
        while step < d:
            pairs = x.reshape(n, d // (2 * step), 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        x = x / np.sqrt(d)
    return x


def buckets(x: np.ndarray, table: int, probes: int, polytopes: int = 1) -> np.ndarray:
    """The nearest buckets of each row, nearest first: (rows, probes).

    A bucket is a signed axis of each of ``polytopes`` rotations, axis i or d + i for its negative; of several
    buckets those whose axes the row leans to most in sum are nearest.
    """
    ys = [rotate(x, 1000 + table + 997 * k) for k in range(polytopes)]
    ys = [np.concatenate([y, -y], axis=1) for y in ys]
    axes = ys[0].shape[1]
    probes = min(probes, axes**polytopes)

    def nearest(sums: np.ndarray, k: int) -> np.ndarray:
        near = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(sums, near, 1), axis=1, kind="stable"), 1)

    out = nearest(ys[0], min(probes, axes))
    lean = np.take_along_axis(ys[0], out, 1)
    for y in ys[1:]:
        # One of the best ``probes`` has no axis that is not among the best so many of its own polytope.
        near = nearest(y, min(probes, axes))
        more, rows = [], max(1, 1_000_000 // (out.shape[1] * near.shape[1]))
        for at in range(0, len(x), rows):
            part = slice(at, at + rows)
            sums = (lean[part, :, None] + np.take_along_axis(y[part], near[part], 1)[:, None, :]).reshape(len(lean[part]), -1)
            best = nearest(sums, min(probes, sums.shape[1]))
            named = (out[part, :, None] * axes + near[part][:, None, :]).reshape(len(sums), -1)
            more.append((np.take_along_axis(named, best, 1), np.take_along_axis(sums, best, 1)))
        out, lean = (np.concatenate(c) for c in zip(*more, strict=True))
    return out


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Rows on the unit sphere of a power of two dimensions, so that their angle follows the inner product.

    A base vector gets a component that fills it up to the longest ``norm``, and a query 0 there. ``norm``
    is 0 where all lengths agree within ROUNDING: then an inner product is off its angle's by that share
    at most, about its rounding in single precision, and no component is needed.
    """
    d = x.shape[1]
    length = np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros((len(x), 1 << max(0, (d + 1 if norm else d) - 1).bit_length()))
    out[:, :d] = x / norm if norm and not query else x / length
    if norm and not query:
        out[:, d] = np.sqrt(np.maximum(0, 1 - (length[:, 0] / norm) ** 2))
    return out


def fit_probes(sample: np.ndarray, norm: float, k: int, rows: int, tables: int = TABLES) -> tuple[int, int]:
    """(polytopes, probes): for each count of polytopes the fewest probes of a table that reach RECALL on the sample, and of these the cheapest.

    The sample's rows are compared with each other here. One polytope is enough until its buckets, of
    ``rows`` in all, hold more than BLOCK. A probe costs a shuffled row, about as much as PROBE comparisons.
    """
    asked = sample[:ASKED]
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1, 1
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    true = np.argsort(-near, axis=1, kind="stable")[:, :k]
    base, query = lifted(sample, norm, False), lifted(asked, norm, True)
    axes = 2 * base.shape[1]
    best = None
    for polytopes in range(1, 3 if rows > BLOCK * axes else 2):
        every = axes**polytopes
        needed = np.full(true.shape, every)
        for t in range(tables):
            own = buckets(base, t, 1, polytopes)[:, 0]
            order = buckets(query, t, every, polytopes)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(every)[None, :].repeat(len(order), 0), 1)
            needed = np.minimum(needed, 1 + np.take_along_axis(place, own[true], 1))
        probes = int(np.sort(needed, axis=None)[min(needed.size - 1, int(np.ceil(RECALL * needed.size)))])
        cost = probes * (PROBE + rows / every)
        if best is None or cost < best[0]:
            best = cost, polytopes, probes
    return best[1:]


def usable(vectors: DataFrame, width: int) -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == width) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _hashed(rows: DataFrame, width: int, norm: float, tables: int, probes: int, polytopes: int, query: bool) -> DataFrame:
    """id, embedding -> id, embedding, t, b: a row for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = lifted(_matrix(batch.column("embedding"), width), norm, query)
                for t in range(tables):
                    b = buckets(x, t, probes, polytopes)
                    take = pa.array(np.repeat(np.arange(len(x)), b.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("id", "embedding")), pa.array(np.full(b.size, t, np.int32)), pa.array(b.ravel().astype(np.int64))], names=["id", "embedding", "t", "b"])

    return rows.mapInArrow(run, f"id long, embedding {dict(rows.dtypes)['embedding']}, t int, b long")


def _closest(base: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """The k nearest of each query in each bucket: both sides in blocks, each pair of blocks a task's group.

    Sizes of the buckets are counted first, a row for each bucket that both sides reach.
    """
    # Names of their own: both sides may stem from one table.
    base, queries = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (base, queries))
    sizes = base.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    asked = queries.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"))
    grid = cut(sizes.join(asked, ["t", "b"]))
    grid = F.broadcast(grid) if grid.count() <= BROADCAST_ROWS else grid
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(grid, ["t", "b"]).withColumn("i", part("nb")).withColumn("j", each("nq")).drop("nb", "nq")
    right = queries.join(grid, ["t", "b"]).withColumn("j", part("nq")).withColumn("i", each("nb")).drop("nb", "nq")

    def run(xs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if xs.num_rows and qs.num_rows:
            ids, x = xs.column("id").to_numpy(), _matrix(xs.column("embedding").combine_chunks(), width)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            names, q = qs.column("id").to_numpy(), _matrix(qs.column("embedding").combine_chunks(), width)
            for at in range(0, len(q), 512):
                near = q[at : at + 512] @ x.T
                bound = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
                for r, row in enumerate(near):
                    some = np.flatnonzero(row >= bound[r] - 1e-9 * (1 + abs(bound[r])))
                    exact = np.add.accumulate(x[some] * q[at + r], axis=1)[:, -1]
                    best = np.argsort(-exact, kind="stable")[:k]
                    out.append((np.full(len(best), names[at + r]), ids[some[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("qid", "vec_id", "score"), columns, strict=True)))

    keys = ["t", "b", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "qid long, vec_id long, score double")
    # A vector found in several tables ranks once.
    rank = F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank").distinct()


def search(vectors: DataFrame, queries: Column, k: int = 20, tables: int = TABLES, probes: int | None = None, polytopes: int = 1) -> DataFrame:
    """vectors with vec_id and embedding (any others) -> query_id, rank, vec_id, score for the rows that ``queries`` picks.

    The k largest inner products with every row but the query's own, in double precision, summed from
    the first component to the last; ties go to the smaller vec_id. Null, zero and non-finite vectors,
    and those of another width than the widest, take no part; rows that are the same throughout count
    once. An id that comes with several vectors counts with each: as a query it keeps the nearest that any
    of them finds, as a hit its best. Equal vectors are searched and found as one: only the k + 1 lowest ids of each can rank.
    A query whose probes bring fewer than k others is compared with all rows, block by block.
    """
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Floats travel as floats; tasks turn them into doubles, which changes no value.
    kind = dict(vectors.dtypes)["embedding"]
    same_type = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.filter(usable(vectors, width) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), same_type.alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    same = Window.partitionBy("embedding").orderBy("id")
    base = cut(rows.select("id", "embedding").withColumn("r", F.dense_rank().over(same)).filter(F.col("r") <= k + 1).drop("r").distinct())
    asks = cut(rows.filter("asks").select("id", "embedding").distinct())
    one = cut(asks.groupBy("embedding").agg(F.min("id").alias("id")).select("id", "embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shortest, longest, n = base.agg(F.min(norm), F.max(norm), F.count("*")).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lift = 0.0 if longest - shortest <= ROUNDING * longest else float(longest)
    if probes is None:
        some = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
        polytopes, probes = fit_probes(_matrix(some.column("embedding").combine_chunks(), width), lift, k, n, tables)
    found = cut(_closest(_hashed(base, width, lift, tables, 1, polytopes, False), _hashed(one, width, lift, tables, probes, polytopes, True), width, k + 1))
    short = cut(one.join(found.groupBy("qid").count().filter(F.col("count") >= min(k + 1, n)), F.col("id") == F.col("qid"), "left_anti"))
    if short.limit(1).count():
        place = lambda df: df.withColumn("t", F.lit(0)).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(64)))
        everywhere = short.withColumn("t", F.lit(0)).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
        more = _closest(place(base), everywhere, width, k + 1)
        found = found.join(short.select(F.col("id").alias("qid")), "qid", "left_anti").unionByName(more)
    # A common vector may be asked by many rows, which tasks share.
    members = cut(spread_join(asks, one.withColumnRenamed("id", "qid"), "embedding", "id", frequent(asks, "embedding")).select("qid", F.col("id").alias("query_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = spread_join(members, found, "qid", "query_id", frequent(members, "qid")).filter(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return hits.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
