"""Rank fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.session import cut
from corvine.operators import lexical
from corvine.operators.ordering import ranked

RRF_K, POOL = 60, 20


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Rankings (query_id, doc_id, rank) -> query_id, doc_id, rrf, places: the rank in each ranking or null.

    places breaks ties: an earlier ranking counts first, and there the lower rank.
    """
    each = None
    for i, r in enumerate(rankings):
        one = r.select("query_id", "doc_id", *(F.col("rank").alias(f"rank{j}") if i == j else F.lit(None).cast("int").alias(f"rank{j}") for j in range(len(rankings))))
        each = one if each is None else each.unionByName(one)
    merged = each.groupBy("query_id", "doc_id").agg(*(F.max(f"rank{j}").alias(f"rank{j}") for j in range(len(rankings))))
    total = sum((F.when(F.col(f"rank{j}").isNotNull(), 1.0 / (k + F.col(f"rank{j}"))).otherwise(0.0) for j in range(len(rankings))), F.lit(0.0))
    return merged.withColumn("rrf", total)


def fused(rankings: list[DataFrame], k: int) -> DataFrame:
    order = [F.desc(F.round("rrf", 12)), *(F.asc_nulls_last(f"rank{j}") for j in range(len(rankings)))]
    return ranked(rrf(rankings), ["query_id"], order, k).select("query_id", "rank", "doc_id", "rrf")


def hybrid_independent(dense: DataFrame, tokens: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best of both: ``dense`` (query_id, doc_id, rank within the pool k * POOL) and BM25 over all documents."""
    return fused([dense, lexical.bm25_topk(tokens, queries, k * POOL)], k)


def hybrid_rerank(dense: DataFrame, tokens: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The dense pool alone is ranked anew: by BM25 fitted on each query's pool, fused with the dense order."""
    pool = cut(dense.select("query_id", "doc_id", "rank"))
    scored = lexical.bm25_in_pools(pool, tokens, queries)
    # Ties keep the dense order, which is the pool's own numbering.
    second = ranked(scored.withColumnRenamed("rank", "place"), ["query_id"], [F.desc(F.round("score", 9)), F.col("place")])
    return fused([pool, second], k)
