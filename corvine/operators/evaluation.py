"""Retrieval metrics from the rank of the one relevant document, null if it isn't in the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import metric_name


# The metrics that reports show, in their order.
METRICS = ("accuracy@1", "accuracy@5", "mrr@10", "ndcg@10", "recall@10")


def picked(scores: DataFrame) -> DataFrame:
    """scores (key, value) -> metric, value of the METRICS: what follows a key's last underscore; of equal names the greatest key's value."""
    named = scores.withColumn("metric", metric_name(F.col("key"))).filter(F.col("metric").isin(*METRICS))
    return named.groupBy("metric").agg(F.max_by("value", "key").alias("value"))


def evaluate(rankings: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """Rankings (query_id, doc_id, rank) by model, gold (query_id, doc_id) -> a row for each metric, a column for each model, and the difference of two."""
    parts = [long(closed(gold_ranks(r, gold)), model) for model, r in rankings.items()]
    return compare(parts, list(rankings))


def at_most(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))


def closed(ranks: DataFrame, rank: str = "rank", ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: accuracy at each k, MRR, NDCG and recall at 10."""
    r = F.col(rank)
    named = [at_most(r, k).alias(f"accuracy_at_{k}") for k in ks]
    return ranks.agg(*named, F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)).alias("mrr_at_10"), F.avg(F.when(r <= 10, 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg_at_10"), at_most(r, 10).alias("recall_at_10"))


def open_corpus(ranks: DataFrame, rank: str = "rank", ks: tuple[int, ...] = (1, 5, 10, 50, 100, 500)) -> DataFrame:
    """One row: recall at each k, MRR with 0 for what isn't found, and the median rank of what is, cut to a whole number."""
    r = F.col(rank)
    return ranks.agg(*(at_most(r, k).alias(f"recall_at_{k}") for k in ks), F.avg(F.when(r.isNotNull(), 1 / r).otherwise(0.0)).alias("mrr"), F.percentile(r, F.lit(0.5)).cast("int").alias("median_rank"))


def gold_ranks(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """gold (query_id, doc_id) -> query_id, rank in the ranking (query_id, doc_id, rank)."""
    return gold.join(ranking.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").select("query_id", "rank")


def long(metrics: DataFrame, model: str) -> DataFrame:
    """One wide row -> model, metric, value."""
    return metrics.select(F.lit(model).alias("model"), F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics.columns)), F.array(*(F.col(c).cast("double") for c in metrics.columns)))).alias("metric", "value"))


def compare(parts: list[DataFrame], models: list[str]) -> DataFrame:
    """metric, a column for each model (NaN where it has none) and, for two, the difference."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    wide = every.groupBy("metric").pivot("model", models).agg(F.max("value"))
    wide = wide.select("metric", *(F.coalesce(m, F.lit(float("nan"))).alias(m) for m in models))
    return wide.withColumn("delta", F.col(models[1]) - F.col(models[0])) if len(models) == 2 else wide
