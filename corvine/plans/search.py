"""Searching an index of chunks: dense, hybrid over all chunks, or hybrid within the dense pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.hashed import md5_counts
from corvine.functions.session import cut, small
from corvine.functions.text import identifier_tokens, snippet
from corvine.functions.vector import normalize
from corvine.operators import fusion, lexical, vectors


def hashed_vector(text: Column, width: int = 64) -> Column:
    """A stand-in where no encoder is at hand: tokens counted in ``width`` hashed bins, normalised.

    It finds shared words, not meaning. Any function from text to vectors can take its place.
    """
    return normalize(md5_counts(identifier_tokens(text), width))


def search(index: DataFrame, queries: DataFrame, k: int = 10, mode: str = "dense", code: bool = False) -> DataFrame:
    """index (chunk_id, path, name, kind, line, code, embedding), queries (query_id, text, embedding) -> hits.

    ``mode`` is dense, hybrid (BM25 over all chunks) or rerank (BM25 fitted on each query's k * 20 nearest).
    The hits have query_id, rank, score (the cosine in dense mode, else the fused score), the chunk's
    fields and its first line, or all of its code.
    """
    base = vectors.normalized(index, "chunk_id")
    asked = queries.select("query_id", normalize(F.col("embedding")).alias("q"))
    if mode == "dense":
        hits = vectors.knn(base, asked, k).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score")
    elif mode in ("hybrid", "rerank"):
        dense = cut(vectors.knn(base, asked, k * fusion.POOL))
        tokens = lexical.tokenized(index, "chunk_id", "code")
        words = cut(queries.select("query_id", identifier_tokens(F.col("text")).alias("tokens")))
        fuse = fusion.hybrid_independent if mode == "hybrid" else fusion.hybrid_rerank
        hits = fuse(dense, tokens, words, k).select("query_id", "rank", F.col("doc_id").alias("chunk_id"), F.col("rrf").alias("score"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # A few hits for each query meet the index by their ids; only the fields shown are read.
    shown = index.select("chunk_id", "path", "name", "kind", "line", F.col("code") if code else snippet(F.col("code")).alias("snippet"))
    return small(hits).join(shown, "chunk_id")
