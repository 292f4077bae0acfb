"""Retrieved excerpts within a budget, and the prompt around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.plans.search import search

BUDGET = 12_000


# The first line of an excerpt, and the signs around its code.
HEAD, OPEN, CLOSE = "[%d] %s:%d  (%s %s)", "\n```c\n", "\n```\n"


def excerpt() -> Column:
    """A hit (rank, path, line, kind, name, code) as it stands in the context."""
    head = F.format_string(HEAD, F.col("rank"), F.col("path"), F.col("line"), F.col("kind"), F.col("name"))
    return F.concat(head, F.lit(OPEN), F.col("code"), F.lit(CLOSE))


def within_budget(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """hits (query_id, rank, block) that fit: the first always stays, and nothing follows the first that overflows."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used", F.sum(F.length("block")).over(order)).filter((F.col("used") <= budget) | (F.col("rank") == 1))


def context(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, n_blocks, context: a query's hits are few, so they are joined in one row."""
    kept = within_budget(hits, budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return kept.select("query_id", F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"))


def ask(index: DataFrame, queries: DataFrame, k: int = 8, mode: str = "hybrid", budget: int = BUDGET, instruction: str = "Answer from the excerpts alone.") -> DataFrame:
    """index and queries as ``search`` takes them -> query_id, n_blocks, prompt: what a language model would be asked."""
    hits = search(index, queries, k, mode, code=True)
    found = context(hits.select("query_id", "rank", excerpt().alias("block")), budget)
    asked = prompt(found, queries.select("query_id", F.col("text").alias("question")), instruction)
    return found.select("query_id", "n_blocks").join(asked, "query_id")


def prompt(contexts: DataFrame, questions: DataFrame, instruction: str) -> DataFrame:
    """query_id, prompt."""
    return contexts.join(questions, "query_id").select("query_id", F.concat(F.lit(instruction), F.lit("\n\nExcerpts:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n")).alias("prompt"))
