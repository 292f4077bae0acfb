"""Values of contrastive losses over batches; weights are trained elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.vector import dot

SCALE, W_GIST, W_INFONCE = 20.0, 0.6, 0.4


def pair_scores(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """anchors (batch, i, a[, ga]), candidates (batch, j, c[, gc]) -> batch, i, j, s[, g] within each batch.

    The positive of anchor i is candidate j = i; hard negatives have other numbers. Batches are bounded
    by their size, so pairs are too.
    """
    guided = "ga" in anchors.columns
    cols = ["batch", "i", "j", dot(F.col("a"), F.col("c")).alias("s"), *([dot(F.col("ga"), F.col("gc")).alias("g")] if guided else [])]
    return anchors.join(candidates, "batch").select(*cols)


def candidates(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """positives (batch, i, c[, gc]), negatives alike -> batch, j, c[, gc]: positives keep their anchor's number, the negative of anchor i is -1 - i."""
    rest = [c for c in positives.columns if c not in ("batch", "i")]
    return positives.select("batch", F.col("i").alias("j"), *rest).unionByName(negatives.select("batch", (-1 - F.col("i")).alias("j"), *rest))


def accumulated(loss: Column, steps: int) -> Column:
    """A loss's share where gradients of ``steps`` batches are summed before a step."""
    return loss / steps if steps > 1 else loss


def infonce(scores: DataFrame, scale: float = SCALE) -> DataFrame:
    """One row: mean over anchors of the cross-entropy of their positive among all candidates."""
    top = F.max(F.col("s") * scale)
    each = scores.groupBy("batch", "i").agg(top.alias("m"), F.collect_list(F.col("s") * scale).alias("all"), F.max(F.when(F.col("i") == F.col("j"), F.col("s") * scale)).alias("own"))
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("m")))
    return each.agg(F.avg(F.log(total) + F.col("m") - F.col("own")).alias("loss"))


def unmasked(scores: DataFrame) -> DataFrame:
    """Without candidates that the guide finds closer to the anchor than its positive; that one always stays."""
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("g"))).over(Window.partitionBy("batch", "i"))
    return scores.withColumn("own", own).filter((F.col("i") == F.col("j")) | ~(F.col("g") > F.col("own"))).drop("own")


def total(scores: DataFrame, w_gist: float = W_GIST, w_infonce: float = W_INFONCE, scale: float = SCALE) -> DataFrame:
    """One row: infonce, gist and their weighted sum; a weight of 0 for gist leaves the guide out."""
    plain = infonce(scores, scale).withColumnRenamed("loss", "infonce")
    guided = (infonce(unmasked(scores), scale) if w_gist else infonce(scores, scale)).withColumnRenamed("loss", "gist")
    return plain.crossJoin(guided).withColumn("total", w_gist * F.col("gist") + w_infonce * F.col("infonce"))


def same_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables (token, id) are the same, and how many tokens differ."""
    both = a.select("token", F.col("id").alias("x")).join(b.select("token", F.col("id").alias("y")), "token", "full_outer")
    return both.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("n_different")).withColumn("equal", F.col("n_different") == 0)


def perplexity(rows: DataFrame, loss: str = "loss") -> DataFrame:
    return rows.agg(F.avg(loss).alias("loss")).withColumn("perplexity", F.exp("loss"))
