"""Training pairs: hard negatives, batches, splits, shuffles."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corvine.functions.session import cut
from corvine.functions.text import md5_number, subsystem
from corvine.operators.ordering import first_wins, placed


#: Groups broadcast at most, some 40 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def dedup_anchors(pairs: DataFrame, text: str, order: list[Column], chars: int = 200) -> DataFrame:
    """The first row of each lower-cased prefix."""
    return first_wins(pairs, [F.lower(F.substring(F.col(text), 1, chars))], order)


def seeded(seed: int, *keys: str) -> Column:
    """The key of a reproducible shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def _next_other(rows: DataFrame, group: Column, seed: int) -> DataFrame:
    """i -> j: of the rows of the same group with another name, the next one in a shuffled ring of names.

    A ring instead of all pairs: rows of a group are ordered by a hash of their name, so that those of one
    name stand together; each takes the first row of the next name, the last name takes that of the first.
    """
    names = rows.withColumn("__g", group).withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("name"))))
    heads = names.groupBy("__g", "__h", "name").agg(F.min(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"))), F.col("i")))["i"].alias("j"))
    # Places in one range sort of all groups' names: no task holds a group.
    ring = cut(placed(heads.select("__g", "__h", "name", "j"), [F.col("__g"), F.col("__h"), F.col("name")]))
    after = ring.select((F.col("pos") - 1).alias("pos"), F.col("__g").alias("__g2"), F.col("j").alias("next"))
    firsts = cut(ring.groupBy(F.col("__g").alias("__g1")).agg(F.min_by("j", "pos").alias("first")))
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    following = ring.join(after, "pos", "left").join(firsts, F.col("__g").eqNullSafe(F.col("__g1")))
    own = F.when(F.col("__g").eqNullSafe(F.col("__g2")), F.col("next"))
    following = following.withColumn("to", F.coalesce(own, F.when(F.col("first") != F.col("j"), F.col("first"))))
    return names.join(following.select("__g", "name", "to").filter("to IS NOT NULL"), ["__g", "name"]).select("i", F.col("to").alias("j"))


def hard_negatives(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows (i, path, name, positive) -> i, j, tier, negative: a sibling of another name.

    One in the same file if there is any (tier 0), else one of the same subsystem (tier 1); rows without
    either are dropped. The choice is a hash's: about even, and the same on every run.
    """
    near = _next_other(rows.select("i", "path", "name"), F.col("path"), seed).withColumn("tier", F.lit(0))
    lone = rows.join(near.select("i"), "i", "left_anti").select("i", "path", "name")
    # Candidates of the second tier are all rows of the subsystem, not the lone ones alone.
    wide = _next_other(rows.select("i", "path", "name"), subsystem(F.col("path")), seed).join(lone.select("i"), "i", "left_semi").withColumn("tier", F.lit(1))
    chosen = near.unionByName(wide)
    return chosen.join(rows.select(F.col("i").alias("j"), F.col("positive").alias("negative")), "j").select("i", "j", "tier", "negative")


def grouped_batches(rows: DataFrame, group: str, size: int, seed: int = 42) -> DataFrame:
    """rows (i, group) -> i, batch, place, full: blocks of ``size`` of one group in shuffled order; the groups' tails make mixed batches, the last maybe short."""
    # Places come from a range sort of all rows, so a group of any size is dealt over many tasks.
    keyed = placed(rows.select("i", F.col(group).alias("g"), seeded(seed, "i").alias("h")), [F.col("g"), F.col("h"), F.col("i")])
    sizes = keyed.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("n"), F.min("pos").alias("from"))
    numbered = keyed.join(sizes, F.col("g").eqNullSafe(F.col("__g"))).select("g", "i", "h", "n", (F.col("pos") - F.col("from")).alias("at"))
    whole = F.floor(F.col("n") / size) * size
    full = numbered.filter(F.col("at") < whole).select("i", F.concat_ws("#", "g", F.floor(F.col("at") / size).cast("string")).alias("batch"), (F.col("at") % size).cast("long").alias("place"), F.lit(True).alias("full"))
    rest = placed(numbered.filter(F.col("at") >= whole).select("i", "h"), [F.col("h"), F.col("i")])
    tails = rest.select("i", F.concat_ws("#", F.lit("tail"), F.floor(F.col("pos") / size).cast("string")).alias("batch"), (F.col("pos") % size).cast("long").alias("place"), F.lit(False).alias("full"))
    return full.unionByName(tails)


def distinct_batches(rows: DataFrame, text: str, size: int, seed: int = 42) -> DataFrame:
    """rows (i, text) -> i, batch: no text twice in a batch.

    The n-th copies of all texts form layer n, and each layer is cut into batches of ``size``.
    """
    sorted_ = placed(rows.select("i", F.md5(F.col(text)).alias("t"), seeded(seed, "i").alias("h")), [F.col("t"), F.col("h"), F.col("i")])
    heads = sorted_.groupBy(F.col("t").alias("__t")).agg(F.min("pos").alias("head"))
    copies = sorted_.join(heads, F.col("t").eqNullSafe(F.col("__t"))).select("i", "h", (F.col("pos") - F.col("head") + 1).alias("layer"))
    at = placed(copies, [F.col("layer"), F.col("h"), F.col("i")])
    first = at.groupBy("layer").agg(F.min("pos").alias("from"))
    return at.join(first, "layer").select("i", F.concat_ws("#", F.col("layer").cast("string"), F.floor((F.col("pos") - F.col("from")) / size).cast("string")).alias("batch"))


def positional_split(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Adds held_out for the first ``n`` rows of the order."""
    return placed(rows, order).withColumn("held_out", F.col("pos") < n)


@F.pandas_udf(LongType())
def blake2b_number(keys: pd.Series) -> pd.Series:
    """The 8-byte BLAKE2b of each string as a number modulo a million; Spark has no such function."""
    return keys.map(lambda k: int.from_bytes(hashlib.blake2b((k or "").encode(), digest_size=8).digest(), "big") % 1_000_000).astype("int64")


def blake2b_split(path: Column, fraction: float) -> Column:
    return blake2b_number(path) < int(fraction * 1_000_000)


__all__ = ["blake2b_number", "blake2b_split", "dedup_anchors", "distinct_batches", "grouped_batches", "hard_negatives", "md5_number", "positional_split", "seeded"]
