"""Mixing sources to target weights: pivotal dependent rounding in a reduction tree."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.tables import BROADCAST_ROWS, cut, slots

#: Documents that one task of the tree's first level holds about, and residuals that one task of a later level holds.
LEAF, FAN = 1_000, 1_000
#: Tasks that share the documents of one source where sources are too many to broadcast.
SALTS = 32
#: Copies of a document at most, and so target over source size.
MOST = 3


def size(text: Column) -> Column:
    """Words: runs of what is neither blank nor U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """source (distinct), ... -> also rank from 0, by code point with null last, without one task for all of them."""
    key = F.struct(F.col("source").isNull().alias("last"), F.col("source").cast("binary").alias("s"))
    spread = cut(sources.withColumn("key", key).repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    # A row for each partition, so as many as the session's shuffle partitions at most.
    parts = spread.groupBy("part").count()
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return spread.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rank", F.col("own") + F.col("before") - 1).drop("own", "before", "part", "key")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, source, size -> source, source_size, n_docs, weight, target.

    Weights repeat in code point order of the sources, null last. The targets share the sum of all
    sizes by weight; one stops at ``most`` times its source's size and the excess is shared anew by
    weight until none is above. Sums are whole numbers, so the result doesn't hang on their order.
    """
    every = ranked(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    every = cut(every.withColumn("weight", weight).drop("rank"))
    total = every.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    full = F.lit(False)
    level, seen = 0.0, -1
    while True:
        open_ = every.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if open_["n"] == seen:
            break
        seen, rest, weighs = open_["n"], total - open_["capped"], open_["weight"]
        # Once above its stop a source stays there: the share of a unit of weight only grows.
        full = F.col("weight") * F.lit(float(rest)) / F.lit(float(weighs or 1)) > F.col("source_size") * most
        level = (float(rest), float(weighs or 1))
    share = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(level[0]) / F.lit(level[1]))
    return every.withColumn("target", share)


def pivot(sizes: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractional copies ``part`` so that the sum of sizes times copies stays, but for one document.

    Two documents at a time trade words: one gains what the other loses until a copy becomes whole. Which
    gains is drawn so that each document keeps its expected copies. Returns the parts, all whole but that
    of the returned place (-1 if none is left).
    """
    part, left = part.copy(), -1
    draws = rng.random(len(part))
    for i in np.flatnonzero((part > 1e-12) & (part < 1 - 1e-12)):
        if left < 0:
            left = i
            continue
        a, b = left, i
        up = min((1 - part[a]) * sizes[a], part[b] * sizes[b])
        down = min(part[a] * sizes[a], (1 - part[b]) * sizes[b])
        move = up if draws[i] * (up + down) < down else -down
        part[a] += move / sizes[a]
        part[b] -= move / sizes[b]
        for k in (a, b):
            part[k] = round(part[k]) if min(part[k], 1 - part[k]) < 1e-9 else part[k]
        fractional = [k for k in (a, b) if 0 < part[k] < 1]
        left = fractional[0] if fractional else -1
    return part, left


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 2024) -> DataFrame:
    """docs with doc_id, text, source (any others) -> doc_id, source, size, source_size, target, copies, taken.

    One row for each input row. Every document of a source expects target over source size copies, has
    that rounded down or up, and takes copies times size words; only the last residual document of a
    source is off, by at most half its size. A document without words takes none and gets no copy.
    Sources of any size are split by a hash of the id into leaves; residuals of leaves meet in later
    levels. Draws hang on seed, source, level and place alone, so that reruns agree. Repeated ids are
    told apart by size only; rows that are the same throughout may swap their copies.
    """
    # Rows with a null id are dealt by their text.
    lot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sized = cut(docs.select("doc_id", "source", size(F.col("text")).alias("size"), lot.alias("lot")))
    goal = cut(targets(sized.select("doc_id", "source", "size"), weights))
    same = sized["source"].eqNullSafe(goal["source"])
    if goal.count() <= BROADCAST_ROWS:
        both = sized.join(F.broadcast(goal), same)
    else:  # a row for each source, copied for SALTS tasks that share the documents of one
        goal = goal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = sized.join(goal, same & (F.pmod(sized["lot"], F.lit(SALTS)) == goal["salt"]))
    rows = both.select(sized["*"], "source_size", "target", F.ceil(F.col("n_docs") / LEAF).alias("leaves"))
    most = rows.agg(F.max("leaves")).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("slot", F.pmod("lot", F.col("leaves"))).drop("lot")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, size long, source_size long, target double, leaves long, slot long, whole double, part double"

    def level(number: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
            rng = np.random.default_rng([seed, number, int(key[1]), zlib.crc32(repr(key[0]).encode())])
            part, left = pivot(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), rng)
            if left >= 0 and pdf["leaves"].iloc[0] == 1:
                part[left] = round(part[left])
            return pdf.assign(part=part)[[x.split()[0] for x in schema.split(", ")]]

        return run

    now = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor("rate").cast("double")).otherwise(0.0))
    now = now.withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0)).drop("rate")
    done, number = [], 0
    while True:
        # Each level is written once: its settled rows are final, its residuals at most one for each slot.
        now = cut(now.groupBy("source", "slot").applyInPandas(level(number), schema))
        if most == 1:
            break
        settled = (F.col("part") == 0) | (F.col("part") == 1)
        done.append(now.filter(settled))
        most, number = slots(most, FAN), number + 1
        now = now.filter(~settled).withColumn("leaves", F.ceil(F.col("leaves") / FAN)).withColumn("slot", F.pmod("slot", "leaves"))
    for part in done:
        now = now.unionByName(part)
    return now.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that the mix takes, columns as before and copies, size, source_size, target, taken.

    Documents without a copy, and so those without words, are left out. Rows that share an id must be
    the same document: they get the most copies of any of them each. Rows with a null id are documents of
    their own: each gets the copies of one row of the mix with its source and size. Columns of docs with
    one of the added names give way. Up to ``broadcast_rows`` rows of about 50 bytes are broadcast, more are shuffled.
    """
    added = ["copies", "size", "source_size", "target", "taken"]
    every = cut(mix(docs, weights).filter("copies > 0").select(F.col("doc_id").alias("__id"), "source", *added))
    plan = every.filter("__id IS NOT NULL").groupBy("__id").agg(F.max(F.struct(*added)).alias("most")).select("__id", "most.*")
    small = plan.count() <= broadcast_rows
    own = docs.drop(*added)
    known = own.join(F.broadcast(plan) if small else plan, F.col("doc_id") == F.col("__id")).select(*own.columns, *added)
    nameless = every.filter("__id IS NULL")
    if not nameless.limit(1).count():
        return known
    # Rows of one source and size are numbered on both sides and meet one to one.
    number = lambda order: F.row_number().over(Window.partitionBy("__source", "__size").orderBy(order))
    plan = nameless.withColumn("__source", F.col("source")).withColumn("__size", F.col("size")).withColumn("__n", number(F.desc("copies"))).drop("source", "__id")
    rows = own.filter("doc_id IS NULL").withColumn("__source", F.col("source")).withColumn("__size", size(F.col("text"))).withColumn("__n", number(F.xxhash64("text")))
    same = [rows[c].eqNullSafe(plan[c]) for c in ("__source", "__size", "__n")]
    return known.unionByName(rows.join(plan, same).select(*own.columns, *added))
