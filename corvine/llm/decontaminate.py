"""Benchmark decontamination by spaced seeds: DataFrame and SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.tables import cut

#: Masks of one weight: the token positions that a seed looks at. Those left out may differ.
MASKS = ((0, 1, 3, 4, 6, 8), (0, 2, 3, 5, 8, 9), (0, 1, 4, 6, 7, 10))
#: Tokens that must agree in an overlap, or all of a shorter item's; items under SHORTEST tokens prove nothing and are left out.
LEAST, SHORTEST = 13, 5
#: What a differing token takes off an overlap's length: overlaps agree in more than four of five tokens.
PENALTY = 4
#: Substituted tokens and lengths of the stretches that decide: with LEAST agreeing tokens and at most one in five substituted there is always one of these.
WINDOWS = tuple((k, max(LEAST, PENALTY * k) + k) for k in range(2 * LEAST // PENALTY + 1))
#: Benchmark tokens whose seeds are broadcast at once, about 24 bytes a seed and mask; more take more passes over the documents.
PASS_TOKENS = 400_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; empty for null."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed(tokens: str, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(repr(mask)), *(F.get(F.col(tokens), at + p) for p in mask))


def spared(n: int) -> int:
    """Tokens of an item of n that may be substituted: one in five."""
    return n // (PENALTY + 1)


def run_of(n: int) -> int:
    """Tokens in a row, 4 at most, that surely agree where an item of n overlaps: so many substitutions can't break up all runs."""
    return 4 if n >= LEAST else min(4, -(-(n - spared(n)) // (spared(n) + 1)))


def overlap(h: Column, g: Column, shift: Column) -> Column:
    """Best stretch of the item ``g`` laid on the text ``h`` at ``shift``: score, first and last token in the text, met.

    Every agreeing token counts 1, every other takes PENALTY off; the best sum of a stretch wins, the first on a tie.
    ``met`` tells whether some stretch has LEAST agreeing tokens and at most one in five substituted.
    """
    same, start = laid(h, g, shift)
    zero = F.struct(*(F.lit(v).alias(k) for k, v in (("at", 0), ("now", 0), ("since", 0), ("best", 0), ("first", 0), ("last", -1))), F.lit(-1).cast("long").alias("past"), F.lit(False).alias("met"))

    def step(s: Column, ok: Column) -> Column:
        since = F.when(s["now"] > 0, s["since"]).otherwise(s["at"])
        now = F.greatest(F.when(s["now"] > 0, s["now"]).otherwise(F.lit(0)) + F.when(ok, 1).otherwise(-PENALTY), F.lit(0))
        up = now > s["best"]
        # The last 63 tokens as bits, 1 where substituted.
        past = F.shiftleft(s["past"], 1).bitwiseOR(F.when(ok, 0).otherwise(1).cast("long"))
        met = reduce(lambda a, b: a | b, (F.bit_count(past.bitwiseAND(F.lit((1 << size) - 1).cast("long"))) <= k for k, size in WINDOWS))
        return F.struct(
            (s["at"] + 1).alias("at"), now.alias("now"), since.alias("since"), F.greatest(now, s["best"]).alias("best"),
            F.when(up, since).otherwise(s["first"]).alias("first"), F.when(up, s["at"]).otherwise(s["last"]).alias("last"),
            past.alias("past"), (s["met"] | met).alias("met"),
        )

    return F.aggregate(same, zero, step, lambda s: F.struct(s["best"].alias("score"), (s["first"] + start).alias("first"), (s["last"] + start).alias("last"), s["met"].alias("met")))


def laid(h: Column, g: Column, shift: Column) -> tuple[Column, Column]:
    """Which tokens agree where the item ``g`` is laid on the text ``h`` at ``shift``, and where in the text that begins."""
    start, skip = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    size = F.least(F.size(h) - start, F.size(g) - skip)
    same = F.zip_with(F.slice(h, start + 1, size), F.slice(g, skip + 1, size), lambda a, b: a == b)
    return same, start


def _one_pass(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...], net: bool) -> DataFrame:
    i, j = F.col("i"), F.col("j")

    def wanted(tokens: str, m: tuple[int, ...]) -> Column:
        # Runs under 4 tokens are common: they seed only the items that need them.
        short = [n for n in range(SHORTEST, LEAST) if run_of(n) == len(m)]
        return F.size(tokens).isin(short) if tokens == "g" and len(m) < 4 else F.lit(True)

    def seeded(rows: DataFrame, tokens: str, at: str) -> DataFrame:
        # explode_outer: the filter that an inner explode adds would work out the tokens twice.
        every = rows.select("*", F.posexplode_outer(tokens).alias(at, "token")).drop("token").filter(F.col(at).isNotNull())
        seeds = F.array(*(F.when((F.col(at) + (1 + max(m)) <= F.size(tokens)) & wanted(tokens, m), seed(tokens, F.col(at), m)) for m in masks))
        return every.select("*", F.posexplode_outer(seeds).alias("mask", "seed")).filter(F.col("seed").isNotNull())

    # Both sides are bounded by PASS_TOKENS: a row for each seed, and each item's tokens once.
    known = F.broadcast(seeded(items.filter(F.size("g") >= SHORTEST), "g", "j").select("seed", "item", "j", F.size("g").alias("m")))
    # All hits of a text wait in memory together, so each takes no more of it than the item can lie on.
    start, skip = F.greatest(i - j, F.lit(0)), F.greatest(j - i, F.lit(0))
    stretch = F.slice("h", start + 1, F.least(F.size("h") - start, F.col("m") - skip))
    hits = seeded(docs.select("doc_id", token_hashes(F.col("text")).alias("h")), "h", "i").join(known, "seed")
    hits = hits.select("doc_id", "item", "mask", "i", "j", start.alias("start"), stretch.alias("w")).join(F.broadcast(items), "item")
    # Of neighbouring hits of one mask on one diagonal the leftmost is enough: all lie in the same overlap.
    before = lambda m: reduce(lambda a, b: a & b, (F.get("w", i - F.col("start") + (p - 1)) == F.get("g", j + (p - 1)) for p in m))
    repeated = reduce(lambda a, b: a | b, ((F.col("mask") == k) & before(m) for k, m in enumerate(masks)))
    hits = hits.filter((i == 0) | (j == 0) | ~F.coalesce(repeated, F.lit(False)))
    n, shift = F.size("g"), F.least(i - j, F.lit(0))
    agree = F.size(F.filter(laid(F.col("w"), F.col("g"), shift)[0], lambda ok: ok))
    # Most chance hits go by a plain count before their stretches are worked out.
    hits = hits.filter(agree >= F.least(F.lit(LEAST), n - F.floor(n / (PENALTY + 1))))
    found = hits.select("doc_id", "item_id", "start", n.alias("n"), overlap(F.col("w"), F.col("g"), shift).alias("o"))
    found = found.filter(F.col("o.score") >= F.least(F.lit(LEAST), F.col("n")) if net else (F.col("n") < LEAST) | F.col("o.met"))
    best = F.max(F.struct("o.score", (-(F.col("o.first") + F.col("start"))).alias("first"), (-(F.col("o.last") + F.col("start"))).alias("last")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.first")).alias("first_token"), (-F.col("b.last")).alias("last_token"))


def _pairs(docs: DataFrame, benchmark: DataFrame, net: bool) -> DataFrame:
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("g")).filter(F.size("g") >= SHORTEST)
    sizes = items.agg(F.coalesce(F.sum(F.size("g")), F.lit(0)), F.collect_set(F.when(F.size("g") < LEAST, F.size("g")))).first()
    masks = MASKS + tuple(tuple(range(r)) for r in sorted({4, *map(run_of, sizes[1])}))
    passes = max(1, -(-sizes[0] // PASS_TOKENS))
    items = items.withColumn("item", F.xxhash64("item_id", "g"))
    parts = [_one_pass(docs, items.filter(F.pmod("item", F.lit(passes)) == k) if passes > 1 else items, masks, net) for k in range(passes)]
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text), any other columns -> doc_id, item_id, score, first_token, last_token.

    A pair for each document and item whose texts overlap in a stretch with at least LEAST agreeing
    tokens and at most one in five substituted, case and punctuation aside; of an item shorter than LEAST
    all tokens but one in five must agree. Score, first and last token are those of the pair's best
    stretch by ``overlap``. Items of under SHORTEST tokens, and null or empty texts on either side, match
    nothing. Such an overlap always has a run of ``run_of`` agreeing tokens, which is a seed too, so none
    is missed. Repeated rows give one pair.
    """
    return _pairs(docs, benchmark, net=False)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of ``contaminated`` whose score alone is LEAST or more, that of an entire shorter item without a substitution."""
    return _pairs(docs, benchmark, net=True)


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, columns as they are, without those that overlap a benchmark item.

    The ids of these are broadcast if there are at most ``broadcast_rows``, 8 bytes each. Rows with a null
    id are told apart by their text; rows that share an id all go if one of them overlaps.
    """
    bad = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct())
    small = bad.count() <= broadcast_rows
    kept = docs.join(F.broadcast(bad) if small else bad, F.col("doc_id") == F.col("__bad"), "left_anti")
    if not bad.filter("__bad IS NULL").limit(1).count():
        return kept
    nameless = docs.filter("doc_id IS NULL")
    texts = nameless.select(F.sha2("text", 256).alias("doc_id"), "text")
    go = cut(contaminated(texts, benchmark).select(F.col("doc_id").alias("__go")).distinct())
    return kept.filter("doc_id IS NOT NULL").unionByName(nameless.join(go, F.sha2("text", 256) == F.col("__go"), "left_anti"))
