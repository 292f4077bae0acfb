"""Near duplicates: order MinHash finds candidates, banded alignment verifies them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm import textops
from corvine.llm.tables import BROADCAST_ROWS, PER_TASK, cut, frequent, spread_join

#: Words in a shingle, and the least similarity: 1 less edits over the longer text's words.
SHINGLE, SIMILAR = 5, 0.8
#: Sketches of a text as (words in a shingle, shingles drawn, how many sketches): five-word shingles for close copies, and
#: pairs of words because texts at the limit may share no five-word shingle at all. Texts of up to FEW words have few pairs
#: of words left after an edit, so their words are drawn too.
FAMILIES, SHORT, FEW = ((SHINGLE, 3, 12), (2, 2, 24)), ((1, 3, 12),), 30
#: Bins of words for the first comparison, texts of a bucket compared at once, and a bucket's size beyond which it is dealt by length.
COARSE, BLOCK, LARGE = 64, 4_000, 16_000
#: Texts of one band of lengths or of neighbouring ones are all that can be similar; the slack is for rounding.
BAND = -float(np.log(SIMILAR)) + 1e-9
#: Pairs that are aligned in one cell, about.
PAIRS = 512
#: Tasks that share the edges of one vertex where minima are too many to broadcast.
SALTS = 32


def sketches(words: np.ndarray, level: int = 0) -> np.ndarray:
    """Order MinHash of a text's word hashes: all sketches of its families, drawn anew for each ``level``.

    Each sketch draws the least of the text's shingles, each labelled by which occurrence it is, under an
    order of its own, and hashes them in the order of the text. A text of fewer words than a shingle is
    one shingle; one of fewer shingles than a sketch takes has them all.
    """
    out, first = [], level << 16
    for length, take, count in FAMILIES + (SHORT if len(words) <= FEW else ()):
        x = shingles(words, length)
        number = np.arange(first, first + count, dtype=np.uint64)
        # Half of a hash orders, all of it names.
        odd, first = (textops.mix64(number, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), first + count
        half = (x >> np.uint64(32)).astype(np.uint32)
        step = max(1, 2_000_000 // len(x))
        for at in range(0, count, step):
            drawn = half[None, :] * odd[at : at + step, None]
            rows, place = np.arange(len(drawn)), np.empty((len(drawn), min(take, len(x))), np.int64)
            for c in range(place.shape[1]):
                place[:, c] = drawn.argmin(axis=1)
                drawn[rows, place[:, c]] = np.uint32(2**32 - 1)
            place.sort(axis=1)
            sign = number[at : at + step]
            for c in range(place.shape[1]):
                sign = textops.mix64(sign * np.uint64(0xC2B2AE3D27D4EB4F) + x[place[:, c]])
            out.append(sign)
    return np.concatenate(out)


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words, or of all where there are fewer, each labelled by which occurrence it is."""
    k = min(length, len(words))
    grams = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.empty(len(grams), np.uint64)
    nth[order] = np.arange(len(grams)) - np.repeat(starts, np.diff(np.r_[starts, len(grams)]))
    return textops.mix64(grams + nth * np.uint64(0xD1B54A32D192ED03))


def sketched(docs: DataFrame, level: int = 0) -> DataFrame:
    """doc_id, text -> doc_id, key (of all words, null without any), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textops.lowered(batch.column("text")):
                _, _, doc, h = textops.words(buf, offsets)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                keys: list[bytes | None] = []
                signs = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    keys.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    signs.append(sketches(h[a:b], level).view(np.int64) if b > a else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, signs)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signs)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(keys, pa.binary()), lists], names=["doc_id", "key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, sketch array<long>")


def distance(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edit distances of word sequences, or a number above a pair's limit where it is above.

    What both begin or end with is set aside. Pairs whose bags of words differ by more than the limit are
    out. The others are aligned in a band around the diagonal, many pairs at a time; the band widens
    until it holds the distance or the limit, so the result is exact.
    """
    out = np.empty(len(pairs), np.int64)
    left = []
    for i, (a, b) in enumerate(pairs):
        out[i] = limits[i] + 1
        shift, n = abs(len(a) - len(b)), min(len(a), len(b))
        if shift > limits[i]:
            continue
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
        tail = int(differ[0]) if len(differ) else n - head
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b))
            continue
        known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        common = np.minimum(np.bincount(code[: len(a)], minlength=len(known)), np.bincount(code[len(a) :], minlength=len(known))).sum()
        least = max(len(a), len(b)) - common
        if least <= limits[i]:
            left.append((i, code[: len(a)].astype(np.int32), code[len(a) :].astype(np.int32), min(limits[i], least + 6)))
    while left:
        # A path that leaves a band of half-width w and comes back to the end costs at least 2 w + 2 - shift.
        half = lambda x: 4 << max(0, int((x[3] + abs(len(x[1]) - len(x[2]))) / 2) // 4).bit_length()
        left.sort(key=lambda x: (half(x), len(x[1])))
        again, at = [], 0
        while at < len(left):
            band, upto = half(left[at]), at + 1
            while upto < len(left) and half(left[upto]) == band and upto - at < 256 and (upto - at + 1) * (len(left[upto][1]) + 2 * band) < 1_000_000 and len(left[upto][1]) < 64 + 1.3 * len(left[at][1]):
                upto += 1
            part = left[at:upto]
            for (i, a, b, goal), d in zip(part, _banded([x[1] for x in part], [x[2] for x in part], band), strict=True):
                sure = 2 * band + 1 - abs(len(a) - len(b))
                if d <= sure:
                    out[i] = min(d, limits[i] + 1)
                elif sure < limits[i]:
                    again.append((i, a, b, min(limits[i], 3 * max(goal, sure))))
            at = upto
        left = again
    return out


def _banded(left: list[np.ndarray], right: list[np.ndarray], band: int) -> np.ndarray:
    """Distances within ``band`` of the diagonal for pairs of sequences together; exact where they are at most ``band``."""
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    width, far = 2 * band + 1, np.int32(1 << 29)
    a = np.full((len(left), n.max()), -1, np.int32)
    b = np.full((len(left), max(m.max(), n.max()) + 2 * band + 2), -2, np.int32)
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        a[k, : len(x)] = x
        b[k, band : band + len(y)] = y
    at = np.arange(width, dtype=np.int32)
    row = np.where(at >= band, at - band, far)[None, :].repeat(len(left), 0).astype(np.int32)
    row[at[None, :] - band > m[:, None]] = far
    out = np.full(len(left), int(far))
    for i in range(1, int(n.max()) + 1):
        cost = row + (b[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        np.minimum(cost[:, :-1], row[:, 1:] + 1, out=cost[:, :-1])
        column = i - band + at
        if i <= band:
            cost[:, column < 0] = far
            cost[:, column == 0] = i
        row = np.minimum.accumulate(cost - at, axis=1) + at
        row[column[None, :] > m[:, None]] = far
        ends = np.flatnonzero(n == i)
        if len(ends):
            place = m[ends] - i + band
            fits = (place >= 0) & (place < width)
            out[ends[fits]] = row[ends[fits], place[fits]]
    return out


def limit_of(n: Column) -> Column:
    """The most edits at which a text of ``n`` words, the longer of two, is similar."""
    return F.floor((1 - SIMILAR) * n + 1e-9)


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each of as many bins as there are words, a power of two of at least COARSE; at most 255 counted."""
    bins = max(COARSE, 1 << int(len(words) - 1).bit_length())
    return np.minimum(np.bincount((words % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def folded(some: list[np.ndarray], bins: int) -> np.ndarray:
    """Bags of one size, one a row, in ``bins`` bins."""
    return np.stack(some).reshape(len(some), -1, bins).sum(1, dtype=np.int32)


def surplus(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Fewest edits between texts by their bags: the larger sum of words that one side has more of."""
    differ = many - one
    up = np.maximum(differ, 0).sum(1)
    return np.maximum(up, up - differ.sum(1))


def bags(texts: DataFrame) -> DataFrame:
    """id, text -> id, n (words), bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textops.lowered(batch.column("text")):
                _, _, doc, h = textops.words(buf, offsets)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                out = [bag(h[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(cuts).astype(np.int32)), pa.array(out, pa.binary())], names=["id", "n", "bag"])

    return texts.select("id", "text").mapInArrow(run, "id long, n int, bag binary")


def arrays(column: pa.Array) -> list[np.ndarray]:
    buf, offsets = textops.utf8(column)
    return [buf[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def bounded(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (a, b), known (id, n, bag) -> a, b, n_a, n_b, least: no fewer edits lie between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = arrays(batch.column("bag_a")), arrays(batch.column("bag_b"))
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
            least = np.abs(batch.column("n_a").to_numpy().astype(np.int64) - batch.column("n_b").to_numpy())
            for p, q in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == (p, q)).all(1))
                step = max(1, 2_000_000 // int(max(p, q)))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    bound = surplus(folded([x[k] for k in some], int(min(p, q))), folded([y[k] for k in some], int(min(p, q))))
                    least[some] = np.maximum(least[some], bound)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(least)], names=["a", "b", "n_a", "n_b", "least"])

    right = lambda x: known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bag").alias(f"bag_{x}"))
    # A text is in no more pairs as "a" than it has sketches, but one may lead many.
    pairs = spread_join(pairs, right("b"), "b", "a", frequent(pairs, "b")).join(right("a"), "a")
    return pairs.select("a", "b", "n_a", "n_b", "bag_a", "bag_b").mapInArrow(run, "a long, b long, n_a int, n_b int, least long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b), texts (id, text) -> a, b, edits, similarity of the pairs that are similar, by alignment.

    Pairs are dealt by both their ends to cells of about PAIRS, those of a frequent ``b`` to more; each
    text goes once to each cell that names it and is split into words there once.
    """

    def run(key: tuple[pa.Scalar, ...], some: pa.Table, named: pa.Table) -> pa.Table:
        own: list[np.ndarray] = []
        for batch in named.select(["text"]).to_batches():
            for lo, hi, buf, offsets in textops.lowered(batch.column(0)):
                _, _, doc, h = textops.words(buf, offsets)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                own += [h[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        at = {k: i for i, k in enumerate(named.column("id").to_pylist())}
        ends = [(own[at[x]], own[at[y]]) for x, y in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True)]
        longest = np.array([max(len(x), len(y), 1) for x, y in ends])
        limits = np.floor((1 - SIMILAR) * longest + 1e-9).astype(np.int64)
        found = np.concatenate([distance(ends[k : k + 512], limits[k : k + 512]) for k in range(0, len(ends), 512)])
        out = pa.table({"a": some.column("a"), "b": some.column("b"), "edits": pa.array(found), "similarity": pa.array(1 - found / longest)})
        return out.filter(pa.array(found <= limits))

    pairs = cut(pairs.select("a", "b"))
    side = max(1, int(np.ceil(np.sqrt(pairs.count() / PAIRS))))
    hot = frequent(pairs, "b")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    dealt = pairs.join(hot, "b", "left").select("a", "b", place("a", F.lit(side)).alias("i"), place("b", F.lit(side)).alias("j"), place("a", F.coalesce(F.col("salts"), F.lit(1))).alias("k"))
    cell = ["i", "j", "k"]
    ends = dealt.select(*cell, F.col("a").alias("id")).union(dealt.select(*cell, F.col("b").alias("id"))).distinct()
    # Few texts are named at all; a text in more cells than a task holds is one of a frequent "b".
    sent = ends.join(texts, "id").select(*(F.col(c).alias(c) for c in (*cell, "id", "text")))
    return cut(dealt.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(run, "a long, b long, edits long, similarity double"))


def least_neighbour(edges: DataFrame, small: bool, itself: bool) -> DataFrame:
    """u, v -> u, v, m: the least neighbour of u, or u itself with ``itself`` if that is less.

    Minima are taken before the shuffle. They are broadcast if the graph is small; else each is copied for
    SALTS tasks that share the rows of its u, so no vertex's neighbours are ever gathered.
    """
    least = edges.groupBy("u").agg((F.least(F.min("v"), F.col("u")) if itself else F.min("v")).alias("m"))
    if small:
        return edges.join(F.broadcast(least), "u")
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def components(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """a, b -> id, root: the least id that links reach, for every linked id.

    Alternating large and small stars: every vertex passes the least of its neighbours on.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    # There are no more vertices than ends of edges, and stars never add edges.
    small, state = 2 * now.count() <= broadcast_rows, None
    while True:
        both = least_neighbour(now.union(now.select("v", "u")), small, True)
        large = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        both = least_neighbour(large, small, False)
        now = cut(both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(both.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
            return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def links(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text; one text for each id), reps (id, sketch) of different texts -> verified links (a, b, similarity), classes they join (id, root).

    Texts that share a sketch's hash form a bucket. Its least id leads: all others are compared with it, by
    their bags of words first and then by alignment. ``unsettled`` tells which members can still be similar
    to another one; those of different classes are compared with each other by ``possible``, and the pairs
    that it lets through are aligned. A bucket of over LARGE such members is compared by bands of lengths,
    which no similar pair is too far apart for. So the pairs of a group of copies are never listed, nobody
    is dropped, and a pair that shares a bucket is found whatever the bucket's size.
    """
    rows = reps.select("id", F.explode("sketch").alias("sign"))
    # Buckets of one, most of all, go at once.
    leads = cut(rows.groupBy("sign").agg(F.min("id").alias("lead"), F.count("*").alias("size")).filter("size > 1"))
    hot = leads.select("sign", F.ceil(F.col("size") / PER_TASK).cast("int").alias("salts")).filter("salts > 1")
    left = cut(spread_join(rows, leads.select("sign", "lead"), "sign", "id", hot))
    ids = cut(left.select("id").distinct())
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id")).select("id", "text")
    known = cut(bags(texts))
    left = left.filter("id <> lead")
    pairs = cut(bounded(cut(left.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()), known))
    near = verified(pairs.filter(F.col("least") <= limit_of(F.greatest("n_a", "n_b"))), texts)
    roots = cut(components(near.select("a", "b")))
    small = roots.count() <= BROADCAST_ROWS
    members = unsettled(left, pairs, near, F.broadcast(roots) if small else roots, hot)
    members = members.withColumn("band", F.floor(F.log("n") / BAND).cast("int"))
    bands = members.groupBy("sign", "band").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).groupBy("sign")
    size = F.sum("many")
    # A row for each band of a bucket: text lengths are its only bound, and they are few.
    every = F.when(size > LARGE, F.map_from_entries(F.collect_list(F.struct("band", "many")))).otherwise(F.create_map(F.lit(0), size))
    open_ = bands.agg(size.alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), every.alias("bands")).filter("low < high").select("sign", "size", "bands")
    members = cut(spread_join(members, open_, "sign", "id", hot).withColumn("band", F.when(F.col("size") > LARGE, F.col("band")).otherwise(0)).drop("n", "size"))
    near = near.select("a", "b", "similarity")
    if not members.limit(1).count():
        return near, roots
    fresh = possible(members, known).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(fresh, texts).select("a", "b", "similarity")
    # Further links join whole classes: only their roots meet.
    own = F.broadcast(roots) if small else roots
    ends = more.select("a", "b").join(own.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(own.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    over = cut(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("top")))
    over = F.broadcast(over) if over.count() <= BROADCAST_ROWS else over
    alone = over.join(roots.select(F.col("id").alias("root")), "root", "left_anti").select(F.col("root").alias("id"), "top")
    return near.unionByName(more), roots.join(over, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(alone.withColumnRenamed("top", "root"))


def unsettled(left: DataFrame, pairs: DataFrame, near: DataFrame, roots: DataFrame, hot: DataFrame) -> DataFrame:
    """left (id, sign, lead), pairs (a, b, n_a, least), near (a, b, edits), roots (id, root) -> id, sign, root, n of the members of each bucket that another member than its leader may be similar to and isn't of one class with.

    Strangers are the members of other classes than the leader's. Edits are a distance, so a stranger that
    takes d edits from the leader is at least d - e from a linked member that takes e: where all strangers
    are farther than e and that member's limit, the linked members can be similar to none of them and are
    left out. A bucket of one stranger and such members only is settled.
    """
    d = pairs.join(near.select("a", "b", "edits"), ["a", "b"], "left").select(F.col("a").alias("id"), F.col("b").alias("lead"), F.col("edits").isNotNull().alias("linked"), F.coalesce("edits", F.greatest("least", limit_of(F.greatest("n_a", "n_b")) + 1)).alias("d"), F.col("n_a").alias("n"))
    d = d.join(roots, "id", "left").join(roots.select(F.col("id").alias("lead"), F.col("root").alias("top")), "lead", "left")
    d = d.withColumn("root", F.coalesce("root", "id")).withColumn("stranger", F.col("root") != F.coalesce("top", "lead")).drop("top")
    members = left.join(d, ["id", "lead"])
    # The longest text that is similar to one of n words has n / SIMILAR.
    reach = F.max(F.when(F.col("linked"), F.col("d") + limit_of(F.col("n") / SIMILAR)))
    stats = members.groupBy("sign").agg(F.count_if("stranger").alias("strangers"), F.count_if(~F.col("stranger") & ~F.col("linked")).alias("others"), F.min(F.when(F.col("stranger"), F.col("d"))).alias("closest"), reach.alias("reach"))
    stats = stats.withColumn("mixed", F.coalesce(F.col("closest") <= F.col("reach"), F.lit(False))).filter("strangers > 0 AND (mixed OR strangers + others > 1)").select("sign", "mixed")
    return cut(spread_join(members.select("id", "sign", "linked", "root", "n"), stats, "sign", "id", hot).filter("mixed OR NOT linked").select("id", "sign", "root", "n"))


def possible(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (sign, id, root, band, bands: how many members each band of the bucket has), known (id, n, bag) -> a, b: pairs of a bucket that can be similar at all.

    Pairs of the same root are left out: they are of one class as it is. A pair that shares several buckets
    is listed in the least of them.

    Two texts differ by at least as many edits as the larger sum of surplus words in their bins; pairs for
    which that, or the difference in length, is over the limit are never listed. Bands of over BLOCK
    members are compared block by block, each pair of blocks of a band or of two neighbours a group of its own.
    """
    signs = rows.groupBy("id").agg(F.array_sort(F.collect_set("sign")).alias("signs"))
    blocks = lambda band: F.ceil(F.coalesce(F.col("bands")[band], F.lit(0)) / BLOCK)
    name = lambda band, block: band.cast("long") * (1 << 24) + block
    own = name(F.col("band"), F.pmod(F.xxhash64("id"), blocks(F.col("band"))))
    none = F.array().cast("array<bigint>")
    others = F.concat(*(F.when(blocks(b) > 0, F.sequence(name(b, F.lit(0)), name(b, blocks(b) - 1))).otherwise(none) for b in (F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others)).drop("bands").join(known.join(signs, "id"), "id")
    rows = rows.select("sign", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "n", "bag", "signs")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("n").to_numpy(), kind="stable")))
        ids, root, n, own = (table.column(c).to_numpy() for c in ("id", "root", "n", "own"))
        fine = arrays(table.column("bag"))
        bins = np.array([len(x) for x in fine])
        coarse = np.concatenate([folded([x], COARSE) for x in fine])
        lists = table.column("signs").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sign, apart = key[0].as_py(), key[1].as_py() != key[2].as_py()
        a, b = [], []
        for r in range(len(ids)):
            upto = np.searchsorted(n, n[r] / SIMILAR + 1e-6, side="right")
            limit = (1 - SIMILAR) * n[r + 1 : upto] + 1e-9
            fits = root[r + 1 : upto] != root[r]
            if apart:
                fits &= own[r + 1 : upto] != own[r]
            close = np.flatnonzero(fits)
            close = close[surplus(coarse[r + 1 + close], coarse[r]) <= limit[close]]
            near = []
            for size in np.unique(bins[r + 1 + close]):
                some = close[bins[r + 1 + close] == size]
                least = min(int(size), int(bins[r]))
                for at in range(0, len(some), max(1, 2_000_000 // int(size))):
                    part = some[at : at + max(1, 2_000_000 // int(size))]
                    near.append(part[surplus(folded([fine[r + 1 + k] for k in part], least), folded([fine[r]], least)) <= limit[part]])
            close = np.concatenate([close[:0], *near])
            mine = flat[cuts[r] : cuts[r + 1]]
            some = [k for k in r + 1 + close if np.intersect1d(mine, flat[cuts[k] : cuts[k + 1]], assume_unique=True)[0] == sign]
            a.append(np.maximum(ids[some], ids[r]))
            b.append(np.minimum(ids[some], ids[r]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("sign", "i", "j").applyInArrow(run, "a long, b long")


def one_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the least text of each id that comes with several, as ``rows`` (doc_id, key) show."""
    several = cut(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), (F.col("low") != F.col("high")).alias("differ")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not several.limit(1).count():
        return docs
    same = F.col("doc_id") == F.col("id")
    least = docs.join(several, same, "left_semi").filter(F.col("text").rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(several, same, "left_anti").unionByName(least)


def classes(docs: DataFrame) -> DataFrame:
    """docs with doc_id and text (any others) -> doc_id, class_id, n_links; one row for each input row.

    A class is what links of similarity SIMILAR or more join, copies included; class_id is its least
    doc_id and n_links counts the verified links of the row's text to different texts, as far as classes needed them. Texts are the same
    if their lower-cased words are. Null and empty texts, and texts without a word, are classes of their
    own. Rows that share an id are one document with the least of their texts that has a word: all get its
    class. A null doc_id is left as it is with a null class.
    """
    rows = cut(sketched(docs))
    one = one_text(docs, rows)
    # Only ids that come with several texts are sketched again.
    known = rows.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    mixed = cut(known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select(F.col("doc_id").alias("id")))
    if mixed.limit(1).count():
        same = F.col("doc_id") == F.col("id")
        known = cut(known.join(mixed, same, "left_anti").unionByName(sketched(one.join(mixed, same, "left_semi"))))
    reps = cut(known.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")))
    linked, roots = links(one, reps.select("id", "sketch"))
    ends = linked.select(F.col("a").alias("id")).union(linked.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    named = reps.select("key", "id").join(roots, "id", "left").join(ends, "id", "left").select("key", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    copies = known.select("doc_id", "key").distinct()
    own = spread_join(copies, named, "key", "doc_id", frequent(copies, "key")).select("doc_id", "root", "n_links")
    out = rows.select("doc_id").join(own, "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns as they are, with one document of each class: that of the least doc_id.

    Rows with a null doc_id stay; of rows that share an id the one with the least text stays.
    """
    own = cut(classes(docs))
    go = own.filter("doc_id <> class_id").select(F.col("doc_id").alias("__go")).distinct()
    small = go.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(go) if small else go, F.col("doc_id") == F.col("__go"), "left_anti")
    again = cut(own.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")))
    if not again.limit(1).count():
        return kept
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text")))
    repeated = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi").withColumn("__n", order).filter("__n = 1").drop("__n")
    return kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(repeated)
