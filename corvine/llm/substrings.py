"""Suffix-array dedup of repeated byte strings: blockwise construction with a difference cover.

A byte goes if a string of LENGTH bytes over it also starts in a document of smaller id. So suffixes
count by their first LENGTH bytes, and each needs the least id among those it equals.

1. Deal. Of the K-byte strings inside a suffix's first LENGTH bytes the one of least hash is its anchor.
   Equal suffixes have equal anchors, and neighbours mostly share one: a run of suffixes with one anchor is
   a piece of text that travels whole, some bytes for each suffix instead of LENGTH. Anchors are counted
   first; pieces whose anchor no other document has are settled. Anchors have 64-bit names at most; names
   that are equal by chance cost work and no correctness.
2. Sort. A task gets all pieces of a range of anchors, each distinct piece once. It ranks the cover samples,
   positions whose residue modulo V lies in a difference cover, by their LENGTH bytes. Then it sorts one bucket of
   suffixes at a time, those of a range of leading bytes, by their first V bytes. Long ties are resolved by
   the ranks: any two suffixes have samples at a common offset below V, and are equal if their samples there
   agree for the rest of LENGTH bytes, which ranks and the common prefixes of neighbouring ranks tell.
   Memory follows a task's text and one bucket.
3. Mark. Each chunk of documents marks its suffixes that also start in a smaller id.

Shuffled are compressed texts, names as coded differences, pieces once for each chunk, and bits on the way back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm import textops

LENGTH = 50
#: A perfect difference set: every non-zero residue modulo V is a difference of exactly one pair.
V, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of an anchor, and how many such strings a suffix's first LENGTH bytes hold.
K, SPAN = 20, LENGTH - 20 + 1
#: Bytes of text in a chunk, and bytes of text whose anchors one task counts and whose pieces one task sorts, about.
CHUNK, COUNTED, SORTED = 8 << 20, 64 << 20, 4 << 20
#: Suffixes that are sorted at once.
BUCKET = 1 << 18
#: An anchor has many pieces in a chunk beyond MANY different ones, as where a common line goes on differently in each text.
#: With many in over HOT chunks, or in MANY times as many chunks, its suffixes travel one by one, dealt by their LENGTH bytes.
MANY, HOT = 16, 1024
#: Bits of a name beyond those that number all anchors: one in 2**SPARE seems shared by chance.
SPARE = 8


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.full(n, pow(base, -1, 2**64), np.uint64))


def hashes(part: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` bytes at each position of a short text."""
    n = len(part)
    power, inverse = _powers(max(n, textops.BLOCK + LENGTH))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    return textops.mix64((prefix[width:] - prefix[:-width]) * inverse[: n - width + 1])


def anchored(part: np.ndarray) -> np.ndarray:
    """The hash of the anchor of each suffix of at least LENGTH bytes."""
    least, width = hashes(part, K), 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])


def encode(values: np.ndarray) -> bytes:
    """Sorted uint64 values as Rice-coded differences: low bits as they are, the rest as runs of zeros."""
    steps = np.diff(values, prepend=np.uint64(0))
    low = min(63, max(0, (int(values[-1]) // len(values)).bit_length() - 1)) if len(values) else 0
    rest = (steps >> np.uint64(low)).astype(np.int64)
    runs = np.zeros(int(rest.sum()) + len(steps), np.uint8)
    runs[np.cumsum(rest + 1) - 1] = 1
    kept = np.unpackbits(steps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    return bytes([low]) + len(steps).to_bytes(4, "little") + np.packbits(runs).tobytes() + np.packbits(kept.reshape(-1)).tobytes()


def decode(blob: bytes) -> np.ndarray:
    low, n = blob[0], int.from_bytes(blob[1:5], "little")
    size = (n * low + 7) // 8
    data = np.frombuffer(blob, np.uint8, offset=5)
    ends = np.flatnonzero(np.unpackbits(data[: len(data) - size]))[:n]
    steps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    if low:
        kept = np.zeros((n, 64), np.uint8)
        kept[:, :low] = np.unpackbits(data[len(data) - size :], count=n * low).reshape(n, low)
        steps |= np.packbits(kept, axis=1, bitorder="little").view("<u8").reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Chunk:
    """Documents, in an order of their own, and their runs of suffixes with one anchor: start, end, document, name."""

    def __init__(self, blobs: pa.Table, bits: int) -> None:
        table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs.column("docs").combine_chunks()])
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        self.ids = table.column("doc_id").to_numpy()
        self.buf, self.offsets = textops.utf8(table.column("text"))
        starts, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at in range(0, len(self.buf) - LENGTH + 1, textops.BLOCK):
            upto = min(len(self.buf) - LENGTH + 1, at + textops.BLOCK)
            # The least hashes are small numbers; mixed again they fill the range of names evenly.
            own = textops.mix64(anchored(self.buf[at : upto + LENGTH - 1]), 5) >> np.uint64(64 - bits)
            inside = np.ones(len(own), bool)
            for end in self.offsets[np.searchsorted(self.offsets, at, side="right") : np.searchsorted(self.offsets, upto + LENGTH)]:
                inside[max(0, end - LENGTH + 1 - at) : max(0, end - at)] = False
            # Documents lie apart: the last LENGTH - 1 positions of each begin no suffix that counts.
            new = np.flatnonzero(inside & np.r_[True, (own[1:] != own[:-1]) | ~inside[:-1]])
            starts.append(new + at)
            names.append(own[new])
        self.starts, self.names = np.concatenate(starts), np.concatenate(names)
        self.docs = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.ends = np.minimum(np.r_[self.starts[1:], len(self.buf)][: len(self.starts)], self.offsets[self.docs + 1] - LENGTH + 1)
        order = np.argsort(self.names, kind="stable")
        ordered = self.names[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        #: Each name once, which of these each run's is, and whether several documents have it.
        self.known, self.which = ordered[first], np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        ids = self.ids[self.docs[order]]
        self.several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)

    def many(self) -> np.ndarray:
        """Whether each name has over MANY different pieces."""
        out = np.bincount(self.which, minlength=len(self.known)) > MANY
        seen: dict[int, set[bytes]] = {}
        for k in np.flatnonzero(out[self.which]):
            seen.setdefault(int(self.which[k]), set()).add(self.buf[self.starts[k] : self.ends[k] + LENGTH - 1].tobytes())
        out[[name for name, pieces in seen.items() if len(pieces) <= MANY]] = False
        return out

    def pieces(self, shared: np.ndarray, hot: np.ndarray, bits: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pieces, least id of each, route of each, then of each occurrence: its piece, start, document); the flags are of each name."""
        whole, split = np.flatnonzero(shared[self.which] & ~hot[self.which]), np.flatnonzero(hot[self.which])
        sizes = self.ends[split] - self.starts[split]
        single = _spread(self.starts[split], sizes)
        start = np.r_[self.starts[whole], single]
        end = np.r_[self.ends[whole] + LENGTH - 1, single + LENGTH]
        docs = np.r_[self.docs[whole], np.repeat(self.docs[split], sizes)]
        order = np.lexsort((start, docs))
        every = pa.array([self.buf[a:b].tobytes() for a, b in zip(start[order], end[order], strict=True)], pa.large_binary())
        coded = every.dictionary_encode()
        of = np.empty(len(order), np.int64)
        of[order] = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, of, self.ids[docs])
        # A hot piece goes by its own hash, others by their anchor.
        route = np.empty(len(first), np.uint64)
        route[of[: len(whole)]] = self.names[whole] << np.uint64(64 - bits)
        alone = np.unique(of[len(whole) :])
        if len(alone):
            buf = textops.utf8(coded.dictionary.take(pa.array(alone)))[0].reshape(-1, LENGTH)
            route[alone] = textops.mix64(((buf.astype(np.uint64) + np.uint64(1)) * _powers(LENGTH)[0]).sum(axis=1, dtype=np.uint64))
        return coded.dictionary, first, route, of, start, docs


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``n`` places for each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _cuts(name: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part, a range of names, begins and the last one ends."""
    edges = [(k << bits) // parts for k in range(1, parts)]
    return np.r_[0, np.searchsorted(name, np.array(edges, np.uint64)), len(name)].astype(np.int64)


def _counted(chunk: int, of: Chunk, bits: int, parts: int) -> pa.Table:
    cuts, many = _cuts(of.known, bits, parts), of.many()
    full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
    return pa.table({
        "part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()),
        "names": pa.array([encode(of.known[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
        "flags": pa.array([np.packbits(np.r_[of.several[cuts[k] : cuts[k + 1]], many[cuts[k] : cuts[k + 1]]]).tobytes() for k in full], pa.binary()),
    })


def _shared(table: pa.Table, hot: int) -> pa.Table:
    """All chunks' names of a part together -> for each chunk which of its names are shared, and which are hot."""
    lists = [decode(b) for b in table.column("names").to_pylist()]
    several, many = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(x)).reshape(2, -1) for f, x in zip(table.column("flags").to_pylist(), lists, strict=True)], axis=1)
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.r_[True, every[order[1:]] != every[order[:-1]]])
    times = np.diff(np.r_[starts, len(every)])
    out = np.empty((2, len(every)), bool)
    out[0, order] = np.repeat((times > 1) | (np.maximum.reduceat(several[order], starts) > 0), times)
    crowded = np.add.reduceat(many[order].astype(np.int64), starts) > hot
    out[1, order] = np.repeat(crowded | (times > MANY * hot), times)
    ends = np.cumsum([0, *map(len, lists)])
    pairs = [np.packbits(out[:, a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "stage": pa.array([1] * len(lists), pa.int32()), "part": table.column("part"), "bits": pa.array(pairs, pa.binary())})


def _flags(table: pa.Table, of: Chunk, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(shared, hot) of each name of the chunk."""
    cuts, out = _cuts(of.known, bits, parts), np.zeros((2, len(of.known)), bool)
    for stage, k, b in zip(*(table.column(c).to_pylist() for c in ("stage", "part", "bits")), strict=True):
        if stage == 1:
            n = int(cuts[k + 1] - cuts[k])
            out[:, cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=2 * n).reshape(2, n)
    return out[0], out[1]


def _routed(route: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pieces by part, where each part begins and the last one ends)."""
    order = np.argsort(route, kind="stable")
    return order, _cuts(route[order], 64, parts)


def _dealt(chunk: int, of: Chunk, flags: tuple[np.ndarray, np.ndarray], bits: int, parts: int) -> pa.Table:
    pieces, first, route, *_ = of.pieces(*flags, bits)
    order, cuts = _routed(route, parts)
    full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
    table = pa.table({"piece": pieces, "first": first})
    blobs = [packed(table.take(pa.array(order[cuts[k] : cuts[k + 1]]))) for k in full]
    return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "pieces": pa.array(blobs, pa.binary())})


def _word(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Up to eight bytes at each position as numbers whose order is theirs."""
    eight = np.zeros((len(at), 8), np.uint8)
    eight[:, :width] = np.lib.stride_tricks.sliding_window_view(buf, width)[at]
    return eight.view(">u8").ravel().astype(np.uint64)


def _order(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the ``width`` bytes at each position, whether each differs from the one before in order); bytes beyond the first eight are read of ties only."""
    first = _word(buf, at, min(8, width))
    order = np.argsort(first, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    for k in range(8, width, 8):
        group = np.cumsum(new) - 1
        tied = np.bincount(group, minlength=1)[group] > 1
        some, group = order[tied], group[tied]
        if not len(some):
            break
        word = _word(buf, at[some] + k, min(8, width - k))
        inner = np.lexsort((word, group))
        order[tied], word = some[inner], word[inner]
        new[tied] = np.r_[True, (word[1:] != word[:-1]) | (group[1:] != group[:-1])]
    return order, new


def _sample_ranks(buf: np.ndarray, sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each place, for sampled ones; by rank, how many of the first LENGTH bytes a sample has in common with the one before)."""
    rank = np.zeros(len(buf), np.int32)
    order, _ = _order(buf, sampled, LENGTH)
    rank[sampled[order]] = np.arange(len(order), dtype=np.int32)
    common = np.zeros(len(order), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    for at in range(1, len(order), BUCKET):
        upto = min(len(order), at + BUCKET)
        same = view[sampled[order[at:upto]]] == view[sampled[order[at - 1 : upto - 1]]]
        common[at:upto] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    return rank, common


def least_ids(text: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position of the texts at which LENGTH bytes begin, the least id of a text that holds them; elsewhere the text's own.

    Blockwise suffix sorting: cover samples are ranked, then a bucket of suffixes at a time is sorted by V
    bytes, and what ties there is told apart by the ranks.
    """
    sizes = np.diff(offsets)
    ids, own_id = np.unique(first, return_inverse=True)
    out = np.repeat(own_id.astype(np.int32), sizes)
    buf = np.r_[text, np.zeros(LENGTH, np.uint8)]
    left = np.repeat(offsets[1:].astype(np.int32), sizes) - np.arange(len(text), dtype=np.int32)
    residue = (np.arange(len(text), dtype=np.int32) % V).astype(np.int8)
    served = np.isin(np.arange(V), COVER)
    # A sample serves suffixes of LENGTH bytes that begin up to V - 1 before it.
    sampled = np.flatnonzero(served[residue] & (left > LENGTH - V)).astype(np.int32)
    suffixes = np.flatnonzero(left >= LENGTH).astype(np.int32)
    del left
    lead = buf[suffixes].astype(np.uint16) << np.uint16(8) | buf[suffixes + 1]
    suffixes = suffixes[np.argsort(lead, kind="stable")]
    ends = np.cumsum(np.bincount(lead, minlength=1 << 16))
    ties, groups, at, number = [suffixes[:0]], [np.zeros(0, np.int32)], 0, 0
    while at < len(suffixes):
        # Buckets end between leading bytes; one pair of bytes may exceed a bucket's size.
        upto = int(ends[np.searchsorted(ends, min(at + BUCKET, len(suffixes)))])
        order, new = _order(buf, suffixes[at:upto], V)
        group = np.cumsum(new, dtype=np.int32)
        tied = np.bincount(group)[group] > 1
        ties.append(suffixes[at:upto][order[tied]])
        groups.append(group[tied] + np.int32(number))
        number, at = number + len(order), upto
    own, group = np.concatenate(ties), np.concatenate(groups)
    del suffixes, lead, ties, groups
    rank, common = _sample_ranks(buf, sampled)
    least = out[own]
    for o in range(V):
        # Samples of one class agree for the rest of LENGTH bytes, and the suffixes before them for the first V.
        alike = np.cumsum(common < LENGTH - o, dtype=np.int32)
        some = np.flatnonzero(served[(residue[own] + o) % V])
        key = group[some].astype(np.uint64) << np.uint64(32) | alike[rank[own[some] + o]].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]][: len(key)])
        if len(starts):
            found = np.minimum.reduceat(out[own[some[order]]], starts)
            # Equal suffixes share an offset with the one of least id, so one look at each offset is enough.
            least[some[order]] = np.minimum(least[some[order]], np.repeat(found, np.diff(np.r_[starts, len(key)])))
    out[own] = least
    return ids[out] if len(ids) else first


def _sorted(table: pa.Table) -> pa.Table:
    """All chunks' pieces of a part together -> for each chunk which suffixes of its pieces start in an id below the piece's."""
    blobs = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("pieces").combine_chunks()]
    coded = pa.concat_arrays([c for b in blobs for c in b.column("piece").chunks]).dictionary_encode()
    of = coded.indices.to_numpy()
    own = np.concatenate([b.column("first").to_numpy() for b in blobs])
    first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(first, of, own)
    buf, offsets = textops.utf8(coded.dictionary)
    least = least_ids(buf, offsets, first)
    sizes = np.diff(offsets)[of] - LENGTH + 1
    rows = np.cumsum([0, *(b.num_rows for b in blobs)])
    bits = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        place = _spread(offsets[of[a:b]], sizes[a:b])
        bits.append(np.packbits(least[place] < np.repeat(own[a:b], sizes[a:b])).tobytes())
    return pa.table({"chunk": table.column("chunk"), "stage": pa.array([2] * len(blobs), pa.int32()), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def _removed(chunk: Chunk, table: pa.Table, bits: int, counters: int, sorters: int, texts: bool) -> pa.Table:
    pieces, first, route, of, start, docs = chunk.pieces(*_flags(table, chunk, bits, counters), bits)
    order, cuts = _routed(route, sorters)
    sizes = pc.binary_length(pieces).to_numpy() - LENGTH + 1
    # Where each piece's bits begin among those of all pieces in order.
    begins = np.empty(len(order), np.int64)
    begins[order] = np.cumsum(sizes[order]) - sizes[order]
    earlier = np.zeros(int(sizes.sum()), bool)
    for stage, k, b in zip(*(table.column(c).to_pylist() for c in ("stage", "part", "bits")), strict=True):
        if stage == 2:
            own = order[cuts[k] : cuts[k + 1]]
            n = int(sizes[own].sum())
            earlier[begins[own[0]] : begins[own[0]] + n] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
    n = sizes[of]
    at, place = _spread(start, n), _spread(begins[of], n)
    gone = earlier[place] | np.repeat(chunk.ids[docs] > first[of], n)
    at, docs = at[gone], np.repeat(docs, n)[gone]
    order = np.argsort(at, kind="stable")
    at, docs = at[order], docs[order]
    new = np.r_[True, (at[1:] > at[:-1] + LENGTH) | (docs[1:] != docs[:-1])] if len(at) else np.zeros(0, bool)
    starts, of = at[new], docs[new]
    ends = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + LENGTH if len(at) else at
    cuts = np.searchsorted(of, np.arange(len(chunk.ids) + 1))
    digests, kept, begin, end, removed = [], [], [], [], []
    for d in range(len(chunk.ids)):
        lo, hi = int(chunk.offsets[d]), int(chunk.offsets[d + 1])
        s, e = starts[cuts[d] : cuts[d + 1]], ends[cuts[d] : cuts[d + 1]]
        rest = b"".join(chunk.buf[a:b].tobytes() for a, b in zip(np.r_[lo, e], np.r_[s, hi], strict=True))
        digests.append(hashlib.sha256(rest).hexdigest())
        removed.append(int((e - s).sum()))
        begin.append(s - lo)
        end.append(e - lo)
        kept.append(rest if texts else None)
    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "n_bytes": pa.array(np.diff(chunk.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(cuts), pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "starts": lists(begin), "ends": lists(end), "kept": pa.array(kept, pa.binary())})


def strip(docs: DataFrame, texts: bool = False, chunk_bytes: int = CHUNK, counted_bytes: int = COUNTED, sorted_bytes: int = SORTED, hot: int = HOT) -> DataFrame:
    """docs with doc_id and text (any others) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, kept.

    One row for each input row. starts and ends are the removed runs in bytes, kept the rest (null unless
    ``texts``). A null text is empty; texts under LENGTH bytes lose nothing. Rows that share an id are all
    judged against smaller ids. A null doc_id is smaller than none and loses nothing. A task holds a chunk
    of documents, dealt by a hash so that all have about ``chunk_bytes``, or the names or pieces of a range
    of anchors: memory follows their sizes, or one text if it is longer. Anchors in more than ``hot`` chunks
    are dealt by the bytes of their suffixes.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chunks, counters, sorters = (max(1, -(-total // x)) for x in (chunk_bytes, counted_bytes, sorted_bytes))
    bits = min(64, max(16, int(2 * total / SPAN).bit_length() + SPARE))
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("chunk").to_numpy()
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.r_[True, of[order[1:]] != of[order[:-1]], True]) if len(of) else [0]
            some = pa.Table.from_batches([batch.select(["doc_id", "text"])]).take(pa.array(order))
            blobs = [packed(some.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(of[order[cuts[:-1]]] if len(of) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "docs"])

    parts = dealt.mapInArrow(pack, "chunk long, docs binary")
    back = "chunk long, stage int, part int, bits binary"

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _counted(key[0].as_py(), Chunk(table, bits), bits, counters)

    def deal(key: tuple[pa.Scalar, ...], table: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = Chunk(table, bits)
        return _dealt(key[0].as_py(), chunk, _flags(flags, chunk, bits, counters), bits, sorters)

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, flags: pa.Table) -> pa.Table:
        return _removed(Chunk(table, bits), flags, bits, counters, sorters, texts)

    shared = parts.groupBy("chunk").applyInArrow(count, "part int, chunk long, names binary, flags binary").groupBy("part").applyInArrow(lambda table: _shared(table, hot), back)
    pieces = parts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(deal, "part int, chunk long, pieces binary")
    earlier = pieces.groupBy("part").applyInArrow(lambda table: _sorted(table), back)
    out = parts.groupBy("chunk").cogroup(shared.unionByName(earlier).groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary")
    none = F.array().cast("array<long>")
    rest = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"), F.when(F.lit(texts), body).alias("kept"))
    return out.unionByName(rest)
