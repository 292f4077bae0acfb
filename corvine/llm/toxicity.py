"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm import textops
from corvine.llm.tables import held_out

BITS = 20
#: A word also counts by its first bytes, so that unseen compounds of a known stem are recognised.
STEMS = (5, 6, 7)
#: At most so many labelled rows are learned from, those with the lowest hash of their id; each gives its whole text.
MAX_LABELLED = 8000


def grams(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of each word, its stems, word pair and pair that skips one word."""
    _, _, doc, h, *stems = textops.words(buf, offsets, STEMS)
    shift = np.uint64(64 - bits)
    docs, feats = [doc] * (1 + len(STEMS)), [x >> shift for x in (textops.mix64(h, 1), *stems)]
    for skip in (1, 2):
        if len(h) > skip:
            same = doc[skip:] == doc[:-skip]
            pair = h[:-skip][same] * np.uint64(0xC2B2AE3D27D4EB4F) + h[skip:][same]
            docs.append(doc[skip:][same])
            feats.append(textops.mix64(pair, 1 + skip) >> shift)
    return np.concatenate(docs), np.concatenate(feats).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, *, alpha=0.6, beta=1.0, l1=8.0, l2=0.1, epochs=6, seed=7) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the coordinates that L1 leaves; per-coordinate learning rates."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f = rows[i]
            w = weight(z[f], n[f])
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - labels[i]
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - s * w
            n[f] += g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sb * wb
            nb += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(-zb / ((beta + np.sqrt(nb)) / alpha))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from labelled documents outside the held-out fifth.

    ``labels`` has doc_id and toxic; rows with a null are dropped, a repeated id counts once with its
    highest label and, of several texts, the one whose features come first. One task gets at most ``max_labelled`` rows of at most 2**BITS distinct features each. No usable label at all gives a model that scores one half less a hair everywhere.
    """
    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in textops.lowered(batch.column("text")):
                doc, feat = grams(buf, offsets)
                flat = np.unique((doc << BITS) | feat)
                doc, feat = flat >> BITS, (flat & ((1 << BITS) - 1)).astype(np.int32)
                cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(feat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), lists], names=["doc_id", "label", "feats"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in batches:
            cuts, flat = batch.column("feats").offsets.to_numpy(), batch.column("feats").values.to_numpy()
            for i, (key, label) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                own = flat[cuts[i] : cuts[i + 1]]
                if key not in seen or own.tobytes() < seen[key][1].tobytes():
                    seen[key] = (label, own)
        labels = np.array([seen[k][0] for k in sorted(seen)], float)
        if len(set(labels)) < 2:
            found = np.zeros(0, np.int64), np.zeros(0), 0.0 if not len(labels) else 8 * labels[0] - 4
        else:
            found = ftrl([seen[k][1] for k in sorted(seen)], labels)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found[0]], pa.int32()), pa.array([found[2] if len(labels) else -1e-3, *found[1]], pa.float64())], names=["feature", "weight"])

    # One task holds the bounded sample; only the sparse weights reach the driver.
    features = rows.mapInArrow(featurise, f"doc_id {dict(rows.dtypes)['doc_id']}, label int, feats array<int>")
    model = features.repartition(1).mapInArrow(learn, "feature int, weight double").toArrow()
    keys, weights = model.column("feature").to_numpy(), model.column("weight").to_numpy()
    return keys[keys >= 0].astype(np.int64), weights[keys >= 0], float(weights[keys < 0].sum()) if len(keys) else -1e-3


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """docs (any columns) -> doc_id, held_out, score, predicted; one row for each input row.

    A null or empty text gets the bias alone. Only text decides; each distinct feature counts once.
    The weights, at most 2**BITS of them, travel with the tasks.
    """
    judge = _judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in judge(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of docs, columns as they are, without those that are predicted toxic."""
    judge = _judge(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in judge(batches):
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _judge(model: tuple[np.ndarray, np.ndarray, float]):
    """Batches with a text -> (batch, probabilities)."""
    kept, weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        dense = np.zeros(1 << BITS)
        dense[kept] = weights
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for lo, hi, buf, offsets in textops.lowered(batch.column("text")):
                doc, feat = grams(buf, offsets)
                hit = dense[feat] != 0
                flat = np.unique((doc[hit] << BITS) | feat[hit])
                total[lo:hi] += np.bincount(flat >> BITS, dense[flat & ((1 << BITS) - 1)], minlength=hi - lo)
            yield batch, 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return run
