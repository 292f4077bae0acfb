"""Language ID: error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm import textops
from corvine.llm.tables import BROADCAST_ROWS, cut, held_out

DIM = 4096
#: Learned from at most so many documents in all, shared evenly among the languages, about those with the lowest hash of their id.
MAX_LABELLED = 4000
#: Below this probability of the nearest codeword a prediction is flagged as ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of -1 and 1: all splits for up to 7 languages, else the best of 64 random books by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = np.arange(1, 2 ** (n - 1))
        return np.array([[1.0 if row == 0 or not (c >> (row - 1)) & 1 else -1.0 for c in columns] for row in range(n)])
    rng, bits = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n)))
    books = (rng.choice([-1.0, 1.0], (n, bits)) for _ in range(64))
    return max(books, key=lambda m: (bits - (m @ m.T - 2 * bits * np.eye(n))).min())


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a Unicode letter."""
    ascii_letter = np.zeros(256, np.int8)
    ascii_letter[65:91] = ascii_letter[97:123] = 1
    out = np.zeros(len(offsets) - 1, bool)
    for i in range(len(out)):
        raw = buf[offsets[i] : offsets[i + 1]]
        out[i] = ascii_letter[raw].any() or (raw >= 128).any() and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return out


def vectors(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of root counts of hashed byte pairs and triples; what isn't a letter counts as a space."""
    fold = np.full(256, 32, np.uint32)
    for b in (*range(97, 123), *range(128, 256)):
        fold[b] = b
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    for i in range(len(out)):
        row = out[i]
        for at in range(int(offsets[i]), int(offsets[i + 1]), textops.BLOCK):
            c = fold[buf[at : min(int(offsets[i + 1]), at + textops.BLOCK + 2)]]
            pair = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
            triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
            for x in (pair, triple):
                row += np.bincount((x ^ (x >> np.uint32(15))) >> np.uint32(5) & np.uint32(DIM - 1), minlength=DIM)
    out[:, :] = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    """All bits at once by accelerated gradient descent on the logistic loss; classes count alike."""
    codes = codebook(len(languages))
    goal = codes[y]
    each = (1 / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y][:, None] / max(1, len(languages))
    w, b = np.zeros((DIM, codes.shape[1])), np.zeros(codes.shape[1])
    vw, vb, rate, decay = w.copy(), b.copy(), 8.0, 1e-5
    x = x.astype(np.float32)
    for t in range(steps):
        aw, ab = w + 0.9 * vw, b + 0.9 * vb
        g = -goal / (1 + np.exp(np.clip(goal * (x @ aw.astype(np.float32) + ab), -35, 35))) * each
        g = g.astype(np.float32)
        vw, vb = 0.9 * vw - rate * (x.T @ g + decay * aw), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = (goal * (x @ w + b) > 0).astype(float)
    trust = np.array([right[y == k].mean(0) if (y == k).any() else np.ones(codes.shape[1]) for k in range(len(languages))]) + 1e-3
    return Model(languages, codes, w.astype(np.float32), b, trust / trust.sum(1, keepdims=True))


def decode(m: Model, margins: np.ndarray) -> np.ndarray:
    """Probabilities of the languages: nearest codeword by loss, each bit weighted by how it does for that language; of equals the first language wins."""
    loss = np.stack([np.logaddexp(0, -margins * code) @ t for code, t in zip(m.codes, m.trust, strict=True)], axis=1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * m.codes.shape[1])
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from text and lang outside the held-out fifth; nulls are left out, and so are texts without a letter.

    An id that comes with several languages or texts counts once, with the least language and the text whose vector comes first.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("size")))
    languages = sizes.count()
    each = max(20, max_labelled // max(1, languages))
    few = F.broadcast(sizes) if languages <= BROADCAST_ROWS else sizes
    # A lot by hash thins large languages to about twice what is wanted before rows of one language meet.
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = rows.select("doc_id", "lang", lot.alias("lot")).join(few, "lang").filter(F.col("lot") < F.lit(2.0 * each * (1 << 30)) / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id"))
    ids = some.withColumn("rank", rank).filter(F.col("rank") <= each).select("doc_id", "lang")
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part, cuts in textops.lowered(batch.column("text"), 4 * textops.BLOCK):
                ok = has_letter(part, cuts)
                v = vectors(part, cuts).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array([x.tobytes() if k else None for x, k in zip(v, ok, strict=True)], pa.binary())], names=["doc_id", "lang", "v"])

    seen = picked.mapInArrow(featurise, f"doc_id {dict(picked.dtypes)['doc_id']}, lang string, v binary").filter("v IS NOT NULL").toArrow()
    seen = seen.sort_by([("doc_id", "ascending"), ("v", "ascending")])
    seen = seen.take(np.unique(seen.column("doc_id").to_numpy(), return_index=True)[1])
    known = np.array(seen.column("lang").to_pylist(), object)
    languages = sorted(set(known))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1), np.ones((0, 1)))
    x = np.frombuffer(textops.utf8(seen.column("v"))[0], np.float16).reshape(-1, DIM)
    return train(x, np.array([languages.index(k) for k in known]), languages)


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """docs (any columns) -> doc_id, held_out, lang_pred, score, ambiguous; one row for each input row.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0, as is
    everything if nothing was learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for lo, hi, part, cuts in textops.lowered(batch.column("text"), 4 * textops.BLOCK) if m.languages else []:
                p = decode(m, vectors(part, cuts) @ m.weights + m.bias)
                ok = has_letter(part, cuts)
                best[lo:hi] = np.where(ok, p.argmax(1), -1)
                score[lo:hi] = np.where(ok, p.max(1), 0.0)
            names = np.array([*m.languages, UNDETERMINED], object)[best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")
