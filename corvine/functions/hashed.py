"""Hashes of the tokens of arrays, each different token of a batch hashed once. Runs in Python, over Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(tokens: pa.Array, digits: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each array begins, and for every token what ``md5_number`` gives, modulo ``modulus``."""
    offsets = tokens.offsets.to_numpy()
    coded = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    each = np.array([int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest()[:digits], 16) % modulus for t in coded.dictionary.to_pylist()], np.int64)
    return offsets - offsets[0], each[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.int64)


def md5_numbers(tokens: Column, modulus: int, digits: int = 7) -> Column:
    """array<int>: the tokens' ``md5_number`` modulo ``modulus``; null for null. Tokens must not be null."""

    @F.arrow_udf("array<int>")
    def run(tokens: pa.Array) -> pa.Array:
        offsets, numbers = _numbers(tokens, digits, modulus)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers.astype(np.int32)), mask=tokens.is_null())

    return run(tokens)


def md5_counts(tokens: Column, width: int, digits: int = 7) -> Column:
    """array<double>: how many tokens fall into each of ``width`` bins by ``md5_number``; nulls for null. Tokens must not be null."""

    @F.arrow_udf("array<double>")
    def run(tokens: pa.Array) -> pa.Array:
        offsets, numbers = _numbers(tokens, digits, width)
        rows = np.repeat(np.arange(len(tokens)), np.diff(offsets))
        counts = np.bincount(rows * width + numbers, minlength=len(tokens) * width).astype(np.float64)
        none = np.repeat(tokens.is_null().to_numpy(zero_copy_only=False), width)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * width, pa.int32()), pa.array(counts, mask=none))

    return run(tokens)
