"""Retrievable units of a corpus: definitions, or overlapping line windows where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.session import cut
from corvine.functions.text import lines
from corvine.operators.csource import extract_definitions

WINDOW, STRIDE, LEAST_CHARS = 60, 45, 60


def window_chunks(corpus: DataFrame, size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """corpus (path, text) -> path, name, kind, code, line: windows of ``size`` lines, blank ones left out.

    The first window that reaches the end of the text is its last.
    """
    rows = corpus.select("path", lines(F.col("text")).alias("rows"))
    starts = rows.select("path", "rows", F.explode(F.sequence(F.lit(0), F.greatest(F.size("rows") - 2, F.lit(0)), F.lit(stride))).alias("at"))
    needed = starts.filter((F.col("at") == 0) | (F.col("at") - stride + size < F.size("rows")))
    block = needed.select("path", F.array_join(F.slice("rows", F.col("at") + 1, size), "\n").alias("code"), (F.col("at") + 1).alias("line"))
    base = F.element_at(F.split("path", "/"), -1)
    return block.filter(F.col("code").rlike(r"(?U)\S")).select("path", F.concat(base, F.lit(":"), F.col("line").cast("string")).alias("name"), F.lit("window").alias("kind"), "code", "line")


def chunk(corpus: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Definitions of each file, or its windows if it has none; short chunks go last, so a file may yield nothing."""
    found = cut(extract_definitions(corpus))
    bare = corpus.join(found.select("path").distinct(), "path", "left_anti")
    return found.unionByName(window_chunks(bare)).filter(F.length("code") >= least_chars)
