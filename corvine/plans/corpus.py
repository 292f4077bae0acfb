"""From a source tree or a table of raw texts to a filtered corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.session import cut
from corvine.functions.text import line_density
from corvine.sources.files import scan_tree, write_jsonl

MAX_BYTES, PROBE_BYTES, DENSITY, LINES, MARK = 4 << 20, 8192, 0.60, 500, "#define"


def generated(text: Column, prefix: str = MARK, density: float = DENSITY, least: int = LINES) -> Column:
    d = line_density(text, prefix)
    return (d["n"] >= least) & (d["ratio"] >= density)


def disposition(unreadable: Column, size: Column, head: Column, text: Column, *, max_bytes: int = MAX_BYTES, prefix: str = MARK, density: float = DENSITY, least: int = LINES) -> Column:
    """The first that applies: unreadable, oversized, binary (a NUL in the first bytes), generated, kept."""
    return (
        F.when(unreadable, "unreadable").when(size > max_bytes, "oversized")
        .when(F.position(F.lit(bytearray(1)), F.substring(head, 1, PROBE_BYTES)) > 0, "binary")
        .when(generated(text, prefix, density, least), "generated").otherwise("kept")
    )


def judged(files: DataFrame, **limits) -> DataFrame:
    """files (path, length, content) -> path, disposition, length, text: decoded with U+FFFD for what isn't UTF-8, null unless kept."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.withColumn("text", text).withColumn("disposition", disposition(F.col("content").isNull(), F.col("length"), F.col("content"), F.col("text"), **limits))
    return rows.select("path", "disposition", "length", F.when(F.col("disposition") == "kept", F.col("text")).alias("text"))


def build(spark: SparkSession, root: str, out: str, **limits) -> DataFrame:
    """Reads a source tree, writes path and text of what is kept as JSON lines to ``out`` -> the summary of all files."""
    rows = cut(judged(scan_tree(spark, root), **limits))
    write_jsonl(rows.filter("disposition = 'kept'").select("path", "text"), out)
    return summary(rows)


def summary(rows: DataFrame) -> DataFrame:
    """disposition, n, chars."""
    return rows.groupBy("disposition").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
