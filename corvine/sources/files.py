"""Readers and writers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvine.functions.session import cut

SUFFIXES, SKIPPED = (".c", ".h"), {".git", ".github"}
CORPUS = "path string, text string"
PAIRS = "ord long, path string, name string, kind string, anchor string, positive string, negative string"
CHUNKS = "chunk_id long, path string, name string, kind string, code string, line int"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (from the root), file of every C source below ``root``: tasks list the folders of one depth after another."""

    def entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for folder in part.file:
                try:
                    with os.scandir(folder) as each:
                        for e in each:
                            if e.is_dir(follow_symlinks=False):
                                found += [(e.path, True)] if e.name not in SKIPPED else []
                            elif e.name.endswith(SUFFIXES) and e.is_file(follow_symlinks=False):
                                found.append((e.path, False))
                except OSError:
                    continue  # a folder that went away or can't be read holds no sources
            yield pd.DataFrame(found, columns=["file", "folder"])

    now, out = spark.createDataFrame([(root,)], "file string"), None
    while True:
        level = cut(now.mapInPandas(entries, "file string, folder boolean"))
        files = level.filter("NOT folder").select("file")
        out = files if out is None else out.unionByName(files)
        now = level.filter("folder").select("file").repartition("file")
        if not now.limit(1).count():
            break
    return out.select(F.substring("file", len(root.rstrip("/")) + 2, 1 << 30).alias("path"), "file")


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """path (from the root), length, content of every C source below ``root``; names with a leading dot or underscore count.

    Links and the skipped folders are left out. Tasks list names and read contents, so the tree must be
    mounted alike everywhere. Content is null if it can't be read and empty if it is over ``max_bytes``.
    For stores that only Spark reads there is ``scan_store``.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, contents = [], []
            for p in part.file:
                try:
                    size = os.stat(p).st_size
                    data = Path(p).read_bytes() if size <= max_bytes else b""
                except OSError:
                    size, data = 0, None
                sizes.append(size)
                contents.append(data)
            yield pd.DataFrame({"path": part.path, "length": sizes, "content": contents})

    return list_tree(spark, root).repartition("path").mapInPandas(read, "path string, length long, content binary")


def scan_store(spark: SparkSession, root: str, max_bytes: int = 4 << 20) -> DataFrame:
    """As ``scan_tree`` by Spark's own reader; it leaves out names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h}").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").replace("file:", "").replace(".", r"\.") + "/", "")
    return files.select(path.alias("path"), "length", F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.lit(b"")).alias("content"))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Blank lines are skipped, a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_batches(docs: DataFrame, size: int = 1000, text: str = "text") -> Iterator[list[str]]:
    """The texts in lists of ``size``, the last maybe shorter, for a consumer outside Spark: the driver holds a partition at a time."""
    batch: list[str] = []
    for row in docs.select(text).toLocalIterator():
        batch.append(row[0])
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, characters beyond ASCII as they are."""
    df.write.mode(mode).json(path)


def load_documents(df: DataFrame, order: str) -> DataFrame:
    """Chunks (code, kind, line) or pairs (positive) alike -> path, name, kind, line, code; the first row of each path and name."""
    from corvine.operators.ordering import first_wins

    has = lambda c, other: F.col(c) if c in df.columns else other
    code = F.coalesce(F.nullif(has("code", F.lit("")), F.lit("")), has("positive", F.lit("")))
    rows = df.select("path", "name", F.coalesce(has("kind", F.lit(None)), F.lit("function")).alias("kind"), F.coalesce(has("line", F.lit(None)), F.lit(0)).alias("line"), code.alias("code"), F.col(order).alias("__ord"))
    return first_wins(rows, [F.col("path"), F.col("name")], [F.col("__ord")]).drop("__ord")


def write_merges(spark: SparkSession, merges: list[tuple[str, str]], path: str) -> None:
    """A trained tokenizer as Parquet: its merges in order, which give the vocabulary as well."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(r.left, r.right) for r in spark.read.parquet(path).orderBy("rank").collect()]


def upsert_index(rows: DataFrame, path: str, version: int) -> None:
    """Appends rows of an index (chunk_id, ...) that replace those of lower versions with the same chunk_id."""
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest version of each chunk_id, or all where none has a version."""
    from corvine.operators.ordering import first_wins

    rows = spark.read.option("mergeSchema", True).parquet(path)
    return first_wins(rows, [F.col("chunk_id")], [F.desc_nulls_last("version")]).drop("version") if "version" in rows.columns else rows


def write_index(chunks: DataFrame, vectors: DataFrame, path: str, code: bool = True, store: str = "parquet") -> None:
    """Chunks and their vectors in one table by chunk_id, so the two can't disagree; a missing vector fails the write.

    ``store`` is any format that Spark writes.
    """
    rows = chunks.join(vectors, "chunk_id", "full_outer")
    rows = rows.withColumn("embedding", F.when(F.col("path").isNull() | F.col("embedding").isNull(), F.raise_error(F.lit("vectors and metadata differ"))).otherwise(F.col("embedding")))
    (rows if code else rows.drop("code")).write.mode("overwrite").format(store).save(path)


def index_info(index: DataFrame) -> DataFrame:
    """One row: vectors, width, bytes of the vectors."""
    return index.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("width"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).alias("vector_bytes"))


def write_tokens(windows: DataFrame, path: str) -> None:
    """Windows of token ids as Parquet, in order of the window within each file."""
    windows.repartitionByRange("window").sortWithinPartitions("window").write.mode("overwrite").parquet(path)


def token_bytes(windows: DataFrame) -> DataFrame:
    """window, ids -> window, data: the ids as little-endian 16-bit numbers, as flat token files hold them."""

    @F.pandas_udf("binary")
    def pack(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: np.asarray(x, "<u2").tobytes())

    return windows.select("window", pack("ids").alias("data"))
