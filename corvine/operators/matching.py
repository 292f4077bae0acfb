"""Which documents hold which passages as they stand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.session import cut

#: Words of a passage's anchor, and passages broadcast at most.
ANCHOR, BROADCAST_ROWS = 5, 200_000


_WORD = re.compile("[A-Za-z0-9]+")


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda x: x != "")


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs (doc_id, text), passages (item_id, passage) -> item_id, doc_id of every document that holds a passage.

    A passage's inner words, all but its first and last, are whole words of any text that holds it. If the
    passages can be broadcast, texts stream past them: a text fetches those whose longest inner word it has.
    Else their first ANCHOR inner words, or the first one where there are fewer, are hash-joined with the
    runs of words of documents. What meets is compared as it stands. Passages without an inner word are
    compared with every document. An empty passage is in every text; null texts and passages match nothing.
    """
    given = cut(passages.filter("passage IS NOT NULL").select("item_id", "passage"))
    if given.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _streamed(docs, given)
    return _joined(docs, given)


def _streamed(docs: DataFrame, passages: DataFrame) -> DataFrame:
    known = passages.toArrow()
    fetched: dict[str, list[tuple[int, str]]] = {}
    for i, passage in enumerate(known.column("passage").to_pylist()):
        inner = _WORD.findall(passage)[1:-1]
        # The empty word stands for every text.
        fetched.setdefault(max(inner, key=len, default=""), []).append((i, passage))
    sent = docs.sparkSession.sparkContext.broadcast((known.column("item_id").combine_chunks(), fetched))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, fetched = sent.value
        for batch in batches:
            item, doc = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for word in fetched.keys() & {"", *_WORD.findall(text)}:
                    found = [i for i, passage in fetched[word] if passage in text]
                    item += found
                    doc += [k] * len(found)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item, pa.int64())), batch.column("doc_id").take(pa.array(doc, pa.int64()))], names=["item_id", "doc_id"])

    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    return texts.mapInArrow(run, f"item_id {dict(passages.dtypes)['item_id']}, doc_id {dict(texts.dtypes)['doc_id']}")


def _joined(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``containing`` where the passages are too many to broadcast."""
    inner = words(F.col("passage"))
    known = passages.select("item_id", "passage", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))).alias("inner"))
    known = cut(known.withColumn("take", F.when(F.size("inner") >= ANCHOR, ANCHOR).otherwise(F.least(F.size("inner"), F.lit(1)))))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    found = texts.join(known.filter("take = 0").select("item_id", "passage"), F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
    for take in (1, ANCHOR):
        anchors = known.filter(F.col("take") == take).select("item_id", "passage", F.array_join(F.slice("inner", 1, take), " ").alias("anchor"))
        row = F.col("words")
        runs = row if take == 1 else F.transform(F.sequence(F.lit(1), F.size(row) - take + 1), lambda i: F.array_join(F.slice(row, i, take), " "))
        each = texts.select("doc_id", words(F.col("text")).alias("words")).filter(F.size("words") >= take).select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor"))
        hits = each.join(anchors.select("item_id", "anchor"), "anchor").select("item_id", "doc_id").distinct()
        pairs = hits.join(anchors.select("item_id", "passage"), "item_id").join(texts, "doc_id")
        found = found.unionByName(pairs.filter(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id"))
    return found
