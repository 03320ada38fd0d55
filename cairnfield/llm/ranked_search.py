r"""Operator 12, ranked lexical search: reversed, with the queries indexed and the documents streamed.

The items' terms make an inverted index (term: its weight and the items that have it), which is broadcast; every document's term counts run through it
once, and its scores meet a heap of the best K documents of each item. A task ends with at most K rows an item; the tasks' heaps are then merged.
A pass before counts the documents, their terms and the documents of each indexed term.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 10 + 90 n N div L, its score the sum over an item's terms of
weight * (10^9 tf div (1000 tf + 8 m)), in 64-bit integers (see `scored`).

The index is broadcast up to BLOCK postings. More items are dealt to blocks by hash, and the documents are streamed for each block: memory is bounded by BLOCK, or by
one item's own terms where it has more, and time grows with documents times blocks. Cells of documents by postings are
worked on CELLS at once. A text is read whole; one very long text is one slice.

Null and empty texts have no terms: such documents count for nothing and are not ranked, such items have no rows. Rows of one item_id (null is an id of its
own) are one item with all their terms. Every document row counts and is ranked, repeated ones too; equal scores go by rising doc_id,
null ids last. Empty tables give no rows. Other columns are ignored, whatever their names. Terms are told apart by 64-bit hashes, and items' terms by
their strings: two of them with one hash are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cairnfield.llm import decontaminate, rows, vec
from cairnfield.session import cut, ship

K, BLOCK, CELLS, WIDE = 10, 2_000_000, 4_000_000, 1000
#: Cells of the counts that hold the documents with terms, and all terms.
DOCS, TERMS = -1, -2


class Index:
    """The inverted index of a block of items: sorted hashes of terms, and the items of each, as ranges of `items`."""

    def __init__(self, postings: pa.Table):
        ids, terms = postings["item_id"].combine_chunks().dictionary_encode("encode"), postings["term"].combine_chunks().dictionary_encode()
        self.ids = ids.dictionary
        texts = vec.flat(terms.dictionary)
        data, offsets = vec.buffers(texts)
        hashes = vec.ranges(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hash = hashes[order]
        if len(self.hash) > 1 and (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of the items share a hash")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of = place[terms.indices.to_numpy()]
        by_term = np.argsort(of, kind="stable")
        self.items = ids.indices.to_numpy()[by_term].astype(np.int64)
        self.first = np.searchsorted(of[by_term], np.arange(len(order) + 1))
        self.docs = self.terms = 0
        self.weight = np.zeros(len(order), np.int64)

    def weigh(self, counts: pa.Table) -> None:
        """Takes the counts of the first pass: cell, n."""
        n = dict(zip(counts["cell"].to_pylist(), counts["n"].to_pylist(), strict=True))
        self.docs, self.terms = n.get(DOCS, 0), n.get(TERMS, 0)
        self.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(self.hash))], np.int64)

    def found(self, words: vec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences of the indexed terms in each text, by text."""
        at = np.searchsorted(self.hash, words.hash)
        at[at == len(self.hash)] = 0
        hit = self.hash[at] == words.hash
        pair, tf = np.unique(words.text()[hit] * len(self.hash) + at[hit], return_counts=True)
        return pair // len(self.hash), pair % len(self.hash), tf

    def scored(self, words: vec.Words) -> Iterator[tuple[int, np.ndarray]]:
        """The first text and the scores, a row a text and a column an item, of some of the texts at a time."""
        text, term, tf = self.found(words)
        m = np.array([10 + 90 * n * self.docs // self.terms for n in words.count.tolist()], np.int64)
        gain = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
        size = np.diff(self.first)[term]
        step, width = max(1, CELLS // max(1, len(self.items))), len(self.ids)
        for lo in range(0, len(words.count), step):
            hi = min(len(words.count), lo + step)
            a, b = np.searchsorted(text, [lo, hi])
            if a == b:
                continue
            sizes = size[a:b]
            # the postings of each text's terms, one after another
            posting = np.arange(sizes.sum()) + np.repeat(self.first[term[a:b]] - (np.cumsum(sizes) - sizes), sizes)
            score = np.zeros((hi - lo) * width, np.int64)
            np.add.at(score, np.repeat((text[a:b] - lo) * width, sizes) + self.items[posting], np.repeat(gain[a:b], sizes))
            yield lo, score.reshape(-1, width)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[vec.Words, pa.RecordBatch]]:
    for batch in batches:
        texts = vec.flat(batch.column("text"))
        for lo, hi in vec.slices(texts):
            yield vec.Words(texts.slice(lo, hi - lo), lower=True, within=vec.ALNUM), batch.slice(lo, hi - lo)


def _counted(docs: DataFrame, kept) -> DataFrame:
    """cell and n: the documents of each indexed term, all documents with terms, and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, some, all_ = kept.value, 0, 0
        df = np.zeros(len(index.hash), np.int64)
        for words, _ in _words(batches):
            df += np.bincount(index.found(words)[1], minlength=len(df))
            some += int((words.count > 0).sum())
            all_ += int(words.count.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"cell": pa.array([DOCS, TERMS, *seen], pa.int64()), "n": pa.array([some, all_, *df[seen]], pa.int64())})

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _best(docs: DataFrame, kept, k: int, item_type) -> DataFrame:
    """item_id, doc_id, score: the best k of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept.value
        # heaps of (score, -doc_id), the worst first; least: what a document must reach
        heaps: list[list] = [[] for _ in range(len(index.ids))]
        least = np.ones(len(heaps), np.int64)
        for words, part in _words(batches):
            ids = part.column("doc_id").to_pylist()
            for lo, scores in index.scored(words):
                for text, item in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
                    heap, doc = heaps[item], ids[lo + text]
                    entry = (int(scores[text, item]), -math.inf if doc is None else -doc)
                    if len(heap) < k:
                        heappush(heap, entry)
                    elif entry > heap[0]:
                        heapreplace(heap, entry)
                    if len(heap) == k:
                        least[item] = heap[0][0]
        flat = [(item, score, doc) for item, heap in enumerate(heaps) for score, doc in heap]
        yield pa.RecordBatch.from_pydict({
            "item_id": index.ids.take(pa.array([x[0] for x in flat], pa.int64())),
            "doc_id": pa.array([None if x[2] == -math.inf else -x[2] for x in flat], pa.int64()),
            "score": pa.array([x[1] for x in flat], pa.int64()),
        })

    schema = StructType([StructField("item_id", item_type), StructField("doc_id", LongType()), StructField("score", LongType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def merged(found: DataFrame, k: int, parts: int) -> DataFrame:
    """item_id, rank, doc_id, score from the heaps of `parts` tasks; many tasks' heaps are merged in groups first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    if parts > WIDE:
        groups = math.isqrt(parts)
        some = Window.partitionBy("item_id", "_part").orderBy(*order)
        found = found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(groups))).withColumn("_rank", F.row_number().over(some)).filter(F.col("_rank") <= k).drop("_part", "_rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast(IntegerType()))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's (item_id, text) k best documents (doc_id, text) with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    postings = cut(items.select("item_id", F.explode(decontaminate.words(F.col("text"))).alias("term")).distinct())
    blocks, parts = max(1, math.ceil(postings.count() / block)), docs.rdd.getNumPartitions()
    found = []
    for b in range(blocks):
        index = Index(postings.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow())
        if len(index.ids):
            index.weigh(_counted(docs, spark.sparkContext.broadcast(index)).toArrow())
            if index.terms:
                found.append(_best(docs, spark.sparkContext.broadcast(index), k, items.schema["item_id"].dataType))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return merged(reduce(DataFrame.unionByName, found), k, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(rows.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d
), t AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
