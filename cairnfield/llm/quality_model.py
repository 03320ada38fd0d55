"""Operator 8, quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed n-grams of character classes (how letters are cased, repeated, spaced and punctuated), marks of
how often its words repeat, and its words themselves, lower-cased, hashed to WORDS cells and weighted by how rare they are in the
labelled sample. Terms are log-weighted; a truncated
singular value decomposition of the labelled sample spans the latent space. The labelled vectors (at most SAMPLE, a
documented bound, chosen by hash from the labelled documents that may teach) are broadcast; every text's cosines with all of them are computed exactly,
a block of texts at a time, and its K nearest neighbours vote with weights of their similarity.

Only the text is looked at when scoring. Null and empty texts score as the plain share of label 1. Where a doc_id has
several labels, their majority counts (1 on a tie); null labels and labels without a document do not teach; null ids do not match labels.
With nothing to learn from, every score is 0.5. Of neighbours with equal cosines (in single precision) those earlier by the hash of their id vote. Very long texts are
taken whole, their terms counted piece by piece. Repeated rows get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import rows, vec
from cairnfield.session import ship

SAMPLE, GRAMS, RANK, K, POWER = 4096, 1024, 64, 15, 8
HELD_OUT = (3, 1)
#: Marks of word statistics, each spread over LEVELS terms.
LEVELS, MARKS = 16, 4
#: Cells of hashed words, and what the words count beside the shape.
WORDS, VOCABULARY = 2048, 0.7
SHAPE = GRAMS + LEVELS * MARKS
TERMS = SHAPE + WORDS
#: Bytes whose grams are counted at a time.
PIECE = 1 << 22

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0x61, 0x41, 0x30, 0x61


def terms(texts: pa.Array) -> np.ndarray:
    """Log-weighted terms, a row a text: shape of length 1 (or 0 for empty texts), marks, and words, which weighed() scales."""
    w = vec.Words(texts, lower=False)
    n, size = len(texts), np.diff(w.offsets)
    out = np.zeros((n, TERMS), np.float32)
    for lo in range(0, len(w.data), PIECE):  # grams begin in the piece and may end in the next
        hi = min(lo + PIECE, len(w.data))
        code = _CLASS[w.data[lo : hi + 3]] * np.uint64(0x9E3779B97F4A7C15)
        bounds = np.clip(w.offsets, lo, lo + len(code))
        owner = np.repeat(np.arange(n), np.diff(bounds))
        for order in (2, 4):
            many = min(hi - lo, len(code) - order + 1)
            if many <= 0:
                continue
            h = code[:many].copy()
            for i in range(1, order):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[i : many + i]
            cell = ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % GRAMS
            whole = owner[:many] == owner[order - 1 : order - 1 + many]
            out[:, :GRAMS] += np.bincount(owner[:many][whole] * GRAMS + cell[whole], minlength=n * GRAMS).reshape(n, GRAMS)
    # shares of one, so that a text's length does not matter
    out[:, :GRAMS] = np.log1p(1000 * out[:, :GRAMS] / np.maximum(size, 1)[:, None])
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    out /= np.maximum(norm, 1e-9)
    count = np.maximum(w.count, 1)
    text = w.text()
    _, first = np.unique(vec.keyed(w.hash, text), return_index=True)
    distinct = np.bincount(text[first], minlength=n) / count ** 0.9
    at, of, hashes = w.windows(2)
    _, first = np.unique(vec.keyed(hashes, of), return_index=True)
    pairs = np.bincount(of[first], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    length = np.bincount(text, w.end - w.start, n) / count / 16
    marks = np.stack([distinct, pairs, length, np.log1p(w.count) / 10], 1)
    level = np.clip(marks * LEVELS, 0, LEVELS - 1.001)
    low = level.astype(int)
    some = np.flatnonzero(w.count)
    for k in range(MARKS):  # between two levels, both count
        out[some, GRAMS + LEVELS * k + low[some, k]] += 0.3 * (1 - (level - low)[some, k])
        out[some, np.minimum(GRAMS + LEVELS * k + low[some, k] + 1, GRAMS + LEVELS * (k + 1) - 1)] += 0.3 * (level - low)[some, k]
    low_ = vec.Words(texts, lower=True)
    cell = (vec.mix(low_.hash) >> np.uint64(40)).astype(np.int64) % WORDS
    out[:, SHAPE:] = np.log1p(np.bincount(low_.text() * WORDS + cell, minlength=n * WORDS).reshape(n, WORDS))
    return out


def weighed(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms with their words by idf, at a length of VOCABULARY."""
    words = found[:, SHAPE:] * idf
    words *= VOCABULARY / np.maximum(np.sqrt((words**2).sum(1, keepdims=True)), 1e-9)
    return np.hstack([found[:, :SHAPE], words])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The latent space, the labelled vectors in it and their labels."""
    spark = docs.sparkSession
    ship(spark)
    taught = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~rows.held_out("doc_id", *HELD_OUT))
    one = taught.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # only labels of documents that are there may take a place in the sample; ids alone are shuffled
    there = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("id"), "label")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vec.flat(batch.column("text"))
            for lo, hi in vec.slices(texts):
                found = terms(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo), "terms": pa.array([x.tobytes() for x in found], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, label int, terms binary").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("terms").alias("terms")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    label = got["label"].to_numpy().astype(np.float64)
    if not len(label):
        return {"share": 0.5, "space": np.zeros((TERMS, 1)), "mean": np.zeros(TERMS, np.float32), "idf": np.zeros(WORDS, np.float32), "vectors": np.zeros((0, 1)), "label": label}
    matrix = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float32).reshape(len(label), TERMS)
    idf = np.log((1 + len(label)) / (1 + (matrix[:, SHAPE:] > 0).sum(0))).astype(np.float32)
    scaled = weighed(matrix, idf)
    mean = scaled.mean(0)
    gram = (scaled - mean).T @ (scaled - mean)
    _, basis = np.linalg.eigh(gram.astype(np.float64))
    space = np.ascontiguousarray(basis[:, ::-1][:, :RANK])
    model = {"share": float(label.mean()), "space": space, "mean": mean, "idf": idf, "label": label}
    return model | {"vectors": latent(matrix, model)}


def latent(found: np.ndarray, model: dict) -> np.ndarray:
    """Vectors of length 1 in the latent space."""
    v = (weighed(found, model["idf"]) - model["mean"]).astype(np.float64) @ model["space"]
    return v / np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-9)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row; of equal ones the first."""
    near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k :]
    values = np.take_along_axis(cosine, near, 1)
    least = values.min(1, keepdims=True)
    # rows with more of the least value than there was room for
    for row in np.flatnonzero((cosine == least).sum(1) > (values == least).sum(1)):
        over = np.flatnonzero(cosine[row] > least[row])
        near[row] = np.append(over, np.flatnonzero(cosine[row] == least[row])[: k - len(over)])
    return near


def vote(texts: pa.Array, model: dict, block: int = 512) -> np.ndarray:
    """Scores of a slice of texts, a block of cosines at a time."""
    found = terms(texts)
    out = np.full(len(texts), model["share"])
    some = np.flatnonzero(found.any(1))
    k = min(K, len(model["label"]))
    for lo in range(0, len(some) if k else 0, block):
        at = some[lo : lo + block]
        cosine = (latent(found[at], model) @ model["vectors"].T).astype(np.float32)
        near = nearest(cosine, k)
        weight = (np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) + 1e-6) ** POWER
        out[at] = (weight * model["label"][near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted of every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: pa.Array, _: pa.RecordBatch) -> dict:
        score = vote(texts, kept.value)
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return rows.map_texts(docs.select("doc_id", "text"), fn, ["doc_id"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", rows.held_out("doc_id", *HELD_OUT).alias("held_out"), "score", "predicted")
