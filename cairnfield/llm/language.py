"""Operator 3, language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts every 1- to 3-gram of code points (lower-cased) in the labelled training texts, hashed into
BUCKETS cells a language, with one shuffle of partial counts. The log-probability matrix is broadcast in blocks of at most MAX_CELLS cells (BUCKETS
times some languages each); scoring gathers its rows and adds them up per text in numpy, block after block, with the best language and the sum of
likelihoods so far as state. The number of cells a language does not depend on how many there are; the driver holds one block at a time.

Texts without a letter, and null texts, are `und` with score 0. With nothing to learn from, all are. A null lang does not teach; null
ids belong to the training part; of languages equally likely the first by code point is given; repeated rows get equal results; very long texts are counted
and scored whole, PIECE code points at a time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cairnfield.llm import rows, vec
from cairnfield.session import cut, ship

BUCKETS, ORDERS, MAX_CELLS, SMOOTHING = 1 << 15, 3, 1 << 23, 0.5
HELD_OUT = (4, 2)
UNKNOWN = "und"
PIECE = 1 << 20
_PRIME = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def pieces(text: str) -> Iterator[list[np.ndarray]]:
    """Cells of the text's n-grams, by order: those that begin in one piece of the text after another."""
    lowered = text.lower()
    for at in range(0, len(lowered), PIECE):
        code = np.frombuffer(lowered[at : at + PIECE + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        here, out, h = min(PIECE, len(lowered) - at), [], np.zeros(len(code), np.uint32)
        for n in range(min(ORDERS, len(code))):
            h = (h[: len(code) - n] ^ code[n:]) * _PRIME[n]
            out.append(((h[:here] ^ (h[:here] >> np.uint32(15))) * _PRIME[2] >> np.uint32(9)) & np.uint32(BUCKETS - 1))
        yield out


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell counts of each language over a task's rows; cell BUCKETS counts texts. Beyond MAX_CELLS counts the task gives what it has and goes on."""
    totals: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(cells), pa.string()), "cell": cells.astype(np.int32), "n": total[cells]})
        totals.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), vec.flat(batch.column("text"))
        for lo, hi in vec.slices(texts):
            for lang, text in zip(langs[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True):
                if lang not in totals and len(totals) * BUCKETS >= MAX_CELLS:
                    yield from given()
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += 1
                for cells in (c for piece in pieces(text) for c in piece):
                    if len(cells) > BUCKETS // 4:
                        total += np.bincount(cells, minlength=BUCKETS + 1)
                    else:
                        np.add.at(total, cells, 1)
    yield from given()


class Model:
    """Learned counts of all languages; iterating gives blocks of them, in code-point order, with log priors and log probabilities by cell and language."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        self.sizes = sorted(map(tuple, counts.filter(F.col("cell") == BUCKETS).select("lang", "n").collect()))
        self.at_once = max(1, MAX_CELLS // BUCKETS)

    def __len__(self) -> int:
        return -(-len(self.sizes) // self.at_once)

    def __iter__(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        texts = sum(n for _, n in self.sizes)
        for lo in range(0, len(self.sizes), self.at_once):
            some = self.sizes[lo : lo + self.at_once]
            langs = [lang for lang, _ in some]
            got = self.counts.filter(F.col("lang").between(langs[0], langs[-1]) & (F.col("cell") < BUCKETS)).toArrow()
            table = np.full((BUCKETS, len(langs)), SMOOTHING)
            of = pc.index_in(got["lang"].combine_chunks(), pa.array(langs)).to_numpy(zero_copy_only=False)
            table[got["cell"].to_numpy(), of] += got["n"].to_numpy()
            yield langs, np.log(np.array([n for _, n in some]) / texts), np.log(table / table.sum(0)).astype(np.float32)


def fit(docs: DataFrame) -> Model:
    """Learns from labelled training texts."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~rows.held_out("doc_id", *HELD_OUT)).select("lang", "text")
    ship(docs.sparkSession)
    return Model(cut(train.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))))


def likelihoods(text: str, prior: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log of prior times likelihood of each of a block's languages."""
    total = prior.copy()
    for cells in (c for piece in pieces(text) for c in piece):
        total += np.bincount(cells, minlength=BUCKETS) @ table.astype(np.float64) if len(cells) >= BUCKETS else table.take(cells, axis=0).sum(0, dtype=np.float64)
    return total


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of lang_pred) of every row; only the text is looked at."""
    context = docs.sparkSession.sparkContext
    state = {"best": "string", "top": "double", "mass": "double"}  # the likeliest so far, its log likelihood, and all likelihoods over that one
    out = docs.select("doc_id", "text", F.lit(UNKNOWN).alias("best"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("mass"))

    def step(kept) -> Callable[[pa.Array, pa.RecordBatch], dict]:
        def fn(texts: pa.Array, part: pa.RecordBatch) -> dict:
            langs, prior, table = kept.value
            found = []
            for text, best, top, mass in zip(texts.to_pylist(), *(part.column(c).to_pylist() for c in state), strict=True):
                if any(map(str.isalpha, text)):
                    total = likelihoods(text, prior, table)
                    k = int(total.argmax())
                    most = max(top, float(total[k]))
                    mass = mass * math.exp(top - most) + float(np.exp(total - most).sum())
                    best, top = (langs[k], most) if total[k] > top else (best, top)
                found.append((best, top, mass))
            return {c: pa.array(v, pa.string() if c == "best" else pa.float64()) for c, v in zip(state, zip(*found, strict=True), strict=True)}

        return fn

    for k, block in enumerate(model, 1):
        keep = ["doc_id", "text"] if k < len(model) else ["doc_id"]
        out = rows.map_texts(out, step(context.broadcast(block)), keep, StructType([*docs.select(*keep).schema.fields, *(StructField(c, DoubleType() if c != "best" else StringType()) for c in state)]))
    return out.select("doc_id", F.col("best").alias("lang_pred"), F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", rows.held_out("doc_id", *HELD_OUT).alias("held_out"), "lang_pred", "score")
