"""Operator 10, token counts: delta-maintained rollups.

A batch is a set of signed changes: an insert is a row of sign 1, a delete a row of sign -1 with the deleted
row's values, a revision one of each. A batch is counted once and added up by source, language and tokenizer version into a small
delta table under a name of its own, <root>/deltas/<attempt>. It counts from the moment that its record, one file of one row, is in
<root>/commits: that file appears by one rename, so a batch is in or not in, a batch that died half-way is none, and a replay
finds the record and does nothing. Two writers of one batch at once both leave a record; readers take the one of least attempt.

compact() folds the committed deltas into a base with a record that names the batches in it. Which batches are in a result is
read once, as one snapshot of the records: a batch committed meanwhile stays a delta of its own and is counted once.
Readers take the base of the highest generation, of equal ones that of the greatest attempt, and the batches it does not name.

Sums are additive and partial sums precede the shuffle, so a hot source costs a few rows a task. Null sources, languages
and texts are groups and empty texts of their own; a null sign is an insert; an empty batch commits no rows; repeated rows count each; further columns
are ignored. Groups whose totals are all zero again are left out. Very long texts are tokenized whole, in pieces that no token spans. Folders of superseded deltas are
never read again and may be removed by whoever keeps the shared folder.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import rows, vec
from cairnfield.session import cut, shared_dir, ship

KEYS, SUMS = ["source", "lang", "tokenizer"], ["n_docs", "n_words", "n_chars", "n_tokens"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_words long, n_chars long, n_tokens long"
#: Texts are given to the tokenizer in pieces of about this many code points, cut between its pre-tokens.
PIECE = 1 << 16

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """A byte-pair encoder from a rank file: one base64 token and its rank a line."""
    if path not in _encoders:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}
        _encoders[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(encode: tiktoken.Encoding, text: str) -> int:
    """Tokens of a whole text. Long ones are cut where a non-space meets a space, where no pre-token reaches across."""
    if len(text) <= PIECE:
        return len(encode.encode_ordinary(text))
    total, at = 0, 0
    for m in re.finditer(r"(?<=[^\s]) (?=[^\s])", text):
        if m.start() - at >= PIECE:
            total += len(encode.encode_ordinary(text[at : m.start()]))
            at = m.start()
    return total + len(encode.encode_ordinary(text[at:]))


def delta(changes: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """The signed totals of a batch by source, language and tokenizer version."""

    name = Path(path).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, totals = encoder(SparkFiles.get(name)), {}
        for batch in batches:
            texts, signs = vec.flat(batch.column("text")), batch.column("sign").to_pylist()
            keys = list(zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True))
            for lo, hi in vec.slices(texts):
                some = texts.slice(lo, hi - lo)
                words = vec.Words(some, hashed=False).count.tolist()
                for k, text, n in zip(range(lo, hi), some.to_pylist(), words, strict=True):
                    sums = totals.setdefault(keys[k], np.zeros(4, np.int64))
                    sums += np.array([1, n, len(text), count_tokens(encode, text)]) * (1 if signs[k] is None else signs[k])
        made = list(totals.items())
        columns = {"source": pa.array([k[0] for k, _ in made], pa.string()), "lang": pa.array([k[1] for k, _ in made], pa.string()), "tokenizer": pa.array([tokenizer] * len(made), pa.string())}
        yield pa.RecordBatch.from_pydict(columns | {name: pa.array([int(v[i]) for _, v in made], pa.int64()) for i, name in enumerate(SUMS)})

    ship(changes.sparkSession)
    changes.sparkSession.sparkContext.addFile(path)
    plain = changes.select("source", "lang", "text", F.col("sign").cast("int").alias("sign"))
    return plain.mapInArrow(run, SCHEMA).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


RECORD = "batch string, kind string, generation long, attempt string"


def records(spark: SparkSession, root: str) -> DataFrame:
    """All records, as they are now: later ones do not show in what is derived from it."""
    try:
        return cut(spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(f"{root}/commits"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def _record(spark: SparkSession, root: str, attempt: str, batches: DataFrame, kind: str, generation: int) -> None:
    row = batches.select("batch", F.lit(kind).alias("kind"), F.lit(generation).cast("long").alias("generation"), F.lit(attempt).alias("attempt"))
    row.repartition(1).write.parquet(f"{root}/commits/{attempt}")


def live(snapshot: DataFrame) -> DataFrame:
    """batch, attempt of all that counts in a snapshot of the records: a row for each batch of the latest base, and the other batches' deltas."""
    bases = snapshot.filter("kind = 'base'")
    latest = bases.agg(F.max(F.struct("generation", "attempt")).alias("last")).select("last.attempt")
    inside = bases.join(F.broadcast(latest), "attempt", "left_semi").select("batch", "attempt")
    deltas = snapshot.filter("kind = 'delta'").groupBy("batch").agg(F.min("attempt").alias("attempt"))
    return inside.unionByName(deltas.join(inside, "batch", "left_anti"))


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the batches in the totals."""
    return live(records(spark, root)).select("batch")


def _new() -> str:
    return uuid.uuid4().hex


def commit(changes: DataFrame, root: str, batch: str, tokenizer: str, path: str) -> bool:
    """Adds a batch to the totals; False if it was there already."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch id has letters, digits, _ . and - only: {batch!r}")
    spark, attempt = changes.sparkSession, _new()
    if not committed(spark, root).filter(F.col("batch") == batch).isEmpty():
        return False
    delta(changes, tokenizer, path).write.parquet(f"{root}/deltas/{attempt}")
    _record(spark, root, attempt, spark.createDataFrame([(batch,)], "batch string"), "delta", 0)
    return True


def totals(spark: SparkSession, root: str, snapshot: DataFrame | None = None) -> DataFrame:
    """The totals by source, language and tokenizer version, now or at a snapshot. The attempts to read, one a batch since the last compaction, are listed on the driver."""
    attempts = sorted(r[0] for r in live(records(spark, root) if snapshot is None else snapshot).select("attempt").distinct().collect())
    paths = [f"{root}/deltas/{a}" for a in attempts]
    read = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    summed = read.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return summed.filter(" or ".join(f"{c} <> 0" for c in SUMS))


def compact(spark: SparkSession, root: str) -> None:
    """Folds all deltas committed by now into a new base; its record, written last, is what makes it count."""
    snapshot, attempt = records(spark, root), _new()
    generation = snapshot.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0] + 1
    totals(spark, root, snapshot).write.parquet(f"{root}/deltas/{attempt}")
    _record(spark, root, attempt, live(snapshot).select("batch"), "base", generation)


TOKENIZER, FILE = "byte_bpe_50k", "byte_bpe_50k.tiktoken"


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The totals of all documents, as a store has them after its usual life: a load in which half the rows (by hash of the id) carry a wrong language and source and
    others of the shorter rows are there twice, a revision, a deletion, a replay of each, and a compaction in between."""
    path = path or str(public_tokenizers.path(FILE))
    root = f"{shared_dir(spark)}/token_counts-{_new()}"
    docs = rows.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    wrong = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    was = docs.withColumns({c: F.when(wrong, F.lit("unknown")).otherwise(F.col(c)) for c in ("lang", "source")})
    signed = lambda df, sign: df.withColumn("sign", F.lit(sign))
    twice = was.filter(~wrong & (F.length("text") < 1000))
    steps = {
        "load": signed(was.unionByName(twice), 1),
        "revise": signed(was.filter(wrong), -1).unionByName(signed(docs.filter(wrong), 1)),
        "delete": signed(twice, -1),
    }
    for batch, changes in steps.items():
        for _ in range(2):
            commit(changes, root, batch, TOKENIZER, path)
        if batch == "revise":
            compact(spark, root)
    return totals(spark, root)
