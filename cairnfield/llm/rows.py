"""Row-local Arrow operators: pick the input columns, map batches, keep what is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import vec
from cairnfield.session import ship

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; one of so few splits that cores would idle is dealt out first."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo `modulus`; null for a null id, which is so in no held-out part."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: str | Column, modulus: int, part: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == part, F.lit(False))


def map_texts(df: DataFrame, fn: Callable[[pa.Array, pa.RecordBatch], dict], keep: Iterable[str], schema: str, text: str = "text") -> DataFrame:
    """Runs fn over slices of a few MB of `text`; fn gets the texts (nulls as empty) and the slice, and
    returns new columns by name. `keep` names input columns that pass through, unless fn replaces them."""
    keep = list(keep)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vec.flat(batch.column(text))
            for lo, hi in vec.slices(texts):
                part = batch.slice(lo, hi - lo)
                made = fn(texts.slice(lo, hi - lo), part)
                columns = {k: part.column(k) for k in keep} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)
