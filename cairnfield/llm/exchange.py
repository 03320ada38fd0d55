"""Questions and answers between chunks of the corpus and blocks of an index over it.

Documents are dealt to chunks of a few MB by hash. A chunk asks about its distinct 64-bit keys: they are
sorted, cut at the blocks' borders (a block is a range of keys) and sent as packed arrays, a row a block. A block
meets the keys of all chunks and answers each chunk in the order it asked. So a key that millions of documents
share is sent once a chunk, and a task's text follows from the size of chunks and AT_ONCE, not from the data. Rows that are equal in all columns are dealt
apart by the part of the table that they are read from. What a block meets of one key is a row a
chunk: at 100 TB chunks of some 100 MB (a parameter of the operators) keep that to a million short rows, and rows to a few dozen keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import vec
from cairnfield.session import ship

CHUNK_BYTES, AT_ONCE = 4 << 20, 32


def chunked(docs: DataFrame, columns: Iterable[str], chunk_bytes: int = CHUNK_BYTES, least: int = 1, classes: int = 1, same: Iterable[str] = ()) -> tuple[DataFrame, int]:
    """The columns and `chunk`, dealt out by chunk once for all who read it; and the number of chunks. A chunk is a hash of the columns (or of some of them, `same`) and
    of the part that a row is read from, so equal rows are no crowd. Their number is a multiple of `classes` (a power of two): which of those a chunk is of is said by the columns alone."""
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chunks = max(least, classes, math.ceil(total / chunk_bytes) // classes * classes)
    columns = list(columns)
    of = list(same) or columns
    apart = F.xxhash64(*of, F.spark_partition_id())
    if classes > 1:
        apart = F.shiftleft(apart, classes.bit_length() - 1) + F.pmod(F.xxhash64(*of), F.lit(classes))
    chunk = F.pmod(apart, F.lit(chunks)).cast("long")
    return docs.select(*columns, chunk.alias("chunk")).repartition(partitions(spark, chunks), "chunk"), chunks


def partitions(spark: SparkSession, chunks: int) -> int:
    """As many as the session says, and more where a task would get over AT_ONCE chunks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chunks / AT_ONCE))


def ordered(table: pa.Table) -> tuple[pa.Table, pa.Array]:
    """A chunk's rows in an order of their own (a shuffle has none), and their texts without nulls."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table, vec.flat(table["text"])


def blocks_of(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that sorted keys lie in, and where each one's keys begin (and the last one's end)."""
    of = (keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    begin = np.flatnonzero(np.diff(of, prepend=np.uint64(2**64 - 1))) if len(of) else np.zeros(0, np.int64)
    return of[begin].astype(np.int64), np.append(begin, len(keys))


def pack(values: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, byte by byte (upper bytes are mostly zeros, which shuffles compress)."""
    most = int(values.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    size = np.dtype(kind).itemsize
    return bytes([size]) + values.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    size = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps after it: of each gap as many low bytes as leave the mean one's rest under 32, and the rest in a byte, or
    in eight more where it is 255 and over."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    bits = float(np.log2(max(float(keys[-1] - keys[0]) / max(len(gaps), 1), 1.0)))
    width = min(7, max(0, math.ceil((bits - 5) / 8)))
    rest = gaps >> np.uint64(8 * width)
    far = rest >= np.uint64(255)
    head = bytes([width]) + keys[:1].tobytes() + int(far.sum()).to_bytes(4, "little")
    return head + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + np.where(far, np.uint64(255), rest).astype(np.uint8).tobytes() + rest[far].tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    width, far = packed[0], int.from_bytes(packed[9:13], "little")
    n = (len(packed) - 13 - 8 * far) // (width + 1)
    rest = np.frombuffer(packed, np.uint8, n, 13 + n * width).astype(np.uint64)
    rest[rest == 255] = np.frombuffer(packed, np.uint64, far, 13 + n * (width + 1))
    gaps = np.zeros((n + 1, 8), np.uint8)
    gaps[1:, :width] = np.frombuffer(packed, np.uint8, n * width, 13).reshape(n, width)
    gaps = gaps.view(np.uint64).ravel()
    gaps[1:] |= rest << np.uint64(8 * width)
    gaps[0] = np.frombuffer(packed, np.uint64, 1, 1)[0]
    return np.cumsum(gaps, dtype=np.uint64)


def keys_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All rows' keys as one array, and each row's number of them."""
    parts = [unpack_keys(p) for p in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(p) for p in parts], np.int64)


def joined(table: pa.Table, name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A packed column's values of `size` bytes as one array, and each row's number of them."""
    parts = table[name].to_pylist()
    return np.frombuffer(b"".join(parts), f"u{size}"), np.array([len(p) // size for p in parts], np.int64)
