"""Operator 13, BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

A text is cut at the tokenizer's added tokens, then by its pattern into pieces; a piece's bytes are its first symbols. All neighbours that a merge joins wait in
a heap by (rank, place). The least is taken: the left symbol becomes the product, the right one leaves the list, and the pairs that the
product makes with its neighbours are pushed. Entries whose symbols have changed since are stale and skipped. Decoding
concatenates the ids' vocabulary strings, as bytes, and reads them as UTF-8 (replacement characters where they are not).

The vocabulary is a file of the tokenizers library (byte-level BPE, json); its path is a parameter. The driver reads it once and broadcasts it: its size is
that of the tokenizer (checked against MOST_BYTES), whatever the data. Pieces repeat, so each worker remembers the ids of up to CACHE short ones and
forgets all when these are full; results do not depend on it. Every row is worked on alone: nothing is shuffled, and a very long text
or piece costs n log n.

Null and empty texts have no ids and decode to ''. Repeated rows get equal results; ties of rank go to the earlier place. Empty tables give
no rows. encode() and decode() give `keep` and their own column; other columns of the input are left behind, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from cairnfield.llm import rows
from cairnfield.session import ship

#: Fixed value: the pattern by which byte-level tokenizers of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a vocabulary file, pieces that a worker remembers and their characters, matches and ids at once of a very long text.
MOST_BYTES, CACHE, SHORT, AT_ONCE, LONG = 64 << 20, 1 << 19, 64, 1 << 16, 1 << 20
NAME, BITS = "byte_bpe_50k.json", 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def visible() -> dict[str, int]:
    """The byte that each character of a vocabulary string stands for: printable Latin-1 for itself, all others from U+0100 on in order."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary and the ids of pieces."""

    def __init__(self, text: str):
        made = json.loads(text)
        model, of = made["model"], visible()
        if model["type"] != "BPE" or (made["pre_tokenizer"] or {}).get("type") != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"] or made["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary without normaliser and prefix space")
        ids = model["vocab"]
        self.strings = {k: bytes(of[c] for c in token) for token, k in ids.items()}
        self.strings |= {t["id"]: t["content"].encode() for t in made["added_tokens"]}
        self.first = [ids[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.product: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(ids[left] << BITS | ids[right], len(self.product))
            self.product.append(ids[left + right])
        self.added = {t["content"]: self._packed([t["id"]]) for t in made["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.between = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.known = _Known(self)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """The packed ids of one piece."""
        return self._packed(self.merged([self.first[b] for b in piece.encode()]))

    def merged(self, symbol: list[int]) -> list[int]:
        """The symbols after all merges; -1 marks those that have left the list."""
        n, rank, product = len(symbol), self.rank.get, self.product
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 40 | i for i in range(n - 1) if (r := rank(symbol[i] << BITS | symbol[i + 1])) is not None]
        heapify(queue)
        while queue:
            least = heappop(queue)
            i, r = least & (1 << 40) - 1, least >> 40
            j = after[i]
            if symbol[i] < 0 or j == n or rank(symbol[i] << BITS | symbol[j]) != r:
                continue  # stale
            symbol[i], symbol[j] = product[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbol[i] << BITS | symbol[k])) is not None:
                    heappush(queue, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank(symbol[h] << BITS | symbol[i])) is not None:
                heappush(queue, r << 40 | h)
        return [s for s in symbol if s >= 0]

    def _ordinary(self, text: str) -> Iterator[bytes]:
        of = self.known.__getitem__
        if len(text) <= LONG:
            yield from map(of, self.pattern.findall(text))
        else:
            for some in batched(self.pattern.finditer(text), AT_ONCE):
                yield b"".join([of(m[0]) for m in some])

    def encode(self, text: str) -> bytes:
        """A text's packed ids (little-endian, four bytes each)."""
        if self.between is None or not self.between.search(text):
            return b"".join(self._ordinary(text))
        return b"".join(self.added[part] if k % 2 else b"".join(self._ordinary(part)) for k, part in enumerate(self.between.split(text)))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; ids that the vocabulary does not have are left out."""
        ids, string = np.frombuffer(packed, "<u4"), self.strings
        parts = (b"".join([string.get(i, b"") for i in ids[lo : lo + AT_ONCE].tolist()]) for lo in range(0, len(ids), AT_ONCE))
        return b"".join(parts).decode("utf-8", "replace")


class _Known(dict):
    """The packed ids of pieces by piece."""

    def __init__(self, of: Tokenizer):
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        made = self.of.piece(piece)
        if len(piece) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = made
        return made


@lru_cache(1)
def tokenizer(text: str) -> Tokenizer:
    """Made once a worker."""
    return Tokenizer(text)


def _sent(spark: SparkSession, path: str | None):
    with open(path or default_path(), encoding="utf-8") as file:
        text = file.read(MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError(f"a vocabulary of over {MOST_BYTES} characters is not broadcast")
    ship(spark)
    return spark.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str | None = None, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """`keep` and ids (packed, little-endian, four bytes each) of every row's text."""
    keep, kept = list(keep), _sent(docs.sparkSession, path)

    def fn(texts: pa.Array, part: pa.RecordBatch) -> dict:
        return {"ids": pa.array([*map(tokenizer(kept.value).encode, texts.to_pylist())], pa.binary())}

    schema = StructType([*docs.select(*keep).schema.fields, StructField("ids", BinaryType())])
    return rows.map_texts(docs.select(*dict.fromkeys([*keep, "text"])), fn, keep, schema)


def decode(tokens: DataFrame, path: str | None = None, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """`keep` and the text of every row's ids, packed or an array of numbers; of null ids ''."""
    keep, kept = list(keep), _sent(tokens.sparkSession, path)
    packed = isinstance(tokens.schema["ids"].dataType, BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = tokenizer(kept.value).decode
        for batch in batches:
            ids = (x or b"" for x in batch.column("ids").to_pylist()) if packed else (np.array([i for i in x or () if i is not None], "<u4").tobytes() for x in batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keep} | {"text": pa.array([*map(to_text, ids)], pa.string())})

    columns = tokens.select(*dict.fromkeys([*keep, "ids"]))
    return columns.mapInArrow(run, StructType([*tokens.select(*keep).schema.fields, StructField("text", StringType())]))


def unpacked(ids: str = "ids") -> F.Column:
    """Packed ids as an array of numbers."""
    byte = lambda at: F.conv(F.hex(F.substring(ids, at, 1)), 16, 10).cast("int")
    n = (F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: byte(4 * k + 1) + byte(4 * k + 2) * 256 + byte(4 * k + 3) * 65536 + byte(4 * k + 4) * 16777216)).otherwise(F.array().cast("array<int>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(rows.documents(spark, sf_dir)), keep=("doc_id", "ids"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
