"""Operator 2, substring dedup: relative Lempel-Ziv parsing against the whole corpus.

The reference is the corpus itself, indexed in blocks: a block holds every window of WINDOW words whose hash lies in its
range, with the places where it starts. Each document is factored greedily: from its current word, the factor is
the longest match that continues along one place of the reference elsewhere; factors of WINDOW words or more are
duplicate spans, other words are literals. A greedy factor may hide a window that begins in it and ends beyond: those
windows are checked one by one at each factor's end. Together that is every window that also starts anywhere else.

Windows are not all sent: one is asked about only if its anchor (the ANCHOR-word gram of least hash in it, the same in
all its copies) is there twice, which a first round of questions settles over a fourteenth of the data. See exchange.py
for the rounds. Windows are equal if a 64-bit hash and 32 further bits are, so that among 1e13 different ones less than 1e-3 pairs are expected to be confused.
Where a window starts at several places elsewhere, its reference is the first of them in the order of chunks, so a factor may end before the longest match
there is; that changes factors, not what is removed, since windows across their ends are checked.

Null and empty texts have no words; texts of fewer than WINDOW words keep all; a window repeated inside one text counts as elsewhere, as do repeated rows
(which are removed from one another); null ids are fine; an empty table gives no rows; further columns are ignored by scan(), kept by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import exchange, rows, vec

WINDOW, ANCHOR = 35, 8
ASKED = "block long, chunk long, keys binary, checks binary, places binary"
ANSWERED = "chunk long, block long, known binary, refs binary"


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    out, done = values, 1
    while done < n:
        step = min(done, n - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Chunk:
    """A chunk's words, its windows and their anchors."""

    def __init__(self, table: pa.Table):
        self.table, self.texts = exchange.ordered(table)
        parts = [vec.Words(self.texts.slice(lo, hi - lo)) for lo, hi in vec.slices(self.texts)]
        self.counts = np.concatenate([p.count for p in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        hashes = np.concatenate([p.hash for p in parts]) if parts else np.zeros(0, np.uint64)
        self.at, _, self.window = vec.windows(hashes, self.first, WINDOW)
        grams = np.zeros(0, np.uint64)
        if len(hashes) >= WINDOW:
            # all grams, also across texts; a window's own grams are all inside its text
            _, _, grams = vec.windows(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), np.array([0, len(hashes)]), ANCHOR)
        half = vec.runs(hashes, WINDOW // 2 + 1) if len(hashes) >= WINDOW else np.zeros(0, np.uint64)
        self.check = (vec.mix(half[self.at] * np.uint64(0x9FB21C651E98DF25) + half[self.at + WINDOW // 2]) >> np.uint64(32)).astype(np.uint32)
        self.anchor = sliding_min(grams, WINDOW - ANCHOR + 1)[self.at]
        self.keys, self.inverse = np.unique(self.anchor, return_inverse=True)
        every, counts = np.unique(grams, return_counts=True)
        self.own = counts[np.searchsorted(every, self.keys)] > 1

    def asked(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose anchor is there twice, which distinct hash each has, and the distinct hashes, sorted, with their check bits and first places."""
        some = np.flatnonzero((shared | self.own)[self.inverse])
        window, check = self.window[some], self.check[some]
        order = np.lexsort((check, window))
        head = np.ones(len(some), bool)
        head[1:] = (window[order][1:] != window[order][:-1]) | (check[order][1:] != check[order][:-1])
        index = np.empty(len(some), np.int64)
        index[order] = np.cumsum(head) - 1
        first = order[head]
        return some, index, window[first], check[first], self.at[some[first]]


def _rows(chunk: int, blocks: int, keys: np.ndarray, checks: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    some, cut = exchange.blocks_of(keys, blocks)
    data = [exchange.pack_keys(keys[a:b]) for a, b in pairwise(cut.tolist())]
    more = [[b"" if x is None else x[a:b].astype(np.uint32).tobytes() for a, b in pairwise(cut.tolist())] for x in (checks, places)]
    return pa.table({"block": pa.array(some, pa.int64()), "chunk": pa.array([chunk] * len(some), pa.int64()), "keys": pa.array(data, pa.binary()), "checks": pa.array(more[0], pa.binary()), "places": pa.array(more[1], pa.binary())})


def _answers(table: pa.Table) -> pa.Table:
    """For every key of every chunk, whether another chunk has it, and where: its first place there."""
    table = table.sort_by("chunk")
    chunks = table["chunk"].to_numpy()
    keys, sizes = exchange.keys_of(table, "keys")
    places, given = exchange.joined(table, "places", 4)
    checks, _ = exchange.joined(table, "checks", 4)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((checks, keys)) if len(checks) else np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    if len(checks):
        head[1:] |= checks[order][1:] != checks[order][:-1]
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    size = np.diff(np.append(start, len(keys)))
    known = np.zeros(len(keys), bool)
    known[order] = size[group] > 1
    refs = np.zeros(0, np.uint64)
    if given.any():
        other = np.empty(len(keys), np.int64)  # the group's first place, for itself its second
        other[order] = order[np.minimum(start[group] + head, len(keys) - 1)]
        refs = (chunks[row[other]].astype(np.uint64) << np.uint64(32)) | places[other]
    ends = np.cumsum(sizes)
    bits, back = [], []
    for lo, hi in zip(ends - sizes, ends, strict=True):
        k = known[lo:hi]
        bits.append(np.packbits(k).tobytes())
        back.append(refs[lo:hi][k].tobytes() if len(refs) else b"")
    return pa.table({"chunk": table["chunk"], "block": table["block"], "known": pa.array(bits, pa.binary()), "refs": pa.array(back, pa.binary())})


def _known(answers: pa.Table, keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers to a chunk's sorted keys, as it asked them."""
    answers = answers.sort_by("block")
    sizes = np.diff(exchange.blocks_of(keys, blocks)[1])
    known = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(answers["known"].to_pylist(), sizes, strict=True)]
    return np.concatenate(known) if known else np.zeros(0, bool), np.frombuffer(b"".join(answers["refs"].to_pylist()), np.uint64)


def parse(known: np.ndarray, ref: np.ndarray, n_words: int, n: int = WINDOW) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Greedy factors of n words or more of one document, and the windows found by the check at their ends.

    known: first words of its windows that start elsewhere too, rising; ref: the place of each.
    """
    if not len(known):
        return [], []
    # a match goes on while the next window continues at the next place
    ends = np.ones(len(known), bool)
    ends[:-1] = (known[1:] != known[:-1] + 1) | (ref[1:] != ref[:-1] + np.uint64(1))
    last = known[np.flatnonzero(ends)][np.cumsum(ends) - ends] + n  # where the match from each window ends
    factors, checked, k = [], [], 0
    while k < len(known):
        lo, hi = int(known[k]), int(last[k])
        factors.append((lo, hi))
        nxt = int(np.searchsorted(known, hi))
        over = int(np.searchsorted(known, hi - n + 1))
        if over < nxt:  # they begin in the factor and end beyond it
            a = max(over, k)
            checked += [(int(x), int(x) + n) for x in known[a:nxt] if x + n > hi]
        k = nxt
    return factors, checked


def _finish(chunk: Chunk, some: np.ndarray, index: np.ndarray, known: np.ndarray, refs: np.ndarray, with_text: bool, carry: list[str], number: int) -> pa.Table:
    at = chunk.at[some]
    reference = np.zeros(len(known), np.uint64)
    reference[known] = refs
    # inside the chunk, the first copy refers to the second and the others to the first
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    head = np.ones(len(some), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    start = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    size = np.diff(np.append(start, len(some)))
    twice, inner = np.zeros(len(some), bool), np.zeros(len(some), np.uint64)
    twice[order] = size[group] > 1
    if len(some):
        inner[order] = at[order[np.minimum(start[group] + head, len(some) - 1)]].astype(np.uint64)
    there = known[index] | twice
    ref = np.where(known[index], reference[index], inner | np.uint64(number) << np.uint64(32))
    at, ref = at[there], ref[there]
    raw, offsets = vec.buffers(chunk.texts)
    raw = memoryview(raw)
    cut = np.searchsorted(at, chunk.first)
    n_removed, n_factors, digests, kept_texts, removed_spans = [], [], [], [], []
    for d in range(len(chunk.counts)):
        words = bytes(raw[offsets[d] : offsets[d + 1]]).split()
        lo, hi = cut[d], cut[d + 1]
        factors, checked = parse(at[lo:hi] - chunk.first[d], ref[lo:hi], len(words))
        if factors:
            steps = np.zeros(len(words) + 1, np.int64)
            for a, b in factors + checked:
                steps[a] += 1
                steps[b] -= 1
            kept = np.cumsum(steps[:-1]) == 0
            left = [w for w, k in zip(words, kept.tolist(), strict=True) if k]
        else:
            left = words
        n_removed.append(len(words) - len(left))
        n_factors.append(len(factors))
        text = b" ".join(left)
        digests.append(hashlib.sha256(text).hexdigest())
        if with_text:
            kept_texts.append(text.decode())
    out = {c: chunk.table[c] for c in carry} | {"n_words": pa.array(chunk.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_factors": pa.array(n_factors, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(out | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))


def parsed(docs: DataFrame, carry: Iterable[str], with_text: bool = False, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """The carried columns (under in_<name>), n_words, n_removed, n_factors, kept_sha256 and, if asked, kept_text of every row."""
    carry = list(carry)
    inputs = [F.col(c).alias(f"in_{c}") for c in carry]
    named = docs.select("doc_id", "text", *inputs)
    dealt, chunks = exchange.chunked(named, named.columns, chunk_bytes)
    n, blocks = exchange.partitions(docs.sparkSession, chunks), chunks

    def ask(table: pa.Table) -> pa.Table:
        return _rows(table["chunk"][0].as_py(), blocks, Chunk(table).keys)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(0, blocks, np.zeros(0, np.uint64))
        chunk = Chunk(left)
        _, _, *asked = chunk.asked(_known(right, chunk.keys, blocks)[0])
        return _rows(left["chunk"][0].as_py(), blocks, *asked)

    def finish(left: pa.Table, both: pa.Table) -> pa.Table:
        kinds = both["kind"].to_numpy()
        anchors, windows = both.filter(pa.array(kinds == 1)), both.filter(pa.array(kinds == 2))
        chunk = Chunk(left)
        some, index, keys, *_ = chunk.asked(_known(anchors, chunk.keys, blocks)[0])
        known, refs = _known(windows, keys, blocks)
        return _finish(chunk, some, index, known, refs, with_text, [f"in_{c}" for c in carry], left["chunk"][0].as_py())

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(ask, ASKED).repartition(n, "block").groupBy("block").applyInArrow(_answers, ANSWERED).repartition(n, "chunk")
    asked = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(ask_windows, ASKED)
    windows = asked.repartition(n, "block").groupBy("block").applyInArrow(_answers, ANSWERED).repartition(n, "chunk")
    answers = anchors.withColumn("kind", F.lit(1)).unionByName(windows.withColumn("kind", F.lit(2)))
    schema = docs.select(*inputs).schema.add("n_words", "long").add("n_removed", "long").add("n_factors", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def scan(docs: DataFrame, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept_sha256 of every row."""
    return parsed(docs, ["doc_id"], chunk_bytes=chunk_bytes).withColumnRenamed("in_doc_id", "doc_id")


def clean(docs: DataFrame) -> DataFrame:
    """The rows with their duplicate spans removed (words joined by one space), n_chars counted anew."""
    out = parsed(docs, [c for c in docs.columns if c != "text"], with_text=True)
    out = out.select(*[F.col("kept_text" if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (
  SELECT h FROM win GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice ON win.h = twice.h
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
