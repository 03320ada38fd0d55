"""Operator 6, language-model scoring: deleted interpolation of n-gram estimates.

The model mixes four estimates of a token's probability after the two before it: the maximum likelihood of the trigram, of the bigram and of the unigram, and
the uniform 1 / (V + 1). The mixture depends on how often the context was seen, in buckets of powers of two: that of two words or, where
it was never seen, that of one word. The weights are learned by
expectation-maximisation on held-out counts: the training documents of every EVERY-th chunk are deleted from the counts
(count - their own count), and their tokens' likelihood under what is left is maximised. Scores use all training counts.

Counts cover the whole corpus and are never collected: chunks ask blocks of a hashed index about their distinct n-grams
(see exchange.py), first words and bigrams, then the trigrams both of whose bigrams another chunk has too (others occur nowhere else), and score their own documents with the answers. Only a histogram of held-out estimates (at most
BUCKETS x CELLS^3 cells of their logarithms, whatever the input, each with the sums of the estimates in it) is gathered for the expectation-maximisation.

Words and n-grams are told apart by 64-bit hashes, whatever the size of the corpus (one of 1e9 different n-grams shares one with probability 5e-11).
Null and empty texts are one end token. Null ids train. Repeated rows count each. An empty table gives no rows; with no training
tokens every token has probability 1 in the base and under the model. Further columns are ignored. There are no ties to break. Very long texts are scored whole, in
a chunk of their own if need be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import exchange, rows, vec

HELD_OUT, EVERY, CHUNK_BYTES = (7, 2), 8, 7 << 20
#: Context-frequency buckets, for contexts of two words and of one; cells of the log of an estimate, 0 for an estimate of 0.
LEVELS, CELLS, STEP, ROUNDS = 42, 64, 0.5, 60
BUCKETS, PARTS = 2 * LEVELS, 256
END, START, STARTS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)
DEFAULT = np.array([0.3, 0.3, 0.2, 0.2])
NAMES = ("uni", "bi", "tri")

ASKED = "block long, chunk long, " + ", ".join(f"{n} binary, {n}_n binary" for n in NAMES)
ANSWERED = "chunk long, block long, tokens long, types long, bi_shared binary, " + ", ".join(f"{n}_n binary, {n}_held binary" for n in NAMES)


class Chunk:
    """A chunk's tokens, each with the context before it, and its distinct unigrams and bigrams."""

    def __init__(self, table: pa.Table, slice_bytes: int = vec.SLICE_BYTES):
        self.table, texts = exchange.ordered(table)
        parts = [vec.Words(texts.slice(lo, hi - lo), lower=True) for lo, hi in vec.slices(texts, slice_bytes)]
        words = np.concatenate([p.count for p in parts])
        hashes = np.concatenate([p.hash for p in parts])
        del parts
        self.count = words + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.token = np.full(self.first[-1], END)
        ends = np.zeros(len(self.token), bool)
        ends[self.first[1:] - 1] = True
        self.token[~ends] = hashes
        follows = lambda before, token: vec.mix(before * np.uint64(0xD6E8FEB86659FD93) + token)
        pair = follows(self._before(self.token, START), self.token)
        three = follows(self._before(pair, STARTS) ^ STARTS, self.token)
        self.keys, self.of = {}, {}
        for name, values in {"uni": self.token, "bi": pair, "tri": three}.items():
            self.keys[name], self.of[name] = np.unique(values, return_inverse=True)
        # the start of a text was seen as often as its end
        at = np.arange(len(self.token)) - 1
        at[self.first[:-1]] = self.first[1:] - 1
        self.context_of = self.of["uni"][at]
        self.begins = self.first[:-1]
        self.train = np.repeat(self.table["train"].to_numpy(zero_copy_only=False), self.count)

    def _before(self, values: np.ndarray, start: np.uint64) -> np.ndarray:
        out = np.roll(values, 1)
        out[self.first[:-1]] = start
        return out

    def answered(self, answers: pa.Table) -> None:
        """Takes which bigrams other chunks have too; sent: the trigrams both of whose bigrams are such. No other chunk can have the others, whose own counts are all there is."""
        shared = self.shared = _flags(answers["bi_shared"])
        first = np.zeros(len(self.keys["tri"]), np.int64)
        first[self.of["tri"]] = np.arange(len(self.token))
        begins = np.zeros(len(self.token), bool)
        begins[self.begins] = True
        self.sent = shared[self.of["bi"][first]] & (begins[first] | shared[self.of["bi"][first - 1]])

    def totals(self, answers: pa.Table, kind: str, own: bool) -> dict[str, np.ndarray]:
        """Counts of the distinct n-grams, of a kind ("n" or "held"): the answered ones and, for those that no other chunk has, the chunk's own if it counts."""
        self.answered(answers)
        out = {"uni": _unpacked(answers[f"uni_{kind}"])}
        for name, known in (("bi", self.shared), ("tri", self.sent)):
            out[name] = self.counts(name) if own else np.zeros(len(self.keys[name]), np.int64)
            out[name][known] = _unpacked(answers[f"{name}_{kind}"])
        return out

    def counts(self, name: str) -> np.ndarray:
        return np.bincount(self.of[name], self.train, len(self.keys[name])).astype(np.int64)

    def estimates(self, n: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each token's bucket, its trigram and bigram estimates and its own count, from the counts of the distinct n-grams."""
        one = n["uni"][self.context_of]
        two = np.roll(n["bi"][self.of["bi"]], 1)
        two[self.begins] = one[self.begins]
        three, pair = n["tri"][self.of["tri"]], n["bi"][self.of["bi"]]
        bucket = np.where(two > 0, level(two), LEVELS + level(one))
        return bucket, three / np.maximum(two, 1) * (two > 0), pair / np.maximum(one, 1) * (one > 0), n["uni"][self.of["uni"]]


def level(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64).clip(0, LEVELS - 1)


def _asked(number: int, asked: dict[str, tuple[np.ndarray, np.ndarray]], blocks: int) -> pa.Table:
    """A chunk's keys and their training counts, by block."""
    rows_: dict[int, dict[str, bytes]] = {}
    for name, (keys, n) in asked.items():
        found, cut = exchange.blocks_of(keys, blocks)
        for k, b in enumerate(found.tolist()):
            row = rows_.setdefault(b, dict.fromkeys([*NAMES, *(f"{x}_n" for x in NAMES)], b""))
            row[name], row[f"{name}_n"] = exchange.pack_keys(keys[cut[k] : cut[k + 1]]), exchange.pack(n[cut[k] : cut[k + 1]])
    out = {"block": pa.array(list(rows_), pa.int64()), "chunk": pa.array([number] * len(rows_), pa.int64())}
    return pa.table(out | {c: pa.array([r[c] for r in rows_.values()], pa.binary()) for name in NAMES for c in (name, f"{name}_n")})


def ask(table: pa.Table, blocks: int) -> pa.Table:
    chunk = Chunk(table)
    return _asked(table["chunk"][0].as_py(), {name: (chunk.keys[name], chunk.counts(name)) for name in ("uni", "bi")}, blocks)


def ask_shared(left: pa.Table, right: pa.Table, blocks: int) -> pa.Table:
    """The second round: trigrams that another chunk may have."""
    if not left.num_rows:
        return _asked(0, {}, blocks)
    chunk, answers = Chunk(left), right.sort_by("block")
    chunk.answered(answers)
    return _asked(left["chunk"][0].as_py(), {"tri": (chunk.keys["tri"][chunk.sent], chunk.counts("tri")[chunk.sent])}, blocks)


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([exchange.unpack(x) for x in column.to_pylist() if x] or [np.zeros(0, np.int64)])


def _packed_flags(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _flags(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")) for x in column.to_pylist() if x]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).astype(bool)


def answer(table: pa.Table) -> pa.Table:
    """Training counts of every key of every chunk; those of the held-out chunks too, for these; which bigrams two chunks or more have; and, in one of the PARTS
    chunks below 0, the block's training tokens and types."""
    chunks = table["chunk"].to_numpy()
    held = chunks % EVERY == 0
    out: dict[str, list] = {"bi_shared": [b""] * len(chunks)}
    tokens = types = 0
    for name in NAMES:
        keys, sizes = exchange.keys_of(table, name)
        n = _unpacked(table[f"{name}_n"])
        distinct, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, n, len(distinct)).astype(np.int64)
        apart = np.bincount(of, n * np.repeat(held, sizes), len(distinct)).astype(np.int64)
        if name == "uni":
            tokens, types = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum(sizes)
        told = np.ones(len(of), bool)
        if name == "bi":  # no count is told of a bigram that no other chunk has
            told = (np.bincount(of, minlength=len(distinct)) > 1)[of]
            out["bi_shared"] = [_packed_flags(told[hi - k : hi]) if k else b"" for hi, k in zip(ends, sizes, strict=True)]
        some = lambda values, hi, k: exchange.pack(values[of[hi - k : hi][told[hi - k : hi]]]) if k else b""  # noqa: E731, B023
        out[f"{name}_n"] = [some(total, hi, k) for hi, k in zip(ends, sizes, strict=True)]
        out[f"{name}_held"] = [some(apart, hi, k) if h else b"" for hi, k, h in zip(ends, sizes, held, strict=True)]
    k = len(chunks)
    columns = {"chunk": pa.array([*chunks, -1 - table["block"][0].as_py() % PARTS], pa.int64()), "block": pa.array([table["block"][0].as_py()] * (k + 1), pa.int64())}
    columns |= {"tokens": pa.array([0] * k + [tokens], pa.int64()), "types": pa.array([0] * k + [types], pa.int64())}
    return pa.table(columns | {c: pa.array([*out[c], b""], pa.binary()) for c in ("bi_shared", *(f"{name}_{x}" for name in NAMES for x in ("n", "held")))})


def _cell(estimate: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.round(np.abs(np.log(estimate)) / STEP) + 1
    return np.where(estimate > 0, cell.clip(1, CELLS - 1), 0).astype(np.int64)


#: Cells of the histogram that hold all training tokens and types.
TOKENS, TYPES = -1, -2
HISTOGRAM = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("tri", pa.float64()), ("bi", pa.float64()), ("uni", pa.float64())])


def held_out_histogram(left: pa.Table, right: pa.Table) -> pa.Table:
    """How many of a held-out chunk's training tokens have which estimates once its documents are deleted. Chunks below 0 give the sums over their blocks."""
    if not left.num_rows:
        n = [sum(right[c].to_pylist()) for c in ("tokens", "types")]
        return pa.table({"cell": [TOKENS, TYPES], "n": n} | {c: [0.0, 0.0] for c in ("tri", "bi", "uni")}, HISTOGRAM)
    if left["chunk"][0].as_py() % EVERY:
        return HISTOGRAM.empty_table()
    chunk, answers = Chunk(left), right.sort_by("block")
    # what only this chunk has is deleted with it
    every, apart = (chunk.totals(answers, kind, own=False) for kind in ("n", "held"))
    n = {name: every[name] - apart[name] for name in NAMES}
    bucket, *found = (x[chunk.train] for x in chunk.estimates(n))
    code = bucket
    for x in found:
        code = code * CELLS + _cell(x)
    cells, of = np.unique(code, return_inverse=True)
    sums = {c: np.bincount(of, x, len(cells)) for c, x in zip(("tri", "bi", "uni"), found, strict=True)}
    return pa.table({"cell": cells, "n": np.bincount(of, minlength=len(cells)).astype(np.int64)} | sums, HISTOGRAM)


def learn(bucket: np.ndarray, n: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """Weights of trigram, bigram, unigram and uniform by bucket, by expectation-maximisation; estimate: a row of the four each."""

    def run(estimate: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        weight = start
        for _ in range(ROUNDS):
            share = estimate * weight
            share /= share.sum(1, keepdims=True)
            weight = (share * n[:, None]).sum(0) / n.sum()
        weight = np.maximum(weight, [0, 0, 1e-6, 1e-6])  # unseen words keep a probability
        return weight / weight.sum()

    every = run(estimate, n, DEFAULT) if len(n) else DEFAULT
    out = np.tile(every, (BUCKETS, 1))
    for b in np.unique(bucket):
        out[b] = run(estimate[bucket == b], n[bucket == b], every)
    # an unseen context has no trigrams, or no bigrams either
    out[LEVELS:, 0] = out[LEVELS, 1] = 0
    return out / out.sum(1, keepdims=True)


def _weights(table: pa.Table) -> pa.Table:
    """One row from the whole histogram, which is bounded: the weights, all training tokens and types."""
    table = table.sort_by("cell")
    cell, n = table["cell"].to_numpy(), table["n"].to_numpy()
    tokens, types = (int(n[cell == c].sum()) for c in (TOKENS, TYPES))
    real = cell >= 0
    mean = np.stack([table[c].to_numpy()[real] / n[real] for c in ("tri", "bi", "uni")] + [np.full(real.sum(), 1 / (types + 1))], 1)
    mean[:, 2] /= max(tokens, 1)
    return pa.table({"one": pa.array([1], pa.int32()), "all_tokens": [tokens], "all_types": [types], "weights": pa.array([learn(cell[real] // CELLS**3, n[real].astype(float), mean).tobytes()], pa.binary())})


def score(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of one chunk; every chunk has asked about the end token, and so has answers."""
    chunk, answers = Chunk(left), right.sort_by("block")
    n = chunk.totals(answers, "n", own=True)
    tokens, types = answers["all_tokens"][0].as_py(), answers["all_types"][0].as_py()
    weights = np.frombuffer(answers["weights"][0].as_py()).reshape(BUCKETS, 4)
    base = np.log10(n["uni"] + 1) - np.log10(tokens + (types + 1))
    bucket, three, two, one = chunk.estimates(n)
    if tokens:
        w = weights[bucket]
        log_p = np.log10(w[:, 0] * three + w[:, 1] * two + w[:, 2] * (one / tokens) + w[:, 3] / (types + 1))
    else:
        log_p = np.zeros(len(one))
    first = chunk.first[:-1]
    add = lambda x: np.add.reduceat(x, first)
    out = {"n_tokens": chunk.count.astype(np.int64), "n_known": add((one > 0).astype(np.int64)), "train_tokens": np.full(len(first), tokens, np.int64), "base_score": add(base[chunk.of["uni"]]), "score": add(log_p)}
    return pa.table({"doc_id": chunk.table["doc_id"], "held_out": chunk.table["held_out"]} | {k: pa.array(v) for k, v in out.items()})


def scan(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    out = rows.held_out("doc_id", *HELD_OUT)
    marked = docs.select("doc_id", "text", out.alias("held_out"), (~out).alias("train"))
    dealt, chunks = exchange.chunked(marked, marked.columns, chunk_bytes, least=2 * EVERY, classes=EVERY)
    n, by_chunk = exchange.partitions(spark, chunks), dealt.groupBy("chunk")
    asked = by_chunk.applyInArrow(lambda t: ask(t, chunks), ASKED).repartition(n, "block")
    one = asked.groupBy("block").applyInArrow(answer, ANSWERED).repartition(n, "chunk")
    further = by_chunk.cogroup(one.groupBy("chunk")).applyInArrow(lambda a, b: ask_shared(a, b, chunks), ASKED).repartition(n, "block")
    answers = one.unionByName(further.groupBy("block").applyInArrow(answer, ANSWERED).repartition(n, "chunk"))
    found = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(held_out_histogram, "cell long, n long, tri double, bi double, uni double")
    histogram = found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "tri", "bi", "uni")])
    weights = histogram.groupBy(F.lit(1).alias("one")).applyInArrow(_weights, "one int, all_tokens long, all_types long, weights binary")
    informed = answers.withColumn("one", F.when(F.col("chunk") >= 0, 1).otherwise(0)).join(F.broadcast(weights), "one").drop("one")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_chunk.cogroup(informed.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir))
