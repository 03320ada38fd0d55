"""Operator 4, MinHash near-dedup: odd sketches for banded candidates, exact confirmation, connected components.

Texts are linked from a similarity of `percent` on, PERCENT if not given.
Texts with the same lower-cased words are one node, by a 128-bit digest of them. A node has SAMPLES MinHash samples; the first n_bands() * ROWS of them make its bands, and all
are folded into a parity bitmap of SKETCH bits (the odd sketch): bits that differ between two sketches estimate how far the
sets are apart. Nodes that share a band are candidates; a candidate pair whose sketches differ in over most_bits() bits (six
standard deviations beyond what the similarity gives) is dropped, the others are confirmed on full sets.

Groups are never expanded into all pairs at once:
1. each node meets one pivot a band, and is confirmed with the one whose sketch is nearest;
2. the other (node, pivot) pairs that are still in different components are confirmed;
3. bands that still hold nodes of different components are searched exhaustively, in blocks of about BLOCK nodes, with full sets.
So every pair that shares a band is either confirmed, refuted, or inside one component; a pair at the threshold shares no
band with probability MISSED.

Shingles are compared by 64-bit hashes within a pair of texts; texts of a single shingle, where one hash would decide, by their words.
Ties: of equally near pivots the one of least node is first; a component is named by its least doc_id. Very long texts are taken whole, each in memory once.
Null and empty texts have no shingles and are linked with nothing; null ids are never a component's name, unless all
of its are null; repeated rows are one node, and all rows with the component's doc_id are kept by scan() (clean() keeps one); an empty table gives
no rows; further columns are ignored by scan() and kept by clean().
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import rows, vec
from cairnfield.operators.components import components
from cairnfield.session import cut, ship

SHINGLE, PERCENT = 5, 85
SAMPLES, ROWS, SKETCH, MISSED, DEVIATIONS = 128, 4, 256, 4e-7, 6
BLOCK, SMALL, FEW = 400, 500_000, 100_000

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.Generator(np.random.PCG64(7))
_FLIP = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SCALE = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def n_bands(percent: int) -> int:
    """As few bands as let a pair at the threshold share none with probability MISSED at most."""
    n = math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))
    if n * ROWS > SAMPLES:
        raise ValueError(f"{SAMPLES} samples are too few for a similarity of {percent} percent")
    return n


def most_bits(percent: int) -> int:
    """Bits that sketches at the threshold differ in: their mean and DEVIATIONS standard deviations. Samples differ
    independently; each that does flips two bits."""
    apart = 1 - percent / 100
    one, two = ((1 - apart + apart * (1 - k / SKETCH) ** 2) ** SAMPLES for k in (2, 4))
    mean, variance = SKETCH / 2 * (1 - one), SKETCH / 4 * (1 + (SKETCH - 1) * two - SKETCH * one**2)
    return math.ceil(mean + DEVIATIONS * math.sqrt(variance))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text numbers, rising, and hashes. Shorter texts are one shingle."""
    w = vec.Words(texts, lower=True)
    _, of, hashes = w.windows(SHINGLE)
    parts = [(of, hashes)]
    for n in range(1, SHINGLE):
        _, short, h = w.windows(n)
        whole = w.count[short] == n
        parts.append((short[whole], h[whole]))
    of, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, first = np.unique(vec.keyed(hashes, of), return_index=True)
    first = first[np.argsort(of[first], kind="stable")]
    return of[first], hashes[first]


def _signed(texts: pa.Array, n_band: int) -> dict:
    of, hashes = shingles(texts)
    n = len(texts)
    size = np.bincount(of, minlength=n)
    some = np.flatnonzero(size)
    head = (np.cumsum(size) - size)[some]
    out = {"n_shingles": size.astype(np.int64)}
    node, bands, sketch = [None] * n, [None] * n, [None] * n
    if len(some):
        small = (hashes >> np.uint64(32)).astype(np.uint32)
        sample = np.stack([np.minimum.reduceat((small ^ _FLIP[k]) * _SCALE[k], head) for k in range(SAMPLES)], 1).astype(np.uint64)
        key = np.repeat(np.arange(n_band, dtype=np.uint64)[None], len(some), 0)
        for r in range(ROWS):
            key = vec.mix(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, r : n_band * ROWS : ROWS])
        place = (vec.mix(sample ^ _SALT) >> np.uint64(32)).astype(np.int64) % SKETCH
        bits = np.bincount((np.arange(len(some))[:, None] * SKETCH + place).ravel(), minlength=len(some) * SKETCH).reshape(-1, SKETCH) & 1
        longs = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
        raw, offsets = vec.buffers(texts)
        for k, row in enumerate(some):
            whole = b" ".join(raw[offsets[row] : offsets[row + 1]].tobytes().lower().split())
            node[row], bands[row], sketch[row] = hashlib.blake2b(whole, digest_size=16).digest(), key[k].view(np.int64), longs[k]
    return out | {"node": pa.array(node, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.list_(pa.int64()))}


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, and of texts with shingles node, bands, sketch."""
    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_band = n_bands(percent)
    return rows.map_texts(plain, lambda texts, _: _signed(texts, n_band), ["doc_id", "text_hash"], f"doc_id {kind}, text_hash long, n_shingles long, node binary, bands array<long>, sketch array<long>")


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(1, SKETCH // 64)), F.bit_count(F.get(F.col(a), F.lit(0)).bitwiseXOR(F.get(F.col(b), F.lit(0)))))


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast up to `most` (SMALL) rows of some tens of bytes, else shuffled."""
    return F.broadcast(df) if df.count() <= (SMALL if most is None else most) else df


def _only(text: str) -> list[str]:
    """The words of a text's first shingle."""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(_LOW))[:SHINGLE]


def _confirmed(batches, percent: int):
    for batch in batches:
        left, right = vec.flat(batch.column("text_a")), vec.flat(batch.column("text_b"))
        lo = 0
        _, sizes = vec.buffers(left)
        _, more = vec.buffers(right)
        both = sizes + more
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(both, both[lo] + vec.SLICE_BYTES, "right")) - 1)
            hi = min(hi, batch.num_rows)
            of_a, a = shingles(left.slice(lo, hi - lo))
            of_b, b = shingles(right.slice(lo, hi - lo))
            shared = np.intersect1d(vec.keyed(a, of_a), vec.keyed(b, of_b), assume_unique=True, return_indices=True)[1]
            n = hi - lo
            inter = np.bincount(of_a[shared], minlength=n)
            union = np.bincount(of_a, minlength=n) + np.bincount(of_b, minlength=n) - inter
            linked = (100 * inter >= percent * union) & (union > 0)
            for k in np.flatnonzero(linked & (union == 1)):
                linked[k] = _only(left[lo + k].as_py()) == _only(right[lo + k].as_py())
            yield batch.slice(lo, n).select(["a", "b"]).filter(pa.array(linked))
            lo = hi


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _confirmed(batches, percent), "a binary, b binary")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a, b in different components, with label_a and label_b."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = both.withColumns({f"label_{x}": F.coalesce(f"label_{x}", x) for x in "ab"})
    return both.filter(F.col("label_a") != F.col("label_b"))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes of different components."""
    tied = components(_labelled(links, labels), "label_a", "label_b").select(F.col("node").alias("was"), F.col("label").alias("now"))
    known = labels.join(tied, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    new = tied.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return cut(known.unionByName(new))


def _across(table: pa.Table, percent: int, most: int) -> pa.Table:
    """Links between a block of strangers and another block: for each stranger one to every other component that it reaches.

    Sketches say where to look; the shared shingles of a stranger and the whole other block are counted in an inverted index.
    """
    side = np.array(table["side"].to_pylist())
    label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)[1]
    node = table["node"].to_pylist()
    sketch = np.array(table["sketch"].to_pylist(), np.int64).view(np.uint64)
    texts = vec.flat(table["text"])
    ofs, keys = [], []
    for lo, hi in vec.slices(texts):
        of, hashes = shingles(texts.slice(lo, hi - lo))
        ofs.append(of + lo)
        keys.append(hashes)
    of, hashes = np.concatenate(ofs), np.concatenate(keys)
    size = np.bincount(of, minlength=len(node))
    cut_ = np.concatenate([[0], np.cumsum(size)])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):  # a block of strangers with itself
        right = left
    among = np.isin(of, right)
    order = np.argsort(hashes[among], kind="stable")
    ranked, owner = hashes[among][order], of[among][order]
    a, b = [], []
    for x in left:
        bits = np.bitwise_count(sketch[right] ^ sketch[x]).sum(1)
        near = right[(bits <= most) & (label[right] != label[x])]
        if not len(near):
            continue
        own = hashes[cut_[x] : cut_[x + 1]]
        lo, hi = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.bincount(owner[at], minlength=len(node))[near]
        good = near[100 * shared >= percent * (size[x] + size[near] - shared)]
        if size[x] == 1:
            good = np.array([y for y in good if size[y] > 1 or _only(texts[x].as_py()) == _only(texts[y].as_py())], np.int64)
        _, one = np.unique(label[good], return_index=True)
        a += [node[x]] * len(one)
        b += [node[y] for y in good[one]]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _rest(members: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links a, b between nodes that share a band and are in different components: at least one for every two components linked so.

    Bands whose nodes are not all in one component are put together by the component that most of their nodes are in. Nodes of
    other components in such a group, its strangers, are compared with all its nodes, block by block.
    """
    at = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = at.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("hub")).filter("labels > 1").select("key", "hub")
    group = cut(at.join(sized(cut(mixed), FEW), "key").select("hub", "node", "label").distinct())
    stranger = F.col("label") != F.col("hub")
    sizes = group.groupBy("hub").agg(F.ceil(F.count(F.when(~stranger, 1)) / BLOCK).cast("int").alias("home"), F.ceil(F.count(F.when(stranger, 1)) / BLOCK).cast("int").alias("away"))
    dealt = group.join(sized(cut(sizes), FEW), "hub").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.when(stranger, F.col("away")).otherwise(F.col("home"))).cast("int"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    own = F.col("block")
    # strangers with each block of the others; two blocks of strangers, or one with itself
    out = F.concat(F.transform(upto("home"), lambda m: task(0, own, m, 0)), F.transform(upto("away"), lambda o: F.when(own <= o, task(1, own, o, 0)).otherwise(task(1, o, own, 1))))
    tasks = dealt.select("hub", "node", "label", F.explode(F.when(stranger, out).otherwise(F.transform(upto("away"), lambda o: task(0, o, own, 1)))).alias("task"))
    rows_ = tasks.select("hub", "node", "label", "task.*").join(nodes.select("node", "sketch"), "node").join(texts, "node")
    most = most_bits(percent)
    return rows_.groupBy("hub", "kind", "i", "j").applyInArrow(lambda t: _across(t, percent, most), "a binary, b binary")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, component_id, kept of every row."""
    ship(docs.sparkSession)
    every = cut(signed(docs, percent))
    kind = docs.schema["doc_id"].dataType
    nodes = cut(every.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("doc_id", "text_hash"), F.coalesce(F.hash("doc_id", "text_hash"), F.lit(0))).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("rank"), "node")).alias("pivot"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("pivot.node").alias("pivot"))
    # broadcast where few bands are shared: a band of a third of all nodes is then no task of its own
    members = cut(banded.join(sized(cut(pivots), FEW), "key"))
    pairs = members.filter(F.col("node") != F.col("pivot")).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"), "node").distinct()
    sketches = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    near = cut(pairs.join(sketches("a"), "a").join(sketches("b"), "b").withColumn("bits", _apart("sketch_a", "sketch_b")).filter(F.col("bits") <= most_bits(percent)).select("a", "b", "node", "bits"))
    # the texts of all nodes that share a band
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("row.doc_id").alias("of"), F.col("row.text_hash").alias("hash"))
    wanted = sized(cut(wanted))
    texts = cut(docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("hash"))).select("node", "text").dropDuplicates(["node"]))
    # 1: the nearest pivot of each node
    nearest = near.groupBy("node").agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("pair")).select("pair.*").distinct()
    labels = cut(components(confirm(nearest, texts, percent), "a", "b"))
    # 2: the other pivots in other components
    more = cut(_labelled(near.select("a", "b").distinct(), labels).select("a", "b"))
    if not more.isEmpty():
        labels = _merge(labels, cut(confirm(more, texts, percent)))
    # 3: all that is left
    rest = cut(_rest(members.select("node", "key"), nodes, labels, texts, percent))
    if not rest.isEmpty():
        labels = _merge(labels, rest)
    labelled = nodes.select("node", F.col("doc_id").alias("first")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = labelled.groupBy("label").agg(F.min("first").alias("component"))
    component = labelled.join(named, "label").select(F.col("node").alias("of"), "component")
    out = every.drop("bands", "sketch").join(component, F.col("node") == F.col("of"), "left")
    name = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).cast(kind)
    return out.select("doc_id", "text_hash", "n_shingles", "node", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def scan(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return linked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def clean(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, as it was, and all rows without shingles."""
    found = cut(linked(docs, percent))
    gone = sized(cut(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()))
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
    again = found.filter(F.col("kept") & F.col("node").isNotNull()).groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_doc"))
    if again.isEmpty():
        return left
    # rows of one id in one component: the one of least text hash stays, once
    facts = found.filter("kept and node is not null").join(again, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").groupBy("doc_id", "component_id").agg(F.min("text_hash").alias("_hash")).select(F.col("doc_id").alias("_doc"), "_hash")
    doubtful = left.join(again, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    sure = left.join(again, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti")
    without = doubtful.filter(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) == 0)
    one = doubtful.join(facts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "text"])
    return sure.unionByName(without).unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir), PERCENT)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x
), first AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN first ON d.doc_id = first.doc_id
"""
