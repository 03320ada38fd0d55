r"""Operator 11, phrase collocation mining: a weighted de Bruijn graph of each language's words.

Texts are cut into pieces at punctuation and line ends, pieces into words. An edge is a run of three words inside a piece (the longest phrase asked for), weighted by its
occurrences; it joins the nodes of its first two and its last two words. Shorter counts come from the flow: a pair of words occurs once for each edge
that leaves its node, and once more for each piece that ends with it; a word occurs once for each pair that it begins, and once for each piece that it ends.

Chunks of the corpus build their own graphs and their flows, both of which add up, and send edges, pairs and words with their counts to blocks of a hashed
index (see exchange.py). Blocks add them and ask one chunk that has it to spell each one of at least LEAST occurrences. What is spelled is the graph of frequent
phrases. Its unary paths, nodes that are entered and left by one edge each and by nothing else, are compacted by pointer doubling: inside of
a path every pair has the path's weight, so repeated passages become single rows, and their inner pairs, which lie within
an edge of the same weight, are dropped at once. Only pairs at the ends of paths are looked up and compared with their edges.

Scores are integers by exact division of 38-digit decimals (for counts of up to 10^15). A phrase's score is that of its weakest cut. The report is each
language's first TOP phrases; nothing else is limited.

Null texts are empty; empty texts and pieces have no words. A null language is `und`, every other value is one of its own. Repeated rows count each. Ties of score go to
the more frequent, then the lesser phrase by bytes. Empty tables give no rows. Further columns are ignored. Very long texts are whole, in a chunk of their own if
need be; equal texts are dealt apart by id and by the part of the table that they are read from. Phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.llm import exchange, rows, vec
from cairnfield.session import cut

LEAST, TOP, SHARE, CHUNK_BYTES = 10, 2000, 50, 6 << 20
#: Rows up to which a side of a join is broadcast, after counting it, and parts in which a language's first phrases are found before they meet.
SMALL, PARTS = 200_000, 32
UNKNOWN = "und"
#: What ends a piece, and what parts words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False

NAMES = ("word", "pair", "edge")
ASKED = "block long, chunk long, " + ", ".join(f"{n} binary, {n}_n binary" for n in NAMES)
SPELLED = "kind int, lang string, phrase string, key long, first long, last long, word1 long, word2 long, a long"


def _follows(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return vec.mix(before * np.uint64(0xD6E8FEB86659FD93) + after)


def _summed(keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and the sums of n."""
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, at[first], np.bincount(of, n, len(distinct)).astype(np.int64)


class Graph:
    """A chunk's weighted graph: keys, places (of the first word, somewhere in the chunk) and counts of its words, pairs and edges."""

    def __init__(self, table: pa.Table):
        texts = vec.flat(table["text"])
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
        data, offsets = vec.buffers(vec.flat(langs.dictionary))
        salt = vec.mix(vec.ranges(data, offsets[:-1], offsets[1:]))
        self.parts, words, begins, of = [], [], [], []
        for lo, hi in vec.slices(texts):
            part = vec.Words(texts.slice(lo, hi - lo), lower=True, within=INSIDE)
            text, piece = part.text(), np.cumsum(ENDS[part.data])[part.start]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
            words.append(part.hash)
            begins.append(new)
            of.append(lang[lo:hi][text])
            self.parts.append((part.data, part.start, part.end))
        empty = np.zeros(0, np.int64)
        self.lang = np.concatenate(of or [empty])
        self.from_part = np.cumsum([0, *map(len, words)])
        one = vec.mix(np.concatenate(words or [empty.astype(np.uint64)]) ^ salt[self.lang]) if len(self.lang) else empty.astype(np.uint64)
        new = np.append(np.concatenate(begins or [empty.astype(bool)]), True)
        two = ~new[1:]  # another word of the piece follows
        three = two & np.append(two[1:], False)
        pair = np.zeros_like(one)
        at = np.flatnonzero(two)
        pair[at] = _follows(one[at], one[at + 1])
        at = np.flatnonzero(three)
        edge = _summed(_follows(pair[at] ^ np.uint64(0x14057B7EF767814F), one[at + 2]), at, np.ones(len(at)))
        flow = lambda keys, inner, ends: _summed(keys[np.append(inner[1], ends)], np.append(inner[1], ends), np.append(inner[2], np.ones(len(ends), np.int64)))
        pairs = flow(pair, edge, np.flatnonzero(two & ~three))
        self.one, self.pair = one, pair
        self.made = {"word": flow(one, pairs, np.flatnonzero(~two)), "pair": pairs, "edge": edge}

    def spelt(self, at: int, words: int) -> str:
        """The phrase of so many words at a place."""
        k = int(np.searchsorted(self.from_part, at, "right")) - 1
        data, start, end = self.parts[k]
        at -= int(self.from_part[k])
        return b" ".join(data[start[i] : end[i]].tobytes() for i in range(at, at + words)).decode("utf-8", "replace")


def ask(table: pa.Table, blocks: int) -> pa.Table:
    graph, packed = Graph(table), {}
    for name in NAMES:
        keys, _, n = graph.made[name]
        found, cuts = exchange.blocks_of(keys, blocks)
        for k, b in enumerate(found.tolist()):
            row = packed.setdefault(b, {})
            row[name], row[f"{name}_n"] = exchange.pack_keys(keys[cuts[k] : cuts[k + 1]]), exchange.pack(n[cuts[k] : cuts[k + 1]])
    out = {"block": pa.array(list(packed), pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * len(packed), pa.int64())}
    return pa.table(out | {c: pa.array([r.get(c, b"") for r in packed.values()], pa.binary()) for name in NAMES for c in (name, f"{name}_n")})


def settle(table: pa.Table, least: int) -> pa.Table:
    """The keys of at least so many occurrences in all, with their counts, for the first chunk that has them."""
    chunks, out = table["chunk"].to_numpy(), {}
    for name in NAMES:
        keys, sizes = exchange.keys_of(table, name)
        n = np.concatenate([exchange.unpack(x) for x in table[f"{name}_n"].to_pylist() if x] or [np.zeros(0, np.int64)])
        distinct, chunk, total = _summed(keys, np.repeat(chunks, sizes), n)
        often = np.flatnonzero(total >= least)
        often = often[np.argsort(chunk[often], kind="stable")]
        asked, begin = np.unique(chunk[often], return_index=True)
        for c, mine in zip(asked.tolist(), np.split(often, begin)[1:], strict=True):
            out.setdefault(c, {}).update({name: exchange.pack_keys(distinct[mine]), f"{name}_n": exchange.pack(total[mine])})
    columns = {"block": pa.array([table["block"][0].as_py()] * len(out), pa.int64()), "chunk": pa.array(list(out), pa.int64())}
    return pa.table(columns | {c: pa.array([r.get(c, b"") for r in out.values()], pa.binary()) for name in NAMES for c in (name, f"{name}_n")})


def spell(left: pa.Table, right: pa.Table) -> pa.Table:
    """What a chunk is asked to spell; and, as kind 0, its words by language."""
    graph, out = Graph(left), {c.split()[0]: [] for c in SPELLED.split(", ")}
    signed = lambda x: x.astype(np.int64).tolist()

    def add(kind: int, at: np.ndarray, n: list, phrases: list[str], **keys: list) -> None:
        out["kind"] += [kind] * len(n)
        out["lang"] += [graph.langs[k] for k in graph.lang[at]] if kind else graph.langs
        out["phrase"] += phrases
        out["a"] += n
        for c in ("key", "first", "last", "word1", "word2"):
            out[c] += keys.get(c, [0] * len(n))

    add(0, np.zeros(0, np.int64), np.bincount(graph.lang, minlength=len(graph.langs)).tolist(), [""] * len(graph.langs))
    for kind, name in enumerate(NAMES, 1):
        keys, at, _ = graph.made[name]
        asked, sizes = exchange.keys_of(right, name)
        if not len(asked):
            continue
        n = np.concatenate([exchange.unpack(x) for x in right[f"{name}_n"].to_pylist() if x])
        at = at[np.searchsorted(keys, asked)]
        ends = {} if kind == 1 else {"word1": signed(graph.one[at]), "word2": signed(graph.one[at + kind - 1])}
        nodes = {} if kind < 3 else {"first": signed(graph.pair[at]), "last": signed(graph.pair[at + 1])}
        add(kind, at, n.tolist(), [graph.spelt(i, kind) for i in at.tolist()], key=signed(asked), **ends, **nodes)
    kinds = {"kind": pa.int32(), "lang": pa.string(), "phrase": pa.string()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def frequent(docs: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The graph of phrases of at least so many occurrences, as SPELLED: words (kind 1), pairs (2: word1, word2), edges (3: also their nodes, first and last), and
    every chunk's words by language (0)."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "doc_id", "text").filter(F.octet_length("text") > 0)
    dealt, chunks = exchange.chunked(texts, ["lang", "text"], chunk_bytes, same=("lang", "doc_id", "text"))
    n, by_chunk = exchange.partitions(docs.sparkSession, chunks), dealt.groupBy("chunk")
    asked = by_chunk.applyInArrow(lambda t: ask(t, chunks), ASKED).repartition(n, "block")
    settled = asked.groupBy("block").applyInArrow(lambda t: settle(t, least), ASKED)
    return by_chunk.cogroup(settled.groupBy("chunk")).applyInArrow(spell, SPELLED)


def heads(links: DataFrame) -> DataFrame:
    """key, head, steps of every edge that another one leads into (links: key, before): the first edge of its path and how far it is from it. Each round doubles how far edges see."""
    state = cut(links.select("key", F.col("before").alias("head"), F.lit(1).alias("steps"), F.lit(True).alias("open")))
    while not state.filter("open").isEmpty():
        seen = state.select(F.col("key").alias("_key"), F.col("head").alias("_head"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        joined = state.filter("open").join(seen, F.col("head") == F.col("_key"), "left")
        further = joined.select("key", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_open", F.lit(False)).alias("open"))
        state = cut(state.filter("not open").unionByName(further))
    return state.select("key", "head", "steps")


def paths(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The unary paths (lang, words, steps: word1 and word2 of each edge, a, first, last), single edges among them; and the pairs inside of paths: key."""
    into = edges.groupBy(F.col("last").alias("node")).agg(F.count("*").alias("ins"), F.max("a").alias("a_in"), F.max("key").alias("before"))
    out = edges.groupBy(F.col("first").alias("node")).agg(F.count("*").alias("outs"), F.max("a").alias("a_out"), F.max("key").alias("key"))
    whole = (F.col("ins") == 1) & (F.col("outs") == 1) & (F.col("a_in") == F.col("a_out")) & (F.col("a_in") == F.col("a"))
    through = cut(pairs.select(F.col("key").alias("node"), "a").join(into, "node").join(out, "node").filter(whole).select("node", "key", "before"))
    placed = edges.join(heads(through.select("key", "before")), "key", "left").withColumns({"head": F.coalesce("head", "key"), "steps": F.coalesce("steps", F.lit(0))})
    step = F.struct("steps", "phrase", "word1", "word2", "first", "last")
    packed = placed.groupBy("head").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.array_sort(F.collect_list(step)).alias("s"))
    words = F.concat(F.split(F.get("s", F.lit(0))["phrase"], " "), F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))), lambda x: F.substring_index(x["phrase"], " ", -1)))
    ends = {"first": F.get("s", F.lit(0))["first"], "last": F.element_at("s", -1)["last"]}
    made = packed.select("lang", words.alias("words"), F.transform("s", lambda x: F.struct(x["word1"].alias("word1"), x["word2"].alias("word2"))).alias("steps"), "a", *[v.alias(k) for k, v in ends.items()])
    return made, through.select(F.col("node").alias("key"))


#: floor(10^6 a a / (l r)), exactly.
SCORE = "(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(18,0)))"


def mined(graph: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates that no longer one has (graph: SPELLED, of files)."""
    words = graph.filter("kind = 1").select("key", "a")
    words = F.broadcast(words) if words.count() <= SMALL else words
    pairs = graph.filter("kind = 2").select("key", "lang", "phrase", "word1", "word2", "a")
    chains, inner = paths(graph.filter("kind = 3").drop("kind"), pairs)
    chains = cut(chains)
    # pairs at paths' ends, and those without any edge
    outer = cut(pairs.join(inner, "key", "left_anti"))
    near = chains.select(F.col("first").alias("key"), "a").unionByName(chains.select(F.col("last").alias("key"), "a")).groupBy("key").agg(F.max("a").alias("longer"))
    alone = outer.join(near, "key", "left").filter((F.col("longer").isNull()) | (100 * F.col("longer") < share * F.col("a")))
    count = lambda df, key, name: df.join(words.select(F.col("key").alias(key), F.col("a").alias(name)), key)
    twos = count(count(alone, "word1", "l"), "word2", "r").select("lang", "phrase", "a", "l", "r", F.expr(SCORE.format(l="l", r="r")).alias("score"))
    flow = lambda key, name: outer.select(F.col("key").alias(key), F.col("a").alias(name))
    ends = chains.join(flow("first", "first_a"), "first").join(flow("last", "last_a"), "last")
    each = ends.select("lang", "a", "first_a", "last_a", F.size("steps").alias("n"), "words", F.posexplode("steps").alias("at", "s")).select(
        "lang", F.array_join(F.slice("words", F.col("at") + 1, F.lit(3)), " ").alias("phrase"), "a", F.col("s.word1").alias("word1"), F.col("s.word2").alias("word2"),
        F.when(F.col("at") == 0, F.col("first_a")).otherwise(F.col("a")).alias("l2"), F.when(F.col("at") == F.col("n") - 1, F.col("last_a")).otherwise(F.col("a")).alias("r1"),
    )
    counted = count(count(each, "word1", "l1"), "word2", "r2").withColumns({"s1": F.expr(SCORE.format(l="l1", r="r1")), "s2": F.expr(SCORE.format(l="l2", r="r2"))})
    later = F.col("s2") < F.col("s1")
    threes = counted.select("lang", "phrase", "a", *[F.when(later, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c if c != "s" else "score") for c in ("l", "r", "s")])
    return reduce(DataFrame.unionByName, [twos, threes])


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases (docs: lang, doc_id, text)."""
    graph = cut(frequent(docs, least, chunk_bytes))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = mined(graph).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = graph.filter("kind = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(rows.documents(spark, sf_dir))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
  ) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer AS o ON c.k = 2 AND c.lang = o.lang AND c.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS one, array_to_string(w[cut + 1:], ' ') AS two FROM kept, (VALUES (1), (2)) AS places(cut) WHERE cut < k
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score, cut
  FROM cuts AS c JOIN f AS l ON c.lang = l.lang AND c.one = l.phrase JOIN f AS r ON c.lang = r.lang AND c.two = r.phrase
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
