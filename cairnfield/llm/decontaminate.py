r"""Operator 1, benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of WINDOW words (the whole item, if shorter). A window lies in a document
only if all its tokens do, so one prefix token decides: with containment 1 the necessary prefix of a window, ordered by
rarity in the documents, is its rarest token. Documents' words are joined with those prefix tokens; length and
positional bounds leave the candidates whose window fits between the document's ends at that place; the
candidate's words are then compared one by one with the window, over a slice as long as the item's window.

Windows are told apart by their words, not by item: a window that many items share is looked up once, and its set of items is put in
at the end. The documents are read once for the rarities of all windows and once for the join, however large the benchmark is: up to BLOCK
windows are broadcast; with more, their prefix tokens alone are (in rounds of SMALL tokens), and the places where documents have one are
shuffled, with the words around them, to the windows. Ties in rarity go to the lesser token, then the earlier place. Very long texts are one array of words.

Null and empty texts have no words and no hits; an item without words has no window; an item with a null id counts as
the id ''. Rows are told apart by doc_id (nulls are one id) and text, so repeated rows get equal results. Empty tables
give no rows, or no hits. Further columns are ignored by scan() and kept by clean(); none is confused with a result's.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm import rows
from cairnfield.session import cut

WINDOW, BLOCK, SMALL, MOST_BYTES = 10, 100_000, 500_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; ASCII texts take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame) -> DataFrame:
    """win (its words), n (their number), items (the sorted ids that have it), each window once."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut_ = item.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))).alias("at"))
    return cut_.select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("win")).groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.size("win"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))


def _sent(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SMALL else df


def _sent_sets(sets: DataFrame) -> DataFrame:
    """Sets of items, broadcast if all their ids take at most MOST_BYTES."""
    taken = sets.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(",", "items")).cast("long") + 40 * F.size("items") + 100), F.lit(0))).first()[0]
    return F.broadcast(sets) if taken <= MOST_BYTES else sets


def prefixed(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """win, n, set, token (its rarest word), at (its place in the window) of the windows whose words documents have."""
    tokens = cut(wins.select(F.explode("win").alias("token")).distinct())
    many = tokens.count()
    seen = cut(_identified(docs).select(F.explode("w").alias("token")).join(_sent(tokens, many), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen")))
    places = wins.select("win", "n", "set", F.posexplode("win").alias("at", "token"))
    rarest = places.join(_sent(seen, many), "token", "left").groupBy("win", "n", "set").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "at")).alias("first"))
    # a token that no document has rules its window out
    return rarest.filter("first.seen > 0").select("win", "n", "set", F.col("first.token").alias("token"), F.col("first.at").alias("at"))


def hits(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """doc, text_hash, set, start (0-based word), n of every occurrence of the windows."""
    placed = _identified(docs).select("doc", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    fits = (F.col("n") <= F.col("n_words")) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if prefix.count() <= BLOCK:
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win")
        found = placed.join(F.broadcast(prefix), (F.col("word") == F.col("token")) & fits & same)
        return found.select("doc", "text_hash", "set", start.alias("start"), "n")
    tokens = cut(prefix.select("token").distinct())
    rounds = math.ceil(tokens.count() / SMALL)
    dealt = tokens.select(F.col("token").alias("word"), F.pmod(F.xxhash64("token"), F.lit(rounds)).alias("round"))
    # the words around a place: as many before and after it as a window may need
    low = F.greatest(F.col("pos") - WINDOW + 1, F.lit(0))
    around = F.slice("w", low + 1, F.lit(2 * WINDOW - 1)).alias("around")
    asked = [placed.join(F.broadcast(dealt.filter(F.col("round") == k)), "word", "left_semi").select("doc", "text_hash", "n_words", "pos", "word", low.alias("low"), around) for k in range(rounds)]
    same = F.slice("around", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("n")) == F.col("win")
    found = reduce(DataFrame.unionByName, asked).join(prefix, (F.col("word") == F.col("token")) & fits & same)
    return found.select("doc", "text_hash", "set", start.alias("start"), "n")


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hits() of the benchmark's windows, and the sets of items in them: set, items."""
    every = cut(windows(benchmark))
    sets = cut(every.select("items").distinct().withColumn("set", F.monotonically_increasing_id()))
    wins = every.join(sets, "items").select("win", "n", "set")
    return hits(docs, cut(prefixed(docs, cut(wins)))), sets


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row, and text_hash."""
    found, sets = occurrences(docs, benchmark)
    spans = cut(found.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"), F.array_sort(F.collect_set("set")).alias("sets")))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["total"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("total"), F.greatest(x["end"], a["end"]).alias("end")),
    )
    row = [F.col("doc").alias("hit_doc"), F.col("text_hash").alias("hit_hash")]
    # documents of the same sets share their list of items: it is made once, however many they are
    listed = spans.select(F.col("sets").alias("of_sets")).distinct().select("of_sets", F.explode("of_sets").alias("set")).join(_sent_sets(sets), "set")
    items = listed.groupBy("of_sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    named = items.select("of_sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    by_doc = spans.select(*row, "sets", union["total"].cast("long").alias("n_hit")).join(named, F.col("sets") == F.col("of_sets")).drop("sets", "of_sets")
    counted = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(_sent(by_doc, spans.count()), F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    return joined.select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "text_hash",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any hit, as they were. The ids of the others are broadcast up to SMALL rows, counted before."""
    bad = cut(occurrences(docs, benchmark)[0].select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct())
    bad = F.broadcast(bad) if bad.count() <= SMALL else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rows.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS sizes WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), p AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
