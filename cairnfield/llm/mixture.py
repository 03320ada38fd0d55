"""Operator 7, mixing sources to target weights: entropy balancing.

Among all document rates, those closest (in relative entropy) to one copy each that give every source its
target number of words are exponentially tilted: rate = min(CAP, exp(multiplier * size / mean size)), with one multiplier a
source. The multipliers solve the convex dual; distributed Newton iterations, safeguarded by brackets, find them
over a histogram of sizes by source. Rates are rounded to copies on the same histogram, by carrying the error of a whole source
from size to size, largest first: it never exceeds half the largest document, and ends within a fraction of the small documents
where they have room. A size's extra copies are spread evenly over its documents in the order of hashed groups of about GROUP
documents (by id, size and text), so hot sizes are split and no task holds a source's documents. Sizes whose documents all get the same copies, empty ones among them, need
no order and are dealt anyhow.

Newton steps halve their bracket where they would leave it; sources still open after STEPS of them raise an error.
All sums that steer the iterations are exact integers, and ties are ordered by hash and id, so reruns agree.
Targets: sources ordered by code point (null last) weigh WEIGHTS in turn and share TOTAL times all words; no target
exceeds CAP times its source, and the excess goes to the others by weight: the water level solves that at once.

Sources are taken to be few: one row each passes through one task when they are ordered and their targets levelled. Very long texts are counted whole.
Null and empty texts have size 0 and are taken once, as no words; null sources are one source; null ids are fine; repeated
rows are judged one by one (and may differ, as one of two equal rows may be taken more often); an empty table gives no rows; further columns pass through where asked for.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.llm import rows, vec
from cairnfield.session import cut

WEIGHTS, TOTAL, CAP, GROUP = (3.0, 1.0, 2.0), 1.5, 2.0, 1024
STEPS, NEAR, UNIT, SMALL = 60, 1e-6, 10**9, 100_000


def sized(docs: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, source, text_hash, carried columns (under a prefix) and mix_size of every row."""
    carry = [c for c in carry if c not in ("doc_id", "source")]
    others = [F.col(c).alias(f"in_{c}") for c in carry if c != "text"]
    plain = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.col("text").alias("in_text"), *others)
    dropped = [] if "text" in carry else ["in_text"]
    kept = [c for c in plain.columns if c not in dropped]
    schema = plain.drop(*dropped).schema.add("mix_size", "long")
    return rows.map_texts(plain, lambda texts, _: {"mix_size": vec.Words(texts, hashed=False).count.astype(np.int64)}, kept, schema, text="in_text")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target of each source, from source, mix_size, n."""
    total = sizes.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    weighed = total.withColumn("weight", weigh).withColumn("most", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = TOTAL * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "source", "level"))).over(everything)["level"]
    return leveled.withColumn("free", free).select("source", "source_size", "n_docs", F.least(F.coalesce(F.col("free") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def rate(multiplier: str = "multiplier", size: str = "mix_size") -> F.Column:
    tilt = F.col(multiplier) * F.col(size) / F.col("mean_size")
    return F.when(F.col("full"), F.lit(CAP)).otherwise(F.least(F.lit(CAP), F.exp(F.least(tilt, F.lit(2.0)))))


def solve(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target, mean_size, full, multiplier: the dual's solution."""
    start = wanted.select("*", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)).alias("mean_size"), (F.col("target") >= F.col("source_size") * CAP * (1 - 1e-12)).alias("full"))
    state = cut(start.select("*", F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.col("full").alias("done")))
    few = state.count() <= SMALL
    for _ in range(STEPS):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        at = sizes.withColumnRenamed("source", "of").join(F.broadcast(open_) if few else open_, F.col("of").eqNullSafe(F.col("source")))
        r = rate()
        gain = lambda x: F.sum((F.round(x * UNIT).cast("decimal(20,0)") * F.col("mix_size").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")).cast("double") / UNIT
        value = at.groupBy(F.col("source").alias("of")).agg(gain(r).alias("value"), gain(F.when(r < CAP, r * F.least(F.col("mix_size") / F.col("mean_size"), F.lit(1e9))).otherwise(0.0)).alias("slope"))
        joined = state.join(value, F.col("of").eqNullSafe(F.col("source")), "left")
        over = F.col("value") - F.col("target")
        lo, hi = F.when(over < 0, F.col("multiplier")).otherwise(F.col("lo")), F.when(over >= 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - over / F.col("slope")
        middle = F.when(lo.isNull(), 2 * hi - 1).when(hi.isNull(), 2 * lo + 1).otherwise((lo + hi) / 2)
        inside = (F.col("slope") > 0) & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        done = F.col("done") | F.col("value").isNull() | (F.abs(over) <= NEAR * F.col("target")) | F.coalesce(hi - lo <= 1e-12, F.lit(False))
        moved = F.when(done, F.col("multiplier")).when(inside, newton).otherwise(middle)
        state = cut(joined.select("source", "source_size", "n_docs", "target", "mean_size", "full", moved.alias("multiplier"), lo.alias("lo"), hi.alias("hi"), done.alias("done")))
    else:
        if not (late := state.filter(~F.col("done"))).isEmpty():
            raise RuntimeError(f"no multipliers after {STEPS} steps for sources such as {late.first()['source']!r}")
    return state.drop("lo", "hi", "done")


def allotted(size: np.ndarray, rates: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Copies of n documents of each size, in the given order: the rate rounded down for all, and one more for so many of them, by what is missing so far."""
    low, extra, missing = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0.0
    for k, (s, r, m) in enumerate(zip(size.tolist(), rates.tolist(), n.tolist(), strict=True)):
        if not s:
            low[k] = 1
            continue
        low[k] = int(r)
        missing += (r - int(r)) * s * m
        extra[k] = min(max(round(missing / s), 0), m if r > int(r) else 0)
        missing -= int(extra[k]) * s
    return low, extra


def rounded(size: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies for rates in the given order: each is the rate rounded up or down, by what is missing so far."""
    return sum(allotted(size, rates, np.ones(len(size), np.int64)))


def _allot(table: pa.Table) -> pa.Table:
    table = table.sort_by([("mix_size", "descending")])
    low, extra = allotted(table["mix_size"].to_numpy(), table["rate"].to_numpy(), table["n"].to_numpy())
    return table.append_column("low", pa.array(low)).append_column("extra", pa.array(extra))


def mix(docs: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """doc_id, source, carried columns, size, source_size, target, rate, copies, taken of every row."""
    carry = [c for c in carry if c not in ("doc_id", "source")]
    base = sized(docs, carry).withColumn("_tie", F.xxhash64("doc_id", "mix_size", "text_hash")).drop("text_hash")
    light = cut(base.select("source", "mix_size", "_tie"))
    sizes = cut(light.groupBy("source", "mix_size").agg(F.count("*").alias("n")))
    solved = solve(sizes, targets(sizes))
    sent = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    rated = sizes.join(sent(solved.withColumnRenamed("source", "of")), F.col("of").eqNullSafe(F.col("source"))).select("source", "mix_size", "n", "source_size", "target", rate().alias("rate"))
    allot = cut(rated.groupBy("source").applyInArrow(_allot, rated.select("*").schema.add("low", "long").add("extra", "long")))
    of = lambda df, *names: df.select(F.col("source").alias("of"), F.col("mix_size").alias("of_size"), *names)
    same = F.col("of").eqNullSafe(F.col("source")) & (F.col("of_size") == F.col("mix_size"))
    group = F.pmod(F.xxhash64("_tie"), F.ceil(F.col("n") / GROUP)).cast("long").alias("_group")
    # documents of a size that come in the groups before; where all of a size get the same, there is no order to keep
    in_order = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    counted = light.join(sent(of(allot.filter(in_order & (F.col("n") > GROUP)), "n")), same).select("source", "mix_size", group).groupBy("source", "mix_size", "_group").agg(F.count("*").alias("here"))
    before = Window.partitionBy("source", "mix_size").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counted.withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0))))
    joined = base.join(sent(of(allot, "n", "source_size", "target", "rate", "low", "extra")), same).select(*base.columns, "n", "source_size", "target", "rate", "low", "extra", group)
    placed = joined.join(sent(of(starts, F.col("_group").alias("of_group"), "start")), same & (F.col("of_group") == F.col("_group")), "left")
    number = F.row_number().over(Window.partitionBy("source", "mix_size", "_group").orderBy("_tie", "doc_id"))
    # documents that need no number have groups by the part that they are read from
    dealt = placed.withColumn("_group", F.when(in_order, F.col("_group")).otherwise(-1 - F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / GROUP))))
    numbered = dealt.withColumn("_at", F.when(in_order, number + F.coalesce("start", F.lit(0))).otherwise(1))
    out = numbered.withColumn("copies", F.expr("if(extra >= n, low + if(extra > 0, 1, 0), low + (_at * extra) div n - ((_at - 1) * extra) div n)").cast("long")).withColumn("taken", F.col("copies") * F.col("mix_size"))
    return out.select("doc_id", "source", *[F.col(f"in_{c}").alias(c) for c in carry], F.col("mix_size").alias("size"), "source_size", "target", "rate", "copies", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(rows.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
