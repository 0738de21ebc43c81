"""Mixing sources to target weights by subset-sum budget fitting.

Each source repeats all its documents `whole` times and fits the remaining
budget exactly where sizes allow: counts of documents by exact size are taken
down in proportion, and a bounded-knapsack dynamic program over the sizes left
closes the gap. Which documents of a size are taken follows a seeded hash.

Only counts by (source, size) meet in one task, never documents. Groups of one
size are cut into hash buckets of about BUCKET_ROWS documents: whole buckets
are taken below the bucket that holds the cut, and only that one is ranked. The
hash takes in the text too, so rows that share a doc_id, or have none, fall into many buckets.

Defined results: null text has size 0; documents of size 0 take 0 words; a
source (null is a source of its own) with size 0 has target 0; an empty table
gives no rows; repeated rows count each; rows without doc_id are mixed like
others; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, input_columns, numbered, save

#: A source takes at most this many copies of a document.
MOST_REPEATS = 3
#: Words that the dynamic program may have to fit at most; what it gets is never more, see _closed.
FIT_WORDS = 1 << 17
BUCKET_ROWS = 1000


def word_count(text: F.Column | str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float = 1.0, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, have the weights in turn; a target
    over `most` times its source stops there and the excess is shared again by
    weight. In the order of size per weight the stopped sources are a prefix,
    so running sums find them without iterating."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    df = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    df = df.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    df = df.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    df = df.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
    df = df.withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    free = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free * F.col("w")).alias("target"))


def _program(size: np.ndarray, left: np.ndarray, goal: int) -> np.ndarray:
    """How many of `left` documents of each size to take so that their words come to `goal` as nearly as possible, not over it.

    A bounded-knapsack dynamic program whose states are the bits of an integer and whose items are powers of two of a count."""
    take = np.zeros(len(size), dtype=np.int64)
    usable = [i for i in np.argsort(size, kind="stable").tolist() if size[i] <= goal and left[i] > 0]
    if not usable:
        return take
    mask, reach, steps = (1 << (goal + 1)) - 1, 1, []
    for i in usable:
        s, n, k = int(size[i]), 0, 1
        rest = min(int(left[i]), goal // s)
        while rest > 0 and not reach >> goal & 1:
            n = min(k, rest)
            steps.append((i, n, reach))
            reach = (reach | reach << (n * s)) & mask
            rest -= n
            k *= 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    for i, n, had in reversed(steps):
        if not had >> at & 1:
            take[i] += n
            at -= n * int(size[i])
    return take


def _closed(size: np.ndarray, count: np.ndarray, take: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """take with the remaining budget closed as far as the program can, and the words still missing.

    The greatest sizes that fit go in first, down to half of FIT_WORDS, then without a
    margin; after that the rest is within FIT_WORDS or nothing left over fits into it."""
    take = take.copy()
    for floor, margin in ((FIT_WORDS // 2, FIT_WORDS // 4), (FIT_WORDS, 0)):
        for i in np.argsort(-size, kind="stable"):
            if rest <= floor:
                break
            more = min(int(count[i] - take[i]), (rest - margin) // int(size[i]))
            if more > 0:
                take[i] += more
                rest -= more * int(size[i])
    # one of each of some sizes goes back, so that the program has something to exchange
    back = np.flatnonzero((take > 0) & (size <= FIT_WORDS // 8))
    for i in back[np.argsort(size[back], kind="stable")][::-1][:16]:
        if rest + int(size[i]) <= FIT_WORDS:
            take[i] -= 1
            rest += int(size[i])
    if rest <= FIT_WORDS:
        more = _program(size, count - take, rest)
        take += more
        rest -= int((more * size).sum())
    return take, rest


def fit(size: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come to `budget` as nearly as possible, not over it.

    Sizes are positive and distinct. A budget within FIT_WORDS goes to the bounded-knapsack
    program as a whole and is met as nearly as any choice can. A greater one starts from
    proportional counts, and the program closes the rest. If words are missing still, each
    size that didn't fit is tried in the place of smaller documents."""
    size, count = size.astype(np.int64), count.astype(np.int64)
    total = int((size * count).sum())
    if budget >= total:
        return count
    if budget <= FIT_WORDS:
        return _program(size, count, budget)
    take = (count * (budget / total)).astype(np.int64)
    rest = budget - int((size * take).sum())
    while rest < 0:  # rounding of a large product
        i = int(np.argmax(take * size))
        take[i] -= 1
        rest += int(size[i])
    best, gap = _closed(size, count, take, rest)
    for i in np.argsort(size, kind="stable")[::-1]:
        if not gap or size[i] <= FIT_WORDS // 8:
            break
        if best[i] < count[i] and size[i] <= budget:
            # room for one more of this size by smaller documents, the greatest first
            other, need = best.copy(), int(size[i]) - gap
            for j in np.argsort(-size, kind="stable"):
                if size[j] < size[i] and need > 0:
                    n = min(int(other[j]), -(-need // int(size[j])))
                    other[j] -= n
                    need -= n * int(size[j])
            if need <= 0:
                other[i] += 1
                other, left = _closed(size, count, other, -need)
                if left < gap:
                    best, gap = other, left
    return best


def _plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Per (source, size): copies that all documents get, and how many documents get one more."""
    rows = rows.sort_values("size", kind="stable")
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = min(int(target // total), MOST_REPEATS) if total else 0
    some = rows["size"].to_numpy() > 0
    extra = np.zeros(len(rows), dtype=np.int64)
    if total and whole < MOST_REPEATS:
        extra[some] = fit(rows["size"].to_numpy()[some], rows["n"].to_numpy()[some], int(round(target - whole * total)))
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "source_size": rows["source_size"], "target": rows["target"], "whole": whole, "extra": extra})


def mix_sources(docs: DataFrame, weights: Iterable[float] = (1.0, 2.0, 3.0), share: float = 1.0, seed: int = 7, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and the column `row` if given, for every row of docs (doc_id, text, source)."""
    keys = ["doc_id", row] if row else ["doc_id"]
    rows = input_columns(docs, *keys, "source", "text")
    rows = save(rows.select(*keys, "source", word_count("text").alias("size"), F.xxhash64(F.lit(seed), *keys, *([] if row else ["text"])).alias("lot")), "mix-sizes")
    counts = save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(per_source, tuple(weights), share)
    goals = goals.withColumnRenamed("source", "s")
    both = counts.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target")
    plan = both.groupBy("source").applyInPandas(_plan_source, "source string, size long, source_size long, target double, whole int, extra long")
    plan = plan.join(counts.toDF("s", "z", "n"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    plan = save(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long")), "mix-plan")
    # place each document in a bucket of its group; the buckets' counts tell where the cut falls
    r, p = rows.alias("r"), plan.alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")))
    placed = joined.select(*[f"r.{k}" for k in keys], "r.source", "r.size", "r.lot", "source_size", "target", "whole", "extra", "n", F.pmod("r.lot", "buckets").alias("bucket"))
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    copies_all = F.col("whole") + F.when(F.col("extra") >= F.col("n"), F.when(F.col("n") > 0, 1).otherwise(0)).otherwise(0)
    settled = placed.where(~partly).select(*keys, "source", "size", "source_size", "target", copies_all.cast("int").alias("copies"))
    placed = placed.where(partly)
    per_bucket = placed.groupBy("source", "size", "bucket").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    order = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = per_bucket.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"), (F.col("extra") - F.coalesce(F.sum("m").over(order), F.lit(0))).alias("room"), "m")
    got = placed.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    ranked = got.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("lot", *keys)))
    fitted = ranked.select(*keys, "source", "size", "source_size", "target", (F.col("whole") + (F.col("rank") <= F.col("room")).cast("int")).cast("int").alias("copies"))
    return settled.unionByName(fitted)


def mixed_documents(docs: DataFrame, weights: Iterable[float] = (1.0, 2.0, 3.0), share: float = 1.0, seed: int = 7) -> DataFrame:
    """The rows of the mix themselves, each as many times as the mix takes it."""
    keyed = numbered(docs, "mix-rows")
    plan = mix_sources(keyed.select("row.doc_id", "row.source", "row.text", "key"), weights, share, seed, "key").where("copies > 0").select("key", "copies")
    return keyed.join(plan, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
