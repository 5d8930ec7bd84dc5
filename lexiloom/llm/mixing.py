"""Mixing sources to target weights by pivotal dependent rounding.

A source's target asks for target / source_size copies of each of its documents. The whole part is taken at once. The
fractional parts are rounded by the pivotal method: two documents meet, one probability takes mass from the other at
random until one of them is 0 or 1, and the undecided one meets the next document. Mass is words: what one gains in
probability times its size the other loses, and the two ways it may go are drawn so that no document's chance changes.
Blocks of bounded size run this side by side; a block ends with one undecided document at most, and those meet in blocks
again, level by level, until a source has one left, which goes to the nearer end, half of that document from the target at most. So that this is not a
large one, documents of more than HEAVY of their source's words are rounded first, by pairs and the last by a draw, and
what that moves the sum is spread over the chances of the source's other documents; if they cannot take it, the last
heavy one goes to the nearer end instead.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last; documents
repeated with one doc_id are rounded one by one; draws depend on the seed, the source and the ids alone, so reruns and
other partitionings agree; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table, text_of

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST_COPIES = 3
#: Documents that meet in one block.
BLOCK = 4096
#: Documents with a larger share of their source's words are rounded first; a source has less than 1 / HEAVY of them.
HEAVY = 0.01
SEED = 20


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, n, source_size and target of each source, from a table (source, size).

    Targets share the sum of all sizes by weight. A target above MOST_COPIES times its source's size stops there, and
    the excess is shared anew. Sorted by size over weight the capped sources come first, so the fixed point is found by
    running sums: the first source whose share of what the earlier ones leave is within its cap sets the level for the rest.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 0).alias("n_sized"), F.sum("size").cast("long").alias("source_size"))
    # from here on there is one row for each source
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighed = stats.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), place + 1))
    by_ratio = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    cap = F.lit(MOST_COPIES) * F.col("source_size")
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighed.select("*", (left / weight_left).alias("__level"), cap.alias("__cap"), F.row_number().over(by_ratio).alias("__rank"))
    fits = F.col("__cap") >= F.col("weight") * F.col("__level")
    first = F.min(F.when(fits, F.struct("__rank", "__level"))).over(everything)
    shared = ranked.withColumn("__first", first)
    target = F.when(F.col("__rank") < F.col("__first.__rank"), F.col("__cap").cast("double")).otherwise(F.col("weight") * F.col("__first.__level"))
    return shared.withColumn("__target", target).select("source", "n", "n_sized", "source_size", F.col("__target").alias("target"))


def pivot(probabilities: np.ndarray, sizes: np.ndarray, seed: str) -> np.ndarray:
    """Rounds probabilities by pairs, in order, keeping the sum of probability times size; one entry at most is left that is neither 0 nor 1."""
    out = probabilities.astype(float).tolist()
    draws = np.random.default_rng(xxhash.xxh64_intdigest(seed)).random(len(out))
    open_ = -1
    for i, (size, draw) in enumerate(zip(sizes.tolist(), draws.tolist(), strict=True)):
        if not 0 < out[i] < 1:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b, own = out[open_], out[i], float(sizes[open_])
        up, down = min((1 - a) * own, b * size), min(a * own, (1 - b) * size)  # words that may move to the open one, and from it
        x = up if draw * (up + down) < down else -down
        for k, p in ((open_, a + x / own), (i, b - x / size)):
            out[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        open_ = next((k for k in (open_, i) if 0 < out[k] < 1), -1)
    return np.array(out)


def meeting(level: int, last: bool, columns: list[str]) -> Callable:
    """The rounding of one block; on the last level what is left open goes to the nearer end."""

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("doc_id", "descending"), ("__copy", "ascending")])
        seed = f"{SEED}/{level}/{key[0].as_py()}/{key[1].as_py()}"
        p = pivot(group.column("p").to_numpy(), group.column("size").to_numpy(), seed)
        if last:
            p = np.round(p)
        return pa.table({c: pa.array(p, pa.float64()) if c == "p" else group.column(c) for c in columns})

    return meet


def told_apart(rows: DataFrame) -> DataFrame:
    """rows with __copy, which numbers equal ones; they are counted first, so that none meet in one task."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"))


def dealt(rows: DataFrame, level: int) -> DataFrame:
    """rows with the __block in which each meets others of its source."""
    sized = F.greatest(F.lit(1), F.col("n_sized"))
    blocks = F.ceil(sized / F.lit(float(BLOCK) ** (level + 1)))
    return rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "size", "__copy"), F.greatest(F.lit(1), blocks).cast("long")))


def round_copies(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, size, n_sized, base, p, ...) with p rounded to 0 or 1: a tree of blocks, the same for any partitioning."""
    most = rows.agg(F.max("n_sized")).first()[0] or 0
    columns, rows = rows.columns, told_apart(rows)
    decided, level, undecided = [], 0, rows
    while True:
        parts, last = -(-most // BLOCK), most <= BLOCK
        met = cut(dealt(undecided, level).groupBy("source", "__block").applyInArrow(meeting(level, last, rows.columns), rows.schema))
        if last:
            decided.append(met)
            break
        decided.append(met.where("p = 0 or p = 1"))
        undecided = met.where("p > 0 and p < 1")
        most, level = parts, level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select(*columns)


def heavy_first(key: tuple, group: pa.Table) -> pa.Table:
    """The heavy documents of a source, rounded; the last one by a draw if the others can make up for it, or else to the nearer end."""
    group = group.sort_by([("size", "descending"), ("doc_id", "descending")])
    seed = f"{SEED}/heavy/{key[0].as_py()}"
    p, sizes, was = (group.column(c).to_numpy() for c in ("p", "size", "was"))
    p = pivot(p, sizes, seed)
    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        others = int(group.column("source_size")[0].as_py() - sizes.sum())
        can = sizes[i] * (1 - p[i]) <= was[0] * others and sizes[i] * p[i] <= (1 - was[0]) * others
        p[i] = np.random.default_rng(xxhash.xxh64_intdigest(seed + "/last")).random() < p[i] if can else np.round(p[i])
    return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, copies of every row of docs (doc_id, text, source)."""
    sizes = docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    sizes = cut(sizes)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    targets = cut(source_targets(sizes).withColumn("rate", rate))
    columns = ["doc_id", "size", "source", "source_size", "target", "n_sized", "base", "p"]

    def with_targets(own: DataFrame) -> DataFrame:
        joined = sizes.alias("d").join(own.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        return joined.select("d.doc_id", "d.size", "d.source", *[f"t.{c}" for c in own.columns if c != "source"]).withColumns({"base": F.floor("rate").cast("long"), "p": F.col("rate") - F.floor("rate")})

    is_heavy = F.col("size") > HEAVY * F.col("source_size")
    some = with_targets(targets).where(is_heavy & (F.col("p") > 0)).select(*columns, F.col("p").alias("was"))
    heavy = cut(some.groupBy("source").applyInArrow(heavy_first, some.schema))
    moved = heavy.groupBy("source").agg(F.sum(F.col("size") * (F.col("p") - F.col("was"))).alias("moved"), F.sum("size").alias("heavy_size"))
    both = targets.alias("t").join(moved.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left").select("t.*", F.try_divide("moved", F.col("source_size") - F.col("heavy_size")).alias("less"))
    light = with_targets(both).where(~is_heavy | (F.col("p") == 0)).withColumn("p", F.when(F.col("p") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") - F.coalesce("less", F.lit(0.0))))).otherwise(0.0))
    open_ = (F.col("size") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    rounded = round_copies(light.where(open_).select(*columns))
    settled = light.where(~open_).select(*columns)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.col("p")).cast("long")
    return settled.unionByName(rounded).unionByName(heavy.select(*columns)).select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
