"""Rankings of types, votes, filters and matches.

A global rank needs all values in one order, so ranks are taken after candidates have been added up to types. Values are
dealt by range and numbered within each range; a range's first rank is a running sum over the ranges' sizes. The ranges are
written first, since sizes and rows must come from the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.text import BETWEEN, ESCAPE, key_of, keyed, tokens_of
from lexiloom.sources.tables import written

#: Words that no accepted term may hold.
BLACKLIST = ["figure", "fig.", "table", "various", "other", "most", "many", "current"]
#: The production filter's least mean log weirdness.
LEAST_GLOSSEX = 1.5


def ranks_of(values: DataFrame, columns: list[str]) -> DataFrame:
    """(term, measure, rank) of each column of values (term, ...), all in one pass; ties by term, nulls last."""
    return key_ranks(values, columns).select(tokens_of(F.col("key")).alias("term"), "measure", "rank")


def key_ranks(values: DataFrame, columns: list[str]) -> DataFrame:
    """ranks_of with a term's key in its place. Of a term only the key is dealt and put in order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    one = values.select(key_of(keyed(F.col("term"))).alias("key"), F.explode(pairs).alias("p")).select("key", "p.measure", F.when(F.col("p.value").isNull(), 1).otherwise(0).alias("none"), (-F.col("p.value")).alias("low"))
    text = F.when(F.contains("key", F.lit(ESCAPE)), F.array_join(tokens_of(F.col("key")), " ")).otherwise(F.replace("key", F.lit(BETWEEN), F.lit(" ")))
    order = [F.col("measure"), F.col("none"), F.col("low"), text]
    parts = written(one.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = parts.withColumn("at", F.row_number().over(W.partitionBy("measure", "part").orderBy(*order[1:])))
    sizes = parts.groupBy("measure", "part").agg(F.count(F.lit(1)).alias("size"))  # one row for each range
    before = W.partitionBy("measure").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("measure", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return within.join(F.broadcast(first), ["measure", "part"]).select("key", "measure", (F.col("at") + F.col("before")).cast("int").alias("rank"))


def sums_before(rows: DataFrame, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """rows with, under each name of columns, the sum of that column over all rows before in the order, which must be total.

    Rows are dealt by range; offsets are running sums over the ranges' totals, of which there are few.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    whole = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in columns.items()])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in columns])
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = parts.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in columns.items()}).join(F.broadcast(offsets), "__part")
    return summed.select(*rows.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in columns])


def ranked(values: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """values (term, ...) with a rank from 1 by falling value, ties by term; nulls come last."""
    ranks = key_ranks(values, [value]).select(F.col("key").alias("__key"), F.col("rank").alias(name))
    return values.withColumn("__key", key_of(keyed(F.col("term")))).join(ranks, "__key").drop("__key")


def first_ranked(values: DataFrame, value: str, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of ranked(values, value), for an n of some thousands at most: only they are put in order."""
    order = [F.desc_nulls_last(value), F.array_join("term", " ")]
    return values.orderBy(*order).limit(n).withColumn(name, F.row_number().over(W.orderBy(*order)))  # n rows


def vote(values: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """values with rank_<column> for each column, and vote: the sum over rankings of weight over rank."""
    ranks = key_ranks(values, columns).groupBy(F.col("key").alias("__key")).agg(*[F.max(F.when(F.col("measure") == c, F.col("rank"))).alias(f"rank_{c}") for c in columns])
    parts = [F.lit(float((weights or {}).get(c, 1))) / F.col(f"rank_{c}") for c in columns]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return values.withColumn("__key", key_of(keyed(F.col("term")))).join(ranks, "__key").drop("__key").withColumn("vote", total)


def filter_at_value(values: DataFrame, value: str, least: float) -> DataFrame:
    """Rows above a value, the value itself left out."""
    return values.where(F.col(value) > least)


def keep_proportion(ranking: DataFrame, share: float, rank: str = "rank") -> DataFrame:
    """The first part of a ranking, whole rows rounded down."""
    count = ranking.agg(F.floor(F.count(F.lit(1)) * share).alias("__keep"))
    return ranking.crossJoin(F.broadcast(count)).where(F.col(rank) <= F.col("__keep")).drop("__keep")


def keep_n_highest(ranking: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    return ranking.where(F.col(rank) <= n)


def most_common(counts: DataFrame, n: int, least: int | None = None, rarest: bool = False) -> DataFrame:
    """The n most frequent terms, or the n rarest that occur more than `least` times."""
    some = counts if least is None else counts.where(F.col("freq") > least)
    order = F.col("freq").asc() if rarest else F.col("freq").desc()
    return some.orderBy(order, F.array_join("term", " ")).limit(n)


def combined(predicates: list[Column], method: str = "all", n: int = 1) -> Column:
    """Predicates as one: all, any, majority (more than half) or at_least n of them; null counts as false."""
    held = [F.coalesce(p, F.lit(False)).cast("int") for p in predicates]
    count = held[0]
    for h in held[1:]:
        count = count + h
    return {"all": count == len(held), "any": count >= 1, "majority": count * 2 > len(held), "at_least": count >= n}[method]


def production_filter(least_c_value: float = 2, least_rect_freq: int = 2) -> list[Column]:
    """The predicates on a row of metrics that the extraction run applies together."""
    barred = F.array(*[F.lit(w) for w in BLACKLIST])
    return [F.col("c_value") >= least_c_value, F.col("rect_freq") >= least_rect_freq, F.col("glossex") >= LEAST_GLOSSEX, ~F.arrays_overlap("term", barred)]


def matched(terms: DataFrame, verifier: DataFrame) -> DataFrame:
    """terms with verified: whether the verifier (term) holds them."""
    held = verifier.select("term").distinct().withColumn("__held", F.lit(True))
    return terms.join(held, "term", "left").withColumn("verified", F.coalesce("__held", F.lit(False))).drop("__held")


def matched_by(terms: DataFrame, verifiers: dict[str, DataFrame]) -> DataFrame:
    """terms with a column for each of verifiers (term): whether it holds them. A term list, gold types and extracted types are verifiers alike.

    Verifiers are added up by term first, so that terms are joined once however many there are.
    """
    named_ = [df.select("term", F.lit(name).alias("__by")) for name, df in verifiers.items()]
    flags = reduce(DataFrame.unionByName, named_).groupBy("term").agg(*[F.max(F.col("__by") == name).alias(name) for name in verifiers])
    return terms.join(flags, "term", "left").na.fill(False, list(verifiers))


def accept(final: DataFrame, verified: DataFrame) -> DataFrame:
    """(term): what the filters leave and what a term list verifies."""
    return final.select("term").union(verified.select("term")).distinct()


def with_bridge_strength(disc: DataFrame, votes: DataFrame, known: DataFrame) -> DataFrame:
    """Discontinuous candidates (..., positions, term) with the vote of their type (0 if it has none) and the strength of the bridge over their first gap.

    known: (a, b, freq, strength), as candidates.bridges gives them; null where the bridge is none of them.
    """
    at = F.array_position(F.transform(F.sequence(F.lit(0), F.size("positions") - 2), lambda i: F.get("positions", i + 1) - F.get("positions", i) > 1), True).cast("int")
    ends = disc.withColumns({"a": F.get("term", at - 1), "b": F.get("term", at)})
    scored = ends.join(votes.select("term", "vote"), "term", "left").join(known.select("a", "b", "strength"), ["a", "b"], "left")
    return scored.select(*disc.columns, F.coalesce("vote", F.lit(0.0)).alias("vote"), "strength")
