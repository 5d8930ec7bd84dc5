"""Group statistics: shares, quantiles, outliers, test statistics and their p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.tails import f_tail, range_tail, t_tail, u_tail
from lexiloom.operators.ranking import sums_before
from lexiloom.sources.tables import written

QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def shares(df: DataFrame, keys: list[str], example: str) -> DataFrame:
    """(keys, n, percent, example): rows of each group, their share, and the least example."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("example"))
    total = grouped.agg(F.sum("n").alias("__all"))
    return grouped.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("__all"), 2)).drop("__all")


def order_statistics(df: DataFrame, value: str, keys: list[str], fractions: list[float]) -> DataFrame:
    """(keys, q): for each group the array of its quantiles with linear interpolation, as doubles; nulls are left out.

    Exact, and no task holds a group. Equal values are added up, then dealt by ranges of group and value; the ranges' counts
    alone tell which ranges hold the wanted ranks, and only those are put in order.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    parts = written(counted.repartitionByRange(*names, "__v").withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*names, "__part").agg(F.sum("__c").alias("__s"))  # one row for each range and group in it
    group = W.partitionBy(*names) if names else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__s").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("*", before.alias("__before"), F.sum("__s").over(group).alias("__n"))
    place = [F.lit(f) * (F.col("__n") - 1) for f in fractions]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), to(p).cast("long").alias("rank")) for i, p in enumerate(place) for side, to in (("low", F.floor), ("high", F.ceil))])
    asked = placed.withColumn("__asked", F.filter(wanted, lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__s")))).where(F.size("__asked") > 0)
    other = asked.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__part").alias("__there"), "__before", "__n", "__asked")
    same = F.col("__part") == F.col("__there")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    upto = W.partitionBy(*names, "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    ranked = parts.join(other, same).withColumn("__first", F.col("__before") + F.coalesce(F.sum("__c").over(upto), F.lit(0)))
    hits = ranked.select(*names, "__v", "__n", F.explode(F.filter("__asked", lambda w: (w["rank"] >= F.col("__first")) & (w["rank"] < F.col("__first") + F.col("__c")))).alias("w"))
    at = lambda i, side: F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == side), F.col("__v")))
    ends = hits.groupBy(*names).agg(F.max("__n").alias("__n"), *[at(i, side).alias(f"{side}{i}") for i in range(len(fractions)) for side in ("low", "high")])
    share = [p - F.floor(p) for p in place]
    found = F.array(*[F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * s for i, s in enumerate(share)])
    return ends.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], found.alias("q"))


def quantiles(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """(keys, q0, q25, q50, q75, q100) with linear interpolation."""
    found = order_statistics(df, value, list(keys), QUARTERS)
    return found.select(*keys, *[F.get("q", F.lit(i)).alias(f"q{int(100 * q)}") for i, q in enumerate(QUARTERS)])


def without_outliers(df: DataFrame, value: str) -> DataFrame:
    """Rows strictly within one and a half interquartile ranges of the middle half."""
    q = quantiles(df, value).select(F.col("q25").alias("__a"), F.col("q75").alias("__b"))
    reach = 1.5 * (F.col("__b") - F.col("__a"))
    return df.crossJoin(F.broadcast(q)).where((F.col(value) > F.col("__a") - reach) & (F.col(value) < F.col("__b") + reach)).drop("__a", "__b")


def moments(df: DataFrame, value: str, group: str) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))


def welch_t(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row (t, df): the unequal-variance statistic of the rows with flag against those without, and its degrees of freedom."""
    m = moments(df, value, flag)
    side = lambda s: F.struct(*[F.max(F.when(F.col(flag) == s, F.col(c))).alias(c) for c in ("n", "mean", "variance")])
    one = m.agg(side(True).alias("a"), side(False).alias("b"))
    ea, eb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    t = (F.col("a.mean") - F.col("b.mean")) / F.sqrt(ea + eb)
    freedom = (ea + eb) ** 2 / (ea**2 / (F.col("a.n") - 1) + eb**2 / (F.col("b.n") - 1))
    return one.select(t.alias("t"), freedom.alias("df"))


def mann_whitney_u(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row (u, n1, n2): pairs in which a row with flag is larger than one without, ties as halves.

    Equal values are added up first; the running sum runs over distinct values.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    return sums_before(v, [F.col("v")], {"below": F.col("b")}).agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))


def common_language_effect(u: DataFrame) -> DataFrame:
    """One row: the chance that a row with flag is larger, from mann_whitney_u."""
    return u.select((F.col("u") / (F.col("n1") * F.col("n2"))).alias("cles"))


def welch_anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (f, df1, df2): Welch's statistic over groups of unequal variance."""
    m = moments(df, value, group).where("n > 1 and variance > 0").withColumn("w", F.col("n") / F.col("variance"))
    total = m.agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("grand"), F.count(F.lit(1)).alias("k"))
    j = m.crossJoin(F.broadcast(total))
    sums = j.agg(F.max("k").alias("k"), F.sum(F.col("w") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum((1 - F.col("w") / F.col("sw")) ** 2 / (F.col("n") - 1)).alias("lam"))
    k = F.col("k")
    f = F.col("between") / (k - 1) / (1 + 2 * (k - 2) / (k**2 - 1) * F.col("lam"))
    return sums.select(f.alias("f"), (k - 1).alias("df1"), ((k**2 - 1) / (3 * F.col("lam"))).alias("df2"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (w): equality of variances by distances from the groups' medians."""
    medians = order_statistics(df, value, [group], [0.5]).select(group, F.get("q", F.lit(0)).alias("__m"))
    far = df.join(medians, group).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    m = moments(far, "__d", group)
    total = m.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    j = m.crossJoin(F.broadcast(total))
    s = j.agg(F.max("all").alias("all"), F.max("k").alias("k"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), F.sum((F.col("n") - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"))
    return s.select(((F.col("all") - F.col("k")) / (F.col("k") - 1) * F.col("between") / F.col("within")).alias("w"))


def tukey_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """(a, b, diff, se, q) of each pair of groups; there are as many rows in play as groups."""
    m = moments(df, value, group).select(F.col(group).alias("g"), "n", "mean", "variance")
    pooled = m.agg((F.sum((F.col("n") - 1) * F.col("variance")) / F.sum(F.col("n") - 1)).alias("mse"))
    one, other = m.select(*[F.col(c).alias(f"a_{c}") for c in m.columns]), m.select(*[F.col(c).alias(f"b_{c}") for c in m.columns])
    pairs = one.join(other, F.col("a_g") < F.col("b_g")).crossJoin(F.broadcast(pooled))
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("a_n") + 1 / F.col("b_n")))
    diff = F.col("a_mean") - F.col("b_mean")
    return pairs.select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), diff.alias("diff"), se.alias("se"), (F.abs(diff) / se).alias("q"))


def p_values(df: DataFrame, value: str, flag: str, group: str) -> DataFrame:
    """(test, p): two-sided p-values of welch_t and mann_whitney_u between the rows with flag and those without, and of welch_anova over groups."""
    t = welch_t(df, value, flag).select(F.lit("welch_t").alias("test"), t_tail(F.col("t"), F.col("df")).alias("p"))
    u = mann_whitney_u(df, value, flag).select(F.lit("mwu_u").alias("test"), u_tail(F.col("u"), F.col("n1"), F.col("n2")).alias("p"))
    f = welch_anova(df, value, group).select(F.lit("welch_anova").alias("test"), f_tail(F.col("f"), F.col("df1"), F.col("df2")).alias("p"))
    return t.unionByName(u).unionByName(f)


def tukey_p(df: DataFrame, value: str, group: str) -> DataFrame:
    """tukey_pairs with p, the chance that the widest of as many groups lie as far apart."""
    size = moments(df, value, group).agg(F.count(F.lit(1)).alias("__k"), F.sum(F.col("n") - 1).alias("__df"))
    pairs = tukey_pairs(df, value, group).crossJoin(F.broadcast(size))
    return pairs.withColumn("p", range_tail(F.col("q"), F.col("__k"), F.col("__df"))).drop("__k", "__df")


def long_form(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """(ids, measure, value): a row for each value column."""
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], "measure", "value")


def values_where(df: DataFrame, value: str, flag: str, allowed) -> DataFrame:
    """(value): one column's values in the rows whose flag has the allowed value."""
    return df.where(F.col(flag) == F.lit(allowed)).select(value)


def effect_from_t(t: Column, n1: Column, n2: Column) -> Column:
    """The common-language effect of a t statistic and two group sizes: the normal chance of d over the root of two.

    The normal distribution function is Abramowitz and Stegun's 7.1.26, good to 1.5e-7.
    """
    z = t * F.sqrt(1 / n1 + 1 / n2) / F.sqrt(F.lit(2.0))
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    error = 1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-x * x)
    return (1 + F.signum(z) * error) / 2
