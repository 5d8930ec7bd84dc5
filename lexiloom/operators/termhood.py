"""Termhood: nested frequencies level by level, and measures that look up words or a second corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import measures
from lexiloom.functions.text import BETWEEN, key_of, keyed, parts_of_length, tokens_of
from lexiloom.sources.tables import written


def nested_frequencies(types: DataFrame, threshold: float = 2, min_n: int = 1, choices: bool = False) -> DataFrame:
    """types (term, n, freq, ...) of min_n words or more with rect_freq and c_value, from the longest down, whatever its length.

    rect_freq is freq less the rect_freq of all longer types that hold the term. c_value discounts, over the longer types
    that were accepted, the mean of those of their own discounted frequencies that are above zero; a type is accepted from the
    threshold on. A part that a type holds twice counts once. choices: whether types nest as order-keeping choices of
    words, as discontinuous ones do, and not as runs only.

    A level's types and the parts of that length of all longer types meet in one grouping, parts added up before the
    shuffle; no pair of types is kept. A level is written, so lineage stays short. Terms are distinct.
    """
    kept = [c for c in types.columns if c not in ("rect_freq", "c_value")]
    carried = [c for c in kept if c not in ("term", "n")]
    some = types.where(F.col("n") >= min_n).select("n", key_of(keyed(F.col("term"))).alias("__key"), *carried)
    numbered = written(some, by="n")
    lengths = sorted((r.n for r in numbered.select("n").distinct().collect()), reverse=True)  # one row for each length
    levels: list[DataFrame] = []
    null = lambda kind: F.lit(None).cast(kind)
    for n in lengths:
        own = numbered.where(F.col("n") == n).select("__key", *carried, F.lit(True).alias("__own"), null("long").alias("__rect"), null("long").alias("__freq"), null("boolean").alias("__taken"))
        for longer in levels:
            parts = F.explode(parts_of_length(F.split("__key", BETWEEN, -1), n, choices)).alias("__key")
            held = longer.select(parts, F.col("rect_freq").alias("__rect"), F.col("own_freq").alias("__freq"), F.col("taken").alias("__taken"))
            own = own.unionByName(held, allowMissingColumns=True)
        taken = F.when(F.col("__taken"), F.col("__freq"))
        sums = own.groupBy("__key").agg(
            *[F.max(c).alias(c) for c in carried],
            F.max("__own").alias("__own"),
            F.sum("__rect").alias("nested"),
            F.sum(taken).alias("nested_taken"),
            F.avg(F.when(taken > 0, taken)).alias("mean_taken"),
            F.max("__taken").alias("any_taken"),
        )
        met = sums.where("__own") if levels else own.select("__key", *carried, null("long").alias("nested"), null("long").alias("nested_taken"), null("double").alias("mean_taken"), null("boolean").alias("any_taken"))
        discounted = F.when(F.coalesce("any_taken", F.lit(False)), F.col("freq") - F.coalesce("mean_taken", F.lit(0.0))).otherwise(F.col("freq"))
        c_value = F.log2(F.lit(float(n))) * discounted
        level = met.select(
            "__key",
            *carried,
            F.lit(n).cast(types.schema["n"].dataType).alias("n"),
            (F.col("freq") - F.coalesce("nested", F.lit(0))).alias("rect_freq"),
            c_value.alias("c_value"),
            (F.col("freq") - F.coalesce("nested_taken", F.lit(0))).alias("own_freq"),
            (c_value >= threshold).alias("taken"),
        )
        levels.append(written(level) if n > lengths[-1] else level)
    if not levels:
        return types.where("false").select(*kept, F.lit(0).cast("long").alias("rect_freq"), F.lit(0.0).alias("c_value"))
    return reduce(DataFrame.unionByName, levels).withColumn("term", tokens_of(F.col("__key"))).select(*kept, "rect_freq", "c_value")


def word_sums(terms: DataFrame, model: DataFrame, total: DataFrame, other: DataFrame | None = None, other_total: DataFrame | None = None) -> DataFrame:
    """terms (term, ...) with words_freq, word_logs and glossex: over a term's words, repeated ones each time, the sum of frequencies,
    of log probabilities, and with other the mean log weirdness. Words that a model lacks count 0. Terms are distinct.

    Both corpora's words are joined once and written, so that a small vocabulary is known to be small and goes to the
    tasks. A term's own columns are the keys that its words are grouped by, so whole rows come back without a join.
    """
    found = model.where("n = 1").select(F.get("term", F.lit(0)).alias("__word"), F.col("freq").alias("__f"))
    if other is not None:
        found = found.join(other.where("n = 1").select(F.get("term", F.lit(0)).alias("__word"), F.col("freq").alias("__g")), "__word", "full_outer")
    words = written(found)
    rest = [c for c in terms.columns if c != "term"]
    one = terms.select(key_of(keyed(F.col("term"))).alias("__key"), *rest, F.explode("term").alias("__word")).join(words, "__word", "left").crossJoin(F.broadcast(total.select(F.col("total").alias("__t"))))
    f = F.coalesce("__f", F.lit(0))
    sums = [F.sum(f).alias("words_freq"), F.sum(F.ln(measures.probability(f, F.col("__t")))).alias("word_logs")]
    if other is not None:
        one = one.crossJoin(F.broadcast(other_total.select(F.col("total").alias("__u"))))
        sums.append(F.avg(F.ln(measures.weirdness(f, F.coalesce("__g", F.lit(0)), F.col("__t"), F.col("__u")))).alias("glossex"))
    summed = one.groupBy("__key", *rest).agg(*sums).withColumn("term", tokens_of(F.col("__key")))
    return summed.select(*terms.columns, *[c for c in ("words_freq", "word_logs", *(["glossex"] if other is not None else []))])


def filter_metrics(types: DataFrame, model: DataFrame, total: DataFrame, other: DataFrame, other_total: DataFrame, threshold: float = 2, choices: bool = False) -> DataFrame:
    """(term, n, freq, rect_freq, c_value, glossex) of types (term, n, freq): what the production filter asks, from single words' counts alone."""
    nested = nested_frequencies(types.select("term", "n", "freq"), threshold, choices=choices)
    return word_sums(nested, model, total, other, other_total).drop("words_freq", "word_logs")


def unithood(model: DataFrame, total: DataFrame, min_freq: int = 1, factor: float = 2) -> DataFrame:
    """Every measure of the model's bigrams that occur min_freq times."""
    words = model.where("n = 1").select(F.get("term", F.lit(0)).alias("word"), "freq")
    two = model.where((F.col("n") == 2) & (F.col("freq") >= min_freq)).select("term", F.get("term", F.lit(0)).alias("a"), F.get("term", F.lit(1)).alias("b"), F.col("freq").alias("ab"))
    joined = two.join(words.toDF("a", "fa"), "a").join(words.toDF("b", "fb"), "b").crossJoin(F.broadcast(total))
    tabled = joined.withColumn("t", measures.checked(measures.contingency(F.col("ab"), F.col("fa"), F.col("fb"), F.col("total"))))
    t, ab, both = F.col("t"), F.col("ab"), F.col("fa") + F.col("fb")
    pmi = measures.table_pmi(t)
    return tabled.select(
        "term",
        ab.alias("freq"),
        F.col("fa").alias("freq_a"),
        F.col("fb").alias("freq_b"),
        "t.ab",
        "t.a_nb",
        "t.na_b",
        "t.na_nb",
        measures.log_likelihood_ratio(t).alias("llr"),
        measures.mutual_information(t).alias("mi"),
        pmi.alias("pmi"),
        measures.pair_pmi(ab, F.col("fa"), F.col("fb"), F.col("total")).alias("ngram_pmi"),
        measures.dice(ab, F.lit(2), both).alias("dice"),
        measures.term_coherence(ab, F.lit(2), both).alias("term_coherence"),
        (pmi + F.log10(ab) * factor).alias("combo"),
    )


def metrics(types: DataFrame, model: DataFrame, total: DataFrame, other: DataFrame, other_total: DataFrame, docs: int, threshold: float = 2, choices: bool = False) -> DataFrame:
    """One wide row for each type (term, n, freq, docs): all six measures that rankers use. Types may be of any length.

    docs: documents with a candidate (see candidates.documents). choices: see nested_frequencies. Nested frequencies
    and the model's count are carried along, and a type's words are looked up and summed without a join back.
    """
    freq = model.select(key_of(keyed(F.col("term"))).alias("__key"), F.col("freq").alias("model_freq"))
    asked = types.select("term", "n", "freq", "docs", key_of(keyed(F.col("term"))).alias("__key")).join(freq, "__key", "left").drop("__key")
    nested = nested_frequencies(asked, threshold, choices=choices)
    joined = word_sums(nested, model, total, other, other_total).crossJoin(F.broadcast(total))
    f = F.coalesce("model_freq", F.lit(0))
    return joined.select(
        "term",
        "n",
        "freq",
        "docs",
        "c_value",
        "rect_freq",
        measures.tf_idf(F.col("freq"), F.col("docs"), F.lit(docs)).alias("tf_idf"),
        "glossex",
        measures.normalized_pmi(f, F.col("word_logs"), F.col("n"), F.col("total")).alias("pmi_nl"),
        measures.term_coherence(f, F.col("n"), F.col("words_freq")).alias("term_coherence"),
    )
