"""n-gram and skipgram models: counts of runs of tokens within sentences."""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import key_of, keyed, named, ngram_keys, ngrams_of, tokens_of

GAP = "{*}"


def ngram_model(annotated: DataFrame, max_n: int = 5, min_freq: int = 1, column: str = "lemmas") -> DataFrame:
    """(term, n, freq, docs) of all runs of 1 to max_n tokens that occur min_freq times. Counts are added up before the shuffle."""
    runs = annotated.select("doc_id", F.explode(ngram_keys(F.col(column), 1, max_n)).alias("key"))
    per_doc = runs.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("freq"))
    counted = per_doc.groupBy("key").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("docs"))
    return counted.where(F.col("freq") >= max(1, min_freq)).select(tokens_of(F.col("key")).alias("term"), "freq", "docs").select("term", F.size("term").alias("n"), "freq", "docs")


def doc_ngrams(annotated: DataFrame, max_n: int = 5, tag_pattern: str | None = None, column: str = "lemmas") -> DataFrame:
    """(doc_id, term, n, freq): runs of 1 to max_n tokens of each document, those of the tag pattern only if one is given."""
    keys = ngram_keys(F.col(column), 1, max_n)
    if tag_pattern is not None:
        runs = F.arrays_zip(keys.alias("key"), ngrams_of(F.col("tags"), 1, max_n).alias("run_tags"))
        keys = F.transform(F.filter(runs, lambda r: F.array_join(r["run_tags"], "").rlike(f"^(?:{tag_pattern})$")), lambda r: r["key"])
    counted = annotated.select("doc_id", F.explode(keys).alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("freq"))
    return counted.select("doc_id", tokens_of(F.col("key")).alias("term"), "freq").select("doc_id", "term", F.size("term").alias("n"), "freq")


def ngram_counts(annotated: DataFrame, max_n: int = 5, min_freq: int = 1, column: str = "lemmas") -> DataFrame:
    """(term, n, freq), as ngram_model but without document counts, in one shuffle."""
    runs = annotated.select(F.explode(ngram_keys(F.col(column), 1, max_n)).alias("key"))
    counted = runs.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= max(1, min_freq))
    return counted.select(tokens_of(F.col("key")).alias("term"), "freq").select("term", F.size("term").alias("n"), "freq")


def total_counts(model: DataFrame) -> DataFrame:
    """(n, total): occurrences of surviving terms of each length."""
    return model.groupBy("n").agg(F.sum("freq").alias("total"))


def save_model(model: DataFrame, path: str) -> None:
    """A model as Parquet, one folder for each length."""
    model.write.mode("overwrite").partitionBy("n").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def iterate(model: DataFrame, n: int, least: int = 1) -> DataFrame:
    """Terms of one length that occur `least` times."""
    return model.where((F.col("n") == n) & (F.col("freq") >= least))


def without_words(bigrams: DataFrame, words: DataFrame) -> DataFrame:
    """bigrams (term, ...) neither of whose tokens is in words (word), a list of stop words or signs."""
    barred = words.select("word").distinct()
    first = bigrams.join(barred.toDF("__w"), F.get("term", F.lit(0)) == F.col("__w"), "left_anti")
    return first.join(barred.toDF("__w"), F.get("term", F.lit(1)) == F.col("__w"), "left_anti")


def unigram_total(model: DataFrame) -> DataFrame:
    """One row, total: the surviving single words' occurrences, which all probabilities refer to."""
    return model.where("n = 1").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))


def aggregate_model(*models: DataFrame) -> DataFrame:
    """(term, n, freq) with frequencies added over models."""
    parts = [m.select(key_of(keyed(F.col("term"))).alias("key"), "n", "freq") for m in models]
    added = reduce(DataFrame.unionByName, parts).groupBy("key", "n").agg(F.sum("freq").alias("freq"))
    return added.select(tokens_of(F.col("key")).alias("term"), "n", "freq")


def skipgram_model(annotated: DataFrame, max_n: int = 5, min_freq: int = 2, column: str = "lemmas") -> DataFrame:
    """(pattern, words, n_words, freq): runs of 3 to max_n tokens with inner ones replaced by gaps, that occur min_freq times.

    words holds the tokens that are not gaps. A pattern is counted for each place it covers.
    """
    runs = annotated.select(F.explode(named(keyed(F.col(column)), lambda own: ngrams_of(own, 3, max_n))).alias("run"))
    gapped = []
    for n in range(3, max_n + 1):
        for k in range(1, n - 1):
            for gaps in combinations(range(1, n - 1), k):
                pattern = F.array(*[F.lit(GAP) if i in gaps else F.get("run", F.lit(i)) for i in range(n)])
                gapped.append(F.when(F.size("run") == n, pattern))
    patterns = runs.select(F.explode(F.filter(F.array(*gapped), lambda p: p.isNotNull())).alias("pattern"))
    counted = patterns.select(key_of(F.col("pattern")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= max(1, min_freq))
    counted = counted.select(tokens_of(F.col("key")).alias("pattern"), "freq")
    words = F.filter("pattern", lambda t: t != GAP)
    return counted.select("pattern", words.alias("words"), F.size(words).alias("n_words"), "freq")


def skip_aware(model: DataFrame, skipgrams: DataFrame, compat_weights: bool = False) -> DataFrame:
    """(term, n, freq, skip_freq): a term's frequency with that of the skipgrams of the same words.

    Each pattern counts once. compat_weights: a pattern counts once for each order in which its gaps can be put in one
    by one, which is the number of ways that a recursive sum meets it.
    """
    longest = skipgrams.agg(F.max(F.size("pattern"))).first()[0] or 3 if compat_weights else 0
    one = skipgrams.withColumn("weight", insertion_orders(F.col("pattern"), longest) if compat_weights else F.lit(1))
    added = one.groupBy("words").agg(F.sum(F.col("freq") * F.col("weight")).alias("skips"))
    joined = model.join(added, model["term"] == added["words"], "left")
    return joined.select("term", "n", "freq", (F.col("freq") + F.coalesce("skips", F.lit(0))).alias("skip_freq"))


def insertion_orders(pattern: Column, max_n: int) -> Column:
    """In how many ways a pattern of up to max_n tokens is reached from its words by adding gaps, any number at a step."""
    shape = F.array_join(F.transform(pattern, lambda t: F.when(t == GAP, "_").otherwise("w")), "")
    weights = {}
    for words in range(2, max_n):
        for layout in product(range(max_n - words + 1), repeat=words - 1):  # gaps after each word but the last
            if 0 < sum(layout) <= max_n - words:
                weights["w".join(["", *("_" * g for g in layout), ""])] = orders(layout)
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), shape)


@cache
def orders(layout: tuple[int, ...]) -> int:
    """Ways to fill a layout of gaps from none, by steps that each add some."""
    if not any(layout):
        return 1
    return sum(orders(smaller) for smaller in product(*[range(g + 1) for g in layout]) if smaller != layout)
