"""Association and termhood measures as Columns over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contingency(ab: Column, a: Column, b: Column, n: Column, smoothing: float = 1) -> Column:
    """struct(ab, a_nb, na_b, na_nb): smoothed cells of a pair's table from its count, its words' counts and the total.

    A cell that would be zero or less becomes the smoothing before the last cell is taken from the others.
    """
    both = ab + smoothing
    only_a = a - both + 2 * smoothing
    only_b = b - both + 2 * smoothing
    only_a, only_b = (F.when(c <= 0, F.lit(smoothing)).otherwise(c) for c in (only_a, only_b))
    neither = n - only_a - only_b - both + 4 * smoothing
    cells = {"ab": both, "a_nb": only_a, "na_b": only_b, "na_nb": neither}
    return F.struct(*[c.cast("double").alias(k) for k, c in cells.items()])


def checked(t: Column) -> Column:
    """A table, or an error if a cell is not above zero."""
    least = F.least(t["ab"], t["a_nb"], t["na_b"], t["na_nb"])
    return F.when(least > 0, t).otherwise(F.raise_error(F.lit("a contingency table needs counts above zero")))


def log_likelihood_ratio(t: Column) -> Column:
    """Dunning's ratio of a table: how much likelier the second word's two rates are apart than as one."""
    k1, k2 = t["ab"], t["na_b"]
    n1, n2 = t["ab"] + t["a_nb"], t["na_b"] + t["na_nb"]
    like = lambda p, k, n: k * F.ln(p) + (n - k) * F.ln(1 - p)
    p = (k1 + k2) / (n1 + n2)
    return 2 * (like(k1 / n1, k1, n1) + like(k2 / n2, k2, n2) - like(p, k1, n1) - like(p, k2, n2))


def total(t: Column) -> Column:
    return t["ab"] + t["a_nb"] + t["na_b"] + t["na_nb"]


def mutual_information(t: Column) -> Column:
    n = total(t)
    rows, columns = (t["ab"] + t["a_nb"], t["na_b"] + t["na_nb"]), (t["ab"] + t["na_b"], t["a_nb"] + t["na_nb"])
    cells = (("ab", 0, 0), ("a_nb", 0, 1), ("na_b", 1, 0), ("na_nb", 1, 1))
    parts = [t[c] / n * F.ln(t[c] / n / (rows[i] / n * columns[j] / n)) for c, i, j in cells]
    return parts[0] + parts[1] + parts[2] + parts[3]


def table_pmi(t: Column) -> Column:
    n = total(t)
    return F.ln(t["ab"] / n / ((t["ab"] + t["a_nb"]) / n * (t["ab"] + t["na_b"]) / n))


def probability(freq: Column, n: Column, smoothing: float = 1) -> Column:
    """Smoothed share of the model's single words, for a term of any length."""
    return (freq + smoothing) / (n + smoothing)


def pair_pmi(ab: Column, a: Column, b: Column, n: Column, smoothing: float = 1) -> Column:
    return F.ln(probability(ab, n, smoothing) / (probability(a, n, smoothing) * probability(b, n, smoothing)))


def normalized_pmi(freq: Column, word_logs: Column, length: Column, n: Column, smoothing: float = 1) -> Column:
    """PMI of a term over the number of its joints, from the sum of its words' log probabilities; null for one word."""
    return F.when(length > 1, (F.ln(probability(freq, n, smoothing)) - word_logs) / (length - 1))


def dice(freq: Column, length: Column, words_freq: Column) -> Column:
    return F.when(freq == 0, F.lit(0.0)).otherwise(F.try_divide(length * freq, words_freq))


def term_coherence(freq: Column, length: Column, words_freq: Column) -> Column:
    return F.when(freq == 0, F.lit(0.0)).otherwise(F.log10(freq) * dice(freq, length, words_freq))


def coherence_over_log(freq: Column, coherence: Column) -> Column:
    """Dice as term coherence over the logarithm of the frequency: null where a term occurs once."""
    return F.when(freq != 1, F.try_divide(coherence, F.log10(freq)))


def tf_idf(freq: Column, docs_with: Column, docs: Column) -> Column:
    """Without a logarithm: frequency times documents over documents with the term plus one."""
    return freq * docs / (docs_with + 1)


def weirdness(freq: Column, other_freq: Column, n: Column, other_n: Column, smoothing: float = 1) -> Column:
    return (freq + smoothing) * (other_n + smoothing) / ((other_freq + smoothing) * (n + smoothing))


def bridge_strength(pmi: Column, freq: Column, factor: float = 1) -> Column:
    return pmi + F.log10(freq) * factor


def f_measure(precision: Column, recall: Column, beta: float = 1) -> Column:
    """With beta as it is, not squared; 0 where both are 0."""
    return F.coalesce(F.try_divide((1 + beta) * precision * recall, beta * precision + recall), F.lit(0.0))
