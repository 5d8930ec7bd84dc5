"""Nested frequencies of any length, by runs and by choices of words, against direct recursion."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import ngrams_of, parts_of, subsequences_of
from lexiloom.operators import annotate, candidates, ngrams, termhood
from lexiloom.plans import extraction

TYPES = "term array<string>, n int, freq long"


def holds(whole, part, choices):
    if choices:
        rest = iter(whole)
        return len(part) < len(whole) and all(w in rest for w in part)
    return len(part) < len(whole) and any(whole[i : i + len(part)] == part for i in range(len(whole)))


def recursive(freq: dict, threshold: float, choices: bool) -> dict:
    """(rect_freq, c_value) of each type: the first over all longer types, the second over accepted ones."""
    order = sorted(freq, key=len, reverse=True)
    taken: list = []

    def own(term, among):
        return freq[term] - sum(own(s, among) for s in among if holds(s, term, choices))

    out = {}
    for term in order:
        above = [own(s, taken) for s in taken if holds(s, term, choices)]
        some = [v for v in above if v > 0]
        c = math.log2(len(term)) * (freq[term] - (sum(some) / len(some) if some else 0))
        out[term] = own(term, order), c
        if c >= threshold:
            taken.append(term)
    return out


@pytest.mark.parametrize("choices", [False, True])
@pytest.mark.parametrize("longest", [4, 7])
def test_against_recursion(spark, choices, longest):
    draw = random.Random(longest)
    terms = {tuple(draw.choice("abcd") for _ in range(draw.randint(1, longest))) for _ in range(60)}
    freq = {t: draw.randint(1, 9) for t in sorted(terms)}
    rows = spark.createDataFrame([(list(t), len(t), f) for t, f in freq.items()], TYPES).withColumn("docs", F.lit(1))
    got = {tuple(r.term): (r.rect_freq, r.c_value) for r in termhood.nested_frequencies(rows, choices=choices).collect()}
    want = recursive(freq, 2, choices)
    assert got.keys() == want.keys()
    for t, (rf, c) in want.items():
        assert got[t] == (rf, pytest.approx(c))


def test_toy_with_gaps(spark):
    """As a run `a c` is in nothing; as a choice it is in `a b c`."""
    rows = spark.createDataFrame([(["a", "b", "c"], 3, 4), (["a", "c"], 2, 9), (["b", "c"], 2, 5)], TYPES)
    runs, choices = ({" ".join(r.term): r.rect_freq for r in termhood.nested_frequencies(rows, choices=c).collect()} for c in (False, True))
    assert runs == {"a b c": 4, "a c": 9, "b c": 1} and choices == {"a b c": 4, "a c": 5, "b c": 1}


def test_odd_types(spark):
    empty = spark.createDataFrame([], TYPES)
    assert termhood.nested_frequencies(empty).count() == 0
    single = spark.createDataFrame([(["a"], 1, 3)], TYPES)
    assert [tuple(r) for r in termhood.nested_frequencies(single).collect()] == [(["a"], 1, 3, 3, 0.0)]


def test_parts_of_any_length(spark):
    for n in (1, 2, 6, 9):
        words = [f"w{i}" for i in range(n)]
        t = F.array(*[F.lit(w) for w in words])
        runs, choices, pairs = spark.range(1).select(parts_of(t, 2), parts_of(t, 2, choices=True), subsequences_of(t, 2)).first()
        assert sorted(runs) == sorted(words[i:j] for i in range(n) for j in range(i + 2, n + 1) if j - i < n)
        assert sorted(choices) == sorted(list(c) for k in range(2, n) for c in combinations(words, k))
        assert pairs == [list(c) for c in combinations(words, 2)]
    many = F.array(*[F.lit(i) for i in range(17)])
    with pytest.raises(Exception, match="more than 16"):
        spark.range(1).select(parts_of(many, 2, choices=True)).collect()


def test_long_types_reach_the_end(spark):
    """Types of six and seven words are scored, and accepted if a list verifies them, as others are."""
    line = "big red local global final total thing stops here. "
    docs = spark.createDataFrame([(i, line * 3) for i in range(4)], "doc_id long, text string")
    config = extraction.Configuration(max_n=7, tag_filter="liberal", coord_dcs=False, hypernym_dcs=False)
    annotated, model = extraction.preprocess(docs, config)
    other = ngrams.ngram_counts(annotate.sentences(spark.createDataFrame([(1, "thing is here")], "doc_id long, text string")), 1)
    longest = annotated.select(F.explode(ngrams_of(F.col("lemmas"), 7, 7)).alias("term")).distinct()
    found = extraction.extract(annotated, model, other, longest, config)
    held = {r.n for r in found["metrics"].select("n").distinct().collect()}
    assert held == {2, 3, 4, 5, 6, 7}
    assert 7 in {len(r.term) for r in found["accepted"].collect()}


def test_compat_weights_beyond_five(spark):
    """A pattern of seven tokens counts as often as a recursive sum meets it."""
    rows = [("a {*} {*} {*} {*} {*} b", 2), ("a {*} c {*} {*} {*} b", 3)]
    skips = spark.createDataFrame([(p.split(), [w for w in p.split() if w != "{*}"], 2, f) for p, f in rows], "pattern array<string>, words array<string>, n_words int, freq long")
    model = spark.createDataFrame([(["a", "b"], 2, 5), (["a", "c", "b"], 3, 1)], TYPES)
    got = {len(r.term): r.skip_freq for r in ngrams.skip_aware(model, skips, compat_weights=True).collect()}
    assert got == {2: 5 + 2 * ngrams.orders((5,)), 3: 1 + 3 * ngrams.orders((1, 3))}


def test_long_skips(spark):
    concepts = spark.createDataFrame([("a b c d e f g".split(),), ("a g".split(),), ("b d f g".split(),), ("c d".split(),)], "term array<string>")
    assert sorted(" ".join(r.term) for r in candidates.skips_that_are_concepts(concepts).collect()) == ["a g", "b d f g"]
