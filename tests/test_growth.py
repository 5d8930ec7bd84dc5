"""What keeps the work of the large queries near their input: keys in place of arrays, few shuffles, nothing kept by pairs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import annotate, candidates, ngrams, ranking, termhood
from lexiloom.sources.tables import dealt

ODD = [["a", "b"], ["a b"], ["a\x1fb"], ["\x1e", "\x1e0"], ["", ""], [None, "x"], ["\x1e2"]]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_give_any_tokens_back(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "tokens array<string>").withColumn("key", text.key_of(text.keyed(F.col("tokens"))))
    found = rows.select("tokens", "key", text.tokens_of(F.col("key")).alias("back")).collect()
    assert all(r.tokens == r.back for r in found)
    assert len({r.key for r in found}) == len(ODD)


def test_counts_of_odd_tokens(spark):
    rows = spark.createDataFrame([(1, t) for t in ODD], "doc_id long, lemmas array<string>")
    want = Counter(tuple(t[i : i + n]) for t in ODD for n in (1, 2) for i in range(len(t) - n + 1))
    for counted in (ngrams.ngram_counts(rows, 2), ngrams.ngram_model(rows, 2)):
        assert {tuple(r.term): r.freq for r in counted.collect()} == want


def test_tags_and_lemmas_as_the_patterns_give_them(spark):
    tokens = ["and", "an", "ands", "thing", "ing", "ed", "ly", "12", "1a", "1al", "é", "été", "ßly", ",", "с", "٣", "ea", "bly", "nation", "x1", "ies", "cities", "dies", "boxes", "gas", "bus", "class", "s", "és", "1s", "", "{"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    old = F.lit("n")
    for letter, pattern in reversed(text.TAG_RULES):
        old = F.when(F.col("t").rlike(pattern), letter).otherwise(old)
    assert all(r.a == r.b for r in rows.select(text.rule_tag(F.col("t")).alias("a"), old.alias("b")).collect())
    assert {r.t: r.l for r in rows.select("t", text.rule_lemma(F.col("t")).alias("l")).collect()}["cities"] == "city"


def test_counts_by_document_shuffle_documents_once(spark):
    docs = dealt(spark.createDataFrame([(1, ["a", "b"], ["n", "n"])], "doc_id long, lemmas array<string>, tags array<string>"), "doc_id")
    for counted in (candidates.contiguous_counts(docs, "simple", 2), ngrams.ngram_model(docs, 2)):
        assert plan(counted).count("Exchange hashpartitioning") == 2  # documents, and one row a type and task


def test_word_sums_hash_and_write_words_only(spark, monkeypatch):
    model = spark.createDataFrame([(["a"], 1, 3), (["b"], 1, 2), (["a", "b"], 2, 2)], "term array<string>, n int, freq long")
    sizes = []
    write = termhood.written
    monkeypatch.setattr(termhood, "written", lambda df, *a, **k: sizes.append(df.count()) or write(df, *a, **k))
    summed = termhood.word_sums(model.where("n = 2"), model, ngrams.unigram_total(model))
    assert "SortAggregate" not in plan(summed)
    assert [(r.term, r.words_freq) for r in summed.collect()] == [(["a", "b"], 5)]
    assert sizes == [2]


def test_nesting_keeps_no_pairs(spark, monkeypatch):
    terms = [[f"w{i}", f"w{i + 1}", f"w{i + 2}", "x", "y"][:n] for i in range(40) for n in (2, 3, 4, 5)]
    types = spark.createDataFrame([(t, len(t), 2) for t in terms], "term array<string>, n int, freq long")
    rows = []
    write = termhood.written
    monkeypatch.setattr(termhood, "written", lambda df, *a, **k: rows.append(df.count()) or write(df, *a, **k))
    assert termhood.nested_frequencies(types, 2, 2).count() == len(terms)
    assert sum(rows) <= 2 * len(terms)  # types once, and each level but the last


def test_ranks_write_no_arrays(spark, monkeypatch):
    values = spark.createDataFrame([(["a", "b"], 1.0), (["a"], 2.0), (["c\x1f"], None), (["b"], 2.0)], "term array<string>, v double")
    kinds = []
    write = ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, *a, **k: kinds.extend(t for _, t in df.dtypes) or write(df, *a, **k))
    assert {" ".join(r.term): r["rank"] for r in ranking.ranked(values, "v").collect()} == {"a": 1, "b": 2, "a b": 3, "c\x1f": 4}
    assert not any(t.startswith("array") for t in kinds)


def test_grams_by_document_need_no_shuffle_of_their_own(spark):
    docs = dealt(spark.createDataFrame([(1, ["a", None, "c"], ["a", "n", "n"]), (1, ["a\x1f"], ["n"])], "doc_id long, lemmas array<string>, tags array<string>"), "doc_id")
    counted = ngrams.doc_ngrams(docs, 2, "[an]*n")
    assert plan(counted).count("Exchange hashpartitioning") == 1
    assert {(tuple(r.term), r.n, r.freq) for r in counted.collect()} == {((None,), 1, 1), (("c",), 1, 1), (("a", None), 2, 1), ((None, "c"), 2, 1), (("a\x1f",), 1, 1)}


def test_patterns_and_added_models_are_dealt_as_strings(spark):
    docs = spark.createDataFrame([(1, ["a", "b\x1f", "c"]), (2, ["a", "d", "c"])], "doc_id long, lemmas array<string>")
    patterns = ngrams.skipgram_model(docs, 3)
    assert [(r.pattern, r.words, r.freq) for r in patterns.collect()] == [(["a", "{*}", "c"], ["a", "c"], 2)]
    model = ngrams.ngram_counts(docs, 1)
    added = ngrams.aggregate_model(model, model)
    assert {tuple(r.term): r.freq for r in added.collect()} == {("a",): 4, ("b\x1f",): 2, ("c",): 4, ("d",): 2}
    for df in (patterns, added):
        assert "hashpartitioning(key" in plan(df)


def test_accept_counts_no_instances_again(spark, data, monkeypatch):
    from lexiloom.plans.queries import QUERIES

    monkeypatch.setattr(candidates, "type_counts", lambda found: 1 / 0)
    assert QUERIES["accept"](spark, data).columns == ["term", "n", "freq", "docs"]


def test_ways_from_lists_what_each_end_lists(spark):
    draw = random.Random(5)
    rows = []
    for k in range(200):
        n = draw.randint(2, 8)
        tags = "".join(draw.choice("aannnc,") for _ in range(n))
        bridged = [(i, j) for i in range(n) for j in range(i + 2, n) if draw.random() < 0.2]
        rows.append((k, tags, bridged, [sorted(draw.sample(range(s + 1, n + 1), draw.randint(0, n - s))) if tags[s] in "an" else [] for s in range(n)]))
    df = spark.createDataFrame(rows, "k int, tags string, bridged array<struct<i:int,j:int>>, ends array<array<int>>")
    got = {r.k: [tuple(w) for w in r.w] for r in df.select("k", candidates.ways_from(F.col("tags"), F.col("bridged"), F.col("ends"), "an").alias("w")).collect()}
    each = df.select("*", F.posexplode("ends").alias("s", "own")).select("*", F.explode("own").alias("e"))
    want = {k: set() for k in got}
    for r in each.select("k", "tags", candidates.ways_in(F.col("tags"), F.col("bridged"), F.col("s"), F.col("e")).alias("w")).collect():
        want[r.k].update(tuple(w) for w in r.w if all(r.tags[i] in "an" for i in w) and w[-1] - w[0] >= len(w))
    assert {k: set(w) for k, w in got.items()} == want and any(got.values())
    assert all(len(set(w)) == len(w) for w in got.values())


def test_coordinations_list_each_way_once(spark, monkeypatch):
    """Coordinations within one another share their ways, which are neither listed for each nor listed without a gap."""
    annotated = annotate.sentences(spark.createDataFrame([(1, "x y z and u and v w q")], "doc_id long, text string"))
    found = candidates.coordinations(annotated, "simple")
    pairs = found.select("lemmas", F.explode("pairs").alias("p")).select(F.get("lemmas", F.col("p.i")).alias("a"), F.get("lemmas", F.col("p.j")).alias("b")).distinct()
    listed, inner = [], candidates.discontinuous
    monkeypatch.setattr(candidates, "discontinuous", lambda df, pattern: listed.append(df) or inner(df, pattern))
    kept = candidates.coordinated(found, pairs, "simple").count()
    assert listed[0].count() == listed[0].select("at").distinct().count() >= kept > 0


def test_only_rows_with_a_bridge_reach_its_join(spark):
    rows = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("a"), F.lit("b").alias("b"))
    passed = candidates.sieved(rows, rows.where("a in ('a7', 'a1999')"), "a", "b")
    assert {r.a for r in passed.collect()} >= {"a7", "a1999"} and passed.count() < 20


def test_gapped_choices_meet_concepts_in_one_grouping(spark):
    """Repeated words, odd signs and nulls, concepts of up to seven words, and their last words as concepts."""
    draw = random.Random(6)
    longest = [[draw.choice(["a", "b", "c", "\x1f", "\x1e", None, "x y"]) for _ in range(draw.randint(2, 7))] for _ in range(60)]
    concepts = {tuple(t[i:]) for t in longest for i in range(len(t) - 1)}
    df = spark.createDataFrame([(list(t),) for t in sorted(concepts, key=repr)] * 2, "term array<string>")

    def gapped(t):
        runs = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        return {tuple(t[i] for i in c) for k in range(2, len(t)) for c in combinations(range(len(t)), k)} - runs

    want = {c for t in concepts for c in gapped(t)} & concepts
    for last_words in (False, True):
        found = candidates.skips_that_are_concepts(df, last_words)
        assert "MergeJoin" not in plan(found) and "HashJoin" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
        got = [tuple(r.term) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 10


def test_model_and_types_are_counted_in_one_grouping(spark):
    draw = random.Random(8)
    rows = [(1, i, [draw.choice(["a", "b", "\x1f", None]) for _ in range(n)], [draw.choice("annv") for _ in range(n)]) for i, n in enumerate(draw.randint(1, 7) for _ in range(80))]
    annotated = spark.createDataFrame(rows, "doc_id long, sent_id int, lemmas array<string>, tags array<string>")
    runs = candidates.counted_runs(annotated, "simple", 2, 5, 2)
    assert plan(runs).count("Exchange hashpartitioning") == 1
    all_, kept = Counter(), set()
    for _, _, words, tags in rows:
        for i, j in ((i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 5) + 1)):
            all_[tuple(words[i:j])] += 1
            if j - i > 1 and tags[j - 1] == "n" and set(tags[i:j]) <= set("an"):
                kept.add(tuple(words[i:j]))
    got = {tuple(r.term): r for r in runs.withColumn("term", text.tokens_of(F.col("key"))).collect()}
    assert {t: (r.n, r.freq, r.is_type) for t, r in got.items()} == {t: (len(t), f, t in kept) for t, f in all_.items() if f > 1 or t in kept}
    disc = [("a", "b"), ("v", "v"), (None, "a", "b"), ("a", "v", "b", "a", "b", "a")]
    keys = spark.createDataFrame([(list(t),) for t in disc], "term array<string>").select(text.key_of(text.keyed(F.col("term"))).alias("key"))
    sides = {tuple(r.term): (r.freq, r.kind) for r in candidates.counted_by_side(runs, keys, 2).collect()}
    kind = lambda t: "both" if t in kept and t in disc else "only_CC" if t in kept else "only_DC"
    assert sides == {t: (all_[t] if len(t) < 6 and all_[t] > 1 else 0, kind(t)) for t in kept | set(disc)}


def test_concept_sides_count_no_types_or_model_of_their_own(spark, data, monkeypatch):
    from lexiloom.plans import queries

    def barred(*args, **kwargs):
        raise AssertionError("counted again")

    monkeypatch.setattr(queries, "types", barred)
    monkeypatch.setattr(queries, "model", barred)
    assert queries.QUERIES["concept_sides"](spark, data).columns == ["term", "freq", "kind", "pmi_nl"]


def test_candidate_keys_from_token_rows(spark):
    draw = random.Random(9)
    rows = [(i % 3, i, [draw.choice(["a", "b", "\x1e", None]) for _ in range(n)], [draw.choice(["a", "n", "v", "s", None]) for _ in range(n)]) for i, n in enumerate(draw.randint(1, 9) for _ in range(80))]
    annotated = spark.createDataFrame(rows, "doc_id long, sent_id int, lemmas array<string>, tags array<string>")
    for tag_filter, most in (("simple", 5), ("unsilo", 7), ("liberal", 3)):
        want = Counter((r.doc_id, tuple(r.term)) for r in candidates.contiguous(annotated, tag_filter, 2, most).select("doc_id", "term").collect())
        keys = candidates.contiguous_keys(annotated, tag_filter, 2, most, "doc_id")
        assert Counter((r.doc_id, tuple(r.term)) for r in keys.select("doc_id", text.tokens_of(F.col("key")).alias("term")).collect()) == want


def test_bigrams_that_no_bridge_asks_for_are_not_counted(spark):
    words = [["a", "b", f"w{i}", f"v{i}", "\x1f", "c"] for i in range(100)] * 2
    annotated = spark.createDataFrame([(w, ["n"] * len(w)) for w in words], "lemmas array<string>, tags array<string>")
    pairs = spark.createDataFrame([("a", "b"), ("w5", "v5"), ("\x1f", "c"), ("b", "a")], "a string, b string")
    found = {tuple(r.term): (r.n, r.freq) for r in candidates.asked_model(annotated, pairs, 2).collect()}
    whole = {tuple(r.term): (r.n, r.freq) for r in ngrams.ngram_counts(annotated, 2, 2).collect()}
    assert found.items() <= whole.items() and {t for t in whole if len(t) == 1} | {("a", "b"), ("w5", "v5"), ("\x1f", "c")} <= set(found)
    assert len(found) < len([t for t in whole if len(t) == 1]) + 20
