"""Measures, n-grams, nested frequencies, rankings, evaluation and discontinuous candidates against goldens and plain Python."""

import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import measures
from lexiloom.functions.text import found_in, ngrams_of, subsequences_of, tag_letter
from lexiloom.operators import annotate, candidates, evaluation, ngrams, ranking, statistics, termhood


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def cells(*values):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ab", "a_nb", "na_b", "na_nb"), values, strict=True)])


def test_measures(spark):
    for table in ((110, 2442, 111, 29114), (110, 111, 2442, 29114)):
        assert one(spark, measures.log_likelihood_ratio(cells(*table))) == pytest.approx(270.7218769362)
    assert one(spark, measures.tf_idf(F.lit(4), F.lit(1), F.lit(10))) == 20
    assert one(spark, measures.term_coherence(F.lit(1), F.lit(2), F.lit(9))) == 0
    assert one(spark, measures.term_coherence(F.lit(0), F.lit(2), F.lit(9))) == 0
    assert one(spark, measures.f_measure(F.lit(0.0), F.lit(0.0))) == 0
    assert one(spark, measures.normalized_pmi(F.lit(3), F.lit(-2.0), F.lit(1), F.lit(9))) is None
    with pytest.raises(Exception, match="above zero"):
        one(spark, measures.checked(cells(1, 0, 1, 1))["ab"])
    t = spark.range(1).select(measures.contingency(F.lit(5), F.lit(6), F.lit(30), F.lit(100)).alias("t")).first().t
    assert tuple(t) == (6, 2, 26, 70)
    clamped = spark.range(1).select(measures.contingency(F.lit(9), F.lit(8), F.lit(8), F.lit(100)).alias("t")).first().t
    assert tuple(clamped) == (10, 1, 1, 92)


def test_arrays(spark):
    t = F.array(*[F.lit(c) for c in "abc"])
    assert one(spark, ngrams_of(t, 1, 2)) == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]]
    assert one(spark, ngrams_of(F.array(F.lit("a")), 2, 5)) == []
    assert one(spark, subsequences_of(t, 2)) == [["a", "b"], ["a", "c"], ["b", "c"]]
    assert [one(spark, tag_letter(F.lit(x))) for x in ("NNS", "PRP", "-NONE-", "JJ")] == ["n", "P", "Ø", "a"]


def toy(spark):
    rows = [("a b c", 2), ("b c", 5), ("a b", 2), ("x a b c", 1), ("b c d", 1)]
    return spark.createDataFrame([(t.split(), len(t.split()), f) for t, f in rows], "term array<string>, n int, freq long")


def test_nested_frequencies(spark):
    got = {" ".join(r.term): (r.rect_freq, r.c_value) for r in termhood.nested_frequencies(toy(spark)).collect()}
    want = {"x a b c": (1, 2.0), "a b c": (1, math.log2(3)), "b c d": (1, math.log2(3)), "b c": (2, 4.0), "a b": (0, 1.0)}
    assert got == {t: (rf, pytest.approx(c)) for t, (rf, c) in want.items()}


def test_rectified_frequencies_add_up(spark):
    draw = random.Random(1)
    terms = {tuple(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(150)}
    rows = [(list(t), len(t), draw.randint(1, 9)) for t in sorted(terms)]
    got = {tuple(r.term): r for r in termhood.nested_frequencies(spark.createDataFrame(rows, "term array<string>, n int, freq long")).collect()}
    inside = lambda a, b: len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b)))
    for t, r in got.items():
        assert r.freq == r.rect_freq + sum(s.rect_freq for u, s in got.items() if inside(t, u))


def test_models(spark):
    docs = spark.createDataFrame([(1, "The cats sat. The cats ran, the cats sat"), (2, None), (3, "")], "doc_id long, text string")
    annotated = annotate.sentences(docs)
    model = {" ".join(r.term): (r.freq, r.docs) for r in ngrams.ngram_model(annotated, 2).collect()}
    assert model["the cat"] == (3, 1) and model["ran ,"] == (1, 1)
    assert "sat the" not in model  # not across sentences
    skips = {" ".join(r.pattern): r.freq for r in ngrams.skipgram_model(annotated, 4, 1).collect()}
    assert skips["the {*} sat"] == 2
    assert ngrams.ngram_model(annotate.sentences(docs.where("false")), 2).count() == 0


def test_compat_weights():
    assert [ngrams.orders((k,)) for k in (1, 2, 3, 4)] == [1, 2, 4, 8]
    assert (ngrams.orders((1, 1)), ngrams.orders((2, 0)), ngrams.orders((0, 2))) == (3, 2, 2)


def test_compat_weights_in_a_model(spark):
    patterns = [("a {*} b", 4), ("a {*} {*} b", 3)]
    skips = spark.createDataFrame([(p.split(), ["a", "b"], 2, f) for p, f in patterns], "pattern array<string>, words array<string>, n_words int, freq long")
    model = spark.createDataFrame([(["a", "b"], 2, 5)], "term array<string>, n int, freq long")
    assert ngrams.skip_aware(model, skips).first().skip_freq == 12
    assert ngrams.skip_aware(model, skips, compat_weights=True).first().skip_freq == 15


def test_token_places_are_code_points(spark):
    docs = spark.createDataFrame([(1, "a😀b, çd")], "doc_id long, text string")
    got = [(r.start, r.end, r.word) for r in annotate.token_spans(docs).orderBy("start").collect()]
    assert got == [(0, 1, "a"), (2, 3, "b"), (3, 4, ","), (5, 7, "çd")]


def test_rankings(spark):
    rows = [(["a"], 2.0), (["b"], 3.0), (["c"], 2.0), (["d"], None)]
    values = spark.createDataFrame(rows, "term array<string>, v double")
    ranks = {r.term[0]: r.rank for r in ranking.ranked(values, "v").collect()}
    assert ranks == {"b": 1, "a": 2, "c": 3, "d": 4}
    many = spark.range(0, 5000).select(F.array(F.col("id").cast("string")).alias("term"), (F.col("id") % 97).cast("double").alias("v"))
    got = ranking.ranked(many, "v").collect()
    order = sorted(got, key=lambda r: (-r.v, r.term[0]))
    assert [r.rank for r in order] == list(range(1, 5001))
    assert ranking.keep_proportion(ranking.ranked(values, "v"), 0.5).count() == 2
    flags = spark.createDataFrame([(True, True, False), (True, None, False), (False, False, False)], "a boolean, b boolean, c boolean")
    p = [F.col(c) for c in "abc"]
    held = lambda m, n=1: [r[0] for r in flags.select(ranking.combined(p, m, n)).collect()]
    assert held("all") == [False] * 3 and held("any") == [True, True, False] and held("majority") == [True, False, False] and held("at_least", 1) == held("any")
    assert ranking.ranked(values.where("false"), "v").count() == 0


def test_evaluation(spark):
    to = lambda words: spark.createDataFrame([([w],) for w in words], "term array<string>")
    r = evaluation.report(to("abc"), to("bcde"), ["term"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 2) and r.precision == pytest.approx(2 / 3) and r.recall == 0.5
    assert r.tp + r.fp == 3
    none = evaluation.report(to("a").where("false"), to("b").where("false"), ["term"]).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    ranks = spark.createDataFrame([(["a"], 1), (["b"], 2), (["c"], 3)], "term array<string>, rank int")
    assert {x.k: x.precision for x in evaluation.precision_at(ranks, to("ac"), [1, 2, 9]).collect()} == {1: 1.0, 2: 0.5, 3: pytest.approx(2 / 3)}


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    assert tuple(statistics.quantiles(df, "v").first()) == (1, 1.75, 3, 5, 8)
    two = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (5.0, False)], "v double, f boolean")
    assert statistics.mann_whitney_u(two, "v", "f").first().u == 0.5


WORDS = ["nk", "t", "cell", "big", "and", ",", "line", "b"]
TAGS = {"and": "c", ",": ",", "big": "a"}


def plain_paths(prefix, bridged, tags):
    last = prefix[-1]
    out = [p for to in bridged.get(last, ()) for p in plain_paths([*prefix, to], bridged, tags)]
    if last + 1 >= len(tags) or tags[last + 1] in "c,":
        return [*out, prefix]
    return out + plain_paths([*prefix, last + 1], bridged, tags)


def test_paths_match_recursion(spark):
    draw = random.Random(4)
    rows = []
    for k in range(300):
        n = draw.randint(1, 9)
        tags = "".join(draw.choice("aannc,") for _ in range(n))
        bridged = {}
        for i, j in combinations(range(n), 2):
            if draw.random() < 0.15:
                bridged.setdefault(i, []).append(j)
        start, end = (0, n) if k % 2 else (draw.randrange(n), draw.randint(1, n))
        rows.append((tags, [(i, j) for i, to in bridged.items() for j in to], start, max(start + 1, end)))
    df = spark.createDataFrame(rows, "tags string, bridged array<struct<i:int,j:int>>, s int, e int")
    for r in df.withColumn("ways", candidates.ways_in(F.col("tags"), F.col("bridged"), F.col("s"), F.col("e"))).collect():
        bridged = {}
        for i, j in r.bridged:
            bridged.setdefault(i, []).append(j)
        want = {tuple(w) for w in plain_paths([r.s], bridged, r.tags[: r.e])}
        assert {tuple(w) for w in r.ways} == want and len(r.ways) == len(want)


def test_long_ways_without_listing_all_choices(spark):
    """A way through sixty tokens and one bridge: two ways, not two to the power of sixty."""
    tags = "n" * 60
    row = spark.createDataFrame([(tags, [(3, 50)])], "tags string, bridged array<struct<i:int,j:int>>")
    got = row.select(candidates.ways_in(F.col("tags"), F.col("bridged"), F.lit(0), F.lit(60)).alias("w")).first().w
    assert sorted(got) == sorted([list(range(60)), [*range(4), *range(50, 60)]])


@pytest.mark.parametrize("letters", ["an", "navs", "navrds"])
def test_linear_pattern_finds_the_same_spans(spark, letters):
    plain = re.compile(f"(([{letters}]+,?)+c[{letters}])+[{letters}]*")
    linear = candidates.coordination_pattern(letters)
    draw = random.Random(7)
    texts = ["".join(draw.choice("aannc,pc") for _ in range(draw.randint(0, 11))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", found_in(F.col("t"), linear).alias("m"))
    for r in df.collect():
        want = [m.span() for m in plain.finditer(r.t)]
        assert want == [m.span() for m in re.finditer(linear, r.t)]
        assert want == [(m.start, m.start + len(m.text)) for m in r.m]


def plain_pairs(tags, plural_first):
    found = set()
    for m in re.finditer(candidates.GROUP, tags):
        first, last = m.start(1), m.start(3)
        listed = [i for i in range(m.start(2), m.end(2)) if tags[i] != ","]
        stop = tags.find("c", last + 1)
        after = list(range(last + 1, len(tags))) if stop < 0 else [*range(last + 1, stop), stop + 1]
        stop = tags.rfind("c", 0, first)
        before = list(range(first)) if stop < 0 else [*range(stop + 1, first), stop - 1]
        if not plural_first[first]:
            found.update((first, j) for j in after)
        found.update((i, j) for i in before for j in [last, *listed])
        found.update((i, j) for i in listed for j in after)
    return found


def test_coordination_pairs(spark):
    cases = {"acan": {(0, 3)}, "nncn": {(0, 3)}, "a,a,can": {(0, 6), (2, 6)}}
    for tags, want in cases.items():
        assert plain_pairs(tags, [False] * len(tags)) == want
    assert plain_pairs("nncn", [False, True, False, False]) == {(0, 3)}
    draw = random.Random(9)
    rows = [(t, [draw.random() < 0.2 for _ in t]) for t in [*cases, *("".join(draw.choice("aannc,c") for _ in range(draw.randint(1, 14))) for _ in range(1500))]]
    df = spark.createDataFrame(rows, "tags string, plural array<boolean>")
    for r in df.select("*", candidates.coordination_pairs(F.col("tags"), F.col("plural")).alias("pairs")).collect():
        assert {tuple(p) for p in r.pairs} == plain_pairs(r.tags, r.plural)


def known(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def test_coordinated_concepts(spark):
    docs = spark.createDataFrame([(1, "nk and t cells of it")], "doc_id long, text string")
    annotated = annotate.sentences(docs)
    found = candidates.coordinations(annotated, "simple")
    got = candidates.coordinated(found, known(spark, [("nk", "cell")]), "simple").collect()
    assert [(r.positions, r.term) for r in got] == [([0, 3], ["nk", "cell"])]
    assert candidates.coordinated(found, known(spark, [("x", "y")]), "simple").count() == 0


def test_hypernyms(spark):
    docs = spark.createDataFrame([(1, "human blood cell line")], "doc_id long, text string")
    annotated = annotate.sentences(docs)
    basic = candidates.contiguous(annotated, "simple", 3)
    got = candidates.hypernyms(basic, annotated, known(spark, [("human", "cell")]), "simple").collect()
    assert sorted(tuple(r.positions) for r in got) == [(0, 2), (0, 2, 3)]


def test_illegal_bridges(spark):
    def illegal(way, lemmas, first=0):
        at, words = F.array(*[F.lit(i) for i in way]), F.array(*[F.lit(w) for w in lemmas])
        return one(spark, candidates.bridges_itself(candidates.chunks(at), words, F.lit(first)))

    assert illegal([0, 4], ["t", "x", "and", "t", "line"])
    assert not illegal([0, 3], ["nk", "and", "t", "cell"])
    assert illegal([7, 8, 12], ["a", "b", "b", "c", "a", "d"], 7) and not illegal([7, 8, 11], ["a", "b", "b", "c", "d"], 7)


def test_streaming_counts(spark, tmp_path):
    from lexiloom.streaming.counts import streaming_counts

    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streaming_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT freq FROM counts WHERE term = 'a'").first().freq == 2


def test_small_operators(spark, tmp_path):
    model = spark.createDataFrame([(["a", "b"], 2, 5), (["the", "b"], 2, 4), (["a"], 1, 9)], "term array<string>, n int, freq long")
    ngrams.save_model(model, str(tmp_path / "m"))
    assert sorted(tuple(r.term) for r in ngrams.load_model(spark, str(tmp_path / "m")).collect()) == [("a",), ("a", "b"), ("the", "b")]
    stop = spark.createDataFrame([("the",)], "word string")
    assert [r.term for r in ngrams.without_words(ngrams.iterate(model, 2, 4), stop).collect()] == [["a", "b"]]
    tags = F.array(*[F.lit(c) for c in "nc,n"])
    assert one(spark, annotate.tokens_between(F.lit(3), F.lit(0), tags)) == 2
    assert one(spark, annotate.tokens_between(F.lit(0), F.lit(3), tags, ",")) == 1
    spans = spark.createDataFrame([("d", 0, 2), ("d", 0, 2), ("d", 3, 4)], "doc_id string, start int, end int")
    assert annotate.add(spans, spans).count() == 2 and annotate.remove(spans, spans.where("start = 3")).count() == 2
    pairs = spark.createDataFrame([("d", 0, "e", 4)], "doc_id string, start int, other_doc_id string, other_end int")
    with pytest.raises(Exception, match="two documents"):
        annotate.merged(pairs).collect()


def test_extraction_accepts_by_type(spark):
    from lexiloom.plans import extraction

    text = ". ".join(["nk cell line", "nk and t cell line", "t cell line", "blood cell line is big", "nk cell line"] * 3)
    annotated, model = extraction.preprocess(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    reference = ngrams.ngram_counts(annotated, 1)
    listed = spark.createDataFrame([(["nk", "cell", "line"],)], "term array<string>")
    for before in (True, False):
        found = extraction.extract(annotated, model, reference, listed, extraction.Configuration(consider_dcs_in_ranking=before))
        got = {tuple(r.positions) for r in found["accepted"].where(F.array_join("term", " ") == "nk cell line").collect()}
        assert got == {(0, 1, 2), (0, 3, 4)}
        assert found["metrics"].where("vote is null").count() == 0


def test_more_small_operators(spark):
    from lexiloom.functions.text import covered_text, tag_sequence
    from lexiloom.operators import structure
    from lexiloom.sources import corpora

    values = spark.createDataFrame([(["a"], 2.0), (["a", "b"], 3.0)], "term array<string>, v double")
    assert [r.term for r in ranking.filter_at_value(values, "v", 2.0).collect()] == [["a", "b"]]
    assert [r.term for r in structure.subset_terms(values, ["b", "a"]).collect()] == [["a", "b"]]
    lines = annotate.normalized(spark.createDataFrame([(1, 0, ["x y", "z"])], "doc_id long, sent_id int, lemmas array<string>"))
    assert lines.first().line == "x_y z"
    spans = F.expr("array(named_struct('start', 0, 'end', 2), named_struct('start', 9, 'end', 14))")
    assert one(spark, covered_text(F.lit("NK and T cells"), spans)) == "NK cells"
    assert one(spark, tag_sequence(F.array(F.lit("n"), F.lit("c")))) == "nc"
    two = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (5.0, False)], "v double, f boolean")
    assert statistics.common_language_effect(statistics.mann_whitney_u(two, "v", "f")).first().cles == 0.125
    to = lambda ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r.doc_id for r in evaluation.missing_gold(to([1, 2]), to([1])).collect()] == [2]
    assert [r.doc_id for r in corpora.without_quarantined(to([1, 2]), to([1])).collect()] == [2]
    ranks = spark.createDataFrame([(["a"], 1), (["b"], 2)], "term array<string>, rank int")
    running = evaluation.running_precision(ranks, values.select("term"), 2).orderBy("rank").collect()
    assert [r.precision for r in running] == [1.0, 0.5]


def test_token_spans_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc dd"), (2, ""), (3, None), (4, "é, 😀 x" + " y" * 600)], "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.end, r.word) for r in annotate.token_spans(docs).collect())
    assert found[:4] == [(1, 0, 2, "aa"), (1, 0, 2, "cc"), (1, 3, 5, "bb"), (1, 3, 5, "dd")]
    assert found[4:7] == [(4, 0, 1, "é"), (4, 1, 2, ","), (4, 5, 6, "x")] and found[-1] == (4, 1205, 1206, "y")


def test_sums_before(spark):
    from lexiloom.operators import ranking

    rows = spark.range(0, 500).select(((F.col("id") * 37) % 500).alias("v"), (F.col("id") % 5).alias("w")).repartition(6)
    got = {r.v: r.s for r in ranking.sums_before(rows, [F.col("v")], {"s": F.col("w")}).collect()}
    at = 0
    for v, w in sorted((r.v, r.w) for r in rows.collect()):
        assert got[v] == at
        at += w


def test_effect_from_t(spark):
    import math

    from lexiloom.operators import statistics

    rows = [(t, 40, 70) for t in (-5.0, -0.3, 0.0, 1.7, 86.845)]
    df = spark.createDataFrame(rows, "t double, a int, b int")
    got = [r.c for r in df.select("t", statistics.effect_from_t(F.col("t"), F.col("a"), F.col("b")).alias("c")).orderBy("t").collect()]
    want = [(1 + math.erf(t * math.sqrt(1 / a + 1 / b) / 2)) / 2 for t, a, b in rows]
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, want, strict=True))


def test_small_concept_operators(spark):
    from lexiloom.operators import candidates, ranking, statistics

    rows = [(1, ["a", "b"], False), (1, ["a", "b"], False), (2, ["a", "b"], True), (2, ["a", "x", "b"], False)]
    concepts = spark.createDataFrame(rows, "doc_id long, term array<string>, is_disc boolean")
    counts = lambda **k: sorted((" ".join(r.term), r.freq) for r in annotate.count_concepts(concepts, **k).collect())
    assert counts() == [("a b", 3), ("a x b", 1)]
    assert counts(discontinuous=False) == [("a b", 2), ("a x b", 1)]
    assert counts(doc_frequency=True) == [("a b", 2), ("a x b", 1)]
    assert [r.term for r in candidates.skips_that_are_concepts(concepts).collect()] == [["a", "b"]]
    assert statistics.values_where(concepts, "doc_id", "is_disc", True).collect() == [(2,)]
    disc = spark.createDataFrame([([3, 4, 7], ["p", "q", "r"]), ([1, 3], ["s", "t"])], "positions array<int>, term array<string>")
    votes = spark.createDataFrame([(["p", "q", "r"], 1.5)], "term array<string>, vote double")
    known = spark.createDataFrame([("q", "r", 4, 2.5)], "a string, b string, freq int, strength double")
    assert sorted((r.vote, r.strength) for r in ranking.with_bridge_strength(disc, votes, known).collect()) == [(0.0, None), (1.5, 2.5)]


def test_gold_selection_reports_what_it_leaves_out(spark):
    rows = [(["a", "b"], "nn", False, True), (["a"], "n", False, True), (["c", "d"], "vn", False, True), (["e", "f"], "nn", True, True), (["g", "h"], "nn", False, False), (["i", "j"], None, False, True), (["k", "l"], "nn", False, None)]
    concepts = spark.createDataFrame(rows, "term array<string>, tags string, is_disc boolean, bounded boolean")
    assert tuple(evaluation.gold_report(concepts, disc=False, tag_pattern="n+").first()) == (2, 2, 2)
    assert tuple(evaluation.gold_report(concepts).first()) == (5, 2, 0)
    assert tuple(evaluation.gold_report(concepts.limit(0)).first()) == (0, 0, 0)
    assert {tuple(r.term) for r in evaluation.gold_terms(concepts, disc=False, tag_pattern="n+").collect()} == {("a", "b")}
