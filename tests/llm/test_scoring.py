"""Language identification, fill-in-the-middle and importance resampling: against brute force, SQL and exact round trips."""

import hashlib
import math
import re
import zlib
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import language, middle, resampling
from lexiloom.llm.common import table

from .conftest import ROWS


def normal(rows):
    return sorted(map(repr, rows))


# language


def all_ways(word, pieces):
    """Every segmentation of a word into pieces; a character outside them is a piece of its own."""
    if not word:
        yield []
    for size in range(1, len(word) + 1):
        if word[:size] in pieces or (size == 1 and word[0] not in pieces):
            yield from ([word[:size], *rest] for rest in all_ways(word[size:], pieces))


@pytest.fixture(scope="module")
def toy():
    pieces = sorted({language.START, language.START + "a", "a", "b", "ab", "ba", "abb", "bb", "é", "aé"})
    draws = np.random.default_rng(3).random((len(pieces), 3))
    return pieces, draws / draws.sum(axis=0)


def probability(way, pieces, rates, lang):
    return math.prod(rates[pieces.index(p), lang] if p in pieces else language.UNKNOWN for p in way)


def test_forward_sums_all_segmentations(toy):
    pieces, rates = toy
    words = ["".join(w) for n in range(1, 6) for w in product("abé", repeat=n)][::7] + ["azb", "z", "😀a"]
    found = language.Lattice(words, language.Vocabulary(pieces)).log_likelihoods(language.padded(rates))
    for w, logs in zip(words, found, strict=True):
        for lang in range(3):
            want = sum(probability(way, pieces, rates, lang) for way in all_ways(language.START + w, set(pieces)))
            assert logs[lang] == pytest.approx(math.log(want))
        assert language.long_word(w, language.Vocabulary(pieces), language.padded(rates)) == pytest.approx(logs)


def test_pieces_are_found_by_hash():
    pieces = language.public_pieces()
    vocabulary = language.Vocabulary(pieces)
    words = [p.removeprefix(language.START) for p in pieces[::50]] + ["straße", "naïve", "слово", "語"]
    lattice = language.Lattice(words, vocabulary)
    for i, w in enumerate(words):
        marked = language.START + w
        for end in range(1, len(marked) + 1):
            for size in range(1, min(lattice.longest, end) + 1):
                known = vocabulary.number.get(marked[end - size : end], len(pieces) if size == 1 else len(pieces) + 1)
                assert lattice.ids[end, size, i] == known


def test_expected_counts(spark, toy):
    pieces, rates = toy
    words = [("x", "abab", 3), ("y", "babb", 1), ("x", "aéb", 2), ("y", "abab", 5)]
    got = {(r.lang, r.piece): r.n for r in language.expected_counts(spark.createDataFrame(words, "lang string, word string, n long"), pieces, ["x", "y"], rates[:, :2]).collect()}
    want: dict = {}
    for lang, word, n in words:
        at = "xy".index(lang)
        ways = [(way, probability(way, pieces, rates, at)) for way in all_ways(language.START + word, set(pieces))]
        for way, p in ways:
            for piece in way:
                key = at, pieces.index(piece)
                want[key] = want.get(key, 0) + n * p / sum(q for _, q in ways)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.op11_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)


def test_language_of_odd_rows(spark, edge, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    docs = spark.createDataFrame([*rows, (98, None, "fr"), (99, "le chien", None)], "doc_id long, text string, lang string")
    model = language.train(docs, language.public_pieces())
    assert model.langs == ["de", "en"]
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(edge, model).collect()}
    assert {(3, "und", False), (4, "und", False), (10, "und", False), (1, "en", True)} <= got and len(got) == len({r[0] for r in ROWS})
    assert language.predict(empty, model).count() == 0
    none = language.train(empty, language.public_pieces())
    assert {(r.lang_pred, r.score) for r in language.predict(edge, none).collect()} == {("und", 0.0)}
    mixed = spark.createDataFrame([(1, "UND DIE KATZE, UND"), (2, "123 -- 4"), (None, "the dog")], "doc_id long, text string")
    assert [r.lang_pred for r in language.predict(mixed, model).collect()] == ["de", "und", "en"]


def test_a_model_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_CELLS", 3)
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="numbers"):
        language.train(docs, ["a", "b"])


# fill in the middle


def rearranged(doc_id, text):
    text = text or ""
    digest, n = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest(), len(text)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, mid, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{mid}"


TEXTS = ["é😀ü" * 30, "<S", "P>", "<<S>>", "a<M>b", "<P", "> x <", "x" * 4097, "\n\n", "𝒳" * 2049, "a\tb  c\n", " "]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_fill_in_middle(spark, edge, empty, monkeypatch, chunk):
    monkeypatch.setattr(middle, "CHUNK", chunk)
    monkeypatch.setattr(middle, "STRIDE", 64)
    docs = edge.select("doc_id", "text") if chunk > 1 else edge.select("doc_id", "text").where("length(text) < 1000 or text is null")
    more = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(240)], "doc_id long, text string")
    rows = docs.unionByName(more).collect()
    found = middle.fill_in_middle(docs.unionByName(more)).select("doc_id", "text", "n", "form", "prefix_units", "middle_units", "output", middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert normal(tuple(r)[:7] for r in found) == normal((r.doc_id, r.text or "", *rearranged(r.doc_id, r.text)) for r in rows)
    assert all(r.back == r.text for r in found) and {r.form for r in found} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("unit, begins", [("words", r"(?<![^ \t-\r])[^ \t-\r]"), ("lines", r"(?m)^(?!\Z)")])
def test_other_units(spark, monkeypatch, unit, begins):
    monkeypatch.setattr(middle, "CHUNK", 5)
    docs = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)] + "\nein wort é \n" * (i % 3)) for i in range(60)], "doc_id long, text string")
    for r in middle.fill_in_middle(docs, unit).collect():
        at = [m.start() for m in re.finditer(begins, r.text)]
        assert r.n == len(at)
        if r.form == "psm":
            places = [0 if k == 0 else len(r.text) if k == r.n else at[k] for k in (r.prefix_units, r.prefix_units + r.middle_units)]
            assert r.output == f"<P>{r.text[: places[0]]}<S>{r.text[places[1] :]}<M>{r.text[places[0] : places[1]]}"


def test_fill_in_middle_sql(spark, data):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = middle.op12_fill_in_middle(spark, data)
    want = duck.sql(middle.OP12_SQL)
    assert normal(tuple(r) for r in df.select(*want.columns).collect()) == normal(want.fetchall())


# importance resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(rows, target):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    own, other = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for held, all_ in ((s, own), (t, other)):
        for _, buckets in all_:
            np.add.at(held, buckets, 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + 10_000) / ((s[k] + 1) * (t.sum() + 10_000)))) for k in range(10_000)]
    out = []
    for (doc_id, _), (n, buckets) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in buckets)
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = rank + 1
    return [tuple(r[:5]) for r in out]


def test_resampling(spark, data):
    rows = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, data, "benchmark").collect()]
    got = [tuple(r) for r in resampling.op13_importance_resampling(spark, data).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert normal(got) == normal(brute_resample(rows, target))


@pytest.mark.parametrize("chunk", [1, 7, 40, 1 << 16])
def test_chunks_own_their_starts(spark, edge, empty, monkeypatch, chunk):
    """Texts cut into chunks of any size count as whole ones do; equal rows, null ids and long words too."""
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    some = edge if chunk > 7 else edge.where("length(text) < 1000 or text is null")
    more = [(i, f"Wort {i % 3} éé  A-b c" * (i % 40), "s") for i in range(300)] + [(7, "one two three four " * 9, "s")] * 3 + [(None, "x y z " * 30, "s")] * 2
    docs = some.select("doc_id", "text").unionByName(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    target = spark.createDataFrame([("wort eins A c x y",), (None,), ("one two three",)], "text string")
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert normal(got) == normal(brute_resample(rows, [r.text for r in target.collect()]))
    assert sum(r[4] is not None for r in got) > 5
    assert resampling.resample(empty, target).count() == 0


def test_checksums_join():
    tables = resampling.zero_shifts()
    one, other = [b"", b"a", "straße".encode(), b"x" * 300], [b" b", b" ", " é".encode(), b" " + b"y" * 70_000]
    crc = lambda all_: np.array([zlib.crc32(x) for x in all_], np.uint32)
    got = resampling.joined_crc(crc(one), crc(other), np.array([len(x) for x in other]), tables)
    assert (got == crc([a + b for a, b in zip(one, other, strict=True)])).all()
    text = " ".join(f"w{i}" for i in range(50))
    whole = resampling.run_buckets(pa.array([text]), None, tables)
    assert len(whole[0]) == 50 + 49 + 48 and whole[2].tolist() == [50]
