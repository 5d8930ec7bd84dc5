"""Candidate concepts by tag sequences: contiguous runs, bridges, and discontinuous ones.

A candidate is (doc_id, sent_id, positions, term, tags): positions are token numbers within the sentence, so a run of
neighbours is contiguous and any step of more than one is a gap. The type of a candidate is its term, the lemmas.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.measures import bridge_strength, pair_pmi
from lexiloom.functions.text import BETWEEN, counted, found_in, key_of, keyed, named, parts_of, tokens_of, window_keys, window_rows, window_tokens
from lexiloom.operators.ranking import matched_by
from lexiloom.sources.tables import written

#: The three filters on tag sequences, for contiguous candidates and for coordinated ones.
FILTERS = {"unsilo": "([na]|(ns)|(vn))+n", "simple": "[an]+n", "liberal": "[navrds]*n"}
COORDINATED = {"unsilo": ("navs", "[navs]+n"), "simple": ("an", "[an]+n"), "liberal": ("navrds", "[navrds]+n")}
#: Longest sentence and longest coordination where a query's SQL bounds both.
MOST_TOKENS, MOST_MATCH = 100, 14
#: Ways are grown over so many tokens of a row at once; between these rounds each way is a row.
AT_ONCE = 14


def runs(tags: Column, tag_filter: str, min_n: int, max_n: int) -> Column:
    """array<struct<at, n>>: the places and lengths of a sentence's runs whose tags match the filter in full.

    Every filter ends with a noun, so only runs that do are tried, each from the tags around its noun.
    """
    pattern = f"^(?:{FILTERS[tag_filter]})$"

    def ending(all_tags: Column, end: Column) -> Column:
        lengths = counted(F.lit(min_n), F.least(F.lit(max_n), end + 1))
        return F.transform(F.filter(lengths, lambda n: F.array_join(F.slice(all_tags, end + 2 - n, n), "").rlike(pattern)), lambda n: F.struct((end + 1 - n).alias("at"), n.alias("n")))

    nouns = lambda all_tags: F.filter(counted(F.lit(0), F.size(all_tags) - 1), lambda i: F.get(all_tags, i) == "n")
    return F.flatten(F.transform(nouns(tags), lambda end: ending(tags, end)))


def contiguous(annotated: DataFrame, tag_filter: str, min_n: int = 1, max_n: int = 5) -> DataFrame:
    """Candidates that are runs of min_n to max_n tokens whose tags match the filter in full."""
    found = annotated.select("doc_id", "sent_id", "lemmas", F.array_join("tags", "").alias("all_tags"), F.explode(runs(F.col("tags"), tag_filter, min_n, max_n)).alias("r"))
    at, n = F.col("r.at"), F.col("r.n")
    return found.select("doc_id", "sent_id", F.sequence(at, at + n - 1).alias("positions"), F.slice("lemmas", at + 1, n).alias("term"), F.substring("all_tags", at + 1, n).alias("tags"))


def type_counts(candidates: DataFrame) -> DataFrame:
    """(term, n, freq, docs): distinct instances of each type, and documents with one."""
    one = candidates.select("term", "doc_id", "sent_id", "positions").distinct()
    per_doc = one.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("freq"))
    return per_doc.groupBy("term").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("docs")).select("term", F.size("term").alias("n"), "freq", "docs")


def contiguous_keys(annotated: DataFrame, tag_filter: str, min_n: int = 1, max_n: int = 5, *kept: str) -> DataFrame:
    """(kept columns, key): the key of each run of contiguous(...), which are distinct by their place."""
    keys = [F.when(window_matches(n, tag_filter), key) for n, key in enumerate(window_keys(max_n), 1) if n >= min_n]
    return windows(annotated, max_n, *kept).select(*kept, F.explode(F.array(*keys)).alias("key")).where("key is not null")


def windows(annotated: DataFrame, most: int, *kept: str, at: str | None = None) -> DataFrame:
    """The kept columns and text.window_rows of each sentence's lemmas and tags."""
    own = annotated.select(*kept, window_tokens(F.col("lemmas")).alias("__tokens"), F.transform("tags", lambda t: F.coalesce(t, F.lit(""))).alias("__tags"))
    return own.select(*kept, window_rows(F.col("__tokens"), F.col("__tags"), most, at))


def counted_runs(annotated: DataFrame, tag_filter: str, min_n: int, max_n: int, min_freq: int) -> DataFrame:
    """(key, n, freq, is_type) of runs of 1 to max_n tokens that occur min_freq times or once are a candidate of min_n tokens or more: the model and all types, counted in one grouping."""
    keys = [F.struct(key.alias("key"), (window_matches(n, tag_filter) if n >= min_n else F.lit(False)).alias("is_type")) for n, key in enumerate(window_keys(max_n), 1)]
    one = windows(annotated, max_n).select(F.explode(F.array(*keys)).alias("r")).select("r.key", "r.is_type").where("key is not null")
    counted_ = one.groupBy("key").agg(F.count(F.lit(1)).alias("freq"), F.max("is_type").alias("is_type"))
    return counted_.where(F.col("is_type") | (F.col("freq") >= min_freq)).select("key", F.size(F.split("key", BETWEEN, -1)).alias("n"), "freq", "is_type")


def window_matches(n: int, tag_filter: str) -> Column:
    """Whether the run of n tokens that begins with a row's token is a candidate, which ends with a noun; see text.window_rows."""
    tags = F.concat(*[F.col(f"t{i}") for i in range(n)])
    return (F.col(f"t{n - 1}") == "n") & tags.rlike(f"^(?:{FILTERS[tag_filter]})$")


def contiguous_freqs(annotated: DataFrame, tag_filter: str, min_n: int = 1, max_n: int = 5) -> DataFrame:
    """(term, n, freq), as contiguous_counts but without document counts, in one shuffle."""
    counted_ = contiguous_keys(annotated, tag_filter, min_n, max_n).groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
    return counted_.select(tokens_of(F.col("key")).alias("term"), "freq").select("term", F.size("term").alias("n"), "freq")


def contiguous_counts(annotated: DataFrame, tag_filter: str, min_n: int = 1, max_n: int = 5) -> DataFrame:
    """type_counts(contiguous(...)) without the distinct: runs of one sentence are distinct by their place."""
    found = contiguous_keys(annotated, tag_filter, min_n, max_n, "doc_id")
    per_doc = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("freq"))
    counted_ = per_doc.groupBy("key").agg(F.sum("freq").alias("freq"), F.count(F.lit(1)).alias("docs"))
    return counted_.select(tokens_of(F.col("key")).alias("term"), "freq", "docs").select("term", F.size("term").alias("n"), "freq", "docs")


def documents(candidates: DataFrame) -> int:
    """How many documents hold a candidate."""
    return candidates.agg(F.count_distinct("doc_id")).first()[0]


#: Longest concept whose choices are written out as columns.
MOST_SPELLED = 5


def gapped_keys(words: list[Column], last_words: bool) -> Column:
    """array<string>: the keys of the choices with a gap of so many words, two or more of each; with last_words, only of those with the first word."""
    n = len(words)
    chosen = [c for k in range(2, n) for c in combinations(range(n), k) if c[-1] - c[0] >= k and not (last_words and c[0])]
    spelled = lambda c: F.concat(*[x for i in c for x in (F.lit(BETWEEN), words[i])][1:])
    return F.array(*[spelled(c) for c in chosen])


def skips_that_are_concepts(concepts: DataFrame, last_words: bool = False) -> DataFrame:
    """(term): choices of a concept's words with a gap, and so no run of it, that are concepts themselves.

    last_words: whether the last two or more words of a concept always are a concept, as with runs whose tags match a
    filter; its choices without its first word are theirs, and are not listed again. Concepts and choices meet as keys in
    one grouping, added up before the shuffle; concepts may be repeated.
    """
    return keys_that_skip(concepts.select(key_of(keyed(F.col("term"))).alias("key")), last_words).select(tokens_of(F.col("key")).alias("term"))


def keys_that_skip(concepts: DataFrame, last_words: bool = False) -> DataFrame:
    """skips_that_are_concepts of concepts (key), as keys."""
    words = [F.get("tokens", F.lit(i)).alias(f"w{i}") for i in range(MOST_SPELLED)]
    one = concepts.select(F.col("key").alias("whole"), F.split("key", BETWEEN, -1).alias("tokens")).select("tokens", "whole", *words)
    size = F.size("tokens")
    longer = F.transform(F.array_except(parts_of(F.col("tokens"), 2, choices=True), parts_of(F.col("tokens"), 2)), key_of)
    choices = F.when(size > MOST_SPELLED, longer)
    for n in range(3, MOST_SPELLED + 1):
        choices = choices.when(size == n, gapped_keys([F.col(f"w{i}") for i in range(n)], last_words))
    listed = one.select("whole", F.explode(F.concat(F.array("whole"), F.coalesce(choices, F.expr("cast(array() as array<string>)")))).alias("key"))
    inside = lambda c: F.concat(F.lit(BETWEEN), c, F.lit(BETWEEN))
    own = F.col("key") == F.col("whole")
    some = listed.select("key", own.alias("own")).where(own | ~F.contains(inside(F.col("whole")), inside(F.col("key"))))
    return some.groupBy("key").agg(F.max("own").alias("own"), F.min("own").alias("alone")).where("own and not alone").select("key")


def by_side(terms: DataFrame, continuous: DataFrame, disc: DataFrame) -> DataFrame:
    """terms (term, ...) with kind: whether continuous or disc (term) holds them, as only_CC, only_DC, both or neither."""
    flagged = matched_by(terms, {"__cc": continuous, "__dc": disc})
    kind = F.when(F.col("__cc") & F.col("__dc"), "both").when(F.col("__cc"), "only_CC").when(F.col("__dc"), "only_DC").otherwise("neither")
    return flagged.withColumn("kind", kind).drop("__cc", "__dc")


def counted_by_side(runs: DataFrame, disc: DataFrame, min_freq: int) -> DataFrame:
    """(term, freq, kind) of the types among counted_runs and of disc (key), distinct: the model's count, 0 below min_freq, and kind as by_side has it.

    Both meet in one grouping, for which other runs than types are sieved.
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = runs.where("is_type").unionByName(sieved(runs.where("not is_type and n > 1"), disc, "key")).select("key", "freq", "is_type", F.lit(False).alias("is_disc"))
    met = own.unionByName(disc.select("key", none("long").alias("freq"), F.lit(False).alias("is_type"), F.lit(True).alias("is_disc"))).groupBy("key")
    flagged = met.agg(F.max("freq").alias("freq"), F.max("is_type").alias("cc"), F.max("is_disc").alias("dc")).where("cc or dc")
    kind = F.when(F.col("cc") & F.col("dc"), "both").when(F.col("cc"), "only_CC").otherwise("only_DC")
    return flagged.select(tokens_of(F.col("key")).alias("term"), F.when(F.col("freq") >= min_freq, F.col("freq")).otherwise(0).alias("freq"), kind.alias("kind"))


def asked_model(annotated: DataFrame, pairs: DataFrame, min_freq: int) -> DataFrame:
    """(term, n, freq) of the single words that occur min_freq times, and of the bigrams that do and may be one of pairs (a, b): what bridges asks of a model."""
    one = annotated.select(F.explode(window_tokens(F.col("lemmas"))).alias("key"), F.lit(1).alias("n"))
    asked = keyed_pairs(pairs, "w0", "w1")
    two = sieved(windows(annotated, 2).where("w1 is not null").select("w0", "w1"), asked, "w0", "w1").select(window_keys(2)[1].alias("key"), F.lit(2).alias("n"))
    counted_ = one.unionByName(two).groupBy("key", "n").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)
    return counted_.select(tokens_of(F.col("key")).alias("term"), "n", "freq")


def keyed_pairs(pairs: DataFrame, *names: str) -> DataFrame:
    """pairs (a, b, ...) under the names, as tokens stand in keys."""
    return pairs.select(*[F.element_at(window_tokens(F.array(c)), 1).alias(name) for name, c in zip(names, "ab", strict=True)])


def bridges(pairs: DataFrame | None, model: DataFrame, total: DataFrame, least_strength: float = 1, least_freq: int = 1, factor: float = 1) -> DataFrame:
    """(a, b, freq, strength) of the lemma pairs (a, b) that the model knows as bigrams and that are strong enough; of all of the model without pairs.

    total has one row, the model's single words' occurrences.
    """
    words = model.where("n = 1").select(F.get("term", F.lit(0)).alias("word"), "freq")
    two = model.where("n = 2").select(F.get("term", F.lit(0)).alias("a"), F.get("term", F.lit(1)).alias("b"), "freq")
    known = two if pairs is None else pairs.select("a", "b").distinct().join(two, ["a", "b"])
    known = known.join(words.toDF("a", "freq_a"), "a", "left").join(words.toDF("b", "freq_b"), "b", "left").crossJoin(F.broadcast(total))
    strength = bridge_strength(pair_pmi(F.col("freq"), F.coalesce("freq_a", F.lit(0)), F.coalesce("freq_b", F.lit(0)), F.col("total")), F.col("freq"), factor)
    return known.select("a", "b", "freq", strength.alias("strength")).where((F.col("strength") > least_strength) & (F.col("freq") >= least_freq))


def ways(start: Column, length: Column, edge: Callable[[Column, Column], Column], ends: Callable[[Column], Column]) -> Column:
    """array<array<int>>: all ways from token `start` over edges, each of which leads to a later token, to a token where ways end.

    Tokens are taken in order, and each gathers the ways of those that lead to it, so that only ways that exist are listed.
    """
    tokens = counted(start, length - 1)
    none = F.expr("cast(array() as array<array<array<int>>>)")

    def step(reached: Column, j: Column) -> Column:
        before = F.filter(counted(start, j - 1), lambda i: edge(i, j))
        longer = F.flatten(F.transform(before, lambda i: F.transform(F.get(reached, i - start), lambda w: F.array_append(w, j))))
        return F.array_append(reached, F.when(j == start, F.array(F.array(j))).otherwise(longer))

    gathered = F.aggregate(tokens, none, step)
    return named(gathered, lambda g: F.flatten(F.transform(F.filter(tokens, ends), lambda j: F.get(g, j - start))))


def letter(tags: Column, i: Column) -> Column:
    return F.substring(tags, i + 1, F.lit(1))


def ways_in(tags: Column, bridged: Column, start: Column, end: Column) -> Column:
    """Ways from a token over any bridge (i, j) of bridged, or to the next token; one ends before a coordination, a comma or the end."""
    stops = lambda i: (i + 1 >= end) | letter(tags, i + 1).isin("c", ",")
    edge = lambda i, j: F.array_contains(bridged, F.struct(i.alias("i"), j.alias("j"))) | ((j == i + 1) & ~stops(i))
    return ways(start, F.char_length(tags), edge, stops)


#: A way on its way: its tokens, the last one reached by a step to the next token, whether it has a gap, and the last of its start's ends.
WAY = "struct<w:array<int>,m:int,g:boolean,top:int>"


def grown(tags: Column, bridged: Column, ends: Column, letters: str | None, first: int, most: int | None, begun: Column, gapped: Column) -> Column:
    """array<struct<way:WAY, done, on>>: the ways that reach one of `most` tokens from token `first` on, done if they end there, and those that go on behind these tokens.

    Ways start at tokens with ends or, if there is one, go on from the way begun. See ways_from.
    """
    kind = f"array<{WAY}>"
    none = lambda of: F.expr(f"cast(array() as {of})")
    way = lambda w, m, g, top: F.struct(w.alias("w"), m.alias("m"), g.alias("g"), top.alias("top"))
    among = lambda j: F.lit(True) if letters is None else letter(tags, j).isin(*letters)
    size = F.char_length(tags)
    behind = size if most is None else F.least(size, F.lit(first + most))

    def step(reached: Column, j: Column) -> Column:
        starts = (F.size(F.get(ends, j)) > 0) & begun.isNull()
        own = F.when(starts, F.array(way(F.array(j), F.lit(0), gapped, F.array_max(F.get(ends, j))))).otherwise(none(kind))
        over = F.transform(F.filter(bridged, lambda b: b["j"] == j), lambda b: F.transform(F.get(reached, b["i"]), lambda w: way(F.array_append(w["w"], j), w["m"], w["g"] | (j > b["i"] + 1), w["top"])))
        next_ = F.transform(F.filter(F.coalesce(F.get(reached, j - 1), none(kind)), lambda w: j < w["top"]), lambda w: way(F.array_append(w["w"], j), j, w["g"], w["top"]))
        return F.array_append(reached, F.when(among(j), F.concat(own, F.flatten(over), next_)).otherwise(none(kind)))

    def ended(w: Column, j: Column) -> Column:
        before = letter(tags, j + 1).isin("c", ",")
        return (j >= first) & w["g"] & F.exists(F.get(ends, F.get(w["w"], F.lit(0))), lambda e: (e > w["m"]) & (before | (e <= j + 1)))

    def goes_on(w: Column, j: Column) -> Column:
        over = F.exists(bridged, lambda b: (b["i"] == j) & (b["j"] >= behind) & among(b["j"]))
        return over | ((j + 1 == behind) & (j + 1 < w["top"]) & among(j + 1))

    def flagged(of: Column, j: Column) -> Column:
        return F.transform(of, lambda w: F.struct(w.alias("way"), ended(w, j).alias("done"), (F.lit(False) if most is None else goes_on(w, j)).alias("on")))

    held = lambda i: F.when(i == F.element_at(begun["w"], -1), F.array(begun)).otherwise(none(kind))
    before = F.transform(counted(F.lit(0), F.lit(first - 1)), held) if first else none(f"array<{kind}>")
    reached = F.aggregate(counted(F.lit(first), behind - 1), before, step)
    return F.filter(F.flatten(F.transform(reached, flagged)), lambda x: x["done"] | x["on"])


def ways_from(tags: Column, bridged: Column, ends: Column, letters: str | None, gapped: Column | None = None) -> Column:
    """array<array<int>>: the ways with a gap, over tokens of the letters, that ways_in lists for (start, end) with any of a token's ends. No letter is c or a comma.

    ends: for each token the array<int> of the ends that it starts for, empty for most. A way is listed once, however many
    ends it has: beside its tokens go the last one reached by a step to the next token, which an end must lie behind, whether
    it has a gap, and the last of its start's ends. bridged: array<struct<i, j>>. letters: None for any. gapped: whether
    a row's tokens have gaps of their own, so that no way need leave one out.
    """
    found = grown(tags, bridged, ends, letters, 0, None, F.expr(f"cast(null as {WAY})"), F.lit(False) if gapped is None else gapped)
    return F.transform(found, lambda x: x["way"]["w"])


def each_way(rows: DataFrame, letters: str | None, longest: int | None = None, gapped: Column | None = None) -> DataFrame:
    """rows (tags, bridged, ends, ...) with each way of ways_from in place of bridged and ends.

    The ways of a row double with each of its bridges, so those of a row of more than AT_ONCE tokens are no array: they are grown over
    so many tokens at once, dealt over the tasks, a way to a row, and grown on. longest: of a row's tokens, if it is known.
    """
    kept = [c for c in rows.columns if c not in ("bridged", "ends")]
    size, free = F.char_length("tags"), F.lit(False) if gapped is None else gapped
    if longest is None:
        rows = written(rows)
        longest = rows.agg(F.max(size)).first()[0] or 0
    at_once = lambda df: df.select(*kept, F.explode(ways_from(F.col("tags"), F.col("bridged"), F.col("ends"), letters, free)).alias("way"))
    if longest <= AT_ONCE:
        return at_once(rows)
    found, going = at_once(rows.where(size <= AT_ONCE)), None
    long_ = written(rows.where(size > AT_ONCE))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, long_.rdd.getNumPartitions())
    for first in range(0, longest, AT_ONCE):
        own = long_.where(size > first).withColumn("begun", F.expr(f"cast(null as {WAY})"))
        from_ = (own if going is None else own.unionByName(going)).repartition(tasks)
        more = F.explode(grown(F.col("tags"), F.col("bridged"), F.col("ends"), letters, first, AT_ONCE, F.col("begun"), free)).alias("x")
        out = written(from_.select(*long_.columns, more))
        found = found.unionByName(out.where("x.done").select(*kept, F.col("x.way.w").alias("way")))
        going = out.where("x.on").select(*long_.columns, F.col("x.way").alias("begun"))
    return found


def chunks(way: Column) -> Column:
    """array<struct<s, e>>: the runs of neighbours of a way."""
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def step(out: Column, i: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.array_append(F.slice(out, 1, F.size(out) - 1), F.struct(last["s"].alias("s"), i.alias("e")))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["e"] == i - 1), grown).otherwise(F.array_append(out, F.struct(i.alias("s"), i.alias("e"))))

    return F.aggregate(way, none, step)


def bridges_itself(parts: Column, lemmas: Column, first: Column) -> Column:
    """Whether a gap between parts repeats all words of the part before or after it. lemmas: those from token `first` on."""
    words = lambda s, e: F.slice(lemmas, s - first + 1, F.greatest(F.lit(0), e - s + 1))

    def repeats(k: Column) -> Column:
        one, other = F.get(parts, k), F.get(parts, k + 1)
        gap = words(one["e"] + 1, other["s"] - 1)
        return (F.size(F.array_except(words(one["s"], one["e"]), gap)) == 0) | (F.size(F.array_except(words(other["s"], other["e"]), gap)) == 0)

    return F.exists(counted(F.lit(0), F.size(parts) - 2), repeats)


def discontinuous(found: DataFrame, pattern: str) -> DataFrame:
    """Candidates from found (doc_id, sent_id, at, term, tags, lemmas, first), one row a way: those with a gap whose tags match and that do not bridge their own words."""
    return legal(found, pattern).distinct()


def legal(found: DataFrame, pattern: str) -> DataFrame:
    """discontinuous where equal rows stay."""
    whole = named(chunks(F.col("at")), lambda parts: F.when(F.size(parts) > 1, ~bridges_itself(parts, F.col("lemmas"), F.col("first"))).otherwise(False))  # a filter is moved to where parts are no column
    kept = found.where(F.col("tags").rlike(pattern)).where(whole)
    return kept.select("doc_id", "sent_id", F.col("at").alias("positions"), "term", "tags")


#: Words of 64 bits in a sieve, at most: what is broadcast has this bound, however many keys there are.
SIEVE_WORDS = 1 << 18


def sieved(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns may be a row of keys, all that are and few others: what a join on them needs to shuffle.

    Keys set bits of a bitmap of SIEVE_WORDS rows at most, which is broadcast; as it fills up, more rows pass.
    """
    hashed = F.xxhash64(F.lit("sieve"), *columns)
    word, bit = F.pmod(hashed, F.lit(SIEVE_WORDS)), F.shiftright(hashed, 40).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = F.broadcast(keys.select(word.alias("__word"), one.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__bits")))
    return rows.join(bits, word == F.col("__word")).where(F.call_function("getbit", F.col("__bits"), bit) == 1).select(rows.columns)


def with_bridges(rows: DataFrame, pairs: Column, known: DataFrame, *kept: Column | str) -> DataFrame:
    """rows (lemmas, ...) with bridged: array<struct<i, j>> of the pairs (i, j) of token numbers whose lemmas are a known bridge; rows without one are left out.

    kept: what a row is then, lemmas among it; all columns by default. Equal rows become one. A row is listed with each
    of its pairs, so pairs go through a sieve before they are joined and grouped.
    """
    asked = rows.select(F.struct(*(kept or rows.columns)).alias("row"), F.explode(pairs).alias("p")).select("row", "p", F.get("row.lemmas", F.col("p.i")).alias("a"), F.get("row.lemmas", F.col("p.j")).alias("b"))
    held = sieved(asked, known, "a", "b").join(known.select("a", "b"), ["a", "b"], "left_semi")
    return held.groupBy("row").agg(F.collect_set("p").alias("bridged")).select("row.*", "bridged")


def along(way: Column, values: Column) -> Column:
    return F.transform(way, lambda i: F.get(values, i))


def hypernyms(candidates: DataFrame, annotated: DataFrame, known: DataFrame, tag_filter: str) -> DataFrame:
    """Discontinuous candidates within candidates of three tokens or more, of any length: tokens between two that are bridged drop out.

    candidates may be discontinuous themselves; only of these are the sentences looked up. known: the result of bridges
    over pairs_within, or over all of a model. Those within the runs of a filter are found faster by hypernyms_of_runs.
    """
    last, first = F.element_at("positions", -1), F.get("positions", F.lit(0))
    whole = last - first + 1 == F.size("positions")

    def asked(of: DataFrame) -> DataFrame:
        rows = of.where(F.size("term") >= 3).select("doc_id", "sent_id", first.alias("first"), F.col("term").alias("lemmas"), "positions", "tags")
        return from_first(with_bridges(rows, pairs_within(F.col("lemmas")), known))

    near = each_way(asked(candidates.where(whole)), None).withColumn("span", F.col("lemmas"))
    return left_out(near.unionByName(with_spans(each_way(asked(candidates.where(~whole)), None, gapped=F.lit(True)), annotated)), tag_filter).distinct()


def hypernyms_of_disc(disc: DataFrame, annotated: DataFrame, known: DataFrame, tag_filter: str) -> DataFrame:
    """hypernyms of candidates that all have a gap, each distinct by its place."""
    place = F.array_join(F.col("positions").cast("array<string>"), " ")
    rows = disc.where(F.size("term") >= 3).select("doc_id", "sent_id", place.alias("place"), "positions", F.col("term").alias("lemmas"), "tags")
    keys = ["doc_id", "sent_id", "place"]
    asked = rows.select(*keys, "lemmas", F.explode(pairs_within(F.col("lemmas"))).alias("p")).select(*keys, "p", F.get("lemmas", F.col("p.i")).alias("a"), F.get("lemmas", F.col("p.j")).alias("b"))
    held = sieved(asked, known, "a", "b").join(known.select("a", "b"), ["a", "b"], "left_semi").groupBy(*keys).agg(F.collect_set("p").alias("bridged"))
    found = rows.join(held, keys).withColumn("first", F.get("positions", F.lit(0))).drop("place")
    return left_out(with_spans(each_way(from_first(found), None, gapped=F.lit(True)), annotated), tag_filter).distinct()


def hypernyms_of_runs(annotated: DataFrame, known: DataFrame, tag_filter: str, max_n: int = 5) -> DataFrame:
    """hypernyms of contiguous(annotated, tag_filter, 3, max_n).

    A pair of a sentence's tokens is asked for once, however many runs hold it, and only its place is dealt with it. The
    places of a sentence's bridges and its tokens meet in one grouping, and its runs are found there. Documents are dealt by number, so
    equal results need no further shuffle to meet.
    """
    letters = "".join(sorted({x for x in FILTERS[tag_filter] if x.isalpha()}))
    own = F.xxhash64("lemmas", "tags").alias("own")  # tells sentences of one number apart
    rows = windows(annotated.select("doc_id", "sent_id", own, "lemmas", "tags"), max_n, "doc_id", "sent_id", "own", at="i")
    ahead = F.concat(*[F.coalesce(F.col(f"t{k}"), F.lit("")) for k in range(max_n)])
    pair = lambda k: F.when(ahead.rlike(f"^[{letters}]{{{k}}}[{letters}]*n"), F.struct((F.col("i") + k).alias("j"), F.col(f"w{k}").alias("b")))
    asked = rows.select("doc_id", "sent_id", "own", "i", F.col("w0").alias("a"), F.explode(F.array_compact(F.array(*[pair(k) for k in range(2, max_n)]))).alias("p")).select("doc_id", "sent_id", "own", "i", "p.j", "a", "p.b")
    keys = keyed_pairs(known, "a", "b")
    held = sieved(asked, keys, "a", "b").join(keys, ["a", "b"], "left_semi").select("doc_id", "sent_id", "own", F.struct("i", "j").alias("pair"), F.lit(None).cast("struct<lemmas:array<string>,tags:array<string>>").alias("s"))
    some = annotated.where(F.array_join("tags", "").rlike(f"[{letters}]{{2}}n"))
    texts = some.select("doc_id", "sent_id", own, F.lit(None).cast("struct<i:int,j:int>").alias("pair"), F.struct("lemmas", "tags").alias("s"))
    met = held.unionByName(texts).repartition("doc_id").groupBy("doc_id", "sent_id", "own").agg(F.collect_set("pair").alias("bridged"), F.first("s", ignorenulls=True).alias("s"))
    found = met.where(F.size("bridged") > 0).select("doc_id", "sent_id", "bridged", "s.lemmas", "s.tags")
    inside = lambda r: F.filter("bridged", lambda b: (b["i"] >= r["at"]) & (b["j"] < r["at"] + r["n"]))
    bridged = F.transform(runs(F.col("tags"), tag_filter, 3, max_n), lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"), inside(r).alias("b")))
    one = found.select("doc_id", "sent_id", "lemmas", F.array_join("tags", "").alias("all_tags"), F.explode(F.filter(bridged, lambda r: F.size(r["b"]) > 0)).alias("r"))
    at, n = F.col("r.at"), F.col("r.n")
    moved = F.transform("r.b", lambda b: F.struct((b["i"] - at).alias("i"), (b["j"] - at).alias("j")))
    placed = one.select("doc_id", "sent_id", at.alias("first"), F.slice("lemmas", at + 1, n).alias("lemmas"), F.sequence(at, at + n - 1).alias("positions"), F.substring("all_tags", at + 1, n).alias("tags"), moved.alias("bridged"))
    return left_out(each_way(from_first(placed), None, max_n).withColumn("span", F.col("lemmas")), tag_filter).distinct()


def from_first(rows: DataFrame) -> DataFrame:
    """rows (tags, ...) with the ends of ways from the first token to the last."""
    n = F.char_length("tags")
    return rows.withColumn("ends", F.transform(counted(F.lit(0), n - 1), lambda i: F.when(i == 0, F.array(n)).otherwise(F.expr("cast(array() as array<int>)"))))


def with_spans(rows: DataFrame, annotated: DataFrame) -> DataFrame:
    """rows (doc_id, sent_id, first, positions, ...) with span: the lemmas of their sentence from the first place to the last."""
    sentences = annotated.select("doc_id", "sent_id", F.col("lemmas").alias("sentence"))
    span = F.slice("sentence", F.col("first") + 1, F.element_at("positions", -1) - F.col("first") + 1)
    return rows.join(sentences, ["doc_id", "sent_id"]).withColumn("span", span).drop("sentence")


def left_out(rows: DataFrame, tag_filter: str) -> DataFrame:
    """Discontinuous candidates from rows (doc_id, sent_id, first, lemmas, positions, tags, way, span)."""
    placed = rows.select(
        "doc_id", "sent_id", "first", F.col("span").alias("lemmas"), along(F.col("way"), F.col("positions")).alias("at"), along(F.col("way"), F.col("lemmas")).alias("term"), F.array_join(F.transform("way", lambda i: letter(F.col("tags"), i)), "").alias("tags")
    )
    return legal(placed, f"^(?:{FILTERS[tag_filter]})")


def pairs_within(lemmas: Column) -> Column:
    """array<struct<i, j>> of all pairs at least two apart."""
    last = F.size(lemmas) - 1
    return F.flatten(
        F.transform(F.sequence(F.lit(0), last - 2), lambda i: F.transform(F.sequence(i + 2, last), lambda j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))))
    )


def neighbours(lemmas: Column) -> Column:
    """array<struct<i, j>> of all neighbours."""
    return F.transform(F.sequence(F.lit(0), F.size(lemmas) - 2), lambda i: F.struct(i.cast("int").alias("i"), (i + 1).cast("int").alias("j")))


#: Fixed value: a coordination's first member, its listed ones and its last.
GROUP = "(.)((?:,[^,]+)*),?c(.)"
#: GROUP, the same spans, without a loop that Java's matcher needs a stack for.
FLAT_GROUP = "(.)((?:,(?!,)(?:(?!,,).)*[^,])?),?c(.)"


def coordination_pairs(tags: Column, plural_first: Column) -> Column:
    """array<struct<i, j>>: pairs of tokens that a coordination may join: what stands before it with its later members, and its earlier members with what follows.

    A first member that plural_first (array<boolean>) marks joins nothing that follows.
    """
    size = F.char_length(tags)
    pairs = lambda a, b: F.flatten(F.transform(a, lambda i: F.transform(b, lambda j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))))

    def joins(g: Column) -> Column:
        first, last = g["start"], g["start"] + F.char_length(g["text"]) - 1
        comma = (F.char_length(g["text"]) > 3) & (letter(tags, last - 2) == ",")
        listed = F.filter(counted(first + 1, last - 2 - comma.cast("int")), lambda i: letter(tags, i) != ",")
        next_ = F.call_function("locate", F.lit("c"), tags, last + 2) - 1  # -1 if there is none
        after = F.when(next_ < 0, counted(last + 1, size - 1)).otherwise(F.array_append(counted(last + 1, next_ - 1), next_ + 1))
        back = F.call_function("locate", F.lit("c"), F.reverse(F.substring(tags, F.lit(1), first)))
        stop = first - back
        before = F.when(back == 0, counted(F.lit(0), first - 1)).otherwise(F.array_append(counted(stop + 1, first - 1), stop - 1))
        of_first = F.when(F.get(plural_first, first), F.expr("cast(array() as array<struct<i:int,j:int>>)")).otherwise(pairs(F.array(first), after))
        return F.concat(of_first, pairs(before, F.concat(F.array(last), listed)), pairs(listed, after))

    both = F.transform(F.flatten(F.transform(found_in(tags, FLAT_GROUP), joins)), lambda p: F.call_function("shiftleft", p["i"].cast("long"), F.lit(32)) + p["j"])  # numbers are told apart by hash
    return F.transform(F.array_sort(F.array_distinct(both)), lambda n: F.struct(F.shiftright(n, 32).cast("int").alias("i"), n.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("j")))


def coordination_pattern(letters: str) -> str:
    """Coordinations of runs of the letters. Written so that no run can be read in two ways, it takes linear time."""
    return f"(?:[{letters}]+(?:,[{letters}]+)*,?c[{letters}])+[{letters}]*"


def flat_pattern(letters: str) -> str:
    """coordination_pattern, the same spans: what is read is not given back, so that Java's matcher needs no stack for each member of a long list."""
    return f"(?:[{letters}]++(?:,[{letters}]++)*+,?c[{letters}])++[{letters}]*"


def coordinations(annotated: DataFrame, tag_filter: str, most_tokens: int | None = None, most_match: int | None = None) -> DataFrame:
    """(doc_id, sent_id, first, lemmas, tags, pairs) of each coordination; with bounds, of those of so many tokens in sentences of so many."""
    pattern = flat_pattern(COORDINATED[tag_filter][0])
    bound = lambda n, most: F.lit(True) if most is None else n <= most
    rows = annotated.where(bound(F.size("words"), most_tokens) & F.array_contains("tags", "c")).select("doc_id", "sent_id", "words", "lemmas", F.explode(found_in(F.array_join("tags", ""), pattern)).alias("m"))
    some = rows.where(bound(F.char_length("m.text"), most_match))
    own = lambda c: F.slice(c, F.col("m.start") + 1, F.char_length("m.text"))
    placed = some.select("doc_id", "sent_id", F.col("m.start").alias("first"), own("words").alias("words"), own("lemmas").alias("lemmas"), F.col("m.text").alias("tags"))
    plural = F.transform("words", lambda w, i: (w != F.get("lemmas", i)) & (letter(F.col("tags"), i) == "n"))
    return placed.select("doc_id", "sent_id", "first", "lemmas", "tags", coordination_pairs(F.col("tags"), plural).alias("pairs"))


def coordinated(found: DataFrame, known: DataFrame, tag_filter: str, longest: int | None = None) -> DataFrame:
    """Discontinuous candidates of coordinations: ways over the known bridges through every coordination of four tokens or more within.

    These share most of their ways, which are listed once for a row. longest: of the coordinations, if it is known.
    """
    letters, concept = COORDINATED[tag_filter]
    whole = f"^(?:{flat_pattern(letters)})$"
    marked = found.withColumn("pairs_of", F.md5(F.col("pairs").cast("string")))  # tells rows apart, and is shorter
    asked = with_bridges(marked, F.col("pairs"), known, "doc_id", "sent_id", "first", "lemmas", "tags", "pairs_of")
    tags, size = F.col("tags"), F.char_length("tags")
    within = lambda s: F.filter(counted(s + 4, size), lambda e: F.substring(tags, s + 1, e - s).rlike(whole))
    part = asked.withColumn("ends", F.transform(counted(F.lit(0), size - 1), within))
    one = each_way(part.drop("pairs_of"), letters, longest)
    placed = one.select(
        "doc_id", "sent_id", "first", "lemmas", F.transform("way", lambda i: i + F.col("first")).alias("at"), along(F.col("way"), F.col("lemmas")).alias("term"), F.array_join(F.transform("way", lambda i: letter(tags, i)), "").alias("tags")
    )
    return discontinuous(placed, f"^(?:{concept})$")


def pair_lemmas(rows: DataFrame, pairs: Column) -> DataFrame:
    """(a, b): the lemmas at the pairs of token numbers of rows (lemmas, ...)."""
    one = rows.select("lemmas", F.explode(pairs).alias("p"))
    return one.select(F.get("lemmas", F.col("p.i")).alias("a"), F.get("lemmas", F.col("p.j")).alias("b")).where("a is not null and b is not null").distinct()


def accepted(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """All instances of the types in terms (term)."""
    return candidates.join(terms.select("term").distinct(), "term", "left_semi")


def accepted_runs(annotated: DataFrame, tag_filter: str, terms: DataFrame, min_n: int = 1, max_n: int = 5) -> DataFrame:
    """accepted(contiguous(...), terms): a run is dealt as its place, length, tags and key, and has its arrays when it is accepted."""
    found = annotated.select("doc_id", "sent_id", keyed(F.col("lemmas")).alias("lemmas"), F.array_join("tags", "").alias("all_tags"), F.explode(runs(F.col("tags"), tag_filter, min_n, max_n)).alias("r"))
    at, n = F.col("r.at"), F.col("r.n")
    placed = found.select("doc_id", "sent_id", at.alias("at"), n.alias("n"), key_of(F.slice("lemmas", at + 1, n)).alias("key"), F.substring("all_tags", at + 1, n).alias("tags"))
    held = placed.join(terms.select(key_of(keyed(F.col("term"))).alias("key")).distinct(), "key", "left_semi")
    return held.select("doc_id", "sent_id", F.sequence(F.col("at"), F.col("at") + F.col("n") - 1).alias("positions"), tokens_of(F.col("key")).alias("term"), "tags")


def update(candidates: DataFrame, other: DataFrame, only_existing: bool = False) -> DataFrame:
    """candidates with those of other, of known types only if only_existing."""
    more = accepted(other, candidates) if only_existing else other
    return candidates.unionByName(more).distinct()
