"""Text, part-of-speech and array functions as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?\n]+"
TOKEN = r"[\p{L}\p{N}]+|,"

#: Part-of-speech tags and the one letter each stands for in tag sequences.
TAG_LETTERS = {
    "NN": "n", "NNS": "n", "NNP": "n", "NNPS": "n",
    "JJ": "a", "JJR": "a", "JJS": "a",
    "VB": "v", "VBD": "v", "VBG": "v", "VBN": "v", "VBP": "v", "VBZ": "v",
    "RB": "r", "RBS": "r", "RBR": "r",
    "CD": "d", "CC": "c", "POS": "s", "IN": "p", "DT": "t", "HYPH": "-",
    ",": ",", ".": ".", "*": "f", "AFX": "f", "-NONE-": "Ø", "": "Ø",
}

#: Rules of the built-in tagger, the first that matches a lower-case token decides; a noun otherwise.
TAG_RULES = (
    ("c", "^(and|or|but|nor)$"),
    ("t", "^(the|a|an|this|that)$"),
    ("p", "^(of|in|to|for|with|by|on|at|from)$"),
    (",", "^,$"),
    ("d", r"^\p{N}+$"),
    ("r", "ly$"),
    ("v", "(ing|ed)$"),
    ("a", "(al|ic|ive|ous|able|ble|ful|ea)$"),
    (".", r"^[^\p{L}]"),
)


def tag_letter(tag: Column) -> Column:
    """The letter of a tag; of an unknown tag its first character."""
    known = F.create_map(*[F.lit(x) for pair in TAG_LETTERS.items() for x in pair])
    return F.coalesce(F.element_at(known, tag), F.substring(tag, 1, 1))


def rule_tag(token: Column) -> Column:
    """The letter that the built-in rules give a lower-case token of TOKEN.

    Words and endings are compared as strings; rules on first characters are tried last, since no other rule meets them, and
    only where a token does not begin with a letter from a to z.
    """
    out = None
    for letter, pattern in TAG_RULES:
        words, ending = re.fullmatch(r"\^\(?([a-z|,]+?)\)?\$", pattern), re.fullmatch(r"\(?([a-z|]+?)\)?\$", pattern)
        if words:
            held = token.isin(words[1].split("|"))
        elif ending:
            held = reduce(Column.__or__, [F.endswith(token, F.lit(e)) for e in ending[1].split("|")])
        else:
            continue
        out = F.when(held, letter) if out is None else out.when(held, letter)
    out = out.when((token >= "a") & (token < "{"), "n")
    for letter, pattern in TAG_RULES:
        if "\\p" in pattern:
            out = out.when(token.rlike(pattern), letter)
    return out.otherwise("n")


def rule_lemma(token: Column) -> Column:
    """A lower-case token without its plural ending."""
    return (
        F.when(~F.endswith(token, F.lit("s")), token)
        .when(token.rlike("[^aeiou]ies$") & (F.char_length(token) > 4), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("(s|x|z|ch|sh)es$") & (F.char_length(token) > 4), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("[^siu]s$") & (F.char_length(token) > 3), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def ngrams_of(tokens: Column, least: int = 1, most: int = 5) -> Column:
    """All contiguous runs of least to most elements of an array, as array<array>, by length and then place."""
    size = F.size(tokens)

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1)))
        return F.filter(F.transform(starts, lambda i: F.slice(tokens, i, n)), lambda run: F.size(run) == n)

    return F.flatten(F.array(*[of_length(n) for n in range(least, most + 1)]))


#: Between the tokens of a key, and before what stands for one of the two signs or for null.
BETWEEN, ESCAPE = "\x1f", "\x1e"


def keyed(tokens: Column) -> Column:
    """An array of tokens, in which key_of may be taken of any run: both signs are replaced where they occur at all."""
    replaced = F.transform(tokens, lambda t: F.replace(F.replace(t, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(BETWEEN), F.lit(ESCAPE + "1")))
    return F.when(F.array_join(tokens, "").rlike(f"[{ESCAPE}{BETWEEN}]"), replaced).otherwise(tokens)


def key_of(tokens: Column) -> Column:
    """A run of keyed tokens as one string, which is shorter than the array and compared faster; tokens_of gives the tokens back."""
    return F.array_join(tokens, BETWEEN, ESCAPE + "2")


def tokens_of(key: Column) -> Column:
    """The tokens of a key, of any signs, nulls included."""
    parts = F.split(key, BETWEEN, -1)
    plain = lambda t: F.replace(F.replace(t, F.lit(ESCAPE + "1"), F.lit(BETWEEN)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))
    return F.when(F.contains(key, F.lit(ESCAPE)), F.transform(parts, lambda t: F.when(t != ESCAPE + "2", plain(t)))).otherwise(parts)


def ngram_keys(tokens: Column, least: int = 1, most: int = 5) -> Column:
    """The keys of all contiguous runs of least to most elements of an array, as ngrams_of gives the runs."""

    def keys(own: Column) -> Column:
        runs = lambda n: F.transform(counted(F.lit(1), F.size(own) - (n - 1)), lambda i: key_of(F.slice(own, i, n)))
        one = F.transform(own, lambda t: F.coalesce(t, F.lit(ESCAPE + "2")))
        return F.concat(*[one if n == 1 else runs(n) for n in range(least, most + 1)])

    return named(keyed(tokens), keys)


def window_tokens(tokens: Column) -> Column:
    """An array of tokens as they stand in keys, nulls too."""
    return F.transform(keyed(tokens), lambda t: F.coalesce(t, F.lit(ESCAPE + "2")))


def window_rows(tokens: Column, tags: Column, most: int, at: str | None = None) -> Column:
    """A generator of a row for each token: w0, w1, ... are it and the next ones, most in all, and t0, t1, ... their tags; null behind the end. at: a column of its place.

    Both are named many times, so they are to be columns. tokens: window_tokens.
    """
    shifted = lambda c, name: [F.slice(c, i + 1, F.size(c)).alias(f"{name}{i}") if i else c.alias(f"{name}0") for i in range(most)]
    place = [] if at is None else [counted(F.lit(0), F.size(tokens) - 1).alias(at)]
    return F.inline(F.arrays_zip(*shifted(tokens, "w"), *shifted(tags, "t"), *place))


def window_keys(most: int) -> list[Column]:
    """The keys of the runs of 1, 2, ..., most tokens that begin with a row's token; null behind the end."""
    words = [F.col(f"w{i}") for i in range(most)]
    return [F.concat(words[0], *[x for w in words[1:n] for x in (F.lit(BETWEEN), w)]) for n in range(1, most + 1)]


def counted(first: Column, last: Column) -> Column:
    """The whole numbers from first to last; none if last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))


def subsequences_of(tokens: Column, length: int) -> Column:
    """All order-keeping choices of `length` elements of an array, contiguous ones included, in the order of their places."""
    last = F.size(tokens) - 1
    places = F.transform(counted(F.lit(0), last), lambda i: F.array(i))
    for _ in range(length - 1):
        places = F.flatten(F.transform(places, lambda p: F.transform(counted(F.element_at(p, -1) + 1, last), lambda j: F.array_append(p, j))))
    return F.transform(places, lambda p: F.transform(p, lambda i: F.get(tokens, i)))


#: Longest array whose choices are listed: there are two to the power of its length.
MOST_CHOSEN = 16


def parts_of(tokens: Column, least: int = 1, choices: bool = False) -> Column:
    """The distinct proper runs of an array of any length, of `least` elements or more; with choices, all order-keeping choices.

    Choices of arrays of more than MOST_CHOSEN elements are an error.
    """
    size = F.size(tokens)
    if not choices:
        runs = lambda n: F.transform(counted(F.lit(1), size - n + 1), lambda i: F.slice(tokens, i, n))
        return F.array_distinct(F.flatten(F.transform(counted(F.lit(least), size - 1), runs)))
    bit = lambda mask, i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0
    masks = counted(F.lit(1), F.call_function("shiftleft", F.lit(1), size) - 2)
    some = F.filter(masks, lambda m: F.bit_count(m) >= least)
    found = F.array_distinct(F.transform(some, lambda m: F.filter(tokens, lambda _, i: bit(m, i))))
    return F.when(size <= MOST_CHOSEN, found).otherwise(F.raise_error(F.lit(f"choices of more than {MOST_CHOSEN} elements")))


def parts_of_length(tokens: Column, length: int, choices: bool = False) -> Column:
    """The keys of the distinct runs of `length` elements of a longer array of keyed tokens; with choices, of all order-keeping choices.

    Choices of arrays of more than MOST_CHOSEN elements are an error.
    """
    size = F.size(tokens)
    if not choices:
        return F.array_distinct(F.transform(counted(F.lit(1), size - length + 1), lambda i: F.array_join(F.slice(tokens, i, length), BETWEEN)))
    bit = lambda mask, i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0
    masks = F.filter(counted(F.lit(1), F.call_function("shiftleft", F.lit(1), size) - 2), lambda m: F.bit_count(m) == length)
    found = F.array_distinct(F.transform(masks, lambda m: F.array_join(F.filter(tokens, lambda _, i: bit(m, i)), BETWEEN)))
    return F.when(size <= MOST_CHOSEN, found).otherwise(F.raise_error(F.lit(f"choices of more than {MOST_CHOSEN} elements")))


def found_in(text: Column, pattern: str) -> Column:
    """array<struct<start, text>>: the matches of a pattern, none of which is empty, with their places in code points from 0."""
    none = F.expr("cast(array() as array<struct<start:int,text:string>>)")

    def placed(p: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            start, hit = s["at"] + F.char_length(F.get(p["gaps"], k)), F.get(p["hits"], k)
            return F.struct((start + F.char_length(hit)).alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), hit.alias("text"))).alias("out"))

        return F.aggregate(counted(F.lit(0), F.size(p["hits"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    return named(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)


def tag_sequence(tags: Column) -> Column:
    return F.array_join(tags, "")


def merged_spans(spans: Column, gap: int = 2) -> Column:
    """An ordered array<struct<start,end>> with spans joined whose distance is below gap."""
    first = F.slice(spans, 1, 1)

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when(s["start"] - last["end"] < gap, joined).otherwise(F.array_append(out, s))

    return F.when(F.size(spans) > 1, F.aggregate(F.slice(spans, 2, F.greatest(F.lit(1), F.size(spans) - 1)), first, step)).otherwise(spans)


def covered_text(text: Column, spans: Column) -> Column:
    """The pieces of text under spans [start, end) in code points, joined by blanks."""
    return F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), " ")


def in_context(text: Column, start: Column, end: Column, width: int = 20) -> Column:
    """The span [start, end) in double brackets with `width` code points on either side, on one line."""
    before = F.substring(text, F.greatest(F.lit(0), start - width) + 1, start - F.greatest(F.lit(0), start - width))
    parts = F.concat(before, F.lit("[["), F.substring(text, start + 1, end - start), F.lit("]]"), F.substring(text, end + 1, F.lit(width)))
    return F.replace(parts, F.lit("\n"), F.lit(" "))


def meets_span(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Whether an annotation starts within [from, to) or ends within (from, to]; one that encloses the span does not meet it."""
    return ((start >= from_) & (start < to)) | ((end > from_) & (end <= to))


#: Running sums are taken in blocks of so many numbers, so that no long array is copied for each of its elements.
TOGETHER = 64


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """For each element of an array of numbers, which is not empty, the sum of those before it. The array is made once, not once for each block."""
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")

    def one(s: Column, n: Column) -> Column:
        return state(s["at"] + n, F.array_append(s["out"], s["at"]))

    def sums(own: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(own, k * TOGETHER + 1, TOGETHER), state(s["at"], none("int")), one)
            return named(part, lambda o: state(o["at"], F.array_append(s["out"], o["out"])))

        blocks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / TOGETHER).cast("int"))
        return F.flatten(F.aggregate(blocks, state(F.lit(0), none("array<int>")), block, lambda s: s["out"]))

    return named(numbers, sums)


def placed_tokens(text: Column) -> Column:
    """array<struct<start, word>> of a text's tokens and what lies between them, in code points from 0."""
    pieces = F.regexp_extract_all(text, F.lit(TOKEN + r"|[^\p{L}\p{N},]+"), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,word:string>>)")
    placed = named(pieces, lambda p: F.when(F.size(p) > 0, F.arrays_zip(running_sums(F.transform(p, F.char_length)).alias("start"), p.alias("word"))).otherwise(none))
    return placed
