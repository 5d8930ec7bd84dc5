"""Language identification by unigrams of pieces, with all segmentations of a word summed.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all ways to
cut it into pieces of the product of their probabilities, which a forward pass over its characters gives; no segmentation
is chosen. A text's is the product over its words, its runs of letters in lower case, each after a word-start mark. The
language with the largest posterior is predicted, with the posterior as score.

Piece probabilities are learnt by expectation maximisation: forward and backward passes give the expected count of each piece
in the words of a language. Words of a bounded sample of labelled rows, LANGUAGE_ROWS of each language at most by a hash of the
id, are counted in Spark; a round is one pass over these counts, summed by language and piece. What the driver holds and
broadcasts is a model of languages times vocabulary numbers, of which there may be MOST_CELLS (an error beyond, so the bound
is checked). Priors are the languages' shares of all labelled rows.

Words of a batch are passed forward together, one character at a time, for all languages at once; longer words than LONG go by
themselves. Each task remembers the words that it has seen, up to a bound.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learnt;
characters outside the vocabulary count alike for all languages; ties go to the first language by code point; a null
doc_id is not held out, and held_out is false; repeated rows score alike; an empty table gives an empty result; extra
columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

#: Labelled rows of each language that the model learns from, at most.
LANGUAGE_ROWS = 2_000
ROUNDS = 4
#: Occurrences that smoothing adds to a language, spread evenly over the vocabulary.
SMOOTHING = 10.0
#: Probability of a character that the vocabulary lacks, and the least of any piece.
UNKNOWN = 1e-7
#: Numbers in a model, at most.
MOST_CELLS = 1 << 26
#: Words of up to so many characters are passed forward together.
LONG = 48
#: What a probability is multiplied by for each character, so that products stay within range.
PER_CHARACTER = 1e3
#: Words times languages that are passed forward at once.
TOGETHER = 8192
#: Words with their counts in a task of training, about.
TASK_WORDS = 20_000
#: Words that a task remembers.
REMEMBERED = 200_000
START = "▁"
UNDETERMINED = "und"
BETWEEN = r"[^\pL\pM]+"


def public_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces that a lower-case word can hold, in order, from a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    inner = lambda p: p.removeprefix(START)
    return sorted({p for p in known if inner(p) == inner(p).lower() and START not in inner(p) and (not inner(p) or all(c.isalpha() or not c.isascii() for c in inner(p)))})


class Vocabulary:
    """Pieces by number, found by hash for many strings at once."""

    BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str]):
        self.pieces, self.number = pieces, {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.powers = self.BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        whole = 1 << 64
        sums = [sum(ord(c) * pow(int(self.BASE), len(p) - 1 - i, whole) for i, c in enumerate(p)) for p in pieces]
        keys = np.array([(h + len(p)) * int(self.SPREAD) % whole for h, p in zip(sums, pieces, strict=True)], np.uint64)
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64(0))
        if (self.keys[1:-1] == self.keys[:-2]).any():
            raise ValueError("two pieces have one hash")
        self.first = np.searchsorted(self.keys[:-1] >> np.uint64(48), np.arange((1 << 16) + 1)).astype(np.int32)

    def key(self, hashes: np.ndarray, size: int) -> np.ndarray:
        return (hashes + np.uint64(size)) * self.SPREAD

    def find(self, hashes: np.ndarray, size: int, none: int) -> np.ndarray:
        """The number of the piece of each string of a size, from the sum of its codes times powers of BASE, or none."""
        keys = self.key(hashes, size).ravel()
        bucket = keys >> np.uint64(48)
        at, stop = self.first[bucket], self.first[bucket + np.uint64(1)]
        out = np.full(len(keys), none, np.int32)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.order[at[open_[hit]]]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < stop[open_])]
        return out.reshape(hashes.shape)


class Lattice:
    """All pieces of a list of words: at each end and length the piece's number, UNKNOWN's for a lone character outside the vocabulary, or none."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        marked = [START + w for w in words]
        self.lengths = np.array([len(w) for w in marked])
        most = int(self.lengths.max(initial=1))
        self.none, unknown = len(vocabulary.pieces) + 1, len(vocabulary.pieces)
        self.longest = min(vocabulary.longest, most)
        codes = np.frombuffer("".join(w.ljust(most, "\0") for w in marked).encode("utf-32-le"), np.uint32).reshape(-1, most).T.astype(np.uint64)
        # by end, length and word, so that a step of the passes reads one block
        self.ids = np.full((most + 1, self.longest + 1, len(words)), self.none, np.int32)
        hashes = np.zeros((most + 1, len(words)), np.uint64)
        for size in range(1, self.longest + 1):
            hashes[size:] += codes[: most - size + 1] * vocabulary.powers[size - 1]
            self.ids[size:, size] = vocabulary.find(hashes[size:], size, self.none)
        lone = self.ids[1:, 1]
        lone[(lone == self.none) & (np.arange(1, most + 1)[:, None] <= self.lengths[None])] = unknown

    def forward(self, rates: np.ndarray) -> np.ndarray:
        """(end, word, language): probability of each word's beginning up to an end, scaled by PER_CHARACTER for each character. rates: by piece (unknown, none) and language."""
        out = np.zeros((len(self.ids), self.ids.shape[2], rates.shape[1]))
        out[0] = 1
        for end in range(1, len(out)):
            for size in range(1, min(self.longest, end) + 1):
                piece = self.ids[end, size]
                if (piece != self.none).any():
                    out[end] += out[end - size] * rates[piece] * PER_CHARACTER**size
        return out

    def backward(self, rates: np.ndarray) -> np.ndarray:
        """(start, word, language): probability of what follows each start, scaled likewise."""
        out = np.zeros((len(self.ids), self.ids.shape[2], rates.shape[1]))
        out[self.lengths, np.arange(self.ids.shape[2])] = 1
        for end in range(len(out) - 1, 0, -1):
            for size in range(1, min(self.longest, end) + 1):
                piece = self.ids[end, size]
                if (piece != self.none).any():
                    out[end - size] += out[end] * rates[piece] * PER_CHARACTER**size
        return out

    def log_likelihoods(self, rates: np.ndarray) -> np.ndarray:
        """(word, language)."""
        whole = self.forward(rates)[self.lengths, np.arange(self.ids.shape[2])]
        return np.log(whole) - self.lengths[:, None] * np.log(PER_CHARACTER)


def long_word(word: str, vocabulary: Vocabulary, rates: np.ndarray) -> np.ndarray:
    """Log likelihoods of one word of any length: the last `longest` sums are kept, and scaled back at each character."""
    marked, unknown, logs = START + word, len(vocabulary.pieces), np.zeros(rates.shape[1])
    longest = vocabulary.longest
    kept = [np.ones(rates.shape[1])]
    for end in range(1, len(marked) + 1):
        now = np.zeros(rates.shape[1])
        for size in range(1, min(longest, len(kept)) + 1):
            piece = vocabulary.number.get(marked[end - size : end], unknown if size == 1 else None)
            if piece is not None:
                now = now + kept[-size] * rates[piece]
        logs = logs + np.log(now)
        kept = [k / now for k in kept[-(longest - 1) :]] if longest > 1 else []
        kept.append(np.ones(rates.shape[1]))
    return logs


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of texts without nulls: runs of letters and marks in lower case; empty ones at the ends."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), BETWEEN)


def padded(rates: np.ndarray) -> np.ndarray:
    """rates by piece and language with two rows more: of an unknown character, and of no piece."""
    return np.vstack((rates, np.full((1, rates.shape[1]), UNKNOWN), np.zeros((1, rates.shape[1]))))


class Scorer:
    """Log likelihoods of texts in every language."""

    def __init__(self, pieces: list[str], rates: np.ndarray):
        self.vocabulary, self.rates = Vocabulary(pieces), padded(rates)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.logs = np.zeros((1, self.rates.shape[1]))

    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) < LONG]
        short.sort(key=len)  # words of like length pass together
        rows = [self.logs]
        together = max(64, TOGETHER // self.rates.shape[1])
        for at in range(0, len(short), together):
            rows.append(Lattice(short[at : at + together], self.vocabulary).log_likelihoods(self.rates))
        long_ = [w for w in words if len(w) >= LONG]
        rows += [long_word(w, self.vocabulary, self.rates)[None] for w in long_]
        self.known.update(zip([*short, *long_], range(len(self.logs), len(self.logs) + len(words)), strict=True))
        self.logs = np.concatenate(rows)

    def score(self, texts: pa.Array) -> np.ndarray:
        """(text, language), of texts without nulls."""
        split = words_of(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        number = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        sums = np.concatenate((np.zeros((1, self.logs.shape[1])), np.cumsum(self.logs[number], axis=0))) if len(number) else np.zeros((1, self.logs.shape[1]))
        return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            split = words_of(batch.column("text"))
            langs = batch.column("lang").take(pc.list_parent_indices(split))
            counted = pa.table({"lang": langs, "word": split.flatten()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counted.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return found.where("word != ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(words: DataFrame, pieces: list[str], langs: list[str], rates: np.ndarray) -> DataFrame:
    """(lang, piece, n): how often a piece is expected in the words (lang, word, n) of each language, under rates (piece, language). lang and piece are numbers."""
    held = words.sparkSession.sparkContext.broadcast((pieces, rates))
    place = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, rates = held.value
        vocabulary, rates = Vocabulary(pieces), padded(rates)
        sums = np.zeros((len(pieces) + 2, rates.shape[1]))
        for batch in batches:
            own = np.array([place[v] for v in batch.column("lang").to_pylist()], np.int64)
            n, found = batch.column("n").to_numpy(), batch.column("word").to_pylist()
            order = sorted((i for i, w in enumerate(found) if len(w) < LONG), key=lambda i: (own[i], len(found[i])))
            cuts = [0, *(k for k in range(1, len(order)) if own[order[k]] != own[order[k - 1]]), len(order)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(start, stop, TOGETHER):
                    part = order[at : min(stop, at + TOGETHER)]
                    lang = own[part[0]]
                    lattice, rate = Lattice([found[i] for i in part], vocabulary), rates[:, lang : lang + 1]
                    ahead, after = lattice.forward(rate)[:, :, 0], lattice.backward(rate)[:, :, 0]
                    share = n[part] / ahead[lattice.lengths, np.arange(len(part))]
                    for end in range(1, len(ahead)):
                        for size in range(1, min(lattice.longest, end) + 1):
                            piece = lattice.ids[end, size]
                            if (piece != lattice.none).any():
                                sums[:, lang] += np.bincount(piece, share * ahead[end - size] * after[end] * rate[piece, 0] * PER_CHARACTER**size, len(sums))
        piece, lang = np.nonzero(sums[: len(pieces)])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(piece, pa.int64()), pa.array(sums[piece, lang])], ["lang", "piece", "n"])

    return words.mapInArrow(run, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Languages in code-point order, their log priors, the pieces and their probabilities by piece and language."""

    def __init__(self, langs: list[str], priors: np.ndarray, pieces: list[str], rates: np.ndarray):
        self.langs, self.priors, self.pieces, self.rates = langs, priors, pieces, rates


def train(rows: DataFrame, pieces: list[str], max_rows: int = LANGUAGE_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of the languages of rows (doc_id, text, lang); rows without a language or a text are left aside."""
    usable = rows.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS // max(1, len(pieces)) + 1).collect()  # a row for each language
    if len(counted) * len(pieces) > MOST_CELLS:
        raise ValueError(f"a model of more than {MOST_CELLS} numbers")
    counted.sort(key=lambda r: r.lang)
    langs = [r.lang for r in counted]
    if not langs:
        return Model([], np.zeros(0), pieces, np.zeros((len(pieces), 0)))
    shares = rows.sparkSession.createDataFrame([(r.lang, min(1.0, max_rows / r.n)) for r in counted], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    words = cut(word_counts(usable.join(F.broadcast(shares), "lang").where(drawn)))
    words = cut(words.repartition(-(-words.count() // TASK_WORDS) or 1))
    rates = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    for _ in range(rounds):
        sums = np.full(rates.shape, SMOOTHING / max(1, len(pieces)))
        for lang, piece, n in expected_counts(words, pieces, langs, rates).toLocalIterator():
            sums[piece, lang] += n
        rates = np.maximum(sums / sums.sum(axis=0), UNKNOWN)
    n = np.array([r.n for r in counted], float)
    return Model(langs, np.log(n / n.sum()), pieces, rates)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.priors, model.pieces, model.rates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, priors, pieces, rates = held.value
        scorer = Scorer(pieces, rates)
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            best, chance = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            if langs:
                logs = scorer.score(texts) + priors
                best = logs.argmax(axis=1)
                chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                lettered = np.zeros(len(batch), bool)
            found = [langs[b] if known else UNDETERMINED for b, known in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(np.where(lettered, chance, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id's text leaves no remainder by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_language(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: the path of the public piece model, read on the driver alone."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), public_pieces(vocabulary))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
