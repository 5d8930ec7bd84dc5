"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are its words and runs of signs, and pairs of neighbours
(a pair of equal words being the same feature for all words), hashed into a fixed number of dimensions; a
value is the logarithm of 1 plus the count, scaled to unit length. Labelled rows are dealt into FOLDS; a model is trained
on each choice of all folds but one, in a fixed order, and scores the fold it has not seen. The weights are averaged, and a
logistic curve fitted to the scores of unseen rows (Platt's method) makes probabilities of them, so that a fixed threshold
means the same however many labels there are. The model depends on the rows and not on how they lie in partitions. It has
a fixed size and travels to the executors, where each text is scored as a sparse dot product.

Training takes TRAIN_ROWS labelled rows at most, chosen by a hash of the id. Texts become vectors where they are read, and
only vectors, of at most DIMENSIONS entries each, meet in the task that trains a fold.

Defined results: null and empty texts have no features and score by the intercept; a null doc_id is not held out, and held_out is
false; a document labelled more than once
counts as good if any label says so; without labelled rows every score is 0.5; repeated rows score alike; an empty table
gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

DIMENSIONS = 1 << 18
FOLDS = 4
TRAIN_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.001, 0.001
#: A text is taken as good from this score on.
GOOD = 0.3
#: Words that a task remembers the hashes of.
REMEMBERED = 100_000
UNIT = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Hashes of words, each taken once."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def features(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text, by index."""
    units = UNIT.findall(text or "")
    h = np.fromiter(map(hashes.__getitem__, units), np.uint64, len(units))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(31)))
    pairs = (pairs ^ (pairs >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    pairs[h[:-1] == h[1:]] = 0  # a word twice in a row is one feature, whatever the word
    index, counts = np.unique(np.concatenate((h, pairs >> np.uint64(20))) & np.uint64(DIMENSIONS - 1), return_counts=True)
    values = np.log1p(counts)
    return index.astype(np.int64), values / max(1e-12, np.sqrt((values * values).sum()))


def leader_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that follow the regularised leader, from the sums z and n."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def vector(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text, with the intercept's last."""
    own, weights = features(text, hashes)
    return np.append(own, DIMENSIONS).astype(np.int32), np.append(weights, 1.0).astype(np.float16)


def vectors(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes = Hashes()
    return [vector(text, hashes) for text in texts]


def encoded(rows: DataFrame) -> DataFrame:
    """(turn, doc_id, label, index, values) of labelled rows (turn, doc_id, label, text): vectors instead of texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches, "text"):
            made = [vector(text, hashes) for text in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in ("turn", "doc_id", "label")), *(pa.array([v[k].tobytes() for v in made], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["turn", "doc_id", "label", "index", "values"])

    return rows.select(F.col("turn"), F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(run, "turn long, doc_id long, label int, index binary, values binary")


def leader(rows: list[tuple[np.ndarray, np.ndarray]], labels) -> np.ndarray:
    """The weights after EPOCHS passes over rows in their order; the intercept comes last."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for _ in range(EPOCHS):
        for (index, values), label in zip(rows, labels, strict=True):
            values = values.astype(float)
            own_z, own_n = z[index], n[index]
            w = leader_weights(own_z, own_n)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            gradient = (p - label) * values
            grown = own_n + gradient * gradient
            z[index] = own_z + gradient - (np.sqrt(grown) - np.sqrt(own_n)) / ALPHA * w
            n[index] = grown
    return leader_weights(z, n)


def train_fold(rows: pa.Table) -> pa.Table:
    """Of labelled vectors (turn, doc_id, label, index, values, own): the weights of those that are not the fold's own, and the margins and labels of those that are.

    Vectors are read where they lie in the table; nothing of them is copied.
    """
    order = pc.sort_indices(rows.select(["turn", "doc_id"]), [("turn", "ascending"), ("doc_id", "ascending")]).to_pylist()
    index, values = rows.column("index"), rows.column("values")
    held = [(np.frombuffer(index[i].as_buffer(), np.int32), np.frombuffer(values[i].as_buffer(), np.float16)) for i in order]
    labels, own = rows.column("label").to_numpy().astype(float)[order], rows.column("own").to_numpy()[order]
    weights = leader([r for r, o in zip(held, own, strict=True) if not o], labels[~own])
    margins = [float(weights[i] @ v) for (i, v), o in zip(held, own, strict=True) if o]
    kinds = {"weights": pa.binary(), "margins": pa.list_(pa.float64()), "labels": pa.list_(pa.float64())}
    return pa.table({c: pa.array([v], kinds[c]) for c, v in (("weights", weights.astype(np.float32).tobytes()), ("margins", margins), ("labels", labels[own].tolist()))})


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that fits labels to margins, by Newton steps that never raise the loss."""
    good = labels.sum()
    bad = len(labels) - good
    aim = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))  # keeps the slope finite where classes part
    x = np.stack((margins, np.ones(len(margins))))
    loss = lambda c: (np.logaddexp(0, c @ x) - aim * (c @ x)).sum()
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -35, 35)))
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - aim))
        while np.abs(move).max() > 1e-9 and loss(at - move) > loss(at):
            move = move / 2
        at = at - move
        if np.abs(move).max() <= 1e-9:
            break
    return float(at[0]), float(at[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The calibrated weights of a model trained on rows of docs (doc_id, text) and labels (doc_id, label)."""
    labelled = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    turn = F.xxhash64(F.lit("turn"), "doc_id")
    share = min(1.0, max_rows / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit("chosen"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # chosen has about max_rows rows at most, whatever the corpus, so it goes to the texts and not they to it
    rows = encoded(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("turn", turn))
    every = rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).withColumn("own", F.pmod("turn", F.lit(FOLDS)) == F.col("fold"))
    found = every.groupBy("fold").applyInArrow(train_fold, "weights binary, margins array<double>, labels array<double>").collect()
    if not found:
        return np.zeros(DIMENSIONS + 1, np.float32)
    weights = sum(np.frombuffer(r["weights"], np.float32) for r in found) / np.float32(len(found))
    slope, intercept = platt(*(np.concatenate([np.array(r[c], float) for r in found]) for c in ("margins", "labels")))
    weights = weights * np.float32(slope)
    weights[-1] += np.float32(intercept)
    return weights


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs with a column of scores: 0 to 1, higher where the label 1 is likelier."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = Hashes(), held.value.astype(float)
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                index, values = features(text, hashes)
                found.append(1 / (1 + np.exp(-np.clip(w[index] @ values + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name)
    return docs.drop(name).mapInArrow(run, f"{kept}, `{name}` double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id's text leaves no remainder by 5; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return train(docs, labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
