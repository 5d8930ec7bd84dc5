"""Best-fit packing of tokenized documents into sequences, under several capacities at once.

A piece asks for tokens, for a place among a sequence's documents and for attention cost (the square of its length). In
falling order of length a piece goes to the open sequence that can take it under every capacity and scores best: the
least weighted norm of what would be left ("norm"), or the largest weighted dot product of demand and residual ("dot").
Pieces that fill a sequence need no search. The others are dealt at random into blocks of bounded size, packed side by
side; sequences that stay less than half full in every capacity are opened again and packed with those of other blocks,
level by level, so blocks cost next to nothing against one search over all.

Defined results: a null or empty text is a document of one id, the end; repeated rows are packed one by one; ties go by
doc_id and piece; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table
from .tokens import TextTokens

LENGTH = 2048
#: The id that ends a document.
END = 0
#: Most documents in a sequence, and most attention cost; at these values only the tokens bind.
MOST_DOCUMENTS, MOST_COST = LENGTH, LENGTH * LENGTH
WEIGHTS = (1.0, 0.1, 0.1)
#: Pieces in a block, about.
BLOCK = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, level int, reopen boolean"


def cut_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and END, cut only where longer than a sequence."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TextTokens(vocabulary)
        for batch in slices(batches, "text"):
            found: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                found += [(doc_id, k, at, min(length, len(ids) - at), zlib.crc32(ids[at : at + length])) for k, at in enumerate(range(0, len(ids), length))]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


def best_fit(demands: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each row of demands (in the order given), and what each sequence has left."""
    n = len(demands)
    placed = np.zeros(n, np.int64)
    left = np.zeros((n, len(capacities)))  # by sequence
    open_, names, m = np.zeros((len(capacities), n)), np.zeros(n, np.int64), 0  # what open sequences have left
    least = np.minimum.accumulate(demands[::-1], axis=0)[::-1]  # the least that later pieces ask for
    scale, made = (weights / capacities**2)[:, None], 0
    for i in range(n):
        need = demands[i][:, None]
        after = open_[:, :m] - need
        fits = (after >= 0).all(axis=0)
        if fits.any():
            score = (scale * after * after).sum(axis=0) if rule == "norm" else -(scale * need * open_[:, :m]).sum(axis=0)
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            at, names[m] = m, made
            after = np.concatenate((after, capacities[:, None] - need), axis=1)
            m, made = m + 1, made + 1
        open_[:, at] = after[:, at]
        placed[i] = names[at]
        left[names[at]] = open_[:, at]
        if i + 1 < n and (open_[:, at] < least[i + 1]).any():  # nothing to come fits: the last open one takes its place
            m -= 1
            open_[:, at], names[at] = open_[:, m], names[m]
    return placed, left[:made]


def packing(level: int, rule: str, capacities: tuple[int, ...], weights: tuple[float, ...]):
    """The packing of one block."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1)
        limit = np.array(capacities, float)
        placed, left = best_fit(demands, limit, np.array(weights), rule)
        by_sequence = np.argsort(placed, kind="stable")
        before = np.cumsum(lengths[by_sequence]) - lengths[by_sequence]
        offset = np.empty(len(lengths), np.int64)
        offset[by_sequence] = before - np.maximum.accumulate(np.where(np.diff(placed[by_sequence], prepend=-1) != 0, before, 0))
        made = {
            "sequence_id": pa.array((key[0].as_py() << 24) + (level << 56) + placed, pa.int64()),
            "offset": pa.array(offset, pa.int64()),
            "level": pa.array(np.full(len(lengths), level), pa.int32()),
            "reopen": pa.array((left > limit / 2).all(axis=1)[placed]),
        }
        return pa.table({name: made[name] if name in made else group.column(name) for name in (c.split()[0] for c in PACKED.split(", "))})

    return pack


def dealt(pieces: DataFrame, level: int, parts: int) -> DataFrame:
    """pieces, a written table, with the __block of each; equal rows are told apart by their place, so that they spread as others do."""
    return pieces.withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))


def pack_pieces(pieces: DataFrame, rule: str = "norm", capacities: tuple[int, ...] = (LENGTH, MOST_DOCUMENTS, MOST_COST), weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """pieces with sequence_id and offset."""
    out, level = [], 1
    full = pieces.where(F.col("length") >= capacities[0])
    # a full piece is a sequence by itself; its number comes from its place among the rows and stays clear of the levels'
    out.append(full.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    rest = pieces.where(F.col("length") < capacities[0])
    n = rest.count()
    while True:
        parts = max(1, -(-n // BLOCK))
        packed = cut(dealt(rest, level, parts).groupBy("__block").applyInArrow(packing(level, rule, capacities, weights), PACKED))
        if parts == 1:
            out.append(packed.select(*out[0].columns))
            break
        out.append(packed.where("not reopen").select(*out[0].columns))
        rest, level = packed.where("reopen").select(*pieces.columns), level + 1
        n = rest.count()
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op2_vector_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary)


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place. vocabulary: the tokenizer's file, which every executor has."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack_pieces(cut(cut_pieces(docs, vocabulary)))
