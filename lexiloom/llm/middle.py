"""Fill-in-the-middle: whole texts cut at two drawn ranks of units and put in another order.

A unit begins where a predicate on two adjacent bytes holds: at each code point, word or line. A text is decomposed into
chunks of CHUNK bytes that overlap by one, so that a chunk sees the byte before its first one and the predicate decides on
every byte in exactly one chunk. Chunks count their units side by side; running sums over a text's chunks give its number of units
and route both cut ranks to the chunks that own them, and only these are scanned again for the places of the cuts.

Python sees a text once and gives two byte positions for it; hashes, forms and outputs are DataFrame functions. A row
depends on nothing but itself, so there is no shuffle, and a lost executor costs its rows alone. Memory is bounded by a slice
of texts or by the longest one.

Defined results: a null text counts as empty and stays plain; a null id draws as the word null; repeated rows give equal rows;
a text that holds a marker stays plain; a text of n units has n + 1 places for cuts, which may be equal, and what lies before
its first unit goes with that; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

#: Bytes of a text in a chunk, besides the one before.
CHUNK = 4096
#: Bytes whose predicate is held at once while chunks count.
STRIDE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are rearranged, and those of them in a hundred whose suffix comes first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: What goes before a text's first byte.
BEFORE = 0x0A

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Whether a unit begins at a byte, from the byte before and the byte.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "code points": lambda before, byte: (byte & 0xC0) != 0x80,
    "words": lambda before, byte: WHITE[before] & ~WHITE[byte],
    "lines": lambda before, byte: before == 0x0A,
}


class Chunks:
    """The overlapping chunks of several texts that lie one after the other, with the units that begin in each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str):
        """data: the bytes of all texts; ends: where each text starts, and the end of the last."""
        self.begins_unit, self.data, self.ends = UNITS[unit], data, ends
        lengths = np.diff(ends)
        chunks = -(-lengths // CHUNK)
        self.first_chunk = np.concatenate(([0], np.cumsum(chunks)))
        text = np.repeat(np.arange(len(lengths)), chunks)
        within = np.arange(len(text)) - self.first_chunk[text]
        self.starts = ends[text] + within * CHUNK
        self.stops = np.minimum(self.starts + CHUNK, ends[text + 1])
        self.opens = within == 0  # a text's first chunk has no byte before it
        self.units = np.zeros(len(text), np.int64)
        per_stride = max(1, STRIDE // CHUNK)
        for at in range(0, len(text), per_stride):
            part = slice(at, at + per_stride)
            low, high = self.starts[part][0], self.stops[part][-1]
            hits = self._hits(low, high, self.starts[part][self.opens[part]])
            self.units[part] = np.add.reduceat(hits, self.starts[part] - low, dtype=np.int64)
        self.sums = np.concatenate(([0], np.cumsum(self.units)))  # units before each chunk

    def _hits(self, low: int, high: int, firsts: np.ndarray) -> np.ndarray:
        """Where units begin in [low, high); firsts are first bytes of texts."""
        before = np.empty(high - low, np.uint8)
        before[1:], before[0] = self.data[low : high - 1], self.data[low - 1] if low else BEFORE
        before[firsts - low] = BEFORE
        return self.begins_unit(before, self.data[low:high])

    def counts(self) -> np.ndarray:
        """The units of each text."""
        return self.sums[self.first_chunk[1:]] - self.sums[self.first_chunk[:-1]]

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """For each text, the byte within it where its unit of the given rank begins; rank 0 is its start and its number of units its end."""
        out = np.where(ranks <= 0, 0, np.diff(self.ends))
        inner = np.flatnonzero((ranks > 0) & (ranks < self.counts()))
        wanted = self.sums[self.first_chunk[inner]] + ranks[inner]
        owners = np.searchsorted(self.sums, wanted, "right") - 1
        for text, rank, owner in zip(inner.tolist(), (wanted - self.sums[owners]).tolist(), owners.tolist(), strict=True):
            low, high = int(self.starts[owner]), int(self.stops[owner])
            firsts = self.starts[owner : owner + 1][self.opens[owner : owner + 1]]
            out[text] = low + np.flatnonzero(self._hits(low, high, firsts))[rank] - self.ends[text]
        return out


def with_cuts(rows: DataFrame, unit: str) -> DataFrame:
    """rows (text, h1, h2, ...), without nulls, with n, the number of units, the ranks of both cuts and their places in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pa.concat_arrays([batch.column("text")])
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            held = texts.buffers()[2]
            data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
            chunks = Chunks(data, ends - ends[0], unit)
            n = chunks.counts()
            draws = np.stack([batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")])
            made = {"n": n, "rank1": draws.min(axis=0), "rank2": draws.max(axis=0)}
            made |= {"cut1": chunks.places(made["rank1"]), "cut2": chunks.places(made["rank2"])}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, pa.int64()) for v in made.values()]], [*batch.schema.names, *made])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, n long, rank1 long, rank2 long, cut1 long, cut2 long")


def draws(key: Column) -> list[Column]:
    """Four 32-bit numbers of a row's key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "code points", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, form, prefix_units, middle_units (null if plain), text and output of every row."""
    whole = text_of(text)
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    h1, h2, h3, h4 = draws(F.col(key))
    form = F.when((whole == "") | marked | (h3 % 100 >= REARRANGED), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = docs.select(F.col(key).alias("key"), whole.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    placed = with_cuts(rows, unit)
    data = F.col("text").cast("binary")
    piece = lambda start, end: F.substring(data, start.cast("int") + 1, (end - start).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), F.col("cut1")), piece(F.col("cut1"), F.col("cut2")), piece(F.col("cut2"), F.octet_length("text"))
    sign = lambda s: F.lit(s).cast("binary")
    psm = F.concat(sign(PREFIX), prefix, sign(SUFFIX), suffix, sign(MIDDLE), middle)
    spm = F.concat(sign(SUFFIX), suffix, sign(PREFIX), prefix, sign(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.when(F.col("form") == "psm", psm).otherwise(spm).cast("string"))
    units = lambda c: F.when(F.col("form") != "plain", c)
    return placed.select(F.col("key").alias(key), "n", "form", units(F.col("rank1")).alias("prefix_units"), units(F.col("rank2") - F.col("rank1")).alias("middle_units"), "text", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    inner = F.substring(output, len(PREFIX) + 1, 1 << 30)
    first = F.when(form == "psm", F.substring_index(inner, SUFFIX, 1)).otherwise(F.substring_index(inner, PREFIX, 1))
    middle = F.substring_index(output, MIDDLE, -1)
    used = F.char_length(first) + 3 + 3  # the first part and two markers
    second = F.substring(output, used + 1, F.char_length(output) - used - F.char_length(middle) - 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_H = [f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, 'null')), {1 + 8 * i}, 8))::BIGINT" for i in range(4)]
#: Code points are DuckDB's characters; cuts are ranks of them.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, {", ".join(f"{h} AS h{i + 1}" for i, h in enumerate(_H))} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {REARRANGED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
  ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
