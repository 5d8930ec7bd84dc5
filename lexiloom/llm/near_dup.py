"""Near-duplicate classes by b-bit MinHash.

Each text becomes its set of word shingles, hashed to 64 bits. Of MINIMA permutations the least values are taken; bands of
ROWS minima give candidate buckets, and the low BITS of each minimum are kept, packed in bit planes, to estimate
similarity by bit counts, corrected for chance agreement. Documents with equal sets collapse into one first. Candidates
are confirmed on their full shingle sets.

A pair at the threshold of 0.8 shares none of the 32 bands of 5 with probability 3e-6, and less above. Within a bucket
pairs are not listed. First each document meets the least document of the buckets it shares with it most often, and the
confirmed pairs give classes. In buckets where several classes are left, the members outside the largest are open: blocks
of them meet blocks of all members, pairs of different classes whose estimate can reach the threshold (five standard
errors below it) are confirmed on the spot, each pair in the first bucket it shares, and only links between classes leave
a block. Pairs within one class need no check, so classes come out as if all pairs of all buckets had been confirmed.

Defined results: texts of fewer words than a shingle are one shingle; null texts and texts without words have no shingles
and link with nothing; rows that share a doc_id are one document, linked; a row whose doc_id is null links with nothing
and its component_id is null; an empty table gives an empty result; extra columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sieve, cut, discard, slices, table, tables_of
from .components import components, roots

SIMILAR = 0.8
BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Low bits kept of each minimum.
BITS = 4
#: How far below the threshold an estimate may lie for a pair to be confirmed: five standard errors.
SLACK = 5 * (SIMILAR * (1 - SIMILAR) / MINIMA) ** 0.5 / (1 - 2.0**-BITS) + 0.01
#: Open members of a bucket, and members, whose signatures meet in one group, and those whose texts do.
OPEN_BLOCK, BLOCK = 4096, 4096
OPEN_TEXTS, TEXTS = 256, 1024
#: Followers that are compared with one copy of their leader's text.
FOLLOWERS = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each text, and where each text's start (with the end)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = split.offsets.to_numpy().astype(np.int64)
    units = split.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.binary()).dictionary_encode()
    distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(u) if u else 0 for u in distinct), np.uint64, len(distinct))
    words_ = hashes[units.indices.to_numpy()] if distinct else hashes
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    real = words_ != 0  # blanks at a text's ends leave empty words
    words_, text = words_[real], text[real]
    counts = np.bincount(text, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    place = np.arange(len(words_)) - starts[text]
    span = np.minimum(words, counts)[text]  # a shorter text is one shingle
    whole = place + span <= counts[text]
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        live = k < span[at]
        value[live] = mixed(value[live] * MIX + words_[at[live] + k] + np.uint64(1))
    owner = text[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[first], minlength=len(texts))
    return value[first], np.concatenate(([0], np.cumsum(sizes)))


def each_set(texts: pa.Array, words: int, max_bytes: int = 1 << 18) -> list[np.ndarray]:
    """The shingle set of each text, cut a few at a time."""
    found: list[np.ndarray] = []
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", max_bytes):
        values, starts = shingle_sets(part.column("text"), words)
        found += [values[a:b].copy() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return found


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(8).integers(0, 1 << 63, (2, MINIMA), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA rows of the least permuted value of each set (none of which is empty)."""
    factors, masks = permutations()
    out = np.zeros((MINIMA, len(starts)), np.uint64)
    for i in range(MINIMA):
        out[i] = np.minimum.reduceat((values ^ masks[i]) * factors[i], starts)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """For each set, BITS planes of MINIMA bits: the low bits of its minima, well mixed."""
    low = (least * MIX) >> np.uint64(64 - BITS)
    planes = np.stack([((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(BITS)])  # bit, minimum, set
    return np.packbits(planes.transpose(2, 0, 1), axis=2).reshape(least.shape[1], -1)


def estimates(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of each packed signature of one with each of other: agreeing minima by bit counts, without chance agreement."""
    planes = MINIMA // 8
    differ = np.zeros((len(one), len(other), planes), np.uint8)
    for b in range(BITS):
        part = slice(b * planes, (b + 1) * planes)
        differ |= one[:, None, part] ^ other[None, :, part]
    agree = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / MINIMA
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


SIGNED = "doc_id long, n_shingles long, set_hash binary, bits binary, bands array<long>"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, packed low bits and band keys of each text; the last three null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = mixed(np.arange(1, ROWS + 1, dtype=np.uint64))[:, None]
        number = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))[:, None]
        for batch in slices(batches, "text", 1 << 19):
            values, starts = shingle_sets(batch.column("text"), words)
            sizes = np.diff(starts)
            some = np.flatnonzero(sizes)
            least = minima(values, starts[some]) if len(some) else np.zeros((MINIMA, 0), np.uint64)
            keys = mixed((mixed(least.reshape(BANDS, ROWS, -1)) * multipliers).sum(axis=1, dtype=np.uint64) + number).T
            bits = packed_bits(least)
            hashes: list = [None] * len(sizes)
            signs: list = [None] * len(sizes)
            for k, i in enumerate(some.tolist()):
                hashes[i] = xxhash.xxh3_128_digest(values[starts[i] : starts[i + 1]].tobytes())
                signs[i] = bits[k].tobytes()
            offsets = np.zeros(len(sizes) + 1, np.int32)
            offsets[1:] = np.cumsum(sizes > 0) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signs, pa.binary()), bands], ["doc_id", "n_shingles", "set_hash", "bits", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, SIGNED)


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if min(len(one), len(other)) < SIMILAR * max(len(one), len(other)) or not len(one):
        return False
    both = np.concatenate((one, other))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= round(100 * SIMILAR) * (len(both) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full shingle sets are similar, with their texts from texts (doc_id, text).

    The followers b of a leader a are dealt into blocks of about FOLLOWERS; a block gets the leader's text once and is
    read in order, the leader first.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, key = np.zeros(0, np.uint64), None
        for batch in slices(batches, "text", 1 << 19):
            a, b = [], []
            for one, block, other, own in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b")), each_set(batch.column("text"), words), strict=True):
                if other is None:
                    leader, key = own, (one, block)
                elif key == (one, block) and similar(leader, own):
                    a.append(one)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sized = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("blocks"))
    of_a = sized.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    of_b = pairs.join(sized, "a").join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "text")
    both = of_a.unionByName(of_b).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return both.mapInArrow(compare, "a long, b long")


def groups(rows: DataFrame, by: list[str], answer, schema: str) -> DataFrame:
    """answer(table) for each group of rows, from partitions sorted by group; a group is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the group that may go on in the next batch
        for batch in batches:
            part = pa.Table.from_batches([batch])
            kept = part if kept is None else pa.concat_tables([kept, part])
            keys = np.stack([kept.column(c).to_numpy() for c in by])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for at, to in zip([0, *cuts[:-1]], cuts, strict=False):
                yield from answer(kept.slice(at, to - at)).to_batches()
            if cuts:
                kept = kept.slice(cuts[-1]).combine_chunks()
        if kept is not None and len(kept):
            yield from answer(kept).to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of open members, rows of members, which of their pairs may be similar, and their estimates.

    A pair is looked at in the first bucket that it shares, and from its smaller member if both are open.
    """
    rep, component, n, side, open_ = (group.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "n", "side", "open"))
    u, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(rep), -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    guess = estimates(bits[u], bits[x])
    small, large = np.minimum(n[u][:, None], n[x][None]), np.maximum(n[u][:, None], n[x][None])
    can = (guess >= SIMILAR - SLACK) & (small >= SIMILAR * large) & (component[u][:, None] != component[x][None])
    can &= ~open_[x][None] | (rep[u][:, None] < rep[x][None])
    if can.any():
        this = int(np.argmax(bands[0] == group.column("key")[0].as_py()))
        for k in range(this):
            can &= bands[u, k][:, None] != bands[x, k][None]
    return u, x, can, guess


def promising(group: pa.Table) -> pa.Table:
    """The rows of a group that have a partner, dealt anew with their texts' blocks: ut and xt join the group's key."""
    side = group.column("side").to_numpy()
    u, x = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    rows, ut, xt = [], [], []
    for i in range(0, len(u), OPEN_TEXTS):
        for j in range(0, len(x), TEXTS):
            part = np.concatenate((u[i : i + OPEN_TEXTS], x[j : j + TEXTS]))
            a, b, can, _ = open_pairs(group.take(pa.array(part)))
            found = np.sort(np.concatenate((a[can.any(axis=1)], b[can.any(axis=0)])))
            rows.append(part[found])
            ut.append(np.full(len(found), i // OPEN_TEXTS, np.int32))
            xt.append(np.full(len(found), j // TEXTS, np.int32))
    taken = group.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
    return taken.append_column("ut", pa.array(np.concatenate(ut) if rows else [], pa.int32())).append_column("xt", pa.array(np.concatenate(xt) if rows else [], pa.int32()))


def links_in(words: int):
    """Confirms pairs within a group on their full shingle sets; pairs that a link found before has joined need no check."""

    def answer(group: pa.Table) -> pa.Table:
        u, x, can, guess = open_pairs(group)
        sets = each_set(group.column("text").combine_chunks(), words)
        rep = group.column("rep").to_numpy()
        names, component = np.unique(group.column("component").to_numpy(), return_inverse=True)
        a, b = [], []
        for i, row in enumerate(u.tolist()):
            mates = np.flatnonzero(can[i])
            for j in mates[np.argsort(-guess[i, mates], kind="stable")].tolist():
                other = int(x[j])
                if component[row] != component[other] and similar(sets[row], sets[other]):
                    component[component == component[other]] = component[row]
                    a.append(int(rep[row]))
                    b.append(int(rep[other]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return answer


MEMBER = "key long, ub int, xb int, side int, open boolean, rep long, component long, n long, bits binary, bands array<long>"


def cross_links(members: DataFrame, component: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between members (key, rep, m) of a bucket that component (node, component) leaves in different classes.

    In each bucket that holds several classes, the members outside its largest class are open. Each block of open
    members meets each block of members in a group of its own; first by their signatures, then, for rows that may have
    a partner, by their texts.
    """
    now = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "m", F.coalesce("component", "rep").alias("component"))
    held = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    buckets = held.groupBy("key").agg(F.max(F.struct("held", "component")).alias("top"), F.sum("held").alias("all")).where(F.col("top.held") < F.col("all"))
    sized = buckets.select("key", F.col("top.component").alias("largest"), F.ceil((F.col("all") - F.col("top.held")) / OPEN_BLOCK).cast("int").alias("ubs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("xbs"))
    rows = now.join(sized, "key").join(classes.select("rep", "n", "bits", "bands"), "rep").withColumn("open", F.col("component") != F.col("largest"))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    as_member = F.transform(every("ubs"), lambda k: F.struct(k.alias("ub"), own("xbs").alias("xb"), F.lit(1).alias("side")))
    as_open = F.when(F.col("open"), F.transform(every("xbs"), lambda k: F.struct(own("ubs").alias("ub"), k.alias("xb"), F.lit(0).alias("side")))).otherwise(F.expr("cast(array() as array<struct<ub:int,xb:int,side:int>>)"))
    dealt = rows.withColumn("at", F.explode(F.concat(as_member, as_open))).select("key", "at.ub", "at.xb", "at.side", "open", "rep", "component", "n", "bits", "bands")
    found = groups(dealt, ["key", "ub", "xb"], promising, MEMBER + ", ut int, xt int")
    with_text = found.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return groups(with_text, ["key", "ub", "xb", "ut", "xt"], links_in(words), "a long, b long")


def linked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    signed = cut(signatures(docs, words))
    usable = signed.where("set_hash is not null and doc_id is not null")
    classes = cut(
        usable.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    )
    with tables_of() as written:
        placed = classes.select("rep", F.explode("bands").alias("key"))
        shared = placed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
        members = cut(placed.join(shared, "key").select("key", "rep", "leader", "m"))
        ids = cut(members.select(F.col("rep").alias("doc_id")).distinct())
        some = Sieve(ids, "doc_id").passed(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
        texts = cut(some.join(ids, "doc_id", "left_semi"))

        # each document and the leader it shares most buckets with
        often = members.where("rep != leader").groupBy("rep", "leader").count()
        best = often.groupBy("rep").agg(F.max(F.struct("count", (-F.col("leader")).alias("leader"))).alias("top"))
        tried = cut(best.select((-F.col("top.leader")).alias("a"), F.col("rep").alias("b")))
        component = roots(confirmed(tried, texts, words).groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("component")))

        ends = cross_links(members, component, classes, texts, words).join(component.toDF("a", "of_a"), "a", "left").join(component.toDF("b", "of_b"), "b", "left")
        merged = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        moved = component.join(merged.toDF("component", "__to"), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
        component = cut(moved.unionByName(merged.join(moved, "node", "left_anti")))
        discard(docs.sparkSession, written, kept=1)  # all but signatures, classes and components

    several = classes.where("copies > 1").select("set_hash", "rep")
    rows = signed.select("doc_id", "n_shingles", "set_hash").join(several, "set_hash", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    found = rows.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents"), 2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
