"""A counting quotient filter block: sorted fingerprints, split in quotient and remainder, with counters in the slots.

A block holds the fingerprints that share some leading bits. Of the other bits, the first QUOTIENT_BITS are the quotient
and the rest the remainder. `occupied` has a bit for each quotient that occurs, `runends` a bit for each slot, set on the
last slot of a quotient's run. A remainder x (stored plus 1, so never 0) that occurs once takes the slot [x], twice
[x, x], c > 2 times [x, digits of c - 3, x]; the digits avoid x and the first is less than x, so the descent tells them
from a next remainder. Nothing is lost: a decoded block gives back each fingerprint with its count, and blocks merge by
their sorted remainders.
"""

from __future__ import annotations

import numpy as np

QUOTIENT_BITS = 8


def _split(fingerprints: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - lead - QUOTIENT_BITS)
    quotient = (fingerprints >> shift) & np.uint64((1 << QUOTIENT_BITS) - 1)
    remainder = fingerprints & np.uint64((1 << int(shift)) - 1)
    return quotient.astype(np.int64), remainder + np.uint64(1)


def _counter(x: int, count: int, bits: int) -> list[int]:
    """Slots of a remainder that occurs more than twice."""
    base, left, digits = (1 << bits) - 1, count - 3, []
    while True:
        left, d = divmod(left, base)
        digits.append(d if d < x else d + 1)
        if not left:
            break
    digits.reverse()
    return [x, *([] if digits[0] < x else [0]), *digits, x]


def encode(fingerprints: np.ndarray, counts: np.ndarray, lead: int) -> bytes:
    """A block from sorted distinct 64-bit fingerprints that share their `lead` leading bits, and their counts."""
    quotient, remainder = _split(fingerprints, lead)
    bits = 64 - lead - QUOTIENT_BITS + 1
    width = np.minimum(counts, 2)
    special = {int(i): _counter(int(remainder[i]), int(counts[i]), bits) for i in np.flatnonzero(counts > 2)}
    for i, slots in special.items():
        width[i] = len(slots)
    slots, start = np.repeat(remainder, width), np.cumsum(width) - width
    for i, own in special.items():
        slots[start[i] : start[i] + len(own)] = own
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotient] = True
    runends = np.zeros(len(slots), bool)
    last = np.flatnonzero(np.diff(quotient, append=-1))
    runends[(start + width)[last] - 1] = True
    return b"".join((np.uint32(len(slots)).tobytes(), np.packbits(occupied).tobytes(), np.packbits(runends).tobytes(), slots.astype("<u8").tobytes()))


def decode(block: bytes, prefix: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts of a block whose leading bits are `prefix`."""
    n = int(np.frombuffer(block, np.uint32, 1)[0])
    at = 4 + (1 << QUOTIENT_BITS) // 8
    occupied = np.unpackbits(np.frombuffer(block, np.uint8, at - 4, 4)).astype(bool)
    runends = np.unpackbits(np.frombuffer(block, np.uint8, -(-n // 8), at))[:n].astype(bool)
    slots = np.frombuffer(block, "<u8", n, at + -(-n // 8))
    run = np.cumsum(runends) - runends
    first = np.ones(n, bool)
    counts = np.ones(n, np.int64)
    bits = 64 - lead - QUOTIENT_BITS + 1
    base = (1 << bits) - 1
    # a slot that isn't above the one before it, in the same run, belongs to a counter
    descends = np.flatnonzero((slots[1:] <= slots[:-1]) & (run[1:] == run[:-1])) + 1
    done = 0
    for i in descends:
        if i < done:
            continue
        x, j, value = int(slots[i - 1]), int(i), 0
        while int(slots[j]) != x:
            d = int(slots[j])
            value = value * base + (d if d < x else d - 1)
            j += 1
        counts[i - 1] = 2 if j == i else value + 3
        first[i : j + 1] = False
        done = j + 1
    quotients = np.flatnonzero(occupied).astype(np.uint64)[run[first]]
    shift = np.uint64(64 - lead - QUOTIENT_BITS)
    high = np.uint64(prefix << (64 - lead)) if lead else np.uint64(0)
    return high | (quotients << shift) | (slots[first] - np.uint64(1)), counts[first]


def tally(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with their summed counts."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    starts = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1])) if len(fingerprints) else np.zeros(0, np.int64)
    return fingerprints[starts], np.add.reduceat(counts, starts) if len(starts) else counts
