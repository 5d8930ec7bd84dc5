"""Token ids of whole texts by a public tokenizer, with each distinct word or run of signs encoded once for a task."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a task remembers before it starts over.
REMEMBERED = 200_000
#: A text with other characters than these is encoded as it is; in these the tokenizer's units are runs of letters, single digits and runs of signs.
OTHER = r"[^\x20-\x26\x28-\x7E\nÀ-ÖØ-öø-ÿ]"
BETWEEN_LETTERS = r"([0-9]|[^ \pL0-9]+)"


class TextTokens:
    """Encodes texts by their units: no token crosses one, and each ends in an id that marks a word's end, so many are encoded in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        texts = [" ".join(units[at : at + 1024]) for at in range(0, len(units), 1024)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(units):
            raise ValueError("a unit is not one of this tokenizer's")
        counts = np.diff(cuts, prepend=0)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + cuts - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))

    def _by_units(self, texts: pa.Array) -> list[np.ndarray]:
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.replace_substring(texts, "\n", " ")), BETWEEN_LETTERS, r" \1 ")
        split = pc.ascii_split_whitespace(spaced)
        ends = split.offsets.to_numpy()
        units = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [u for u in distinct if u and u not in self.known]:
            self._learn(new)
        number = np.fromiter((self.known[u] if u else -1 for u in distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        counts = np.where(number < 0, 0, self.counts[number]) if len(self.counts) else np.zeros(len(number), np.int64)
        before = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.starts[number] - before[:-1], counts) + np.arange(before[-1])] if before[-1] else np.zeros(0, np.uint32)
        return np.split(ids, before[(ends - ends[0])[1:-1]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, OTHER).to_numpy(zero_copy_only=False)
        found: list = [None] * len(texts)
        if (plain := np.flatnonzero(~odd)).size:
            for i, ids in zip(plain.tolist(), self._by_units(texts.take(pa.array(plain))), strict=True):
                found[i] = ids
        for i in np.flatnonzero(odd).tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return found
