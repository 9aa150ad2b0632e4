"""Ids of whole texts by a byte-level tokenizer, a chunk of texts at a time.

A corpus has far fewer different pieces than pieces, so each piece is hashed, and only
pieces that a task hasn't met yet are merged. A second hash tells pieces apart that have
the same first one; then all are hashed anew.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken

from tidewell.llm.arrays import distinct_spans, flat_ranges
from tidewell.llm.pretoken import byte_level_pieces

#: The memo starts anew beyond this many pieces (some 40 bytes each).
MEMO_PIECES = 1_500_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder:
    """Encodes as the tokenizers library does with the same file and no added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = byte_characters()
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece.encode() not in self.specials}
        # one piece is one match, so that the library merges it and nothing else
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seed = 0
        self.forget()

    def forget(self) -> None:
        self.known, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk, and how many lie before each text."""
        cuts, before = byte_level_pieces(data, offsets, tuple(self.specials))
        starts, ends = cuts[:-1], cuts[1:]
        while (at := self._rows(distinct_spans(data, starts, ends, self.seed), data, starts, ends)) is None:
            self.seed += 1
            self.forget()
        count = self.count[at]
        ids = self.ids[flat_ranges(self.first[at], count)]
        return ids, np.concatenate([[0], np.cumsum(count)])[before]

    def _rows(self, found, data, starts, ends) -> np.ndarray | None:
        """Where the memo has each piece, new ones being merged first; None if a hash isn't one piece's alone."""
        if found is None:
            return None
        unique, second, one, back = found
        if len(self.known) + len(unique) > MEMO_PIECES:
            self.forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        if len(self.known):
            near = np.minimum(at, len(self.known) - 1)
            new = self.known[near] != unique
            if (self.second[near] != second)[~new].any():
                return None
        if new.any():
            parts = []
            for i in one[new]:
                piece = data[starts[i] : ends[i]].tobytes()
                parts.append([self.specials[piece]] if piece in self.specials else self.merge(piece.decode()))
            count = np.array([len(p) for p in parts])
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.array([i for p in parts for i in p], np.uint32)])
            place = at[new]
            self.known, self.second = np.insert(self.known, place, unique[new]), np.insert(self.second, place, second[new])
            self.first, self.count = np.insert(self.first, place, first), np.insert(self.count, place, count)
            at = np.searchsorted(self.known, unique)
        return at[back]
