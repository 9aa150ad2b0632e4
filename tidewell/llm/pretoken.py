"""Splitting of chunks of texts into the pieces that byte-pair tokenizers merge within."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Kinds of characters: anything else, letters, numbers, white space.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Characters with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Endings that are pieces of their own after an apostrophe.
ONE_LETTER_ENDINGS = "stmd"
TWO_LETTER_ENDINGS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            out[c] = LETTER
        elif group == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and where each begins (with the end added)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _contraction_ends(points: np.ndarray, quotes: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """For each apostrophe the end of the contraction that starts with it, or -1."""
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    one, two = padded[quotes + 1], padded[quotes + 2]
    end = np.full(len(quotes), -1, np.int64)
    for a, b in TWO_LETTER_ENDINGS:
        end[(one == ord(a)) & (two == ord(b)) & (quotes + 3 <= text_end)] = 3
    end[np.isin(one, [ord(c) for c in ONE_LETTER_ENDINGS]) & (quotes + 2 <= text_end)] = 2
    return np.where(end > 0, quotes + end, -1)


def _run_starts(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a run of characters of one kind in one text begins."""
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return begins


def _text_ends(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return offsets[np.searchsorted(offsets, at, "right")]


def byte_level_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of byte-level tokenizers; together the pieces cover the texts.

    A piece is a run of letters, of numbers or of other characters, each with one space
    before it if there is one, or a contraction, or white space: of a run before something
    else, the last character is a piece of its own, unless it is a space that goes with
    what follows.
    """
    if not len(points):
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    begins = _run_starts(kind, offsets)
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], len(points))
    finish = _text_ends(offsets, runs)
    blank = kind[runs] == SPACE
    # white space before something else in the same text gives up its last character
    before = blank & (ends < finish)
    begins[ends[before] - 1] = True
    joins = before & (points[ends - 1] == 32)
    begins[ends[joins]] = False
    # contractions: an apostrophe that begins a piece, so neither after a space nor among other characters
    alone = runs[(points[runs] == 39) & begins[runs]]
    stop = _contraction_ends(points, alone, _text_ends(offsets, alone))
    stop, alone = stop[stop > 0], alone[stop > 0]
    begins[alone + 1] = False
    cut = stop[stop < len(points)]
    begins[cut] = True
    # what follows a contraction begins a piece even within a run; a space that went with it still does
    return np.flatnonzero(begins)


def word_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of word tokenizers: contractions, runs of letters,
    single numbers and runs of other characters; white space lies between them."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds()[points]
    begins = _run_starts(kind, offsets) | (kind == NUMBER)
    quotes = np.flatnonzero(begins & (points == 39))
    stop = _contraction_ends(points, quotes, _text_ends(offsets, quotes))
    stop, quotes = stop[stop > 0], quotes[stop > 0]
    begins[quotes + 1] = False
    begins[stop[stop < len(points)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    solid = kind[starts] != SPACE
    return starts[solid], ends[solid]


def byte_level_pieces(data: np.ndarray, offsets: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the byte-level pieces (the end added), and how many lie before each text.

    Each occurrence of one of `specials` is one piece, and the text on either side of it is
    split as if it stood alone.
    """
    cuts, inside = offsets, None
    whole = data.tobytes() if specials else b""
    found = sorted((p, p + len(s)) for s in specials for p in _finds(whole, s))
    if found:
        first, last = np.array(found).T
        same = np.searchsorted(offsets, first, "right") == np.searchsorted(offsets, last - 1, "right")
        first, last = first[same], last[same]
        # np.unique would drop empty texts, which byte_level_starts doesn't mind
        cuts, inside = np.unique(np.concatenate([offsets, first, last])), (first, last)
    points, at = code_points(data)
    starts = at[byte_level_starts(points, np.searchsorted(at, cuts))]
    if inside is not None:
        k = np.searchsorted(inside[0], starts, "left") - 1
        starts = starts[(k < 0) | (starts >= inside[1][np.maximum(k, 0)])]
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


def _finds(whole: bytes, part: bytes):
    at = whole.find(part)
    while at >= 0:
        yield at
        at = whole.find(part, at + len(part))
