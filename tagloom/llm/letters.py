"""Words of letters in whole columns of text, by code points."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, MARK, NUMBER = 1, 2, 3


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every code point (0: none of the three), and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            kind[c] = LETTER
            low = x.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif (group := unicodedata.category(x)[0]) in "MN":
            kind[c] = MARK if group == "M" else NUMBER
    return kind, lower


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and the offsets of rows among them."""
    raw = data.tobytes()
    try:
        flat = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return flat, count[offsets]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return (
            np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32),
            np.concatenate([[0], np.cumsum([len(x) for x in rows])]),
        )


def word_bounds(points: np.ndarray, offsets: np.ndarray, numbers: bool = False):
    """Lower-case code points, and (first, end, row) of every run of letters and their marks.

    ``numbers``: digits and other numbers belong to words too.
    """
    kind, lower = characters()
    own = kind[points]
    begins = np.zeros(len(points), bool)
    begins[offsets[:-1][offsets[:-1] < len(points)]] = True
    solid = (own > 0) if numbers else (own == LETTER) | (own == MARK)
    joined = np.zeros(len(points), bool)
    joined[1:] = solid[1:] & solid[:-1] & ~begins[1:]
    first = np.flatnonzero(solid & ~joined)
    last = np.flatnonzero(solid & ~np.append(joined[1:], False)) + 1
    letters = np.concatenate([[0], np.cumsum((own == LETTER) | (solid & (own == NUMBER)))])
    real = letters[last] > letters[first]  # marks alone are no word
    first, last = first[real], last[real]
    return lower[points], first, last, np.searchsorted(offsets, first, "right") - 1
