"""Greedy longest-match of many tokens at once against a table of hashed pieces.

For vocabularies too large for a trie: each piece is one 64-bit hash, its id and its text.
The hashes of all substrings come from one running sum, so a step looks for the longest
piece of all tokens of an Arrow batch together. Hashes only propose: what they give is
compared with the text, and tokens that differ or fail are matched again by text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INNER = "##"
# A piece at the start of a token, and after another piece.
START, INSIDE = 0, 1
MULTIPLIER, SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PieceTable:
    """``pieces(piece, id)`` by hash. Of equal names the one with the least id counts."""

    def __init__(self, pieces: pa.Table, unk: str, multiplier: int = MULTIPLIER):
        named = pieces.filter(pc.greater(pc.utf8_length(pieces["piece"]), 0))
        named = named.group_by("piece", use_threads=False).aggregate([("id", "min")])
        names, self.numbers = named["piece"].to_pylist(), named["id_min"].combine_chunks().cast(pa.int64())
        inner = [i for i, n in enumerate(names) if n.startswith(INNER) and len(n) > len(INNER)]
        self.names = pa.array([*names, unk], pa.string())
        known = pc.index(self.names.slice(0, len(names)), unk).as_py()
        self.numbers = pa.concat_arrays([self.numbers, pa.array([None if known < 0 else self.numbers[known].as_py()], pa.int64())])
        self.multiplier = multiplier
        texts = {START: (names, np.arange(len(names))), INSIDE: ([names[i][len(INNER):] for i in inner], np.array(inner, np.int64))}
        self.keys, self.rows, self.lengths = {}, {}, {}
        for kind, (held, rows) in texts.items():
            sizes = np.array([len(t) for t in held], np.int64)
            ends = np.cumsum(sizes)
            keys = self._hashes(*self._sums(_code_points(held)), ends - sizes, sizes)
            order = np.argsort(keys)
            self.keys[kind], self.rows[kind] = keys[order], rows[order]
            self.lengths[kind] = np.unique(sizes)[::-1].tolist()
            if len(keys) > 1 and (self.keys[kind][1:] == self.keys[kind][:-1]).any():
                self.__init__(pieces, unk, multiplier + 0x10000001A)  # another odd one: two pieces have one hash
                return

    def _sums(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sum of characters times powers of the multiplier, and powers of its inverse."""
        odd, inverse = self.multiplier, pow(self.multiplier, -1, 1 << 64)
        powers = np.full(len(chars), odd & (1 << 64) - 1, np.uint64).cumprod() if len(chars) else chars
        back = np.full(len(chars) + 1, inverse, np.uint64)
        back[0] = 1
        return np.append(np.uint64(0), (chars * powers).cumsum(dtype=np.uint64)), back.cumprod()

    @staticmethod
    def _hashes(sums: np.ndarray, back: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hash of the text of ``size`` characters from ``first``."""
        mixed = (sums[first + size] - sums[first]) * back[first] + np.asarray(size).astype(np.uint64)
        mixed = mixed * np.uint64(SPREAD)
        return mixed ^ (mixed >> np.uint64(29))

    def _find(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if there is none."""
        if not len(self.keys[kind]):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys[kind], keys), len(self.keys[kind]) - 1)
        return np.where(self.keys[kind][at] == keys, self.rows[kind][at], -1)

    def _by_text(self, token: str) -> list[int] | None:
        """Rows of the pieces of one token, None if it has none: every proposal is compared at once."""
        sums, back = self._sums(_code_points([token]))
        rows, at = [], 0
        while at < len(token):
            kind = INSIDE if at else START
            sizes = np.array([n for n in self.lengths[kind] if at + n <= len(token)], np.int64)
            found = self._find(kind, self._hashes(sums, back, np.full(len(sizes), at), sizes))
            mark = INNER if at else ""
            hits = (
                (int(n), int(r)) for n, r in zip(sizes, found)
                if r >= 0 and self.names[int(r)].as_py() == mark + token[at : at + int(n)]
            )
            size, row = next(hits, (0, -1))
            if row < 0:
                return None
            rows.append(row)
            at += size
        return rows

    def match(self, tokens: list[str | None], max_chars: int) -> pa.Array:
        """The pieces of every token as ``list<struct<piece,id>>``."""
        sizes = np.array([-1 if t is None else len(t) for t in tokens], dtype=np.int64)
        unfit = (sizes < 0) | (sizes > max_chars)
        active = np.flatnonzero(~unfit & (sizes > 0))
        sums, back = self._sums(_code_points([tokens[i] for i in active]))
        ends = np.cumsum(sizes[active])
        place, kind = ends - sizes[active], START
        owners, found = [], []
        failed = np.zeros(len(tokens), bool)
        while len(active):
            row, step = np.full(len(active), -1), np.zeros(len(active), np.int64)
            todo = np.arange(len(active))
            for size in self.lengths[kind]:
                fits = todo[place[todo] + size <= ends[todo]]
                hit = self._find(kind, self._hashes(sums, back, place[fits], size))
                row[fits], step[fits] = hit, np.where(hit >= 0, size, 0)
                todo = todo[row[todo] < 0]
            failed[active[row < 0]] = True
            owners.append(active[row >= 0])
            found.append(row[row >= 0])
            place = place + step
            more = (row >= 0) & (place < ends)
            active, place, ends, kind = active[more], place[more], ends[more], INSIDE
        owner = np.concatenate([*owners, [0]])[:-1].astype(np.int64)
        rows = np.concatenate([*found, [0]])[:-1].astype(np.int64)
        rows, owner, held = self._ordered(rows, owner, len(tokens))
        failed |= self._differs(rows, owner, held, tokens, sizes)
        again = {i: self._by_text(tokens[i]) for i in np.flatnonzero(failed & ~unfit).tolist()}
        lost = np.concatenate([np.flatnonzero(unfit), [i for i, r in again.items() if r is None]]).astype(np.int64)
        more = [(i, r) for i, known in again.items() for r in known or ()]
        kept = ~(failed | unfit)[owner]
        owner = np.concatenate([owner[kept], lost, [i for i, _ in more]]).astype(np.int64)
        rows = np.concatenate([rows[kept], np.full(len(lost), len(self.names) - 1), [r for _, r in more]]).astype(np.int64)
        rows, owner, held = self._ordered(rows, owner, len(tokens))
        offsets = pa.array(np.append(0, np.cumsum(held)).astype(np.int32))
        taken = pa.array(rows)
        pieces = pa.StructArray.from_arrays([self.names.take(taken), self.numbers.take(taken)], ["piece", "id"])
        return pa.ListArray.from_arrays(offsets, pieces)

    @staticmethod
    def _ordered(rows: np.ndarray, owner: np.ndarray, count: int):
        order = np.argsort(owner, kind="stable")
        return rows[order], owner[order], np.bincount(owner, minlength=count)

    def _differs(self, rows: np.ndarray, owner: np.ndarray, held: np.ndarray, tokens: list, sizes: np.ndarray) -> np.ndarray:
        """Tokens whose pieces put together are not the token: a hash was met by chance."""
        names = self.names.take(pa.array(rows))
        after = np.append(False, owner[1:] == owner[:-1])[: len(owner)]
        bare = pc.if_else(pa.array(after), pc.utf8_slice_codeunits(names, len(INNER)), names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), bare)
        same = pc.equal(pc.binary_join(lists, ""), pa.array(tokens, pa.string()))
        return ~same.fill_null(True).to_numpy(zero_copy_only=False) & (sizes > 0)
