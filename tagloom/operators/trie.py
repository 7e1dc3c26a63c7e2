"""Greedy longest-match of many tokens at once in one pass over a trie with failure links.

A node stands for the characters read since the last piece that is certain. Where a node
has no child for the next character, its failure link says which pieces are certain now
and at which node reading goes on, so no character is read twice. All tokens of an Arrow
batch take a step together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

INNER = "##"
# Nodes that stand for nothing read: at the start of a token, and after a piece.
START, INSIDE = 0, 1
NONE = -1
# A key of the edge table is a node and a code point.
CHAR_BITS = 21


class PieceTrie:
    """Pieces ``(name, id)`` as arrays: edges, failure links, pieces certain on failure.

    Of equal names the one with the least id counts. The unknown piece comes last.
    """

    def __init__(self, pieces: Iterable[tuple[str, int]], unk: str):
        ids: dict[str, int] = {}
        for name, number in pieces:
            if name:
                ids[name] = min(number, ids.get(name, number))
        names = list(ids)
        edges: dict[int, int] = {}
        parent, char, own = [NONE, NONE], [NONE, NONE], [NONE, NONE]
        levels = [[START, INSIDE]]

        def insert(node: int, text: str, row: int) -> None:
            for depth, c in enumerate(map(ord, text), 1):
                key = node << CHAR_BITS | c
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    char.append(c)
                    own.append(NONE)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(edges[key])
                node = edges[key]
            own[node] = row

        for row, name in enumerate(names):
            insert(START, name, row)
            if name.startswith(INNER) and len(name) > len(INNER):
                insert(INSIDE, name[len(INNER):], row)

        fail = [NONE] * len(parent)
        certain: list[tuple[int, ...]] = [()] * len(parent)
        for node in (n for level in levels[1:] for n in level):
            if own[node] != NONE:
                fail[node], certain[node] = INSIDE, (own[node],)
                continue
            out, at = certain[parent[node]], fail[parent[node]]
            while at != NONE and (at << CHAR_BITS | char[node]) not in edges:
                out, at = out + certain[at], fail[at]
            if at != NONE:
                fail[node], certain[node] = edges[at << CHAR_BITS | char[node]], out
        # One node more, never reached, stands for the unknown piece.
        fail.append(NONE)
        certain.append((len(names),))
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int32)
        self.fail = np.array(fail, dtype=np.int32)
        self.counts = np.array([len(c) for c in certain], dtype=np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.rows = np.array([row for c in certain for row in c], dtype=np.int64)
        self.names = pa.array([*names, unk], pa.string())
        self.ids = pa.array([*ids.values(), ids.get(unk)], pa.int64())

    def _children(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(nodes), NONE)
        keys = nodes.astype(np.int64) << CHAR_BITS | chars
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.child[at], NONE)

    def match(self, tokens: list[str | None], max_chars: int) -> pa.Array:
        """The pieces of every token as ``list<struct<piece,id>>``."""
        sizes = np.array([NONE if t is None else len(t) for t in tokens], dtype=np.int64)
        failed = (sizes < 0) | (sizes > max_chars)
        active = np.flatnonzero(~failed & (sizes > 0))
        text = "".join(tokens[i] for i in active)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes[active])
        place, nodes = ends - sizes[active], np.full(len(active), START)
        owners, found = [], []
        while len(active):
            more = place < ends
            to = np.full(len(active), NONE)
            to[more] = self._children(nodes[more], chars[place[more]])
            read = to != NONE
            closed = ~more & (nodes == INSIDE)
            stuck = ~read & ~closed
            dead = stuck & (self.fail[nodes] == NONE)
            failed[active[dead]] = True
            turn = stuck & ~dead
            owners.append(active[turn])
            found.append(nodes[turn])
            nodes = np.where(read, to, self.fail[nodes])
            place = place + read
            stay = ~closed & ~dead
            active, place, ends, nodes = active[stay], place[stay], ends[stay], nodes[stay]
        lost = np.flatnonzero(failed)
        owner = np.concatenate([*owners, lost]).astype(np.int64)
        node = np.concatenate([*found, np.full(len(lost), len(self.fail) - 1)]).astype(np.int64)
        kept = ~failed[owner] | (node == len(self.fail) - 1)
        order = np.argsort(owner[kept], kind="stable")
        owner, node = owner[kept][order], node[kept][order]
        counts = self.counts[node]
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = pa.array(self.rows[np.repeat(self.firsts[node], counts) + within])
        held = np.bincount(owner, weights=counts, minlength=len(tokens)).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
        pieces = pa.StructArray.from_arrays([self.names.take(rows), self.ids.take(rows)], ["piece", "id"])
        return pa.ListArray.from_arrays(offsets, pieces)


def match_pieces(tokens: DataFrame, matcher, max_chars: int) -> DataFrame:
    """``(token, …)`` -> the same rows with ``pieces``; rows stay where they are.

    ``matcher`` (a :class:`PieceTrie` or a ``PieceTable``) is sent to every executor.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = shared.value.match(batch.column("token").to_pylist(), max_chars)
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], [*batch.schema.names, "pieces"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, _PIECES]))


def match_lists(words: DataFrame, matcher, max_chars: int, tokens: str = "tokens") -> DataFrame:
    """Rows with a list of ``tokens`` -> ``pieces`` of all of them in place of the list, none for a null list."""
    shared = words.sparkSession.sparkContext.broadcast(matcher)
    kept = [c for c in words.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            pieces = shared.value.match(pc.list_flatten(lists).to_pylist(), max_chars)
            ends = pieces.offsets.to_numpy()[np.append(0, np.cumsum(sizes))]
            whole = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pieces.values)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], whole], [*kept, "pieces"])

    return words.mapInArrow(run, T.StructType([*[words.schema[c] for c in kept], _PIECES]))


_PIECE = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.LongType())])
_PIECES = T.StructField("pieces", T.ArrayType(_PIECE))
