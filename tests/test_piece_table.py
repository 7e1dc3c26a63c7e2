import random

import numpy as np
import pyarrow as pa
import pytest

from tagloom.operators import lookup, wordpiece as wp
from tagloom.operators.piece_table import PieceTable
from tagloom.operators.trie import PieceTrie


class Colliding(PieceTable):
    """A seventh of all substrings that are no piece are proposed as the first one."""

    def _find(self, kind, keys):
        found = super()._find(kind, keys)
        return np.where((found < 0) & (keys % np.uint64(7) == 0) & (len(self.rows[kind]) > 0), 0, found)


@pytest.mark.parametrize("kind", [PieceTable, Colliding])
@pytest.mark.parametrize("letters", [["a", "b", "#", "é", "\U0001f600"], list("abc")])
def test_table_and_trie_agree(kind, letters):
    rnd = random.Random(5)
    for unk in ([], ["[UNK]"]) * 5:
        pieces = ["".join(rnd.choices(letters, k=rnd.randint(1, 4))) for _ in range(40)]
        pieces = [*unk, "##", "#", *pieces, *["##" + p for p in pieces[::2]], *pieces[:5]]
        tokens = ["".join(rnd.choices(letters, k=rnd.randint(0, 12))) for _ in range(300)]
        tokens += [None, "", letters[0] * 200, letters[0] * 201]
        table = pa.table({"piece": [*pieces, None, ""], "id": range(len(pieces) + 2)})
        trie = PieceTrie([(p, i) for i, p in enumerate(pieces)], "[UNK]")
        assert kind(table, "[UNK]").match(tokens, 200).to_pylist() == trie.match(tokens, 200).to_pylist()


def test_large_vocabulary_is_not_joined(spark, monkeypatch):
    """Above the size of a trie words are still matched where they are, with the same dictionary."""
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(["[UNK]", "ab", "##c", "-", "x"])], "piece string, id long")
    words = spark.createDataFrame([("Abc", 3), ("x-ab", 2), ("qq", 1), ("​", 1)], "word string, n long")
    small = sorted(map(str, wp.word_dictionary(words, vocab).collect()))
    monkeypatch.setattr(lookup, "is_small", lambda table, rows=0, size=0: rows > 250_000)

    def joined(*args):
        raise AssertionError("joined with all substrings")

    monkeypatch.setattr(wp, "_joined_wordpiece", joined)
    assert sorted(map(str, wp.word_dictionary(words, vocab).collect())) == small
