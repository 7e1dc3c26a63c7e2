import random

import numpy as np
import pytest

from tagloom.llm import decontaminate as dc
from tagloom.llm.buffers import U64, mix


def naive_tiles(a, b, least):
    """Greedy string tiling by comparing all places."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, matches = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, [(i, j)]
                elif n == best:
                    matches.append((i, j))
        if not matches:
            return sorted(out)
        for i, j in matches:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_equal_naive_ones():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randint(0, 2) for _ in range(rng.randint(0, n))] for n in (30, 20))
        least = rng.randint(2, 4)
        runs = [dc.running_hashes(mix(np.array(x, np.uint64) + U64(9)), least) for x in (a, b)]
        i, j = np.nonzero(runs[0][:, None] == runs[1][None, :])
        assert sorted(dc.tiles(i, j, len(a), len(b), least)) == naive_tiles(a, b, least)


ITEM = "The quick brown fox jumps over the lazy dog. Pack my box with five dozen liquor jugs, says the wizard."


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_BYTES, 0])
def test_leaks(spark, broadcast):
    words = ITEM.lower().replace(".", "").replace(",", "").split()
    moved = " ".join(words[9:]) + " something else in between " + " ".join(words[:9])
    half = " ".join(words[:9])  # 9 of 20 words
    rows = [
        (1, f"before {ITEM} after"), (2, ITEM.upper()), (3, moved), (4, half), (5, " ".join(sorted(words))), (6, None), (7, ""),
        (8, f"{ITEM} {ITEM}"), (8, f"{ITEM} {ITEM}"), (None, ITEM), (9, "filler words " * 100_000 + ITEM), (10, "quick brown fox"),
    ]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, coverage double")
    items = [(1, ITEM), (2, None), (3, "too short"), (4, ""), (None, ITEM), (5, "one two three four five six seven")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.leaks(docs, "doc_id", "text", bench, broadcast_bytes=broadcast).collect()
    got = sorted((r.id or 0, r.item_id, r.item_words, r.matched_words, r.n_tiles) for r in found)
    assert got == [(0, 1, 20, 20, 1), (1, 1, 20, 20, 1), (2, 1, 20, 20, 1), (3, 1, 20, 20, 2), (8, 1, 20, 20, 1), (8, 1, 20, 20, 1), (9, 1, 20, 20, 1)]
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert dc.leaks(a, "doc_id", "text", b, broadcast_bytes=broadcast).count() == 0


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_BYTES, 0])
def test_many_words_of_a_long_item(spark, broadcast):
    words = [f"w{n}" for n in range(2000)]
    docs = spark.createDataFrame([(n, " ".join(words[:n])) for n in (900, 50, 49)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = dc.leaks(docs, "doc_id", "text", bench, broadcast_bytes=broadcast).collect()
    assert sorted((r.id, r.matched_words, r.coverage) for r in found) == [(50, 50, 0.025), (900, 900, 0.45)]


def test_both_ways_agree(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (
        sorted(map(tuple, dc.leaks(docs, "doc_id", "text", bench, coverage=0.1, broadcast_bytes=n).collect()))
        for n in (dc.BROADCAST_BYTES, 0)
    )
    assert a == b and a


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_BYTES, 0])
def test_short_and_equal_items(spark, broadcast):
    rows = [(1, "say: Too  short, really"), (2, "too"), (3, "short too"), (4, "a b c d too short too short"), (4, "a b c d too short too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "too short"), (2, "really"), (3, "a b c d"), (3, "a b c d"), (4, "a b c d too"), (4, "a b c d too")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(map(tuple, dc.leaks(docs, "doc_id", "text", bench, broadcast_bytes=broadcast).collect()))
    four = [(4, 1, 2, 2, 1, 1.0), (4, 3, 4, 4, 1, 1.0), (4, 3, 4, 4, 1, 1.0), (4, 4, 5, 5, 1, 1.0), (4, 4, 5, 5, 1, 1.0)]
    assert found == sorted([(1, 1, 2, 2, 1, 1.0), (1, 2, 1, 1, 1, 1.0), *four, *four])
