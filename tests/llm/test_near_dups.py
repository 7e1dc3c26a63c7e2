import random

import numpy as np
import pytest

from tagloom.llm import near_dups as nd
from tagloom.llm.components import components


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """Least id of the component of every id, by all pairs."""
    sets = {}
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = [(i, shingles(t or "")) for i, t in rows if i is not None]
    for i, a in held:
        for j, b in held:
            if a and b and len(a & b) / len(a | b) >= threshold:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] for _ in range(12)]
    for n in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((n, " ".join(words)))
    rows += [(200 + n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for n in range(60)]
    return rows


@pytest.mark.parametrize("few", [2, 12])
def test_classes_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(nd, "FEW", few)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r.class_id for r in nd.near_groups(df, "doc_id", "text").collect()}
    assert found == brute(rows)


def test_edge_rows(spark):
    same = "one two three four five six seven"
    rows = [
        (1, same, "x"), (2, same.replace(" ", "\n  "), "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"), (6, "one", "x"),
        (7, "one", "x"), (7, "one", "x"), (8, "two", "x"), (None, same, "x"), (9, "long " * 50_000, "x"), (10, "long " * 60_000, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    found = {r.id: r.class_id for r in nd.near_groups(df, "doc_id", "text").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, None: None, 9: 9, 10: 9}
    assert nd.near_groups(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_ids_link_their_classes(spark):
    a, b = "a b c d e f g", "t u v w x y z"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r.id: r.class_id for r in nd.near_groups(df, "doc_id", "text").collect()} == {1: 1, 2: 1, 3: 1}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300) * 0.5, rng.integers(1, 9, 300) * 0.5
    rows = np.repeat([0, 1], 300)
    k = 4096
    sig = nd.dart_signatures(rows, np.concatenate([items, items]), np.concatenate([a, b]), 2, k)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)
    assert (sig != 0).all()


def test_tiny_and_empty_sets_have_full_signatures():
    sig = nd.dart_signatures(np.array([0, 2]), np.array([5, 5], np.uint64), np.array([1.0, 1.0]), 3)
    assert (sig[0] == sig[2]).all() and (sig[0] != 0).all() and not sig[1].any()


def test_counted_shingles_tell_bags_apart(spark):
    once = " ".join(f"w{n}" for n in range(40))
    df = spark.createDataFrame([(1, once), (2, " ".join([once] * 3))], "doc_id long, text string")
    plain = {r.id: r.class_id for r in nd.near_groups(df, "doc_id", "text").collect()}
    bags = {r.id: r.class_id for r in nd.near_groups(df, "doc_id", "text", counted=True).collect()}
    assert plain == {1: 1, 2: 1} and bags == {1: 1, 2: 2}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(1000, 1100)]
    links += [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.id: r.component for r in components(df).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for x in list(parent)}
    assert components(df.limit(0)).count() == 0
