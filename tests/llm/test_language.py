import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import language, queries


def brute_posteriors(emissions, transitions):
    """Forward-backward over one sequence, word by word."""
    move, emit = np.exp(transitions), np.exp(emissions)
    n, s = emit.shape
    a, b = np.zeros((n, s)), np.ones((n, s))
    a[0] = (np.full(s, 1 / s) @ move) * emit[0]
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * emit[t]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = move @ (emit[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b
    return g / g.sum(axis=1, keepdims=True)


def test_blocks_equal_word_by_word():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 31, 32, 33, 200, 0, 64, 5]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    emissions, transitions = rng.normal(0, 3, (ends[-1], 3)), rng.normal(0, 1, (3, 3))
    found = language.posteriors(emissions, ends, transitions)
    for a, b in zip(ends[:-1], ends[1:]):
        if b > a:
            assert np.allclose(found[a:b], brute_posteriors(emissions[a:b], transitions), atol=1e-9)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    parts = {"xx": ["ka", "ko", "ki", "tak"], "yy": ["lum", "lem", "na", "ro"]}
    texts, langs = [], []
    for lang, syllables in parts.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(40)))
            langs.append(lang)
    return language.fit(texts, langs)


def test_switches_inside_a_text(spark, model):
    df = spark.createDataFrame([(1, "kakoki tak koka kita naro lumna rolem lemlum")], "doc_id long, text string")
    found = sorted(tuple(r) for r in language.segments(df, "doc_id", "text", model).collect())
    assert found == [(1, 0, 4, "xx"), (1, 4, 4, "yy")]
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


def test_edge_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !? ²", "c"), (4, "kako", "d"), (4, "kako", "d"), (None, "lumna", "e"), (5, "tak " * 200_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = language.predict(df, "doc_id", "text", model).collect()
    got = sorted(((r.id or 0, r.lang_pred, r.n_words) for r in found))
    assert got == [(0, "yy", 1), (1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "xx", 1), (4, "xx", 1), (5, "xx", 200_000)]
    assert all(0 <= r.score <= 1 for r in found)
    whole = language.predict(df, "doc_id", "text", model, whole_rows=True)
    assert {r.row.score for r in whole.collect()} == set("abcdef")
    assert language.predict(df.limit(0), "doc_id", "text", model).count() == 0
    assert [r.lang_pred for r in language.predict(df, "doc_id", "text", None).collect()] == ["und"] * len(rows)


def test_sample_is_bounded_and_keeps_out_what_is_held_out(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("doc "), "id").alias("text"),
        F.when(F.col("id") % 10 == 0, None).otherwise(F.when(F.col("id") % 3 == 0, "aa").otherwise("bb")).alias("lang"),
    )
    sample = language.training_sample(df, "doc_id", "text", "lang", ~queries.held_out(), most=20).collect()
    assert sorted(r.lang for r in sample) == ["aa"] * 20 + ["bb"] * 20
    out = {f"doc {r.doc_id}" for r in df.where(queries.held_out()).collect()}
    assert not out & {r.text for r in sample}
    assert language.train(language.training_sample(df.limit(0), "doc_id", "text", "lang", F.lit(True))) is None


def test_held_out_accuracy(spark, sf_dir):
    found = queries.op6_language(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
