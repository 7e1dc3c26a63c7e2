import bisect
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing, tokens
from tagloom.llm.configurations import _best_fit, configurations, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
EXACT.encode_special_tokens = True
ENCODER = tokens.Encoder(Path(PATH).read_text())


def ids(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def mine(text):
    return np.frombuffer(ENCODER.encode(text), np.uint32).tolist()


BITS = [" ", "  ", "\n", "\t", "　", "a", "foo", "'s", "'", "don't", "é", "12", "!?", "<|endoftext|>", "日本", " x", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(BITS), max_size=30).map("".join)))
def test_ids_equal_the_library(text):
    assert mine(text) == ids(text)


DEFAULT = Tokenizer.from_file(PATH)
ADDED = tokens.Encoder(Path(PATH).read_text(), added=True)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(BITS), max_size=30).map("".join)))
def test_ids_equal_the_library_as_it_is(text):
    assert np.frombuffer(ADDED.encode(text), np.uint32).tolist() == DEFAULT.encode(text, add_special_tokens=False).ids


def test_pack_knows_added_tokens(spark):
    text = "a <|endoftext|> b<|endoftext|><|endoftext|>"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = packing.pack(df, "doc_id", "text", PATH, keep_ids=True).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [64, 220, 50256, 275, 50256, 50256, 0]
    assert DEFAULT.encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275, 50256, 50256]


def test_long_texts_are_cut_where_tokens_are(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 16)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(60))
        assert mine(text) == ids(text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_configurations_hold_every_piece_once(counts):
    histogram = np.zeros(65, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    made = configurations(histogram, 64)
    seen = Counter()
    for lengths, times in made:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            seen[n] += times
    assert seen == Counter({n: c for n, c in counts.items()})
    plain = sum(times for _, times in _best_fit(Counter(), histogram.copy(), 64))
    assert sum(times for _, times in made) <= plain + 1


def test_configurations_reach_the_volume_bound():
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.clip(rng.gamma(1.5, 300, 20_000).astype(int), 1, 2048), minlength=2049)
    bins = sum(times for _, times in configurations(histogram, 2048))
    assert bins <= -(-int((histogram * np.arange(2049)).sum()) // 2048) + 1


def best_fit_piece_by_piece(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(rooms, length)
            room = rooms.pop(at) if at < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_best_fit_in_groups_equals_piece_by_piece(counts):
    histogram = np.zeros(65, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    made = _best_fit(Counter(), histogram, 64)
    assert Counter(n for config, times in made for n in config for _ in range(times)) == Counter(counts)
    assert sum(times for _, times in made) == best_fit_piece_by_piece(counts, 64)


@pytest.mark.parametrize(
    "counts, capacity, most",
    [
        ({500: 8000, 1100: 8000}, 2048, 8000),
        ({512: 8000, 1100: 8000}, 2048, 8000),
        ({16: 80_000, 33: 80_000}, 64, 80_000),
        ({22: 100_000, 30: 100_000, 12: 100_000}, 64, 100_000),  # best fit alone: 110,000
    ],
)
def test_few_lengths_reach_the_optimum(counts, capacity, most):
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    bins, bound = plan(histogram, capacity)
    assert sum(times for _, times in bins) == most and bound <= most + 1e-6


def test_bins_are_near_the_dual_bound():
    rng = np.random.default_rng(3)
    for _ in range(12):
        histogram = np.zeros(65, np.int64)
        histogram[rng.choice(np.arange(4, 40), 8, replace=False)] = rng.integers(1000, 100_000, 8)
        bins, bound = plan(histogram, 64)
        total = sum(times for _, times in bins)
        assert bound - 1e-6 <= total <= 1.006 * bound + 8
        assert sum(c * n for c, n in enumerate(histogram)) == sum(sum(config) * times for config, times in bins)


def test_no_step_for_each_piece():
    rng = np.random.default_rng(4)
    histogram = np.bincount(rng.integers(1030, 1900, 3_000_000), minlength=2049)
    start = time.process_time()
    bins = _best_fit(Counter(), histogram * 1000, 2048)
    assert sum(times for _, times in bins) == 3_000_000_000 and time.process_time() - start < 1


def check(rows, docs, capacity):
    """Pieces rebuild every document, places are gapless and within the capacity."""
    by_sequence, by_doc = {}, Counter()
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    expected = Counter()
    for i, text in docs:
        whole = [*ids(text or ""), 0]
        cuts = list(range(len(whole), 0, -capacity))[::-1]
        for piece, end in enumerate(cuts):
            start = max(0, end - capacity)
            start = 0 if piece == 0 else start
            crc = zlib.crc32(np.array(whole[start:end], "<u4").tobytes())
            expected[i, piece, start, end - start, crc] += 1
    assert by_doc == expected


@pytest.mark.parametrize("ranked", [100_000, 3])
def test_pack(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rng = random.Random(1)
    docs = [(n, " ".join(rng.choice(["alpha", "beta", "x", "yy\n"]) for _ in range(rng.randint(0, 80)))) for n in range(80)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 3000), (7, docs[7][1]), (7, "other"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, piece int")
    check(packing.pack(df, "doc_id", "text", PATH, 64).collect(), docs, 64)
    assert packing.pack(df.limit(0), "doc_id", "text", PATH, 64).count() == 0


def test_ids_are_kept_on_demand(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    (row,) = packing.pack(df, "doc_id", "text", PATH, keep_ids=True).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [*ids("one two three"), 0]
