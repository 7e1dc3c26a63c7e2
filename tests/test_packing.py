import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from tagloom.operators import features, packing


def sequential(sizes, limit, keep_empty):
    """Packs as lists of (sentence, first piece, pieces)."""
    packs, fill = [[]], 0
    for i, n in enumerate(sizes):
        if n > limit:
            if not keep_empty and not packs[-1]:
                packs.pop()
            packs += [[(i, at, min(limit, n - at))] for at in range(0, n, limit)] + [[]]
            fill = 0
        elif fill + n > limit:
            packs.append([(i, 0, n)])
            fill = n
        else:
            packs[-1].append((i, 0, n))
            fill += n
    return packs


def run(spark, shards, limit, keep_empty=True, **blocks):
    rows = [(s, i, n) for s, sizes in enumerate(shards) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "shard int, sent_id long, n long").orderBy(F.rand(3))
    placed = packing.pack_sentences(df, limit, ["shard"], keep_empty, **blocks)
    return packing.oversize_chunks(placed, limit).collect()


def expected(shards, limit, keep_empty):
    out = set()
    for s, sizes in enumerate(shards):
        for p, pack in enumerate(sequential(sizes, limit, keep_empty)):
            at = 0
            for i, first, size in pack:
                out.add((s, i, p, at, first, size))
                at += size
    return out


def found(rows):
    return {(r["shard"], r["sent_id"], r["pack_id"], r["offset"], r["first"], r["size"]) for r in rows}


CASES = [[3, 5], [3, 6], [20, 1], [2, 20, 17, 3], [16], [8, 8, 1], [1] * 20, [9, 16, 24, 8]]


@pytest.mark.parametrize("keep_empty", [True, False])
def test_cases(spark, keep_empty):
    assert found(run(spark, CASES, 8, keep_empty)) == expected(CASES, 8, keep_empty)


@pytest.mark.parametrize("keep_empty", [True, False])
def test_one_long_shard_in_blocks(spark, keep_empty):
    """Blocks and groups of blocks far smaller than the shard."""
    rnd = random.Random(11)
    shards = [[rnd.choice([1, 2, 3, 5, 8, 9, 30]) for _ in range(n)] for n in (700, 40, 3)]
    got = found(run(spark, shards, 8, keep_empty, block=16, fan=4))
    assert got == expected(shards, 8, keep_empty)


def test_without_shard(spark):
    sizes = [random.Random(2).randint(1, 9) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sizes)), "sent_id long, n long")
    placed = packing.pack_sentences(df, 8, block=32, fan=2)
    got = {(0, *k) for k in ((r["sent_id"], r["pack_id"], r["offset"], r["first"], r["size"])
                             for r in packing.oversize_chunks(placed, 8).collect())}
    assert got == expected([sizes], 8, True)


def test_empty_packs_are_marked(spark):
    rows = run(spark, [[20, 20, 1]], 8)
    assert [(r["pack_id"], r["empty_before"]) for r in sorted(rows, key=lambda r: r["pack_id"]) if r["chunk"] == 0] == [
        (1, True), (5, True), (8, False)]


PIECE = "struct<piece:string,id:bigint,start:int,focus:int,weight:double>"


def tokenized(spark, sentences):
    """``sentences[s]`` is a list of (label, [weights]) words; ids count up."""
    rows, ident = [], 100
    for s, words in enumerate(sentences):
        for w, (label, weights) in enumerate(words):
            ps = []
            for k, weight in enumerate(weights):
                ps.append((f"p{ident}", ident, int(k == 0), int(weight == max(weights) and weights.index(weight) == k), weight))
                ident += 1
            rows.append((0, s, w, label, ps))
    return spark.createDataFrame(rows, f"shard int, sent_id long, word_pos int, label int, pieces array<{PIECE}>")


CFG = features.FeatureConfig(max_len=8, x_id=9)


def test_assembled_arrays(spark):
    df = tokenized(spark, [[(1, [0.25, 0.75]), (2, [1.0])], [(3, [1.0])]])
    r = features.build_features(df, CFG, ["shard"]).collect()
    assert len(r) == 1
    r = r[0]
    assert r["input_ids"] == [3, 100, 101, 102, 103, 4, 0, 0]
    assert r["input_mask"] == [1, 1, 1, 1, 1, 1, 0, 0]
    assert r["segment_ids"] == [0] * 8
    assert r["label_ids"] == [0, 1, 1, 2, 3, 0, 0, 0]
    assert r["is_start_label"] == [1, 1, 0, 1, 1, 1, 0, 0]
    assert r["words_label"] == [0, 1, 2, 3, 0, 0, 0, 0]
    assert r["label_x"] == [0, 1, 9, 2, 3, 0, 0, 0]
    assert r["is_weight_focus"] == [0, 9, 1, 2, 3, 0, 0, 0]
    assert r["label_x_mask"] == [1, 1, 0, 1, 1, 1, 0, 0]
    assert r["weight_focus_mask"] == [1, 0, 1, 1, 1, 1, 0, 0]
    assert r["weight_matrix_mask"] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert r["piece_list"] == ["[CLS]", "p100", "p101", "p102", "p103", "[SEP]", "[PAD]", "[PAD]"]


def test_oversize_and_empty_pack(spark):
    df = tokenized(spark, [[(1, [0.1] * 4), (2, [0.1] * 4)]])
    rows = sorted(features.build_features(df, CFG, ["shard"]).collect(), key=lambda r: r["pack_id"])
    assert [sum(r["input_mask"]) for r in rows] == [2, 8, 4]  # an empty pack, a full one, the rest
    assert rows[1]["words_label"] == [0, 1, 2, 0, 0, 0, 0, 0]
    assert rows[2]["is_start_label"] == [1, 0, 0, 1, 0, 0, 0, 0]  # begins inside a word
    assert rows[2]["words_label"] == [0] * 8


def test_simple_mode(spark):
    df = tokenized(spark, [[(1, [0.1] * 5), (2, [0.5, 0.5])], [(3, [1.0])]])
    rows = sorted(features.build_features(df, CFG, ["shard"], "simple").collect(), key=lambda r: r["pack_id"])
    assert [sum(r["input_mask"]) for r in rows] == [8, 3]
    assert rows[0]["words_label"] == [0, 1, 2, 0, 0, 0, 0, 0]
    bad = features.feature_violations(features.build_features(df, CFG, ["shard"], "simple"), ["pack_id"], CFG)
    assert bad.count() == 0
    with pytest.raises(ValueError):
        features.build_features(df, CFG, ["shard"], "other")


def matrix(spark, words, parity):
    packs = features.pack_combined(features.sentence_pieces(tokenized(spark, [words]), ["shard", "sent_id"]), CFG, ["shard"])
    cells = features.weight_matrix(packs, ["shard", "pack_id"], parity)
    return sorted((r["word_idx"], r["piece_pos"], r["w"]) for r in cells.collect()), cells


def test_weight_matrix(spark):
    words = [(1, [0.25, 0.75]), (2, [1.0, 0.5]), (3, [0.5, 0.5])]
    plain, cells = matrix(spark, words, False)
    assert plain == [(0, 0, 1.0), (1, 1, 0.25), (1, 2, 0.75), (2, 3, 1.0), (2, 4, 0.5), (3, 5, 0.5), (3, 6, 0.5)]
    # A piece of weight 1 closes its row; the last row, of two pieces, is not kept.
    assert matrix(spark, words, True)[0] == [(0, 0, 1.0), (1, 1, 0.25), (1, 2, 0.75), (2, 3, 1.0), (3, 4, 0.5)]
    assert matrix(spark, [(1, [1.0])], True)[0] == [(0, 0, 1.0), (1, 1, 1.0)]
    flat = features.dense_matrix(cells, ["shard", "pack_id"], 8).first()["weight_matrix"]
    assert len(flat) == 64 and {(i // 8, i % 8, v) for i, v in enumerate(flat) if v} == set(plain)


def test_sentence_longer_than_a_part(spark, monkeypatch):
    """Parts of three words give the same sequences as whole sentences."""
    rnd = random.Random(6)
    sentences = [[(rnd.randint(0, 3), [0.5] * rnd.randint(1, 3)) for _ in range(n)] for n in (40, 2, 1, 17, 5)]
    df = tokenized(spark, sentences)

    def built(mode):
        rows = features.build_features(df, CFG, ["shard"], mode).drop("piece_weights")
        return sorted(map(str, rows.collect()))

    whole = [built("combine"), built("simple")]
    monkeypatch.setattr(features, "PART_WORDS", 3)
    assert [built("combine"), built("simple")] == whole
    monkeypatch.setattr(features, "BLOCK", 2)  # the scan in blocks instead of one window
    assert [built("combine"), built("simple")] == whole


@pytest.mark.parametrize("keep_empty", [True, False])
@pytest.mark.parametrize("shard", [["d"], []])
def test_sparse_ids_and_deep_levels(spark, keep_empty, shard):
    """50-bit ids with gaps, three levels of tables."""
    rng = np.random.default_rng(6)
    ids = np.sort(rng.choice(1 << 50, 300, replace=False))
    sizes = rng.choice([1, 2, 3, 9, 25], 300)
    df = spark.createDataFrame([(1, int(i), int(n)) for i, n in zip(ids, sizes)], "d long, sent_id long, n long")
    dense = spark.createDataFrame([(1, k, int(n)) for k, n in enumerate(sizes)], "d long, sent_id long, n long")
    columns = ["pack_id", "offset", "empty_before"]
    got, plain = (
        [tuple(r) for r in packing.pack_sentences(x, 10, shard, keep_empty, block=b, fan=f).orderBy("sent_id").select(columns).collect()]
        for x, b, f in ((df, 4, 3), (dense, 1000, 1000))
    )
    assert got == plain


def step_by_step(sizes, fill, pack, limit, keep_empty):
    out = []
    for n in sizes:
        if n > limit:
            first = pack + (1 if keep_empty or fill else 0)
            out.append((first, 0, fill == 0))
            fill, pack = 0, first - (-n // limit)
        else:
            if fill + n > limit:
                fill, pack = 0, pack + 1
            out.append((pack, fill, False))
            fill += n
    return out, fill, pack


@pytest.mark.parametrize("keep_empty", [True, False])
def test_linked_packs_equal_single_steps(keep_empty):
    """Several groups at once, from any fill; and the table of all fills."""
    rnd = random.Random(4)
    for _ in range(300):
        limit = rnd.randint(1, 12)
        groups = [[rnd.choice([1, 1, 2, 3, 5, 9, 13, 30]) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        fills = [rnd.randint(0, limit) for _ in groups]
        opened = [rnd.randint(0, 50) for _ in groups]
        sizes = np.array([n for g in groups for n in g])
        firsts = np.cumsum([0, *map(len, groups)])[:-1]
        packs, offsets, empties, fill, pack = packing._fill(
            sizes, firsts, np.array(fills), np.array(opened), limit, keep_empty
        )
        wanted = [step_by_step(*g, limit, keep_empty) for g in zip(groups, fills, opened)]
        assert list(zip(packs, offsets, empties)) == [x for out, _, _ in wanted for x in out]
        assert (fill, pack) == wanted[-1][1:]
        table, used = packing._block_table(np.array(groups[0]), limit, keep_empty)
        for f in range(limit + 1):
            assert (table[f], used[f]) == step_by_step(groups[0], f, 0, limit, keep_empty)[1:]


def test_weight_matrix_numbers_words_inside_the_record(spark):
    """No exchange or sort for the words of a record; a record without pieces has its opening mark."""
    kind = "s int, ps array<struct<start:int,weight:double>>"
    df = spark.createDataFrame([(1, [(0, 0.5), (1, 0.25), (0, None), (1, 1.0)]), (2, []), (3, None), (None, [(1, 1.0)])], kind)
    cells = features.weight_matrix(df, ["s"])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = sorted((r["s"] or 0, r["word_idx"], r["piece_pos"], r["w"]) for r in cells.collect())
    assert got == [(0, 0, 0, 1.0), (0, 1, 1, 1.0), (1, 0, 0, 1.0), (1, 1, 2, 0.25), (1, 1, 3, None), (1, 2, 4, 1.0), (2, 0, 0, 1.0)]
