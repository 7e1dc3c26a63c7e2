import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import chunks


def frame(spark, seqs):
    rows = [(s, i, g, p) for s, pairs in enumerate(seqs) for i, (g, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "seq_id long, pos int, gold string, pred string")


def overall(df):
    r = df.where("level = 'overall'").first()
    return r["gold"], r["guessed"], r["correct"]


def spans(tags):
    """Chunks as (start, end, type), for tag sets where every chunk end shows."""
    out, start = set(), None
    for i, tag in enumerate([*tags, "O"]):
        prefix, _, kind = tag.partition("-")
        before, _, before_kind = (tags[i - 1] if i else "O").partition("-")
        joined = prefix in ("I", "E") and before in ("B", "I") and kind == before_kind
        if start is not None and not joined:
            out.add((start, i - 1, before_kind))
            start = None
        if prefix != "O" and not joined:
            start = i
    return out


def random_tags(rnd, prefixes, n):
    return [rnd.choice([*[f"{p}-{t}" for p in prefixes for t in "XY"], "O"]) for _ in range(n)]


@pytest.mark.parametrize("prefixes", ["BI", "BIES"])
def test_against_span_sets(spark, prefixes):
    rnd = random.Random(7)
    seqs = []
    for _ in range(400):
        n = rnd.randint(1, 9)
        gold = random_tags(rnd, prefixes, n)
        pred = [g if rnd.random() < 0.7 else rnd.choice(random_tags(rnd, prefixes, 3)) for g in gold]
        seqs.append(list(zip(gold, pred)))
    want = [0, 0, 0]
    for pairs in seqs:
        g, p = spans([a for a, _ in pairs]), spans([b for _, b in pairs])
        want = [want[0] + len(g), want[1] + len(p), want[2] + len(g & p)]
    df = frame(spark, seqs)
    assert overall(chunks.score(df, ["seq_id"])) == tuple(want)
    # A break row between sequences makes one stream equal to scoring them apart.
    closed = frame(spark, [[*pairs, ("O", "O")] for pairs in seqs])
    assert overall(chunks.score(closed, ["seq_id"], boundary="none")) == tuple(want)
    listed = chunks.chunk_spans(df, ["seq_id"])
    found = {tuple(r) for r in listed.collect()}
    assert found == {(s, *x) for s, pairs in enumerate(seqs) for x in spans([a for a, _ in pairs])}


@pytest.mark.parametrize(
    "gold,pred,want",
    [
        ("B-X I-X O", "B-X I-X O", (1, 1, 1)),
        ("B-X I-X", "B-X I-X", (1, 1, 1)),  # open at the end of the stream
        ("B-X I-Y", "B-X I-Y", (2, 2, 2)),  # a type change starts a chunk
        ("O I-X E-X", "O I-X O", (1, 1, 0)),
        ("S-X S-X", "S-X O", (2, 1, 1)),
        ("E-X E-X", "E-X E-X", (2, 2, 2)),
        ("[ ]", "[ ]", (2, 2, 2)),
        (". .", ". .", (0, 0, 0)),
        ("B-X . I-X", "B-X . I-X", (2, 2, 2)),
        ("U-X U-X", "U-X U-X", (1, 1, 1)),  # an unknown prefix starts by type change only
        ("O O", "O B-X", (0, 1, 0)),
        ("B-X", "B-Y", (1, 1, 0)),
    ],
)
def test_rules(spark, gold, pred, want):
    pairs = list(zip(gold.split(), pred.split()))
    assert overall(chunks.score(frame(spark, [pairs]), ["seq_id"])) == want
    assert overall(chunks.score(frame(spark, [pairs]), ["seq_id"], boundary="none")) == want


def test_stream_crosses_sequences(spark):
    df = frame(spark, [[("B-X", "B-X")], [("I-X", "I-X"), ("O", "O")]])
    assert overall(chunks.score(df, ["seq_id"], boundary="none")) == (1, 1, 1)
    assert overall(chunks.score(df, ["seq_id"])) == (2, 2, 2)


def test_stream_blocks(spark, monkeypatch):
    """Tiny blocks: chunks and states cross many block edges."""
    rnd = random.Random(3)
    gold = random_tags(rnd, "BIES", 500)
    pred = [g if rnd.random() < 0.8 else "O" for g in gold]
    df = frame(spark, [list(zip(gold, pred))])
    whole = overall(chunks.score(df, ["seq_id"]))
    monkeypatch.setattr(chunks, "BLOCK", 7)
    assert overall(chunks.score(df, ["seq_id"], boundary="none")) == whole


def test_metrics(spark):
    df = frame(spark, [[("O", "B-X"), ("B-Y", "O")]])
    rows = {r["type"]: r for r in chunks.score(df, ["seq_id"]).collect()}
    assert (rows["X"]["precision"], rows["X"]["recall"], rows["X"]["f1"]) == (0.0, 0.0, 0.0)
    assert (rows["Y"]["tp"], rows["Y"]["fp"], rows["Y"]["fn"]) == (0, 0, 1)
    assert rows[""]["accuracy"] == 0.0 and rows[""]["tokens"] == 2


def test_partition_invariance(spark):
    rnd = random.Random(5)
    seqs = [[(t, t if rnd.random() < 0.5 else "O") for t in random_tags(rnd, "BIES", 8)] for _ in range(60)]
    df = frame(spark, seqs)
    wants = sorted(map(tuple, chunks.score(df, ["seq_id"]).collect()))
    shuffled = df.orderBy(F.rand(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, chunks.score(shuffled, ["seq_id"]).collect())) == wants
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_unknown_boundary(spark):
    with pytest.raises(ValueError):
        chunks.score(frame(spark, [[("O", "O")]]), ["seq_id"], boundary="line")


def test_long_sequences_in_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    seqs = [[(t, t if rnd.random() < 0.7 else "O") for t in random_tags(rnd, "BIES", n)] for n in (300, 1, 40, 7)]
    df = frame(spark, seqs)
    want = overall(chunks.score(df, ["seq_id"]))
    monkeypatch.setattr(chunks, "BLOCK", 16)
    assert overall(chunks.score(df, ["seq_id"], boundary="long_sequence")) == want


def test_empty_stream_has_an_overall_row(spark):
    empty = spark.createDataFrame([], "s long, pos int, gold string, pred string")
    (row,) = chunks.score(empty, ["s"]).collect()
    assert (row["level"], row["gold"], row["guessed"], row["tokens"]) == ("overall", 0, 0, 0)
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0, 0, 0, 0)


@pytest.mark.parametrize("span", [1, 3, 256])
def test_streams_summed_in_blocks_equal_labelled_rows(spark, monkeypatch, span):
    monkeypatch.setattr(chunks, "SPAN", span)
    rng = random.Random(span)
    tags = ["O", "B-a", "I-a", "B-b", "I-b", "E-a"]
    rows = [
        (f, s, p, rng.choice(tags), rng.choice(tags), rng.random() < 0.1)
        for f in range(3) for s in rng.sample(range(20), 12) for p in range(rng.randint(1, 6))
    ]
    df = spark.createDataFrame(rows, "f int, s int, p int, gold string, pred string, is_break boolean")
    for seq, by, streams in ((["f", "s"], [], []), (["f", "s"], ["f"], []), (["f", "s"], [], ["f"])):
        labelled = chunks.chunk_counts(chunks.chunk_rows(df, seq, "p", "none", streams or by), by)
        summed = chunks.score(df, seq, "p", "none", by, streams)
        assert sorted(map(str, summed.select(labelled.columns).collect())) == sorted(map(str, labelled.collect()))


@pytest.mark.parametrize("size", [1, 3, 8, 1 << 16])
def test_spans_in_blocks(spark, size):
    """Blocks of any size, gaps between positions and an empty table give what one window a sequence gives."""
    rnd = random.Random(size)
    seqs = [random_tags(rnd, "BIES", n) for n in (1, 2, 5, 30, 90)]
    rows = [(s, i + (i // 7) * 20, g) for s, tags in enumerate(seqs) for i, g in enumerate(tags)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "s int, pos long, gold string").repartition(4)
    plain = chunks.chunk_spans(df, ["s"])
    cut = chunks.chunk_spans(df, ["s"], boundary="long_sequence", size=size)
    assert cut.columns == plain.columns
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    assert chunks.chunk_spans(df.limit(0), ["s"], boundary="long_sequence", size=size).count() == 0


def test_spans_of_one_sequence_without_keys(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(["B-X", "I-X", "O", "S-Y", "I-X", "E-X"])], "pos int, gold string")
    got = chunks.chunk_spans(df, [], boundary="long_sequence", size=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, "X"), (3, 3, "Y"), (4, 5, "X")]
    with pytest.raises(ValueError, match="unknown boundary"):
        chunks.chunk_spans(df, [], boundary="other")
