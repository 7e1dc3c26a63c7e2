import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators import chunks, training
from tagloom.schemas import FEATURES
from tagloom.sources import readers, writers
from tagloom.streaming.rows import stream_ids, stream_tokens
from tagloom.workspace import store


def put(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_tokens(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "\n\nthe\tO\textra\r\n cat\tB-X\n\n\nsat\tI-X\nbad\n")
    rows = readers.read_tokens(spark, path).orderBy("sent_id", "word_pos").collect()
    assert [(r["sent_id"], r["word_pos"], r["word"], r["label"]) for r in rows] == [
        (2, 0, "the", "O"), (2, 1, "cat", "B-X"), (4, 0, "sat", "I-X"), (4, 1, "bad", None)]
    assert [r["word"] for r in readers.malformed(readers.read_tokens(spark, path)).collect()] == ["bad"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    """A file read in many pieces keeps its line order."""
    put(tmp_path / "big.txt", "".join(f"line {i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = readers.read_lines(spark, str(tmp_path / "big.txt"))
        assert rows.select("block").distinct().count() > 3
        assert all(r["value"] == f"line {r['line_no']}" for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_sentences_over_many_blocks(spark, tmp_path, batch):
    """Sentence and word numbers where blocks, batches and runs of blank lines meet."""
    rnd = random.Random(3)
    wanted = set()
    for name in ("a.tsv", "b.tsv", "c.tsv"):
        lines = [rnd.choice(["", "", f"w{i}\tO", f"word{i}\tB-X"]) for i in range(900)]
        put(tmp_path / name, "\n".join(lines[: 0 if name == "b.tsv" else 900]))
        sent = pos = 0
        for line in lines if name != "b.tsv" else []:
            if line:
                wanted.add((name, sent, pos, line.split("\t")[0]))
                pos += 1
            else:
                sent, pos = sent + 1, 0
    sizes = {"spark.sql.files.maxPartitionBytes": "800", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    old = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        rows = readers.read_tokens(spark, str(tmp_path / "*.tsv")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == len(wanted)
    assert {(r["file"].rsplit("/", 1)[1], r["sent_id"], r["word_pos"], r["word"]) for r in rows} == wanted


def test_vocab_keeps_last_id(spark, tmp_path):
    path = put(tmp_path / "vocab.txt", "a\n b \nc\na\n")
    assert {r["piece"]: r["id"] for r in readers.read_vocab(spark, path).collect()} == {"a": 3, "b": 1, "c": 2}


def test_label_map(spark, tmp_path):
    path = put(tmp_path / "labels.txt", "O 0\nB-X 1\ntwo words 2\n\nX 3\n")
    assert {r["label"]: r["id"] for r in readers.read_label_map(spark, path).collect()} == {
        "O": 0, "B-X": 1, "two words": 2, "X": 3
    }


def test_histogram_round_trip(spark, tmp_path):
    path = str(tmp_path / "hist")
    first = spark.createDataFrame([(1, 10), (12, 3)], "n_pieces int, n_words long")
    writers.write_histogram(first, path)
    writers.write_histogram(first.where("n_pieces = 1"), path)  # only if absent
    assert {r["n_pieces"]: r["n_words"] for r in readers.read_histogram(spark, path).collect()} == {1: 10, 12: 3}


TAGGED = "a B-X B-X\nb I-X I-X\n-X- z z\nc I-X I-X\n\nd O O\n"


def test_tagged_stream(spark, tmp_path):
    path = put(tmp_path / "t.txt", TAGGED)
    rows = readers.read_tagged(spark, path)
    assert [r["is_break"] for r in rows.orderBy("line_no").collect()] == [False, False, True, False, True, False]
    for keys, pos in (([], "line_no"), (["block"], "mark")):
        top = chunks.score(rows, keys, pos, boundary="none", streams=["file"]).where("level = 'overall'").first()
        assert (top["gold"], top["guessed"], top["correct"], top["tokens"]) == (2, 2, 2, 4)
    assert readers.format_violations(rows).count() == 0


def test_format_checks(spark, tmp_path):
    path = put(tmp_path / "bad.txt", "\na B-X B-X\nb O\nc O O O\n")
    rows = readers.read_tagged(spark, path)
    assert sorted(r["line_no"] for r in readers.format_violations(rows).collect()) == [2, 3]
    with pytest.raises(Exception, match="unexpected number of columns"):
        readers.require_format(rows).collect()
    fine = readers.read_tagged(spark, put(tmp_path / "d.txt", "a|B-X|O\n\nb|O|O\n"), "|")
    assert [r["gold"] for r in readers.require_format(fine).orderBy("line_no").collect()] == ["B-X", "O", "O"]


def test_feature_store(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame([("train", 1, ["a"]), ("test", 2, ["b"])], "split string, pack_id long, piece_list array<string>")
    writers.features_if_missing(spark, path, lambda: df)
    kept = writers.features_if_missing(spark, path, lambda: pytest.fail("built twice"))
    assert {r["split"]: r["piece_list"] for r in kept.collect()} == {"train": None, "test": ["b"]}
    train = readers.read_features(spark, path, "train")
    assert set(train.columns) == set(FEATURES.names) - {"piece_list"} and train.count() == 1
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_predictions_round_trip(spark, tmp_path):
    path = put(tmp_path / "p.json", '[{"logits":[1,2],"labels":[1,2],"mask":[1,1],"is_start_label":[1,0],'
               '"piece_list":["a","##b"],"label_x":[1,9],"weight_focus_label":[1,9]}]')
    df = readers.read_predictions(spark, path)
    writers.write_predictions(df, str(tmp_path / "out"))
    assert readers.read_predictions(spark, str(tmp_path / "out"), multi_line=False).collect() == df.collect()


def test_small_writers(spark, tmp_path):
    tokens = spark.createDataFrame([("a", "test"), ("**NULL**", "test"), ("b", "train")], "token string, split string")
    writers.append_tokens(tokens, str(tmp_path / "tok"))
    writers.append_tokens(tokens, str(tmp_path / "tok"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "tok")).collect()] == ["a", "a"]
    writers.write_report(spark.createDataFrame([(2, "y"), (1, "x")], "line_no int, line string"), str(tmp_path / "rep"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rep")).collect()] == ["x", "y"]
    assert writers.preview(tokens, ["token"]).first()["value"] == '{"token":"**NULL**","split":"test"}'


def test_training_input(spark):
    rows = spark.range(10).select(F.col("id").alias("k"))
    kept = training.assign_batches(rows, ["k"], 4)
    assert sorted((r["k"], r["batch"]) for r in kept.collect()) == [(k, k // 4) for k in range(8)]
    assert training.assign_batches(rows, ["k"], 4, drop_last=False).count() == 10
    split = rows.withColumn("s", F.expr("k % 2"))
    assert training.assign_batches(split, ["k"], 2, ["s"]).count() == 8
    assert training.repeat_epochs(rows, 3).count() == 30
    order = [r["k"] for r in training.shuffle_order(rows, ["k"], 1).collect()]
    assert order != sorted(order) and order == [r["k"] for r in training.shuffle_order(rows.repartition(5), ["k"], 1).collect()]


@pytest.mark.parametrize(
    "records,mode,want",
    [(100, "combine", (62, 300)), (4000, "combine", (2500, 500)), (9000, "combine", (5625, 1000)), (10**6, "combine", (8000, 1000)),
     (100, "simple", (62, 500)), (10000, "simple", (6250, 1000)), (10**6, "simple", (30000, 2000))],
)
def test_step_budget(spark, records, mode, want):
    r = training.step_budget(spark.createDataFrame([(records,)], "records long"), 16, 10, mode).first()
    assert (r["steps"], r["save_steps"]) == want


def test_runs(spark):
    runs = spark.createDataFrame([(100, 1000, 0.1), (300, 1000, 0.5), (200, 1000, 0.4), (900, 1000, 0.2)], "step int, max_steps int, f1 double")
    assert [r["step"] for r in training.candidate_runs(runs).collect()] == [300, 900]
    assert training.last_run(runs).first()["step"] == 900


def test_context(spark):
    df = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "s int, pos int, v int")
    r = training.context_features(df, F.col("v"), (1, 2, 3), ["s"], "pos").orderBy("pos").collect()
    assert [x["ctx_3"] for x in r] == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 0]]
    assert [x["ctx_2"] for x in r] == [[1, 2], [2, 3], [3, 4], [4, 0]]
    assert r[2]["ctx_1"] == [3]


def test_stream_tokens(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src / "a.txt", "Héllo, you\nx\n")
    out = stream_tokens(spark.readStream.text(str(src)))
    run = out.writeStream.format("memory").queryName("tokens_out").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["token"] for r in spark.table("tokens_out").collect()) == sorted(["hello", ",", "you", "x"])


@pytest.mark.parametrize("small,heavy", [(10, False), (0, True)])
def test_stream_ids(spark, tmp_path, small, heavy):
    """A file stream against a vocabulary that is broadcast, or too large and with a hot piece."""
    src = tmp_path / "in"
    src.mkdir()
    put(src / "a.txt", "the cat the dog\nthe emu\n")
    vocab = [("the", 4, 90), ("cat", 5, 9), ("dog", 6, 1), ("rare", 7, 0)]
    vocab = store(spark.createDataFrame(vocab, "piece string, id long, n long"), "vocab")
    items = stream_tokens(spark.readStream.text(str(src))).withColumnRenamed("token", "piece")
    found = stream_ids(items, vocab, "n", batch_rows=1000, small=small, task_rows=300)
    name = f"ids_out_{small}"
    run = found.writeStream.format("memory").queryName(name).start()
    run.processAllAvailable()
    plan = run._jsq.explainInternal(False)
    put(src / "b.txt", "cat the\n")
    run.processAllAvailable()
    run.stop()
    ids = sorted((r["piece"], r["id"]) for r in spark.table(name).select("piece", F.coalesce("id", F.lit(-1)).alias("id")).collect())
    assert ids == [("cat", 5)] * 2 + [("dog", 6), ("emu", -1)] + [("the", 4)] * 4
    assert ("_copy" in plan) == heavy


def test_context_across_blocks(spark):
    df = spark.createDataFrame([(s, i, i * 3 % 7) for s in (0, 1) for i in range(50)], "s int, pos int, v int")
    whole = training.context_features(df, F.col("v"), (3, 7, 2), ["s"], "pos")
    cut = training.context_features(df, F.col("v"), (3, 7, 2), ["s"], "pos", block=5)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_label_map_keeps_last_line_and_spaces(spark, tmp_path):
    path = tmp_path / "labels.txt"
    path.write_text("O 0\nB-Y 1\nB Z 2\nB-Y 7\nno number\n\n")
    found = {r["label"]: r["id"] for r in readers.read_label_map(spark, str(path)).collect()}
    assert found == {"O": 0, "B-Y": 7, "B Z": 2}


def test_existing_label_map_wins(spark, tmp_path):
    path = str(tmp_path / "map")
    first = spark.createDataFrame([("O", 0), ("B", 1)], "label string, id int")
    for made in (first, first.withColumn("id", first.id + 5)):
        found = writers.label_map_if_missing(spark, path, lambda: made)
        assert {r["label"]: r["id"] for r in found.collect()} == {"O": 0, "B": 1}


def test_half_written_features_are_built_again(spark, tmp_path):
    path = tmp_path / "features"
    made = spark.createDataFrame([("test", 1, ["a"])], "split string, pack_id long, piece_list array<string>")
    assert writers.features_if_missing(spark, str(path), lambda: made).count() == 1
    (path / "_SUCCESS").unlink()
    built = []
    writers.features_if_missing(spark, str(path), lambda: built.append(1) or made)
    writers.features_if_missing(spark, str(path), lambda: built.append(1) or made)
    assert built == [1]


def test_invalid_bytes_go_and_replacement_characters_stay(spark):
    raw = "a\ufffdé".encode() + b"\xc3" + b"b\xff"
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary")
    assert df.select(text.utf8_text(F.col("raw"))).first()[0] == "a\ufffdéb"
