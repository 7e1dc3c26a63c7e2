"""What travels and what is written by the queries over packed sentences."""

import re

import pytest
from conftest import one
from pyspark.sql import functions as F

from tagloom.functions.arrays import from_line, to_line
from tagloom.operators import chunks, evaluate, features, word_lists
from tagloom.operators import wordpiece as wp
from tagloom.plans import registry

PIECE = "array<struct<piece:string,id:bigint,start:int,focus:int,weight:double>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entry(*names):
    return [(n, len(n), int(i == 0), int(i == 0), 1.0 / len(names)) for i, n in enumerate(names)]


def dictionary(spark):
    words = [("a", 4, entry("a")), ("bc", 3, entry("b", "##c")), ("x\ny", 1, entry("x", "\n", "y")), ("", 1, [])]
    return spark.createDataFrame(words, f"word string, n bigint, pieces {PIECE}")


def test_lines_hold_any_text(spark):
    values = [(["a", "b"],), ([""],), ([],), (None,), (["", ""],), (["a\nb", "c"],), ([None, "c"],), (["\0[]", "c"],), (["é\\", '"'],)]
    assert one(spark, "a array<string>", values, from_line(to_line(F.col("a")))) == values


@pytest.mark.parametrize("held", [True, False])
def test_lists_of_words_are_looked_up_like_words(spark, monkeypatch, held):
    """Same parts whether words come one by one or in lists; repeated and null keys, null words and labels included."""
    monkeypatch.setattr(features, "PART_WORDS", 3)
    monkeypatch.setattr(word_lists, "is_small", lambda table, *_: held)
    sentences = [
        (1, 0, ["a", "bc", "", None, "x\ny", "a", "bc"], [1, 2, 3, 4, None, 6, 7]),
        (1, 1, ["bc"], [5]), (2, 0, ["", None], [1, 1]), (2, 1, [], []),
        (3, 0, ["bc", "a"], [2, 1]), (3, 0, ["a", "a"], [1, 1]), (None, 0, ["a"], [9]), (None, 0, ["bc", "a"], [None, 8]),
    ]
    rows = spark.createDataFrame(sentences, "doc_id int, sent_id int, word array<string>, label array<int>")
    keys = ["doc_id", "sent_id"]
    parts = word_lists.word_parts(rows, keys, 3)
    made = features.sentence_pieces(wp.tokenize(parts, dictionary(spark), near=["doc_id"]), keys)
    each = rows.select(*keys, F.posexplode(F.arrays_zip("word", "label")).alias("word_pos", "w")).select(*keys, "word_pos", "w.*")
    want = features.sentence_pieces(wp.tokenize(each, dictionary(spark)), keys)
    assert made.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect())) and made.count() == 6


def test_a_word_without_an_entry_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, ["a", "lost"], [1, 1], None)], "doc_id int, part bigint, word array<string>, label array<int>, word_pos array<int>")
    for held in (True, False):
        monkeypatch.setattr(word_lists, "is_small", lambda table, *_: held)
        with pytest.raises(Exception, match="word not in the dictionary: lost"):
            wp.tokenize(rows, dictionary(spark)).collect()


def test_a_word_is_looked_up_once_a_group(spark, monkeypatch):
    """No occurrence is exchanged: a group of rows asks for each of its words once."""
    monkeypatch.setattr(word_lists, "is_small", lambda table, *_: False)
    seen = {}
    keep = word_lists.store
    monkeypatch.setattr(word_lists, "store", lambda df, name: seen.setdefault(name, keep(df, name)))
    rows = spark.range(100).selectExpr("id % 4 AS doc_id", "array_repeat('a', 500) AS word")
    made = wp.tokenize(rows, dictionary(spark), near=["doc_id"])
    assert seen["asked"].count() <= 4 and made.agg(F.sum(F.size("pieces"))).first()[0] == 50_000
    assert "SortMergeJoin" not in plan(made) and "BroadcastHashJoin" not in plan(made)


def test_only_fields_that_are_read_travel(spark, sf_dir):
    """Scores need two fields of the pieces, weights two others; texts stay in the files."""
    for name, wanted in (("eval_x", {"label", "start"}), ("word_pool", {"start", "weight"}), ("weight_matrix_parity", {"start", "weight"})):
        found = plan(registry.QUERIES[name](spark, sf_dir))
        read = re.findall(r"ReadSchema: struct<[^\n]*ps:array<struct<([^>]*)>>", found)
        assert read and all({f.split(":")[0] for f in r.split(",")} == wanted for r in read), (name, read)


def test_a_stream_is_exchanged_once(spark):
    """Records of a stream are scored in one pass over blocks that already lie together."""
    n = chunks.SPAN + 5
    rows = [(1, i, [0, i % 3, 1, 0], [0, 1, 2 - i % 3, 0], [1] * 4, [0, 1, 1, 0], ["[CLS]", "a", "b", "[SEP]"], [0, 1, 2 - i % 3, 0], [9] * 4) for i in range(n)]
    kind = ", ".join(f"{c} array<{'string' if c == 'piece_list' else 'int'}>" for c in evaluate.FIELDS)
    preds = spark.createDataFrame(rows, f"d int, s int, {kind}")
    labels = spark.createDataFrame([("O", 0), ("B-T", 1), ("I-T", 2), ("X", 9)], "label string, id int")
    made = evaluate.score_predictions(preds, labels, "X", ["d", "s"], "none")
    tags = evaluate.tag_rows(preds, labels, "X", ["d", "s"])
    want = chunks.add_metrics(chunks.chunk_counts(chunks.chunk_rows(tags, ["d", "s"], "pos", "none")))
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))
    near = evaluate.tag_rows(preds.withColumn("_blk", F.expr(f"s div {chunks.SPAN}")), labels, "X", ["d", "s"], near=["d", "_blk"])
    seen = {}
    keep = chunks.store
    try:
        chunks.store = lambda df, name: seen.setdefault(name, plan(df)) and keep(df, name)
        chunks.score(near, ["d", "s"], "pos", "none", blocks="_blk")
    finally:
        chunks.store = keep
    keyed = [k for k in re.findall(r"hashpartitioning\(([^)]*)\)", seen["cells"]) if "gt#" not in k]
    assert len(keyed) == 1 and "_blk" in keyed[0]
