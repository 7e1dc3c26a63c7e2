import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import labels, lookup
from tagloom.operators import wordpiece as wp


def vocab_of(spark, *pieces):
    return spark.createDataFrame([(p, i) for i, p in enumerate(["[UNK]", *pieces])], "piece string, id long")


def pieces_of(spark, vocab, *tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    rows = wp.wordpiece(df, vocab).collect()
    return {r["token"]: [p["piece"] for p in r["pieces"]] for r in rows}


def test_greedy(spark):
    v = vocab_of(spark, "un", "##aff", "##able", "##a", "a", "##af", "unab", "##b")
    got = pieces_of(spark, v, "unaffable", "unaffablx", "", "a" * 200, "a" * 201, "una")
    assert got["unaffable"] == ["un", "##aff", "##able"]
    assert got["unaffablx"] == ["[UNK]"]  # unmatched tail
    assert got[""] == []
    assert got["a" * 200] == ["a"] + ["##a"] * 199
    assert got["a" * 201] == ["[UNK]"]
    assert got["una"] == ["un", "##a"]


def test_greedy_does_not_back_up(spark):
    v = vocab_of(spark, "ab", "abc", "##cd")
    assert pieces_of(spark, v, "abcd")["abcd"] == ["[UNK]"]


def brute(token, vocab):
    out, at = [], 0
    while at < len(token):
        ends = [e for e in range(at + 1, len(token) + 1) if ("##" if at else "") + token[at:e] in vocab]
        if not ends:
            return ["[UNK]"]
        out.append(("##" if at else "") + token[at : max(ends)])
        at = max(ends)
    return out


@pytest.mark.parametrize("small", [10**6, 0])
def test_random_words(spark, monkeypatch, small):
    """Broadcast and spread vocabularies give the same pieces as a plain loop."""
    monkeypatch.setattr(lookup, "is_small", lambda *a: small > 0)
    monkeypatch.setattr(lookup.lookup, "__defaults__", ("left", None, small, 20))
    rnd = random.Random(4)
    pieces = {("##" if rnd.random() < 0.5 else "") + "".join(rnd.choices("abc", k=rnd.randint(1, 3))) for _ in range(25)}
    tokens = {"".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(400)}
    got = pieces_of(spark, vocab_of(spark, *sorted(pieces)), *tokens)
    assert got == {t: brute(t, pieces) for t in tokens}


def test_trie_and_join_agree(spark):
    """Nulls, empty and long tokens, marks inside tokens, repeated pieces, wide characters, extra columns."""
    rnd = random.Random(8)
    letters = ["a", "b", "#", "é", "\U0001f600"]
    pieces = ["".join(rnd.choices(letters, k=rnd.randint(1, 4))) for _ in range(40)]
    pieces = ["[UNK]", "##", "#", *pieces, *["##" + p for p in pieces[::2]], *pieces[:5]]
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id long")
    tokens = {"".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(500)} | {"", "a" * 200, "a" * 201}
    rows = [(t, i) for i, t in enumerate(sorted(tokens))] + [(None, -1)]
    df = spark.createDataFrame(rows, "token string, s int").repartition(3)
    by_trie = {r["token"]: (r["s"], [tuple(p) for p in r["pieces"]]) for r in wp.wordpiece(df, vocab).collect()}
    first = vocab.groupBy("piece").agg(F.min("id").alias("id"))
    by_join = wp._joined_wordpiece(df.withColumnRenamed("s", "n0"), first, "[UNK]", 200).collect()
    assert by_trie == {r["token"]: (r["n0"], [tuple(p) for p in r["pieces"]]) for r in by_join}
    assert by_trie[""][1] == [] and by_trie[None][1] == [("[UNK]", 0)]


def test_trie_of_an_empty_vocabulary(spark):
    none = spark.createDataFrame([], "piece string, id long")
    df = spark.createDataFrame([("a",), ("",)], "token string")
    got = {r["token"]: [tuple(p) for p in r["pieces"]] for r in wp.wordpiece(df, none).collect()}
    assert got == {"a": [("[UNK]", None)], "": []}
    assert wp.wordpiece(df.limit(0), none).count() == 0


def words_frame(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, n long")


def test_dictionary_shapes(spark):
    v = vocab_of(spark, "ab", "##cd", "##e", "x", "##yy", "##zz", "-")
    rows = wp.word_dictionary(words_frame(spark, "Abcd", "xyyzz", "x-ab", "qqq", "​"), v).collect()
    got = {r["word"]: [(p["piece"], p["start"], p["focus"], round(p["weight"], 4)) for p in r["pieces"]] for r in rows}
    assert got["Abcd"] == [("ab", 1, 1, 0.5), ("##cd", 0, 0, 0.5)]
    assert got["xyyzz"] == [("x", 1, 0, 0.2), ("##yy", 0, 1, 0.4), ("##zz", 0, 0, 0.4)]  # first of the longest
    assert got["x-ab"] == [("x", 1, 0, 0.25), ("-", 0, 0, 0.25), ("ab", 0, 1, 0.5)]
    assert got["qqq"] == [("[UNK]", 1, 1, round(5 / 3, 4))]  # the mark counts five characters
    assert got["​"] == []
    whole = wp.word_dictionary(words_frame(spark, "qqq"), v, unk_as_word=True).first()
    assert whole["pieces"][0]["weight"] == 1.0
    bare = wp.words_without_pieces(words_frame(spark, "​", "Abcd"), wp.word_dictionary(words_frame(spark, "​", "Abcd"), v))
    assert [r["word"] for r in bare.collect()] == ["​"]


@pytest.mark.parametrize("how,lost", [("inner", 0), ("left", 1)])
def test_hot_and_cold_lookup(spark, how, lost):
    """A key with a third of the rows, and a table above the broadcast limit."""
    rows = [("hot",)] * 500 + [(f"k{i}",) for i in range(1000)] + [("absent",)] * lost
    table = spark.createDataFrame([("hot", 500, 1)] + [(f"k{i}", 1, i) for i in range(1000)], "word string, n long, v long")
    df = spark.createDataFrame(rows, "word string")
    plain = df.join(table.drop("n"), "word", how)
    cut = lookup.lookup(df, table, "word", how, weight="n", small=10, task_rows=100)
    assert sorted(map(str, cut.select("word", "v").collect())) == sorted(map(str, plain.select("word", "v").collect()))


def test_strict_ids(spark):
    v = vocab_of(spark, "a")
    df = spark.createDataFrame([("a",), ("b",)], "piece string")
    assert {r["piece"]: r["id"] for r in lookup.lookup_ids(df, v).collect()} == {"a": 1, "b": None}
    with pytest.raises(Exception, match="unknown piece: b"):
        lookup.lookup_ids(df, v, strict=True).collect()


def test_label_dictionary(spark):
    rows = spark.createDataFrame(
        [(0, 0, "B-Y"), (0, 1, "O"), (1, 0, "B-X"), (1, 1, "B-Y")], "s int, p int, label string"
    )
    d = labels.label_dictionary(rows, ["s", "p"])
    assert {r["label"]: r["id"] for r in d.collect()} == {"O": 0, "B-Y": 1, "B-X": 2, "X": 3}
    assert labels.class_count(d).first()[0] == 3
    coded = labels.encode_labels(spark.createDataFrame([("B-X",), ("new",)], "label string"), d).collect()
    assert {r["label"]: r["label_id"] for r in coded} == {"B-X": 2, "new": 0}
    back = labels.decode_labels(spark.createDataFrame([(2,), (3,), (9,)], "v int"), d, ["v"]).collect()
    assert sorted(r["v"] for r in back) == ["B-X", "O", "O"]


def test_top_widths(spark):
    h = spark.createDataFrame([(1, 9), (2, 5), (3, 5), (4, 1), (5, 7)], "n_pieces int, n_words long")
    assert [r["width"] for r in labels.top_widths(h).orderBy("rank").collect()] == [1, 5, 2, 3]
    assert [r["width"] for r in labels.top_widths(h, fixed=True).orderBy("rank").collect()] == [1, 3, 5, 7]


def test_mixed_words(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0)], "w int, logit int")
    assert {r["w"]: r["consistent"] for r in labels.mixed_words(df, ["w"]).collect()} == {0: False, 1: True}


def test_words_outside_the_dictionary(spark):
    v = vocab_of(spark, "ab", "##cd", "x")
    known = wp.word_dictionary(words_frame(spark, "ab"), v)
    rows = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, "x"), (4, "zz"), (5, None), (6, "x")], "at int, word string")
    got = {r["at"]: [p["piece"] for p in r["pieces"]] for r in wp.tokenize(rows, known, v).collect()}
    assert got == {1: ["ab"], 2: ["ab", "##cd"], 3: ["x"], 4: ["[UNK]"], 5: [], 6: ["x"]}
    with pytest.raises(Exception, match="word not in the dictionary"):
        wp.tokenize(rows, known).collect()
    assert [r["at"] for r in wp.words_without_pieces(rows, known, v).collect()] == [5]


def test_missing_vectors_are_errors(spark):
    items = spark.createDataFrame([(1, 0), (2, 7)], "vec_id int, pos int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<double>")
    assert lookup.gather_vectors(items, vectors).count() == 2
    with pytest.raises(Exception, match="unknown vec_id: 2"):
        lookup.gather_vectors(items, vectors.where("vec_id = 1")).collect()
    places = spark.createDataFrame([(0, [0.5, 0.5])], "pos int, vec array<double>")
    with pytest.raises(Exception, match="unknown pos: 7"):
        lookup.add_vectors(lookup.gather_vectors(items, vectors), [(places, "pos")]).collect()


@pytest.mark.parametrize("small", [True, False])
def test_vector_sums(spark, monkeypatch, small):
    """Held matrices and joined tables give the same sums; missing, null and repeated keys, no rows."""
    real = lookup.is_small
    monkeypatch.setattr(lookup, "is_small", lambda table, *a: small and real(table, *a))
    items = spark.createDataFrame([(1, 0, "p"), (2, 1, "q"), (2, 0, "r")], "vec_id int, pos int, embedding string")
    words = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "vec_id int, v array<float>")
    places = spark.createDataFrame([(0, [0.5, 0.25]), (1, [8.0, 8.0])], "pos int, w array<double>")
    tables = [(words, "vec_id", "v"), (places, "pos", "w")]
    got = lookup.sum_vectors(items, tables, "total")
    assert got.columns == ["vec_id", "pos", "embedding", "total"] or not small
    assert {r["embedding"]: r["total"] for r in got.collect()} == {"p": [1.5, 2.25], "q": [11.0, 12.0], "r": [3.5, 4.25]}
    assert lookup.sum_vectors(items.limit(0), tables).count() == 0
    with pytest.raises(Exception, match="unknown pos: 1"):
        lookup.sum_vectors(items, [tables[0], (places.where("pos = 0"), "pos", "w")]).collect()
    with pytest.raises(Exception, match="unknown pos: null"):
        lookup.sum_vectors(items.withColumn("pos", F.lit(None).cast("int")), tables).collect()


@pytest.mark.parametrize("weight", [None, "n"])
def test_heavy_keys_are_spread(spark, weight):
    rows = spark.createDataFrame([(n, "hot" if n % 3 == 0 else f"k{n % 50}") for n in range(900)] + [(901, None)], "at int, word string")
    counts = rows.where("word IS NOT NULL").groupBy("word").count().collect()
    table = spark.createDataFrame([(r[0], r[1], i) for i, r in enumerate(counts)], "word string, n long, v int")
    got = lookup.lookup(rows, table if weight else table.drop("n"), "word", "left", weight, small=3, task_rows=40)
    expected = {r[0]: i for i, r in enumerate(counts)}
    assert sorted((r["at"], r["v"]) for r in got.select("at", "v").na.fill(-1).collect()) == sorted(
        (r["at"], expected.get(r["word"], -1)) for r in rows.collect()
    )


def test_label_x_in_the_data_and_first_seen_ties(spark):
    rows = spark.createDataFrame([(0, "X"), (1, "B"), (2, "O")], "at int, label string")
    d = labels.label_dictionary(rows, ["at"])
    assert sorted((r["label"], r["id"]) for r in d.collect()) == [("B", 1), ("O", 0), ("X", 2)]
    assert labels.encode_labels(rows, d).count() == 3
    words = spark.createDataFrame([(0, [1, 2]), (1, [1]), (2, [1]), (3, [1, 2])], "at int, pieces array<int>")
    top = labels.top_widths(labels.piece_histogram(words, ["at"]), "seen")
    assert [(r["rank"], r["width"]) for r in top.orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_any_tokenizer(spark):
    words = spark.createDataFrame([("ab", 2), ("", 1), ("cab", 1)], "word string, n long")
    vocab = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "piece string, id long")

    def letters(df):
        return df.withColumn("pieces", F.filter(F.split("word", ""), lambda x: x != ""))

    made = wp.tokenizer_dictionary(words, vocab, letters)
    ids = {r.word: [p.id for p in r.pieces] for r in made.collect()}
    assert ids == {"ab": [7, 8], "": [], "cab": [9, 7, 8]}
    (cab,) = made.where("word = 'cab'").collect()
    assert [(p.start, p.focus) for p in cab.pieces] == [(1, 1), (0, 0), (0, 0)]
    rows = spark.createDataFrame([("ab",), ("ba",), (None,)], "word string")
    found = wp.tokenize(rows, made, vocab, tokenizer=letters)
    assert {r.word: [p.id for p in r.pieces] for r in found.collect()} == {"ab": [7, 8], "ba": [8, 7], None: []}
    for bad in (lambda df: letters(df).where("word <> 'ab'"), lambda df: letters(df).union(letters(df))):
        with pytest.raises(Exception, match="every word once"):
            wp.tokenizer_dictionary(words, vocab, bad)
    with pytest.raises(Exception, match="unknown"):
        wp.tokenizer_dictionary(words, vocab.where("id < 9"), letters)


def test_vocabulary_in_several_files(spark, tmp_path):
    from tagloom.sources import readers, writers

    vocab = spark.createDataFrame([(f"p{n}", n) for n in range(1000)], "piece string, id long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_vocab(vocab.repartition(5), str(tmp_path / "vocab"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "vocab").glob("part-*"))) > 1
    assert sorted(map(tuple, readers.read_vocab(spark, str(tmp_path / "vocab")).collect())) == sorted(map(tuple, vocab.collect()))
