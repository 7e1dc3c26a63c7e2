import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import naive_tiles
from test_near_dups import brute as near_classes
from test_repeats import brute_passages
from test_sequence_packing import check
from tagloom.llm import queries


def words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def leaks(text, items, least=5):
    own = words(text)
    grams = {tuple(own[k : k + least]) for k in range(len(own) - least + 1)}
    for item in items:
        if any(tuple(item[k : k + least]) in grams for k in range(len(item) - least + 1)):
            if sum(n for *_, n in naive_tiles(own, item, least)) >= 0.5 * len(item):
                return True
    return False


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in queries.op6_language(spark, sf_dir).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if labels[r.doc_id].lang_pred != "und" and labels[r.doc_id].score >= corpus_pipeline.CONFIDENT}
    classes = near_classes(list(rows.items()))
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    rows = dict(zip(rows, (t for t, _ in brute_passages(list(rows.values()), 51))))
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not leaks(t, items)}

    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, sf_dir)
        assert stage.columns == docs.columns, name
    kept = {r.doc_id: (r.text, r.n_chars, r.lang) for r in stage.collect()}
    assert {i: t for i, (t, *_) in kept.items()} == rows
    assert all(n == len(t) and lang == labels[i].lang_pred for i, (t, n, lang) in kept.items())
    placed = corpus_pipeline.run(spark, sf_dir).withColumnRenamed("doc_id", "id")
    check(placed.collect(), list(rows.items()), 2048)


def test_stages_take_edge_rows(spark, sf_dir):
    text = "the and of that with from this for was are " * 3
    rows = [
        (1, text, "en", "s", 1, 0.1), (1, text, "en", "s", 1, 0.2), (None, text + "more", None, None, None, 0.3), (2, None, "en", "s", 0, 0.4),
        (3, "", "en", "s", 0, 0.5), (4, "123 456", "en", "s", 7, 0.6), (5, "ein der die und das ist nicht mit", "de", "s", 3, 0.7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    kept = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, schema), sf_dir).select(F.col("doc_id")).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1, 5]


def test_documents_of_an_unlearned_language_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blind = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, blind, sf_dir).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    share = {x: sum(i in kept for i in lang if lang[i] == x) / list(lang.values()).count(x) for x in set(lang.values())}
    assert share.pop("es") < 0.35 and min(share.values()) > 0.9
