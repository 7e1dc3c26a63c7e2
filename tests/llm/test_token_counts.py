from collections import Counter

import public_tokenizers
from pathlib import Path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import queries, token_counts

FILE = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
EXACT = Tokenizer.from_str(FILE)
EXACT.encode_special_tokens = True


def count(text):
    return len(EXACT.encode(text or "", add_special_tokens=False).ids)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches(spark, tmp_path):
    rows = [(1, "one two", "a", "en"), (2, None, "a", None), (3, "", None, "en"), (4, "x " * 5000, "a", "en"), (4, "x", "a", "en"), (None, "y", "b", "en")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, lang string, n_docs int")
    files = {"v1": FILE, "v2": FILE}
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert totals(rollup) == {} and rollup.committed() == []
    assert rollup.commit("b1", token_counts.inserts(token_counts.counted(docs, files)))
    assert not rollup.commit("b1", token_counts.inserts(token_counts.counted(docs, files)))
    expected = Counter()
    for v in files:
        for _, text, source, lang in rows:
            expected[source, lang, v, 0] += 1
            expected[source, lang, v, 1] += count(text)
    want = {k[:3]: (expected[(*k[:3], 0)], expected[(*k[:3], 1)]) for k in expected}
    assert totals(rollup) == want

    gone = docs.where("source = 'b'")
    new = F.when(F.col("doc_id") == 1, F.concat(F.col("text"), F.lit(" more")))
    rollup.commit("b2", token_counts.deletes(token_counts.counted(gone, files)))
    rollup.commit("b3", token_counts.revisions(token_counts.counted(docs, files, new)))
    rollup.commit("b4", token_counts.inserts(token_counts.counted(docs.limit(0), files)))
    for v in files:
        del want["b", "en", v]
        n, tokens = want["a", "en", v]
        want["a", "en", v] = (n, tokens + count("one two more") - count("one two"))
    assert totals(rollup) == want and rollup.committed() == ["b1", "b2", "b3", "b4"]


def test_added_tokens_count_once(spark):
    text = "a <|endoftext|> b"
    docs = spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")
    (row,) = token_counts.counted(docs, {"v1": FILE}).collect()
    assert row.n_tokens == len(Tokenizer.from_str(FILE).encode(text, add_special_tokens=False).ids) == 4


def test_half_written_batch_counts_for_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "a", "en")], "doc_id long, text string, source string, lang string")
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("b1", token_counts.inserts(token_counts.counted(docs, {"v1": FILE})))
    (tmp_path / "rollup" / "batch=b1" / "_SUCCESS").unlink()
    assert totals(rollup) == {}
    assert rollup.commit("b1", token_counts.inserts(token_counts.counted(docs, {"v1": FILE})))
    assert totals(rollup) == {("a", "en", "v1"): (1, count("one two"))}


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic == 1}
    expected = Counter()
    for r in docs:
        if r.doc_id not in toxic:
            expected[r.source, r.lang, 0] += 1
            expected[r.source, r.lang, 1] += count("\n".join(dict.fromkeys(r.text.split("\n"))))
    found = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.op4_token_rollup(spark, sf_dir).collect()}
    assert found == {k[:2]: (expected[(*k[:2], 0)], expected[(*k[:2], 1)]) for k in expected}
