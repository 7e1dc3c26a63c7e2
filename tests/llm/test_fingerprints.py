import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tagloom.llm import fingerprints as fp
from tagloom.llm import queries


def one(text):
    return fp.packed(*fp.vectors([text]))[0]


def shingles(text):
    out = {}
    for line in text.split("\n"):
        w = re.findall(r"[^\t-\r ]+", line)
        for k in range(max(1, len(w) - 2) if w else 0):
            out[tuple(w[k : k + 3])] = out.get(tuple(w[k : k + 3]), 0) + 1
    return out


def true_likeness(a, b):
    x, y = shingles(a), shingles(b)
    whole = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y.get(k, 0) for k, v in x.items()) / whole if whole else 0.0


def brute(rows):
    """Rows in descending order of ids -> id, n_chars, digest of the edited text, both fingerprints."""
    out = []
    for n, (i, text) in enumerate(rows):
        other = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), one(text).hex(), one(edited).hex(), text, edited, other))
    return out


def test_order_does_not_count_and_parts_go_in_and_out():
    a, b, c = "one two three four", "", "Ünd so weiter\tim Text"
    assert one("\n".join([a, b, c])) == one("\n".join([c, a, b])) != one("\n".join([a, c]))
    assert fp.combined(one(a), one(f"{b}\n{c}")) == one(f"{c}\n{b}\n{a}")
    assert fp.combined(one(f"{a}\n{c}"), one(c), remove=True) == one(a)
    assert len({one(x) for x in ["", "\n", " ", "a", "a a", "a\na", "a\n"]}) == 7


def test_likeness_is_near_the_share_of_shingles():
    rng = random.Random(3)
    for size in (40, 400, 3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2 * size)]
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            a = " ".join(words[:size])
            b = " ".join(words[: int(size * share)] + words[size : 2 * size - int(size * share)])
            found = float(fp.likeness(fp.unpacked([one(a)]), fp.unpacked([one(b)]))[0])
            assert abs(found - true_likeness(a, b)) < 0.3
            assert found == 1.0 if a == b else found < 1.0
    assert fp.likeness(fp.unpacked([one("")]), fp.unpacked([one("\n")]))[0] == 0.0


@pytest.mark.parametrize("partitions", [1, 7])
def test_report_equals_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(fp, "ROWS", 3)
    rng = random.Random(partitions)
    texts = ["\n".join(" ".join(rng.choices("ab é 漢 the of".split(), k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    texts += ["", "x", "y" * 5001, "\n\n\n", "x"]
    rows = sorted(zip(rng.sample(range(-50, 200), len(texts)), texts), reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("k").alias("fingerprint"), F.lit(1).alias("part"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r.id: r for r in fp.edit_report(df, "doc_id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = brute(rows)
    assert [tuple(found[w[0]])[:5] for w in wanted] == [w[:5] for w in wanted]
    for _, _, _, a, b, text, edited, other in wanted:
        row = found[wanted[[w[5] is text for w in wanted].index(True)][0]]
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if text == other:
            assert row.near_next == 1.0
        if a == b:
            assert row.near_edited == 1.0
    kept = fp.fingerprints(df, "text")
    assert kept.columns == ["doc_id", "text", "part", "fingerprint"]
    assert {r.doc_id: r.fingerprint for r in kept.collect()} == {w[0]: w[3] for w in wanted}


def test_nulls_repeated_ids_and_few_rows(spark):
    schema = "doc_id long, text string"
    assert fp.edit_report(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    (single,) = fp.edit_report(spark.createDataFrame([(1, "abc")], schema), "doc_id", "text").collect()
    assert single.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and single.near_next == 1.0
    rows = [(None, "abcd"), (4, None), (4, None), (9, "wxyz")]
    found = fp.edit_report(spark.createDataFrame(rows, schema), "doc_id", "text").collect()
    edited = {(r.id, r.n_chars): r.edited_sha256 for r in found}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(found) == 4
    assert edited == {(9, 4): hashlib.sha256(b"wx").hexdigest(), (4, 0): empty, (None, 4): hashlib.sha256(b"abwx").hexdigest()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    found = {r.doc_id: r for r in queries.op13_fingerprints(spark, sf_dir).collect()}
    wanted = brute(rows)
    assert len(found) == len(rows)
    errors = []
    for i, n, sha, own, made, text, edited, other in wanted:
        r = found[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha, own, made)
        errors += [abs(r.near_edited - true_likeness(text, edited)), abs(r.near_next - true_likeness(text, other))]
    assert sum(errors) / len(errors) < 0.08
    assert sum(r.near_edited for r in found.values()) > 4 * sum(r.near_next for r in found.values())
