import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import chunks, run_scoring

TAGS = ["O", "O", "B-X", "I-X", "E-X", "S-Y", "I-Y", "E-Y", "B-Y", ".", "B"]
SCHEMA = "s int, run int, tags array<string>"


def random_rows(seed, sequences):
    rnd = random.Random(seed)
    rows = []
    for s in range(sequences):
        gold = [rnd.choice(TAGS) for _ in range(rnd.randint(0, 9))]
        rows.append((s, None, gold))
        for run in (3, 1, 2):
            if rnd.random() < 0.8:
                rows.append((s, run, [g if rnd.random() < 0.7 else rnd.choice(TAGS) for g in gold]))
    return rows


@pytest.mark.parametrize("batch", [10_000, 3])
def test_equals_scoring_run_by_run(spark, batch):
    """Also where a batch ends between a gold row and its runs."""
    rows = random_rows(5, 80)
    gold = {s: tags for s, run, tags in rows if run is None}
    flat = [(run, s, i, g, p) for s, run, tags in rows if run for i, (g, p) in enumerate(zip(gold[s], tags))]
    flat = spark.createDataFrame(flat, "run int, s int, pos int, gold string, pred string")
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        found = run_scoring.score_runs(df, ["s"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    wanted = chunks.score(flat, ["run", "s"], by=["run"]).collect()
    assert len(wanted) > 6 and sorted(map(str, found)) == sorted(map(str, wanted))


def test_nothing_to_score(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert run_scoring.score_runs(none, ["s"]).count() == 0
    empty = spark.createDataFrame([(1, None, None), (1, 4, []), (2, None, []), (2, 4, None)], SCHEMA)
    assert run_scoring.score_runs(empty, ["s"]).count() == 0


@pytest.mark.parametrize(
    "rows,message",
    [
        ([(1, 4, ["O"])], "one gold row"),
        ([(1, None, ["O"]), (2, 4, ["O"])], "one gold row"),
        ([(1, None, ["O"]), (1, None, ["O"])], "one gold row"),
        ([(1, None, ["O"]), (1, 4, ["O"]), (1, 4, ["O"])], "each run at most once"),
        ([(1, None, ["O"]), (1, 4, ["O", "O"])], "number of tags"),
        ([(1, None, ["O"]), (1, 4, [None])], "tag is null"),
    ],
)
def test_errors(spark, rows, message):
    with pytest.raises(Exception, match=message):
        run_scoring.score_runs(spark.createDataFrame(rows, SCHEMA), ["s"]).collect()
