import hashlib
from pathlib import Path

import numpy as np
from check_queries import compare
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import chat, queries

FILE = Path(queries.TOKENIZER).read_text()
ENCODER = chat.tokenizer(FILE)
TEXTS = st.one_of(
    st.text(max_size=30), st.lists(st.sampled_from(["<", "|", "\\", "<|", "<|im_end|>", "<\\|", "im_sep|>", "\n", " ", "a"]), max_size=12).map("".join)
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXTS), TEXTS), max_size=6))
def test_round_trip(turns):
    formatted, _ = chat.render(turns)
    assert chat.parse(formatted) == turns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXTS), max_size=6))
def test_mask_covers_assistants_texts(turns):
    formatted, spans = chat.render(turns)
    encoded = ENCODER.encode(formatted, add_special_tokens=False)
    starts, ends = np.array(encoded.offsets, np.int32).reshape(-1, 2).T
    mask = chat.token_mask(starts, ends, spans)
    assert chat.masked_texts(formatted, starts, ends, mask) == [t for r, t in turns if r == "assistant" and t]
    assert ENCODER.decode(encoded.ids, skip_special_tokens=False) == formatted


def test_edge_rows(spark):
    rows = [
        (1, 2, "assistant", "two"), (1, 1, "user", None), (1, 3, None, "x"), (2, 1, "assistant", ""), (3, 1, "assistant", "b"),
        (3, 1, "assistant", "a"), (3, None, "assistant", "first"), (None, 1, "user", "q"), (None, 2, "assistant", "é日"),
        (4, 1, "assistant", "w " * 50_000), (5, 1, "user", "dup"), (5, 1, "user", "dup"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    found = {r.conv_id: r for r in chat.read_back(chat.format_chat(df, FILE)).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    turns = {1: [("user", ""), ("assistant", "two"), ("", "x")], 2: [("assistant", "")], 3: [("assistant", x) for x in ("first", "a", "b")],
             None: [("user", "q"), ("assistant", "é日")], 4: [("assistant", "w " * 50_000)], 5: [("user", "dup")] * 2}
    assert found.keys() == turns.keys()
    for conv, own in turns.items():
        learned = "".join(t for r, t in own if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), digest("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), digest(learned))
        assert r.formatted_chars == len(chat.render(own)[0])
    assert chat.format_chat(df.limit(0), FILE).count() == 0


def test_long_conversations_come_in_parts(monkeypatch):
    monkeypatch.setattr(chat, "PART", 8)
    turns = [(1, "user", "abcde"), (1, "assistant", "fghij"), (1, "user", "x" * 20), (2, "user", "a")]
    assert [(c, p, len(t)) for c, p, t in chat._parts(iter(turns))] == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 1)]


def test_query(spark, sf_dir, duck):
    assert compare(queries.op8_chat(spark, sf_dir), duck, queries.ORACLE_SQL["op8_chat"]) == ""
