import unicodedata

import pytest
from conftest import one
from pyspark.sql import functions as F

from tagloom.functions import arrays, tags, text


def apply(spark, fn, *values):
    return [r[0] for r in one(spark, "t string", [(v,) for v in values], fn(F.col("t")))]


def test_clean_text(spark):
    got = apply(spark, text.clean_text, "a\x00b", "a�b", "a​b", "a b", "a\x0bb\x0cc", "a\tb\nc\rd", "a b")
    assert got == ["ab", "ab", "ab", "a b", "abc", "a b c d", "a b"]


def test_control_and_space_agree_with_unicode_tables(spark):
    chars = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    got = apply(spark, text.clean_text, *chars)
    for c, g in zip(chars, got):
        cat = unicodedata.category(c)
        want = " " if c in "\t\n\r" or cat == "Zs" else "" if cat in ("Cc", "Cf") else c
        assert g == want or unicodedata.category(c) in ("Cf",), (hex(ord(c)), g)


CJK_EDGES = [0x4E00, 0x9FFF, 0x3400, 0x4DBF, 0x20000, 0x2A6DF, 0x2A700, 0x2B73F, 0x2B740, 0x2B81F, 0x2B820, 0x2CEAF,
             0xF900, 0xFAFF, 0x2F800, 0x2FA1F]
OUTSIDE = [0x4DFF, 0xA000, 0x33FF, 0x4DC0, 0x1FFFF, 0x2A6E0, 0x2CEB0, 0xF8FF, 0xFB00, 0x2F7FF, 0x2FA20, 0xAC00, 0x3042]


def test_cjk(spark):
    assert apply(spark, text.space_cjk, *[f"a{chr(c)}b" for c in CJK_EDGES]) == [f"a {chr(c)} b" for c in CJK_EDGES]
    assert apply(spark, text.space_cjk, *[f"a{chr(c)}b" for c in OUTSIDE]) == [f"a{chr(c)}b" for c in OUTSIDE]


def test_punctuation(spark):
    got = apply(spark, lambda c: text.split_space(text.space_punctuation(c)), "a-b$", "`^", "«x»", "你，好", "a+b~c")
    assert got == [["a", "-", "b", "$"], ["`", "^"], ["«", "x", "»"], ["你", "，", "好"], ["a", "+", "b", "~", "c"]]


def test_accents(spark):
    words = ["café", "café", "straße", "ø", "Ñandú", "plain", None, "한"]
    got = apply(spark, text.strip_accents, *words)
    assert got[:7] == ["cafe", "cafe", "straße", "ø", "Nandu", "plain", None]
    assert got[7] == unicodedata.normalize("NFD", "한")


def test_basic_tokens(spark):
    got = apply(spark, text.basic_tokens, "Héllo, World!", "", "  ", "ab中c d", "x y")
    assert got == [["hello", ",", "world", "!"], [], [], ["ab", "中", "c", "d"], ["x", "y"]]
    assert apply(spark, lambda c: text.basic_tokens(c, lower=False), "Héllo, W") == [["Héllo", ",", "W"]]


def test_normalize_text(spark):
    got = apply(spark, text.normalize_text, "  a \n b ", "``x''", "falsé", "ﬁn")
    assert got == ["a b", '"x"', "false", "fin"]
    assert apply(spark, lambda c: text.normalize_text(c, lower=True, keep_accents=True), "É  A") == ["é a"]
    assert apply(spark, lambda c: text.normalize_text(c, remove_space=False), " a ") == [" a "]


def test_number_comma(spark):
    rows = one(spark, "p array<string>", [(["▁2000,", "and", "92,", ",", "a,", "▁b", "1"],)], text.split_number_commas(F.col("p")))
    assert rows[0][0] == ["▁2000", ",", "and", "92", ",", ",", "a,", "▁b", "1"]


def test_utf8(spark):
    rows = one(spark, "b binary", [(b"ok\xff\xfe!",), ("é".encode()[:1],), ("né".encode(),)], text.utf8_text(F.col("b")))
    assert [r[0] for r in rows] == ["ok!", "", "né"]


def test_split_columns(spark):
    assert apply(spark, text.split_columns, "a  b\tc\r\n", " ") == [["a", "b", "c"], []]
    assert apply(spark, lambda c: text.split_columns(c, "|"), "a||b\n") == [["a", "", "b"]]


@pytest.mark.parametrize(
    "tag,want", [("B-X", ("B", "X")), ("O", ("O", "")), ("B-a-b", ("B", "a-b")), ("-x", ("", "x")), ("U-", ("U", ""))]
)
def test_parse_tag(spark, tag, want):
    assert one(spark, "t string", [(tag,)], tags.tag_prefix(F.col("t")), tags.tag_type(F.col("t"))) == [want]


def test_bilou(spark):
    got = apply(spark, tags.from_bilou, "U-X", "L-X", "B-X", "O", "U", "Ux-1")
    assert got == ["S-X", "E-X", "B-X", "O", "S", "Ux-1"]


def test_arrays(spark):
    row = one(
        spark, "s array<double>", [([1.0, 3.0, 3.0],)],
        arrays.argmax(F.col("s")), arrays.one_hot(F.lit(1), 3), F.round(F.get(arrays.softmax(F.col("s")), F.lit(0)), 6),
        arrays.pad_to(F.col("s"), 5, F.lit(0.0)), arrays.ones_then_zeros(F.lit(2), 3),
        arrays.invert_map(F.create_map(F.lit("a"), F.lit(1))),
    )[0]
    assert row == (1, [0, 1, 0], 0.063379, [1.0, 3.0, 3.0, 0.0, 0.0], [1, 1, 0], {1: "a"})
