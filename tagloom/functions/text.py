"""Text normalisation and basic tokenising as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges of CJK ideographs.
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
)
# ASCII symbols counted as punctuation, and Unicode category P.
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
# White space as str.split() sees it.
ANY_SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}"


# Two noncharacters, which no text holds, stand for a replacement character of the input.
_HELD = "\U0010ffff\U0010fffe"


def utf8_text(raw: Column) -> Column:
    """Bytes to text, dropping invalid sequences; replacement characters of the input stay."""
    held = F.replace(raw.cast("string"), F.lit("\ufffd"), F.lit(_HELD))
    valid = F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit(""))
    return F.replace(valid, F.lit(_HELD), F.lit("\ufffd"))


def clean_text(text: Column) -> Column:
    """Blank out white space, then drop control and replacement characters."""
    spaced = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(spaced, r"[\p{Cc}\p{Cf}\x{FFFD}]", "")


def space_cjk(text: Column) -> Column:
    """Put a space on each side of every CJK ideograph."""
    return F.regexp_replace(text, f"([{CJK}])", " $1 ")


def split_space(text: Column) -> Column:
    """Split on any run of white space; no empty parts."""
    return F.filter(F.split(text, f"[{ANY_SPACE}]+"), lambda w: w != "")


def space_punctuation(text: Column) -> Column:
    """Put a space on each side of every punctuation character."""
    return F.regexp_replace(text, f"([{PUNCTUATION}])", " $1 ")


def _without(form: str, drop) -> object:
    def fold(text: str) -> str:
        return "".join(c for c in unicodedata.normalize(form, text) if not drop(c))

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold, na_action="ignore")

    return folded


_is_mark = lambda c: unicodedata.category(c) == "Mn"


def _non_ascii(text: Column) -> Column:
    """The text where it needs folding, null elsewhere: ASCII never leaves the JVM
    as more than a null."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), text)


def strip_accents(text: Column) -> Column:
    """Canonical decomposition, then drop non-spacing marks."""
    return F.coalesce(_without("NFD", _is_mark)(_non_ascii(text)), text)


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Clean, space out ideographs, optionally lower-case and fold accents, then
    split at white space and punctuation."""
    spaced = space_cjk(clean_text(text))
    if lower:
        spaced = strip_accents(F.lower(spaced))
    return split_space(space_punctuation(spaced))


def normalize_text(
    text: Column, lower: bool = False, remove_space: bool = True, keep_accents: bool = False
) -> Column:
    """Collapse white space, unify double quotes, optionally fold accents and case."""
    if remove_space:
        text = F.trim(F.regexp_replace(text, f"[{ANY_SPACE}]+", " "))
    text = F.replace(F.replace(text, F.lit("``"), F.lit('"')), F.lit("''"), F.lit('"'))
    if not keep_accents:
        text = F.coalesce(_without("NFKD", unicodedata.combining)(_non_ascii(text)), text)
    return F.lower(text) if lower else text


# The mark put before a piece that starts a word, and digits (decimal
# digits, superscripts and subscripts).
WORD_MARK = "▁"
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def split_number_commas(pieces: Column) -> Column:
    """Turn a piece that ends in a digit and a comma into the number and the comma."""

    def parts(p: Column) -> Column:
        number = F.replace(F.substr(p, F.lit(1), F.length(p) - 1), F.lit(WORD_MARK), F.lit(""))
        mark = F.when(F.startswith(p, F.lit(WORD_MARK)), WORD_MARK).otherwise("")
        return F.when(p.rlike(f"{DIGIT},$"), F.array(F.concat(mark, number), F.lit(","))).otherwise(
            F.array(p)
        )

    return F.flatten(F.transform(pieces, parts))


def split_columns(line: Column, delimiter: str | None = None) -> Column:
    """Drop line ends, then split at any white space or at ``delimiter``."""
    line = F.regexp_replace(line, r"[\r\n]+$", "")
    if delimiter is None:
        return split_space(line)
    return F.split(line, rf"\Q{delimiter}\E")
