"""Chunk-tag expressions: splitting a tag and finding where chunks start and end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_prefix(tag: Column) -> Column:
    """Part before the first ``-``; the whole tag when there is none."""
    return F.substring_index(tag, "-", 1)


def tag_type(tag: Column) -> Column:
    """Part after the first ``-``; empty when there is none."""
    cut = F.instr(tag, "-")
    return F.when(cut > 0, F.substr(tag, cut + 1)).otherwise(F.lit(""))


def chunk_starts(prev_prefix: Column, prev_type: Column, prefix: Column, type_: Column) -> Column:
    """A chunk begins at this token, given the token before it."""
    return (
        prefix.isin("B", "S", "[", "]")
        | (prev_prefix.isin("E", "S", "O") & prefix.isin("E", "I"))
        | (~prefix.isin("O", ".") & (prev_type != type_))
    )


def chunk_ends(prev_prefix: Column, prev_type: Column, prefix: Column, type_: Column) -> Column:
    """A chunk ended between the previous token and this one."""
    return (
        prev_prefix.isin("E", "S", "[", "]")
        | (prev_prefix.isin("B", "I") & prefix.isin("B", "S", "O"))
        | (~prev_prefix.isin("O", ".") & (prev_type != type_))
    )


def from_bilou(tag: Column) -> Column:
    """Map BILOU prefixes to IOBES ones, which the chunk rules know."""
    rest = F.substr(tag, F.lit(2))
    return (
        F.when(tag.rlike("^U(-|$)"), F.concat(F.lit("S"), rest))
        .when(tag.rlike("^L(-|$)"), F.concat(F.lit("E"), rest))
        .otherwise(tag)
    )
