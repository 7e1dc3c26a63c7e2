"""Sub-word tokenising through a dictionary of distinct words.

Only distinct words are tokenised; the corpus then looks its words up. Greedy
longest-match is one pass over a trie that every executor holds, or over a table of hashed
pieces for a larger vocabulary; with one too large for that too it is an equality join of
every possible substring with the vocabulary followed by one pass over the matches of each word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.arrays import let
from tagloom.functions.text import basic_tokens
from tagloom.operators import lookup as lookups
from tagloom.operators.lookup import lookup, lookup_ids
from tagloom.operators.piece_table import PieceTable
from tagloom.operators.trie import PieceTrie, match_lists, match_pieces
from tagloom.operators.word_lists import lookup_lists
from tagloom.workspace import store

UNK = "[UNK]"
MAX_CHARS = 200
# Largest vocabulary, in rows and in estimated bytes, that executors hold as a table of hashes.
TABLE_ROWS = 8_000_000
TABLE_BYTES = 160 << 20
NO_PIECES = "cast(array() as array<struct<piece:string,id:bigint>>)"


def word_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct words with their number of uses; counted before the shuffle, so a
    word that fills a third of the corpus costs one row per task."""
    return words.groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def wordpiece(tokens: DataFrame, vocab: DataFrame, unk: str = UNK, max_chars: int = MAX_CHARS) -> DataFrame:
    """``(token, …)`` distinct -> the same rows with ``pieces array<struct<piece,id>>``.

    A token with an unmatched position, or longer than ``max_chars``, becomes the
    unknown piece, and so does a null one. An empty token has no pieces. The vocabulary
    becomes a trie if its rows and bytes are few (``is_small``), a table of hashes up to
    ``TABLE_ROWS`` and ``TABLE_BYTES``, else it is joined.
    """
    matcher = _matcher(vocab, unk)
    if matcher is None:
        return _joined_wordpiece(tokens, vocab, unk, max_chars)
    return match_pieces(tokens, matcher, max_chars)


def _matcher(vocab: DataFrame, unk: str) -> PieceTrie | PieceTable | None:
    """What finds pieces on the executors, None for a vocabulary that they cannot hold."""
    pieces = vocab.select("piece", "id")
    if lookups.is_small(vocab):
        return PieceTrie([(r["piece"], r["id"]) for r in pieces.collect()], unk)
    if lookups.is_small(vocab, TABLE_ROWS, TABLE_BYTES):
        return PieceTable(pieces.toArrow(), unk)
    return None


def _joined_wordpiece(tokens: DataFrame, vocab: DataFrame, unk: str, max_chars: int) -> DataFrame:
    """The same by a join of all substrings, for vocabularies of any size."""
    longest = vocab.agg(
        F.max(F.length("piece")).alias("m"), F.max(F.when(F.col("piece") == unk, F.col("id"))).alias("u")
    ).first()
    size = F.length("token")
    spans = tokens.where((size > 0) & (size <= max_chars)).select("token", size.alias("n"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    last = F.least(F.col("n"), F.col("s") + longest["m"])
    spans = spans.select("*", F.explode(F.sequence(F.col("s") + 1, last)).alias("e"))
    cut = F.substr("token", F.col("s") + 1, F.col("e") - F.col("s"))
    spans = spans.withColumn("piece", F.concat(F.when(F.col("s") > 0, "##").otherwise(""), cut))
    matches = _match(spans, vocab.select("piece", "id"))
    found = matches.groupBy("token").agg(
        F.array_sort(
            F.collect_list(F.struct("s", (-F.col("e")).alias("back"), "piece", "id"))
        ).alias("m")
    )
    # Matches are ordered by start, longest first: the first match at the current
    # position is the greedy choice.
    walked = F.aggregate(
        "m",
        F.expr(f"named_struct('at', 0, 'pieces', {NO_PIECES})"),
        lambda acc, x: F.when(
            x["s"] == acc["at"],
            F.struct(
                (-x["back"]).alias("at"),
                F.concat(
                    acc["pieces"],
                    F.array(F.struct(x["piece"].alias("piece"), x["id"].cast("bigint").alias("id"))),
                ).alias("pieces"),
            ),
        ).otherwise(acc),
    )
    found = found.select("token", walked.alias("w"))
    unknown = F.array(F.struct(F.lit(unk).alias("piece"), F.lit(longest["u"]).cast("bigint").alias("id")))
    return tokens.join(found, "token", "left").select(
        *tokens.columns,
        F.when(size == 0, F.expr(NO_PIECES))
        .when(F.col("w.at") == size, F.col("w.pieces"))
        .otherwise(unknown)
        .alias("pieces"),
    )


def _match(spans: DataFrame, vocab: DataFrame) -> DataFrame:
    """Spans found in the vocabulary. Short pieces match in very many words; with a
    vocabulary too big to broadcast they are spread as their number asks."""
    return lookup(spans, vocab, "piece", "inner")


def basic_dictionary(words: DataFrame, lower: bool = True) -> DataFrame:
    """``(word, …)`` distinct -> ``(word, …, tokens array<string>)``."""
    return words.withColumn("tokens", basic_tokens(F.col("word"), lower))


def shape_pieces(pieces: Column, word: Column, unk: str = UNK, unk_as_word: bool = False) -> Column:
    """Add to each piece of a word: first-piece flag, focus flag, share of the word.

    The share is the piece's length without ``##`` over the word's length. The
    unknown mark counts with its own length, or with the word's if ``unk_as_word``.
    The focus piece is the longest one, the first of them on ties.
    """

    def chars(p: Column) -> Column:
        plain = F.length(F.replace(p["piece"], F.lit("##"), F.lit("")))
        return F.when(p["piece"] == unk, F.length(word)).otherwise(plain) if unk_as_word else plain

    def shaped(focus: Column) -> Column:
        return F.transform(
            pieces,
            lambda p, i: F.struct(
                p["piece"].alias("piece"),
                p["id"].alias("id"),
                (i == 0).cast("int").alias("start"),
                (i == focus).cast("int").alias("focus"),
                (chars(p) / F.length(word)).alias("weight"),
            ),
        )

    longest = let(F.transform(pieces, chars), lambda n: F.array_position(n, F.array_max(n)) - 1)
    return let(longest, shaped)


def word_dictionary(
    words: DataFrame, vocab: DataFrame, lower: bool = True, unk_as_word: bool = False
) -> DataFrame:
    """Written table ``(word, n, pieces)`` for a ``(word, n)`` table of distinct words.

    ``pieces`` holds everything that depends on the word alone, so the corpus only
    adds labels. A word that cleans to nothing has an empty list.
    """
    basic = basic_dictionary(words, lower)
    matcher = _matcher(vocab, UNK)
    if matcher is not None:
        full = match_lists(basic.select("word", "n", "tokens"), matcher, MAX_CHARS)
        shaped = shape_pieces(F.col("pieces"), F.col("word"), unk_as_word=unk_as_word)
        return store(full.withColumn("pieces", shaped), "dictionary")
    basic = store(basic, "basic")
    parts = basic.select("word", F.posexplode("tokens").alias("at", "token"))
    # Stems and punctuation recur in many words; their use counts guide the lookup.
    tokens = store(parts.groupBy("token").agg(F.count("*").alias("uses")), "tokens")
    pieces = store(wordpiece(tokens, vocab), "wordpiece")
    joined = lookup(parts, pieces, "token", "inner", weight="uses")
    whole = joined.groupBy("word").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "pieces"))), lambda x: x["pieces"])
        ).alias("pieces")
    )
    full = basic.select("word", "n").join(whole, "word", "left")
    pieces = F.coalesce("pieces", F.expr(NO_PIECES))
    shaped = shape_pieces(F.col("pieces"), F.col("word"), unk_as_word=unk_as_word)
    return store(full.withColumn("pieces", pieces).withColumn("pieces", shaped), "dictionary")


Tokenizer = Callable[[DataFrame], DataFrame]


def tokenizer_dictionary(
    words: DataFrame, vocab: DataFrame, tokenizer: Tokenizer, unk_as_word: bool = False
) -> DataFrame:
    """The same table as ``word_dictionary`` gives, by any ``(word) -> (word, pieces array<string>)``.

    The tokenizer gets distinct words and must return each of them once; a word it
    leaves out or repeats, and a piece that is not in ``vocab``, is an error. Words it
    adds are ignored; a null or empty list of pieces is an empty one.
    """
    made = store(tokenizer(words.select("word")).select("word", "pieces"), "tokenizer")
    held = made.groupBy("word").agg(F.count("*").alias("times"), F.first("pieces").alias("names"))
    wrong = F.raise_error(
        F.concat(F.lit("the tokenizer must return every word once: "), F.coalesce("word", F.lit("null")))
    ).cast("array<string>")
    asked = words.select("word", "n").join(held, "word", "left")
    asked = store(asked.withColumn("names", F.when(F.col("times") == 1, F.coalesce("names", F.array().cast("array<string>"))).otherwise(wrong)), "asked")
    parts = asked.select("word", F.posexplode("names").alias("at", "piece"))
    pieces = lookup_ids(parts, vocab, strict=True)
    whole = pieces.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "piece", F.col("id").cast("bigint").alias("id")))).alias("found"))
    found = F.transform("found", lambda x: F.struct(x["piece"].alias("piece"), x["id"].alias("id")))
    full = asked.select("word", "n").join(whole.select("word", found.alias("pieces")), "word", "left")
    shaped = shape_pieces(F.coalesce("pieces", F.expr(NO_PIECES)), F.col("word"), unk_as_word=unk_as_word)
    return store(full.withColumn("pieces", shaped), "dictionary")


def tokenize(
    words: DataFrame,
    dictionary: DataFrame,
    vocab: DataFrame | None = None,
    lower: bool = True,
    unk_as_word: bool = False,
    tokenizer: Tokenizer | None = None,
    near: Sequence[str] = (),
) -> DataFrame:
    """Attach ``pieces`` to every word row; a null word has none.

    Where ``word`` is a list of words, ``pieces`` is a list for each of them: the distinct
    words of rows that are equal in the columns ``near`` are then looked up together.

    Words that are not in the dictionary are tokenised with ``vocab`` (by ``tokenizer``,
    if given, and with the options the dictionary was made with) and join it; without
    ``vocab`` such a word is an error.
    """
    listed = isinstance(words.schema["word"].dataType, T.ArrayType)
    if vocab is not None:
        known = dictionary.select("word")
        each = words.select(F.explode("word").alias("word")) if listed else words
        unseen = word_counts(each.where("word IS NOT NULL")).join(known, "word", "left_anti")
        if tokenizer is None:
            unseen = word_dictionary(unseen, vocab, lower, unk_as_word)
        else:
            unseen = tokenizer_dictionary(store(unseen, "unseen"), vocab, tokenizer, unk_as_word)
        dictionary = store(dictionary.unionByName(unseen), "dictionary")
    if listed:
        return lookup_lists(words, dictionary, near or [c for c in words.columns if c != "word"])
    found = lookup(words, dictionary, "word", weight="n")
    kind = found.schema["pieces"].dataType
    empty = F.when(F.col("word").isNull(), F.array().cast(kind))
    missing = F.raise_error(F.concat(F.lit("word not in the dictionary: "), F.col("word"))).cast(kind)
    return found.withColumn("pieces", F.coalesce("pieces", empty, missing))


def words_without_pieces(words: DataFrame, dictionary: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Word rows that are null or clean to nothing, set aside for inspection."""
    return tokenize(words, dictionary, vocab).where(F.size("pieces") == 0).drop("pieces")
