"""Language of texts by a linear-chain conditional random field over their words.

Every word has one state, its language. Emission scores come from hashed affixes and
character n-grams of the word and from lexicons of frequent words; transition scores
say how readily neighbouring words change language. Both are learned together by
maximum likelihood on word sequences that are put together from labelled documents
of all languages, so that changes occur. Forward-backward gives each word's
probability of each language; a text's language is the one with the largest sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm.buffers import U64, column_bytes, mix, slices
from tagloom.llm.letters import code_points, word_bounds

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Bounds of the training sample: documents of a language, and characters read of each.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 4000
LEXICON = 300  # words of a language
SEQUENCE = 128  # words of a training sequence
STEPS = 60
_SLICE = 1 << 19  # bytes of text labelled at once
_BLOCK = 64
_FLOOR = -40.0


@dataclass(frozen=True)
class Model:
    """Weights of a field: rows of ``features`` are hashed features, columns languages."""

    languages: tuple[str, ...]
    features: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray  # sorted word hashes


def _padded(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each between two marks; and their offsets."""
    size = last - first + 2
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(ends[-1], np.uint64)
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    at = np.repeat(first, size) + inner - 1
    flat[:] = points[np.clip(at, 0, len(points) - 1)]
    flat[ends[:-1]] = 0x110001
    flat[ends[1:] - 1] = 0x110002
    return flat, ends


def _word_hashes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every marked word."""
    place = (np.arange(len(flat)) - np.repeat(ends[:-1], np.diff(ends)) + 1).astype(np.uint64)
    place *= U64(0x9E3779B97F4A7C15)
    place += flat * U64(0xD6E8FEB86659FD93)
    return mix(np.add.reduceat(mix(place), ends[:-1])) if len(ends) > 1 else flat[:0]


def _features(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: (word, bucket) pairs sorted by word.

    All bigrams and trigrams of the marked word (so affixes of one and two letters),
    and affixes of three letters.
    """
    n, count = len(flat), len(ends) - 1
    word = np.repeat(np.arange(count), np.diff(ends))
    h1 = mix(flat + U64(0x51ED27))
    padded = np.concatenate([h1, np.zeros(3, np.uint64)])
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)  # letters from here to the end
    h2 = padded[:n] * U64(3) + padded[1 : n + 1] * U64(5)
    h3 = h2 + padded[2 : n + 2] * U64(7)
    h4 = h3 + padded[3 : n + 3] * U64(11)
    at_start = np.zeros(n, bool)
    at_start[ends[:-1]] = True
    parts = []
    for size, h, where in ((2, h2, left >= 2), (3, h3, left >= 3), (4, h4, (left >= 4) & (at_start | (left == 4)))):
        i = np.flatnonzero(where)
        parts.append((word[i], (mix(h[i] + U64(size)) >> U64(20)) % U64(BUCKETS)))
    words, buckets = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(words, kind="stable")
    return words[order], buckets[order].astype(np.int64)


def _lexicon_rows(lexicon: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Row of ``Model.features`` of each word's lexicon entry; the last row stands for none."""
    if not len(lexicon):
        return np.full(len(whole), BUCKETS)
    at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
    return np.where(lexicon[at] == whole, BUCKETS + at, BUCKETS + len(lexicon))


def _emissions(weights: np.ndarray, words: np.ndarray, buckets: np.ndarray, lex: np.ndarray, count: int) -> np.ndarray:
    out = weights[lex].copy()
    for c in range(weights.shape[1]):
        out[:, c] += np.bincount(words, weights[buckets, c], count)
    return out


def posteriors(emissions: np.ndarray, ends: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of every state of every word; ``ends`` are offsets of the sequences.

    Sequences are cut into blocks. A block's product of transition and emission
    matrices carries the state across it, so that the number of steps is the length
    of a block plus the number of blocks of the longest sequence.
    """
    states = emissions.shape[1]
    if not len(emissions):
        return emissions
    move = np.exp(transitions - transitions.max())
    emit = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), _FLOOR))
    blocks = -(-np.diff(ends) // _BLOCK)
    sequence = np.repeat(np.arange(len(blocks)), blocks)
    nth = np.arange(len(sequence)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = ends[:-1][sequence] + nth * _BLOCK
    size = np.minimum(ends[1:][sequence] - begin, _BLOCK)
    order = np.argsort(-size, kind="stable")  # long blocks first: those with a step t are the first ones
    begin, size = begin[order], size[order]
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(_BLOCK)]  # blocks of more than t words
    total = len(size)

    carry = np.broadcast_to(np.eye(states), (total, states, states)).copy()
    for t, n in enumerate(active):
        if n:
            carry[:n] = (carry[:n].reshape(-1, states) @ move).reshape(n, states, states) * emit[begin[:n] + t][:, None, :]
    carry /= carry.max(axis=(1, 2), keepdims=True)

    place = np.empty(total, np.int64)
    place[order] = np.arange(total)  # of the blocks in text order
    offset = np.cumsum(blocks) - blocks
    into, out_of = np.empty((total, states)), np.empty((total, states))
    by_blocks = np.argsort(-blocks, kind="stable")
    most = int(blocks.max(initial=0))
    having = np.searchsorted(-blocks[by_blocks], -np.arange(most), "left")  # sequences of more than b blocks
    state = np.full((len(blocks), states), 1.0 / states)
    for b in range(most):
        live = by_blocks[: having[b]]
        at = place[offset[live] + b]
        into[at] = state[live]
        new = np.einsum("ni,nij->nj", state[live], carry[at])
        state[live] = new / new.sum(axis=1, keepdims=True)
    state = np.ones((len(blocks), states))
    for b in range(most - 1, -1, -1):
        live = by_blocks[: having[b]]
        at = place[offset[live] + b]
        out_of[at] = state[live]
        new = np.einsum("nij,nj->ni", carry[at], state[live])
        state[live] = new / new.max(axis=1, keepdims=True)

    result = np.empty_like(emit)
    for t, n in enumerate(active):
        if n:
            new = (into[:n] @ move) * emit[begin[:n] + t]
            into[:n] = new / new.sum(axis=1, keepdims=True)
            result[begin[:n] + t] = into[:n]
    for t in range(_BLOCK - 1, -1, -1):
        n = active[t]
        if n:
            i = begin[:n] + t
            result[i] *= out_of[:n]
            new = (emit[i] * out_of[:n]) @ move.T
            out_of[:n] = new / new.max(axis=1, keepdims=True)
    return result / result.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """Maximum-likelihood field for a bounded list of labelled texts; None without any word.

    Texts are cut into pieces of 4 to 40 words, which are shuffled and strung together.
    """
    languages = tuple(sorted(set(langs)))
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    points, offsets = code_points(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    if not len(points):
        return None
    points, first, last, row = word_bounds(points, offsets)
    if not len(first):
        return None
    flat, ends = _padded(points, first, last)
    whole = _word_hashes(flat, ends)
    del flat, ends
    label = np.searchsorted(np.array(languages), np.array(langs))[row]
    distinct, index, inverse = np.unique(whole, return_index=True, return_inverse=True)
    counts = np.zeros((len(languages), len(distinct)))
    np.add.at(counts, (label, inverse), 1)
    top = np.argsort(-counts, axis=1, kind="stable")[:, :LEXICON]
    lexicon = np.unique(distinct[np.unique(top)])
    words, buckets = _features(*_padded(points, first[index], last[index]))
    lex = _lexicon_rows(lexicon, distinct)

    rng = np.random.default_rng(seed)
    n_states, total = len(languages), len(whole)
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), np.cumsum(rng.integers(4, 41, total // 4 + 1))]))
    cuts = np.append(cuts[cuts < total], total)
    pieces = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    line = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
    line = np.resize(line, -(-total // SEQUENCE) * SEQUENCE)  # the last sequence is filled from the beginning
    word_at, label_at = inverse[line].reshape(-1, SEQUENCE), label[line].reshape(-1, SEQUENCE)
    n = len(word_at)
    rows = np.arange(n)

    features = np.zeros((BUCKETS + len(lexicon) + 1, n_states))
    transitions = np.zeros((n_states, n_states))
    squares = [np.full_like(features, 1e-8), np.full_like(transitions, 1e-8)]
    seen = np.bincount(word_at.ravel() * n_states + label_at.ravel(), minlength=len(distinct) * n_states).reshape(-1, n_states)
    pairs = np.bincount((label_at[:, :-1] * n_states + label_at[:, 1:]).ravel(), minlength=n_states**2).reshape(n_states, -1)
    for _ in range(STEPS):
        scores = _emissions(features, words, buckets, lex, len(distinct))
        emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), _FLOOR))[word_at]
        move = np.exp(transitions - transitions.max())
        ahead = np.empty_like(emit)
        state = np.full((n, n_states), 1.0 / n_states)
        for t in range(SEQUENCE):
            state = ((state @ move) if t else state) * emit[:, t]
            state /= state.sum(axis=1, keepdims=True)
            ahead[:, t] = state
        behind = np.ones((n, n_states))
        expected = np.zeros((len(distinct), n_states))
        crossed = np.zeros((n_states, n_states))
        for t in range(SEQUENCE - 1, -1, -1):
            gamma = ahead[:, t] * behind
            gamma /= gamma.sum(axis=1, keepdims=True)
            for c in range(n_states):
                expected[:, c] += np.bincount(word_at[:, t], gamma[:, c], len(distinct))
            right = emit[:, t] * behind
            if t:
                norm = np.einsum("ni,ij,nj->n", ahead[:, t - 1], move, right)
                crossed += move * ((ahead[:, t - 1] / norm[:, None]).T @ right)
            behind = right @ move.T
            behind /= behind.max(axis=1, keepdims=True)
        error = (seen - expected) / total
        gradient = np.zeros_like(features)
        for c in range(n_states):
            gradient[:, c] = np.bincount(buckets, error[words, c], len(features))
            gradient[:, c] += np.bincount(lex, error[:, c], len(features))
        gradient[-1] = 0  # no score for a word outside all lexicons
        for value, slope, square in (
            (features, gradient - 1e-7 * features, squares[0]),
            (transitions, (pairs - crossed) / total - 1e-7 * transitions, squares[1]),
        ):
            square += slope * slope
            value += 0.3 * slope / np.sqrt(square)
    return Model(languages, features, transitions, lexicon)


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, where: Column, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """At most ``most`` labelled documents of each language, of each no more than the first ``chars`` characters.

    Which ones depends on a hash of the id alone. The first filter leaves a few times
    as many rows a language, so that ranking them is a small task.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40)).alias("at"),
        F.substring(text_col, 1, chars).alias("text"),
    )
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(float(4 * most << 40)) / F.col("n")).alias("below"))
    # One row a language, of which the model holds a square.
    ranked = rows.join(F.broadcast(share), "lang").where("at < below").withColumn(
        "nth", F.row_number().over(W.partitionBy("lang").orderBy("at", "text"))
    )
    return ranked.where(F.col("nth") <= most).select("lang", "text")


def train(sample: DataFrame) -> Model | None:
    """Fit the field on a bounded sample (lang, text)."""
    rows = sorted((r.lang, r.text) for r in sample.collect())
    return fit([t for _, t in rows], [x for x, _ in rows]) if rows else None


def label(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Posterior sums by row, words by row, and each word's row and best language."""
    states = len(model.languages)
    points, ends = code_points(data, offsets)
    rows = len(offsets) - 1
    if len(points):
        points, first, last, row = word_bounds(points, ends)
    if not len(points) or not len(first):
        return np.zeros((rows, states)), np.zeros(rows, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = _word_hashes(*_padded(points, first, last))
    hashes, index, inverse = np.unique(whole, return_index=True, return_inverse=True)
    words, buckets = _features(*_padded(points, first[index], last[index]))
    scores = _emissions(model.features, words, buckets, _lexicon_rows(model.lexicon, hashes), len(index))
    counts = np.bincount(row, minlength=rows)
    gamma = posteriors(scores[inverse], np.concatenate([[0], np.cumsum(counts)]), model.transitions)
    sums = np.stack([np.bincount(row, gamma[:, c], rows) for c in range(states)], axis=1)
    return sums, counts, row, gamma.argmax(axis=1)


def _predict(
    columns: Iterator[tuple[pa.Array, pa.Array]], model: Model | None, name: str
) -> Iterator[pa.RecordBatch]:
    names = np.array([*(model.languages if model else ()), UNKNOWN], dtype=object)
    for carried, texts in columns:
        data, offsets = column_bytes(texts)
        for i, j in slices(offsets, _SLICE):
            n = j - i
            best, score, words, switches = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if model:
                sums, words, row, state = label(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = words > 0
                best[some] = sums[some].argmax(axis=1)
                score[some] = np.clip(sums[some].max(axis=1) / words[some], 0, 1)
                changed = np.flatnonzero((row[1:] == row[:-1]) & (state[1:] != state[:-1]))
                switches = np.bincount(row[changed], minlength=n)
            yield pa.record_batch(
                {
                    name: carried[i:j],
                    "lang_pred": pa.array(names[best], pa.string()),
                    "score": pa.array(score),
                    "n_words": pa.array(words.astype(np.int64)),
                    "n_switches": pa.array(switches.astype(np.int64)),
                }
            )


def predict(docs: DataFrame, id_col: str, text_col: str, model: Model | None, whole_rows: bool = False) -> DataFrame:
    """(id, lang_pred, score, n_words, n_switches) of every row; ``whole_rows``: (row, ...), a struct of all columns.

    ``lang_pred`` is the language with the largest sum of word probabilities (of equal
    ones the first by name), ``score`` its mean probability over the words,
    ``n_switches`` how often the most probable language changes from word to word. A
    text that is null or has no letter, and any text under a model of None, gets
    ``und``, 0, 0, 0. Rows with null or repeated ids are rows like any other; an empty
    table gives no rows; further columns, whatever their names, do not matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: hashed features and lexicons
    added = "lang_pred string, score double, n_words long, n_switches long"
    if whole_rows:
        rows = docs.select(F.struct(*docs.columns).alias("row"))
        place, kind = docs.columns.index(text_col), rows.schema["row"].dataType.simpleString()
        return rows.mapInArrow(
            lambda it: _predict(((b.column(0), b.column(0).field(place)) for b in it), held.value, "row"),
            f"row {kind}, {added}",
        )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        lambda it: _predict(((b.column(0), b.column(1)) for b in it), held.value, "id"), f"id long, {added}"
    )


def _segments(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for i, j in slices(offsets):
            _, counts, row, state = label(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (state[1:] != state[:-1])]) if len(row) else [])
            nth = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            yield pa.record_batch(
                {
                    "id": batch.column(0)[i:j].take(pa.array(row[new])),
                    "first_word": pa.array(nth[new].astype(np.int64)),
                    "n_words": pa.array(np.diff(np.append(new, len(row))).astype(np.int64)),
                    "lang": pa.array(np.array(model.languages, dtype=object)[state[new]], pa.string()),
                }
            )


def segments(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Runs of words in one language: (id, first_word, n_words, lang); texts without letters have none."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda it: _segments(it, held.value), "id long, first_word long, n_words long, lang string"
    )
