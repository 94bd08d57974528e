"""Counting the terms and trigrams of whole documents, batch by batch.

A document's counts come out of its own row, so nothing is grouped by document afterwards
and a task holds one batch of texts, however large its partition. The rules are those of
``quarry.functions.text``, applied to the bytes of a batch: all characters of tokens are ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stemmer import porter2
from quarry.functions.text import OFFSET_LIMIT, STOP_WORDS

_IN_TOKEN = np.zeros(256, bool)
for _c in range(128):
    _IN_TOKEN[_c] = chr(_c).isalnum() or chr(_c) in "$%&+@"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOPS = pa.array(STOP_WORDS)


def _counted(each: T.DataType) -> T.StructType:
    return T.StructType().add("doc_len", T.LongType()).add("counts", T.ArrayType(each))


_TERMS = _counted(T.StructType().add("term", T.StringType()).add("tf", T.LongType()))
_GRAMS = _counted(T.LongType())


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where each text ends, and of each token start, end and text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside, n = _IN_TOKEN[data], len(data)
    joined = np.zeros(n + 1, bool)  # place i belongs to the token of place i - 1
    joined[1:n] = inside[1:] & inside[:-1]
    joined[bounds] = False
    starts = np.flatnonzero(inside & ~joined[:n])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return _LOWER[data], bounds[1:], starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _listed(owner: np.ndarray, n: int, values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A row (length, list) for each of n texts; owner: the text of each value, ascending."""
    at = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=at[1:])
    return pa.StructArray.from_arrays(
        [pa.array(lengths.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), values)], ["doc_len", "counts"]
    )


def _coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The text of each token, the distinct tokens, and which of them each token is."""
    low, _, starts, ends, text = _tokens(texts)
    sizes = ends - starts
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    first = np.repeat(starts - places[:-1], sizes)
    packed = low[first + np.arange(places[-1])]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(packed))
    coded = words.cast(pa.string()).dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy()
    return text, known, codes


def _term_counts(texts: pa.Array, stem: bool) -> pa.Array:
    n = len(texts)
    kind = pa.struct([("term", pa.string()), ("tf", pa.int64())])
    if not n:
        return _listed(np.zeros(0, int), 0, pa.array([], kind), np.zeros(0))
    text, known, codes = _coded(texts)
    keep = ~pc.is_in(known, _STOPS).to_numpy(zero_copy_only=False)
    if stem:
        known = pa.array([porter2(t) if k else "" for t, k in zip(known.to_pylist(), keep, strict=True)], pa.string())
        recoded = known.dictionary_encode()
        keep, codes, known = keep[codes], recoded.indices.to_numpy()[codes], recoded.dictionary
    else:
        keep = keep[codes]
    key, tf = np.unique(text[keep] * np.int64(max(len(known), 1)) + codes[keep], return_counts=True)
    owner, code = np.divmod(key, max(len(known), 1))
    values = pa.StructArray.from_arrays([known.take(pa.array(code)), pa.array(tf.astype(np.int64))], ["term", "tf"])
    return _listed(owner, n, values, np.bincount(text[keep], minlength=n))


def _words_of_trigrams(texts: pa.Array):
    low, stop, starts, ends, text = _tokens(texts)
    size = ends - starts
    keep = (size > 2) | ((size == 2) & (ends != stop[text]))
    return low, starts[keep], size[keep], text[keep]


def _trigram_counts(texts: pa.Array) -> pa.Array:
    n = len(texts)
    if not n:
        return _listed(np.zeros(0, int), 0, pa.array([], pa.int64()), np.zeros(0))
    low, starts, size, text = _words_of_trigrams(texts)
    low = np.concatenate([low, np.zeros(2, np.uint8)]).astype(np.int64)
    many = np.maximum(size - 2, 1)
    word = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
    place = starts[word] + at
    third = np.where(size[word] > 2, low[place + 2], 0)
    key = (((text[word] << 7 | low[place]) << 7 | low[place + 1]) << 7 | third) << 8 | at % 256
    key, tf = np.unique(key, return_counts=True)
    # a value: count, three characters of 7 bits (the third of a word of two is 0), clamped offset
    value = (tf << 21 | (key >> 8) & 0x1FFFFF) << 4 | np.minimum(key & 255, OFFSET_LIMIT - 1)
    return _listed(key >> 29, n, pa.array(value), np.bincount(text, many, n))


@F.arrow_udf(_TERMS)
def term_counts(texts: pa.Array) -> pa.Array:
    """Tokens of a text without stop words: how many, and each distinct one's count."""
    return _term_counts(texts, False)


@F.arrow_udf(_TERMS)
def stem_counts(texts: pa.Array) -> pa.Array:
    """As ``term_counts``, of the tokens' stems."""
    return _term_counts(texts, True)


@F.arrow_udf(_GRAMS)
def gram_counts(texts: pa.Array) -> pa.Array:
    """Trigrams of a text: how many, and the count of each trigram and raw offset; see ``gram``."""
    return _trigram_counts(texts)


@F.arrow_udf(T.LongType())
def term_total(texts: pa.Array) -> pa.Array:
    """The length of ``term_counts`` alone; a stem is never empty, so it holds for stems too."""
    n = len(texts)
    if not n:
        return pa.array([], pa.int64())
    text, known, codes = _coded(texts)
    keep = ~pc.is_in(known, _STOPS).to_numpy(zero_copy_only=False)
    return pa.array(np.bincount(text[keep[codes]], minlength=n).astype(np.int64))


@F.arrow_udf(T.LongType())
def gram_total(texts: pa.Array) -> pa.Array:
    """The length of ``gram_counts`` alone."""
    if not len(texts):
        return pa.array([], pa.int64())
    _, _, size, text = _words_of_trigrams(texts)
    return pa.array(np.bincount(text, np.maximum(size - 2, 1), len(texts)).astype(np.int64))


def gram_key(value: Column) -> Column:
    """The trigram and the clamped offset of a value of ``gram_counts``, as a number."""
    return value.bitwiseAND(F.lit((1 << 25) - 1))


def gram(value: Column) -> dict[str, Column]:
    """tri, off and tf of a value of ``gram_counts``."""
    char = lambda shift: F.char(F.shiftright(value, shift).bitwiseAND(F.lit(127)))
    third = F.shiftright(value, 4).bitwiseAND(F.lit(127)) == 0
    return {
        "tri": F.concat(char(18), char(11), F.when(third, F.lit("")).otherwise(char(4))),
        "off": value.bitwiseAND(F.lit(15)).cast("int"),
        "tf": F.shiftright(value, 25),
    }
