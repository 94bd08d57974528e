"""Text analysis as Column expressions.

A token is a maximal run of ASCII letters, digits and ``$ % & + @``; every other
character, hence every byte of a non-ASCII letter, separates tokens.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stemmer import porter2

TOKEN_CLASS = "0-9A-Za-z$%&+@"

# The 136 English stop words the engine skips, compared with the
# lower-cased, unstemmed token.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what
    which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up
    down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too
    very s t can will just don should now n like good go going get one got could
    """.split()
)

#: Offsets at or above this are stored as OFFSET_LIMIT - 1 in an index.
OFFSET_LIMIT = 15


def plain_text(col: Column) -> Column:
    """Null counts as an empty document."""
    return F.coalesce(col.cast("string"), F.lit(""))


def tokens(col: Column, skip_stop_words: bool = True) -> Column:
    """Lower-cased tokens in text order, duplicates kept."""
    # Split first: lower() turns a few non-ASCII capitals into ASCII letters.
    found = F.transform(
        F.regexp_extract_all(plain_text(col), F.lit(f"([{TOKEN_CLASS}]+)"), 1), F.lower
    )
    if not skip_stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(lists: pa.Array) -> pa.Array:
    """Stem each token; within a batch every distinct token is stemmed once."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = pc.list_flatten(lists)
    coded = flat.dictionary_encode()
    stems = pa.array([porter2(t) for t in coded.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    values = stems.take(coded.indices) if len(flat) else pa.array([], pa.string())
    return pa.ListArray.from_arrays(offsets, values)


def stemmed_tokens(col: Column, skip_stop_words: bool = True) -> Column:
    """Tokens, stop words skipped before stemming."""
    return F.filter(stem_all(tokens(col, skip_stop_words)), lambda t: t != "")


def trigram_words(col: Column) -> Column:
    """Words that yield trigrams: two letters or more; a two-letter word at the very
    end of the text has no delimiter behind it and yields none."""
    text = F.regexp_replace(plain_text(col), rf"(?<![{TOKEN_CLASS}])[{TOKEN_CLASS}]{{2}}\z", "")
    return F.transform(F.regexp_extract_all(text, F.lit(f"([{TOKEN_CLASS}]{{2,}})"), 1), F.lower)


def word_trigrams(word: Column) -> Column:
    """``array<struct<tri, off>>`` of one word; the offset wraps at 256."""
    at = F.sequence(F.lit(0), F.greatest(F.length(word) - 3, F.lit(0)))
    return F.transform(
        at,
        lambda i: F.struct(
            F.substring(word, i + 1, F.lit(3)).alias("tri"), (i % 256).cast("int").alias("off")
        ),
    )


def trigram_places(word: Column) -> Column:
    """The offsets at which a word's trigrams begin, unwrapped."""
    return F.sequence(F.lit(0), F.greatest(F.length(word) - 3, F.lit(0)))


def n_trigrams(words: Column) -> Column:
    """Number of trigrams that the words yield."""
    one = lambda w: F.greatest(F.length(w) - 2, F.lit(1)).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + one(w))


def clamp_offset(off: Column) -> Column:
    return F.least(off, F.lit(OFFSET_LIMIT - 1)).cast("int")


_TOKEN = re.compile(f"[{TOKEN_CLASS}]+")
_TAIL = re.compile(rf"(?<![{TOKEN_CLASS}])[{TOKEN_CLASS}]{{2}}\Z")
_STOPS = frozenset(STOP_WORDS)


def query_tokens(text: str, stem: bool = True, skip_stop_words: bool = True) -> list[str]:
    """Tokens of one query text on the driver; same rules as the columns above."""
    found = [t.lower() for t in _TOKEN.findall(text or "")]
    if skip_stop_words:
        found = [t for t in found if t not in _STOPS]
    return [s for s in map(porter2, found) if s] if stem else found


def query_trigrams(text: str) -> list[tuple[str, int]]:
    """Trigrams of one query text with raw, unclamped offsets."""
    out = []
    for word in _TOKEN.findall(_TAIL.sub("", text or "")):
        if len(word) >= 2:
            low = word.lower()
            out += [(low[i : i + 3], i % 256) for i in range(max(len(low) - 2, 1))]
    return out
