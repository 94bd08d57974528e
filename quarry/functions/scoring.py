"""Ranking formulas as Column expressions.

A scoring function maps (tf, doc_len, avg_len, idf) columns to a score column; it is
the engine's extension point. Inverse document frequency is computed once per term.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

Scoring = Callable[[Column, Column, Column, Column], Column]

BM25_K1 = 1.5
BM25_B = 0.75


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(
    tf: Column, doc_len: Column, avg_len: Column, idf: Column, k1: float = BM25_K1, b: float = BM25_B
) -> Column:
    tf = tf.cast("double")
    relative = doc_len.cast("double") / F.nullif(avg_len.cast("double"), F.lit(0.0))
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.coalesce(relative, F.lit(0.0)))
    return F.coalesce(idf * (tf * F.lit(k1 + 1.0)) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))


def tf_idf(tf: Column, doc_len: Column, avg_len: Column, idf: Column) -> Column:
    share = tf.cast("double") / F.nullif(doc_len.cast("double"), F.lit(0.0))
    return F.coalesce(share * idf, F.lit(0.0))


def bm25_with(k1: float, b: float) -> Scoring:
    return partial(bm25, k1=k1, b=b)


SCORINGS: dict[str, Scoring] = {"bm25": bm25, "tf-idf": tf_idf}


def resolve(scoring: str | Scoring) -> Scoring:
    if callable(scoring):
        return scoring
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}; choose one of {sorted(SCORINGS)}")
    return SCORINGS[scoring]
