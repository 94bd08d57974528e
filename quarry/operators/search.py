"""Ranked search: key join, score, sum, top k. One path serves both index kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scoring as S
from quarry.functions import text as A
from quarry.operators.index import Index, source_bytes

#: A score is the sum of its contributions' multiples of COARSE and of what is left in
#: multiples of FINE. Both sums are exact in a double (up to 2^22 contributions' worth), so a
#: score does not depend on the order of summation, equal documents tie, and scores far
#: below 1 keep their digits.
COARSE, FINE = 2.0**-30, 2.0**-76
RESULT = "query string, rank int, doc_id long, score double"


def exact_sum(value: Column) -> Column:
    coarse = F.rint(value / F.lit(COARSE)) * F.lit(COARSE)
    fine = F.rint((value - coarse) / F.lit(FINE)) * F.lit(FINE)
    return F.sum(coarse) + F.sum(fine)


def _ranked_sum(index: Index, wanted: DataFrame, by: list[str], scorings: dict, few: bool) -> DataFrame:
    """wanted: ``by`` columns, key columns, ``times``, ``n_keys``. A column of sums for each name
    in ``scorings``. few: the wanted keys go to the postings, not the postings to the keys; a
    document's postings lie in one partition then, and so its sums need no exchange either."""
    weighted = wanted.join(
        index.term_stats.select(
            *index.keys, S.idf(F.lit(index.n), F.col("df")).alias("_idf")
        ),
        index.keys,
    )
    hits = index.sought().join(F.broadcast(weighted) if few else weighted, index.keys)

    def total(score) -> Column:
        value = score(F.col("tf"), F.col("doc_len"), F.lit(float(index.avg_len)), F.col("_idf"))
        if index.algorithm == "trigram":
            value = value / F.col("n_keys")
        return exact_sum(value * F.col("times"))

    return hits.groupBy(*by, "doc_id").agg(*(total(S.resolve(s)).alias(name) for name, s in scorings.items()))


def search(index: Index, query: str, scoring="bm25", k: int = 10) -> DataFrame:
    """(rank, doc_id, score) of one query. Its keys are pushed into the postings scan as
    an ``IN`` filter; the ranking is a TakeOrderedAndProject."""
    spark = index.postings.sparkSession
    if index.algorithm == "trigram":
        found = A.query_trigrams(query)
        schema = "tri string, off int, times long, n_keys long"
    else:
        found = [(t,) for t in A.query_tokens(query, index.stemmed)]
        schema = "term string, times long, n_keys long"
    counts: dict[tuple, int] = {}
    for key in found:
        counts[key] = counts.get(key, 0) + 1
    wanted = spark.createDataFrame([(*key, n, len(found)) for key, n in counts.items()], schema)
    narrowed = index
    first = index.keys[0]
    if counts:
        only = F.col(first).isin(*sorted({key[0] for key in counts}))
        narrowed = Index(
            index.algorithm, index.sought().where(only), index.term_stats.where(only), index.doc_stats,
            index.n, index.avg_len, index.stemmed,
        )
    summed = _ranked_sum(narrowed, wanted, [], {"score": scoring}, True)
    top = summed.orderBy(F.desc("score"), F.desc("doc_id")).limit(max(k, 0))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("doc_id")))
    return top.select(rank.cast("int").alias("rank"), "doc_id", "score")


def query_keys(index: Index, queries: DataFrame) -> DataFrame:
    """Key multiset of each query: (query_id, keys, times, n_keys)."""
    content = F.col("content")
    if index.algorithm == "trigram":
        grams = queries.select(
            "query_id", F.flatten(F.transform(A.trigram_words(content), A.word_trigrams)).alias("g")
        )
        rows = grams.select("query_id", F.size("g").cast("long").alias("n_keys"), F.inline("g"))
    else:
        make = A.stemmed_tokens if index.stemmed else A.tokens
        toks = queries.select("query_id", make(content).alias("g"))
        rows = toks.select("query_id", F.size("g").cast("long").alias("n_keys"), F.explode("g").alias("term"))
    return rows.groupBy("query_id", "n_keys", *index.keys).agg(F.count("*").alias("times"))


#: Bytes of queries up to which their keys go to all executors.
FEW_BYTES = 8 << 20


def rank_batch(index: Index, queries: DataFrame, scorings: dict, k: int = 10) -> DataFrame:
    """(scoring, query_id, rank, doc_id, score) for ``queries(query_id, content)`` by several
    named scorings, from one pass over the postings. Postings of keys that no query has go
    before anything is counted or joined. The window keeps k rows per query before and after
    the shuffle."""
    size = source_bytes(queries)
    few = size is not None and size <= FEW_BYTES
    wanted = query_keys(index, queries)
    asked = wanted.select(*index.keys).distinct()
    only = lambda d: d.join(F.broadcast(asked) if few else asked, index.keys, "left_semi")
    narrowed = Index(
        index.algorithm, only(index.sought()), only(index.term_stats), index.doc_stats, index.n, index.avg_len, index.stemmed
    )
    summed = _ranked_sum(narrowed, wanted, ["query_id"], {f"_{i}": s for i, s in enumerate(scorings.values())}, few)
    each = F.array(*(F.struct(F.lit(name).alias("scoring"), F.col(f"_{i}").alias("score")) for i, name in enumerate(scorings)))
    scored = summed.select("query_id", "doc_id", F.inline(each))
    order = Window.partitionBy("scoring", "query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("scoring", "query_id", "rank", "doc_id", "score")
    )


def search_batch(index: Index, queries: DataFrame, scoring="bm25", k: int = 10) -> DataFrame:
    """(query_id, query, rank, doc_id, score) for ``queries(query_id, content)`` in one
    job. ``query_id`` tells lines apart, also equal ones."""
    top = rank_batch(index, queries, {"": scoring}, k)
    names = queries.select("query_id", F.col("content").alias("query"))
    return top.join(names, "query_id").select("query_id", "query", "rank", "doc_id", "score")
