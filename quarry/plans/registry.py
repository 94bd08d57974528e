"""Queries over ``documents`` and ``benchmark``: callables (spark, sf_dir) -> DataFrame,
and the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as A
from quarry.functions.stemmer import porter2  # noqa: F401  (part of the surface)
from quarry.operators import evaluation as E
from quarry.operators.index import build_inverted, build_trigram, inverted_tokens, load_index, trigram_counts
from quarry.operators.search import rank_batch, search, search_batch
from quarry.plans.stem_sql import stems
from quarry.sources import readers as R
from quarry.sources import writers as W
from quarry.sources.scratch import scratch_path

QUERY = "worthless the example of another going thatned about"
DIGITS = 6


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, whole, serves as a query text."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))


def _out(df: DataFrame) -> DataFrame:
    """Scores are returned to nine significant digits; logarithms differ between engines."""
    return df.withColumn("score", F.format_string("%.8e", "score").cast("double"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search(build_trigram(documents(spark, sf_dir)), QUERY, "bm25", 10))


def tokens_simple(spark, d):
    toks = documents(spark, d).select("doc_id", A.tokens(F.col("text"), False).alias("t"))
    return toks.select("doc_id", F.posexplode("t").alias("pos", "token"))


def tokens_no_stop_words(spark, d):
    toks = documents(spark, d).select("doc_id", A.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.posexplode("t").alias("pos", "token"))


def term_freq(spark, d):
    return build_inverted(documents(spark, d), stem=False).postings.select("term", "doc_id", "tf")


def doc_length(spark, d):
    return inverted_tokens(documents(spark, d), stem=False).select("doc_id", "doc_len")


def doc_freq(spark, d):
    return build_inverted(documents(spark, d), stem=False).term_stats


def corpus_stats(spark, d):
    index = build_inverted(documents(spark, d), stem=False)
    return index.doc_stats.agg(
        (F.max("doc_id") + 1).alias("n"),
        F.round(F.sum("doc_len") / (F.max("doc_id") + 1), DIGITS).alias("avg_len"),
    )


def trigram_postings(spark, d):
    return trigram_counts(documents(spark, d))[0]


def trigram_doc_freq(spark, d):
    return build_trigram(documents(spark, d)).term_stats


def trigram_stop_keys(spark, d):
    return build_trigram(documents(spark, d)).extra["stop_keys"]


def _single(kind, scoring):
    def run(spark, d):
        docs = documents(spark, d)
        index = build_trigram(docs) if kind == "trigram" else build_inverted(docs, stem=kind == "stemmed")
        return _out(search(index, QUERY, scoring, 10))

    return run


def _batch(kind, scoring, k):
    def run(spark, d):
        docs = documents(spark, d)
        index = build_trigram(docs) if kind == "trigram" else build_inverted(docs, stem=kind == "stemmed")
        ranked = search_batch(index, benchmark_queries(spark, d), scoring, k)
        return _out(ranked.select("query_id", "rank", "doc_id", "score"))

    return run


def overlap_at_100(spark, d):
    """Both rankings come from one pass over the postings; they are written, as each is read."""
    index, path = build_inverted(documents(spark, d), stem=False), scratch_path(spark, "rankings")
    rank_batch(index, benchmark_queries(spark, d), {s: s for s in ("bm25", "tf-idf")}, 100).write.parquet(path)
    ranked = spark.read.parquet(path)
    return E.overlap_at_k(*(ranked.where(F.col("scoring") == s) for s in ("bm25", "tf-idf")), 100)


def score_diff(spark, d):
    index = build_inverted(documents(spark, d), stem=False)
    a, b = (search(index, QUERY, s, 100) for s in ("bm25", "tf-idf"))
    return E.score_difference(a, b).select("matches", F.round("sum_abs_diff", DIGITS).alias("sum_abs_diff"))


def known_item_rank(spark, d):
    """Expected: the document whose id equals the benchmark item's id."""
    q = benchmark_queries(spark, d)
    ranked = search_batch(build_inverted(documents(spark, d), stem=False), q, "bm25", 10)
    expected = q.select(F.col("content").alias("query"), F.col("query_id").alias("document")).distinct()
    return E.known_item_rank(expected, ranked)


def stem_vocabulary(spark, d):
    toks = documents(spark, d).select(F.explode(A.tokens(F.col("text"))).alias("token")).distinct()
    return toks.select("token", A.stem_all(F.array("token"))[0].alias("stem"))


def index_stats(spark, d):
    return build_inverted(documents(spark, d), stem=False).stats().drop("approx_terms", "stored_bytes")


def approx_vocabulary(spark, d):
    """The exact number of terms, and whether the estimate is within three standard errors."""
    near = F.abs(F.col("approx_terms") / F.col("n_terms") - 1) <= 3 * 0.092
    return build_inverted(documents(spark, d), stem=False).stats().select("n_terms", near.alias("estimate_is_near"))


def dense_reid(spark, d):
    from quarry.sources.readers import dense_ids

    return dense_ids(spark, f"{d}/documents.parquet", "text").select("Id", "text")


def _saved(kind, scoring):
    """Build, save, load, and answer from the stored index."""

    def run(spark, d):
        docs, path = documents(spark, d), scratch_path(spark, f"index-{kind}")
        (build_trigram(docs) if kind == "trigram" else build_inverted(docs, stem=kind == "stemmed")).save(path)
        return _out(search(load_index(spark, path), QUERY, scoring, 10))

    return run


def source_by_position(spark, d):
    path = scratch_path(spark, "corpus")
    W.write_corpus(documents(spark, d).select("text", "doc_id"), path)
    return R.load_documents(spark, path)


def source_csv(spark, d):
    path = scratch_path(spark, "csv")
    one_line = F.regexp_replace("text", "[\\r\\n]", " ")
    table = documents(spark, d).select(one_line.alias("body"), F.col("doc_id").alias("key"))
    exact = {"escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.write.options(header=True, **exact).csv(path)
    return R.read_corpus_csv(spark, path, "body", "key")


def source_query_files(spark, d):
    path = scratch_path(spark, "queries")
    b = benchmark_queries(spark, d).coalesce(1).sortWithinPartitions("query_id")
    b.select(F.regexp_replace("content", "[\\r\\n]", " ").alias("value")).write.text(path)
    return R.read_queries(spark, path).select("line", "content")


def sink_result_table(spark, d):
    path = scratch_path(spark, "results")
    docs = documents(spark, d)
    ranked = search_batch(build_inverted(docs, stem=False), benchmark_queries(spark, d), "bm25", 10)
    # one line per hit: the query's text is named by its number here
    named = ranked.select("query_id", "rank", "doc_id", "score", F.col("query_id").cast("string").alias("query"))
    return R.read_results(spark, W.write_results(named, path, "bm25"))


def sink_rank_csv(spark, d):
    path = W.write_ranks(known_item_rank(spark, d).withColumn("query", F.md5("query")), scratch_path(spark, "ranks"))
    return spark.read.schema("query string, rank int, document long").csv(path, header=True)


def source_score_csv(spark, d):
    path = scratch_path(spark, "scores")
    sized = build_inverted(documents(spark, d), stem=False).doc_stats
    rows = sized.select("doc_id", F.col("doc_len").cast("double")).orderBy("doc_id")
    rows.write.csv(path)
    return R.read_scores(spark, path)


def source_id_list(spark, d):
    path = scratch_path(spark, "ids")
    documents(spark, d).select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return R.read_id_list(spark, path)


def source_search_dump(spark, d):
    """Benchmark passages as hits of a saved response, some in triple quotes."""
    path = scratch_path(spark, "dump")
    plain = F.regexp_replace("content", r'["\\\\]', " ")
    value = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit('"""'), plain, F.lit('"""'))).otherwise(
        F.expr("regexp_extract(to_json(array(p)), '(?s)^.(.*).$', 1)")
    )
    hit = F.concat(F.lit('{"_source": {"column1": '), value, F.lit("}}"))
    rows = benchmark_queries(spark, d).withColumn("p", plain).select(F.struct("query_id", hit.alias("h")).alias("x"))
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ", ").alias("h"))
    whole.select(F.concat(F.lit('{"hits": {"hits": ['), "h", F.lit("]}}")).alias("value")).coalesce(1).write.text(path)
    return R.read_search_dump(spark, path)


QUERIES = {
    "tokens_simple": tokens_simple,
    "token_stopword_filtered": tokens_no_stop_words,
    "term_freq": term_freq,
    "doc_length": doc_length,
    "doc_freq": doc_freq,
    "corpus_stats": corpus_stats,
    "trigram_postings": trigram_postings,
    "trigram_doc_freq": trigram_doc_freq,
    "trigram_stop_keys": trigram_stop_keys,
    "trigram_bm25_topk": _single("trigram", "bm25"),
    "trigram_tfidf_topk": _single("trigram", "tf-idf"),
    "trigram_batch_topk": _batch("trigram", "bm25", 10),
    "inverted_unstemmed_bm25_topk": _single("plain", "bm25"),
    "inverted_unstemmed_tfidf_topk": _single("plain", "tf-idf"),
    "inverted_unstemmed_batch_topk": _batch("plain", "bm25", 10),
    "inverted_bm25_topk": _single("stemmed", "bm25"),
    "inverted_tfidf_topk": _single("stemmed", "tf-idf"),
    "inverted_batch_topk": _batch("stemmed", "bm25", 10),
    "overlap_at_100": overlap_at_100,
    "score_diff": score_diff,
    "known_item_rank": known_item_rank,
    "stem_vocabulary": stem_vocabulary,
    "index_stats": index_stats,
    "approx_vocabulary": approx_vocabulary,
    "dense_reid": dense_reid,
    "saved_inverted_topk": _saved("plain", "bm25"),
    "saved_stemmed_topk": _saved("stemmed", "tf-idf"),
    "saved_trigram_topk": _saved("trigram", "bm25"),
    "source_by_position": source_by_position,
    "source_csv": source_csv,
    "source_query_files": source_query_files,
    "source_score_csv": source_score_csv,
    "source_id_list": source_id_list,
    "source_search_dump": source_search_dump,
    "sink_result_table": sink_result_table,
    "sink_rank_csv": sink_rank_csv,
}

# --- oracles -------------------------------------------------------------------------

_C = A.TOKEN_CLASS
_STOP = ", ".join(f"'{w}'" for w in A.STOP_WORDS)
_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_QUERY = f"SELECT 0::BIGINT AS query_id, '{QUERY}' AS content"
_BENCH = "SELECT item_id AS query_id, text AS content FROM benchmark"


def _words(source: str, ident: str, text: str, stop: bool = True) -> str:
    """(ident, pos, token) of a relation."""
    listed = f"[lower(x) FOR x IN regexp_extract_all({text}, '[{_C}]+')]"
    if stop:
        listed = f"[y FOR y IN {listed} IF y NOT IN ({_STOP})]"
    return (
        f"SELECT {ident}, (unnest(range(len(l))))::INT AS pos, unnest(l) AS token "
        f"FROM (SELECT {ident}, {listed} AS l FROM ({source}))"
    )


_TF = f"""
tok AS ({_words(_DOCS, "doc_id", "text")}),
tf AS (SELECT token AS term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT d.doc_id, count(t.token) AS doc_len FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY ALL),
st AS (SELECT max(doc_id) + 1 AS n, sum(doc_len) / (max(doc_id) + 1) AS avg_len FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)
"""


_VOCABULARY = f"SELECT DISTINCT token FROM ({_words(_DOCS, 'doc_id', 'text')})"


def _stemmed(words: str, ident: str) -> str:
    """(ident, token) of a relation of ``_words``, tokens replaced by their stems."""
    return f"SELECT {ident}, stem AS token FROM ({words}) JOIN ({stems(f'SELECT token FROM ({words})')}) USING (token) WHERE stem <> ''"


_STF = _TF.replace(_words(_DOCS, "doc_id", "text"), _stemmed(_words(_DOCS, "doc_id", "text"), "doc_id"))


def _grams(source: str, ident: str, text: str) -> str:
    return f"""
SELECT {ident}, substr(w, i + 1, 3) AS tri, (i % 256)::INT AS off FROM (
  SELECT {ident}, w, unnest(range(greatest(length(w) - 2, 1))) AS i FROM (
    SELECT {ident}, lower(unnest(regexp_extract_all(
      regexp_replace({text}, '(^|[^{_C}])[{_C}]{{2}}\\z', '\\1'), '[{_C}]{{2,}}'))) AS w FROM ({source})))
"""


_TRI = f"""
g AS ({_grams(_DOCS, "doc_id", "text")}),
len AS (SELECT d.doc_id, count(g.tri) AS doc_len FROM documents d LEFT JOIN g USING (doc_id) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(doc_len) / count(*) AS avg_len FROM len),
lim AS (SELECT n // greatest(2, least(10, floor(n / (avg_len + 1))::BIGINT)) AS m FROM st),
tf AS (SELECT tri, least(off, 14)::INT AS off, doc_id, tf
       FROM (SELECT doc_id, tri, off, count(*) AS tf FROM g GROUP BY ALL)),
alldf AS (SELECT tri, off, count(*) AS df FROM tf GROUP BY ALL),
df AS (SELECT * FROM alldf WHERE df <= (SELECT m FROM lim))
"""

_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
_FORMULA = {
    "bm25": f"{_IDF} * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))",
    "tf-idf": f"tf::DOUBLE / doc_len * {_IDF}",
}


def _total(value: str) -> str:
    """The engine's order-independent sum: multiples of 2^-30, and of 2^-76 for the rest."""
    coarse = f"round(({value}) * pow(2.0, 30)) / pow(2.0, 30)"
    return f"sum({coarse}) + sum(round((({value}) - {coarse}) * pow(2.0, 76)) / pow(2.0, 76))"


def _ranking(kind: str, scoring: str, queries: str, k: int) -> str:
    """CTEs up to ``top(query_id, rank, doc_id, score)`` with unrounded scores."""
    if kind == "trigram":
        base, on, norm = _TRI, "tri, off", " / nk"
        q = f"{_grams(queries, 'query_id', 'content')}"
    else:
        base, on, norm = _STF if kind == "stemmed" else _TF, "term", ""
        words = _words(queries, "query_id", "content")
        q = f"SELECT query_id, token AS term FROM ({_stemmed(words, 'query_id') if kind == 'stemmed' else words})"
    return f"""WITH {base},
q0 AS ({q}),
q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nk FROM q0),
w AS (SELECT query_id, {on}, nk, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT query_id, doc_id, {_total(f"({_FORMULA[scoring]}){norm} * times")} AS score
      FROM w JOIN df USING ({on}) JOIN tf USING ({on}) JOIN len USING (doc_id) CROSS JOIN st GROUP BY ALL),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC)::INT AS rank,
        doc_id, score FROM s QUALIFY rank <= {k})"""


_SCORE = "printf('%.8e', score)::DOUBLE"


def _single_sql(kind: str, scoring: str) -> str:
    return f"{_ranking(kind, scoring, _QUERY, 10)} SELECT rank, doc_id, {_SCORE} AS score FROM top"


def _batch_sql(kind: str, scoring: str, k: int) -> str:
    return f"{_ranking(kind, scoring, _BENCH, k)} SELECT query_id, rank, doc_id, {_SCORE} AS score FROM top"


def _nested(kind: str, scoring: str, queries: str, k: int) -> str:
    return f"(SELECT * FROM ({_ranking(kind, scoring, queries, k)} SELECT * FROM top))"


ORACLE_SQL = {
    "tokens_simple": _words(_DOCS, "doc_id", "text", False),
    "token_stopword_filtered": _words(_DOCS, "doc_id", "text"),
    "term_freq": f"WITH {_TF} SELECT term, doc_id, tf FROM tf",
    "doc_length": f"WITH {_TF} SELECT doc_id, doc_len FROM len",
    "doc_freq": f"WITH {_TF} SELECT term, df FROM df",
    "corpus_stats": f"WITH {_TF} SELECT n, round(avg_len, {DIGITS}) AS avg_len FROM st",
    "trigram_postings": f"WITH {_TRI} SELECT tri, off, doc_id, tf, doc_len FROM tf JOIN len USING (doc_id)",
    "trigram_doc_freq": f"WITH {_TRI} SELECT tri, off, df FROM df",
    "trigram_stop_keys": f"WITH {_TRI} SELECT tri, off FROM alldf WHERE df > (SELECT m FROM lim)",
    "trigram_bm25_topk": _single_sql("trigram", "bm25"),
    "trigram_tfidf_topk": _single_sql("trigram", "tf-idf"),
    "trigram_batch_topk": _batch_sql("trigram", "bm25", 10),
    "inverted_unstemmed_bm25_topk": _single_sql("plain", "bm25"),
    "inverted_unstemmed_tfidf_topk": _single_sql("plain", "tf-idf"),
    "inverted_unstemmed_batch_topk": _batch_sql("plain", "bm25", 10),
    "overlap_at_100": f"""WITH {_TF},
q AS (SELECT query_id, token AS term FROM ({_words(_BENCH, "query_id", "content")})),
w AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT query_id, doc_id, {_total(f"({_FORMULA['bm25']}) * times")} AS s1, {_total(f"({_FORMULA['tf-idf']}) * times")} AS s2
      FROM w JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN st GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, doc_id DESC) AS r1,
      row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, doc_id DESC) AS r2 FROM s)
SELECT query_id, count(*) AS overlap FROM r WHERE r1 <= 100 AND r2 <= 100 GROUP BY ALL""",
    "score_diff": f"""SELECT count(*) AS matches, round(coalesce(sum(abs(a.score - b.score)), 0), {DIGITS}) AS sum_abs_diff
FROM {_nested("plain", "bm25", _QUERY, 100)} a JOIN {_nested("plain", "tf-idf", _QUERY, 100)} b USING (doc_id)""",
    "known_item_rank": f"""SELECT e.query, coalesce(min(t.rank), -1)::INT AS rank, e.document
FROM (SELECT DISTINCT content AS query, query_id AS document FROM ({_BENCH})) e
LEFT JOIN (SELECT q.content AS query, t.rank, t.doc_id AS document FROM {_nested("plain", "bm25", _BENCH, 10)} t
           JOIN ({_BENCH}) q USING (query_id)) t USING (query, document) GROUP BY e.query, e.document""",
    "index_stats": f"""WITH {_TF} SELECT
(SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings, (SELECT count(*) FROM len) AS n_docs,
(8 * (SELECT count(*) FROM tf) + (SELECT sum(length(term)) FROM df) + 4 * (SELECT count(*) FROM len))::BIGINT AS logical_bytes,
n, avg_len FROM st""",
    "dense_reid": 'SELECT doc_id AS "Id", text FROM documents',
    "inverted_bm25_topk": _single_sql("stemmed", "bm25"),
    "inverted_tfidf_topk": _single_sql("stemmed", "tf-idf"),
    "inverted_batch_topk": _batch_sql("stemmed", "bm25", 10),
    "stem_vocabulary": stems(_VOCABULARY),
    "approx_vocabulary": f"WITH {_TF} SELECT count(*) AS n_terms, true AS estimate_is_near FROM df",
    "saved_inverted_topk": _single_sql("plain", "bm25"),
    "saved_stemmed_topk": _single_sql("stemmed", "tf-idf"),
    "saved_trigram_topk": _single_sql("trigram", "bm25"),
    "source_by_position": "SELECT doc_id, text FROM documents",
    "source_csv": r"SELECT doc_id AS id, regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM documents",
    "source_query_files": r"""SELECT row_number() OVER (ORDER BY item_id)::INT AS line,
regexp_replace(text, '[\r\n]', ' ', 'g') AS content FROM benchmark""",
    "source_score_csv": f"""WITH {_TF} SELECT doc_id::VARCHAR AS doc_id, doc_len::DOUBLE AS score,
row_number() OVER (ORDER BY doc_id)::BIGINT AS position FROM len""",
    "source_id_list": "SELECT doc_id::VARCHAR AS doc_id FROM documents",
    "source_search_dump": r"""SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS pos,
regexp_replace(text, '["\\]', ' ', 'g') AS column1 FROM benchmark""",
    "sink_result_table": f"{_ranking('plain', 'bm25', _BENCH, 10)} SELECT query_id::VARCHAR AS query, rank, doc_id, "
    "printf('%.6g', score)::DOUBLE AS score FROM top",
}
ORACLE_SQL["sink_rank_csv"] = f"SELECT md5(query) AS query, rank, document FROM ({ORACLE_SQL['known_item_rank']})"
