from collections import Counter

import pytest

from quarry.functions import text as A
from quarry.operators.index import _dealt, build_index, build_inverted, load_index, trigram_counts
from quarry.operators.search import search_batch

TEXTS = [
    "The cat eats fresh salmon, the cat sleeps.", "", None, "x" * 300 + " abc ok yo", "é ab cd ef café", "go", "go\n", "ab", "abc",
    "$% &+@ K1", "a", "Running runs\x00runK", "ok ok", "abİcd", "",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("counting"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{path}/d")
    spark.createDataFrame([(1, "cat salmon"), (2, "running")], "query_id long, content string").write.parquet(f"{path}/q")
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stem", [False, True])
def test_terms_of_whole_documents(spark, stored, stem):
    index = build_inverted(spark.read.parquet(f"{stored}/d"), stem)
    want = {(d, t): (n, len(A.query_tokens(x, stem))) for d, x in enumerate(TEXTS) for t, n in Counter(A.query_tokens(x, stem)).items()}
    assert {(r["doc_id"], r["term"]): (r["tf"], r["doc_len"]) for r in index.postings.collect()} == want
    assert {r["doc_id"]: r["doc_len"] for r in index.doc_stats.collect()} == {d: len(A.query_tokens(x)) for d, x in enumerate(TEXTS)}
    assert "Aggregate" not in plan(index.postings)


def test_trigrams_of_whole_documents(spark, stored):
    postings, sizes = trigram_counts(spark.read.parquet(f"{stored}/d"))
    grams = [A.query_trigrams(x) for x in TEXTS]
    want = sorted((t, min(o, 14), d, n, len(g)) for d, g in enumerate(grams) for (t, o), n in Counter(g).items())
    assert sorted(tuple(r) for r in postings.collect()) == want
    assert {r["doc_id"]: r["doc_len"] for r in sizes.collect()} == dict(enumerate(map(len, grams)))
    assert "Aggregate" not in plan(postings)


def test_partitions_grow_with_the_input(spark, stored, monkeypatch):
    from quarry.operators import index

    monkeypatch.setattr(index, "PIECE_BYTES", 100)
    assert _dealt(spark.read.parquet(f"{stored}/d")).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("kind", ["inverted", "trigram"])
def test_postings_do_not_move_by_key(spark, stored, tmp_path, kind):
    index = build_index(spark.read.parquet(f"{stored}/d"), kind)
    found = plan(search_batch(index, spark.read.parquet(f"{stored}/q")))
    assert "SortMergeJoin" not in found
    index.save(str(tmp_path))
    again = load_index(spark, str(tmp_path))
    for a, b in ((index.postings, again.postings), (index.term_stats, again.term_stats), (index.doc_stats, again.doc_stats)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert "Join" not in plan(index.postings) or "SortMergeJoin" not in plan(index.postings)
