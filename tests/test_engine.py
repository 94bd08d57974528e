import math
from collections import Counter, defaultdict

import pytest

from quarry import build_index, load_index
from quarry.cli import main
from quarry.functions import text as A
from quarry.operators import evaluation as E
from quarry.operators.search import search, search_batch
from quarry.sources import readers as R
from quarry.sources import writers as W

DOCS = [
    (1, "The cat eats fresh salmon, the cat sleeps."),
    (5, "A dog eats; the dogs are eating salmon"),
    (9, "cat cat cat"),
    (10, "cat cat cat"),
    (12, ""),
    (14, None),
    (15, "the is of"),
    (17, "x" * 300 + " abc ok yo"),
    (20, "é ab cd ef café"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def idf(n, df):
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf, df, n, length, avg):
    return idf(n, df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))


def brute_inverted(query):
    toks = {d: A.query_tokens(t) for d, t in DOCS}
    n = max(toks) + 1
    avg = sum(map(len, toks.values())) / n
    df = Counter(t for x in toks.values() for t in set(x))
    scores = defaultdict(float)
    for term in A.query_tokens(query):
        for d, x in toks.items():
            if term in x:
                scores[d] += bm25(x.count(term), df[term], n, len(x), avg)
    return sorted(((d, round(s, 9)) for d, s in scores.items()), key=lambda p: (-p[1], -p[0]))


def brute_trigram(query):
    grams = {d: A.query_trigrams(t or "") for d, t in DOCS}
    n, avg = len(DOCS), sum(map(len, grams.values())) / len(DOCS)
    lists = defaultdict(list)
    for d, g in grams.items():
        for (tri, off), tf in Counter(g).items():
            lists[tri, min(off, 14)].append((d, tf))
    most = n // max(2, min(10, int(n / (avg + 1))))
    wanted, scores = A.query_trigrams(query), defaultdict(float)
    for key in wanted:
        entries = lists.get(key, [])
        if len(entries) <= most:
            for d, tf in entries:
                scores[d] += bm25(tf, len(entries), n, len(grams[d]), avg) / len(wanted)
    return sorted(((d, round(s, 9)) for d, s in scores.items()), key=lambda p: (-p[1], -p[0]))


QUERIES = ["cat", "cat cat", "fresh salmon eating", "the of", "go", "ok ", "xxxxxxxxxxxxxxxxxxxxxxx", "CAFÉ dogs"]


@pytest.mark.parametrize("kind,brute", [("inverted", brute_inverted), ("trigram", brute_trigram)])
def test_search_against_brute_force(spark, docs, kind, brute):
    index = build_index(docs, kind)
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "query_id long, content string")
    batch = defaultdict(list)
    for r in search_batch(index, rows, "bm25", 20).orderBy("query_id", "rank").collect():
        batch[r["query_id"]].append((r["doc_id"], round(r["score"], 9)))
    for i, q in enumerate(QUERIES):
        assert batch[i] == brute(q)
    for q in QUERIES[:3]:
        one = [(r["doc_id"], round(r["score"], 9)) for r in search(index, q, "bm25", 20).orderBy("rank").collect()]
        assert one == brute(q)


def test_gap_ids_count_in_n(docs):
    assert build_index(docs, "inverted").n == 21
    assert build_index(docs, "trigram").n == 9


def test_ties_prefer_larger_id(docs):
    assert [r["doc_id"] for r in search(build_index(docs), "cat", "tf-idf", 2).orderBy("rank").collect()] == [10, 9]


def test_small_scores_keep_their_order(spark):
    rows = [(k, "needle " + "filler " * (2_000_000 // 100 + k)) for k in (1, 2, 3)]
    rows += [(50 + k, "needle other") for k in range(2)] + [(60, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tiny = lambda tf, length, avg, idf: idf * 1e-3 * tf / length
    got = [r["doc_id"] for r in search(build_index(docs), "needle", tiny, 5).orderBy("rank").collect()]
    assert got == [51, 50, 1, 2, 3]  # shorter documents first, although scores differ by 1e-12 only


def test_sums_do_not_depend_on_their_order(spark):
    import random

    from quarry.operators.search import exact_sum

    r = random.Random(1)
    values = [10 ** r.uniform(-9, 1.5) for _ in range(60)]
    sums = set()
    for _ in range(5):
        r.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        sums.add(df.agg(exact_sum(df["v"]).alias("s")).first()["s"])
    assert len(sums) == 1 and math.isclose(sums.pop(), math.fsum(values), rel_tol=1e-15)


def test_k_zero_and_no_match(docs):
    index = build_index(docs)
    assert search(index, "cat", "bm25", 0).count() == 0
    assert search(index, "zebra", "bm25", 5).count() == 0
    assert search(index, "", "bm25", 5).count() == 0


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for kind in ("inverted", "trigram"):
        assert search(build_index(none, kind), "cat").count() == 0


def test_bad_arguments(spark, docs):
    with pytest.raises(ValueError):
        build_index(docs, "b-tree")
    with pytest.raises(NotImplementedError):
        build_index(docs, "vsm")
    with pytest.raises(ValueError):
        build_index(docs.withColumnRenamed("text", "body"))
    with pytest.raises(ValueError):
        search(build_index(docs), "cat", "pagerank")


@pytest.mark.parametrize("kind", ["inverted", "trigram"])
def test_round_trip(spark, docs, tmp_path, kind):
    index = build_index(docs, kind)
    index.save(str(tmp_path))
    again = load_index(spark, str(tmp_path))
    same = lambda i: sorted((r["doc_id"], round(r["score"], 9)) for r in search(i, "fresh salmon cat").collect())
    assert same(index) == same(again)
    plan = again.search("salmon")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan
    assert again.stats().first()["n_docs"] == 9
    assert again.stats().first()["stored_bytes"] > 1000 and index.stats().first()["stored_bytes"] is None


def test_evaluation(spark):
    a = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7)], "query_id long, rank int, doc_id long")
    b = spark.createDataFrame([(0, 1, 6), (0, 2, 9), (0, 3, 5)], "query_id long, rank int, doc_id long")
    assert E.overlap_at_k(a, b, 2).first()["overlap"] == 1
    x = spark.createDataFrame([("1", 1.0), ("1", 2.0), ("2", 1.0)], "doc_id string, score double")
    y = spark.createDataFrame([("1", 0.5), ("3", 1.0)], "doc_id string, score double")
    assert tuple(E.score_difference(x, y).first()) == (1, 0.5)
    listed = lambda *rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position long, doc_id string, score double")
    assert tuple(E.score_difference(listed(("1", 2.0), ("1", 1.0)), listed(("1", 1.0), ("1", 3.0))).first()) == (2, 3.0)
    wanted = spark.createDataFrame([("q", 5), ("q", 8)], "query string, document long")
    got = spark.createDataFrame([("q", 2, 5)], "query string, rank int, doc_id long")
    assert sorted(tuple(r) for r in E.known_item_rank(wanted, got).collect()) == [("q", -1, 8), ("q", 2, 5)]


def test_query_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\ntwo\r\nlast")
    (tmp_path / "b.txt").write_bytes(b"x\n")
    (tmp_path / "c.md").write_bytes(b"no\n")
    rows = [(r["file"], r["line"], r["content"]) for r in R.read_queries(spark, str(tmp_path)).orderBy("query_id").collect()]
    assert rows == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "two\r"), ("a", 4, "last"), ("b", 1, "x")]


def test_prompt():
    lines = iter(["cat", "", "!q", "no"])
    assert list(R.prompt_queries(lambda _: next(lines))) == [("0", "cat"), ("1", "")]


def test_result_table(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, 5, 0.5), ("q", 2, 6, 1234567.0)], "query string, rank int, doc_id long, score double")
    path = W.write_results(df, str(tmp_path), "bm25")
    assert [r["value"] for r in spark.read.text(path).collect()] == ["q|1|5|0.5|", "q|2|6|1.23457e+06|"]
    assert R.read_results(spark, path).count() == 2


def test_converters(spark, tmp_path):
    (tmp_path / "in.csv").write_text('n,body\n1,"two\nlines"\n2,"say ""x"""\n')
    rows = R.read_corpus_csv(spark, str(tmp_path / "in.csv"), "body", "n").orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "two\nlines"), (2, 'say "x"')]
    W.write_corpus(spark.createDataFrame([("cat", 3), ("dog", 4)], "text string, id long"), str(tmp_path / "c"))
    assert sorted(r["doc_id"] for r in R.load_documents(spark, str(tmp_path / "c")).collect()) == [3, 4]
    spark.createDataFrame([(c,) for c in "abcdefgh"], "t string").repartition(3).write.parquet(str(tmp_path / "p"))
    assert sorted(r["Id"] for r in R.dense_ids(spark, str(tmp_path / "p"), "t").collect()) == list(range(8))
    names = sorted(f.name for f in (tmp_path / "p").glob("*.parquet"))
    ordered = [r["t"] for n in names for r in spark.read.parquet(str(tmp_path / "p" / n)).collect()]
    W.write_dense_ids(R.dense_ids(spark, str(tmp_path / "p"), "t"), str(tmp_path / "r"))
    assert [r["t"] for r in spark.read.parquet(str(tmp_path / "r")).orderBy("Id").collect()] == ordered
    with pytest.raises(ValueError):
        R.dense_ids(spark, str(tmp_path / "p"), "missing")


def test_lists(spark, tmp_path):
    (tmp_path / "s.csv").write_text("7,1.5\n7,0.5\n8,2\n")
    got = [tuple(r) for r in R.read_scores(spark, str(tmp_path / "s.csv")).orderBy("position").collect()]
    assert got == [(1, "7", 1.5), (2, "7", 0.5), (3, "8", 2.0)]
    (tmp_path / "ids.txt").write_text(" 4\n5 \n")
    assert [r["doc_id"] for r in R.read_id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["4", "5"]
    (tmp_path / "known.tbl").write_text("cat|9\ndog|5\n")
    assert sorted(tuple(r) for r in R.read_known_items(spark, str(tmp_path / "known.tbl")).collect()) == [("cat", 9), ("dog", 5)]


def test_search_dump(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"hits": {"hits": [{"_source": {"column1": """a "quoted"\nline"""}}, {"_source": {"column1": "b"}}]}}')
    rows = R.read_search_dump(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [r["column1"] for r in rows] == ['a "quoted"\nline', "b"]


def test_command_line(spark, tmp_path, capsys):
    W.write_corpus(spark.createDataFrame([(t or "", d) for d, t in DOCS], "text string, id long"), str(tmp_path / "d"))
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "one.txt").write_text("cat\nsalmon\n")
    base = ["-d", str(tmp_path / "d"), "-a", "inverted", "-s", "tf-idf"]
    assert main([*base, "-b"], spark) == 0
    assert main([*base, "-q", str(tmp_path / "q"), "-n", "2"], spark) == 0
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "q" / "tf-idf_result.tbl")).collect()]
    assert len(lines) == 4 and lines[0].startswith("cat|1|10|") and lines[2].startswith("salmon|1|")
    capsys.readouterr()
    assert main([*base, "-q", str(tmp_path / "q"), "-l"], spark) == 0
    assert [x.split(":")[0] for x in capsys.readouterr().out.splitlines()[:2]] == ["cat", "salmon"]
    assert main(["-a", "inverted"], spark) == 1


def test_stream(spark, docs, tmp_path):
    from quarry.streaming import rank_stream

    src = tmp_path / "in"
    spark.createDataFrame([("0", "cat"), ("1", "salmon")], "query_id string, content string").write.parquet(str(src))
    stream = spark.readStream.schema("query_id string, content string").parquet(str(src))
    run = rank_stream(build_index(docs), stream, str(tmp_path / "out"), str(tmp_path / "ck"), k=1)
    run.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_benchmark_texts_are_queried_whole(spark, docs, tmp_path):
    from quarry.plans.registry import QUERIES as registered

    lead = "nothing of this beginning stands in any of the documents there, "
    items = [(5, lead + "dogs eating fresh salmon"), (9, lead + "a cat, a CAT"), (17, lead + "abc"), (40, "salmon")]
    assert len(lead) > 60
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: registered[name](spark, str(tmp_path)).collect()

    def plain(query, value):
        toks = {d: A.query_tokens(t, False) for d, t in DOCS}
        n = max(toks) + 1
        avg = sum(map(len, toks.values())) / n
        df = Counter(t for x in toks.values() for t in set(x))
        scores = defaultdict(float)
        for term in A.query_tokens(query, False):
            for d, x in toks.items():
                if term in x:
                    scores[d] += value(x.count(term), df[term], n, len(x), avg)
        return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda p: (-p[1], -p[0]))[:10]

    six = lambda found: [(d, round(s, 6)) for d, s in found[:10]]
    for name, brute in [("trigram_batch_topk", brute_trigram), ("inverted_batch_topk", brute_inverted),
                        ("inverted_unstemmed_batch_topk", lambda q: plain(q, bm25))]:
        got = defaultdict(list)
        for r in sorted(run(name), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for i, text in items:
            assert [d for d, _ in got[i]] == [d for d, _ in six(brute(text))], (name, text)
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in six(brute(text))], abs=2e-6)
    tfidf = lambda tf, df, n, length, avg: tf / length * idf(n, df)
    ranked = {i: ([d for d, _ in plain(t, bm25)], {d for d, _ in plain(t, tfidf)}) for i, t in items}
    both = {i: len(set(a) & b) for i, (a, b) in ranked.items() if set(a) & b}
    assert {r["query_id"]: r["overlap"] for r in run("overlap_at_100")} == both
    place = {(t, i): ranked[i][0].index(i) + 1 if i in ranked[i][0] else -1 for i, t in items}
    assert {(r["query"], r["document"]): r["rank"] for r in run("known_item_rank")} == place


def test_csv_keeps_odd_texts(spark, tmp_path):
    from quarry.plans.registry import QUERIES as registered

    texts = ["", None, " before", "after\t", "  ", '"', '""', 'a "b", c', "\\", "\x00nul", "null", "two\nlines", "\ufeff"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["text"] for r in registered["source_csv"](spark, str(tmp_path)).collect()}
    assert got == {k: t and t.replace("\n", " ") for k, t in enumerate(texts)}
    (tmp_path / "e.csv").write_text('n,body\n1,\n2,""\n')
    read = R.read_corpus_csv(spark, str(tmp_path / "e.csv"), "body", "n").collect()
    assert {r["id"]: r["text"] for r in read} == {1: None, 2: ""}


def test_scores_are_read_in_blocks(spark, tmp_path):
    folder, texts = tmp_path / "scores", ["".join(f"{k},{k}.5\n" for k in range(90)), "7,1\r\n\n7,2", ""]
    folder.mkdir()
    for name, text in zip(("b.csv", "a.csv", "c.csv"), texts, strict=True):
        (folder / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        read = R.read_scores(spark, str(folder))
        assert read.rdd.getNumPartitions() > 8
        got = [tuple(r) for r in read.orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [("7", 1.0), (None, None), ("7", 2.0)] + [(str(k), k + 0.5) for k in range(90)]
    assert got == [(k, *r) for k, r in enumerate(want, 1)]
