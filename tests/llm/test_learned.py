import random
import zlib

import numpy as np
import pytest

from quarry.llm.ann import ann_search, fit_tree, nearest
from quarry.llm.toxicity import BlockMaxIndex, fit, isotonic, toxicity, without_toxic


def brute_neighbours(rows, queries, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q in queries:
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in ok if i != q)
            out[q] = [(i, round(d, 9)) for d, i in near[:k]]
    return out


def run(spark, rows, queries, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, leaf string, v string")
    got = {}
    asked = df.where(df["vec_id"].isin(*queries)) if queries else df.limit(0)
    for r in ann_search(df, asked, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(600)]
    rows += [(1000 + i, [1.0] * 6) for i in range(60)]  # many equal vectors
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6),
             (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (None, [1.0] * 6)]
    queries = [0, 10, 50, 1000, 1030, 1059, 2000, 2001, 2004]
    usable = [r for r in rows if r[0] not in (2005,)]
    want = brute_neighbours(usable, queries)
    # visiting every leaf is exact, ties included
    assert run(spark, rows, queries, recall=1.0, leaf_rows=5000, block_rows=50) == want
    got = run(spark, rows, queries, leaf_rows=40, sample=300)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_few_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert run(spark, rows, [1]) == brute_neighbours(rows, [1])
    assert run(spark, rows[:1], [1]) == {}
    assert run(spark, rows, []) == {}
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann_search(none, none).count() == 0


def test_neighbours_among_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    want = brute_neighbours(rows * 2, [0, 7])
    assert run(spark, rows * 2, [0, 7], recall=1.0, leaf_rows=10) == {q: want[q] for q in want}
    assert len(want[0]) == 10
    many = rows[:40] + rows[:1] * 11 + [(3, rng.normal(size=4).tolist()) for _ in range(30)]
    for how in ({}, {"leaf_rows": 5, "block_rows": 7}):
        assert run(spark, many, [0], recall=1.0, **how) == brute_neighbours(many, [0])
    assert run(spark, rows[:1] * 5 + rows[1:2] * 30, [0], recall=1.0) == brute_neighbours(rows[:1] + rows[1:2] * 30, [0])


def test_queries_of_another_dimension(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2 if i in (100, 200) else 4).tolist()) for i in range(300)]
    want = brute_neighbours([r for r in rows if r[0] not in (100, 200)], [0])
    assert run(spark, rows, [0, 100, 200], recall=1.0) == want


def test_best_bins_visit_each_leaf_once():
    x = np.random.default_rng(1).normal(size=(500, 4))
    tree = fit_tree(x, 20)
    order = list(tree.best_bins(x[7]))
    assert sorted(order) == list(range(tree.n_leaves)) and order[0] == tree.assign(x[7:8])[0]
    _, ids, _ = next(nearest(x[7:8], x, np.arange(500), 1))
    assert ids.tolist() == [7]


def test_block_max_equals_full_scan():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(sorted(vectors, key=lambda v: v[0][np.argmax(v[1])]), 40, 16)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(sorted(vectors, key=lambda v: v[0][np.argmax(v[1])])):
        dense[i, t] = w
    for t, w in vectors[:60]:
        scores = dense[:, t] @ w
        want = sorted(range(700), key=lambda i: (-round(scores[i], 12), i))[:9]
        got, cos = index.top(t, w, 9)
        assert got.tolist() == [i for i in want if scores[i] > 1e-12]
        assert np.allclose(cos, np.minimum(scores[got], 1))
    assert index.evaluated < 60 * 44  # bounds spare blocks


def test_isotonic():
    x, y = isotonic(np.array([0, 1, 2, 3.0]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 0.5, 1]


@pytest.fixture(scope="module")
def labelled(make, spark):
    r = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        if toxic:
            text[:2] = [r.choice(["vile", "Dreadful", "cursedness"]) for _ in range(2)]
            r.shuffle(text)
        rows.append((i, " ".join(text)))
        if i % 2 == 0 or r.random() < 0.5:
            labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "word1 " * 50_000 + "vile"), (None, "vile vile dreadful")]
    return make(rows), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"), len(rows)


def test_toxicity(labelled):
    docs, labels, n = labelled
    got = toxicity(docs, labels).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] == (i in set(held)) for i in range(900))
    assert sum(by[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert by[2000]["score"] == by[2001]["score"] < 0.5
    assert by[None]["predicted"] == 1 and by[None]["evidence_ids"]
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 2001").count() == 1
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


def test_scores_against_brute_force(labelled):
    """Every score and piece of evidence from a full scan of the examples, term by term."""
    import math
    import re

    from quarry.llm import textkernel as K

    docs, labels, _ = labelled
    model = fit(docs, labels, examples_per_class=60)
    number = {h: k for k, h in enumerate(model.vocabulary.hashes.tolist())}

    def vector(text):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        counts = {}
        for w in words:
            w = w.lower()
            for n, part in [(0, w), *((n, w[:n]) for n in (5, 6, 7, 8) if len(w) > n)]:
                h = int(K.hash_spans(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]), n)[0])
                if h in number:
                    counts[number[h]] = counts.get(number[h], 0) + 1
        if not counts:
            return None
        counts[len(number)] = max(len(words), 1)
        raw = {t: (1 + math.log(n)) * model.idf[t] for t, n in counts.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / size for t, x in raw.items()}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = dict(rows)
    examples = [(int(i), y, vector(texts[int(i)])) for i, y in zip(model.example_ids, model.example_toxic, strict=True)]
    got = {r["doc_id"]: r for r in toxicity(docs, labels, examples_per_class=60).collect()}
    for ident, text in rows:
        v = vector(text)
        if v is None:
            assert got[ident]["score"] == pytest.approx(model.no_hit)
            continue
        near = sorted(((-round(min(sum(x * e.get(t, 0.0) for t, x in v.items()), 1.0), 12), i, y) for i, y, e in examples))[:15]
        by = [1 / (0.01 + 1 + c) for c, _, _ in near]
        share = sum(w * y for w, (_, _, y) in zip(by, near, strict=True)) / sum(by)
        assert got[ident]["score"] == pytest.approx(float(np.interp(share, *model.curve)), abs=1e-6)
        assert got[ident]["evidence_ids"] == [i for _, i, _ in near[:3]]


def test_ties_go_to_smaller_ids():
    v = (np.array([1]), np.array([1.0]))
    index = BlockMaxIndex([v] * 40, 3, 4, ids=np.arange(40)[::-1] * 10)
    got, _ = index.top(*v, 5)
    assert index.ids[got].tolist() == [0, 10, 20, 30, 40]


def test_examples_are_drawn_from_the_whole_range_of_ids(make, spark):
    # ids follow kinds: the words of toxic texts change half way
    rows = [(i, f"w{i % 7} w{i % 11} " + ("plain fine" if i % 2 else "vile" if i < 400 else "dreadful")) for i in range(800)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(800)], "doc_id long, toxic int")
    model = fit(make(rows), labels, examples_per_class=60)
    for toxic in (0, 1):
        ids = model.example_ids[model.example_toxic == toxic]
        assert len(ids) == 60 and 15 <= (ids >= 400).sum() <= 45
    late = {r["doc_id"]: r["evidence_ids"] for r in toxicity(make(rows), labels, examples_per_class=60).where("doc_id >= 700").collect()}
    assert all(late[i] and min(late[i]) >= 400 for i in range(700, 800, 2))


def test_toxicity_edges(make, spark):
    docs = make([(i, "a b c") for i in range(5)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, none).collect()} == {0.0}
    only = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, only).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity(docs, both).collect())
    assert toxicity(make([]), both).count() == 0
