import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.line_dedup import line_dedup
from quarry.llm.ngram_join import Bands, Frequent, keep_one_of_each, ngram_components, signatures, sketch, sketch_differences
from quarry.llm.suffix_dedup import merge_spans, suffix_dedup

ROWS = [(1, "a b"), (2, "a b"), (3, "a  b"), (4, None), (5, ""), (6, "x" * 300 + "1"), (7, "x" * 300 + "2"),
        (8, "x" * 300 + "1"), (9, "long " * 30_000), (9, "long " * 30_000), (None, "a b")]


def test_exact(make):
    got = sorted((tuple(r) for r in exact_dedup(make(ROWS)).collect()), key=repr)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_exact_empty(make):
    assert exact_dedup(make([])).count() == 0


def brute_lines(rows):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ls = (t or "").split("\n")
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p : p + 3]), (i, p))
    for i, t in rows:
        ls, gone = (t or "").split("\n"), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if i is not None and "".join(w).strip(" ") and first[w] != (i, p):
                gone |= {p, p + 1, p + 2}
        kept = None if t is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)
        out.append((i, kept, 0 if t is None else len(ls), len(gone)))
    return sorted(out, key=repr)


def test_lines(make):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abc ") for _ in range(r.randint(0, 12)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n\n\n"), (53, "\n\n\n\n"), (54, "q\n" * 3000), (55, "one"), (56, "a\nb")]
    got = sorted((tuple(x) for x in line_dedup(make(rows)).select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)
    assert got == brute_lines(rows)
    assert line_dedup(make([])).count() == 0
    assert "source" in line_dedup(make(rows)).columns


def test_lines_repeated_rows_and_null_ids(make):
    got = line_dedup(make([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]))
    assert {r["n_removed"] for r in got.where("doc_id IS NULL").collect()} == {0}
    assert got.count() == 3


def test_lines_of_an_id_with_unlike_texts(make):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\ny\nz"), (2, "a\nb\nc"), (3, "q\nx\ny\nz")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup(make(rows)).collect())
    assert got == [(1, "a\nb\nc", 0), (2, "", 3), (2, "", 3), (2, "x\ny\nz", 0), (3, "q", 3)]
    # the same passage twice under one id, in unlike texts: one of them stays
    got = line_dedup(make([(4, "a\nb\nc\nd"), (4, "a\nb\nc\ne")])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 3]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "a", "A", "a b", "b a"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([2, 4, 5, 6, 8, 12, 40, 150, 500]))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            x = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                x[r.randrange(len(x))] = r.choice(words)
            texts.append("\t".join(x).upper() if r.random() < 0.3 else " ".join(x))
    hot = " ".join(r.choice(words) for _ in range(60))  # many unlike documents share a passage
    texts += [" ".join(r.choice(words) for _ in range(30)) + " " + hot for _ in range(30)]
    r.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_components(make, near_rows):
    assert sorted(tuple(x) for x in ngram_components(make(near_rows)).collect()) == brute_components(near_rows)
    kept = sorted(r["doc_id"] for r in keep_one_of_each(make(near_rows)).collect())
    assert kept == sorted({c for _, _, c in brute_components(near_rows)})


def test_components_edges(make):
    assert ngram_components(make([])).count() == 0
    t = "one two three four five six seven"
    got = ngram_components(make([(7, t), (7, t), (9, t), (None, t), (3, None)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(7, 7), (9, 7), (None, 7), (3, 3)}
    assert len(got) == 5


def test_components_through_null_ids(make, near_rows):
    base = [f"w{i}" for i in range(70)]
    near = lambda k: " ".join([*(f"x{i}" for i in range(k)), *base[k:]])
    chain = [(5, near(0)), (None, near(5)), (9, near(10))]  # 5 and 9 are linked only by way of the row between
    got = [tuple(r) for r in ngram_components(make(chain)).collect()]
    assert {(i, c) for i, _, c in got} == {(5, 5), (None, 5), (9, 5)}
    assert [c for _, _, c in brute_components([chain[0], chain[2]])] == [5, 9]
    assert sorted(r["doc_id"] or 0 for r in keep_one_of_each(make(chain)).collect()) == [0, 5]
    # against brute force, where rows with a null id have large ids of their own
    rows = [(10**6 + i if k % 3 == 0 else i, t) for k, (i, t) in enumerate(near_rows)]
    real = lambda i: None if i >= 10**6 else i
    want = [(real(i), n, None if n == 0 and i >= 10**6 else real(c)) for i, n, c in brute_components(rows)]
    got = [tuple(r) for r in ngram_components(make([(real(i), t) for i, t in rows])).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_id_with_several_texts(make):
    r = random.Random(9)
    a, b = ([f"{x}{r.random()}" for _ in range(60)] for x in "ab")
    near = lambda t, k: " ".join(["new", *t[1:-1], str(k)])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 2)), (3, near(b, 3)), (4, near(b, 4))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(make(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_every_link_has_a_common_signature():
    import numpy as np

    rng, bands = np.random.default_rng(1), Bands(75)
    for _ in range(10):
        sets = []
        for _ in range(25):
            a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, rng.choice([6, 30, 300])))).astype(np.uint64))
            sets += [a, *(x for x in (a[rng.random(len(a)) > p] for p in (0.05, 0.15, 0.24)) if len(x))]
        flat = np.concatenate(sets)
        often = Frequent(*np.unique(rng.choice(flat, len(flat) // 4), return_counts=True))
        deletion = frozenset(np.flatnonzero(bands.worst == 1).tolist()) if rng.random() < 0.5 else frozenset()
        sig, own, step = signatures(sets, bands, deletion, often)
        of = [dict(zip(sig[own == k].tolist(), step[own == k].tolist(), strict=True)) for k in range(len(sets))]
        for i, x in enumerate(sets):
            for j in range(i):
                n = len(np.intersect1d(x, sets[j]))
                same = n == len(x) == len(sets[j])
                if not same and 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                    common = of[i].keys() & of[j].keys()
                    left = [min(bands.left(of[i][c], len(x)), bands.left(of[j][c], len(sets[j]))) for c in common]
                    assert max(left) >= bands.overlap(len(x) + len(sets[j]))
                    small, steps = (x, of[i]) if len(x) <= len(sets[j]) else (sets[j], of[j])
                    assert any(bands.may_be_smaller(bands.left(steps[c], len(small)), len(small)) for c in common)


def test_sketches_bound_the_differences():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 400, int(rng.integers(1, 300)))).astype(np.uint64) for _ in range(60)]
    b = [x[rng.random(len(x)) > 0.1] if k % 2 else a[k - 1] for k, x in enumerate(a)]
    b = [x if len(x) else a[0] for x in b]
    got = sketch_differences(*(pa.array([sketch(s) for s in x], pa.binary()) for x in (a, b)))
    want = np.array([len(np.setxor1d(x, y)) for x, y in zip(a, b, strict=True)])
    assert (got <= want).all() and (got[want <= 2] == want[want <= 2]).mean() > 0.8


def test_components_of_short_texts(make):
    rows = [(1, "hello"), (2, "a b"), (3, "hello"), (4, "A  B"), (5, "c"), (6, "a b c d e")]
    assert sorted(tuple(x) for x in ngram_components(make(rows)).collect()) == brute_components(rows)


def test_components_null_id_between(make):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(make([(7, near(1)), (None, near(2)), (9, near(3))])).collect()}
    assert got == {(7, 7), (None, 7), (9, 7)}


def test_components_of_an_id_with_unlike_texts(make):
    r = random.Random(10)
    a, b = (" ".join(f"{x}{r.random()}" for _ in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (5, ""), (2, b), (8, a.rsplit(" ", 1)[0] + " end"), (6, None), (6, None)]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(make(rows)).collect()}
    assert got == {(5, 2), (2, 2), (8, 2), (6, 6)}


def test_components_of_very_long_words(make):
    """Words of two letters whose places follow the Thue-Morse sequence have one hash
    under every polynomial modulo a power of two."""
    tm = ["a"]
    while len(tm[0]) < 2048:
        tm[0] += tm[0].translate(str.maketrans("ab", "ba"))
    one, two = tm[0][:1024], tm[0][:1024].translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, "x" * 300_000), (4, "x" * 300_000), (5, "x" * 299_999 + "y")]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_components(make(rows)).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)}


def brute_bytes(rows, window):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + window] for _, b in docs for p in range(len(b) - window + 1))
    out = []
    for i, b in docs:
        mark = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                mark[p : p + window] = b"\1" * window
        left = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for p in range(len(b)) if mark[p] and (not p or not mark[p - 1]))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("split", [4096, 7])
def test_suffixes(make, split):
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefgh é\n") for _ in range(r.randint(0, 250))) for _ in range(40)]
    for _ in range(30):
        t = r.choice(texts)
        p = r.randint(0, len(t))
        texts.append("".join(r.choice("xyz") for _ in range(60)) + t[p : p + r.randint(20, 90)] + "xy")
    hot = "".join(r.choice("klmnop") for _ in range(60))
    texts += ["".join(r.choice("qrstuv") for _ in range(50)) + hot + "".join(r.choice("qrstuv") for _ in range(50)) for _ in range(60)]
    texts += ["a" * 400, "ab" * 90, None, "", texts[3], texts[3]]
    rows = list(enumerate(texts))
    rows += [rows[5], rows[5]]  # repeated rows are documents of their own
    got = suffix_dedup(make(rows), window=40, gram=10, split_segments=split).drop("kept_text")
    assert sorted(tuple(x) for x in got.collect()) == brute_bytes(rows, 40)


def test_suffixes_edges(make):
    assert suffix_dedup(make([])).count() == 0
    row = suffix_dedup(make([(None, "é" * 150)]), window=40, gram=10).first()
    assert (row["doc_id"], row["n_bytes"], row["n_removed"], row["kept_text"]) == (None, 300, 300, "")
    assert merge_spans([(5, 9), (0, 5), (12, 13)]) == [(0, 9), (12, 13)]


def test_suffix_array_and_common_prefixes():
    import numpy as np

    from quarry.llm import suffix_dedup as S

    r = random.Random(2)
    texts = [bytes(r.choice(a) for _ in range(n)) for a in (b"ab", b"a", b"abcdefgh", b"\0a", b"\0") for n in (1, 2, 7, 8, 9, 40, 200)]
    texts += [b"abcabcab" * 30, b"x" * 300 + b"y" + b"x" * 300]
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        order = S.suffix_array(data)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        common = S.common_prefixes(data, order)
        for k in range(1, len(text)):
            a, b = text[want[k - 1] :], text[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == n
        valid = np.array(sorted(r.sample(range(max(len(text) - 4, 1)), max(1, (len(text) - 4) // 2)))) if len(text) > 5 else np.array([0])
        if len(text) > 5:
            seen = Counter(text[i : i + 5] for i in valid.tolist())
            assert S.repeated_windows(data, valid, 5).tolist() == [seen[text[i : i + 5]] > 1 for i in valid.tolist()]


def test_one_very_long_text():
    import numpy as np

    from quarry.llm import suffix_dedup as S

    old, S._CHUNK = S._CHUNK, 1000
    try:
        data = np.frombuffer(bytes(random.Random(1).choice(b"abcd") for _ in range(5000)), np.uint8)
        off = np.array([0, 2500, 2500, 5000])
        seen = np.zeros(5000, int)
        for part, inner, shift in S._chunks(data, off, 40):
            text, begin, count, _, _ = S.segment_table(part, inner, 40, 10)
            for t, b, c in zip(text, begin + shift, count, strict=True):
                assert off[t] <= b and b + c - 1 + 40 <= off[t + 1]
                seen[b : b + c] += 1
        want = np.zeros(5000, int)
        want[: 2500 - 39] = want[2500 : 5000 - 39] = 1
        assert (seen == want).all()
    finally:
        S._CHUNK = old
