import hashlib
import random

import pytest

from quarry.llm.components import components
from quarry.llm.url_filter import url_verdicts
from quarry.llm.warc import parse_record, read_warc, record_bytes, write_warc


def pages(spark, rows):
    full = [(*r, "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, host string, rule string, node string")


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000), (None, 3)]
    edges += [(2000 + r.randint(0, 90), 2000 + r.randint(0, 90)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {(x["node"], x["component"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def link(url):
    return f'<html><head><LINK href="{url}" rel="canonical"></head></html>'


def test_verdicts(spark):
    rows = [
        (1, "http://example.com/en/a", "x"),
        (2, "http://www.example.com/en/a", None),
        (3, "HTTP://A.Example.NET/es/1?x#y", "x"),
        (4, "http://plain.org/one", link("http://a.example.net/es/1?x")),
        (5, "http://other.org/", '<meta http-equiv="refresh" content="0; url=http://plain.org/one">'),
        (6, "http://third.org/q", link("//b.net/fr/2")),
        (7, "http://third.org/q", "a second row of one url"),
        (8, "http://both.org/", link("http://b.net/fr/2")),
        (9, "http://both.org/", link("http://shop.com/")),
        (10, None, link("http://b.net/fr/2")),
        (11, "no scheme", "x"),
        (12, "", "x"),
        (13, "http://notexample.com/en/", "x"),
        (14, "http://net/fr/", "x"),
        (15, "http://lonely.org", link("")),
        (16, "http://sub.org/dir/page", link("/one")),
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in url_verdicts(pages(spark, rows)).collect()}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[3] == ("a.example.net", "/es/1", "net/es/", "block")
    assert got[4] == ("plain.org", "/one", None, "block")
    assert got[5][3] == "block"  # through two edges
    # one component: blocked by b.net/fr/2, allowed by shop.com; allow takes precedence
    assert got[6][3] == got[7][3] == got[8][3] == got[9][3] == "allow"
    assert got[10] == got[12] == ("", "", None, "allow") and got[11] == ("", "", None, "allow")
    assert got[13][2:] == ("com/", "allow") and got[14][2:] == ("net/fr/", "block")
    assert got[15] == ("lonely.org", "", None, "allow") and got[16][3] == "allow"
    assert url_verdicts(pages(spark, [])).count() == 0


def test_redirect_table(spark):
    more = spark.createDataFrame([("http://x.org/", "http://y.net/fr/"), ("http://x.org/", None)], "a string, b string")
    got = url_verdicts(pages(spark, [(1, "http://x.org/", None)]), more).first()
    assert got["verdict"] == "block"


def test_warc(spark):
    big = "é" * 60
    rows = [(3, "http://a/", big), (1, "http://b/", big), (2, None, big), (4, "u\r\nX: y", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (8, "u", "z" * 200_000), (1, "http://b/", big), (None, "u", big)]
    index = write_warc(pages(spark, rows).repartition(3))
    got = sorted((tuple(r) for r in read_warc(index).drop("url", "payload").collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = 1 if html == big and i not in (1, None) else None
        kind = "response" if first is None else "revisit"
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), kind, first))
    assert got == sorted(want, key=repr)
    bodies = {r["page_id"]: r["payload"] for r in read_warc(index.where("page_id IN (4, 8, 3)")).collect()}
    assert bodies == {4: b"small", 8: b"z" * 200_000, 3: None}
    assert read_warc(write_warc(pages(spark, []))).count() == 0


def test_record_ids(spark):
    from quarry.llm.warc import _record_id

    spelled = lambda *a: parse_record(record_bytes(*a))
    one, two = (spelled(None, "u", b"x", "d", None, f"f:{k}")["WARC-Record-ID"] for k in (0, 9))
    assert one != two
    assert spelled(5, "u", b"x", "d", None)["WARC-Record-ID"] != spelled(5, "u", b"y", "e", None)["WARC-Record-ID"]
    assert spelled(7, "u", b"x", "d", 5)["WARC-Refers-To"] == spelled(5, "v", b"x", "d", None)["WARC-Record-ID"] == _record_id(5, "d")


def test_reading_is_dealt_by_record_bytes(spark, monkeypatch):
    from quarry.llm import warc as W

    monkeypatch.setattr(W, "TASK_BYTES", 20_000)
    r = random.Random(1)
    rows = [(i, "u", "".join(r.choice("abcdefghij") for _ in range(2000))) for i in range(100)]
    back = read_warc(write_warc(pages(spark, rows)))
    assert back.rdd.getNumPartitions() >= 4 and {x["page_id"] for x in back.collect()} == set(range(100))


def test_records_are_warc():
    data = record_bytes(5, "http://a/", b"body\r\n\r\nmore", "ab", None)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    r = parse_record(data)
    assert r["payload"] == b"body\r\n\r\nmore" and r["WARC-Target-URI"] == "http://a/"
    with pytest.raises(ValueError):
        parse_record(b"no")
