"""URL filters and archives against plain versions."""

import base64
import gzip
import hashlib
import random
import re

import pytest

from premia.llm import urls, warc

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not match:
        return "", ""
    lower = {c: c + 32 for c in range(65, 91)}
    return match[1].translate(lower), match[2]


def judged(url, rules):
    host, path = parts(url)
    fits = [(h + p, v, h) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict, _ = max(fits, key=lambda x: (len(x[0]), len(x[2])), default=(None, "allow", ""))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/x", "https://example.org/es", "https://a.b.example.org/en/12?q",
    "http://notexample.org/es/", "http://example.org?x", "http://example.org#x/es/", "http://x.com/fr/1", "http://x.com/frx", "x://y.com/de/z://w.org/",
    "http://a..com/de/", "http://.com/de/", "http://example.org:80/es/", "http://é.com/fr/é", "http://com/de/\U0010ffff", "http://x.org/\n/es/", "http://" + "a." * 300 + "org/es/",
]


@pytest.mark.parametrize("extra", [[], [("org", "/e", "block"), ("org", "/en", "allow"), ("org", "/en/1", "block"), ("www.example.org", "", "allow"), ("", "", "block"), ("com", "/fr/", "block"), ("b.example.org", "/en/", "allow")]])
def test_rules(spark, extra):
    rng = random.Random(3)
    made = [f"http://{rng.choice(['a.', 'www.', '', 'b.'])}{rng.choice(['example.org', 'x.org', 'y.com', 'org'])}/{rng.choice(['es/', 'en/1', 'en/2', 'fr/', 'de/', ''])}{i % 7}" for i in range(200)]
    rows = [(i, url, "h", 1) for i, url in enumerate(URLS + made)] + [(5, "http://org/", "h", 1)] * 3 + [(None, "http://org/x", "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, URL string, host int")
    rules = spark.createDataFrame(RULES + extra + [("org", None, "block")], "host string, path string, verdict string")
    distinct = {}
    for h, p, v in RULES + extra:
        distinct[h, p] = max(v, distinct.get((h, p), v))
    plain = [(h, p, v) for (h, p), v in distinct.items() if h]
    want = []
    for i, url, *_ in rows:
        host, path, rule, verdict = judged(url, plain)
        if host == "" and ("", "") in distinct:
            rule, verdict = "", distinct["", ""]
        want.append((i, host, path, rule, verdict))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in urls.filter_urls(pages, rules, "block").collect()] == ["block"]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_the_main_path_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urls.filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


HTML = ["<p>a</p>", "<p>a</p>", "", None, "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n", "é漢\U0001f600\x00\r\n", "x" * 300_000, "<p>a</p>", "only"]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    rows = [(i, f"http://h{i % 3}.example.org/{i}", html, "x") for i, html in enumerate(HTML)]
    rows += [(None, None, "<p>a</p>", "x"), (7, "u v\r\nw", "<p>a</p>", "x"), (20, None, "lone", "x"), (None, "http://z.org/", "unnamed", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string").repartition(3)
    chief = {}
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= least:
            chief[html or ""] = max(i, chief.get(html or "", i))
    want = []
    for i, _, html, _ in rows:
        first = chief.get(html or "", i)
        kind = "response" if i == first else "revisit"
        want.append((i, len((html or "").encode()), digest(html), kind, None if i == first else first))
    found = warc.archive(pages, records=2, least=least).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in found]
    assert keys == sorted(keys)
    assert len({r.archive for r in found}) > 3


def test_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_loser_tree_merges_any_runs():
    rng = random.Random(8)
    for k in range(0, 12):
        runs = [sorted((rng.randint(0, 9), rng.random()) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
        got = [runs[run][place] for run, place in warc.LoserTree(runs)]
        assert got == sorted(x for run in runs for x in run)


def test_gzip_members_and_damage():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    content = gzip.compress(record) + gzip.compress(record * 2)
    assert [(offset, payload) for offset, _, payload in warc.parse(content)] == [(len(record) * k, b"abc") for k in range(3)]
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(record[:-6])))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"HTTP/1.0\r\n\r\n\r\n\r\n")))
