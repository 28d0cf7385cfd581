import math
import random
import re

import numpy as np
import pytest

from chronaxis.functions.stats import beta_inc
from chronaxis.llm import url_filter
from chronaxis.llm.queries import URL_RULES, op8_url_filter

CASES = {
    "https://a.example.org/es/5": ("a.example.org", "/es/5", "example.org/es/", "block"),
    "http://Example.ORG/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://example.org": ("example.org", "", None, None),
    "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
    "x://y.com/fr/1": ("y.com", "/fr/1", "com/fr/", "allow"),
    "x://y.com/de/": ("y.com", "/de/", "com/de/", "block"),
    "x://h?p://q/r": ("h", "", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "ÀB://ÀB.Com#/fr/": ("Àb.com", "", None, None),
}


def pages(spark, urls):
    from pyspark.sql import functions as F

    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "bad": F.lit(3)})


def test_rules(spark):
    urls = list(CASES)
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), URL_RULES).collect()}
    for i, url in enumerate(urls):
        host, path, rule, verdict = CASES[url]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)


def test_reputation_shrinks_to_the_domain(spark):
    rows = [("bad.spam.net", True)] * 40 + [("x.spam.net", True)] * 30 + [("one.spam.net", None)] + [("good.fine.net", False)] * 60 + [("new.fine.net", None)] + [("odd.fine.net", True)]
    got = {r.host: r for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.spam.net"].bad_low > 0.5
    assert got["one.spam.net"].bad_mean > 0.5 > got["new.fine.net"].bad_mean
    assert got["odd.fine.net"].bad_low < 0.5
    for r in got.values():
        assert 0 <= r.bad_low <= r.bad_mean <= 1


def test_outcomes_decide_where_no_rule_fits(spark):
    outcomes = spark.createDataFrame([("spam.net", 1)] * 50 + [("fine.net", 0)] * 50, "host string, bad int")
    got = url_filter.judge(pages(spark, ["http://spam.net/", "http://fine.net/"]), URL_RULES, outcomes).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "block", 1: "allow"}


def plain_judge(urls):
    """Rules and reputations by plain loops; the bound by bisecting another form of the beta distribution function."""
    rows = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in URL_RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        rows.append((host, path, *(max(fits)[1:] if fits else (None, None))))
    counts = {}
    for host, _, _, says in rows:
        n, bad = counts.get(host, (0, 0))
        counts[host] = (n + (says is not None), bad + (says == "block"))
    up = lambda h: [h, ".".join(h.split(".")[-2:]), h.split(".")[-1]]
    levels = [{}, {}, {}]
    for host, (n, bad) in counts.items():
        for level, name in zip(levels, up(host), strict=True):
            old = level.get(name, (0, 0))
            level[name] = (old[0] + n, old[1] + bad)
    total, bad = (sum(x[i] for x in counts.values()) for i in (0, 1))
    means, k = {None: (bad + 1) / (total + 2) if total else 0.0}, 0
    for i in (2, 1, 0):
        parent = {name: None if i == 2 else up(host)[i + 1] for host in counts for name in [up(host)[i]]}
        many = [(n, b, means[parent[name]]) for name, (n, b) in levels[i].items() if n >= 2]
        chance = sum(n * m * (1 - m) for n, b, m in many)
        excess = sum(n * (b / n - m) ** 2 - m * (1 - m) for n, b, m in many)
        k = min(200.0, max(2.0, (chance - excess) / excess)) if len(many) > 1 and chance > 0 and excess > 0 else 200.0
        means = {name: (b + k * means[parent[name]]) / (n + k) for name, (n, b) in levels[i].items()}
    out = []
    for host, path, rule, says in rows:
        mean, size = means[host], counts[host][0] + k
        low, high = 0.0, 1.0
        for _ in range(45 if 0 < mean < 1 else 0):
            mid = (low + high) / 2
            low, high = (mid, high) if beta_inc(size * mean, size * (1 - mean), mid) < 0.05 else (low, mid)
        bound = low if 0 < mean < 1 else mean
        out.append((host, path, rule, says or ("block" if bound > 0.5 else "allow"), mean, bound))
    return out


def made_urls():
    rng = random.Random(8)
    hosts = ["example.org", "a.example.org", "Bad.example.org", "x.com", "www.y.com", "y.com", "deep.z.y.com", "q.net", "other.net", "", "co"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/de/', '/fr/', '/es/1', '/en/1', '/en/2', '', '/', '?q=/de/', '#'])}{rng.randrange(30)}" for _ in range(400)]
    urls += [f"https://spam.com/de/{i}" for i in range(300)] + ["https://spam.com/other"] * 3  # a hot host, repeated rows
    return urls + [None, "", "no scheme", "x://", "x://h\nost/p"] + [u for u in CASES]


def test_query_equals_brute_force(spark, tmp_path):
    urls = made_urls()
    pages(spark, urls).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, op8_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "bad_mean", "bad_low").collect()))
    want = plain_judge(urls)
    assert len(got) == len(want)
    for (i, *a), b in zip(got, want, strict=True):
        assert tuple(a[:4]) == b[:4], urls[i]
        assert a[4:] == pytest.approx(b[4:], abs=1e-9), urls[i]
    assert {r[3] for r in want if r[2] is None} == {"allow", "block"}


def test_whole_pages_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").orderBy("page_id").collect()
    got = [tuple(r) for r in op8_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert got == [(r.page_id, *x[:4]) for r, x in zip(rows, plain_judge([r.url for r in rows]), strict=True)]


def test_beta_quantile():
    rng = np.random.default_rng(3)
    for a, b in [(0.5, 0.5), (2.0, 5.0), (80.0, 3.0), (1e-3, 40.0), (300.0, 300.0)]:
        want = np.quantile(rng.beta(a, b, 400_000), 0.05)
        assert url_filter.beta_quantile(np.array([a]), np.array([b]), 0.05)[0] == pytest.approx(want, abs=4e-3)
    assert url_filter.beta_quantile(np.array([1.0, 2.0]), np.array([1.0, 1.0]), 0.05) == pytest.approx([0.05, math.sqrt(0.05)])


@pytest.mark.parametrize("few", [0, 100])
def test_suffix_table(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "FEW_SUFFIXES", few)
    rules = spark.createDataFrame([("com",), ("uk",), ("gov.uk",), ("*.ck",), ("!www.ck",), (" COM ",), (None,)], "suffix string")
    want = {"a.b.com": ("b.com", "com"), "com": ("com", "com"), "x.y.gov.uk": ("y.gov.uk", "gov.uk"), "gov.uk": ("gov.uk", "gov.uk"), "q.uk": ("q.uk", "uk"), "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"), "x.unknown": ("x.unknown", "unknown"), "": ("", "")}
    got = url_filter.registered_by(spark.createDataFrame([(h,) for h in want], "host string"), rules).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == want
    rows = [("a.gov.uk", True)] * 40 + [("b.gov.uk", False)] * 40 + [("c.gov.uk", None)]
    seen = {r.host: r.bad_mean for r in url_filter.reputations(spark.createDataFrame(rows, "host string, bad boolean"), rules).collect()}
    assert seen["a.gov.uk"] > 0.8 and seen["b.gov.uk"] < 0.2 and 0.3 < seen["c.gov.uk"] < 0.7


def test_empty_table(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert op8_url_filter(spark, str(tmp_path)).collect() == []
