import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from devicelode.llm import urls
from devicelode.llm.queries import QUERIES

URLS = [None, "", "no scheme", "http://", "http://Example.COM", "http://example.com/", "https://a.example.com/en/1", "https://example.com/en", "x://www.example.com/en/?q",
        "http://b.www.example.com/en/x#y", "http://q.net/es/1", "http://net/fr/", "http://notcom/", "http://evil.co.uk/a?b://c", "http://a.b.evil.co.uk#f", "http://a?x",
        "http://host:80/p", "http://ÀB.Com/é", "http://one.org/a\nb", "http://one.org/a\nb"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_every_url_is_judged(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rate string")
    outcomes = spark.createDataFrame([("http://one.org/1", 1)] * 60 + [("http://good.org/1", 0)] * 60 + [(None, 1)] * 2, "url string, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, outcomes).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["lower"] > 0.25 else "allow"))
    assert got[len(URLS) - 1]["verdict"] == "block"


def test_no_rows(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, bad int")).count() == 0


def test_reputation_is_shrunk_level_by_level(spark):
    pages = [("a.x.org", 1)] * 30 + [("b.x.org", 0)] * 30 + [("c.x.org", None)] + [("d.y.org", 0)] * 40 + [("a.co.uk", 1), ("a.co.uk", 0)]
    got = {r["host"]: r for r in urls.host_reputation(spark.createDataFrame(pages, "host string, bad int")).collect()}
    assert got["a.x.org"]["rate"] > got["c.x.org"]["rate"] > got["b.x.org"]["rate"] > 0
    assert (got["c.x.org"]["domain"], got["c.x.org"]["suffix"], got["a.co.uk"]["domain"], got["a.co.uk"]["suffix"]) == ("x.org", "org", "a.co.uk", "co.uk")
    # By hand: the strengths are fitted, so check the arithmetic of the last level from its own mean and strength.
    n, bad = defaultdict(int), Counter()
    for host, b in pages:
        n[host] += b is not None
        bad[host] += b or 0
    c = got["c.x.org"]["rate"]
    strength = (n["a.x.org"] * (1 - got["a.x.org"]["rate"])) / (got["a.x.org"]["rate"] - c)
    assert got["b.x.org"]["rate"] == pytest.approx(strength * c / (strength + 30), rel=1e-6)


def test_query(spark, sf):
    got = QUERIES["op1_url_reputation"](spark, sf).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if verdict else ["allow", "block"])


def test_beta_quantile():
    cases = [(a, b) for a in (1, 2, 7, 60) for b in (1, 3, 25, 400)]
    got = urls.beta_quantile(np.array([float(a) for a, _ in cases]), np.array([float(b) for _, b in cases]), 0.05)
    for (a, b), x in zip(cases, got, strict=True):  # the integral over whole a and b is a binomial sum
        n = a + b - 1
        assert sum(math.comb(n, k) * x**k * (1 - x)**(n - k) for k in range(a, n + 1)) == pytest.approx(0.05, abs=2e-4)
    tiny = urls.beta_quantile(np.array([0.01, 0.5, 3e6]), np.array([0.5, 0.5, 1e6]), 0.05)
    assert 0 <= tiny[0] < 1e-12 and tiny[1] == pytest.approx(math.sin(math.pi / 2 * 0.05) ** 2, rel=1e-2)
    assert tiny[2] == pytest.approx(0.75 - 1.645 * math.sqrt(0.75 * 0.25 / 4e6), abs=1e-5)
    assert len(urls.beta_quantile(np.array([]), np.array([]), 0.05)) == 0


def test_the_query_blocks_hosts_domains_and_suffixes(spark, tmp_path):
    """Known rates: one bad host of a good domain, a bad domain, a bad suffix; unlabelled hosts go by the level above."""
    rng = np.random.default_rng(3)
    hosts = {f"h{h}.d{d}.{s}": 0.95 if s == "zz" or d == 0 or (d, h) == (1, 0) else 0.02 for s in ("zz", "org", "co.uk") for d in range(12) for h in range(4)}
    pages, labels, n = [], [], 0
    for host, rate in hosts.items():
        for i in range(40):
            n += 1
            pages.append((n, f"http://{host}/{n}"))
            if not host.startswith("h3.") and i < 39:
                labels.append((n, 1, int(rng.random() < rate)))
    pages += [(n + 1, "http://new.d0.org/x"), (n + 2, "http://new.d5.org/x"), (n + 3, "http://a.unseen.zz/x"), (n + 4, "http://a.unseen.co.uk/x")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r for r in QUERIES["op1_url_reputation"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages)
    for page, url in pages[:n]:
        host = url.split("/")[2]
        if not host.startswith("h3."):
            assert got[page]["verdict"] == ("block" if hosts[host] > 0.5 else "allow"), (host, got[page])
    assert all(0 <= r["lower"] <= r["rate"] <= 1 for r in got.values())
    rate = {pages[i - 1][1]: got[i]["rate"] for i in range(n + 1, n + 5)}
    assert rate["http://new.d0.org/x"] > rate["http://new.d5.org/x"]
    assert rate["http://a.unseen.zz/x"] > rate["http://a.unseen.co.uk/x"]
    verdicts = {i: (got[i]["verdict"], round(got[i]["lower"], 3), round(got[i]["rate"], 3)) for i in range(n + 1, n + 5)}
    assert [verdicts[i][0] for i in range(n + 1, n + 5)] == ["block", "allow", "block", "allow"], verdicts
