import math
import re
import zlib

import pytest

from screenlab.llm import url_filter
from screenlab.llm.op01 import RULES
from screenlab.llm.url_filter import MarkovModel, judge_urls, logistic_curve


def brute(url):
    """host, path, rule string, its verdict."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(str(r)), default=None)
    return host, path, best and str(best), best and best.verdict


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://example.org/en/12",
    "https://example.org/en/2", "http://badexample.org/es/", "http://a.b.com/fr/x", "http://com/de/1", "http://x.com",
    "ftp://h.net?q=/fr/", "http://x.org#/es/", "http://Ünï.com/de/ß", "http://a.com/de/\n/x", "x\ny://a.org/z",
    "http://a.net/en/1://b.org/",
]


def test_hosts_paths_and_rules_equal_brute_force(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[5], "clash"), (5, URLS[5], "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judge_urls(df, RULES).select("row.url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_probabilities_sum_to_one():
    text, counts = "^abracadabra$", {}
    for size in range(1, 7):
        for k in range(len(text) - size + 1):
            counts[text[k : k + size]] = counts.get(text[k : k + size], 0) + 1
    model = MarkovModel(counts, alphabet=7)
    for head in ("", "a", "ab", "abr", "zz"):
        assert math.isclose(sum(math.exp(model.of(head + c)) for c in "^$abcrd"), 1.0, rel_tol=1e-9)


def test_model_tells_hosts_apart(spark):
    rows = [(k, f"http://news{k % 5}.org/en/{k}") for k in range(200)]
    rows += [(1000 + k, f"http://casino{k % 5}.com/de/{k}") for k in range(200)]
    rows += [(5000, "http://casino9.net/x"), (5001, "http://news8.net/en/9")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["row"]["page_id"]: r["verdict"] for r in judge_urls(df, RULES).filter("row.page_id >= 5000").collect()}
    assert got == {5000: "block", 5001: "allow"}


def test_curve_is_calibrated():
    import numpy as np

    x = np.linspace(-3, 3, 200)
    a, b = logistic_curve(x, 1 / (1 + np.exp(-(2 * x - 1))), np.full(200, 50.0))
    assert abs(a - 2) < 0.05 and abs(b + 1) < 0.05


@pytest.mark.parametrize("bits", [2, 15])
def test_rare_ngrams_count_whatever_the_size(spark, monkeypatch, bits):
    # Each path's last n-grams stand once among far more than 2**15.
    monkeypatch.setattr(url_filter, "BITS", bits)
    taught = next(k for k in range(60000, 60100) if zlib.crc32(str(k).encode()) % 3 != 1)
    rows = [(k, f"http://n.org/{k * 7919 % 10007:05d}-{k * 104729 % 99991:x}") for k in range(3000)]
    rows += [(10000 + k, f"http://n.com/de/{k * 6007 % 10009:05d}") for k in range(3000)]
    rows += [(50000, "http://n.net/zq-xjkv"), (taught, "http://n.org/zq-xjkv"), (50001, "http://n.net/zq-xjkv"), (7, None)]
    counts, total = {"org": {}, "com": {}}, 0
    for k, url in rows:
        host = url and url.split("/")[2][2:]
        if host in counts and zlib.crc32(str(k).encode()) % 3 != 1:
            text = "^" + url[7:] + "$"
            for size in range(1, 7):
                for i in range(len(text) - size + 1):
                    gram = text[i : i + size]
                    counts[host][gram] = counts[host].get(gram, 0) + 1
                    total += size == 6
    assert total > 2**15 and counts["org"]["q-xjkv"] == 1
    allow, block = MarkovModel(counts["org"]), MarkovModel(counts["com"])
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = judge_urls(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "^" + (r["row"]["url"] or "http://")[7:] + "$"
        want = (allow.likelihood(text) - block.likelihood(text)) / (len(text) - 1) if len(text) > 2 else 0.0
        assert math.isclose(r["ratio"], want, rel_tol=1e-9, abs_tol=1e-9), r
