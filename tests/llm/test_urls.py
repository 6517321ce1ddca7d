import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import urls as u
from txnlens.llm.queries import URL_RULES

from .helpers import rows

CASES = [
    ("https://x.com/en/1", "x.com", "/en/1", "com/en/", "block"), ("http://Example.COM/en/77?x#y", "example.com", "/en/77", "example.com/en/7", "allow"), ("https://m.example.com/en/8", "m.example.com", "/en/8", "com/en/", "block"),
    ("ftp://a.net/de/8", "a.net", "/de/8", "net/de/", "allow"), ("https://b.example.net/de/8.html", "b.example.net", "/de/8.html", "example.net/de/8", "block"), ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
    ("https://a.org/es/", "a.org", "/es/", "org/es/", "block"), ("https://a.org/es", "a.org", "/es", None, None), (None, "", "", None, None), ("no scheme/en/", "", "", None, None), ("x://com", "com", "", None, None),
    ("a://b.com?q=://c.net/de/", "b.com", "", None, None), ("a\n://b.com/en/\nz", "b.com", "/en/\nz", "com/en/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = rows(u.judge_urls(df, URL_RULES), "page_id")
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        g = got[i]
        assert (g["host"], g["path"], g["rule"]) == (host, path, rule) and g["verdict"] in ((verdict,) if verdict else ("allow", "block")) and (g["score"] is None) == (rule is not None)
    assert u.judge_urls(df.limit(0), URL_RULES).count() == 0
    unmatched = u.judge_urls(df.filter("page_id = 8"), URL_RULES).first()
    assert unmatched["verdict"] == "allow"


def test_trees_learn_and_are_deterministic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    a, b = (u.Boosted().fit(x[:2000], y[:2000]) for _ in range(2))
    p = a.predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95 and np.array_equal(p, b.predict(x[2000:]))
    assert u.Boosted().fit(x[:5], np.ones(5)).predict(x[:2]).min() > 0.99
    assert u.Boosted().fit(x[:0], np.zeros(0)).predict(x[:2]).max() < 0.01


def test_held_out_accuracy(spark):
    """Verdicts of rules that the trees have not been told are learned from the words that carry them."""
    data = [(i, f"https://site{i}.{'com' if i % 2 else 'net'}/{'a' * (3 + 20 * (i % 2))}/{i}") for i in range(400)]
    rules = [("block", f"site{i}.com", "/") for i in range(1, 300, 2)] + [("allow", f"site{i}.net", "/") for i in range(0, 300, 2)]
    got = rows(u.judge_urls(spark.createDataFrame(data, "page_id long, url string"), rules), "page_id")
    right = [got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(300, 400)]
    assert sum(right) >= 95


@pytest.mark.parametrize("url", ["", "://", "https://" + "a" * 100_000, "https://[::1]:80/?&&;=#", "\x00"])
def test_features_of_odd_urls(url):
    assert np.isfinite(u.lexical([url, None], ["", ""], ["", ""], {})).all()
