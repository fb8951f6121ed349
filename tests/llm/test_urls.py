"""URL filter: parts, rules, the fitted model against numpy, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timesift.llm import urls

CASES = {
    "http://A.Example.com/en/x": ("a.example.com", "/en/x", "example.com/en/"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
    "http://x.www.example.com/en/?q": ("x.www.example.com", "/en/", "www.example.com/en/"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/"),
    "http://foo.net/es/1": ("foo.net", "/es/1", "net/es/"), "http://foo.net/ES/1": ("foo.net", "/ES/1", None), "http://foo.com": ("foo.com", "", None),
    "http://foo.net/fr": ("foo.net", "/fr", None), "http://foo.net?x=/fr/": ("foo.net", "", None), "//foo.com/": ("", "", None), None: ("", "", None), "": ("", "", None),
    "ftp://É.COM:80/a#b?c": ("É.com:80", "/a", None), "a\nb://h.com/p\nq?x": ("h.com", "/p\nq", "com/"), "http://com/": ("com", "/", "com/"), "http://xcom/": ("xcom", "/", None)}


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES)], "page_id long, url string, html string").withColumn("w", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (host, path, rule) in enumerate(CASES.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        wanted = {(h + p): v for h, p, v in urls.RULES}.get(rule)
        assert got[i].verdict == (wanted or ("block" if got[i].score >= 0.5 else "allow"))
    assert urls.judge(df.limit(0)).count() == 0
    assert urls.judge(df.union(df)).count() == 2 * len(CASES)


def test_fit_equals_numpy(spark):
    rows = [("http://bad-casino.org/win", 1), ("http://casino-two.net/play", 1), ("http://good.org/book", 0), ("http://books.net/read", 0), ("http://good.net/", 0)]
    table = spark.createDataFrame(rows + [(None, 1), ("http://x.y", None)], "url string, bad int")
    w = np.array(urls.train(table, dim=512, steps=40).first()["w"])
    feats = table.filter("url IS NOT NULL AND bad IS NOT NULL").select(urls.features(urls.host_of(F.col("url")), urls.path_of(F.col("url")), 512).alias("f"), "bad").collect()
    x, y = np.zeros((len(feats), 512)), np.array([r.bad for r in feats])
    for i, r in enumerate(feats):
        x[i, r.f] = 1
    v, b = np.zeros(512), 0.0
    for _ in range(40):
        e = 1 / (1 + np.exp(-(x @ v + b))) - y
        v, b = v * (1 - urls.RATE * urls.DECAY) - urls.RATE / len(y) * x.T @ e, b - urls.RATE / len(y) * e.sum()
    assert np.allclose(w, [*v, b], atol=1e-9)


def test_unseen_urls_of_both_kinds(spark):
    rows = [(1, "http://m.casino-win.example.org/de/1"), (2, "https://free-bets.example.net/en/5"), (3, "https://poker-slots.example.org/"), (4, "https://www.history-museum.example.org/en/8"),
            (5, "http://ththre.example.net/de/77")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i] for i in range(1, 6)] == ["block", "block", "block", "allow", "allow"]


def test_nothing_learnt_and_too_much(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://foo.org/"), (2, "http://foo.com/")], "page_id long, url string")
    none = urls.judge(df, urls.labelled_urls(spark).limit(0)).collect()
    assert [(r.verdict, r.score) for r in none] == [("allow", None)] * 2
    monkeypatch.setattr(urls, "TRAIN_ROWS", 5)
    with pytest.raises(ValueError):
        urls.judge(df)
