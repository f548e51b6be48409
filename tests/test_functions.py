from conftest import rows
from pagelode.functions import html as H
from pagelode.functions import urls as U
from pagelode.operators import graph, sitefiles
from pyspark.sql import functions as F


def one(spark, values, expr):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalized(spark):
    urls = ["HTTPS://Ex.example:443//a//b/?utm_source=x&b=2&a=1#top", "http://e.example", "ftp://e.example/a", "no url", None, "http://e.example:8080/A/"]
    assert one(spark, urls, U.normalized) == ["https://ex.example/a/b?a=1&b=2", "http://e.example/", None, None, None, "http://e.example:8080/A"]


def test_resolved(spark):
    cases = [("/x", "https://h.example/a/b", "https://h.example/x"), ("y", "https://h.example/a/b", "https://h.example/a/y"), ("../z?q", "https://h.example/a/b/c", "https://h.example/a/z?q"), ("//o.example/p", "https://h.example/", "https://o.example/p"), ("?q=1", "https://h.example/a", "https://h.example/a?q=1"), ("http://o.example/./k", "https://h.example/a", "http://o.example/k")]
    df = spark.createDataFrame([(h, b) for h, b, _ in cases], "h string, b string")
    assert {(r.h, r.b): r.x for r in U.with_resolved(df, "h", "b", "x").collect()} == {(h, b): x for h, b, x in cases}


def test_safe_and_denied(spark):
    assert one(spark, ["http://10.1.2.3/", "https://ok.example/", "http://localhost/", "mailto:x", None], U.is_safe) == [False, True, False, False, False]
    assert one(spark, ["https://e.example/tag/x", "https://e.example/story", "https://e.example/a.pdf", "https://e.example/a?page=2"], U.denied) == [True, False, True, True]


def test_attributes(spark):
    attrs = ['content="a b" name=\'N\'', "NAME=bare", 'name=""', "x"]
    assert one(spark, attrs, lambda c: H.attr(c, "name")) == ["N", "bare", None, None]
    page = ["<html><head><TITLE> T </TITLE><meta name=description content='d'><meta property=\"og:title\" content=\"1\"><meta property=\"og:title\" content=\"2\"></head><body><p>a</p><script>x</script> b</body></html>"]
    assert one(spark, page, H.title) == ["T"]
    assert one(spark, page, lambda c: H.last_named(c, "meta", "property", "og:title", "content")) == ["2"]
    assert one(spark, page, lambda c: H.named(c, "meta", "name", "description", "content")) == ["d"]
    assert one(spark, page, H.visible) == ["T a b"]


def test_bfs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert rows(graph.bfs(edges, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.bfs(edges.limit(0), seeds)) == [("a", 0)]
    assert rows(graph.degrees(edges))[:2] == [("a", 1, 1), ("b", 1, 1)]


def test_robots(spark):
    files = spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /a # no\nAllow: /a/b\n\nUser-agent: x\nDisallow: /"), ("n.example", None)], "origin string, body string")
    urls = spark.createDataFrame([("https://h.example/a/c",), ("https://h.example/a/b/1",), ("https://h.example/",), ("https://n.example/a",), (None,)], "url string")
    got = dict(rows(sitefiles.robots_allowed(urls, sitefiles.robots_rules(files))))
    assert got == {"https://h.example/a/c": False, "https://h.example/a/b/1": True, "https://h.example/": True, "https://n.example/a": True}
