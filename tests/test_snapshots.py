from datetime import datetime

from conftest import rows
from pagelode.operators.snapshots import following, numbered, snapshot_changes

DDL = "id string, site_id string, snapshot_at timestamp, pages array<struct<url: string, page_type: string, status: string, recommendations: array<struct<priority: string, area: string, message: string>>>>, url string"


def page(url, status="PASS", recs=None, kind="a"):
    return (url, kind, status, recs)


def frame(spark, *snaps):
    return spark.createDataFrame([(i, s, datetime(2024, m, d), pages, "clash") for i, s, m, d, pages in snaps], DDL)


def test_changes(spark):
    r1, r2 = ("P0", "x", "m"), ("P1", None, None)
    df = frame(
        spark,
        ("n1", "s", 1, 1, [page("/a"), page("/b", None, [r1, r2]), page("/c", "FAIL"), page("/d")]),
        ("n2", "s", 1, 9, None),  # failed: passed over
        ("n3", "s", 2, 1, [page("/b", None, [r2, r1, r1]), page("/c", "PASS"), page("/d", kind="other"), page("/e"), page("/e", "FAIL"), None, page(None)]),
        ("n3", "s", 2, 1, [page("/b", None, [r2, r1, r1]), page("/c", "PASS"), page("/d", kind="other"), page("/e"), page("/e", "FAIL"), None, page(None)]),  # redelivered
        ("n4", "s", 3, 1, []),
        ("n5", "s", 3, 2, [page("/e", "FAIL", [])]),
        ("n6", "s", 3, 3, [page("/e", "FAIL", None)]),  # NULL and empty lists are alike
        ("o1", "t", 1, 1, [page("/a")]),
    )
    assert rows(snapshot_changes(df)) == sorted([
        ("n3", "/a", "removed"), ("n3", "/c", "changed"), ("n3", "/e", "added"),
        ("n4", "/b", "removed"), ("n4", "/c", "removed"), ("n4", "/d", "removed"), ("n4", "/e", "removed"), ("n5", "/e", "added"),
    ])


def test_no_rows(spark):
    assert rows(snapshot_changes(spark.createDataFrame([], DDL))) == []


def test_following_across_buckets_and_ties(spark):
    heads = [("g", datetime(2024, 1, 5), "b"), ("g", datetime(2024, 1, 5), "a"), ("g", datetime(2024, 4, 1), "c"), ("g", datetime(2023, 12, 1), "z"), ("h", datetime(2024, 1, 1), "x")]
    df = spark.createDataFrame(heads, "g string, t timestamp, k string")
    assert rows(following(df, "g", "t", "k")) == [("a", "b"), ("b", "c"), ("z", "a")]


def test_numbered(spark):
    heads = [("g", datetime(2024, 1, 5), "b"), ("g", datetime(2024, 1, 5), "a"), ("g", datetime(2024, 4, 1), "c"), ("g", datetime(2023, 12, 1), "z"), ("h", None, "x")]
    df = spark.createDataFrame(heads, "g string, t timestamp, k string")
    assert rows(numbered(df, "g", "t", "k").select("g", "no", "k", "is_last")) == [("g", 1, "z", False), ("g", 2, "a", False), ("g", 3, "b", False), ("g", 4, "c", True), ("h", 1, "x", True)]


def test_no_site_and_look_alikes(spark):
    df = frame(
        spark,
        ("a1", None, 1, 1, [page("/a", "1:x"), page("/n", None)]),
        ("a2", None, 2, 1, [page("/a", "1:x", [("-", "-", "-")]), page("/n", "")]),  # NULL and empty status differ
        ("b1", "", 1, 1, [page("/b")]),
    )
    assert rows(snapshot_changes(df)) == [("a2", "/a", "changed"), ("a2", "/n", "changed")]
