"""Every text operator on empty tables, rows of NULLs, empty and very long texts, repeated rows and columns of clashing names."""

import pytest
from test_pages import html, story

from conftest import rows
from pagelode.llm import encoding_repair, leakage, main_content, mixing, near_duplicates, radix_percentiles, residue, truncation

LONG = story(*[f"<p>{'A long way of words goes on and on. ' * 400}</p>"] * 60)
FETCH = "fetch_id bigint, site_id string, url string, html string, kind string, h bigint, score double, words string, rep bigint"
PAGES = [(1, "s", "https://s.example/a", story(), "x", 1, 1.0, "x", 1), (2, None, None, html("<h1>Access denied</h1>"), None, None, None, None, None), (None,) * 9, (4, "s", "u", "", "x", 1, 1.0, "x", 1), (5, "s", "u", LONG, "x", 1, 1.0, "x", 1), (6, "s", "u", story(), "x", 1, 1.0, "x", 1)]


@pytest.fixture(scope="module")
def fetches(spark):
    return spark.createDataFrame(PAGES + PAGES[:2], FETCH)


def test_pages(fetches):
    assert sorted({r.fetch_id for r in residue.residue_pages(fetches).collect()}) == [2]
    assert {r.fetch_id for r in main_content.main_body_blocks(fetches).select("fetch_id").distinct().collect()} == {1, 5, 6}
    made = near_duplicates.bodies(fetches)
    links, members = near_duplicates.near_duplicate_links(made)
    assert rows(links) == [(1, 5)] and rows(members) == [(1, 1), (1, 6), (5, 5)]  # the long one repeats few words
    empty = fetches.limit(0)
    assert rows(residue.residue_pages(empty)) == rows(main_content.main_body_blocks(empty)) == []
    links, members = near_duplicates.near_duplicate_links(near_duplicates.bodies(empty))
    assert rows(links) == rows(members) == []


def test_values(spark):
    ddl = "meta_id bigint, title string, description string, chain string, restored string, value string"
    long = "Für " * 50_000
    data = [(1, "FÃ¼r Elise", None, "x", "x", "x"), (2, "", " ", "x", "x", "x"), (None,) * 6, (3, None, None, None, None, None), (4, long, "FÃ¼r " * 3_000, "x", "x", "x"), (5, "Für", "Früh", "x", "x", "x")]
    df = spark.createDataFrame(data + data[:1], ddl)
    assert [r[:2] for r in rows(encoding_repair.garbled_values(df).select("meta_id", "field_name"))] == [(1, "title"), (4, "description")]
    assert {r.restored for r in encoding_repair.garbled_values(df).where("meta_id = 4").collect()} == {"Für " * 3_000}
    assert rows(encoding_repair.garbled_values(df.limit(0))) == []


def test_texts(spark):
    ddl = "doc_id bigint, text string, source string, errors int, item_id bigint, chars int, kind string, tokens int"
    item = " ".join(f"w{i}" for i in range(20))
    data = [(1, item + " end.", "a", 1, 1, 1, "x", 1), (2, None, None, None, None, None, None, None), (3, " \n", "a", 1, 1, 1, "x", 1), (4, "word " * 200_000 + item, None, 1, 1, 1, "x", 1), (None, item, "a", 1, 1, 1, "x", 1), (5, "", "a", 1, 1, 1, "x", 1)]
    docs = spark.createDataFrame(data + data[:1], ddl)
    items = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, None, "x"), (None, item, "x"), (9, "", "x")], "item_id bigint, passage string, doc_id string")
    assert rows(leakage.leaks(docs, items)) == [(1, 7, 0), (4, 7, 0)] == rows(leakage.leaks(docs, items, 2))
    ends = {r.doc_id: r.kind for r in truncation.endings(docs).collect()}
    assert ends == {1: "complete", 4: "running"}
    assert {r.doc_id for r in truncation.cut_documents(docs)[0].where("cut").collect()} == {4}
    targets = spark.createDataFrame([("A", 1.0, 1), (None, 0.5, 1), ("none", None, None)], "source string, target_share double, max_repeats int")
    assert [(r.doc_id, r.times) for r in mixing.mix(docs, targets)[0].collect()] == [(1, 1)]
    empty = docs.limit(0)
    assert rows(leakage.leaks(empty, items)) == rows(truncation.endings(empty)) == rows(mixing.mix(empty, targets)[0]) == []
    assert rows(mixing.mix(docs, targets.limit(0))[0]) == []


def test_numbers(spark):
    ddl = "perf_id bigint, site_id string, page_type string, load_ms bigint, html_kb double, ttfb_ms bigint, measured_at timestamp, salt string, digit int, slice string"
    data = [(1, "s", "a", 5, float("nan"), None, None, "x", 1, "x"), (None,) * 10, (2, None, None, -1, float("inf"), 0, None, "x", 1, "x"), (1, "s", "a", 5, float("nan"), None, None, "x", 1, "x")]
    got = radix_percentiles.exact_percentiles(spark.createDataFrame(data, ddl), (50,)).collect()
    assert sorted((r.site_id or "", r.metric, r.n, r.value) for r in got) == [("", "ttfb_ms", 1, 0.0), ("s", "load_ms", 1, 5.0)]
    assert rows(radix_percentiles.exact_percentiles(spark.createDataFrame([], ddl))) == []
