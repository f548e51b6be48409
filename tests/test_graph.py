from conftest import rows
from pagelode.operators import graph


def test_suggestions(spark):
    u = lambda h, x: f"https://{h}.example/{x}"
    edges = [(u("a", f"p{i}"), u("a", "top")) for i in range(7)] + [(u("a", f"p{i}"), u("a", "next")) for i in range(1, 6)] + [(u("a", "p9"), u("a", f"x{i}")) for i in range(9)] + [(u("b", f"p{i}"), u("b", "few")) for i in range(4)]
    alone = [(u("a", "p0"),), (u("a", "p1"),), (u("a", "p9"),), (u("a", "top"),), (u("b", "p0"),)]
    got = graph.suggestions(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(alone, "url string"))
    # p0 links to the top hub, p1 to both, and b has no page with five links to it
    assert rows(got) == [(u("a", "p0"), u("a", "next")), (u("a", "p9"), u("a", "top")), (u("a", "top"), u("a", "next"))]


def crawl_by_hand(known, edges, seeds, closed, denied, max_depth, max_pages):
    """The crawl in plain Python, level by level, addresses of a level in order."""
    out = {}
    for site, start in seeds:
        level, seen, canon, n = [start], set(), set(), 0
        for depth in range(max_depth + 1):
            found, mine = set(), []
            for url in sorted(set(level) - seen):
                if n == max_pages:
                    break
                n += 1
                seen.add(url)
                status, kind, c = known.get(url, (None, None, None))
                state = "blocked_robots" if closed(url) else "blocked_pattern" if denied(url) else "fetch_error" if status is None else "http_error" if not 200 <= status < 300 else "skipped_non_html" if "text/html" not in (kind or "") else "success"
                if state == "success" and c:
                    again = c in canon or c in mine
                    mine.append(c)
                    state = "duplicate_canonical" if again and c != url else state
                out[url] = (site, depth, state)
                if state == "success":
                    found |= {d for s, d in edges if s == url}
            canon |= set(mine)
            level = found
    return sorted((s, u, d, st) for u, (s, d, st) in out.items())


def test_crawl(spark):
    import random

    rng = random.Random(4)
    sites = ["a.example", "b.example"]
    urls = [f"https://{s}/{p}{i}" for s in sites for i in range(14) for p in ("x", "y", "tag/")]
    edges = {(u, v) for u in urls for v in rng.sample([w for w in urls if w.split("/")[2] == u.split("/")[2]], 4) if u != v}
    known = {u: (rng.choice([200, 200, 200, 200, 404]), rng.choice(["text/html; charset=utf-8"] * 4 + ["text/xml", None]), rng.choice([None, u, rng.choice(urls)])) for u in rng.sample(urls, 76)}
    seeds = [(s, f"https://{s}/x0") for s in sites]
    for s, u in seeds:
        known[u] = (200, "text/html", None)
    rules = [("a.example", 1, "disallow", "/x1"), ("a.example", 2, "allow", "/x12")]
    closed = lambda u: "a.example/x1" in u and "a.example/x12" not in u
    for depth, budget in ((10, 50), (2, 50), (10, 7)):
        got = graph.crawl(
            spark.createDataFrame([(u, *k) for u, k in known.items()], "url string, http_status int, content_type string, canonical string"), spark.createDataFrame(sorted(edges), "src string, dst string"),
            spark.createDataFrame(seeds, "site string, url string"), spark.createDataFrame(rules, "site string, ordinal int, kind string, path string"), depth, budget,
        )
        want = crawl_by_hand(known, edges, seeds, closed, lambda u: "/tag/" in u, depth, budget)
        assert rows(got) == want
        assert budget == 7 or depth == 2 or len({w[3] for w in want}) == 6


def test_deep_chain(spark):
    chain = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(12)], "src string, dst string")
    assert max(r.depth for r in graph.bfs(chain, spark.createDataFrame([("u0",)], "url string")).collect()) == 10


def test_long_numbers(spark):
    urls = [(f"https://e.example/list?page={10**k}",) for k in range(21)] + [("https://e.example/a",), (None,)]
    assert rows(graph.paging_loops(spark.createDataFrame(urls, "url string"))) == [("https://e.example/list", 21, str(10**20))]
    days = [(f"https://e.example/events/2024-{m:02d}-01/20240101123",) for m in range(1, 13)]
    assert rows(graph.calendar_traps(spark.createDataFrame(days, "url string"))) == [("https://e.example/events", 12)]
