"""Page checks against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pagelode.functions import html as H
from pagelode.functions import urls as U
from pagelode.operators import sitemaps
from pagelode.plans import checks, report, runs
from pagelode.sources import tables


def each(spark, values, expr):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


E = "https://e.example"


def test_attributes(spark):
    cases = {"rel=\"next\"": "next", "rel='next'": "next", "rel=next": "next", f' href="{E}/" rel=next': "next", "REL=\"next\"": "next", "rel = \"next\"": "next", "href=\"x\"": None, "rel=\"\"": None, "rel=''": None, "rel=\" next \"": "next"}
    assert each(spark, cases, lambda c: H.attr(c, "rel")) == list(cases.values())


def test_canonical_is_found(spark):
    tag = lambda t: H.named(t, "link", "rel", "canonical", "href")
    u = f"{E}/p/"
    found = [f'<link rel="canonical" href="{u}">', f'<link href="{u}" rel="canonical">', f'<link href="{u}" rel=canonical>', f"<link rel=canonical href='{u}'>", f'<LINK REL="CANONICAL" HREF="{u}">', f'<link  rel="canonical"  href="{u}"  />', f'<link\n rel="canonical"\n href="{u}"\n>', f'<link rel="stylesheet" href="a.css">\n<link href="{u}" rel="canonical"><link rel="icon" href="i">']
    assert each(spark, found, tag) == [u] * len(found)
    assert each(spark, ["", '<link rel="stylesheet" href="a.css">', "<p>x</p>"], tag) == [None] * 3


def test_canonical_tiers(spark):
    cases = [
        (f'<link rel="canonical" href="{E}/">', f"{E}/", (True, "exact", "none")), (f'<link rel="canonical" href="{E}/">', E, (True, "exact", "none")), (f"<link href={E}/ rel=canonical>", f"{E}/", (True, "exact", "none")),
        (f'<link rel="canonical" href="{E}/other/">', f"{E}/", (True, "none", "none")), ("<title>x</title>", f"{E}/", (False, None, None)), (f'<link rel="canonical" href="{E}/?utm_source=a">', f"{E}/", (True, "lenient", "tracking")),
        (f'<link rel="canonical" href="{E}/a">', f"{E}/a/?id=3", (True, "clean", "none")), (f'<link rel="canonical" href="{E}/a?x=1">', f"{E}/a?x=2", (True, "path", "other")), (f'<link rel="canonical" href="{E.upper()}/A%20b">', f"{E}/A b#top", (True, "exact", "none")),
        ('<link rel="canonical" href="no address/">', "no address", (True, "exact", "none")),
    ]
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(cases)], "i int, html string, url string")
    cols = checks.canonical_notes(F.col("html"), F.col("url"))
    got = df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [want for _, _, want in cases]


def test_paths_are_decoded_but_for_reserved(spark):
    cases = {f"{E}/a%20b+c/": f"{E}/a b+c", f"{E}/a%2Fb%3fc": f"{E}/a%2Fb%3fc", f"{E}/caf%C3%A9?q=%20#x": f"{E}/café?q=%20", f"{E}/bad%zz": f"{E}/bad%zz", "odd//": "odd", "//": "//"}
    assert each(spark, cases, U.canonical_strict) == list(cases.values())
    assert each(spark, [f"{E}/a?b=2&utm_source=x&a=1"], U.canonical_lenient) == [f"{E}/a?a=1&b=2"]


def test_url_rules(spark):
    assert each(spark, [f"{E}/a?page=2&x=1", f"{E}/a/page/3/", f"{E}/page/2", f"{E}/a?p=1#t", "odd"], U.without_page) == [f"{E}/a?x=1", f"{E}/a", f"{E}/", f"{E}/a#t", "odd"]
    assert each(spark, ["http://h.example/a", "HTTPS://h.example", "ftp://h.example"], U.other_scheme) == ["https://h.example/a", "http://h.example", None]
    assert each(spark, [f"{E}/a/b/c", f"{E}/a", E, "odd"], U.category_segment) == ["b", "a", "news", "news"]
    drops = f"{E}/a?" + "&".join(f"{k.upper() if i % 2 else k}=1" for i, k in enumerate(U.STRIPPED)) + "&keep=1&source=x"
    assert each(spark, [drops], U.normalized) == [f"{E}/a?keep=1&source=x"]
    denied = ["/search?q=1", "/suche/", "/tags/x", "/page/3", "/p/3", "?offset=20", "/events/2024/05", "/my-account", "/wp-admin/x", "/feed", "/print", "/a.docx", "?lang=de", "?replytocom=3", "/xmlrpc"]
    fine = ["/story", "/searching", "/events/today", "/a.html", "?utm_source=x", "/feeds", "/printing"]
    assert each(spark, [E + u for u in denied + fine], U.denied) == [True] * len(denied) + [False] * len(fine)
    assert each(spark, [f"{E}/a", f"{E}/b"], lambda c: U.denied(c, deny=("/b",), allow=("/a", "/b"))) == [False, True]
    assert each(spark, [f"{E}/a", f"{E}/c"], lambda c: U.denied(c, allow=("/a",))) == [False, True]


GATES = {
    "window._cf_chl_opt = {}": "cloudflare", "<title>Just a moment...</title>": "cloudflare", "/cdn-cgi/challenge-platform/h/b": "cloudflare", 'id="cf-browser-verification"': "cloudflare", 'class="cf-turnstile"': "cloudflare", "<title>Attention Required!</title>": "cloudflare",
    "_abck=1; ak_bmsc=2": "akamai", "_abck=1 and nothing else": None, "<!-- Incapsula incident ID: 4 -->": "imperva", "incap_ses_1 visid_incap_2": "imperva", "incap_ses_1 alone": None, "https://tag.captcha-delivery.com/c": "datadome", "window.ddjskey = 1": "datadome",
    "_pxAppId = 'x'": "perimeterx", '<i class="pxCaptcha">': "perimeterx", "aws-waf-token": "aws", "verify https://hcaptcha.com/1/api.js": "hcaptcha", "<title>DDoS protection by Shield</title>": "title", "<title> Verify you are human\n</title>": "title", "<title>Human Verification</title>": "title",
    "<title>Our security policy</title>": None, "<title>Please verify your email address</title>": None, "<footer>Protected by Cloudflare</footer>": None, "": None, "ok": None, "<urlset></urlset>": None,
}


def test_gates(spark):
    assert each(spark, GATES, checks.gate_vendor) == list(GATES.values())


def test_page_states(spark):
    no, yes = False, True
    cases = [  # http_status, fetch_ok, attempts (kind, status, ok, gate), effective status, state
        (200, yes, [], 200, "OK"), (403, yes, [("access_denied", 403, no, no)], 403, "OK"), (403, no, [("waf_challenge", 200, no, yes)], 403, "BOT_PROTECTION_CHALLENGE"), (404, no, [("waf_challenge", 404, no, yes)], 404, "BOT_PROTECTION_CHALLENGE"),
        (0, no, [("waf_challenge", 200, no, yes)], 403, "BOT_PROTECTION_CHALLENGE"), (403, no, [("access_denied", 403, no, no)] * 3, 403, "CRAWLER_BLOCKED"), (0, no, [("access_denied", 401, no, no), ("timeout", 0, no, no), ("access_denied", 403, no, no)], 403, "CRAWLER_BLOCKED"),
        (401, no, [("access_denied", 401, no, no)], 401, "CRAWLER_BLOCKED"), (404, no, [("not_found", 404, no, no)], 404, "NOT_FOUND"), (410, no, [("not_found", 410, no, no)], 410, "NOT_FOUND"), (0, no, [("timeout", 0, no, no), ("server_error", 503, no, no)], 503, "SERVER_ERROR"),
        (200, no, [("parser_failure", 200, no, no)], 200, "PARSE_ERROR"), (0, no, [("timeout", 0, no, no)], 0, "FETCH_ERROR"), (0, no, [("access_denied", 403, no, no), ("timeout", 0, no, no), ("timeout", 0, no, no)], 403, "FETCH_ERROR"), (None, None, [], 0, "FETCH_ERROR"),
    ]
    fetches = spark.createDataFrame([(i, ok, s, "<html></html>" if i % 2 else "plain") for i, (s, ok, *_) in enumerate(cases)], "fetch_id int, fetch_ok boolean, http_status int, html string")
    tried = [(i, n, 10 * i + n, *a) for i, (_, _, many, *_) in enumerate(cases) for n, a in enumerate(many)]
    got = checks.states(fetches, spark.createDataFrame(tried, "fetch_id int, attempt_no int, attempt_id int, failure_kind string, status int, ok boolean, cf_challenge boolean"))
    assert [tuple(r)[1:3] for r in got.orderBy("fetch_id").collect()] == [c[3:] for c in cases]
    assert {r.fetch_id for r in got.where("usable").collect()} == {1}


def test_error_kinds(spark):
    cases = {"AbortError": "timeout", "connect TIMEOUT": "timeout", "self signed certificate": "ssl_error", "TLS handshake": "ssl_error", "getaddrinfo ENOTFOUND x": "dns_error", "net::ERR_NAME_NOT_RESOLVED": "dns_error", "socket hang up": "timeout"}
    assert each(spark, cases, checks.error_kind) == list(cases.values())


def test_types_by_address(spark):
    cases = {f"{E}/": "home", E: "home", f"{E}/search?q=1": "search", f"{E}/buscar/x": "search", f"{E}/topic/x": "tag", f"{E}/journalist/x": "author", f"{E}/watch/x": "video_article", f"{E}/2024/05/x": "article", f"{E}/a-b-c": "article", f"{E}/en/7817": "section", f"{E}/a/b/c": "unknown", f"{E}/researching/a/b": "unknown"}
    assert each(spark, cases, checks.type_by_url) == list(cases.values())


@pytest.mark.parametrize("value, there", [('"x"', True), ('""', False), ("0", False), ("false", False), ("null", False), ("[]", True), ("{}", True), ("1.5", True), ("true", True)])
def test_field_truth(spark, value, there):
    assert spark.range(1).select(F.try_parse_json(F.lit('{"f": %s}' % value)).alias("entity")).select(checks.field_of("f").alias("x")).first().x is there


def test_entities(spark):
    ld = lambda t: f'<script type="application/ld+json">{t}</script>'
    pages = [(1, ld('{"@type": "A"}') + ld("{broken") + ld('[{"@type": ["B", "C"]}, 7, null]')), (2, ld('{"@graph": [{"@type": "D"}, {"x": 1}], "@type": "Outer"}')), (3, "<p>none</p>"), (4, None)]
    got = checks.entities(spark.createDataFrame(pages, "fetch_id int, html string")).select("fetch_id", F.expr(checks._TYPES_OF).alias("t"), "no").orderBy("fetch_id", "no").collect()
    assert [(r.fetch_id, r.t) for r in got] == [(1, ["A"]), (1, ["B", "C"]), (2, ["D"]), (2, [])]


def test_sitemap_facts(spark):
    url = "<url><loc>https://e.example/a</loc></url>"
    cases = [
        (200, f"<urlset>{url}</urlset>", "FOUND"), (403, "no", "BLOCKED"), (403, f"<urlset>{url}</urlset>", "FOUND"), (404, "", "NOT_FOUND"), (410, url, "NOT_FOUND"), (500, f"<urlset>{url}</urlset>", "ERROR"), (301, "", "ERROR"),
        (200, "<title>Just a moment...</title>", "BOT_PROTECTION"), (200, " <!DOCTYPE html><p>", "SOFT_404"), (200, "words", "INVALID_XML"), (200, "", "INVALID_XML"), (200, f"<urlset>{url}<url></url></urlset>", "FOUND"), (200, f"<urlset>{url}<url></url><url><loc> </loc></url></urlset>", "INVALID_FORMAT"),
        (200, "<sitemapindex></sitemapindex>", "FOUND"), (200, "<sitemapindex><sitemap></sitemap></sitemapindex>", "INVALID_FORMAT"),
    ]
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(cases)], "i int, http_status int, body string")
    assert [r.status for r in sitemaps.sitemap_facts(df).orderBy("i").collect()] == [c[2] for c in cases]


def test_robots_merged(spark):
    body = "User-agent: other\nDisallow: /\nUser-agent: CRAWLER\nDisallow: /a # kept\nUSER-AGENT: *\nAllow: /a/b\nDisallow:\nno rule\nDisallow: /c"
    files = spark.createDataFrame([("h.example", "robots", 200, body), ("n.example", "robots", 404, "User-agent: *\nDisallow: /")], "site string, source string, http_status int, body string")
    rules = sitemaps.merged_rules(files)
    assert [(r.kind, r.path) for r in rules.orderBy("ordinal").collect()] == [("disallow", "/a # kept"), ("allow", "/a/b"), ("disallow", "/c")]
    urls = spark.createDataFrame([("https://h.example/c/1",), ("https://h.example/a/b",), ("https://n.example/x",), (None,)], "url string")
    assert rows(sitemaps.may_fetch(urls, rules)) == [("https://h.example/a/b", True), ("https://h.example/c/1", False), ("https://n.example/x", True)]


def test_index_is_followed_to_its_depth(spark):
    u = lambda k: f"https://e.example/{k}.xml"
    index = lambda *k: "<sitemapindex>" + "".join(f"<sitemap><loc>{u(x)}</loc></sitemap>" for x in k) + "</sitemapindex>"
    files = [("e", u(0), "sitemapindex", index(1, 9), "sitemap"), ("e", u(1), "sitemapindex", index(2, 0), "child"), ("e", u(2), "sitemapindex", index(3), "child"), ("e", u(3), "sitemapindex", index(4), "child"), ("e", u(4), "urlset", "<urlset></urlset>", "child")]
    got = sitemaps.expand(spark.createDataFrame(files, "site string, url string, root string, body string, source string"))
    assert sorted((r.url, r.depth, r.parent) for r in got.collect()) == [(u(0), 0, None), (u(1), 1, u(0)), (u(2), 2, u(1)), (u(3), 3, u(2)), (u(9), 1, u(0))]


def test_dates_are_read(spark):
    cases = {"2024-05-01": "2024-05-01 00:00:00", "2024-05-01T10:00:00Z": "2024-05-01 10:00:00", "2024-05-01T10:00:00+02:00": "2024-05-01 08:00:00", "2024-05-01T10:00+02:00": "2024-05-01 08:00:00", "soon": None, "": None, "2024-13-01": None}
    assert each(spark, cases, lambda c: F.date_format(sitemaps.read_time(c), "yyyy-MM-dd HH:mm:ss")) == list(cases.values())
    assert report.AS_OF == sitemaps.AS_OF


def test_run_status_follows_the_last_event(spark):
    events = [("r", "PENDING", "2024-01-01 00:00:00", 0), ("r", "RUNNING", "2024-01-01 00:00:00", 1), ("r", "COMPLETED", "2024-01-01 01:00:00", 0), ("q", "RUNNING", "2024-01-02 00:00:00", 0)]
    df = spark.createDataFrame(events, "run_id string, status string, at string, ordinal int")
    assert rows(runs.run_status(df).select("run_id", "status")) == [("q", "RUNNING"), ("r", "COMPLETED")]
    assert df.transform(runs.with_uuid).select("id").distinct().count() == 4


def test_shift_risk_adds_in_doubles(spark):
    got = spark.sql("select 11 i, 3 f, true a").select(runs.shift_risk(F.col("i"), F.col("f"), F.col("a")).alias("r")).first().r
    assert got == 0.1 + 0.15 + 0.05 + 0.1 and got > 0.25


def test_files_and_children(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"'), ("b", None)], "id string, text string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert rows(tables.read(spark, str(tmp_path / "c"), "csv", "id string, text string", header="true", escape='"').where("text is not null")) == [("a", 'x "y"')]
    tables.write(df, str(tmp_path / "p"), partition_by=("id",))
    assert tables.read(spark, str(tmp_path / "p")).count() == 2
    kept = tables.replace_children(spark.createDataFrame([("s", 1), ("t", 2)], "site string, n int"), spark.createDataFrame([("s", 7)], "site string, n int"), "site")
    assert rows(kept) == [("s", 7), ("t", 2)]


def test_database_tables(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(20)], "n int, site string")
    tables.write_jdbc(df, url, "runs", "overwrite", 2, driver)
    tables.write_jdbc(df.limit(1), url, "runs", properties=driver)
    back = tables.read_jdbc(spark, url, "runs", "n", 0, 20, 4, driver)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 21 and rows(back.distinct().toDF("n", "site")) == rows(df)
