"""Page-level extraction over fetched pages, one query per operator, with its DuckDB text beside it.

Fetches are redelivered now and then: identical rows are dropped after extraction, when they are narrow.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..session import load, spread
from . import augmented

PAGE_SQL = "(SELECT DISTINCT fetch_id, site_id, url, final_url, html FROM fetch_results WHERE html IS NOT NULL AND html <> '')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches with html, over as many tasks as there are cores: the checks work on every character."""
    return spread(load(spark, sf_dir, "fetch_results").select("fetch_id", "site_id", "url", "final_url", "html").where("html is not null and html <> ''"))


def _columns() -> Iterator[tuple[str, dict[str, Column]]]:
    """Query name and its columns over (html, url)."""
    _html, _url = F.col("html"), F.col("url")
    title = H.title(_html)
    yield 'title_check', {
        'title': title,
        'title_len': F.length(title).cast('bigint'),
        'title_len_ok': F.length(title).between(15, 65),
    }
    d = H.named(_html, 'meta', 'name', 'description', 'content')
    yield 'meta_description', {
        'description': d,
        'desc_len': F.length(d).cast('bigint'),
        'desc_len_ok': F.coalesce(F.length(d).between(70, 160), F.lit(False)),
    }
    h1 = H.inner_texts(_html, 'h1')
    filled = F.filter(h1, lambda x: x != '')
    yield 'h1_check', {
        'h1_count': F.size(h1).cast('bigint'),
        'h1_first': F.get(filled, F.lit(0)),
        'h1_ok': F.size(filled) == 1,
    }
    robots = F.lower(H.named(_html, 'meta', 'name', 'robots', 'content'))
    yield 'robots_meta', {
        'robots': robots,
        'noindex': F.coalesce(robots.contains('noindex'), F.lit(False)),
        'nofollow': F.coalesce(robots.contains('nofollow'), F.lit(False)),
    }
    yield 'og_tags', {f'og_{k}': H.last_named(_html, 'meta', 'property', f'og:{k}', 'content') for k in ('title', 'description', 'image', 'type', 'url')} | {f'article_{k}': H.last_named(_html, 'meta', 'property', f'article:{k}', 'content') for k in ('published_time', 'modified_time')}
    yield 'twitter_tags', {f'twitter_{k}': H.last_named(_html, 'meta', 'name', f'twitter:{k}', 'content') for k in ('card', 'title', 'image')}
    yield 'viewport_charset_lang', {
        'has_viewport': H.named(_html, 'meta', 'name', 'viewport', 'content').isNotNull(),
        'charset': F.nullif(F.lower(F.coalesce(F.nullif(F.regexp_extract(_html, H.CHARSET, 1), F.lit('')), F.regexp_extract(_html, H.HTTP_EQUIV, 1))), F.lit('')),
        'lang': H.attr(F.get(H.tags(_html, 'html'), F.lit(0)), 'lang'),
    }
    yield 'canonical_extract', {
        'canonical': H.named(_html, 'link', 'rel', 'canonical', 'href'),
        'amphtml': H.named(_html, 'link', 'rel', 'amphtml', 'href'),
        'has_next': F.exists(H.tags(_html, 'link'), lambda a: F.coalesce(F.lower(H.attr(a, 'rel')) == 'next', F.lit(False))),
        'has_prev': F.exists(H.tags(_html, 'link'), lambda a: F.coalesce(F.lower(H.attr(a, 'rel')) == 'prev', F.lit(False))),
    }
    words = F.col("_words")  # worked out once, before the columns that use it
    yield 'word_count', {
        'words': F.size(words).cast('bigint'),
        'uniqueness': F.when(F.size(words) == 0, F.lit(100.0)).otherwise(F.floor(F.size(F.array_distinct(F.transform(words, F.lower))) * 100.0 / F.size(words) + 0.5).cast('double')),
    }
    yield 'byline_flags', {
        'has_byline': _html.rlike('(?i)rel=[\\"\']author[\\"\']|class=[\\"\'][^\\"\']*(?:author|byline)[^\\"\']*[\\"\']|itemprop=[\\"\']author[\\"\']'),
        'has_date': _html.rlike('(?i)<time[\\s>]|itemprop=[\\"\']datePublished[\\"\']|article:published_time'),
        'has_main_image': _html.rlike('(?i)<figure[^>]*>|property=[\\"\']og:image[\\"\']'),
        'has_json_ld': _html.rlike('(?i)<script[^>]*type=[\\"\']application/ld\\+json[\\"\']'),
    }
    hrefs = F.regexp_extract_all(_html, F.lit(H.QUOTED_HREF), F.lit(1))
    inside = lambda x: x.startswith('/') & ~x.startswith('//') | F.coalesce(U.host(x) == U.host(_url), F.lit(False))
    web = lambda x: x.rlike('(?i)^https?://') & ~inside(x)
    yield 'link_counts', {
        'internal_links': F.size(F.filter(hrefs, inside)).cast('bigint'),
        'external_links': F.size(F.filter(hrefs, web)).cast('bigint'),
        'mail_links': F.size(F.filter(hrefs, lambda x: x.rlike('(?i)^(?:mailto|tel):'))).cast('bigint'),
    }
    yield 'headings', {f'h{k}': F.size(H.inner_texts(_html, f'h{k}')).cast('bigint') for k in range(1, 7)}
    imgs = F.regexp_extract_all(_html, F.lit(H.IMG), F.lit(0))
    yield 'image_alt', {
        'images': F.size(imgs).cast('bigint'),
        'without_alt': F.size(F.filter(imgs, lambda t: ~t.rlike('(?i)\\balt\\s*=\\s*[\\"\'][^\\"\']+[\\"\']'))).cast('bigint'),
    }
    yield 'page_weight', {
        'html_kb': F.floor(F.octet_length(_html) / 1024.0 * 10 + 0.5) / 10,
        'scripts': F.regexp_count(_html, F.lit('(?i)<script')).cast('bigint'),
        'lazy_images': F.regexp_count(_html, F.lit('(?i)loading=["\']lazy["\']')).cast('bigint'),
        'touch_ok': ~_html.rlike('(?i)touch-action:\\s*none'),
    }
    yield 'url_parts', {
        'scheme': U.part(_url, 1),
        'host': U.host(_url),
        'path': U.path(_url),
        'first_segment': F.split_part(U.path(_url), F.lit('/'), F.lit(2)),
        'safe': U.is_safe(_url),
        'denied': U.denied(_url),
        'page_token': U.page_token(_url),
    }
    tokens = F.split(F.coalesce(U.part(_url, 5), F.lit('')), '&')
    yield 'normalized_url', {
        'normalized': U.normalized(_url),
        'tracking': F.size(F.filter(tokens, lambda t: t.rlike(U.TRACKING))).cast('bigint'),
    }
    canonical = H.named(_html, 'link', 'rel', 'canonical', 'href')
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    yield 'canonical_match', {
        'has_canonical': canonical.isNotNull(),
        'exact': same(U.normalized(canonical), U.normalized(_url)),
        'same_page': same(U.host(canonical), U.host(_url)) & same(U.path(canonical), U.path(_url)),
        'with_query': F.coalesce(canonical.contains('?'), F.lit(False)),
    }


def _int(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def _flag(pattern: str) -> str:
    return f"regexp_matches(html, {H.q(pattern)})"


def _texts() -> Iterator[tuple[str, dict[str, str]]]:
    """The same in DuckDB's SQL."""
    title_sql = H.title_sql('html')
    yield 'title_check', {
        'title': title_sql,
        'title_len': _int(f'length({title_sql})'),
        'title_len_ok': f'length({title_sql}) BETWEEN 15 AND 65',
    }
    d_sql = H.named_sql('html', 'meta', 'name', 'description', 'content')
    yield 'meta_description', {
        'description': d_sql,
        'desc_len': _int(f'length({d_sql})'),
        'desc_len_ok': f'coalesce(length({d_sql}) BETWEEN 70 AND 160, false)',
    }
    h1_sql = H.inner_texts_sql('html', 'h1')
    filled_sql = f"list_filter({h1_sql}, lambda y: y <> '')"
    yield 'h1_check', {
        'h1_count': _int(f'len({h1_sql})'),
        'h1_first': f'{filled_sql}[1]',
        'h1_ok': f'len({filled_sql}) = 1',
    }
    robots_sql = f'lower({H.named_sql('html', 'meta', 'name', 'robots', 'content')})'
    yield 'robots_meta', {
        'robots': robots_sql,
        'noindex': f"coalesce(contains({robots_sql}, 'noindex'), false)",
        'nofollow': f"coalesce(contains({robots_sql}, 'nofollow'), false)",
    }
    yield 'og_tags', {f'og_{k}': H.last_named_sql('html', 'meta', 'property', f'og:{k}', 'content') for k in ('title', 'description', 'image', 'type', 'url')} | {f'article_{k}': H.last_named_sql('html', 'meta', 'property', f'article:{k}', 'content') for k in ('published_time', 'modified_time')}
    yield 'twitter_tags', {f'twitter_{k}': H.last_named_sql('html', 'meta', 'name', f'twitter:{k}', 'content') for k in ('card', 'title', 'image')}
    yield 'viewport_charset_lang', {
        'has_viewport': f'{H.named_sql('html', 'meta', 'name', 'viewport', 'content')} IS NOT NULL',
        'charset': f"nullif(lower(coalesce(nullif(regexp_extract(html, {H.q(H.CHARSET)}, 1), ''), regexp_extract(html, {H.q(H.HTTP_EQUIV)}, 1))), '')",
        'lang': H.attr_sql(f'{H.tags_sql('html', 'html')}[1]', 'lang'),
    }
    yield 'canonical_extract', {
        'canonical': H.named_sql('html', 'link', 'rel', 'canonical', 'href'),
        'amphtml': H.named_sql('html', 'link', 'rel', 'amphtml', 'href'),
        'has_next': f"len(list_filter({H.tags_sql('html', 'link')}, lambda a: lower({H.attr_sql('a', 'rel')}) = 'next')) > 0",
        'has_prev': f"len(list_filter({H.tags_sql('html', 'link')}, lambda a: lower({H.attr_sql('a', 'rel')}) = 'prev')) > 0",
    }
    words_sql = H.words_sql('html')
    yield 'word_count', {
        'words': _int(f'len({words_sql})'),
        'uniqueness': f'CASE WHEN len({words_sql}) = 0 THEN 100.0::DOUBLE ELSE floor(len(list_distinct(list_transform({words_sql}, lambda w: lower(w)))) * 100.0::DOUBLE / len({words_sql}) + 0.5) END',
    }
    yield 'byline_flags', {
        'has_byline': _flag('(?i)rel=[\\"\']author[\\"\']|class=[\\"\'][^\\"\']*(?:author|byline)[^\\"\']*[\\"\']|itemprop=[\\"\']author[\\"\']'),
        'has_date': _flag('(?i)<time[\\s>]|itemprop=[\\"\']datePublished[\\"\']|article:published_time'),
        'has_main_image': _flag('(?i)<figure[^>]*>|property=[\\"\']og:image[\\"\']'),
        'has_json_ld': _flag('(?i)<script[^>]*type=[\\"\']application/ld\\+json[\\"\']'),
    }
    hrefs_sql = f'regexp_extract_all(html, {H.q(H.QUOTED_HREF)}, 1)'
    inside_sql = f"(starts_with(x, '/') AND NOT starts_with(x, '//') OR coalesce({U.host_sql('x')} = {U.host_sql('url')}, false))"
    yield 'link_counts', {
        'internal_links': _int(f'len(list_filter({hrefs_sql}, lambda x: {inside_sql}))'),
        'external_links': _int(f"len(list_filter({hrefs_sql}, lambda x: regexp_matches(x, '(?i)^https?://') AND NOT {inside_sql}))"),
        'mail_links': _int(f"len(list_filter({hrefs_sql}, lambda x: regexp_matches(x, '(?i)^(?:mailto|tel):')))"),
    }
    yield 'headings', {f'h{k}': _int(f'len({H.inner_texts_sql('html', f'h{k}')})') for k in range(1, 7)}
    imgs_sql = f'regexp_extract_all(html, {H.q(H.IMG)})'
    yield 'image_alt', {
        'images': _int(f'len({imgs_sql})'),
        'without_alt': _int(f'len(list_filter({imgs_sql}, lambda t: NOT regexp_matches(t, {H.q(chr(40) + '?i)' + chr(92) + 'balt' + chr(92) + 's*=' + chr(92) + 's*[' + chr(34) + chr(39) + '][^' + chr(34) + chr(39) + ']+[' + chr(34) + chr(39) + ']')})))'),
    }
    yield 'page_weight', {
        'html_kb': 'floor(octet_length(encode(html)) / 1024.0::DOUBLE * 10 + 0.5) / 10',
        'scripts': _int("len(regexp_extract_all(html, '(?i)<script'))"),
        'lazy_images': _int('len(regexp_extract_all(html, \'(?i)loading=["\'\']lazy["\'\']\'))'),
        'touch_ok': "NOT regexp_matches(html, '(?i)touch-action:\\s*none')",
    }
    yield 'url_parts', {
        'scheme': U.part_sql('url', 1),
        'host': U.host_sql('url'),
        'path': U.path_sql('url'),
        'first_segment': f"split_part({U.path_sql('url')}, '/', 2)",
        'safe': f"coalesce(lower({U.part_sql('url', 1)}) IN ('http', 'https') AND {U.host_sql('url')} IS NOT NULL AND NOT regexp_matches({U.host_sql('url')}, {H.q(U.PRIVATE)}), false)",
        'denied': U.denied_sql('url'),
        'page_token': U.page_token_sql('url'),
    }
    tokens_sql = f"string_split(coalesce({U.part_sql('url', 5)}, ''), '&')"
    yield 'normalized_url', {
        'normalized': U.normalized_sql('url'),
        'tracking': _int(f'len(list_filter({tokens_sql}, lambda t: regexp_matches(t, {H.q(U.TRACKING)})))'),
    }
    canonical_sql = H.named_sql('html', 'link', 'rel', 'canonical', 'href')
    yield 'canonical_match', {
        'has_canonical': f'{canonical_sql} IS NOT NULL',
        'exact': f'coalesce({U.normalized_sql(canonical_sql)} = {U.normalized_sql('url')}, false)',
        'same_page': f'coalesce({U.host_sql(canonical_sql)} = {U.host_sql('url')}, false) AND coalesce({U.path_sql(canonical_sql)} = {U.path_sql('url')}, false)',
        'with_query': f"coalesce(contains({canonical_sql}, '?'), false)",
    }


#: Queries over pages with the tags of ``augmented`` put before them, as the delivered ones have none of theirs.
AUGMENTED = frozenset("robots_meta og_tags twitter_tags viewport_charset_lang canonical_extract canonical_match".split())


def _query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = dict(_columns())[name]
        source = augmented.pages if name in AUGMENTED else pages
        return source(spark, sf_dir).withColumn("_words", H.words(F.col("html"))).select("fetch_id", *[c.alias(n) for n, c in cols.items()]).distinct()

    return query


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles seen before on their site, in order of fetch id; only the second and later pages count."""
    rows = pages(spark, sf_dir).select("fetch_id", "site_id", F.lower(H.title(F.col("html"))).alias("key")).where("key <> ''").distinct()
    first = rows.groupBy("site_id", "key").agg(F.min("fetch_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["site_id", "key"]).where("fetch_id > first_id").select("fetch_id", "site_id", "key", "first_id")


DUPLICATE_TITLES_SQL = """
WITH r AS (SELECT DISTINCT fetch_id, site_id, lower({t}) AS key FROM {p}),
f AS (SELECT *, min(fetch_id) OVER (PARTITION BY site_id, key) AS first_id FROM r WHERE key <> '')
SELECT fetch_id, site_id, key, first_id FROM f WHERE fetch_id > first_id
"""


def json_ld_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, block, type): types of the JSON-LD blocks, @graph members and lists spread; blocks that don't parse are skipped."""
    pattern = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    blocks = augmented.pages(spark, sf_dir).select("fetch_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("block", "body")).distinct()
    parsed = blocks.select("fetch_id", "block", F.try_parse_json("body").alias("v")).where("v is not null")
    # an object, or a list of objects, or an object with @graph: read as lists by path, absent paths are NULL
    one = F.array(F.col("v"))
    many = F.expr("try_variant_get(v, '$', 'array<variant>')")
    graph = F.expr("try_variant_get(v, '$[\"@graph\"]', 'array<variant>')")
    nodes = parsed.select("fetch_id", "block", F.explode(F.coalesce(graph, many, one)).alias("n"))
    kinds = F.coalesce(F.expr("try_variant_get(n, '$[\"@type\"]', 'array<string>')"), F.array(F.expr("try_variant_get(n, '$[\"@type\"]', 'string')")))
    return nodes.select("fetch_id", F.col("block").cast("bigint").alias("block"), F.explode(kinds).alias("type")).where("type is not null")


JSON_LD_SQL = """
WITH b AS (SELECT DISTINCT fetch_id, unnest(range(len(x))) AS block, unnest(x) AS body FROM
  (SELECT fetch_id, regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) AS x FROM {a})),
v AS (SELECT fetch_id, block, body::JSON AS j FROM b WHERE json_valid(body)),
n AS (SELECT fetch_id, block, unnest(CASE WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS n FROM v),
t AS (SELECT fetch_id, block, unnest(CASE WHEN json_type(n, '$."@type"') = 'ARRAY' THEN json_extract_string(n, '$."@type"[*]') ELSE [json_extract_string(n, '$."@type"')] END) AS type FROM n)
SELECT fetch_id, block, type FROM t WHERE type IS NOT NULL
"""


def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest link texts of each site; ties by text."""
    found = pages(spark, sf_dir).select("fetch_id", "site_id", F.regexp_extract_all("html", F.lit(H.ANCHOR), F.lit(1)).alias("a")).distinct()
    texts = found.select("site_id", F.explode("a").alias("a")).select("site_id", H.trimmed(F.regexp_replace("a", H.TAGS, "")).alias("anchor")).where("anchor <> '' and length(anchor) < 100")
    counts = texts.groupBy("site_id", "anchor").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("n"), "anchor"))
    return counts.withColumn("rank", rank).where("rank <= 10").withColumn("rank", F.col("rank").cast("bigint"))


ANCHOR_SQL = """
WITH a AS (SELECT site_id, unnest(x) AS a FROM (SELECT DISTINCT fetch_id, site_id, regexp_extract_all(html, {pattern}, 1) AS x FROM {p})),
t AS (SELECT site_id, {text} AS anchor FROM a),
c AS (SELECT site_id, anchor, count(*) AS n FROM t WHERE anchor <> '' AND length(anchor) < 100 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, anchor) AS rank FROM c) WHERE rank <= 10
"""


def term_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest words (between blanks, of more than three characters) of each source's texts, with their share in percent; ties by word."""
    docs = load(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower("text"), f"{H.WS}+")).alias("term")).where("length(term) > 3")
    counts = docs.groupBy("source", "term").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source")
    share = F.floor(F.col("n") * 10000.0 / F.sum("n").over(by) + 0.5) / 100
    rank = F.row_number().over(by.orderBy(F.desc("n"), "term"))
    return counts.withColumn("pct", share).withColumn("rank", rank.cast("bigint")).where("rank <= 10")


TERM_SQL = """
WITH t AS (SELECT source, term FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n\\f]+')) AS term FROM documents) WHERE length(term) > 3),
c AS (SELECT source, term, count(*) AS n FROM t GROUP BY ALL)
SELECT * FROM (SELECT source, term, n, floor(n * 10000.0::DOUBLE / sum(n) OVER (PARTITION BY source) + 0.5) / 100 AS pct, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 10
"""


def fingerprint_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same 32-bit rolling hash of their first 500 visible characters, lower-cased (the fingerprint's definition), at two or more addresses, and the address
    they should name: the canonical address of the one with the shortest address, or that address.  Some pages are taken to have a print version, so that copies are met."""
    rows = pages(spark, sf_dir).select("fetch_id", "url", H.named(F.col("html"), "link", "rel", "canonical", "href").alias("canonical"), F.substring(F.lower(H.visible(F.col("html"))), 1, 500).alias("t")).distinct()
    rows = rows.unionByName(rows.where("fetch_id % 10 = 0").withColumn("url", F.concat("url", F.lit("/print"))))
    codes = F.transform(F.split("t", ""), lambda c: F.ascii(c).cast("bigint"))
    rows = rows.select("url", "canonical", F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))).alias("fingerprint")).where("url is not null")
    per = rows.groupBy("fingerprint").agg(F.count_distinct("url").alias("n_urls"), F.min(F.struct(F.length("url").alias("l"), "url", F.coalesce("canonical", F.col("url")).alias("keep"))).alias("m")).where("n_urls > 1")
    return per.select("fingerprint", "n_urls", F.col("m.url").alias("shortest"), F.col("m.keep").alias("keep"))


FINGERPRINT_SQL = """
WITH o AS (SELECT DISTINCT fetch_id, url, {c} AS canonical, lower({v})[1:500] AS t FROM {p}),
r AS (SELECT url, canonical, t FROM o UNION SELECT url || '/print', canonical, t FROM o WHERE fetch_id % 10 = 0),
h AS (SELECT url, coalesce(canonical, url) AS keep, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS fingerprint FROM r WHERE url IS NOT NULL)
SELECT fingerprint, count(DISTINCT url) AS n_urls, arg_min(url, (length(url), url)) AS shortest, arg_min(keep, (length(url), url, keep)) AS keep FROM h GROUP BY fingerprint HAVING count(DISTINCT url) > 1
"""


def content_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything about a page's content and meta tags in one row: the columns of the single checks over one scan."""
    cols = dict(_columns())
    wanted = ("title_check", "meta_description", "h1_check", "robots_meta", "og_tags", "twitter_tags", "viewport_charset_lang", "canonical_extract", "word_count", "byline_flags", "link_counts")
    return augmented.pages(spark, sf_dir).withColumn("_words", H.words(F.col("html"))).select("fetch_id", *[c.alias(n) for k in wanted for n, c in cols[k].items()]).distinct()


def _content_sql() -> str:
    texts = dict(_texts())
    wanted = ("title_check", "meta_description", "h1_check", "robots_meta", "og_tags", "twitter_tags", "viewport_charset_lang", "canonical_extract", "word_count", "byline_flags", "link_counts")
    return "SELECT DISTINCT fetch_id, " + ", ".join(f"{e} AS {n}" for k in wanted for n, e in texts[k].items()) + f" FROM {augmented.SQL}"


def registry() -> tuple[dict, dict[str, str]]:
    extra = {
        "duplicate_titles": (duplicate_titles, DUPLICATE_TITLES_SQL.format(t=H.title_sql("html"), p=PAGE_SQL)),
        "json_ld_types": (json_ld_types, JSON_LD_SQL.format(a=augmented.SQL)),
        "anchor_texts": (anchor_texts, ANCHOR_SQL.format(p=PAGE_SQL, pattern=H.q(H.ANCHOR), text=H.trimmed_sql(f"regexp_replace(a, {H.q(H.TAGS)}, '', 'g')"))),
        "term_density": (term_density, TERM_SQL),
        "fingerprint_clusters": (fingerprint_clusters, FINGERPRINT_SQL.format(v=H.visible_sql("html"), c=H.named_sql("html", "link", "rel", "canonical", "href"), p=PAGE_SQL)),
        "content_check": (content_check, _content_sql()),
    }
    texts = {n: "SELECT DISTINCT fetch_id, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {augmented.SQL if n in AUGMENTED else PAGE_SQL}" for n, cols in _texts()}
    return {n: _query(n) for n in texts} | {n: f for n, (f, _) in extra.items()}, texts | {n: s for n, (_, s) in extra.items()}
