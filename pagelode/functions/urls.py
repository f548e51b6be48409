"""URL functions as column expressions, with DuckDB text for the oracle.

Addresses are cut by one regular expression into scheme, host, port, path, query and fragment, the same
in both dialects, so unparsable input gives NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import q

SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query parameters a crawl drops, compared in lower case (fixed values that must match).
STRIPPED = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref",
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid",
    "msclkid",
    "hsa_cam", "hsa_grp", "hsa_mt", "hsa_src", "hsa_ad", "hsa_acc", "hsa_net", "hsa_ver", "hsa_la", "hsa_ol", "hsa_kw",
    "mc_cid", "mc_eid", "_ga", "_gl", "_ke", "ref", "ref_src",
    "sid", "sessionid", "session_id", "jsessionid", "phpsessid", "aspsessionid",
    "nocache", "_", "timestamp", "cb",
)
#: Query parameters that canonical addresses are compared without, case-sensitively (fixed values that must match).
CANONICAL_STRIPPED = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid",
    "mc_cid", "mc_eid", "ref", "_ga", "_gl",
    "hsCtaTracking", "hsa_cam", "hsa_grp", "hsa_mt", "hsa_src", "hsa_ad", "hsa_acc", "hsa_net", "hsa_ver", "hsa_kw",
)
#: What counts as a tracking parameter in an address as it stands (fixed values that must match): prefix, then names.
TRACKING = r"^(?:utm_.*|fbclid|gclid|msclkid|ref|_ga|_gl)(?:=|$)"
#: Hosts that must not be fetched (fixed): loopback, private and link-local ranges.
PRIVATE = r"(?i)^(?:localhost|127\..*|10\..*|192\.168\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\..*|\[::1\])$"
#: Addresses a crawl leaves out by default (fixed patterns that must match).
DENY = (
    r"(?i)/(?:search|buscar|suche|recherche)(?:/|$|\?)",
    r"(?i)/(?:tag|tags|category|categories|label|labels)/",
    r"(?i)/(?:page|p)/\d+",
    r"(?i)[?&](?:page|p|pg|offset|start)=\d",
    r"(?i)/(?:calendar|event|events)/\d{4}[/-]\d{2}",
    r"(?i)/(?:login|logout|register|signup|signin|signout|account|my-?account|cart|checkout|wishlist)\b",
    r"(?i)/(?:wp-admin|admin|administrator|cgi-bin)/",
    r"(?i)/(?:feed|rss|atom|xmlrpc)(?:/|$)",
    r"(?i)/(?:print|pdf|share|email|mailto)(?:/|$)",
    r"(?i)\.(?:pdf|zip|gz|tar|rar|exe|dmg|iso|mp3|mp4|avi|mov|wmv|doc|docx|xls|xlsx|ppt|pptx)$",
    r"(?i)[?&](?:sort|order|filter|view|display|limit|lang|currency|size|color)=",
    r"(?i)[?&](?:replytocom|action|preview|doing_wp_cron)=",
)
#: Addresses that look like calendars, and like paging (fixed patterns that must match).
CALENDAR = (r"/\d{4}/\d{2}/\d{2}", r"/\d{4}-\d{2}-\d{2}", r"(?i)/calendar/\d{4}", r"(?i)/events?/\d{4}", r"(?i)[?&]date=\d{4}", r"(?i)[?&]month=\d", r"(?i)[?&]year=\d{4}")
CALENDAR_TAIL = r"/\d{4}[/-]\d{2}(?:[/-]\d{2})?.*$"
PAGING = (r"(?i)/page/\d+", r"(?i)[?&]page=\d+", r"(?i)[?&]p=\d+", r"(?i)[?&]offset=\d+", r"(?i)[?&]start=\d+", r"(?i)/pg/\d+")
PAGE_SUFFIX = r"(?i)/page/[0-9]+/?$"
PAGE_TOKENS = ((r"(?i)[?&]page=[0-9]+", "?page=N"), (r"(?i)/page/[0-9]+", "/page/N"), (r"(?i)[?&]p=[0-9]+", "?p=N"))


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_SEPARATOR = "\x01"


def parts(url: Column) -> Column:
    """[scheme, host, port, path, query, fragment] by one match ("" where absent); one element if url isn't of that shape."""
    return F.split(F.regexp_replace(url, SHAPE, _SEPARATOR.join(f"${i}" for i in range(1, 7))), _SEPARATOR, -1)


def part(url: Column, group: int) -> Column:
    return F.when(url.rlike(SHAPE), F.regexp_extract(url, SHAPE, group))


def part_sql(e: str, group: int) -> str:
    return f"CASE WHEN regexp_matches({e}, {q(SHAPE)}) THEN regexp_extract({e}, {q(SHAPE)}, {group}) END"


def host(url: Column) -> Column:
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def host_sql(e: str) -> str:
    return f"nullif(lower({part_sql(e, 2)}), '')"


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def path_sql(e: str) -> str:
    return f"CASE WHEN {part_sql(e, 4)} = '' THEN '/' ELSE {part_sql(e, 4)} END"


def _origin(p: Column) -> Column:
    """scheme://host[:port] in lower case without the scheme's own port, of ``parts``."""
    scheme, port = F.lower(p[0]), p[2]
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(scheme, F.lit("://"), F.lower(p[1]), F.when(plain, "").otherwise(F.concat(F.lit(":"), port)))


def _web(p: Column) -> Column:
    return (F.size(p) == 6) & F.lower(p[0]).isin("http", "https") & (F.get(p, F.lit(1)) != "")


def _query(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.concat(F.lit("?"), F.array_join(tokens, "&"))).otherwise("")


def _key(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def normalized(url: Column) -> Column:
    """http(s) only; lower host, no default port, no fragment, stripped parameters dropped, the rest sorted, slashes collapsed, no trailing slash.

    Parameters are sorted by name and value as written; percent-encoding is left as it is."""

    def build(p: Column) -> Column:
        kept = F.array_sort(F.filter(F.split(p[4], "&"), lambda x: (x != "") & ~F.lower(_key(x)).isin(*STRIPPED)))
        clean = F.regexp_replace(p[3], "/{2,}", "/")
        clean = F.when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(F.lit("/"))
        return F.when(_web(p), F.concat(_origin(p), clean, _query(kept)))

    return let(parts(url), build)


def normalized_sql(e: str) -> str:
    scheme, port, query, p = f"lower({part_sql(e, 1)})", part_sql(e, 3), f"coalesce({part_sql(e, 5)}, '')", f"regexp_replace({part_sql(e, 4)}, '/{{2,}}', '/', 'g')"
    names = ", ".join(f"'{k}'" for k in STRIPPED)
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({names})))"
    port_text = f"CASE WHEN {port} = '' OR {port} IS NULL OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    clean = f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/$', '') ELSE '/' END"
    return f"CASE WHEN {scheme} IN ('http', 'https') AND {host_sql(e)} IS NOT NULL THEN {scheme} || '://' || {host_sql(e)} || {port_text} || {clean} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def _trimmed_path(path_: Column) -> Column:
    return F.when(path_ == "", "/").when(F.length(path_) > 1, F.coalesce(F.nullif(F.regexp_replace(path_, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path_)


#: Escapes that stay when a path is decoded: those of characters that would change what it means.
_RESERVED = "(?i)%(2F|3F|23|3B|2C|40|26|3D|2B|24|3A)"


def _decoded(path_: Column) -> Column:
    """path_ with its percent-escapes decoded, but for reserved characters; as it is if it can't be."""
    return F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(path_, _RESERVED, "%25$1"), F.lit("+"), F.lit("%2B"))), path_)


def canonical_strict(url: Column) -> Column:
    """Origin in lower case, path without trailing slashes and decoded, query as written, no fragment; what can't be read as an address loses its trailing slashes."""
    raw = F.coalesce(F.nullif(F.regexp_replace(url, "/+$", ""), F.lit("")), url)
    return let(parts(url), lambda p: F.when(_web(p), F.concat(_origin(p), _decoded(_trimmed_path(p[3])), F.when(p[4] == "", "").otherwise(F.concat(F.lit("?"), p[4])))).otherwise(raw))


def canonical_lenient(url: Column) -> Column:
    """As ``canonical_strict``, without CANONICAL_STRIPPED parameters and with the rest sorted."""
    raw = F.coalesce(F.nullif(F.regexp_replace(url, "/+$", ""), F.lit("")), url)

    def build(p: Column) -> Column:
        kept = F.array_sort(F.filter(F.split(p[4], "&"), lambda x: (x != "") & ~_key(x).isin(*CANONICAL_STRIPPED)))
        return F.when(_web(p), F.concat(_origin(p), _decoded(_trimmed_path(p[3])), _query(kept))).otherwise(raw)

    return let(parts(url), build)


def canonical_base(url: Column) -> Column:
    """Origin and path without trailing slashes; NULL for what isn't an address."""
    return let(parts(url), lambda p: F.when(_web(p), F.concat(_origin(p), F.regexp_replace(p[3], "/+$", ""))))


def without_page(url: Column) -> Column:
    """url without page and p parameters and without a /page/N at the path's end."""

    def build(p: Column) -> Column:
        kept = F.filter(F.split(p[4], "&"), lambda x: (x != "") & ~_key(x).isin("page", "p"))
        path_ = F.regexp_replace(p[3], "/page/[0-9]+/?$", "")
        return F.when(_web(p), F.concat(_origin(p), F.when(path_ == "", "/").otherwise(path_), _query(kept), F.when(p[5] == "", "").otherwise(F.concat(F.lit("#"), p[5])))).otherwise(url)

    return let(parts(url), build)


def other_scheme(url: Column) -> Column:
    """The https form of an http address and the other way round; NULL for others."""
    return F.when(url.rlike("(?i)^http://"), F.regexp_replace(url, "(?i)^http://", "https://")).when(url.rlike("(?i)^https://"), F.regexp_replace(url, "(?i)^https://", "http://"))


def category_segment(url: Column) -> Column:
    """The path's segment before the last, its only one, or news."""
    seg = F.filter(F.split(F.coalesce(path(url), F.lit("")), "/"), lambda x: x != "")
    return F.when(F.size(seg) >= 2, F.get(seg, F.size(seg) - 2)).otherwise(F.coalesce(F.get(seg, F.lit(0)), F.lit("news")))


def with_resolved(df: DataFrame, href: str, base: str, out: str) -> DataFrame:
    """href against base: absolute, //host, /path, ?query, #fragment or relative to the base's directory; dot segments removed.

    Done in steps over helper columns: nested in one expression, each part would be worked out many times.
    """
    h, b = F.col(href), F.col(base)
    df = df.withColumn("_origin", F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)).withColumn("_path", path(b))
    joined = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract("_origin", "^([^:]*:)", 1), h))
        .when(h.startswith("/"), F.concat("_origin", h))
        .when(h.startswith("?"), F.concat("_origin", "_path", h))
        .when((h == "") | h.startswith("#"), F.regexp_replace(b, "#.*$", ""))
        .otherwise(F.concat("_origin", F.regexp_replace("_path", "[^/]*$", ""), h))
    )
    df = df.withColumn("_joined", joined)
    dotted = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(/[^?#]*/\.\.?(?:/[^?#]*)?|/\.\.?(?:/[^?#]*)?)([?#].*)?$"
    folded = F.aggregate(
        F.split(F.regexp_extract("_joined", dotted, 2), "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    rebuilt = F.concat(F.regexp_extract("_joined", dotted, 1), F.array_join(folded, "/"), F.regexp_extract("_joined", dotted, 3))
    return df.withColumn(out, F.when(F.col("_joined").rlike(dotted), rebuilt).otherwise(F.col("_joined"))).drop("_origin", "_path", "_joined")


def is_safe(url: Column) -> Column:
    """http(s) and not a private host."""
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & (host(url).isNotNull()) & ~host(url).rlike(PRIVATE), F.lit(False))


def denied(url: Column, deny: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> Column:
    """Whether a crawl leaves url out: no pattern of allow fits (if any is given), or one of deny or of the default list does."""
    hit = F.lit(False)
    for pattern in (*deny, *DENY):
        hit = hit | url.rlike(pattern)
    if allow:
        wanted = F.lit(False)
        for pattern in allow:
            wanted = wanted | url.rlike(pattern)
        hit = ~wanted | hit
    return hit


def any_of(url: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | url.rlike(pattern)
    return hit


def any_of_sql(e: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({e}, {q(p)})" for p in patterns) + ")"


def denied_sql(e: str) -> str:
    return any_of_sql(e, DENY)


def page_token(url: Column) -> Column:
    out = F.when(url.rlike(PAGE_TOKENS[0][0]), PAGE_TOKENS[0][1])
    for pattern, label in PAGE_TOKENS[1:]:
        out = out.when(url.rlike(pattern), label)
    return out


def page_token_sql(e: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, {q(p)}) THEN '{label}'" for p, label in PAGE_TOKENS) + " END"
