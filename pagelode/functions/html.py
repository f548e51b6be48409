"""HTML extractors as column expressions, each with its DuckDB text for the oracle.

Everything stays inside the JVM: tags come out as arrays of attribute strings, attributes by regular
expressions on those.  Patterns are shared by both dialects and keep to what both support.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f]"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
STYLE_SCRIPT = r"(?is)<s(?:cript[^>]*>.*?</script>|tyle[^>]*>.*?</style>)"
TAGS = r"<[^>]+>"
QUOTED_HREF = r"(?i)<a[ \t\r\n\f][^>]*href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']([^\"'#]*)[\"']"
ANCHOR = r"(?is)<a(?:[ \t\r\n\f][^>]*)?>(.*?)</a>"
CHARSET = r"(?i)<meta[^>]*charset=[\"']?([^\"' \t\r\n\f>]+)"
HTTP_EQUIV = r"(?i)<meta[^>]*http-equiv=[\"']content-type[\"'][^>]*content=[\"'][^\"']*charset=([^\"' \t\r\n\f;]+)"
IMG = r"(?i)<img\b[^>]*>"


def q(pattern: str) -> str:
    """A pattern as a SQL string of DuckDB."""
    return "'" + pattern.replace("'", "''") + "'"


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def trimmed_sql(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def tag_pattern(tag: str) -> str:
    return rf"(?i)<{tag}\b([^>]*)>"


def tags(html: Column, tag: str) -> Column:
    """Attribute strings of all tags of a name."""
    return F.regexp_extract_all(html, F.lit(tag_pattern(tag)), F.lit(1))


def tags_sql(e: str, tag: str) -> str:
    return f"regexp_extract_all({e}, {q(tag_pattern(tag))}, 1)"


def _attr_patterns(name: str) -> tuple[str, str, str]:
    head = rf"(?i)\b{name}{WS}*={WS}*"
    return head + r'"([^"]*)"', head + r"'([^']*)'", head + r"([^ \t\r\n\f\"'>]+)"


def attr(attrs: Column, name: str) -> Column:
    """Value of an attribute, double-quoted, single-quoted or bare; NULL if absent or empty."""
    return F.coalesce(*[F.nullif(trimmed(extract(attrs, p)), F.lit("")) for p in _attr_patterns(name)])


def attr_sql(e: str, name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({trimmed_sql(f'regexp_extract({e}, {q(p)}, 1)')}, '')" for p in _attr_patterns(name)) + ")"


def title(html: Column) -> Column:
    """First title, trimmed; NULL if there is no title element."""
    return F.when(html.rlike(TITLE), trimmed(extract(html, TITLE)))


def title_sql(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, {q(TITLE)}) THEN {trimmed_sql(f'regexp_extract({e}, {q(TITLE)}, 1)')} END"


def named(html: Column, tag: str, key: str, value: str, out: str) -> Column:
    """Attribute ``out`` of the first tag whose attribute ``key`` equals ``value``, case-insensitively."""
    hit = F.get(F.filter(tags(html, tag), lambda a: F.lower(attr(a, key)) == value), 0)
    return attr(hit, out)


def named_sql(e: str, tag: str, key: str, value: str, out: str) -> str:
    return attr_sql(f"list_filter({tags_sql(e, tag)}, lambda a: lower({attr_sql('a', key)}) = '{value}')[1]", out)


def last_named(html: Column, tag: str, key: str, value: str, out: str) -> Column:
    hits = F.filter(tags(html, tag), lambda a: (F.lower(attr(a, key)) == value) & attr(a, out).isNotNull())
    return attr(F.try_element_at(hits, F.lit(-1)), out)


def last_named_sql(e: str, tag: str, key: str, value: str, out: str) -> str:
    return attr_sql(f"list_filter({tags_sql(e, tag)}, lambda a: lower({attr_sql('a', key)}) = '{value}' AND {attr_sql('a', out)} IS NOT NULL)[-1]", out)


def inner_texts(html: Column, tag: str) -> Column:
    """Texts of all elements of a name, inner tags removed, trimmed."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: trimmed(F.regexp_replace(x, TAGS, "")))


def inner_texts_sql(e: str, tag: str) -> str:
    inner = trimmed_sql(f"regexp_replace(x, {q(TAGS)}, '', 'g')")
    pattern = q(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")
    return f"list_transform(regexp_extract_all({e}, {pattern}, 1), lambda x: {inner})"


def visible(html: Column) -> Column:
    """Text without scripts, styles and tags, blanks collapsed."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, STYLE_SCRIPT, " "), TAGS, " "), rf"{WS}{{2,}}|[\t\r\n\f]", " "))


def visible_sql(e: str) -> str:
    step = f"regexp_replace(regexp_replace({e}, {q(STYLE_SCRIPT)}, ' ', 'g'), {q(TAGS)}, ' ', 'g')"
    return trimmed_sql(f"regexp_replace({step}, {q(WS + '+')}, ' ', 'g')")


def words(html: Column) -> Column:
    return F.filter(F.split(visible(html), " "), lambda w: w != "")


def words_sql(e: str) -> str:
    return f"list_filter(string_split({visible_sql(e)}, ' '), lambda w: w <> '')"
