"""Pages as numbered text blocks, from streaming standard-library parser events.

``HtmlBlocks`` is an ``html.parser.HTMLParser``: start tags, end tags and text arrive as events
and are folded into blocks on the fly, so memory is bounded by one page.  A page that is plainly written
throughout (nearly all are) is cut at its tags at once and folded by ``plainly`` into the same blocks.

Defined results: NULL or empty html has no blocks; unclosed ``p``/``li``/table cells end where
HTML lets them end; unclosed ``head`` ends at ``body``; character references are decoded; a
block without a visible character isn't numbered.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from html import unescape

#: Tags that vanish inside a block, and elements dropped with their content (fixed by the data contract).
INLINE = frozenset("a abbr b code em i span strong time sup".split())
DROPPED = frozenset("head script style noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that only ever hold one block's text or list entries; a block's container lies above them.
LEAFLIKE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre address figure figcaption button label summary caption center".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_SAME = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

#: What a plainly written page loses before it is cut at its tags: comments, declarations, and scripts and styles with their content.
_GONE = re.compile(r"<!--(?!-?>).*?-->|<!DOCTYPE[^>\[]*>|<(script|style)(?:\s(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)?>.*?</\1\s*>", re.S | re.I)
_TAGS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>\"']*(?:\"[^\"<]*\"[^<>\"']*|'[^'<]*'[^<>\"']*)*)?/?)>")
_SKIPPED = "<script \0>"
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]*)", re.I)
_VISIBLE = re.compile("[^\\s\u00ad\u200b-\u200f\u2060\ufeff]")


class Node:
    """An open or closed element: its parent, tag, raw attributes, and how many blocks and children it had."""

    __slots__ = ("parent", "tag", "raw", "blocks", "kids")

    def __init__(self, parent: "Node | None", tag: str, raw: str) -> None:
        self.parent, self.tag, self.raw, self.blocks, self.kids = parent, tag, raw, 0, 0

    @property
    def cls(self) -> str:
        m = _CLASS.search(self.raw) if self.raw else None
        return m.group(1).lower() if m else ""


class Block:
    """One numbered block: text, text without inline code, its element, linked characters and the tags met since the block before."""

    __slots__ = ("text", "plain", "node", "linked", "tags")

    def __init__(self, text: str, plain: str, node: Node, linked: int, tags: int) -> None:
        self.text, self.plain, self.node, self.linked, self.tags = text, plain, node, linked, tags


def _opened(node: Node, tag: str) -> Node:
    """The element that a start tag's element goes into, after those are closed that HTML lets end there."""
    if tag in ENDS_P:
        while node.tag in _HEADINGS and tag[0] == "h" or node.tag == "p":
            node = node.parent
    elif tag in ENDS_SAME:
        up, stop = node, ENDS_SAME[tag]
        while up.parent is not None and up.tag not in stop:
            if up.tag == tag:
                node = up.parent
                break
            up = up.parent
    node.kids += 1
    return node


class HtmlBlocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node(None, "#root", "")
        self.node = self.root
        self.blocks: list[Block] = []
        self.title: list[str] = []
        self.noscript: list[str] = []
        self.parts: list[str] = []
        self.plain: list[str] = []
        self.drop = ""
        self.in_title = self.in_noscript = False
        self.links = self.codes = self.linked = self.tags = self.coded = 0

    def plainly(self, raw: str) -> bool:
        """Take in a whole page by one cut at its tags, if all of it is plainly written; False, with nothing done, if not."""
        cut = _TAGS.split(_GONE.sub(lambda m: _SKIPPED if m[1] else "", raw))
        texts, tags = cut[0::4], cut[2::4]
        if any("<" in t for t in texts) or "\0" in raw:
            return False
        if any(t.lower() in self.CDATA_CONTENT_ELEMENTS and a != " \0" for t, a in zip(tags, cut[3::4], strict=True)) or any(t.lower() in ("textarea", "plaintext", "xmp", "iframe", "noembed", "noframes") for t in tags):
            return False
        # the events below, folded in one loop over local names
        node, blocks, parts, plain = self.root, self.blocks, self.parts, self.plain
        drop, in_title, in_noscript, links, codes, linked, count, coded = "", False, False, 0, 0, 0, 0, 0
        for slash, tag, attrs, text in zip(["", *cut[1::4]], ["", *tags], ["", *cut[3::4]], texts, strict=True):
            tag = tag.lower()
            if tag:
                count += 1
            if attrs == " \0":
                count += 1
                gone = True
            else:
                gone = False
            if drop:
                if gone:
                    pass
                elif slash:
                    if tag == "title":
                        in_title = False
                    else:
                        if tag == "noscript":
                            in_noscript = False
                        if tag == drop:
                            drop = ""
                elif tag == "title" and drop == "head":
                    in_title = True
                elif drop == "head" and tag == "body":
                    drop, in_title = "", False
                elif tag == "noscript":
                    in_noscript = True
            elif tag in INLINE:
                if tag == "a":
                    links = 0 if slash else 1
                elif tag == "code":
                    codes = max(0, codes - 1) if slash else codes + 1
            elif tag == "title" and slash:
                in_title = False
            elif tag:
                if parts:  # a block ends
                    whole = " ".join("".join(parts).split())
                    if whole and _VISIBLE.search(whole):
                        blocks.append(Block(whole, whole if not coded else " ".join("".join(plain).split()), node, linked, count or 1))
                        node.blocks += 1
                        count = 0
                    parts.clear()
                    linked = 0
                    if coded:
                        plain.clear()
                        coded = 0
                if gone:
                    pass
                elif slash:
                    up = node
                    while up.parent is not None:
                        if up.tag == tag:
                            node = up.parent
                            break
                        up = up.parent
                elif tag in DROPPED:
                    drop, in_noscript = tag, tag == "noscript"
                elif tag == "title":
                    in_title = True
                elif tag not in VOID:
                    node = Node(_opened(node, tag), tag, attrs)
            if text:
                if in_title:
                    self.title.append(unescape(text))
                elif drop:
                    if in_noscript:
                        self.noscript.append(unescape(text))
                elif parts or not text.isspace():
                    if "&" in text:
                        text = unescape(text)
                        if not parts and text.isspace():
                            continue
                    if codes:
                        if not coded:
                            coded = 1
                            plain[:] = parts
                    elif coded:
                        plain.append(text)
                    parts.append(text)
                    if links:
                        linked += len(text)
        self.node, self.linked, self.tags, self.coded = node, linked, count, coded
        return True

    # -- events --------------------------------------------------------------------------------
    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, " ".join(f'{k}="{v or ""}"' for k, v in attrs))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _start(self, tag: str, raw: str) -> None:
        self.tags += 1
        if self.drop:
            if tag == "title" and self.drop == "head":
                self.in_title = True
            elif self.drop == "head" and tag == "body":
                self.drop, self.in_title = "", False
            elif tag == "noscript":
                self.in_noscript = True
            return
        if tag in INLINE:
            if tag == "a":
                self.links = 1
            elif tag == "code":
                self.codes += 1
            return
        self._flush()
        if tag in DROPPED:
            self.drop, self.in_noscript = tag, tag == "noscript"
            return
        if tag == "title":
            self.in_title = True
            return
        if tag in VOID:
            return
        self.node = Node(_opened(self.node, tag), tag, raw)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "title":
            self.in_title = False
            return
        if self.drop:
            if tag == "noscript":
                self.in_noscript = False
            if tag == self.drop:
                self.drop = ""
            return
        if tag in INLINE:
            if tag == "a":
                self.links = 0
            elif tag == "code":
                self.codes = max(0, self.codes - 1)
            return
        self._flush()
        up = self.node
        while up.parent is not None:
            if up.tag == tag:
                self.node = up.parent
                return
            up = up.parent

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif self.drop:
            if self.in_noscript and self.cdata_elem is None:
                self.noscript.append(data)
        elif self.parts or not data.isspace():
            if self.codes:
                if not self.coded:
                    self.coded, self.plain = 1, self.parts.copy()
            elif self.coded:
                self.plain.append(data)
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def _flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text and _VISIBLE.search(text):
            plain = text if not self.coded else " ".join("".join(self.plain).split())
            self.blocks.append(Block(text, plain, self.node, self.linked, self.tags or 1))
            self.node.blocks += 1
            self.tags = 0
        self.parts.clear()
        self.linked = 0
        if self.coded:
            self.plain.clear()
            self.coded = 0


class Page:
    """A parsed page: title, blocks, and the text of ``noscript`` elements."""

    __slots__ = ("title", "blocks", "noscript")

    def __init__(self, html: str | None) -> None:
        self.title, self.blocks, self.noscript = "", [], ""
        if not html:
            return
        p = HtmlBlocks()
        try:
            if not p.plainly(html):
                p.feed(html)
                p.close()
        except (AssertionError, ValueError):  # malformed declarations: keep what came before
            pass
        p._flush()
        self.title = unescape(" ".join("".join(p.title).split()))
        self.noscript = " ".join("".join(p.noscript).split())
        self.blocks = p.blocks
