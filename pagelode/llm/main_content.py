"""Main body of web pages (problem 4): text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Every block is a line.  Its text-to-tag ratio is smoothed with a Gaussian over the lines around
it; two-means clustering of the smoothed ratios gives the page's own threshold; lines above it
are content.  The clusters choose the region: a container's mass is the sum of the smoothed ratios of
its content lines, and the container of the greatest mass is the page's story if that mass is
``CLEAR`` or more, and none if it is under ``FAINT``.  Only between the two are the wording and
sentence rules asked.  Within the region a line whose own ratio is ``CORE`` times the threshold is content
as it stands; the lists of furniture (by-lines, tool labels, advert labels, credits, letter sign-ups,
pointers to other stories) decide ties: lines of lower ratio, which come back in (headline, short
subheadings, list entries) unless they are furniture by form or wording.

The numbers below are parameters of the method; all are in characters, or characters per tag.

Defined results: NULL or empty html, overview pages (link-headed teasers only) and pages whose
densest container is faint have no main body; very long texts are processed whole;
redelivered rows count once; columns other than the ones named are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread
from .html_events import LEAFLIKE, Block, Node, Page

SIGMA = 1.0
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-2, 3)]
_WHOLE = sum(_KERNEL)

#: Fixed wordings of furniture inside a story's own container, per language.
AD_LABELS = frozenset(
    "advertisement|advert|ad|sponsored content|sponsored|anzeige|werbung|publicité|annonce|contenu sponsorisé|publicidad|anuncio|contenido patrocinado|gesponsert|gesponserter inhalt".split("|")
)
TOOL_LABELS = frozenset(
    "print|copy link|share this page|share|send by mail|save for later|drucken|link kopieren|seite teilen|teilen|per mail senden|merken|imprimer|copier le lien|partager|envoyer par courriel|garder pour plus tard|imprimir|copiar enlace|compartir|enviar por correo|guardar".split("|")
)
POINTER_HEADS = (
    "read also", "most read", "most read today", "more from this section", "you may also like", "see also", "related",
    "lesen sie auch", "meistgelesen", "mehr aus dem ressort", "das könnte sie auch interessieren",
    "à lire aussi", "à lire", "les plus lus", "dans la même rubrique", "sur le même sujet",
    "lea también", "lo más leído", "más de esta sección", "también le puede interesar",
)
_POINTER = re.compile(rf"(?:{'|'.join(map(re.escape, POINTER_HEADS))})\s*(?::|$)", re.I)
_LETTER = (
    "our letter every morning", "receive the weekend edition", "sign up now", "newsletter", "unser brief kommt", "wochenendausgabe", "recevez notre lettre",
    "l’édition du week-end", "inscrivez-vous", "reciba nuestra carta", "edición de fin de semana", "apúntese",
)
_BYLINE = re.compile(r"(?:by|von|par|por|text|texte|texto|author|autor|auteur)\b\s*:?\s*[A-ZÀ-Þ]", re.I)
_UPDATED = re.compile(r"·\s*(?:updated|aktualisiert|mis à jour|actualizado|published|veröffentlicht|publié|publicado)\b", re.I)
_CREDIT = re.compile(r"(?:photo|foto|image|bild|picture|imagen|graphic|grafik|video)\s*:", re.I)
_COMMENT = re.compile(r"(?:comments|kommentare|commentaires|comentarios)\s*\(\d+\)$", re.I)
_FRAME = (
    "cookie", "store small files", "kleine dateien", "petits fichiers", "pequeños archivos", "©", "rights reserved", "rechte vorbehalten", "droits réservés", "derechos reservados",
    "not responsible for the content", "keine haftung für", "décline toute responsabilité", "no responde del contenido", "sign in to write", "log in to write", "sign in to comment",
    "bitte anmelden", "pour commenter", "para comentar", "javascript to view", "kommentare zu sehen", "voir les commentaires", "ver los comentarios",
)
_SENTENCE_END = re.compile(r"[.!?…][\"”»’')\]]*(?:\s|$)")
_NAME = re.compile(r"[A-ZÀ-Þ][\w’'-]*(?: [A-ZÀ-Þ][\w’'-]*){1,3}$")
#: Mass of a container (sum of the smoothed ratios of its content lines) that makes it a story outright, and below which it is none.
CLEAR, FAINT = 300.0, 80.0
#: A line whose own ratio is so many times the threshold is content whatever it says.
CORE = 3.5
#: Between faint and clear: least characters and sentences of running text that make a container a story.
LEAST_CHARS, LEAST_SENTENCES = 220, 2
#: Longest text of a letter sign-up or pointer, of a by-line, of a credit, of a frame notice, and of a tool's label (with its words).
NOTE, BYLINE, CREDIT, NOTICE, LABEL, LABEL_WORDS = 200, 90, 80, 300, 28, 4


def line_ratios(blocks: list[Block]) -> list[float]:
    """Text-to-tag ratio of each line; linked characters don't count as text."""
    return [max(0, len(b.text) - b.linked) / b.tags for b in blocks]


def smoothed(raw: list[float]) -> list[float]:
    """The ratios under a Gaussian window of five lines, cut off at the page's ends."""
    n = len(raw)
    k1, k2 = _KERNEL[1], _KERNEL[0]
    pad = [0.0, 0.0, *raw, 0.0, 0.0]
    out = [(c + k1 * (b + d) + k2 * (a + e)) / _WHOLE for a, b, c, d, e in zip(pad, pad[1:], pad[2:], pad[3:], pad[4:], strict=False)]
    for i in {*range(min(2, n)), *range(max(0, n - 2), n)}:  # fewer neighbours, less weight
        out[i] *= _WHOLE / sum(_KERNEL[k + 2] for k in range(-2, 3) if 0 <= i + k < n)
    return out


def two_means(values: list[float]) -> float:
    """The threshold between the two clusters of values: halfway between their means."""
    ordered = sorted(values)
    sums, total = [0.0], 0.0
    for v in ordered:
        total += v
        sums.append(total)
    n, low, high = len(ordered), ordered[0], ordered[-1]
    for _ in range(20):
        cut = (low + high) / 2
        at = bisect_right(ordered, cut)
        if at == n:
            return cut
        new = sums[at] / at, (total - sums[at]) / (n - at)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def container_of(node: Node) -> Node:
    """The nearest element that may hold several blocks; an element with one block of its own and no children is a line."""
    while node.parent is not None and (node.tag in LEAFLIKE or (node.blocks <= 1 and node.kids == 0)):
        node = node.parent
    return node


def _sentences(text: str) -> int:
    return len(_SENTENCE_END.findall(text))


def _furniture(b: Block, after_head: int) -> bool:
    """after_head: lines since the headline, 0 at and before it."""
    text, tag = b.text, b.node.tag
    if tag in ("figcaption", "button", "label", "caption", "address"):
        return True
    if len(text) >= NOTE:
        return False
    low = text.lower()
    if low in AD_LABELS or low in TOOL_LABELS or any(k in low for k in _LETTER) or _COMMENT.search(text) or _POINTER.match(text):
        return True
    if len(text) < CREDIT and _CREDIT.match(text):
        return True
    if 0 < after_head <= 3 and len(text) < BYLINE and tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "li") and not _SENTENCE_END.search(text):
        if _UPDATED.search(text) or _BYLINE.match(text) or _NAME.match(text):
            return True
    return False


def main_blocks(page: Page) -> list[int]:
    """Numbers (from 1) of the main-body blocks; empty if the page has no story of its own."""
    blocks = page.blocks
    if not blocks:
        return []
    raw = line_ratios(blocks)
    ratios = smoothed(raw)
    cut = two_means(ratios)
    mass: dict[int, float] = {}
    of: dict[int, list[int]] = {}
    home_of: dict[int, Node] = {}  # by element, as its lines mostly follow one another
    homes: dict[int, Node] = {}
    for i, b in enumerate(blocks):
        node = b.node
        home = home_of.get(id(node))
        if home is None:
            home = home_of[id(node)] = container_of(node)
        key = id(home)
        homes[key] = home
        of.setdefault(key, []).append(i)
        if ratios[i] > cut:
            mass[key] = mass.get(key, 0.0) + ratios[i]
    for key in sorted(mass, key=mass.get, reverse=True):
        if mass[key] < FAINT:
            break
        rows = of[key]
        if mass[key] < CLEAR and not _is_story(blocks, rows):
            continue
        rows = _region(blocks, key, homes, of, mass, raw, ratios, cut)
        opening = next((i for i in rows if raw[i] > cut and _sentences(blocks[i].text)), rows[0])
        first = next((i for i in rows if i <= opening and (blocks[i].node.tag in ("h1", "h2") or "headline" in blocks[i].node.cls)), rows[0])
        kept = [i for i in rows if i >= first and (raw[i] > CORE * cut and ratios[i] > cut or not _furniture(blocks[i], i - first))]
        kept = _without_tool_lists(blocks, kept)
        if sum(_sentences(blocks[i].text) for i in kept) >= LEAST_SENTENCES:
            return [i + 1 for i in kept]
    return []


def _region(blocks: list[Block], key: int, homes: dict[int, Node], of: dict[int, list[int]], mass: dict[int, float], raw: list[float], ratios: list[float], cut: float) -> list[int]:
    """Lines of the story's container and of the parts set beside or inside it: containers of the same parent, or
    whose parent is the container, that aren't headed by a link, and whose content lines lie above the
    threshold by their own ratios.  A headline in an element of its own right before joins them."""
    home, rows = homes[key], of[key]
    for other, its in of.items():
        near = homes[other]
        if other == key or other not in mass or near.parent is not home and (near.parent is not home.parent or home.parent.tag in ("body", "html", "#root")):
            continue
        top = [raw[i] for i in its if ratios[i] > cut]
        head = blocks[its[0]]
        if sum(top) > cut * len(top) and head.linked < 0.9 * len(head.text) and any(_sentences(blocks[i].text) for i in its):
            rows = sorted(rows + its)
    before = rows[0] - 1
    if before >= 0 and blocks[before].node.tag in ("h1", "h2") and blocks[rows[0]].node.tag not in ("h1", "h2") and "headline" not in blocks[rows[0]].node.cls:
        up = blocks[before].node.parent
        while up is not None and up is not home and up is not home.parent:
            up = up.parent
        if up is not None and up.tag not in ("body", "html", "#root"):
            rows = [before, *rows]
    return rows


def _is_story(blocks: list[Block], rows: list[int]) -> bool:
    """The rules for a container between faint and clear."""
    head = blocks[rows[0]]
    if head.linked >= 0.9 * len(head.text) and len(rows) <= 4:  # a teaser: its heading is a link
        return False
    chars = sentences = 0
    for i in rows:
        b = blocks[i]
        n = _sentences(b.text) if b.linked < 0.5 * len(b.text) else 0
        if n and not _furniture(b, 0) and not (len(b.text) < NOTICE and _framing(b.text)):
            chars, sentences = chars + len(b.text), sentences + n
            if chars >= LEAST_CHARS and sentences >= LEAST_SENTENCES:
                return True
    return False


def _framing(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in _FRAME)


def _without_tool_lists(blocks: list[Block], kept: list[int]) -> list[int]:
    """Lists whose entries are all bare labels (no sentence, few words) are tools or menus."""
    lists: dict[int, list[int]] = {}
    for i in kept:
        if blocks[i].node.tag == "li":
            lists.setdefault(id(blocks[i].node.parent), []).append(i)
    bare = {i for rows in lists.values() if all(len(blocks[i].text) <= LABEL and len(blocks[i].text.split()) <= LABEL_WORDS for i in rows) for i in rows}
    return [i for i in kept if i not in bare]


# -- Spark ---------------------------------------------------------------------------------------
def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .residue import has_residue

    schema = pa.schema([("fetch_id", pa.int64()), ("blocks", pa.list_(pa.int32()))])
    for batch in batches:
        ids, rows = [], []
        for fetch_id, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(html.as_py())
            main = main_blocks(page)
            if main and not has_residue(page):
                ids.append(fetch_id)
                rows.append(main)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], schema=schema)


def main_body_blocks(fetches: DataFrame) -> DataFrame:
    """(fetch_id, block_no) of the main-body blocks.  A page with an error or gate in place of content is too bare
    to have a body; pages with template residue are left out.  Map-only but for dropping redelivered rows,
    which moves one small array per page."""
    pages = fetches.select(F.col("fetch_id").cast("bigint"), F.col("html").cast("string")).where("length(html) > 0 and fetch_id is not null")
    per_page = spread(pages).mapInArrow(_numbers, "fetch_id bigint, blocks array<int>").dropDuplicates(["fetch_id"])
    return per_page.select("fetch_id", F.explode("blocks").alias("block_no"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body_blocks(load(spark, sf_dir, "fetch_results"))
