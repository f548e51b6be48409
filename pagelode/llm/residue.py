"""Template residue and error pages (problem 1).

Two kinds of evidence, joined per fetch:

* residue: the visible text (title included; code samples, scripts and ``noscript`` beside other
  content excluded) holds a placeholder in some template notation, or filler text;
* message: the page has no body of its own, and shows a message (error, bot gate, need-scripts notice).

Messages are judged as groups.  Every sentence of a bare page, and every sentence of a story page that reads
like a notice, is masked (numbers, dates, addresses, ids, the site's own names) and hashed; sentences of one
hash are one group over all sites.  A group's score is the sum of

* its prior by rules: server output forms and status lines ``FORM_PRIOR``, full phrases ``PHRASE_PRIOR``, mere cue
  words ``CUE_PRIOR``, none of them no candidate;
* how widely it recurs: log2(1 + sites that show it on bare pages);
* less 2 log2(1 + sites that show it on pages with a story), for what is quoted or belongs to the frame;
* less log2(length / ``SHORT``) of longer sentences that aren't server output.

``ENOUGH`` points make it a message.  So a phrase counts on its own, a cue only if it recurs on three sites or
more, and either falls if story pages show the same sentence.  No text is too long to be judged.

Masked sentences are grouped by exact 64-bit hash over all pages; only (hash, site) pairs move, after a
map-side distinct.

Defined results: NULL or empty html is no case; status and flags aren't read; redelivered rows
count once; a NULL url masks no name; clashing extra columns are ignored because only named columns are selected.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, scratch, spread
from .html_events import Page
from .main_content import main_blocks

#: Priors and threshold of the score, in bits, and the length from which a sentence loses.
FORM_PRIOR, PHRASE_PRIOR, CUE_PRIOR, ENOUGH, SHORT = 3.0, 2.0, 1.0, 3.0, 120

_WORD = r"[A-Za-z_][\w]*(?:\s?[._-]?\s?[A-Za-z_]\w*){0,4}"
#: Template notations (fixed forms).
_NOTATIONS = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*[>#/^&!]?\s*" + _WORD + r"[^{}]{0,40}\}\}",
            r"\[\[\s*" + _WORD + r"\s*\]\]",
            r"[$#]\{\s*" + _WORD + r"\s*\}",
            r"\{\$" + _WORD + r"\}",
            r"(?<![\w{$#])\{(?:" + _WORD + r"|\d)\}(?!\})",
            r"<%[=-]?\s*[$\w][^%<>]{0,60}%>",
            r"<\?(?:=|php)?\s*\$?\w[^<>]{0,60}\?>",
            r"<<\s*" + _WORD + r"\s*>>",
            r"\{%\s*\w[^{}%]{0,60}%\}",
            r"\[%\s*\w[^\[\]%]{0,60}%\]",
            r"(?<![\w%])%{1,2}" + _WORD + r"%{1,2}(?![\w%])",
            r"(?<!\w)%\(" + _WORD + r"\)[sdf]\b",
            r"\*\|\s*" + _WORD + r"\s*\|\*",
            r"@@\s*" + _WORD + r"\s*@@",
            r"##\s*" + _WORD + r"\s*##",
            r"(?<!\w)__[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*__(?!\w)",
            r"(?<![\w:]):[A-Za-z]+(?:[_.-][A-Za-z]+)*:(?![\w:])",
            r"<[A-ZÄÖÜÉ][\w-]{2,30}>",
            r"\[\s*(?:INSERT|INSERTAR|EINFÜGEN|INSÉRER)\b[^\]]{0,60}\]",
            r"\[\s*(?:Your|Ihr|Ihre|Votre|Su|Tu)\s[^\]]{1,40}\]",
            r"\[\s*(?:[\w’' ]{0,20}\s)?(?:Name|Nombre|Nom|Title|Titel|Titre|Título|City|Stadt|Ville|Ciudad|Date|Datum|Fecha|Author|Autor|Auteur|Company|Firma|Product|Produkt)(?:\s[\w’' ]{0,30})?\]",
            r"\(\s*(?:insert|insertar|einfügen|insérer)\s[^)]{1,40}\)",
            r"\bTODO\s*:",
            r"\b(?:tbd|tba)(?:\s+(?:tbd|tba)\b)+",
            r"\bXXX+\b[^.]{0,40}\bXXX+\b",
            r"\bundefined\s+undefined\b",
            r"\bNaN\s+\w+",
            r"\bInvalid Date\b",
            r"\[object Object\]",
            r"\b(?:null|none)\s+null\b",
        ]
    )
)
#: Fixed filler sentences and fields left to be written.
_FILLER = re.compile(
    r"type your text here|your (?:\w+ )?(?:headline|text|title|name|content|copy) (?:goes )?here|ihr text hier|votre texte ici|su texto aquí|lorem ipsum dolor|placeholder paragraph|supply the final copy|sample text\. replace|replace this paragraph with|with your own words before going live|^sample text\b|dummy text"
    r"|hier steht ein beispieltext|beispieltext, der|blindtext|platzhaltertext|durch den richtigen inhalt ersetzt|diesen absatz (?:bitte )?ersetzen"
    r"|contenu définitif|faux texte|texte d’exemple|texte de remplissage|(?:titre|texte|nom|date|légende|résumé) à compléter|à remplacer avant"
    r"|texto de relleno|texto de ejemplo|texto provisional|texto de muestra|(?:título|texto|nombre|fecha) (?:pendiente|por completar|por definir)|sustituya este párrafo|contenido definitivo"
    r"|(?:titel|text|name|datum) (?:folgt|ergänzen|einfügen)\b",
    re.I,
)
#: Sentences that talk about such things instead of being them.
_DISCUSSES = re.compile(
    r"placeholder (?:\S+ ){0,3}in the|template engine|in the sample|the sample below|example below|im beispiel|ersetzt die vorlage|den platzhalter|dans l’exemple|le modèle remplace|en el ejemplo|la plantilla sustituye|still fill drafts|fill drafts with"
    r"|\b(?:templates?|vorlagen?|modèles?|plantillas?|placeholders?|platzhalter|syntax|snippet)\b",
    re.I,
)
#: Words of the classical filler passage (fixed).
_LOREM = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing adipisicing eiusmod tempor incididunt labore dolore magna aliqua enim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
_LATIN = re.compile(r"[a-z]+")

#: Server output and status lines (fixed forms).
FORMS = re.compile(
    r"^(?:error|fehler|erreur)(?: #| \d+)?$|^(?:[45]\d\d)(?: [a-z ]+)?$"
    r"|^warning: \w+\(|^fatal error:|^parse error:|sqlstate\[|error establishing a database|traceback \(most recent|\b[\w.]+(?:exception|error) at [\w.]+\(|upstream connect error|\bon line (?:\d+|#)$|stack trace:",
    re.I,
)
_FORM_HINTS = ("warning: ", "fatal error:", "parse error:", "sqlstate[", "traceback (most", "exception at ", "error at ", "upstream connect", "on line ", "stack trace:")
#: Phrases that make a sentence a message of a kind by themselves (fixed, four languages).
PHRASES = {
    "error": (
        r"(?:page|file|resource|url) not found|no longer available\.?$|internal (?:server )?error|service unavailable|bad gateway|gateway time-?out|access denied|^forbidden|down for maintenance"
        r"|seite nicht gefunden|zugriff verweigert|wartungsarbeiten|page introuvable|accès refusé|maintenance en cours|página no encontrada|acceso denegado|^mantenimiento\.?$"
    ),
    "gate": (
        r"just a moment|checking your browser|verify (?:that )?you are (?:a )?human|are you a robot|captcha|browser wird geprüft|ein mensch sind"
        r"|vérification de votre navigateur|n’êtes pas un robot|comprobando su navegador|no es un robot"
    ),
    "scripts": r"(?:enable|requires|turn on|activate) (?:javascript|scripts)|javascript (?:is )?(?:required|disabled)|aktivieren sie javascript|activer javascript|activez javascript|active javascript|habilite javascript",
}
_PHRASE = {k: re.compile(v, re.I) for k, v in PHRASES.items()}
#: One feature needing scripts isn't a page needing them.
_FEATURE = re.compile(r"(?:comments|kommentare|commentaires|comentarios|video|map|karte|carte|mapa)\b[^.]*\.?$", re.I)
#: Words of notices: addressed to the reader, about state, or a reference.  They make a sentence a candidate, no more.
CUES = (
    "error", "fehler", "erreur", "please", "bitte", "veuillez", "por favor", "reload", "retry", "try again", "browser", "navigateur", "navegador", "javascript", "script", "skript",
    "denied", "blocked", "unavailable", "maintenance", "wartung", "exception", "failed", "refused", "timeout", "robot", "human", "captcha", "not find", "nothing here", "removed", "expired",
    "went wrong", "server", "busy", "permission", "berechtigung", "updating", "be back", "security check", "traffic", "verkehr", "tráfico", "trafic", "prüfung", "keinen inhalt", "erreichbar", "verarbeitung",
    "n’existe pas", "no existe", "droit de", "permiso", "rétabli", "traitement", "demande", "petición", "solicitada", "volveremos", "datenverkehr", "anfrage",
)
_CUE = re.compile("|".join(map(re.escape, CUES)), re.I)
_MASKS = (
    (re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|example)\b\S*|(?:/[\w.-]+){2,}"), "@url"),
    (re.compile(r"\b[0-9a-f]{12,}\b"), "@id"),
    (re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\b\d{1,2}:\d{2}(?::\d{2})?\b"), "@date"),
    (re.compile(r"\d+(?:[.,]\d+)*"), "#"),
)


def masked(text: str, names: tuple[str, ...] = ()) -> str:
    """Lower-cased text with addresses, ids, dates, numbers and the given names masked."""
    text = text.lower()
    for name in names:
        text = text.replace(name.lower(), "@name")
    for pattern, mark in _MASKS:
        text = pattern.sub(mark, text)
    return " ".join(text.split())


def _lorem(text: str) -> bool:
    words = _LATIN.findall(text.lower())
    if len(words) < 4:
        return False
    hits = [w for w in words if w in _LOREM]
    return len(set(hits)) >= 4 and len(hits) >= 0.5 * len(words) or len(set(hits)) >= 8


def _in_code(node) -> bool:
    while node is not None:
        if node.tag in ("pre", "textarea", "kbd", "samp", "xmp"):
            return True
        node = node.parent
    return False


_SENTENCES = re.compile(r"(?<=[.!?…])\s+")


def residue_in(text: str) -> bool:
    """Whether text holds a placeholder or filler that it doesn't merely discuss."""
    if _FILLER.search(text) and not _DISCUSSES.search(_FILLER.sub(" ", text)):
        return True
    if _lorem(text):
        return True
    if not _NOTATIONS.search(text):
        return False
    return any(_NOTATIONS.search(s) and not _DISCUSSES.search(_NOTATIONS.sub(" ", s)) for s in _SENTENCES.split(text))


#: What a text with residue holds at least one of, in lower case: single marks, other marks, openings of filler.
_MARKS = ("{", "}", "[", "]", "<", ">")
_PERCENT, _COLONS = re.compile(r"%[\w%(]"), re.compile(r":[A-Za-z][\w.-]*:")
_RESIDUE_HINTS = (
    "@@", "##", "*|", "__", "todo", "tbd", "tba", "xxx", "undefined undefined", "nan ", "invalid date", "null null", "none null", "(insert", "(einf", "(insé",
    "text here", "goes here", "headline here", "title here", "name here", "content here", "copy here", "text hier", "texte ici", "texto aquí", "lorem", "placeholder", "final copy", "sample text", "dummy text", "before going live",
    "beispieltext", "blindtext", "platzhaltertext", "richtigen inhalt", "absatz", "contenu définitif", "faux texte", "texte d’exemple", "remplissage", "à compléter",
    "à remplacer", "relleno", "texto de", "provisional", "pendiente", "por completar", "por definir", "sustituya", "definitivo", "folgt", "ergänzen", "einfügen",
    "ipsum", "consectetur", "adipisc", "eiusmod", "incididunt", "aliqua", "ullamco", "cillum", "pariatur", "nostrud", "fugiat", "laboris",
)


@functools.cache
def _automaton():
    """Aho-Corasick automaton of the hints and cues, each with its class; one pass over a page's text finds them all."""
    words = {word: (word in _RESIDUE_HINTS, word in CUES or word in _FORM_HINTS) for word in {*_RESIDUE_HINTS, *CUES, *_FORM_HINTS}}
    try:
        import ahocorasick
    except ImportError:
        return _OneByOne(words)
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, kind)
    found.make_automaton()
    return found


class _OneByOne:
    """What the automaton finds, word by word, where the library is missing: the same blocks, more slowly."""

    def __init__(self, words: dict[str, tuple[bool, bool]]) -> None:
        self.words = words

    def iter(self, text: str) -> Iterator[tuple[int, tuple[bool, bool]]]:
        for word, kind in self.words.items():
            at = text.find(word)
            while at >= 0:
                yield at + len(word) - 1, kind
                at = text.find(word, at + 1)


def hinted(page: Page) -> tuple[set[int], set[int]]:
    """(blocks that may hold residue, blocks that may hold a message), by number from 0; the title has the number after the last."""
    texts = [b.text for b in page.blocks]
    texts.append(page.title)
    residue: set[int] = set()
    cues: set[int] = set()
    ends = None
    joined = "\n".join(texts)
    for at, (r, c) in _automaton().iter(joined.lower()):
        if ends is None:
            ends = list(itertools.accumulate(len(t.lower()) + 1 for t in texts))
        k = bisect_right(ends, at)
        if r:
            residue.add(k)
        if c:
            cues.add(k)
    if any(m in joined for m in _MARKS) or "%" in joined or _COLONS.search(joined):
        residue |= {k for k, t in enumerate(texts) if any(m in t for m in _MARKS) or "%" in t and _PERCENT.search(t) or ":" in t and _COLONS.search(t)}
    return residue, cues


def has_residue(page: Page, may: set[int] | None = None) -> bool:
    for k in hinted(page)[0] if may is None else may:
        if k == len(page.blocks):
            if residue_in(page.title):
                return True
        elif not _in_code(page.blocks[k].node) and residue_in(page.blocks[k].plain):
            return True
    return False


def prior_of(text: str) -> tuple[str | None, float]:
    """(kind, prior score) of a sentence by the rules; (None, 0) if it is no candidate."""
    if FORMS.search(text):
        return "error", FORM_PRIOR
    long = max(0.0, math.log2(len(text) / SHORT)) if text else 0.0
    for kind, pattern in _PHRASE.items():
        if pattern.search(text):
            return (None, 0.0) if kind == "scripts" and _FEATURE.search(text) else (kind, PHRASE_PRIOR - long)
    if _CUE.search(text) and not _FEATURE.search(text):
        return "recurring", CUE_PRIOR - long
    return None, 0.0


def group_score(prior: float, bare_sites: int, story_sites: int) -> float:
    return prior + math.log2(1 + bare_sites) - 2 * math.log2(1 + story_sites)


def names_of(url: str | None) -> tuple[str, ...]:
    """The site's names as its address has them: the host, and the words of its first label."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", url or "")
    if not m:
        return ()
    host = m[1].lower()
    label = re.sub(r"^(?:www\d?|m|amp|news)\.", "", host).split(".")[0]
    return (host, *sorted((w for w in label.split("-") if len(w) >= 4), key=len, reverse=True))


# -- Spark ---------------------------------------------------------------------------------------
_SCHEMA = "fetch_id bigint, site_id string, bare boolean, residue boolean, texts array<struct<h: bigint, text: string>>"
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def _evidence(page: Page, names: tuple[str, ...] = ()) -> tuple[bool, bool, list[str]]:
    """(without a body of its own, holds residue, masked sentences that may be messages).

    ``noscript`` is read on bare pages that have no teasers either, that is where it stands for the content."""
    bare = not main_blocks(page)
    residue, cues = hinted(page)
    texts: dict[str, None] = {}
    if bare:
        shown = [b.text for b in page.blocks if b.linked < 0.5 * len(b.text)]
        if page.title:
            shown.append(page.title)
        if page.noscript and not any(b.linked >= 0.9 * len(b.text) and b.node.tag in _HEADS for b in page.blocks):
            shown.append(page.noscript)
    else:
        shown = [page.blocks[k].text for k in sorted(cues) if k < len(page.blocks)]
        shown += [b.text for b in page.blocks if b.text[0] in "45" and FORMS.search(b.text)]
    for text in shown:
        for sentence in _SENTENCE.split(text):
            if prior_of(sentence)[0]:
                texts[masked(sentence, names)] = None
    return bare, has_residue(page, residue), list(texts)


_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _evidence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("fetch_id", pa.int64()), ("site_id", pa.string()), ("bare", pa.bool_()), ("residue", pa.bool_()), ("texts", pa.list_(pa.struct([("h", pa.int64()), ("text", pa.string())])))]
    )
    for batch in batches:
        rows = []
        for fetch_id, site_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            bare, residue, texts = _evidence(Page(html.as_py()), names_of(url))
            if residue or texts:
                rows.append({"fetch_id": fetch_id, "site_id": site_id, "bare": bare, "residue": residue, "texts": [{"h": _hash(t), "text": t} for t in texts]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
    for batch in batches:
        out: list[tuple] = []
        for h, text, bare, story in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            kind, prior = prior_of(text)
            if kind and (score := group_score(prior, bare, story)) >= ENOUGH:
                out.append((h, kind, score))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)


def residue_pages(fetches: DataFrame) -> DataFrame:
    """(fetch_id, kind) of every fetch that shows residue or a message in place of content; one row per fetch and kind.

    fetches needs fetch_id, site_id and html, and url if it has one; other columns are ignored.
    """
    url = F.col("url") if "url" in fetches.columns else F.lit(None)
    pages = fetches.select(F.col("fetch_id").cast("bigint"), F.col("site_id").cast("string"), url.cast("string").alias("url"), F.col("html").cast("string")).where("length(html) > 0")
    evidence = scratch(spread(pages).mapInArrow(_evidence_batches, _SCHEMA), "residue")
    texts = evidence.select("fetch_id", "site_id", "bare", F.explode("texts").alias("t")).select("fetch_id", "site_id", "bare", "t.h", "t.text")
    # distinct sites counted in two steps, so that a text shown by very many pages is combined before it moves
    per_site = texts.groupBy("h", "site_id").agg(F.min("text").alias("text"), F.max(F.col("bare").cast("int")).alias("bare"), F.max((~F.col("bare")).cast("int")).alias("story"))
    groups = per_site.groupBy("h").agg(F.min("text").alias("text"), F.sum("bare").cast("bigint").alias("bare_sites"), F.sum("story").cast("bigint").alias("story_sites")).where("bare_sites > 0")
    messages = groups.mapInArrow(_classify, "h bigint, kind string, score double")
    shown = texts.where("bare").select("fetch_id", "h").join(messages, "h").select("fetch_id", "kind")
    return evidence.where("residue").select("fetch_id", F.lit("residue").alias("kind")).unionByName(shown).where("fetch_id is not null").distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_pages(load(spark, sf_dir, "fetch_results")).select("fetch_id").distinct()
