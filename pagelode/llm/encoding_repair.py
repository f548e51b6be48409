"""Text garbled by a wrong character encoding (problem 7).

A multinomial classifier over hashed byte bigrams (of the UTF-8 bytes, around non-ASCII characters) has
classes for clean text, one per script, one per chain "written as R, read as W", and one for garbled text that lost
bytes since.  The clean classes are trained on a bounded sample of the table's own values and on
``READERS``, a public passage in two dozen languages with each script's letters; the chain classes on
synthetic garblings of all of those.  The classifier decides: a stretch that could be the trace of a chain counts if
the chain's class beats the best clean class by ``MARGIN`` on the stretch and its neighbours, and of the chains
that fit, the one with the largest sum of odds is the verdict.  Inversion verifies it: the stretch must decode
strictly, and the decoded text must look cleaner than the garbled one.  What is restored is judged
again until nothing more is found, so garblings of any number of rounds come off.

``SAMPLE`` (documented bound) limits only the labelled values the classifier is fitted on; every value
of the table is judged.

Defined results: NULL and empty values and pure ASCII values without character references are correct;
a value with replacement characters is garbled and not restorable; values whose garbling was escaped
into character references are judged unescaped; a garbled sequence that stands alone beside the very
character it stands for is a citation, not a case; correct text in any script is correct; redelivered rows count once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, spread

SAMPLE = 6_000
DIMS = 1 << 15
#: Log-odds by which a chain must beat clean text, and its inversion the text as it is, where strict decoding
#: alone proves little (single-byte chains).
MARGIN = 1.0
#: Share of each class's probability that is spread evenly over all bigrams.
FLOOR = 0.05
_UTF8_READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-15", "cp1253", "cp1254", "cp1257", "cp852", "cp866", "koi8-r", "iso8859-2")
_BYTES_READ_AS = (
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "cp866"), ("cp1252", "koi8-r"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"),
    ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp1254", "cp1252"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"), ("euc_jp", "latin-1"), ("gbk", "latin-1"), ("gbk", "cp1252"), ("big5", "latin-1"), ("euc_kr", "latin-1"),
)
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", w),) for w in _UTF8_READ_AS),
    *((pair,) for pair in _BYTES_READ_AS),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
)
_REFERENCE = re.compile(r"&#(x[0-9a-fA-F]{1,6}|\d{1,7});")


def chain_name(chain: tuple[tuple[str, str], ...]) -> str:
    return " > ".join(f"{r} as {w}" for r, w in chain)


@functools.cache
def _tables(encoding: str) -> tuple[str, dict[str, int]]:
    """Byte -> character and back; bytes without a character stand for the control of the same number, as readers do."""
    chars = [bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256)]
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def read_as(data: bytes, encoding: str) -> str:
    table = _tables(encoding)[0]
    return "".join([table[b] for b in data])


def back_to_bytes(text: str, encoding: str) -> bytes | None:
    table = _tables(encoding)[1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in chain:
        try:
            text = read_as(text.encode(written), read)
        except UnicodeEncodeError:
            return None
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain; None unless every step decodes strictly."""
    for written, read in reversed(chain):
        data = back_to_bytes(text, read)
        if data is None:
            return None
        try:
            text = data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


def unescaped(value: str) -> str:
    if "&#" not in value:
        return value
    return _REFERENCE.sub(lambda m: chr(n) if (n := int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0], value)


@functools.cache
def _sequences(encoding: str) -> re.Pattern:
    """Well-formed multi-byte UTF-8 sequences as they look when read in the encoding."""
    table = _tables(encoding)[0]
    cls = lambda a, b: "[" + re.escape("".join(table[a : b + 1])) + "]"
    more = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{more}|{cls(0xF0, 0xF4)}{more}{more}{more}")


#: Openings of three-byte sequences whose end got lost, and lone lead characters before what is left of one.
_LOST = re.compile("â€(?![™œžš“”˜¦¢¡°¹º\u0080-¿])|[ÃÂ] |(?<=[a-zà-ÿ])Ã(?=[\\s.,!?])|ï»¿")


def _cited(text: str, start: int, end: int, meant: str) -> bool:
    """Whether text[start:end] stands alone, and so does what it stands for, elsewhere in the text."""

    def alone(a: int, b: int) -> bool:
        return not (a > 0 and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())

    if not alone(start, end):
        return False
    at = text.find(meant)
    while at >= 0:
        if (at + len(meant) <= start or at >= end) and alone(at, at + len(meant)):
            return True
        at = text.find(meant, at + 1)
    return False


def _stretches(text: str, read: str) -> list[tuple[int, int]]:
    """(start, end) of what may be UTF-8 sequences read in an encoding, those that touch joined."""
    out: list[tuple[int, int]] = []
    for m in _sequences(read).finditer(text):
        if out and out[-1][1] == m.start():
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
    return out


# -- classifier ----------------------------------------------------------------------------------
def _bigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the byte bigrams that touch a non-ASCII byte."""
    a, b = data[:-1].astype(np.uint32), data[1:].astype(np.uint32)
    kept = np.flatnonzero((a > 127) | (b > 127))
    return kept, ((a[kept] << 8 | b[kept]) * np.uint32(2654435761)) >> np.uint32(32 - 15)


def features(text: str) -> np.ndarray:
    """Hashed byte bigrams that touch a non-ASCII byte."""
    return _bigrams(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))[1]


#: Article 1 of the Universal Declaration of Human Rights, by script: clean text the table may not have.
READERS: dict[str, tuple[str, ...]] = {
    "western": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
        "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
        "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    ),
    "central": (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "ą ć ę ł ń ó ś ź ż Ą Ć Ę Ł Ń Ó Ś Ź Ż á č ď é ě í ň ó ř š ť ú ů ý ž Č Ď Ě Ň Ř Š Ť Ů Ž ő ű Ő Ű ă â î ș ț ş ţ ğ ı İ zażółć gęślą jaźń Łódź Świąt Żółw příliš žluťoučký kůň",
    ),
    "cyrillic": (
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
        "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ а б в г д е ё ж з и й к л м н о п р с т у ф х ц ч ш щ э ю я ії єґ Привет мир Новый порт Москва Ещё одна съёмка",
    ),
    "greek": (
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
        "αβγδεζηθικλμνξοπρσςτυφχψω ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ ά έ ή ί ό ύ ώ Ά Έ Ή Ί Ό Ύ Ώ ϊ ϋ Η πόλη Αθήνα Θεσσαλονίκη",
    ),
    "hebrew and arabic": (
        "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    ),
    "east asian": (
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
        "カタカナ ひらがな 東京 日本語 新聞 中文 한국어 アイウエオ",
    ),
}
SCRIPTS = tuple(READERS)
#: Letters and signs of the western code pages, each in and beside a word, so that none is unseen.
_LETTERS = " ".join(f"a{c}e {c}n s{c} {c}" for c in map(chr, [*range(0xA1, 0x100), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, *range(0x2013, 0x2016), *range(0x2018, 0x201F), 0x2020, 0x2021, 0x2022, 0x2026, 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122]))


#: Correct words don't mix Latin with Cyrillic or Greek letters: those classes never explain a word with an ASCII letter.
NEVER = -1e6
_ASCII_LETTER = re.compile("[A-Za-z]")


def script_of(word: str) -> int:
    """The clean class a word belongs to, by its first letter beyond ASCII."""
    for c in word:
        n = ord(c)
        if n > 127 and c.isalpha():
            if n < 0x100 or n in (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192):
                continue
            return 1 if n < 0x250 else 3 if 0x370 <= n < 0x400 else 2 if 0x400 <= n < 0x530 else 4 if 0x590 <= n < 0x780 else 5 if n >= 0x1100 else 0
    return 0


def _lossy(text: str) -> Iterator[str]:
    """What is left of garbled text whose controls, no-break blanks or ends of sequences got lost."""
    yield re.sub("[\x80-\x9f\xad]", "", text)
    yield text.replace("\xa0", " ")
    yield re.sub("([\xc2-\xc5\xe2])[^\x00-\x7f]", r"\1", text)
    yield "\xef\xbb\xbf" + text


class ChainModel:
    """Multinomial classifier: a class of clean text per script, one of garbled text with losses, then one per chain."""

    CLEAN = len(SCRIPTS)
    LOSSY = CLEAN
    FIRST = CLEAN + 1

    def __init__(self, log_p: np.ndarray) -> None:
        self.log_p = log_p
        self.most = log_p[: self.CLEAN].max(axis=1)
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, clean: list[str]) -> "ChainModel":
        """clean: values without garbling; each of their words teaches the clean class of its script."""
        texts: list[list[str]] = [list(READERS[s]) for s in SCRIPTS]
        texts[0].append(_LETTERS)
        for value in clean:
            words: dict[int, list[str]] = {}
            for word in value.split(" "):
                if not word.isascii() and ((k := script_of(word)) < 2 or sum(c.isalpha() for c in word) > 1 and not any(c.isascii() and c.isalnum() for c in word)):
                    words.setdefault(k, []).append(word)  # a lone letter of another script, or one among ASCII, may be a trace
            for k, own in words.items():
                texts[k].append(" ".join(own))
        everything = [t for own in texts for t in own]
        counts = np.zeros((cls.FIRST + len(CHAINS), DIMS), np.float64)
        for k, own in enumerate(texts):
            counts[k] = _count(own)
        for i, chain in enumerate(CHAINS):
            bad = [g for t in everything if (g := garble(t, chain)) is not None and g != t]
            counts[cls.FIRST + i] = _count(bad)
            if chain in (CHAINS[0], CHAINS[1]):
                counts[cls.LOSSY] += _count([x for g in bad for x in _lossy(g)])
        # every class gives an unseen bigram the same floor, however much text taught it
        seen = counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))
        return cls(np.log((1 - FLOOR) * seen + FLOOR / DIMS).astype(np.float32))

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods (classes by words) of words that all hold a character beyond ASCII."""
        data = [b" " + w.encode("utf-8", "replace") + b" " for w in words]
        joined = np.frombuffer(b"".join(data), np.uint8)
        kept, hashes = _bigrams(joined)
        starts = np.cumsum([0, *map(len, data[:-1])])
        return np.add.reduceat(self.log_p[:, hashes], np.searchsorted(kept, starts), axis=1)

    def odds_of(self, words: list[str]) -> np.ndarray:
        """Log-odds (by words; lossy class, then chains) against the best clean class, which each word picks for itself."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if fresh:
            if len(self.known) > 20_000:  # words recur; forget all when there are many
                self.known.clear()
                fresh = list(dict.fromkeys(words))
            scores = self.of_words(fresh)
            scores[2:4, [k for k, w in enumerate(fresh) if _ASCII_LETTER.search(w)]] = NEVER
            self.known.update(zip(fresh, (scores[self.CLEAN :] - scores[: self.CLEAN].max(axis=0)).T.copy(), strict=True))
        return np.array([self.known[w] for w in words])

    def odds(self, text: str) -> np.ndarray:
        words = [w for w in text.split(" ") if not w.isascii()]
        return self.odds_of(words).sum(axis=0) if words else np.zeros(len(self.log_p) - self.CLEAN)

    def clean(self, text: str) -> float:
        """Log-likelihood of text as clean text, against the commonest bigram, so that fewer bigrams aren't a gain by themselves."""
        total = 0.0
        for word in text.split(" "):
            if not word.isascii():
                f = features(" " + word + " ")
                each = (self.log_p[: self.CLEAN, f] - self.most[:, None]).sum(axis=1)
                if _ASCII_LETTER.search(word):
                    each[2:4] = NEVER
                total += float(each.max())
        return total


def _count(texts: list[str]) -> np.ndarray:
    """Counts of the features of all texts; blanks between them make no feature."""
    return np.bincount(features(" " + "  ".join(texts) + " "), minlength=DIMS).astype(np.float64) if texts else np.zeros(DIMS)


def judge(value: str, model: ChainModel) -> tuple[str, str | None] | None:
    """(chain, restored text or None) of a garbled value; None for a correct one."""
    text = unescaped(value)
    if text.isascii():
        return None
    if "\ufffd" in text:
        return "lost", None
    verdict = _round(text, model)
    if verdict is None or verdict[1] is None:
        return verdict
    name, text = verdict
    while (again := _round(text, model)) is not None and again[1] is not None and len(again[1]) < len(text):  # a further round
        text = again[1]
    return name, text


def _round(text: str, model: ChainModel) -> tuple[str, str | None] | None:
    """One verdict: of the chains that fit, in stretches or as a whole, the one with the most odds; then chains that fit some words; then losses."""
    cited: list[tuple[int, int]] = []
    meant: set[str] = set()
    fits: dict[int, list[tuple[float, int, int, str]]] = {}
    if _RUN.search(text):  # sequences are two characters at least
        for read in _UTF8_READ_AS:
            for start, end in _stretches(text, read):
                left, right = text[max(0, start - 1) : start], text[end : end + 1]
                here = model.odds(f"{left}{text[start:end]}{right}")
                before = None
                for i in _CHAINS_READ[read]:
                    if here[i + 1] <= MARGIN or (back := invert(text[start:end], CHAINS[i])) is None or back == text[start:end]:
                        continue
                    if _cited(text, start, end, back):
                        cited.append((start, end))
                        meant.add(back)
                        continue
                    before = model.clean(f"{left}{text[start:end]}{right}") if before is None else before
                    if model.clean(f"{left}{back}{right}") > before:
                        fits.setdefault(i, []).append((float(here[i + 1]), start, end, back))
    # byte chains are judged by the words outside citations
    rest = text
    for start, end in cited:
        rest = rest[:start] + " " * (end - start) + rest[end:]
    words = [w for w in rest.split(" ") if not w.isascii() and not any(c in w and len(w) <= len(c) + 2 for c in meant)]
    per_word = model.odds_of(words) if words else np.zeros((0, 1 + len(CHAINS)))
    odds = per_word.sum(axis=0) + PRIOR
    best = max(((sum(f[0] for f in own), -i) for i, own in fits.items()), default=None)
    order = sorted((_BYTE_CHAINS[odds[_BYTE_CHAINS + 1] > MARGIN]).tolist(), key=lambda i: -odds[i + 1])
    before = model.clean(text) if order else 0.0
    for i in order if not cited else ():
        if best is not None and best[0] + PRIOR >= odds[i + 1]:
            break
        whole = invert(text, CHAINS[i])
        if whole is not None and whole != text and model.clean(whole) > before + MARGIN:
            return chain_name(CHAINS[i]), whole
    if best is not None:
        i = -best[1]
        parts, at = [], 0
        for _, start, end, back in fits[i]:
            parts += [text[at:start], back]
            at = end
        whole = invert(text, CHAINS[i]) is not None
        return ("" if whole else "part ") + chain_name(CHAINS[i]), "".join([*parts, text[at:]])
    for i in order:
        changed = {}
        for word, w in zip(words, per_word[:, i + 1], strict=True):
            if w > 0 and (back := invert(word, CHAINS[i])) is not None and back != word and model.clean(back) > model.clean(word) + MARGIN:
                changed[word] = (w, back)
        if changed and sum(w for w, _ in changed.values()) + PRIOR > MARGIN:
            return "part " + chain_name(CHAINS[i]), " ".join(changed[w][1] if w in changed else w for w in text.split(" "))
    if any(0x80 <= ord(c) < 0xA0 for c in text) or any(model.odds(text[max(0, m.start() - 2) : m.end() + 2])[0] > MARGIN for m in _LOST.finditer(text)):
        return "lost", None
    return None


_RUN = re.compile(r"[^\x00-\x7f]{2}")
_CHAINS_READ = {w: [i for i, c in enumerate(CHAINS) if c[-1] == ("utf-8", w)] for w in _UTF8_READ_AS}
_BYTE_CHAINS = np.array([i for i, c in enumerate(CHAINS) if c[-1][0] != "utf-8"])
#: Log-odds of one chain against clean text before a value is seen: one value in ten garbled, all chains alike.
PRIOR = float(np.log(0.1 / len(CHAINS) / 0.9))


# -- Spark ---------------------------------------------------------------------------------------
def _values(meta: DataFrame) -> DataFrame:
    """(meta_id, field_name, value) of the values that could be garbled at all."""
    rows = meta.select(F.col("meta_id").cast("bigint"), F.expr("stack(2, 'title', cast(title as string), 'description', cast(description as string)) as (field_name, value)"))
    return rows.where("meta_id is not null and value rlike '[^\\\\x00-\\\\x7F]|&#'")


def fit_on(meta: DataFrame, sample: int = SAMPLE) -> ChainModel:
    """A model fitted on at most ``sample`` values without any garbled sequence, chosen by hash."""
    rows = _values(meta).where("value not like '%&#%' and value not like '%�%'")
    picked = rows.select("value", F.xxhash64("meta_id", "field_name").alias("h")).orderBy("h", "value").limit(sample).collect()
    return ChainModel.fit([r.value for r in picked if not _suspect(r.value)])


def _suspect(value: str) -> bool:
    """Whether a value holds a sequence that decodes to a letter or sign, or a control: no example of clean text."""
    if any(0x80 <= ord(c) < 0xA0 for c in value):
        return True
    for read in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
        for start, end in _stretches(value, read):
            back = invert(value[start:end], (("utf-8", read),))
            if back is not None and all(unicodedata.category(c)[0] in "LPSZ" and ord(c) < 0x2600 for c in back):
                return True
    return False


def garbled_values(meta: DataFrame) -> DataFrame:
    """(meta_id, field_name, chain, restored): every garbled value, the chain found, and the text restored where possible."""
    spark = meta.sparkSession
    shared = spark.sparkContext.broadcast(fit_on(meta))  # a few dozen classes by DIMS floats, whatever the table's size
    schema = pa.schema([("meta_id", pa.int64()), ("field_name", pa.string()), ("chain", pa.string()), ("restored", pa.string())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            cols: list[list] = [[], [], [], []]
            for meta_id, field, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                verdict = judge(value, model)
                if verdict:
                    for col, x in zip(cols, (meta_id, field, *verdict), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return spread(_values(meta)).mapInArrow(batches, "meta_id bigint, field_name string, chain string, restored string").dropDuplicates(["meta_id", "field_name"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_values(load(spark, sf_dir, "content_meta")).select("meta_id", "field_name")


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_values(load(spark, sf_dir, "content_meta"))
