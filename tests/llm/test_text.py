import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from pagelode.llm import encoding_repair as E
from pagelode.llm import leakage, mixing, truncation


# -- encoding ------------------------------------------------------------------------------------
CLEAN = ["Café – Größe: naïve «été» für die Bücherei", "La coopérative a présenté l’été à Zoë", "El jardín detrás de la estación reparó 3 años", "Straße “Quiet” – Müller über Öffnung", "Ærøby – The town", "X | Новый порт", "Y – Η πόλη", "SÃO TELMO: Z"] * 30


def test_chains_invert():
    text = "Größe – été ñ “x” €"
    for chain in E.CHAINS:
        bad = E.garble(text, chain)
        if bad is not None and bad != text:
            assert E.invert(bad, chain) == text, chain


def test_judge():
    model = E.ChainModel.fit(CLEAN)
    for text in ["Die Bücherei am Hügel – Größe", "Un été à la bibliothèque", "El coro celebró el túnel"]:
        for chain in E.CHAINS:
            bad = E.garble(text, chain)
            if bad is not None and bad != text and chain[0][0] == "utf-8" and len(chain) == 1:
                assert E.judge(bad, model) is not None, (chain, bad)
    assert E.judge("Die BÃ¼cherei", model)[1] == "Die Bücherei"
    assert E.judge("Das Museumscafй prьfte", model)[1] == "Das Museumscafé prüfte"
    assert E.judge("f&#195;&#188;r", model)[1] == "für"
    assert E.judge("M�s", model) == ("lost", None)
    for good in [*CLEAN, "Got Ã± instead of ñ? Check the charset", "Why “ä” turns into “Ã¤” in page titles", "Â & Ã: x", "plain", ""]:
        assert E.judge(good, model) is None, good


def test_garbled_rows(spark):
    data = [(1, "FÃ¼r", None, "x"), (1, "FÃ¼r", None, "x"), (2, "Für", "", "x"), (3, None, "cafÃ© â€“ x", "x"), (None, "FÃ¼r", None, "x")] + [(10 + i, t, None, "x") for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(data, "meta_id bigint, title string, description string, chain string")
    assert [r[:2] for r in rows(E.garbled_values(df))] == [(1, "title"), (3, "description")]
    assert rows(E.garbled_values(df.limit(0))) == []


# -- leakage -------------------------------------------------------------------------------------
def edit(pattern, text):
    best = prev = list(range(len(pattern) + 1))
    low = prev[-1]
    for c in text:
        cur = [0]
        for i, p in enumerate(pattern):
            cur.append(min(prev[i] + (p != c), prev[i + 1] + 1, cur[i] + 1))
        prev, low = cur, min(low, cur[-1])
    return low if best else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=30))
def test_myers(pattern, text):
    assert leakage.myers_distance(pattern, text) == edit(pattern, text)


def test_leaks(spark):
    item = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(item), "x"), (2, "too short", "x"), (3, None, "x")], "item_id bigint, passage string, doc_id string")
    texts = {i: "Intro " + " ".join(item[s : s + 12]) + " end" for i, s in enumerate(range(19))}
    texts |= {100: " ".join(item[3:14]), 101: "<b>" + "</b>, <i>".join(item[5:17]).upper(), 102: " ".join(item[:6]) + " x " + " ".join(item[6:14]), 103: "long " * 50_000 + " ".join(item), 104: None, 105: "", 106: " "}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id bigint, text string")
    assert rows(leakage.leaks(docs, items)) == [(i, 1, 0) for i in sorted({*range(19), 101, 103})]
    assert rows(leakage.leaks(docs.limit(0), items)) == [] and rows(leakage.leaks(docs, items.limit(0))) == []


def test_piece_width():
    for run in (6, 12, 13, 24):
        for budget in range(4):
            if run >= budget + 1:
                p = leakage.piece_width(run, budget)
                # any run of words, wherever it starts, holds budget+1 pieces of the grid
                assert min(sum(1 for k in range(0, 200, p) if s <= k and k + p <= s + run) for s in range(60)) >= budget + 1


def test_edited_leaks(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(25)]
    passages = {i: [rng.choice(vocab) for _ in range(rng.randint(10, 20))] for i in range(12)}
    docs = {}
    for d in range(120):
        words = list(passages[rng.randrange(12)])
        cut = rng.randint(0, 3)
        words = words[cut : cut + rng.randint(9, 16)]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [rng.choice([*vocab, "new"])] * rng.randint(0, 1)
        docs[d] = ["x"] * rng.randint(0, 3) + words + ["y"] * rng.randint(0, 3)
    want = {}
    for d, words in docs.items():
        for i, p in passages.items():
            for s in range(len(p) - leakage.RUN + 1):
                e = edit(p[s : s + leakage.RUN], words)
                if e <= leakage.EDITS:
                    want[d, i] = min(e, want.get((d, i), e))
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in passages.items()], "item_id bigint, passage string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.errors for r in leakage.leaks(frame, items, leakage.EDITS).collect()}
    assert got == want and {0, 1, 2} == set(want.values())
    exact = {(r.doc_id, r.item_id) for r in leakage.leaks(frame, items).collect()}
    assert exact == {k for k, e in want.items() if e == 0}
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 40)  # in blocks
    assert {(r.doc_id, r.item_id): r.errors for r in leakage.leaks(frame, items, leakage.EDITS).collect()} == want


def test_distance_decides(monkeypatch):
    words = [f"w{i}" for i in range(30)]
    near = words[:6] + ["x"] + words[6:30]  # a whole piece, but no run of twelve before the change
    passages = leakage.Passages([(1, " ".join(words[:14]))])
    hashes = leakage.window_hashes(np.array([leakage.WordHashes()[w] for w in near], np.uint64), passages.piece)
    assert passages.leaked(near, hashes) == {}
    monkeypatch.setattr(leakage, "myers_distance", lambda pattern, text: 0)
    assert passages.leaked(near, hashes) == {1: 0}


# -- mixing --------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 600))
def test_fit(hist, budget):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    take = mixing.fit(lengths, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    reach = {0}
    for n, c in hist.items():
        reach = {s + n * k for s in reach for k in range(c + 1)}
    got = int((take * lengths).sum())
    assert got <= budget
    if budget < mixing.KNAPSACK_ROOM * max(hist):
        assert got == max(s for s in reach if s <= budget)


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma delta"]) for _ in range(rng.randint(1, 30))), s) for i, s in enumerate(["A-b"] * 40 + ["a_b "] * 40 + ["c"] * 20 + [None] * 5 + ["other"] * 5)]
    docs += [(900, None, "c"), (901, "  ", "c"), (0, docs[0][1], docs[0][2])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("a_b", 0.5, 2), ("C", 0.4, 3), ("none", 0.1, 2), (None, 0.2, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    taken, shares = mixing.mix(d, t)
    got = taken.collect()
    assert {r.source for r in got} == {"a_b", "c"} and len({r.doc_id for r in got}) == len(got)
    assert max(r.times for r in got if r.source == "c") <= 3 and max(r.times for r in got if r.source == "a_b") <= 2
    share = {r.source: r for r in shares.collect()}
    total = sum(r.tokens * r.times for r in got)
    for s, goal in (("a_b", 5 / 9), ("c", 4 / 9)):
        used = sum(r.tokens * r.times for r in got if r.source == s)
        assert used == share[s].used_tokens == share[s].budget_tokens and math.isclose(used / total, goal, abs_tol=0.002)
    assert share["none"].actual_share == 0
    assert mixing.mix(d.limit(0), t)[0].count() == 0


def test_vocabulary_is_served(spark, tmp_path):
    import shutil

    from pagelode.llm import tokens

    here = str(tmp_path / "served.tiktoken")
    shutil.copy(tokens.VOCABULARY, here)
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "i int, t string")
    assert rows(tokens.with_token_counts(df, "t", "n", here)) == [(1, 2), (2, 0), (3, 0)]
    served = tokens._at_worker("/not/here/served.tiktoken")  # where a worker without the path looks
    assert open(served, "rb").read() == open(here, "rb").read()


# -- truncation ----------------------------------------------------------------------------------
def test_binomial_tail():
    for n, p in ((10, 0.3), (40, 0.05), (5, 0.9)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
            assert math.isclose(truncation.binomial_tail(k, n, p), want, rel_tol=1e-9)


def test_endings(spark):
    cases = {
        "A sentence.": "complete", "A sentence.”": "complete", "<p>Fine.</p>": "complete", "One. Two and thr": "running", "One. Two and…": "marked", "One. Two and [...]": "marked", "One. Two a [more]": "marked",
        "One. Two.  ": "complete", "Text. <b": "broken", "Text &amp": "broken", "Intro.\n- item without stop": "form", "Intro.\nTags: a, b, c": "form", "Intro.\n— Ann Lee, Paper": "form", "Intro.\nhttps://e.example/a/1": "form",
        "Intro.\nDisallow: /x": "form", "One. Two thr\"": "marked", 'He said "yes."': "complete", "Done. [...]": "complete", "12345": "form", "short words": "open", "x" * 100_000 + " one two three": "running",
    }
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(cases)] + [(900, None, "s", 0), (901, " \n", "s", 0), (0, "A sentence.", "s", 0)], "doc_id bigint, text string, source string, chars int")
    got = {r.doc_id: r.kind for r in truncation.endings(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_limits(spark):
    rng = random.Random(3)
    docs = [(i, "w" * (rng.randint(60, 400) - 1) + ".", "a") for i in range(800)] + [(1000 + i, ("two words " * 30)[:200].rstrip() + "x" * (200 - len(("two words " * 30)[:200].rstrip())), "A ") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    flagged, limits = truncation.cut_documents(df)
    assert {(r.unit, r.length) for r in limits.collect()} == {("chars", 200), ("bytes", 200)}
    assert {r.doc_id for r in flagged.where("cut").collect()} == set(range(1000, 1060))
    assert truncation.cut_documents(df.limit(0))[0].count() == 0


def test_forms_at_limits(spark):
    rng = random.Random(4)
    docs = [(i, "w" * (rng.randint(60, 400) - 1) + ".", "a") for i in range(800)]
    lines = ["- The canonical ", "3. Der Crawler ", "https://e.example/", "Tags: a, b", "— Ann ", "5"]
    for i in range(60):
        last = lines[i % 6] + ("7" if i % 6 == 5 else "l") * (1 + i % 7)
        docs.append((1000 + i, "w" * (198 - len(last)) + ".\n" + last, "a"))
        docs.append((2000 + i, "w" * (203 + 3 * i) + ".\n" + last, "a"))
        docs.append((3000 + i, "One. " + "ab " * 98 + "c", "b"))
        docs.append((4000 + i, "w" * (200 + 3 * i) + ".\n" + last, "b"))
    docs.append((5000, "w" * 285 + ".\n- a whole item", "b"))  # by chance at the limit of 300 characters
    flagged, _ = truncation.cut_documents(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    assert {r.kind for r in flagged.where("doc_id >= 1000 and kind <> 'running'").collect()} == {"form"}
    assert {r.doc_id for r in flagged.where("cut").collect()} == {*range(1000, 1060), *range(3000, 3060)}


def test_scripts_beyond_the_west():
    model = E.ChainModel.fit(CLEAN)
    read = lambda *pairs: tuple(pairs)
    for good in ("Привет мир", "Ещё одна съёмка в порту", "Η πόλη της Αθήνας", "Zażółć gęślą jaźń", "Łódź – Święto", "東京の新聞", "한국어 신문", "LE COMITÉ SCOLAIRE A SALUÉ", "LA JUNTA ESCOLAR DUPLICÓ UN PLAN"):
        assert E.judge(good, model) is None, good
    cases = [
        ("Привет мир", read(("utf-8", "cp1252"))), ("Привет мир", read(("utf-8", "latin-1"))), ("Привет мир", read(("cp1251", "cp1252"))), ("Η πόλη της Αθήνας", read(("utf-8", "cp1252"))),
        ("Η πόλη της Αθήνας", read(("cp1253", "cp1252"))), ("Zażółć gęślą jaźń", read(("utf-8", "cp1252"))), ("東京の新聞", read(("utf-8", "latin-1"))), ("東京の新聞", read(("shift_jis", "cp1252"))),
    ]
    for text, chain in cases:
        assert E.judge(E.garble(text, chain), model)[1] == text, (text, chain)
    # rounds upon rounds
    deep = "Für die Bücherei – “Größe”"
    for _ in range(5):
        deep = E.garble(deep, (("utf-8", "cp1252"),))
    assert E.judge(deep, model)[1] == "Für die Bücherei – “Größe”"


def test_classifier_decides():
    model = E.ChainModel.fit(CLEAN)
    bad = ["FÃ¼r die BÃ¼cherei", "cafÃ© â€“ x", "Das Museumscafй prьfte", "Привет"]
    assert [E.judge(b, model) is not None for b in bad] == [True, True, True, False]
    blank = E.ChainModel(np.zeros_like(model.log_p))
    assert [E.judge(b, blank) for b in bad] == [None] * 4


def test_limits_decide(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, "w" * (rng.randint(60, 400) - 1) + ".", "a") for i in range(800)] + [(1000 + i, ("two words " * 30)[:199] + "x", "a") for i in range(60)]
    docs += [(2000 + i, "w" * (90 + 3 * i) + " two w", "b") for i in range(60)]  # the same endings at no limit
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows_, _ = truncation.cut_documents(df)
    assert {r.doc_id for r in rows_.where("cut").collect()} == set(range(1000, 1060)) and {r.by for r in rows_.where("cut").collect()} == {"limit"}
    monkeypatch.setattr(truncation, "FDR", 0.0)  # no length is significant
    assert {r.by for r in truncation.cut_documents(df)[0].where("cut").collect()} <= {"ending"}
