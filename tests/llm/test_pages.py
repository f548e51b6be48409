import numpy as np
import xxhash

from conftest import rows
from pagelode.llm import html_events, main_content, near_duplicates, residue
from pagelode.llm.html_events import Page

STORY = "The glass factory opened the old mill. A group of beekeepers praised it after a long debate in the quarter."
FRAME = '<body><div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport</a></li></ul></div>{}<div class="bottom"><div>Imprint</div><p>© Paper. All rights reserved, and more. Prices include tax.</p></div></body>'


def html(*body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title></head>" + FRAME.format("".join(body)) + "</html>"


def story(*more, head="The headline", n=3, title="T"):
    return html(f"<div class=x><h1>{head}</h1><address>By A B</address>", "".join(f"<p>{STORY} Number {i} of it." for i in range(n)), "".join(more), "</div><h3>Read also</h3><div class=t><h4><a href='/x'>Another story of the day</a></h4><p>Short. Teaser.</p></div>", title=title)


def test_blocks():
    page = Page("<html><head><title>a &amp; b</title><p>not</p></head><body><!-- no --><p>one<b>1</b> two<p>three<script>if (a<b) {}</script><noscript>n</noscript><li>x&#233;<br>y</body>")
    assert page.title == "a & b"
    assert [b.text for b in page.blocks] == ["one1 two", "three", "xé", "y"]
    assert Page(None).blocks == Page("").blocks == []
    assert [b.text for b in Page("a < b <p>c</p><!x><p>d").blocks][-1] == "d"
    assert len(Page("<p>" + "word " * 300_000).blocks) == 1


def test_main_blocks():
    page = Page(story("<ul class=tools><li>Print</li><li>Share this page</li></ul>", "<blockquote>Quoted words here.</blockquote>"))
    kept = [page.blocks[i - 1].text for i in main_content.main_blocks(page)]
    assert kept[0] == "The headline" and kept[-1] == "Quoted words here." and len(kept) == 5
    assert main_content.main_blocks(Page(html("<div class=t><h4><a href='/x'>Only a teaser</a></h4><p>Short. Teaser.</p></div>"))) == []


def test_residue_rules():
    for text in ["{{ city }}", "a {$x} b", "${user}", "#{REGION}", "<%= x %>", "<?= $t ?>", "<<teaser>>", "{% city %}", "[%seo%]", "%%city%%", "%(price)s", "*|CITY|*", "@@COUNT@@", "##TEASER##", "__TITLE__", ":teaser:", "[INSERT X]", "[Your City]", "(insert quote)", "TODO: write", "tbd tbd", "undefined undefined", "NaN views", "[object Object]", "{0} of {1}", "Dolor sit amet consectetur elit ipsum.", "Type your text here.", "Blindtext ohne Sinn"]:
        assert residue.residue_in(text), text
    for text in ["[Update] It happened.", "[sic] so", "at 10:30: done", "The placeholder {{ title }} in the sample below has to be replaced by the template engine.", "They still fill drafts with lorem ipsum before the text.", "100 % of it", "a_b {…} c", "Et il a dit non."]:
        assert not residue.residue_in(text), text


def test_residue_pages(spark):
    odd = "Our machines are asleep, please retry soon"
    data = [
        (1, "s1", story()), (2, "s1", story("<p>Dear {{ name }}, welcome.</p>")), (3, "s2", html("<h1>Page not found</h1>")), (4, "s2", story("<pre>{{ name }}</pre><p>See <code>{{x}}</code> there.</p>")),
        (5, "s3", "<html><head><title>X</title></head><body><noscript>You need to enable JavaScript to run this app.</noscript><div id=root></div></body></html>"),
        (6, "s3", story("<p>Please enable JavaScript to view the comments.</p>")), (7, "s1", None), (8, "s1", ""), (2, "s1", story("<p>Dear {{ name }}, welcome.</p>")),
        *[(10 + i, f"t{i}", html(f"<p>{odd}</p>")) for i in range(4)], (20, "s4", story(title="{{page.title}}")), (None, "s5", html("<h1>Access denied</h1>")),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in data], "fetch_id bigint, site_id string, html string, kind string")
    assert sorted({r.fetch_id for r in residue.residue_pages(df).collect()}) == [2, 3, 5, 10, 11, 12, 13, 20]
    assert rows(residue.residue_pages(df.limit(0))) == []


def test_main_body_rows(spark):
    df = spark.createDataFrame([(1, story(), 0), (1, story(), 0), (2, None, 0), (3, html("<h1>Access denied</h1>"), 0), (None, story(), 0)], "fetch_id bigint, html string, block_no int")
    got = rows(main_content.main_body_blocks(df))
    assert {f for f, _ in got} == {1} and len(got) == 4
    assert rows(main_content.main_body_blocks(df.limit(0))) == []


def test_covering_masks():
    from itertools import combinations

    for r in (1, 2, 3):
        n = 2 ** (r + 1) - 1
        masks = near_duplicates.covering_masks(r)
        assert len(masks) == n and all(masks)
        assert all(any(not set(m) & set(bad) for m in masks) for bad in combinations(range(n), r))


def test_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(160)] for _ in range(12)]
    texts = []
    for words in base:
        texts.append(words)
        for share in (0.02, 0.06, 0.1, 0.5):
            texts.append([rng.choice(vocab) if rng.random() < share else w for w in words])
    texts.append(base[0])
    texts.append(base[1][80:] + base[1][:80])
    sentence = lambda w: " ".join(" ".join(w[i : i + 10]).capitalize() + "." for i in range(0, len(w), 10))
    pages = [(i, html(f"<div class=x><h1>Head</h1><p>{sentence(w[:80])}</p><p>{sentence(w[80:])}</p></div>")) for i, w in enumerate(texts)]
    df = spark.createDataFrame([*pages, pages[0], (900, None), (901, "")], "fetch_id bigint, html string")
    sets = {}
    for i, h in pages:
        p = Page(h)
        w = near_duplicates._WORDS.findall(" ".join(p.blocks[k - 1].text for k in main_content.main_blocks(p)).lower())
        sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    links, members = near_duplicates.near_duplicate_links(near_duplicates.bodies(df))
    rep = {f: r for r, f in rows(members)}
    linked = {(r.a, r.b) for r in links.collect()}
    got = {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked)}
    assert len(want) > 60 and got <= want and len(got) >= 0.97 * len(want)


def test_recall_at_threshold(spark):
    """Pairs just above J = 0.5: single-word edits spread evenly, and short entries in another order."""
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    shingles = lambda w: set(zip(w, w[1:], w[2:], strict=False))
    data, pairs = [], []

    def add(a, b):
        left, right = shingles(a), shingles(b)
        if 0.5 <= len(left & right) / len(left | right) <= 0.6:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            for fetch_id, words in zip(pairs[-1], (a, b), strict=True):
                symbols, bits = near_duplicates.sketch(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64))
                data.append((fetch_id, *bits.tolist(), symbols.tolist()))

    for _ in range(200):
        base = [word() for _ in range(270)]
        add(base, [word() if i % 9 == 4 and i > 9 else w for i, w in enumerate(base)])
        for size in (6, 7):
            entries = [[word() for _ in range(size)] for _ in range(40)]
            add([w for e in entries for w in e], [w for e in rng.sample(entries, 40) for w in e])
    sketches = [f"s{i} bigint" for i in range(1, len(data[0]) - 1)]
    reps = spark.createDataFrame(data, f"rep bigint, {', '.join(sketches)}, symbols array<int>")
    got = {(r.a, r.b) for r in near_duplicates.candidates(reps).collect()}
    assert len(pairs) > 500 and len(got & set(pairs)) >= 0.99 * len(pairs)


def test_plain_and_irregular_pages_agree():
    """A page cut at its tags at once gives what the parser's events give."""
    body = "<p class=a>One <b>two</b> &amp; <code>x</code> three<ul><li>a<li>b &#233;</ul><img src='x>y'><h2>Head <a href='/q'>link</a></h2><br/>tail<script>if (a<b) {'</p>'}</script> more<noscript>off</noscript><!-- <p>no -->end"
    for head in ("<title>T &lt; t</title>", "<title>T</title><style>p > a {}</style>"):
        html = f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"
        fast, slow = html_events.HtmlBlocks(), html_events.HtmlBlocks()
        assert fast.plainly(html)
        fast._flush()
        slow.feed(html)
        slow.close()
        slow._flush()
        of = lambda p: ([(b.text, b.plain, b.linked, b.node.tag, b.node.cls) for b in p.blocks], p.title, p.noscript)
        assert of(fast) == of(slow) and len(fast.blocks) == 7
    for odd in ("<p>a < b</p>", "<p a='>c</p>", "<script>open", "<textarea><b>x</b></textarea>"):
        assert not html_events.HtmlBlocks().plainly(odd)


def test_clusters_choose_the_region(monkeypatch):
    page = Page(story("<blockquote>Quoted words here.</blockquote>", n=5))
    kept = main_content.main_blocks(page)
    assert len(kept) == 7
    asked = []
    monkeypatch.setattr(main_content, "_is_story", lambda *a: asked.append(a) or True)
    assert main_content.main_blocks(page) == kept and not asked  # clear: no rule is asked
    monkeypatch.setattr(main_content, "line_ratios", lambda blocks: [1.0] * len(blocks))
    assert main_content.main_blocks(page) == []  # without ratios there is no region


def test_story_in_parts():
    part = lambda n: "<div class=p>" + f"<p>{STORY}</p>" * n + "</div>"
    page = Page(html(f"<article><header><h1>The headline</h1></header>{part(3)}{part(2)}</article>"))
    assert [page.blocks[i - 1].node.tag for i in main_content.main_blocks(page)] == ["h1", *["p"] * 5]


def pages_frame(spark, data):
    return spark.createDataFrame(data, "fetch_id bigint, site_id string, url string, html string")


def ids(df):
    return sorted({r.fetch_id for r in df.collect()})


def test_messages_as_groups(spark, monkeypatch):
    odd, quoted = "Our machines are asleep, please retry soon", "Access denied."
    u = lambda s: f"https://www.{s}-paper.example/x"
    bare = lambda i, s, text: (i, s, u(s), html(f"<p>{text}</p>"))
    data = [bare(i, f"wide{i}", odd) for i in range(3)] + [bare(10, "alone", "Nothing works here, please wait")]
    data += [bare(20, "named", "Welcome to Named-Paper, the server is busy")] + [bare(21 + i, s, f"Welcome to {s.title()}-Paper, the server is busy") for i, s in enumerate(("other", "third"))]
    data += [bare(30, "long", "Access denied. " + "This page has more to say about what you may and may not do. " * 9)]
    data += [(31, "noscript", u("noscript"), "<html><body><noscript>" + "Some words before. " * 30 + "Please enable JavaScript.</noscript><div id=root></div></body></html>")]
    data += [(32, "framed", u("framed"), html("<noscript>Please enable JavaScript to see this site.</noscript><div id=root></div>"))]
    assert ids(residue.residue_pages(pages_frame(spark, data))) == [0, 1, 2, 20, 21, 22, 30, 31, 32]
    # what story pages of several sites show as well isn't a message on one bare page
    data = [bare(1, "s1", quoted)] + [(2 + i, f"t{i}", u(f"t{i}"), story(f"<p>{quoted}</p>")) for i in range(4)]
    assert ids(residue.residue_pages(pages_frame(spark, data))) == []
    # without the count of sites the cues have nothing to stand on
    monkeypatch.setattr(residue, "group_score", lambda prior, bare_sites, story_sites: prior)
    assert {k for k in ("recurring",) if residue.group_score(residue.prior_of(odd)[1], 3, 0) >= residue.ENOUGH} == set()


def test_masks():
    assert residue.masked("Ref 12.5 at 10:30 on 2024-01-02, see https://a.example/x", ()) == "ref # at @date on @date, see @url"
    assert residue.masked("Paper Times is down", residue.names_of("https://www.paper-times.example/a")) == "@name @name is down"
    assert residue.names_of(None) == () == residue.names_of("no url")


def test_hints_without_the_library():
    texts = [story("<p>Dear {{ name }}, please wait, lorem ipsum.</p>"), story(), html("<h1>Access denied</h1>"), story("<pre>undefined undefined</pre>", title="Ihr Text hier")]
    for text in texts:
        low = "\n".join(b.text for b in Page(text).blocks).lower()
        found = residue._automaton()
        plain = residue._OneByOne({w: (w in residue._RESIDUE_HINTS, w in residue.CUES or w in residue._FORM_HINTS) for w in {*residue._RESIDUE_HINTS, *residue.CUES, *residue._FORM_HINTS}})
        assert sorted(found.iter(low)) == sorted(plain.iter(low))
