"""HTML extraction: tags, hostile pages, and the suffix array against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import html_text as H


def main_text(page):
    return [t for z, t in H.zones(page) if z == H.MAIN]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title=don't>hello</p>", ["hello"]),
        ("<p class='advert'>x</p><p hidden>y<p>z", ["z"]),
        ("<h3 class=share>s</h3>a <span class=ad>buy</span> b<br>c", ["a", "b c"]),
        ("<ul><li class=comment>c<li>d</ul>", ["d"]),
        ("<a href='x>y' title=\"a>b\">in</a>line", ["inline"]),
        ("<div class='has-sidebar'>x &lt; y < z &amp;</div>", ["x < y < z &"]),
        ("<div class=sidebar><div>in</div>deep</div>out", ["out"]),
        ("<script>if (a < b) '</p>'</script>ok<!-- <p>no</p> -->ay<style>p{}</style>", ["okay"]),
        ("<p>one\n two three</p><table><tr><td>c1<td>c2</table>", ["one two three", "c1", "c2"]),
        ("kept<script>never closed", ["kept"]),
        ("kept<p class=", ["kept"]),
        ("</i></div><b>x</b>", ["x"]),
    ],
)
def test_zones(page, want):
    assert main_text(f"<article>{page}</article>") == want or main_text(f"<article>{page}") == want


def test_hostile_pages_take_linear_time():
    for piece in ('<a "', "<script '", "<!", "<?", "</", "<a x='", '<a x=">" ', "<div>", "<b class=ad>", "<ul><ol></ul>", "<!--", "<a =", "&#", "<p><li class=ad>"):
        page = "<article>text" + piece * (1_000_000 // len(piece))
        start = time.perf_counter()
        H.zones(page)
        assert time.perf_counter() - start < 4, piece


def test_suffix_array_by_brute_force():
    rng = random.Random(5)
    for depth in (1, 3, 8):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(8)]
        streams[3] = streams[1] + streams[2]
        flat = [t for s in streams for t in s]
        size = np.array([len(s) for s in streams])
        page, ends = np.repeat(np.arange(8), size), np.repeat(np.cumsum(size), size)
        order, rank = H.suffix_array(np.array([ord(t) for t in flat], np.uint64), ends, depth)
        heads = {i: tuple(flat[i : i + depth]) for i in range(len(flat)) if i + depth <= ends[i]}
        assert sorted(order.tolist()) == sorted(heads)
        assert [heads[i] for i in order] == sorted(heads.values())
        on = H.pages_with(rank, order, page)
        want = Counter(h for s in streams for h in {tuple(s[i : i + depth]) for i in range(len(s) - depth + 1)})
        assert all(on[i] == want[h] for i, h in heads.items())


def by_hand(pages, p):
    """The rules over one host, by sets of token tuples."""
    parsed = [H.zones(x) for x in pages]
    words = lambda f: [w for _, t in f for w in t.split(" ")]
    distinct = {tuple(f) for f in parsed if f}
    on = {n: Counter(h for f in distinct for h in {tuple(words(f)[i : i + n]) for i in range(len(words(f)) - n + 1)}) for n in (p.run, p.edge)}
    out = []
    for f in parsed:
        w = words(f)
        best = lambda n: [max([1, *(on[n][tuple(w[k : k + n])] for k in range(max(0, i - n + 1), min(i, len(w) - n) + 1))]) for i in range(len(w))]
        count, edge = best(p.run), best(p.edge)
        blocks, at = [], 0
        for z, t in f:
            n = len(t.split(" "))
            blocks.append((z, t, range(at, at + n)))
            at += n
        marked = any(z in (H.MAIN, H.DOUBT) for z, _, _ in blocks)
        loose = [b for b in blocks if b[0] == H.LOOSE and not marked]
        own = lambda most: [k for k, b in enumerate(blocks) if b in loose and sum(count[i] <= most for i in b[2]) >= p.anchor]
        usual, repeated = 1, [count[i] for b in loose for i in b[2]]
        if not own(1) and sum(c > 1 for c in repeated) >= p.copy_tokens:
            usual = int(np.median(repeated))
        anchors = own(usual) or [len(blocks), -1]
        much = lambda b, test: sum(map(test, b[2])) >= max(1, p.block_share * len(b[2]))
        notice = lambda i: count[i] >= max(p.sure, p.main_share * len(distinct))
        main = [b for b in blocks if b[0] == H.MAIN]
        lost, total = sum(len(b[2]) for b in main if much(b, notice)), sum(len(b[2]) for b in main)
        kept = []
        for k, b in enumerate(blocks):
            z, t, span = b
            inside = anchors[0] <= k <= anchors[-1]
            gone = lambda i, inside=inside: count[i] >= max(p.sure, 2 * usual + 1) if inside else edge[i] >= 2
            if z == H.MAIN and (not much(b, notice) or 2 * lost >= max(1, total)) or z == H.DOUBT and not (much(b, lambda i: count[i] > 1) or all(edge[i] >= 2 for i in span)):
                kept.append(t)
            elif b in loose:
                kept.append(" ".join(x for i, x in zip(span, t.split(" "), strict=True) if not gone(i)) if much(b, gone) else t)
        out.append("\n".join(t for t in kept if t))
    return out


def site(rng):
    menu, notice = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("menu", 9), ("notice", 12)))
    article = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    pages = []
    for k in range(24):
        own = " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(rng.choice([4, 30, 60])))
        tag = rng.choice(["article", "div"])
        extra = rng.choice([f"<p>{notice}</p>", f"<p>{notice} {own}</p>", ""])
        pages.append(f"<nav>home</nav><div>{menu}</div><{tag}><p>{own}</p>{extra}</{tag}>")
    for k in range(3):  # near copies of a long article on few pages
        words = [*article]
        words[k * 7] = f"edit{k}"
        pages.append(f"<div>{menu}</div><div>{' '.join(words)}</div>")
    return [*pages, pages[0], "", "<nav>only a menu</nav>", "tiny"]


@pytest.mark.parametrize("name", ["search-results", "advertisement-free", "notice-of-default", "comment-free prose", "white-noise-share"])
def test_a_part_of_a_class_needs_repeats(spark, name):
    own = [f"<article><p>first {k} words</p><div class='{name}'><p>the body of page {k} has other words {k * 7919}</p></div></article>" for k in range(6)]
    same = [f"<article><p>another {k} text {k * 31}</p><p id='{name}'>what all of these pages say</p></article>" for k in range(6)]
    schema = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(k, "http://a.com", x) for k, x in enumerate(own)], schema)).collect()}
    assert got == {k: f"first {k} words\nthe body of page {k} has other words {k * 7919}" for k in range(6)}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(k, "http://a.com", x) for k, x in enumerate(same)], schema)).collect()}
    assert got == {k: f"another {k} text {k * 31}" for k in range(6)}
    assert H.extract(spark.createDataFrame([(1, "u", "<article><p>a<p class='share x'>b<p class=ad>c</article>")], schema).repartition(1)).first().text == "a"


def test_neutral_tags():
    """With no tag or class to go by, the array alone parts chrome from text."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 5000)}"
    menus, adverts, feet = ([" ".join(word() for _ in range(n)) for _ in range(12)] for n in (6, 9, 14))
    pages, texts = [], []
    for _ in range(60):
        text = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(2, 6))] + [" ".join(word() for _ in range(40))]
        rng.shuffle(text)
        blocks = [rng.choice(menus), rng.choice(adverts), " ".join(word() for _ in range(30)), *text, rng.choice(feet)]
        pages.append("".join(f"<div>{x}</div>" for x in blocks))
        texts.append((blocks[2:-1], [blocks[0], blocks[1], blocks[-1]]))
    parsed = [H.zones(x) for x in pages]
    out = H.section_texts(["\n".join(t for _, t in f) for f in parsed], [bytes(z for z, _ in f) for f in parsed], H.HtmlParams())
    size = lambda xs: sum(map(len, xs))
    kept = sum(size(x for x in t if x in o.split("\n")) for o, (t, _) in zip(out, texts, strict=True))
    left = sum(size(x for x in c if x in o.split("\n")) for o, (_, c) in zip(out, texts, strict=True))
    assert kept >= 0.99 * sum(size(t) for t, _ in texts)
    assert left <= 0.1 * sum(size(c) for _, c in texts)


def test_extraction_by_brute_force(spark):
    rng = random.Random(9)
    sites = {f"http://h{k}.com/": site(rng) for k in range(3)}
    rows = [(f"{u}{i}", u, x) for u, pages in sites.items() for i, x in enumerate(pages)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id string, url string, html string, text string, section int").repartition(4)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    want = {f"{u}{i}": t for u, pages in sites.items() for i, t in enumerate(by_hand(pages, H.HtmlParams()))}
    assert got == want
    assert all(len(got[f"{u}{k}"].split()) == 150 for u in sites for k in (24, 25, 26))
    assert not any("menu3" in t for t in got.values())


def test_hosts_of_several_sections(spark):
    rng = random.Random(10)
    menu = " ".join(f"menu{i}" for i in range(10))
    own = {k: " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(40)) for k in range(300)}
    df = spark.createDataFrame([(k, "http://hot.com", f"<div>{menu}</div><p>{t}</p>") for k, t in own.items()], "page_id long, url string, html string")
    for p in (H.HtmlParams(), H.HtmlParams(section_bytes=20_000, section_pages=9), H.HtmlParams(section_bytes=20_000, section_pages=9, small=0)):
        assert {r.page_id: r.text for r in H.extract(df, p).collect()} == own
    assert H.sections(df, H.HtmlParams(section_bytes=20_000, section_pages=9)).select("section").distinct().count() > 3


@pytest.mark.parametrize("seed", [31, 32])
def test_sections_change_no_result(spark, seed):
    """Counts are of the host, also for substrings on one page of each section, copies with other tags, notices and doubtful blocks."""
    rng = random.Random(seed)
    notice, doubt = " ".join(f"seen{i}" for i in range(12)), " ".join(f"maybe{i}" for i in range(9))
    pages = [x for _ in range(2) for x in site(rng)]
    own = lambda n: " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(n))
    pages += [f"<article><p>{own(30)}</p><p>{notice}</p></article>" for _ in range(120)]
    pages += [f"<article><p>{own(30)}</p><div class='my-share'>{x}</div></article>" for x in (doubt, doubt, own(9), "one two", "one two", own(2))]
    pages += [x.replace("<p>", f"<p title='{k}'>") for k, x in enumerate(pages[:12])]
    df = spark.createDataFrame([(k, "http://hot.com", x) for k, x in enumerate(pages)] + [(-1, "http://other.com", pages[0])], "page_id long, url string, html string").repartition(3)
    small = [H.HtmlParams(section_bytes=1500, section_pages=3), H.HtmlParams(section_bytes=6000, section_pages=10, small=0)]
    want = {**dict(enumerate(by_hand(pages, H.HtmlParams()))), -1: by_hand(pages[:1], H.HtmlParams())[0]}
    for p in (H.HtmlParams(), *small):
        assert {r.page_id: r.text for r in H.extract(df, p).collect()} == want
    assert [H.sections(df, p).where("page_id >= 0").select("section").distinct().count() > 5 for p in small] == [True, True]
    assert not any(notice in t for t in want.values()) and sum(doubt in t for t in want.values()) == 0


def test_every_page_asks(spark, monkeypatch):
    """A full filter lets all substrings pass; results stay."""
    monkeypatch.setattr(H, "asked", lambda s, p: np.arange(1 << H._FILTER, dtype=np.uint64) << np.uint64(64 - H._FILTER))
    test_sections_change_no_result(spark, 33)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string"
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 400_000
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a</p>"), (2, "", f"<article>{long}</article>"), (3, "http://U@A.com:80/x", "&eacute;&#x41;&nosuch; ")]
    got = sorted(((r.page_id or 0, r.text) for r in H.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(0, "a"), (1, ""), (1, ""), (2, long.strip()), (3, "éA&nosuch;")]


def test_each_page_is_parsed_once(spark):
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    plan = H.extract(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
