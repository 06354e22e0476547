import itertools
import random
import time

from whence.llm import html as H
from whence.llm.common import table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def page(rng, article=True, n=None):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    blocks = [say(rng.randint(3, 9)) for _ in range(n or rng.randint(1, 6))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p class='t'>{b}" for b in blocks[1:])
    body = f"<article>{body}<div class='share'>share {say(2)}</div></article>" if article else f"<div id=page-{rng.randint(1, 99)}><div class=body>{body}</div></div>"
    made = f"""<!DOCTYPE html><html><head><title>{say(3)}</title><script>if (a<b) "</p>"</script></head><body>
    <header class="site"><div>Site name</div></header><nav><ul><li>{say(1)}<li>b</ul></nav><div class="cookie-notice">we use cookies</div>
    <div class=intro>Welcome to this site, where every page says so</div>{body}<aside>{say(4)}</aside>
    <section class="comments"><h2>Comments</h2><p>{say(5)}</p></section><form><p>mail</p><input></form><footer>&copy; {say(2)}</footer></body></html>"""
    return made, blocks


def text(page):
    """By the page's own tree."""
    return H.extract(page)


def wrapped(spark, pages, n=3):
    """The texts of one host's pages."""
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(n)
    return [r.text for r in sorted(H.main_text(df).collect(), key=lambda r: r.page_id)]


def test_parse_odd_markup():
    assert text(None) == text("") == text("<p") == text("<script>x") == ""
    assert text("a &amp; b&nbsp;\n c<br>d &#233;&lt;i&gt;") == "a & b c d é<i>"
    assert text("<p><b>one<br><p>two</p>three<div>four</b></div><!-- no --><p title='a>b'>five < six") == "one\n\ntwo\n\nthree\n\nfour\n\nfive < six"
    assert text("<ul><li>a<li>b <ul><li>c</ul>d</ul><table><tr><td>1<td>2<tr><th>3</table>") == "a\n\nb\n\nc\n\nd\n\n1\n\n2\n\n3"
    assert text("<style>p{}</style><p hidden>x</p><span class=ad>y</span>z<p style='display: none'>w</p>") == "z"
    assert text("<p>" + "long " * 100_000).count("long") == 100_000
    assert text("<p title=it's>a</p><p class=\"x>y\">b</p><button>c<p>d") == "a\n\nb\n\nc\n\nd"
    assert text("<script>if (a<b) x='</p>'; y=\"</script><p>after</p>") == "after"
    assert text("<p>&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65; &#x110000; &#x41;") == "\ufffd A \ufffd A"


def test_time_and_depth_have_no_limit():
    began = time.time()
    for page in ("<div " * 200_000, "<a b='" * 200_000, "<p a=\"" * 200_001, "<!--" * 200_000, "<div>" * 200_000 + "deep", "<td>" * 100_000 + "x", "<li><div>" * 100_000, "<a =" * 200_000, "</p" * 200_000):
        text(page)
    assert time.time() - began < 30
    assert text("<div>" * 200_000 + "deep") == "deep"
    deep = "<div>" * 110 + "<nav>MENU</nav><aside>SIDE</aside><p>body</p>"
    assert text(deep) == "body"


def test_long_pages_align(spark):
    own = ["".join(f"<p>{k} {i}" for k in range(n)) + "<p>the same end" for i, n in enumerate((3000, 2500, 2000, 1))]
    got = wrapped(spark, own)
    assert [t.count("\n\n") + 1 for t in got] == [3000, 2500, 2000, 1] and "same end" not in "".join(got)


def test_names_that_mislead():
    long = "what the page is about, said at some length so that it has most of the letters"
    assert text(f"<div class='wrap no-sidebar'><article><p>{long}</article></div><div class=sidebar>s</div>") == long
    assert text(f"<div class='content with-sidebar'><p>{long}</p></div><div class=ads>a</div>") == long
    assert text(f"<div id=header>site</div><div class=post><div class=entry-header><h1>Title</h1></div><p>{long}</div>") == f"Title\n\n{long}"
    assert text(f"<article><header><h1>T</h1></header><p>{long}<footer>tags</footer></article><div class=related><article>other</article></div>") == f"T\n\n{long}"
    assert text(f"<main><p>{long}</p><div id='comments'><article class=comment>no</article></div><div role=alert>!</div></main>") == long
    odd = "<div class=related-work>a</div><div class=social-history>b</div><section id=discussion>c</section>"
    noise = "<div class=related-posts>x</div><ul class='share-buttons'><li>y</ul><section id=comment-list>z</section>"
    assert text(f"<article><h1>T</h1>{odd}{noise}<p>{long}</article>") == f"T\n\na\n\nb\n\nc\n\n{long}"


def own_tree(*nested):
    """A tree of (signature, children...)."""
    page = H.Page()
    page.sigs, page.parents = [], []

    def add(node, above):
        at = len(page.sigs)
        page.sigs.append(node[0])
        page.parents.append(above)
        for k in node[1:]:
            add(k, at)

    add(nested, -1)
    return H.tree(page)


def brute(a, i, b, j):
    """The largest common top-down ordered mapping, by trying all."""
    if a.sigs[i] != b.sigs[j]:
        return 0
    x, y = a.kids[i], b.kids[j]
    best = 0
    for n in range(min(len(x), len(y)) + 1):
        for p in itertools.combinations(x, n):
            for q in itertools.combinations(y, n):
                w = [brute(a, s, b, t) for s, t in zip(p, q, strict=True)]
                best = max(best, sum(w)) if all(w) else best
    return 1 + best


def test_matching_is_simple_tree_matching(monkeypatch):
    rng = random.Random(7)

    def grown(depth):
        return (rng.choice("abc"), *[grown(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)])

    for cells in (H.CELLS, 3):
        monkeypatch.setattr(H, "CELLS", cells)
        for _ in range(150):
            a, b = own_tree("r", *grown(2)[1:]), own_tree("r", *grown(2)[1:])
            want = brute(a, 0, b, 0)
            assert H.match(a, 0, b, 0) == want
            pairs, n = [(0, 0)], 0
            while pairs:
                i, j = pairs.pop()
                n += 1
                found = sorted(H.aligned(a, a.kids[i], b, b.kids[j]))
                assert [j for _, j in found] == sorted(j for _, j in found) and all(a.sigs[i] == b.sigs[j] for i, j in found)
                pairs += found
            assert n == want


def test_wrapper_decides_within_articles(spark):
    """A line that all of a host's pages repeat goes, wherever it stands; without the host's wrapper it stays."""
    for first in (True, False):
        pages = []
        for i in range(9):
            line, own = "<div>Same boilerplate on every page</div>", "".join(f"<p>text {i} {k}</p>" for k in range(i % 4 + 1))
            pages.append(f"<nav>n</nav><article><h1>Title {i}</h1>{line if first else ''}{own}{'' if first else line}</article>")
        got = wrapped(spark, pages)
        assert all("boilerplate" not in t and t.count("text") == i % 4 + 1 for i, t in enumerate(got))
        assert all("boilerplate" in text(p) for p in pages)
    # A perhaps-name within the article: kept where it varies, left out where it is the same.
    pages = [f"<article><p>text {i}</p><div class=related-work>work {i}</div><div class=social-history>all alike</div></article>" for i in range(4)]
    assert wrapped(spark, pages) == [f"text {i}\n\nwork {i}" for i in range(4)]


def test_copies_are_no_evidence(spark):
    """Near copies differ in one line; what they share is no template, on hosts of few pages or many."""
    for n in (2, 3, 12):
        shared = "<p>a passage that all the copies share word by word</p><p>and another one that they share</p>"
        pages = [f"<article><h1>Title</h1>{shared}<p>no. {i}</p></article>" for i in range(n)]
        assert wrapped(spark, pages) == [text(p) for p in pages]


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example/{i}", *page(rng, i % 2 == 0)) for i in range(60)]
    odd = [(100, None, None, []), (101, "http://h0.example/x", "", []), (None, "http://one.example/", "<p>only</p>", ["only"]), (102, "no host", "<article><p>x</article>", ["x"]), (103, None, "<article>y</article>", ["y"])]
    rows += [*odd, rows[0], rows[0]]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h, _ in rows], "page_id long, url string, html string, host string, wrapper int").repartition(4)
    want = sorted(((i, u, "\n\n".join(b)) for i, u, _, b in rows if i is None or i % 2 == 0 or i > 99), key=str)
    got = sorted((tuple(r) for r in H.main_text(df).collect() if r.page_id is None or r.page_id % 2 == 0 or r.page_id > 99), key=str)
    assert got == want
    assert H.main_text(df.limit(0)).collect() == []


def test_both_ways_to_hand_out_wrappers(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    one = sorted(map(tuple, H.op4_html(spark, d).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, H.op4_html(spark, d).collect())) == one and len(one) == table(spark, d, "pages").count()
    assert all(len(t) == n for _, _, t, n in one)


def test_hosts_of_mixed_layouts(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 3}.example/{i}", *page(rng, i % 2 == 0)) for i in range(120)]
    rows += [(200 + i, None, *page(rng, i == 0)) for i in range(20)]  # without a host, one of them with an article
    story = [f"story {i} tells of {rng.random()}" for i in range(3)]  # a second layout, rare on its host
    rows += [(300 + i, f"http://h0.example/s{i}", f"<nav>n</nav><div class=story><div class=in><p>{t}</p></div></div>", [t]) for i, t in enumerate(story)]
    card = "<article><p>a teaser</p></article>"
    rows += [(400, "http://h1.example/card", f"<div class=list>{card}</div>", ["a teaser"]), (401, "http://h1.example/r", f"<div class=text><p>{'the text ' * 9}</p></div><div class=related>{card}</div>", [("the text " * 9).strip()])]
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in rows], "page_id long, url string, html string").repartition(4)
    want = {i: "\n\n".join(b) for i, _, _, b in rows}
    assert {r.page_id: r.text for r in H.main_text(df).collect()} == want


def test_copies_and_partitions_change_no_text(spark):
    wrap = lambda t: f"<div class=top>Site line</div><div class=body><p>{t}</p></div>"
    rows = [(i, "http://h.example/", wrap("copied text")) for i in range(40)] + [(100 + i, "http://h.example/", wrap(f"text {i}")) for i in range(7)]
    rows += [(200 + i, "http://one.example/", wrap("the host's only text")) for i in range(30)]
    # Of ten pages eight, then nine, hold one text at a node; the others differ.
    rows += [(300 + i, "http://eight.example/", f"<h2>{'same' if i < 8 else i}</h2><p>text number {i}</p>") for i in range(10)]
    rows += [(400 + i, "http://nine.example/", f"<h2>{'same' if i < 9 else i}</h2><p>text number {i}</p>") for i in range(10)]
    # Siblings in either order.
    rows += [(500 + i, "http://turned.example/", "".join([f"<h2>line</h2><p>text {i}</p>", "<h3>x</h3>"][:: 1 if i % 3 else -1])) for i in range(12)]
    heads = {i: "same" if i < 308 else str(i % 100) for i in range(300, 310)}
    want = {i: "copied text" for i in range(40)} | {100 + i: f"text {i}" for i in range(7)} | {200 + i: "Site line\n\nthe host's only text" for i in range(30)}
    want |= {i: f"{heads[i]}\n\ntext number {i % 100}" for i in range(300, 310)} | {i: f"text number {i % 100}" if i < 409 else f"{i % 100}\n\ntext number {i % 100}" for i in range(400, 410)} | {500 + i: f"text {i}" for i in range(12)}
    for n, seed in ((1, 0), (7, 1), (31, 2)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert {r.page_id: r.text for r in H.main_text(df).collect()} == want
