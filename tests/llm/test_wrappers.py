import functools
import random

import numpy as np
import pytest

from veilspan.llm import dom, wrappers
from veilspan.llm.wrappers import Matcher


def text(html):
    return "\n".join(wrappers.texts_of(dom.cleaned(dom.read(html)), set()))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("no markup  at\nall &lt;3", "no markup at all <3"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<article><h1>T</h1><p><b>x &amp;amp; <i>y</i>z<br><p>w</article><footer>f</footer>", "T\nx &amp; yz\nw"),
        ("<body><nav><a href='/'>m</a></nav><main><p>one</p><aside>s</aside><form>f</form></main>", "one"),
        ("<div class='with-sidebar'><div class=sidebar>s</div><article><p>a<script>'</p>'</script>b</p></article></div>", "ab"),
        ("<article><p>real</p><section id='comments'><article><p>first!</p></article></section></article>", "real"),
        ("<section class='comments'><article>c</article></section><article>a</article>", "a"),
        ("<article><p>x <span class='ad'>buy <span>now</span></span> y</p></article>", "x y"),
        ("<article><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>a<td>b<tr><td>c</table></article>", "1\n2\n3\na\nb\nc"),
        ("<div class='cookie-notice'>c</div><div id='content'><p>t</p></div><div>other</div>", "t"),
        ("<div><a href='x'>link</a></div><p>plain</p><!-- <p>no</p> -->", "plain"),
        ("a < b and <3 but <em>c</em> > d", "a < b and <3 but c > d"),
        ("<p title='a>b'>t</p><p title=\"open>u</p>", "t\nu"),
        ("<article><header><h1>H</h1></header><p>p</p><footer>tags</footer></article><header>page</header>", "H\np"),
        ("<p>&#x41;&#66;&nbsp;&eacute;&notin;</p>", "AB é∉"),
        ("<textarea><p>no</p></textarea><style>p{}</style><p>yes<noscript>no</noscript><button>go</button>", "yes"),
        ("<p>cut <a href='", "cut <a href='"),
        ("<h1>cut at 60 &amp</h1><p>a &ampamp; b", "cut at 60 &\na &amp; b"),
    ],
)
def test_texts(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y"
    assert text(deep) == "x\ny"
    assert text("<p>" + "w " * 200_000) == "w " * 199_999 + "w"
    assert text("<" * 20_000) == "<" * 20_000
    assert text("<article>" + "<p>a" * 20_000 + "</article>").count("a") == 20_000


def trees(r, depth=3):
    label = r.choice("ab")
    kids = [trees(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else []
    return f"<div class={label}>{r.choice(['', 'x', 'y'])}" + "".join(kids) + "</div>"


def brute_size(a, b):
    if a.label != b.label:
        return 0

    @functools.cache
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + brute_size(a.kids[i - 1], b.kids[j - 1]))

    return 1 + best(len(a.kids), len(b.kids))


@pytest.mark.parametrize("cells", [1 << 22, 2])
def test_matching_like_brute_force(monkeypatch, cells):
    monkeypatch.setattr(wrappers, "CELLS", cells)
    r = random.Random(3)
    for _ in range(60):
        m = Matcher()
        a, b = (m.tree(dom.cleaned(dom.read("<main>" + trees(r) + trees(r) + "</main>"))) for _ in range(2))
        pairs = list(m.matched(a, b))
        assert len(pairs) == m.size(a.shape, b.shape) == brute_size(a, b)
        assert all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_equal_texts_decide_ties():
    m = Matcher()
    a, b = (m.tree(dom.cleaned(dom.read(f"<article>{''.join(f'<p>{w}' for w in words)}</article>"))) for words in ("sxe", "ase"))
    assert [(x.text, y.text) for x, y in m.matched(a, b) if x.text == y.text and x.text] in ([("e", "e")], [("e", "e"), ("s", "s")])
    weights, one = np.full((1, 1), wrappers._PAIR), np.zeros(3, int)
    assert sorted(wrappers._pairs(weights, one, one, np.array([1, 2, 3]), np.array([9, 2, 3]))) == [(0, 0), (1, 1), (2, 2)]


def site(r, n, host, layout):
    """Pages with constant parts that no mark tells from content, and what is content."""
    words = lambda k: " ".join(r.choice("lorem ipsum dolor sit amet consectetur elit sed do tempor".split()) + str(r.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        body = [words(r.randint(5, 30)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            body.append(f"This passage is shared by some pages of {host} and is content.")
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        out.append((f"https://{host}/p{i}", layout.format(paragraphs), "\n".join(body)))
    return out


SITES = {
    "news.example.com": "<article><div class=k1>Read this and more on our site</div>{}<p class=k2>All texts belong to us.</p></article>",
    "Blog.example.org": "<body><div class=q>Welcome to the blog of blogs</div><div class=z>{}</div><div class=r>Made by hand <b>since 1999</b></div></body>",
}


def expected():
    r = random.Random(8)
    rows = [row for host, layout in SITES.items() for row in site(r, 40, host, layout)]
    # copies of a page, many of them, and a host of nothing but copies
    rows += [rows[0]] * 60 + [("http://copies.example.net/x", "<article><p>same</p><p>again</p></article>", "same\nagain")] * 30
    rows += [(None, "<p>no host", "no host"), ("mailto:x", "<p>none", "none"), ("http://one.example/", None, ""), ("http://one.example/", "", ""), ("http:///p", "<p>t", "t")]
    return [(i, *row) for i, row in enumerate(rows)] + [(None, *rows[1]), (3, *rows[3])]


@pytest.mark.parametrize("limit", [1 << 24, -1])
def test_templates_go_and_content_stays(spark, limit):
    rows = expected()
    df = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h, _ in rows], "page_id long, url string, html string, host string, n int").repartition(5)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in wrappers.extract(df, limit).collect()]
    assert sorted(got, key=repr) == sorted([(i, u, t, len(t)) for i, u, _, t in rows], key=repr)


def test_no_pages(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts(spark):
    urls = ["http://A.b:80/x", "x://y?z", "s://h#f", "no", None, "://", "a://b://c"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(wrappers.host_of(F.col("u"))).collect()] == ["a.b:80", "y", "h", None, None, None, "b:"]
