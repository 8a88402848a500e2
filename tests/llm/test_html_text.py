"""Main text: parsing, messages against enumeration, held-out accuracy, whole pages."""

import itertools
import re

import numpy as np
import pytest

import oracle
from uttera.llm import html_text as ht
from uttera.llm import html_tree as tree
from uttera.session import ship

P1 = "The harbour reopened on Monday after repairs that took nearly two years, the council said."
P2 = "Fishing boats returned first. Ferries will follow in May, once the eastern quay has been tested."
P3 = "Costs rose &mdash; by 12 % &amp; more &#8212; as <b>steel</b> became\n   dearer. Nobody complained."
PARAS = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = "\n".join(["Harbour reopens", P1, P2, "Costs rose — by 12 % & more — as steel became dearer. Nobody complained."])
HEAD = "<header><h2>The Gazette</h2><p>News from the coast since 1902.</p></header>"
NAV = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2024 The Gazette. All rights reserved.</p><a href="/imprint">Imprint</a></footer>'
COMMENTS = '<section id="comments"><h2>3 comments</h2><div class="comment"><p class="author">anna</p><p>What a relief, I have waited for this for two years now!</p></div><div class="comment"><p>They should have done it earlier.</p></div></section>'
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Council votes on budget</a></li></ul><p>Weather today: sunny, with some clouds later in the afternoon.</p></aside>'
COOKIE = '<div class="cookie-notice"><p>We use cookies to improve your experience. By going on you agree to our terms.</p><button>Accept</button></div>'
AD = '<div class="advert"><p>Buy one, get one free! Only this week at the Big Store.</p></div>'
FORM = '<form action="/subscribe"><label>Your e-mail address</label><input name="e"><button>Subscribe</button><p>We never share your address with anybody.</p></form>'
SCRIPT = '<script>var a = "<p>no text</p>";</script><style>p{color:red}</style><noscript>Enable scripts please.</noscript>'
PAGES = {
    "article": f"<html><head><title>Harbour</title></head><body>{HEAD}{NAV}{COOKIE}<article><h1>Harbour reopens</h1>{PARAS}</article>{SIDE}{COMMENTS}{FOOT}</body></html>",
    "main": f"<body>{COOKIE}{HEAD}{NAV}<main><h1>Harbour reopens</h1><p>{P1}</p>{AD}<p>{P2}</p>{SCRIPT}<p>{P3}</p>{FORM}</main>{SIDE}{FOOT}",
    "divs": f'<div id="header"><a href="/">The Gazette</a></div><div class="navbar"><a href="/a">Home</a> | <a href="/b">News</a></div><div id="wrapper"><div id="content"><h1>Harbour reopens</h1>{PARAS}</div><div id="sidebar"><h3>Most read</h3><p>Weather today: sunny.</p></div></div><div id="footer">&copy; 2024 The Gazette. <a href="/i">Imprint</a></div>',
    "comments inside": f"<body>{NAV}<article><h1>Harbour reopens</h1>{PARAS}{COMMENTS}</article>{FOOT}</body>",
    "post": f'<body>{HEAD}{AD}<div class="post"><h1>Harbour reopens</h1><div class="entry-content">{PARAS}</div>{FORM}</div><div class="related"><h3>Related</h3><ul><li><a href="/3">Ferry sinks near the islands</a></li></ul></div>{COMMENTS}{FOOT}',
    "no container": f"<html><body>{NAV}<h1>Harbour reopens</h1>{PARAS}{FOOT}</body></html>",
    "nothing else": f"<html><body><h1>Harbour reopens</h1>{PARAS}</body></html>",
    "aside inside": f'<body>{NAV}<main><article><h1>Harbour reopens</h1><p>{P1}</p><aside><h3>Newsletter</h3><p>Get our best stories, every morning, free of charge.</p></aside><p>{P2}</p><div class="notice">This story was paid for by readers. Please support us.</div><p>{P3}</p></article></main>{FOOT}',
    "names that tell nothing": f'<body><div class="x1"><a href="/">Home</a><a href="/n">News</a></div><div class="x2"><h1>Harbour reopens</h1>{PARAS}</div><div class="x3">&copy; 2024 Gazette</div>',
}


@pytest.fixture(scope="module")
def model(spark):
    ship(spark)
    return ht.fit(spark.read.parquet(f"{oracle.SF}/pages.parquet"))


def blocks(source):
    f = tree.Forest()
    tree.parse(source, 0, f)
    return [t for t in f.text if t]


def test_blocks():
    assert blocks("<p>a &lt;b&gt;&nbsp; c<br>d<p><b>e</b> f</p>g<div>h<span> i</span></div>") == ["a <b> c d", "e f", "g", "h i"]
    assert blocks('<title>x</title><script>"<p>x</p>"</script><p title="a>b" data-x=\'<p>\'>y</p><!-- <p>x</p> --><style>p{}</style><textarea><p>x</textarea>z') == ["y", "z"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") == list("abcdefg")
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("a < b &am &amp c &") == ["a < b &am & c &"] and blocks("<p>x<div") == ["x"]
    assert blocks("</div></p>a</span>b<!doctype html><?php x ?>c") == ["abc"]
    assert blocks("<select><option>no</select><button>no</button>yes<svg><text>no</text></svg>") == ["yes"]
    assert blocks("<body><p>a<article><h1>b</h1>") == ["a", "b"]


def test_odd_pages_take_linear_time():
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert blocks(deep) == ["x"]
    assert blocks('<p a="' * 20_000) == []
    assert len(blocks("<div></p></li>x" * 20_000)) == 20_000
    assert len(blocks("<p>w " * 50_000)) == 50_000
    assert blocks("<" * 100_000) == ["<" * 100_000]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    for k in (2, 3):
        parent = np.array([-1, 0, 1, 0, 3, 3, -1, 6])
        depth = np.array([0, 1, 2, 1, 2, 2, 0, 1])
        potentials = rng.normal(0, 2, (8, k, k))
        node, edge, z = ht.marginals(potentials, parent, tree.levels(depth))
        weight = {s: np.exp(sum(potentials[i, s[parent[i]] if parent[i] >= 0 else 0, s[i]] for i in range(8))) for s in itertools.product(range(k), repeat=8)}
        total = sum(weight.values())
        assert np.isclose(z, np.log(total))
        for i in range(8):
            for y in range(k):
                assert np.isclose(np.exp(node[i, y]), sum(w for s, w in weight.items() if s[i] == y) / total)
                for x in range(k):
                    assert np.isclose(np.exp(edge[i, x, y]), sum(w for s, w in weight.items() if s[i] == y and (s[parent[i]] if parent[i] >= 0 else 0) == x) / total)


def test_training_climbs():
    pages = [ht.Layouts(ht.words_of([]), seed).page() for seed in range(40)]
    f = tree.Forest()
    for i, p in enumerate(pages):
        tree.parse(p, i, f)
    y, parent, down = ht.states(f), f.array("parent"), tree.levels(f.array("depth"))

    def likelihood(m):
        t = m.potentials(tree.features(f))
        return sum(t[i, y[parent[i]] if parent[i] >= 0 else 0, y[i]] for i in range(len(y))) - ht.marginals(t, parent, down)[2]

    a, b = (likelihood(ht.trained(pages, steps)) for steps in (2, 80))
    assert a < b < 0


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_layouts(model, name):
    assert model.texts([PAGES[name]]) == [TEXT]


def test_held_out_pages(model):
    made = ht.Layouts(ht.words_of([]), seed=99)
    pages = [made.page() for _ in range(300)]
    f = tree.Forest()
    for i, p in enumerate(pages):
        tree.parse(p, i, f)
    leaf, words = f.array("group") == tree.LEAF, f.array("words")
    right = (model.kept(f) >= 0.5) == (f.array("label") == 1)
    assert right[leaf].mean() > 0.96 and (right * words)[leaf].sum() / words[leaf].sum() > 0.96


def test_labels_hide_names():
    page = '<html><body><nav>x</nav><article class="post" id=a><p>y</p></article><div class="ad">z</div>'
    marked, hidden = ht.labelled(page)
    assert re.sub(r"</?html>|</?body>", "", hidden) == '<html><body><div>x</div><div data-main="1"><p>y</p></div><div>z</div>'.replace("<html><body>", "")
    assert 'data-main="1"' in marked and ht.labelled("<p>none</p>") == [] and ht.labelled("<article></article><article></article>") == []


def test_rows(spark, model):
    rows = [(1, "u", PAGES["article"], "t"), (1, "u", PAGES["article"], "t"), (2, None, None, None), (None, "v", "", None), (3, "w", "<div class=ad>Buy!", None), (4, "x", "<article>" + "<p>Long text, and more of it.</p>" * 20_000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = ht.main_texts(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in out.collect()}
    assert out.count() == 6 and got[1, "u"] == (TEXT, len(TEXT)) and got[2, None] == got[None, "v"] == ("", 0)
    assert got[4, "x"][0] == "\n".join(["Long text, and more of it."] * 20_000)
    none = df.limit(0)
    assert ht.main_texts(none, ht.fit(none)).collect() == []


def test_fit_depends_on_content_alone(spark):
    ship(spark)
    pages = spark.read.parquet(f"{oracle.SF}/pages.parquet")
    a, b = ht.fit(pages, most=5, layouts=5), ht.fit(pages.unionByName(pages).repartition(7), most=5, layouts=5)
    assert (a.weights == b.weights).all()
