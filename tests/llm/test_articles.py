"""What markup alone leaves of a page: nothing that is dropped leaks, and nothing of the article goes."""

import time

import pytest

from lodestone.llm import extract

LONG = "The body of the page stands in a plain element and is long enough to be told from a teaser."


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>text <span hidden>SECRET</span> more</p></article>", ["text more"]),
    ("<article><p>a <span class='ad'>Buy now</span>b</p></article>", ["a b"]),
    ("<article><p>c<svg><text>X</text></svg> <button>Go</button>d</p></article>", ["c d"]),
    ("<article><p>e <select><option>one</option></select> f</p></article>", ["e", "f"]),
    ("<article><div><button>Subscribe</button></div><p>g</p></article>", ["g"]),
    ("<span hidden><p>no</p></span><p>yes</p>", ["yes"]),
    ("<p>one <span hidden>two<p>three", ["one", "three"]),
    ("<article><p>Intro.</p><p><a href=x>A whole sentence that is a link to the source report</a></p></article>", ["Intro.", "A whole sentence that is a link to the source report"]),
    (f"<article>Teaser: other story</article><div><p>{LONG}</p></div>", ["Teaser: other story", LONG]),
    (f"<main>Related</main><div><p>{LONG}</p></div>", ["Related", LONG]),
    (f"<article><p>{LONG}</p></article><div>Short line outside</div>", [LONG]),
    (f"<article><p>{LONG}</p></article><article class='comment'>me too</article>", [LONG]),
    (f"<div><p>{LONG}</p></div><div class='user-comments'>c</div><div id='comment-list'>d</div><div class='nav-bar'>e</div><div class='top-menu'>f</div><div class='site-notice'>g</div>", [LONG]),
    ("<article><div class='menu'>The menu of the inn has soup, bread and fish for all guests.</div><div class='menu'><a>Home</a> <a>About</a></div></article>", ["The menu of the inn has soup, bread and fish for all guests."]),
    ("<div class='has-sidebar no-comments'><p>All of the text</p></div>", ["All of the text"]),
    ("<body class='comments'><article class='comments-open post'><p>Text</p></article></body>", ["Text"]),
    ("<div class='notice'><p>Only this</p></div>", ["Only this"]),
    ("<article><header class='page-top'><h1>Title</h1><p>by me</p></header><p>Text</p></article>", ["Title", "Text"]),
    ("<p>a<p class='ad'>b<p>c", ["a", "c"]),
    ("", []), (None, []), ("<nav>x</nav>", []), ("&lt;b&gt; &amp;c &#x1F600;", ["<b> &c \U0001f600"]),
])
def test_article(page, want):
    assert extract.article(page)[0] == want


def test_all_lines_are_aligned(spark):
    """A menu and a footer that two pages of a host share are found by differencing, and a plain shared line goes by it alone."""
    page = lambda k: f"<nav><a>Home</a></nav><div>Shared boilerplate of the site</div><p>{LONG} {k}</p><footer>All rights</footer>"
    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(4)] + [(9, "http://other.example/x", page(9))]
    got = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    for k in range(4):
        assert got[k]["text"] == f"{LONG} {k}" and got[k]["n_shared"] == 3
    assert got[9]["n_shared"] == 0 and got[9]["text"] == f"Shared boilerplate of the site\n\n{LONG} 9"


@pytest.mark.parametrize("unit", ["<span a><p></p>", "<p><div><span a><p></p>", "<b x>", "<span hidden>x", "<p><b y>"])
def test_malformed_pages_take_linear_time(unit):
    began = time.process_time()
    extract.lines(unit * (600_000 // len(unit)))
    assert time.process_time() - began < 10
