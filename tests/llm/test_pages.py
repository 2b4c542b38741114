import pytest

from tallyrack.llm import pages

ARTICLE = "<h1>A title</h1><p>First paragraph with a good many words in it, so that it is long enough.<p>Short.</p>"
WANT = "A title\nFirst paragraph with a good many words in it, so that it is long enough.\nShort."
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "extra",
    [
        NAV, "<header>Site name</header>", "<footer>&copy; us</footer>", "<aside>More</aside>", "<div class='ad'>Buy</div>", "<form><p>Name <input></p></form>",
        "<div class='cookie-notice'>We use cookies</div>", "<section id=comments><h2>Comments</h2><p>I liked this very long article a lot indeed, it was good.</p></section>",
        "<div class='sidebar'><p>Something about the author, a longer text that no reader of the article needs.</p></div>", "<script>x = '<p>no</p>'</script>",
        "<noscript>Turn on scripts</noscript>", "<div role=navigation>x</div>", "<div hidden>x</div>", "<div style='display: none'>x</div>", "<!-- <p>no</p> -->",
        "<div class=breadcrumbs><div>a</div><div>b</div></div>",
    ],
)
def test_boilerplate_goes(extra):
    assert pages.main_text(page(f"{extra}<article>{ARTICLE}</article>")) == WANT
    assert pages.main_text(page(f"<article>{ARTICLE}</article>{extra}")) == WANT
    assert pages.main_text(page(f"<main>{extra}<article>{ARTICLE}{extra}</article>{extra}</main>")) == WANT
    assert pages.main_text(page(f"{NAV}<div id=page><div class=story>{ARTICLE}</div>{extra}</div>")) == WANT


def test_inside_a_block():
    html = page("<article><p>a <b>b</b>\n\t c<br>d&nbsp;&amp; e&#39;s &lt;x&gt; <i>f</p><p><span>g</span>h</p><ul><li>one<li>two</ul></article>")
    assert pages.main_text(html) == "a b c d & e's <x> f\ngh\none\ntwo"


def test_broken_pages():
    assert pages.main_text("") == "" and pages.main_text("<") == "<" and pages.main_text("just text") == "just text"
    assert pages.main_text(page(f"<article>{ARTICLE}")[:-20]) != ""
    cut = f"<body>{NAV}<article>{ARTICLE}<p>It ends here and the"
    assert pages.main_text(cut) == WANT + "\nIt ends here and the"
    assert pages.main_text(cut + "<a href='x") == WANT + "\nIt ends here and the"
    assert pages.main_text(page(NAV)) == ""
    assert pages.main_text(f"<article><p><b>{ARTICLE}</b></div></span></article>{NAV}") == WANT
    assert pages.main_text("<article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000 + "</article>") == "deep text"


def test_short_paragraphs_and_links_of_the_article_stay():
    many = "".join(f"<p>Paragraph {i} {'word ' * (i % 7)}</p>" for i in range(30))
    text = pages.main_text(page(f"{NAV}<article>{many}<p><a href=x>A linked line</a></p></article>"))
    assert text.split("\n") == [" ".join(f"Paragraph {i} {'word ' * (i % 7)}".split()) for i in range(30)] + ["A linked line"]


def test_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>")), (2, None, None), (None, "v", ""), (1, "u", page(NAV)), (3, "w", page("<article><p>" + "é word " * 200_000))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = sorted(((r["page_id"], r["url"], r["n_chars"], len(r["text"])) for r in pages.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", len(WANT), len(WANT)), (2, None, 0, 0), (None, "v", 0, 0), (1, "u", 0, 0), (3, "w", 1_399_999, 1_399_999)], key=repr)
    assert pages.extract(df.limit(0)).count() == 0


LONG = "A paragraph of the article with a good many words in it, long enough to be content by its ratio alone. "


@pytest.mark.parametrize(
    "part, text",
    [
        ("<pre><code>x = 1 <span class='hljs-comment'># why</span></code></pre>", "x = 1 # why"),
        ("<pre><div class='comment'>kept</div></pre>", "kept"),
        ("<p class='notice-period'>The notice period is a month.</p>", "The notice period is a month."),
        ("<p>Click <span class=share>share</span> to go on.</p>", "Click share to go on."),
        ("<div id='related-work'><p>Related work.</p></div>", "Related work."),
        ("<section class='social-history'><p>A social history.</p></section>", "A social history."),
        ("<div class='ad-box'>Buy</div><div class='x comments-area'><p>Me too</p></div><p>On.</p>", "On."),
    ],
)
def test_names_inside_the_article(part, text):
    assert pages.main_text(page(f"{NAV}<article>{ARTICLE}{part}</article>")) == f"{WANT}\n{text}"


def test_an_article_in_parts():
    two = pages.main_text(page(f"{NAV}<div><article><p>One. {LONG}</p></article><article><p>Two. {LONG * 2}</p></article><article><p>Teaser</p></article></div>"))
    assert two.split("\n") == [f"One. {LONG}".strip(), f"Two. {LONG * 2}".strip()]


def test_lists_where_nothing_says_article():
    references = "".join(f"<li>Author {i}: <a href=x>A work with quite a long title, in its second edition</a>, 19{i}</li>" for i in range(10, 20))
    text = pages.main_text(page(f"<div>{NAV.replace('nav>', 'div>')}<p>{LONG * 3}</p><p>{LONG * 2}</p><ol>{references}</ol></div>"))
    assert text.count("Author") == 10 and "Home" not in text
    # no tag names the article: the clusters find the element that holds it
    menus = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(30))
    assert pages.main_text(page(f"<div>{menus}</div><div><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2}</p></div><div>{menus}</div>")).split("\n") == [
        (LONG * 3).strip(), "Short.", (LONG * 2).strip()]


@pytest.mark.parametrize("n", [4000])
def test_deep_pages_take_linear_time(n):
    import time

    start = time.perf_counter()
    text = pages.main_text("<article>" + "<div><p>some text" * n)
    assert text.count("some text") == n and pages.main_text("<article>" + "<div>x" * n + "</div>y" * n + "</article>").count("\n") == 2 * n - 1
    assert time.perf_counter() - start < 4


def test_clusters_against_a_plain_version():
    import math
    import random

    import numpy as np

    rng = random.Random(1)
    weight = [math.exp(-0.5 * d * d) for d in range(-3, 4)]
    for _ in range(200):
        ratios = [rng.choice([0.0, rng.uniform(0, 300)]) for _ in range(rng.randint(1, 40))]
        at = lambda i: ratios[min(max(i, 0), len(ratios) - 1)]
        smooth = [sum(w * at(i + d) for w, d in zip(weight, range(-3, 4))) / sum(weight) for i in range(len(ratios))]
        mean = sum(smooth) / len(smooth)
        bound = min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))
        got = pages.clusters(np.array(ratios))
        assert all(g == (x >= bound) or abs(x - bound) < 1e-9 for g, x in zip(got, smooth))
