import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmatch.llm import article
from lumenmatch.llm.queries import op7_article

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies <b>ok</b></div><nav><ul><li>Home<li>About</ul>
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
 three.<div class="ad">buy this now</div><p>Four&nbsp;&eacute; five<br>six<script>var t="</p>";</script><!-- gone <p> -->
<form>Name <input></form><blockquote>Quote 3 < 4</blockquote></article>
<section id="comments"><h2>Comments</h2><p>great article, thanks a lot for writing it</p></section></main>
<aside>Related things here</aside><footer>&copy; 2020</footer><script>var a="<p>hi</p>"</script></body>"""
TEXT = "Title & more\nOne two three.\nFour é five six\nQuote 3 < 4"


def test_article_of_a_full_page():
    assert article.main_text(PAGE, {}) == TEXT


def test_menus_without_an_end_hide_nothing():
    assert article.main_text("<body><nav><a>Home</a><article><p>Some text here", {}) == "Some text here"
    assert article.main_text("", {}) == article.main_text("<nav>menu</nav>", {}) == article.main_text("<p> &nbsp; </p>", {}) == ""


def test_best_region_in_one_scan():
    assert article.best_region([1, -3, 2, 2, -1, 3, -9, 4]) == (2, 6)
    assert article.best_region([-1, -2]) == article.best_region([]) == (0, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-5, 5), max_size=12))
def test_best_region_is_the_best(scores):
    a, b = article.best_region(scores)
    assert sum(scores[a:b]) >= max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0) - 1e-9


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ap\"'=! divscrt-&;x", max_size=60))
def test_any_bytes_give_a_text(page):
    assert isinstance(article.main_text(page, {}), str)


def test_weights_shut_out_what_stands_beside_articles(spark):
    side = '<div class="teaser"><p>{}</p></div>'
    pages = [(i, "u", side.format("more words of another page " * 3) + f"<article><p>{'own words ' * 9}{i}</p></article>", "t") for i in range(30)]
    pages.append((99, "u", side.format("more words of another page " * 3) + "<div><p>plain words of a page without marks</p></div>", "t"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in article.extract_articles(df).collect()}
    assert got[3] == "own words " * 9 + "3" and got[99] == "plain words of a page without marks"


def test_hostile_pages(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "u", "", 1), (2, "u", "<p>" + "long " * 50000, 1), (3, "u", "<" * 5000, 1), (4, "u", "<a " + "x='" * 3000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = article.extract_articles(df).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 2] == [("long " * 50000).strip()]
    assert article.extract_articles(df.limit(0)).count() == 0


def test_query_against_mark_up(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op7_article(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:h1|p)>", "\n", inner.replace("\n", " ").replace("<br>", " "))).split("\n")
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
