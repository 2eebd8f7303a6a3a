from lumenmatch.llm import article

PARTS = [
    '<h2 id="notice-period">Notice period</h2>',
    '<p class="social-history">Paragraph on social history</p>',
    '<section id="related-work"><h3 class="banner">Related work</h3><p>of <span class="share">others</span> here</p></section>',
    '<div class="entry-content has-sidebar"><p>Words in a layout column</p></div>',
    "<p>where <math><mi>x</mi></math> is large</p>",
    "<video><p>Transcript of the film</p></video>",
]
WANT = "Notice period\nParagraph on social history\nRelated work\nof others here\nWords in a layout column\nwhere x is large\nTranscript of the film"


def test_names_drop_nothing_of_an_article():
    for tag in ("article", "main"):
        assert article.main_text(f"<body><{tag}>{''.join(PARTS)}</{tag}>", {}) == WANT
    assert article.main_text('<body><div class="entry-content has-sidebar"><h2 id="notice-period">A head</h2><p>Words</p></div>', {}) == "A head\nWords"


def test_adverts_and_comments_still_go():
    page = '<main><article><p>Own text</p><div class="box ad"><p>buy</p></div><ul class="share"><li>x</ul><p>goes on</p></article><section id="comments"><article><p>nice words</p></article></section></main>'
    for extra in ("", '<div class="site-sidebar"><div><p>many words of a side column</p></div></div>'):
        assert article.main_text(f"<body>{extra}{page}{extra}", {}) == "Own text\ngoes on"
    assert article.main_text('<div><p>One two three</p><div class="sidebar"><p>' + "side " * 99 + "</p></div><p>four five six</p></div>", {}) == "One two three\nfour five six"


def test_words_against_a_container_are_learnt(spark):
    """Where pages show that such a container holds their text, it is kept."""
    body = '<div id="social"><p>{}</p></div>'
    pages = [(i, "u", f"<main>{body.format('own words ' * 9)}</main>") for i in range(30)] + [(99, "u", body.format("plain words of a page"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in article.extract_articles(df).collect()}[99] == "plain words of a page"
    assert article.main_text(pages[-1][2], {}) == ""
