import html as entities
import re
import time

import pytest

from passagemill.llm import maintext, queries

SF = "/root/testdata/sf0.001"


def expected(page):
    """The blocks of the one article of a generated page, by plain replacement."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = re.split(r"</?(?:p|h1|h2|ul|li)>", article)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_gives_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_maintext(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == expected(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


LONG = "This sentence is part of the story that the page tells its readers today. " * 4


@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='content'>{}</div>"])
def test_boilerplate_goes_and_short_blocks_stay(inside):
    story = f"<h2>Head</h2><p>{LONG}</p><p>No.</p><ul><li>one<li>two</ul><p>{LONG} &amp; &#233;<p>{LONG}"
    page = f"""<html><head><title>T</title><style>x</style></head><body>
    <header><a href=/>Home</a> Site name</header><nav><ul><li><a>A</a><li><a>B</a></ul></nav>
    <div id="cookie-notice">We use cookies to show you more of what you like, is that all right?</div>
    <aside><p>{LONG}</p></aside>
    {inside.format(story)}
    <div class="ad-banner">Buy now</div><form><label>Name</label><input></form>
    <section id="comments"><p>{LONG} says a reader</p></section>
    <script>var x = "<p>no</p>";</script><footer>&copy; 2020 All rights</footer></body></html>"""
    tidy = LONG.strip()
    assert maintext.main_text(page) == "\n".join(["Head", tidy, "No.", "one", "two", f"{tidy} & é", tidy])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain  text\nonly", "plain text only"), ("<<<>>> &bogus; </p></div>", None),
        ("<p>a<b>b</b>c<br>d</p>", "abc d"), ("<script>x</script>", ""), ("<p>open <i>tag", "open tag"),
    ],
)
def test_odd_pages(page, text):
    assert maintext.main_text(page) == text or text is None


def test_a_very_long_page_and_repeats(spark):
    page = "<article>" + "<p>word word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text", "url as row")
    got = sorted((str(r.page_id), len(r.text)) for r in maintext.extract(pages).collect())
    assert got == [("1", 20_000 * 15 - 1)] * 2 + [("None", 0)]
    assert maintext.extract(pages.limit(0)).collect() == []


def test_smoothing_and_threshold():
    import numpy as np

    flat = np.full(7, 3.0)
    assert np.allclose(maintext.smooth(flat), flat)
    assert 2 < maintext.threshold(np.array([1.0, 1, 2, 9, 10, 11])) < 9
    assert maintext.threshold(np.array([5.0])) <= 5


WORDS = LONG.strip()


@pytest.mark.parametrize(
    "body, text",
    [
        # a title beside the body
        (f"<div><h1>Title</h1><div class=body><p>{LONG}<p>{LONG}</div></div>", ["Title", WORDS, WORDS]),
        # sibling sections, of which one has most of the text
        (
            f"<div><section><p>{LONG * 9}</section><section><h2>End</h2><p>{LONG}<ul><li>one<li>two</ul></section></div>",
            [(LONG * 9).strip(), "End", WORDS, "one", "two"],
        ),
        # two articles
        (f"<article><p>{LONG * 9}</article><nav>Menu</nav><article><p>{LONG}</article>", [(LONG * 9).strip(), WORDS]),
        # layout classes of a wrapper, and a form around everything
        (f"<div class='page has-sidebar'><p>{LONG}<div class=sidebar>Links</div><p>{LONG}</div>", [WORDS, WORDS]),
        (f"<div class='sidebar'><p>{LONG}<p>{LONG}</div>", [WORDS, WORDS]),
        (f"<form><div><p>{LONG}<p>{LONG}</div></form>", [WORDS, WORDS]),
        # generated ids of headings and sections
        (f"<div><p>{LONG}<h2 id='related'>Related</h2><div id='related-works'><p>{LONG}</div></div>", [WORDS, "Related", WORDS]),
        # what is named is still left out, inside a line too
        (f"<div><p>{LONG}<span class='share-bar'>Share</span></p><p>{LONG}</p><div id=siteFooter>All rights</div></div>", [WORDS, WORDS]),
    ],
)
def test_the_whole_content_stays(body, text):
    page = f"<html><body><nav><a>A</a></nav>{body}<footer>Contact</footer></body></html>"
    assert maintext.main_text(page) == "\n".join(text)


def nameless(page):
    """The page without what names its parts: only divisions, and no class, id or role."""
    page = re.sub(r"<(/?)(?:article|nav|aside|header|footer|form|main|section)\b", r"<\1div", page)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)


def test_ratios_find_the_article_without_names(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = sum(maintext.main_text(nameless(p)) == expected(p) for p in pages)
    assert right >= 0.95 * len(pages)


def test_the_threshold_decides(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    monkeypatch.setattr(maintext, "threshold", lambda values: -1.0)
    right = sum(maintext.main_text(nameless(p)) == expected(p) for p in pages)
    assert right < 0.1 * len(pages)


@pytest.mark.parametrize("part", ["<p>word word word</p>", "<b><i>word</u> ", "</u>word<div>", "<p><b>word"])
def test_events_take_linear_time(part):
    begun = time.perf_counter()
    text = maintext.main_text("<div>" + part * 100_000 + "</div>")
    # Of divisions in divisions the outermost two may fall below the threshold.
    assert text.count("word") >= 99_998 and time.perf_counter() - begun < 30


def test_a_long_comment_list_goes_beside_an_article():
    page = f"<body><article><p>{LONG}</article><div class='comments'>{f'<p>{LONG}' * 9}</div></body>"
    assert maintext.main_text(page) == WORDS
