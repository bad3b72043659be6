"""Extraction of broken, odd and templated pages, and of the tables' pages against a plain reading of them."""

import html as entities
import re

from reachwell.llm import html, queries
from reachwell.llm.common import table

SF = "/root/testdata/sf0.001"


def text(page):
    return html.Page(page).text([])


def test_drawings_and_unclosed_elements():
    assert text("<body><article><h1>T</h1><svg viewBox='0 0 1 1'/><p>Body text.</p></article></body>") == "T Body text."
    assert text("<body><article><h1>T</h1><p>One <svg><path d=1><title>x</title></svg>two.</p></article></body>") == "T One two."
    assert text("<body><article><h1>T</h1><svg><path d=1><p>Body text.</p></article></body>") == "T Body text."
    assert text("<body><article><p>Long <noscript>off</p><p>body text.</p></article></body>") == "Long body text."
    assert text("<body><article><p>A.</p><template><p>No.</p></template><p>B.</p></article></body>") == "A. B."
    assert text("<body><p>A <b>b</p><p>C</b> d<br>e</p><script>x</body>") == "A b C d e"


def test_sibling_containers_are_one_article(spark):
    post = "<body><div class=post><div class=post-title><h1>T{0}</h1></div><div class=lead>Lead {0}.</div><div class=post-body><p>{1}</p></div></div><div class=box><a href=1>Many linked words about other pages</a></div></body>"
    pages = [(i, "http://h.example/p", post.format(i, f"The body of page {i} is here. " * (1 + i % 3))) for i in range(12)]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"T{i} Lead {i}. " + " ".join([f"The body of page {i} is here."] * (1 + i % 3)) for i in range(12)}


def test_names_of_layout_and_of_contents():
    page = "<body><article><section class='social-history'><p>Social history.</p></section><p>Rest.</p><div class='comment-list'>A reader.</div><div id=adBox>Buy.</div><div class='cookie-notice'>Ok?</div></article></body>"
    assert text(page) == "Social history. Rest."


def test_deep_and_long_pages():
    deep = "<div class=a>" * 3000 + "<p>Deep.</p>" + "</div>" * 3000
    assert text(deep) == "Deep."
    assert text("<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>") == " ".join(["word & word"] * 50_000)


def test_no_pages_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(empty).count() == 0
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [(0, ""), (1, "x"), (1, "x")]


def test_query_against_the_articles_of_the_pages(spark):
    """Every page of the tables has one article element: its blocks, without what the contract leaves out."""
    found = {r["page_id"]: r["text"] for r in queries.QUERIES["op2_html_extraction"](spark, SF).collect()}
    gone = re.compile(r"<(script|style|form|nav|aside|footer)\b.*?</\1>|<!--.*?-->", re.S)
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article\b[^>]*>(.*?)</article>", r["html"] or "", re.S)
        if article is None:
            continue
        whole = gone.sub(" ", article[1])
        words = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", whole)).split())
        squeezed = "".join(words.split())
        assert "".join(found[r["page_id"]].split()) in squeezed
        assert len("".join(found[r["page_id"]].split())) > 0.6 * len(squeezed)


def test_what_a_host_repeats_beside_its_articles(spark):
    """Adverts and footers in plain containers stand in the same words on every page; the article doesn't."""
    page = "<body><div class=story><h1>T{0}</h1><p>{1}</p></div><div class=xk29>Buy our shoes now for half of the price, today only.</div><div class=copy>Copyright 2020 by the paper.</div></body>"
    pages = [(i, "http://h.example/p", page.format(i, f"The body of page {i} is here. " * (2 + i % 3))) for i in range(12)]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"T{i} " + " ".join([f"The body of page {i} is here."] * (2 + i % 3)) for i in range(12)}


def test_repeated_text_within_an_article_stays(spark):
    page = "<body><article><div class=a><p>{0} is the subject of this page and of its text.</p></div><div class=b><p>This text is free to use.</p></div></article><div class=z>All about us, on every page.</div></body>"
    pages = [(i, "http://h.example/p", page.format(f"Number {i}")) for i in range(12)]
    rows = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host string, paths string, repeated string".split(", host")[0])).collect()
    assert {r["text"] for r in rows} == {f"Number {i} is the subject of this page and of its text. This text is free to use." for i in range(12)}


def test_readers_comments_by_name():
    assert text("<body><article><p>Body.</p><div class=reader-responses>I think so too.</div><div class=user-comments>No.</div></article></body>") == "Body."
    assert text("<body><article><div class=reader><p>Body.</p></div></article></body>") == "Body."


def test_ties_of_votes_and_clashing_columns(spark):
    pages = [(i, "http://t.example/", f"<body><div class={'a' if i % 2 else 'b'}><p>Text of page {i}, as long as the others.</p></div></body>", "x", "y") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, path string")
    found = [sorted(map(tuple, html.extract(d).collect())) for d in (df, df.repartition(5))]
    assert found[0] == found[1] == [(i, "http://t.example/", f"Text of page {i}, as long as the others.") for i in range(8)]
