import time

from pyspark.sql import functions as F

from claimspark.functions import html, text
from claimspark.operators import scrape
from claimspark.schemas import PAGES

LONG = "Long enough to be kept. " * 10



def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumnRenamed("page_id", "article_id")


def test_metadata_in_any_attribute_order(spark):
    source = (
        "<html><head><title> A &amp;\n B </title>"
        "<meta content='Who, \"x\"' name='author'>"
        '<meta property="og:description" content="It\'s about &lt;things&gt;">'
        '<META NAME="date" CONTENT="2024-01-02"></head><body></body></html>'
    )
    row = scrape.page_metadata(pages(spark, [(1, "http://a", source)])).first()
    assert (row.title, row.author, row.description, row.date) == (
        "A & B", 'Who, "x"', "It's about <things>", "2024-01-02"
    )


def test_metadata_absent_is_empty(spark):
    row = scrape.page_metadata(pages(spark, [(1, "http://a", "<p>x"), (2, "http://b", None)])).collect()
    assert all((r.title, r.author, r.description, r.date) == ("", "", "", "") for r in row)


def test_main_text_falls_back_to_body(one):
    source = (
        "<html><head><title>T</title></head><body><nav>menu</nav><header>top</header>"
        "<!-- ad --><script>x('<p>')</script><p>One&nbsp;<b>two</b></p><footer>end</footer></body></html>"
    )
    assert one(html.main_text, [source]) == ["One two"]
    assert one(html.main_text, ["<body><article>in</article>out</body>"]) == ["in"]
    assert one(html.main_text, ["&amp;lt; stays a reference"]) == ["&lt; stays a reference"]


def test_scrape_keeps_usable_and_explains_the_rest(spark):
    rows = [
        (1, "https://x.org/good-page", f"<title></title><article>{LONG}</article>"),
        (2, "https://x.org/b", f"<title>Named</title><article>{LONG}</article>"),
        (3, "https://x.org/c", ""),
        (4, "https://x.org/d", None),
        (5, "https://x.org/e", "<p> </p>"),
        (6, "https://x.org/f", "<article>short</article>"),
    ]
    df = pages(spark, rows)
    kept = {r.article_id: r for r in scrape.scrape(df).collect()}
    assert {k: r.title for k, r in kept.items()} == {1: "Good Page", 2: "Named"}
    assert kept[1].content == LONG.strip()
    rejected = {r.article_id: r.reject for r in scrape.scrape_rejects(df).collect()}
    assert rejected == {3: "download", 4: "download", 5: "extract", 6: "content"}
    counts = scrape.scrape_counts(df).first()
    assert (counts.total_urls, counts.scraped, counts.rejected_download) == (6, 2, 2)


def test_page_text_is_worked_on_once(spark):
    df = scrape.scrape(pages(spark, [(1, "https://x.org/a", LONG)])).where(F.col("title") != "")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(html.INVISIBLE[:20]) == 1


def test_broken_pages_are_read_in_linear_time(one):
    """Many opening marks without a closing one: a quadratic scan would take minutes."""
    size = 100_000
    marks = ["<script ", "<!-- ", "<article ", "<", "<meta ", "<title>", "<nav ", "<p>x"]
    broken = [mark * size for mark in marks]
    start = time.monotonic()
    texts = one(html.main_text, broken)
    one(html.title, broken)
    one(lambda c: html.meta(c, "author"), broken)
    one(text.strip, ["a" + " " * size + "b"])
    assert time.monotonic() - start < 60
    assert texts[0] == texts[1] == "" and len(texts[7]) == 2 * size - 1


def test_unclosed_elements_reach_to_the_end(one):
    assert one(html.main_text, ["<p>in</p><script>x"]) == ["in"]
    assert one(html.main_text, ["<article>all <b>of</b> it"]) == ["all of it"]
    assert one(html.title, ["<head><title>Open</head><body>text"]) == ["Open"]
