"""Page operators: held-out accuracy, odd markup, url rules."""

import pytest

pytest.importorskip("seqsieve.llm")
from pyspark.sql import functions as F  # noqa: E402

from seqsieve.llm import html_extract, labelled_pages, url_filter  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return html_extract.train(labelled_pages.labelled_pages())


def test_held_out_pages(model):
    wrong = total = 0
    for page in labelled_pages.labelled_pages(100, seed=99):
        nodes, labels = html_extract.parse(page), []
        for n in nodes:
            labels.append(int(n.label) if n.label in ("0", "1") else labels[n.parent] if n.parent >= 0 else 0)
        one, _ = html_extract.Forest([nodes]).marginals(*model)
        total += sum(n.chars for n in nodes)
        wrong += sum(n.chars for n, a, b in zip(nodes, labels, one, strict=True) if (b > 0.5) != a)
    assert wrong / total < 0.02


def test_marginals_against_enumeration(model):
    from itertools import product

    import numpy as np

    nodes = html_extract.parse('<body><nav><a href="/">x</a></nav><div><p>Some text here.</p><p>More.</p></div></body>')
    forest = html_extract.Forest([nodes])
    w, ties = model
    one, _ = forest.marginals(w, ties)
    unary, sums = forest.unary(w), np.zeros((len(nodes), 2))
    for labels in product((0, 1), repeat=len(nodes)):
        e = sum(unary[i] * x for i, x in enumerate(labels)) + sum(ties[forest.tie[i], labels[n.parent], labels[i]] for i, n in enumerate(nodes) if n.parent >= 0)
        for i, x in enumerate(labels):
            sums[i, x] += np.exp(e)
    assert np.allclose(one, sums[:, 1] / sums.sum(axis=1))


def test_pages_with_one_article(spark, data, model):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = html_extract.extract_pages(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    bad = 0
    for r in got:
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        words = html_extract.html.unescape(html_extract.re.sub(r"<[^>]*>?", " ", body)).split()
        bad += words != r["text"].split()
        assert r["n_chars"] == len(r["text"]) and "  " not in r["text"]
    assert bad <= len(got) * 0.01


LINE = "The river runs past the old mill and through the town, where people meet each morning to talk about the weather and trade. "
RARE = {
    "paragraphs in a block with a name that says nothing": (f'<body><div class="c2"><p>{LINE * 2}</p><p>{LINE * 2}</p></div></body>', LINE * 4),
    "plain nested blocks": (f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><div><div><div>{LINE * 2}</div><div>{LINE}</div></div></div><footer>Copyright 2020</footer></body>", LINE * 3),
    "a paragraph of links": (f"<body><article><p>{LINE}</p><p><a href=/x>One long linked phrase here</a> and <a href=/y>another linked phrase</a>.</p></article></body>", LINE + "One long linked phrase here and another linked phrase."),
    "a list of links": (f"<body><article><h1>Sources</h1><p>{LINE}</p><ul><li><a href=/x>First source of the text</a></li><li><a href=/y>Second source</a></li></ul></article></body>", "Sources " + LINE + "First source of the text Second source"),
    "details": (f"<body><main><p>{LINE}</p><details><summary>More</summary><p>{LINE}</p></details></main></body>", LINE + "More " + LINE),
    "a formula": (f"<body><article><p>{LINE}<math><mi>x</mi></math> is small.</p></article></body>", LINE + "x is small."),
}


@pytest.mark.parametrize("name", RARE)
def test_pages_that_the_training_pages_do_not_hold(model, name):
    page, want = RARE[name]
    assert html_extract.extract([page], model)[0].split() == want.split()


SAID = "I must say that I did not agree with what was written about the river, as my own village has seen quite another story in the years since."
BESIDE = {
    "comments in a section": f'<section class="user-comments"><p>{SAID}</p></section>',
    "a thread of comments": f'<div id="disqus_thread"><p>{SAID}</p></div>',
    "comments": f'<div class="comments"><p>{SAID}</p><p>{SAID}</p></div>',
    "a footer": '<div class="footer">&copy; 2020 Some Company Limited, all rights reserved in every country</div>',
    "an advert": f'<div class="sponsored"><p>{SAID}</p></div>',
    "an advert without a paragraph": f'<div class="sponsored">{SAID}</div>',
    "a privacy notice": '<div id="gdpr"><p>We use cookies to give you the best experience on our site and to measure what readers like, please accept them all.</p></div>',
    "a notice": '<div class="alert" role="alert">Our office is closed on Monday because of the public holiday, and we open again on Tuesday morning.</div>',
}
STORY = "".join(f"<p>This is paragraph {i} of the article, and it tells a story about the mill and the people in some detail.</p>" for i in range(4))


@pytest.mark.parametrize("name", BESIDE)
@pytest.mark.parametrize("page", ["<article><h1>A title</h1>{0}</article>{1}", "<article><h1>A title</h1>{0}{1}</article>", '<div class="content"><h1>A title</h1>{0}</div>{1}'])
def test_parts_that_read_like_content_go(model, name, page):
    got = html_extract.extract([f"<html><body>{page.format(STORY, BESIDE[name])}</body></html>"], model)[0]
    assert got.split() == html_extract.re.sub("<[^>]*>", " ", f"A title {STORY}").split()


def test_tags_without_partner_take_linear_time():
    import time

    began = time.process_time()
    html_extract.parse("<b>" * 100_000 + "</i>" * 100_000 + "</section>" * 100_000)
    assert time.process_time() - began < 5


def test_odd_pages(spark, model):
    odd = [(1, None), (2, ""), (3, "<p>cut off &am"), (4, "<script>var a='<p>x</p>'"), (5, "<div><p>A short text. &lt;x&gt; &eacute;</p></div>"), (6, "<" * 5000), (7, "<p>" * 3000 + "deep"), (7, "<p>again</p>"), (None, "<!-- never closed <p>x"), (8, "<p>" + "long text. " * 20_000 + "</p>")]
    df = spark.createDataFrame(odd, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_extract.extract_pages(df, model).collect()
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 7}
    assert len(got) == len(odd) and by[1] == by[2] == by[4] == by[None] == "" and by[5] == "A short text. <x> é" and by[8] == ("long text. " * 20_000).strip()
    assert html_extract.extract_pages(df.where("false"), model).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_rules(spark):
    urls = [(1, "HTTP://A.Example.NET/en/1?x"), (2, "http://xexample.net/en/1"), (3, "http://example.com/de/"), (4, "http://example.com/DE/"), (5, "http://a.b.org/fr/#x"), (6, "http://net?x/"), (7, "no url"), (8, None), (9, "http://a.net"), (10, "a://b://c"), (10, "a://b://c"), (None, "http://a.net/é")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit(0)).withColumn("host", F.lit("h"))
    weights = url_filter.fit(url_filter.labelled_table(spark))
    got = url_filter.judge_urls(df, weights, RULES).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls)
    assert by[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and by[2][2:] == ("net/", "block") and by[3][2:] == ("example.com/de/", "block")
    assert by[4][2] is None and by[5][1:] == ("/fr/", "org/fr/", "allow") and by[6][:3] == ("net", "", None) and by[9][2] is None
    assert by[7] == by[8] == ("", "", None, "allow") and by[10][:2] == ("b:", "//c") and by[None][2] == "net/"
    assert url_filter.judge_urls(df.where("false"), weights, RULES).count() == 0


def test_url_model_on_unseen_hosts(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = url_filter.judge_urls(pages, url_filter.fit(url_filter.labelled_table(spark)))
    spam = F.col("host").rlike("adult-x|spam-farm|cheap-pills|ads-track|casino-win|free-bets")
    share = {r["s"]: r["b"] for r in got.groupBy(spam.alias("s")).agg(F.avg((F.col("verdict") == "block").cast("int")).alias("b")).collect()}
    assert share[True] > 0.8 and share[False] < 0.02
    assert url_filter.fit(spark.createDataFrame([], "url string, label int"))[-1] < 0
