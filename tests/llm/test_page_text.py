"""Main text of hand-written pages with known articles."""

import pytest

from lodestone.llm.page_text import extract, main_text

BODY = "A long paragraph, with commas, and with enough words to read like the text of an article rather than a label."


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain text", "plain text"),
        (f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>{BODY}</p></article><footer>(c)</footer></body></html>", f"Title {BODY}"),
        (f"<article><p><b>{BODY}<br><p>Next &amp; last,\n  two.</p></article><footer>x", f"{BODY} Next & last, two."),
        (f"<body><div class='ad'>{BODY}{BODY}</div><div id=main><p>{BODY}</p><p>Short.</p></div><div class='comments'><p>{BODY}{BODY}</p></div>", f"{BODY} Short."),
        (f"<article><header><h1>T</h1><span>3 May</span></header><p>{BODY}</p><aside>{BODY}</aside><form>send</form></article>", f"T {BODY}"),
        (f"<article><p>{BODY}</p><script>var t='</p>';</script><style>p{{}}</style><p>a<i>b</i>c</p></article>", f"{BODY} abc"),
        (f"<article><p title='x > y'>{BODY}</p><!-- <p>no</p> --><p>1 < 2</p></article>", f"{BODY} 1 < 2"),
        (f"<article><p>{BODY}</p><ul><li>one</li><li>two</ul><p>end</p></article>", f"{BODY} one two end"),
        (f"<article><ul><li><a href=a>x</a><li><a href=b>y</a></ul><p>{BODY}</p></article>", BODY),
        (f"<div hidden><p>{BODY}</p></div><div><p>{BODY}</p></div>", BODY),
        (f"<article><p>{BODY}</p><p>broken off <a hre", f"{BODY} broken off"),
        ("<p>&#233;t&eacute;&nbsp;x</p>", "été x"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_sections_of_unequal_weight_without_article():
    first, second = f"<p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>", f"<p>{BODY}</p>"
    whole = " ".join([BODY] * 4)
    assert main_text(f"<body><section>{first}</section><section>{second}</section></body>") == whole
    assert main_text(f"<body><section>{second}</section><section>{first}</section></body>") == whole
    assert main_text(f"<body><p>Before.</p><div>{first}</div><p>Short.</p></body>") == f"Before. {' '.join([BODY] * 3)} Short."
    links = "<div><a href=a>one, two, three</a> <a href=b>four, five, six</a></div>"
    assert main_text(f"<body><div>{first}</div>{links}<p><a href=c>more</a></p></body>") == " ".join([BODY] * 3)


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + "<p>deep, deep text</p>") == "deep, deep text"
    assert len(main_text(f"<article>{'<p>' + BODY * 10 + '</p>' * 1}{'<p>tail</p>' * 5000}</article>")) > 25_000
    assert main_text('<a b="' * 2000) == ""


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "u", f"<p>{BODY}", 2), (1, "u", f"<p>{BODY}", 2)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(BODY)), (1, len(BODY))]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """In the given pages the article is one element of the same name."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S).group(1)
        pieces = [html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[row["page_id"]] == " ".join(" ".join(x.split()) for x in pieces if x.strip())
