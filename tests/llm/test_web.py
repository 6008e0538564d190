import re
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom.llm import extraction, queries, warc


def test_extraction_gives_the_articles(data):
    pages = duckdb.sql(f"select html from '{data}/pages.parquet'").fetchall()
    for (html,) in pages:
        article = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert extraction.main_text(html) == "\n".join(p for p in parts if p)


GOOD = "This is a paragraph of the article that goes on for a while, and it has many of the words that are in any text, so that it is easy to tell it from what is on the page beside it and not a part of it at all."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        (f"<body><nav><a href=x>Home</a></nav><div><p>{GOOD}</p><p>Short end.</p></div><footer>imprint of the site</footer>", f"{GOOD}\nShort end."),
        (f"<article><h1>Title</h1><p>{GOOD}<p>A &lt;b&gt; &amp;amp; c</article><div class='comments'><p>{GOOD}</p></div>", f"Title\n{GOOD}\nA <b> &amp; c"),
        (f"<main><p>{GOOD}</p><aside><p>{GOOD}</p></aside><form><p>{GOOD}</p></form><script>var a = '<p>{GOOD}</p>'</script><table><tr><td>1</td><td>x</td></tr></table></main>", f"{GOOD}\n1\nx"),
        (f"<div id='cookie-notice'><p>{GOOD}</p></div><!-- <p>{GOOD}</p> --><style>p{{}}</style><div><h2>Head</h2>\n<p>{GOOD}</p></div>", f"Head\n{GOOD}"),
        ("<p>" + "<b>" * 3000 + "x", ""),
        ("a < b & c > d <p title='>'>" + GOOD, f"a < b & c > d\n{GOOD}"),
    ],
)
def test_extraction_cases(html, want):
    assert extraction.main_text(html) == want


LINK = "<a href=x>Another page of the site with a long name that is linked</a>"


@pytest.mark.parametrize(
    "html",
    [
        f"<article class='post has-sidebar'><p>{GOOD}</p></article>",
        f"<div class='content with-comments'><p>{GOOD}</p></div>",
        f"<body class='sidebar'><div class=share-price><p>{GOOD}</p></div></body>",
        f"<article><section class='related-work'><p>{GOOD}</p></section></article>",
        f"<div class='widget'><main><p>{GOOD}</p></main></div>",
        f"<article class='sponsored notice'><p>{GOOD}</p></article>",
        f"<div id='menuOfTheDay' title='a hidden gem'><p>{GOOD}</p></div>",
        f"<form action=x><div><p>{GOOD}</p></div></form>",
        f"<form><article><p>{GOOD}</p></article></form>",
        f"<article><p>{GOOD}</p></article><article class='comment'><p>{GOOD}</p></article>",
        f"<article><p>{GOOD}</p><ul><li>{LINK}</li><li>{LINK}</li></ul></article>",
        f"<article><p>{GOOD}</p><div id=comments><article><p>{GOOD}</p></article></div></article>",
        f"<div id='siteHeader'><p>{GOOD}</p></div><div><p>{GOOD}</p></div><div role=contentinfo>{GOOD}</div>",
        f"<div class='related-posts'><p>{GOOD}</p></div><div class='entry-content'><p>{GOOD}</p></div><ul class='share_buttons'><li>{GOOD}</li></ul>",
        f"<div style='display: none'>{GOOD}</div><div hidden>{GOOD}</div><section><p>{GOOD}</p></section><div class='ad-slot-3'>{GOOD}</div>",
        f"<table><tr><td class='sidebar-left'>{GOOD}</td><td>{GOOD}</td></tr></table>",
    ],
)
def test_marks_bar_what_they_name_and_no_more(html):
    assert extraction.main_text(html) == GOOD


SHORT_LINK = "<a href=x>A source of the article</a>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<h2 id='advertising'>Advertising</h2>", "Advertising"),
        ("<h2 id='comments'>Comments</h2>", "Comments"),
        (f"<section id='navigation'><p>{GOOD}</p></section>", GOOD),
        (f"<section id='search'><h3 id=search-form>Search</h3><p>{GOOD}</p></section>", f"Search\n{GOOD}"),
        (f"<div class='widget'><p>{GOOD}</p></div>", GOOD),
        (f"<blockquote><p>{GOOD}</p><footer>Some Body</footer></blockquote>", f"{GOOD}\nSome Body"),
        ("<p>Press <button>Start</button> and wait for it.</p>", "Press Start and wait for it."),
        (f"<ul><li>{SHORT_LINK}</li><li>{SHORT_LINK}</li></ul>", "A source of the article\nA source of the article"),
    ],
)
def test_parts_of_an_article_stay(inner, want):
    assert extraction.main_text(f"<article><p>{GOOD}</p>{inner}<p>{GOOD}</p></article>") == f"{GOOD}\n{want}\n{GOOD}"


@pytest.mark.parametrize(
    "part",
    [
        f"<div class='response'><p>{GOOD}</p></div>",
        f"<section class='more-stories'><p>{GOOD}</p></section>",
        f"<div class='google-auto-placed'><p>{GOOD}</p></div>",
        f"<div class='cookie-law-info'><p>{GOOD}</p></div>",
        f"<div class='dateline share-tools'><p>{GOOD}</p></div>",
        f"<section id='x' class='comments'><p>{GOOD}</p></section>",
        f"<div itemprop='comment'><p>{GOOD}</p></div>",
        f"<footer><p>{GOOD}</p></footer>",
    ],
)
def test_parts_beside_and_inside_an_article_go(part):
    assert extraction.main_text(f"<article><p>{GOOD}</p>{part}</article>") == GOOD
    assert extraction.main_text(f"<article><p>{GOOD}</p></article>{part}") == GOOD


@pytest.mark.parametrize("mark", ["class='comment'", "class='comment-body'", "id='response-7'", "class='related-post'", "itemprop=comment", "class=teaser"])
def test_a_comment_or_teaser_is_never_the_main_text(mark):
    assert extraction.main_text(f"<article></article><article {mark}><p>{GOOD}</p></article>") == ""
    assert extraction.main_text(f"<article></article><div {mark}><article><p>{GOOD}</p></article></div>") == ""
    assert extraction.main_text(f"<form><div {mark}><p>{GOOD}</p></div></form>") == ""


def test_links_and_short_parts_of_articles():
    linked = "Most of this <a href=x>paragraph of the article is a link and it stays in the text</a> with the rest of it."
    page = f"<article><h1>Head</h1><p>{GOOD}</p><p>{linked}</p><p><a href=x>Yes.</a></p><ul><li>One</li><li>Two</li></ul><figure><figcaption>A view</figcaption></figure><pre>x = 1</pre><p>{GOOD}</p></article>"
    plain = re.sub("<[^>]*>", "", linked)
    assert extraction.main_text(page) == "\n".join(["Head", GOOD, plain, "Yes.", "One", "Two", "A view", "x = 1", GOOD])
    assert extraction.main_text(f"<div><p>{GOOD}</p></div><div>{LINK} {LINK} and so on</div><div><figure><figcaption>{GOOD}</figcaption></figure></div>") == f"{GOOD}\n{GOOD}"


def test_long_and_repeated_pages(spark):
    page = "<article>" + f"<p>{GOOD}</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page), (1, "u", page), (1, "u", "<div>" * 50_000 + GOOD)], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in extraction.extract(rows).collect())
    assert got[0] == (1, "u", GOOD, len(GOOD)) and got[1] == got[2] == (1, "u", "\n".join([GOOD] * 20_000), 20_000 * len(GOOD) + 19_999)


PAGES = "page_id long, url string, html string"


def test_captions_formulas_and_other_languages():
    words = "The text of the article is what it is and it has to be of some length to be seen as good by the rules that are in use here. "
    page = f"<article><p>{words * 2}</p><figure><figcaption>{words}</figcaption></figure><p>{words * 2}<math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>"
    got = extraction.main_text(page)
    assert got.count(words.strip()) == 5 and got.endswith("x=1")
    polish = "Każdy człowiek rodzi się wolny oraz równy względem swojej godności, dlatego wszyscy powinni postępować wobec innych życzliwie. "
    links = "<div>" + "<a href='x'>Strona główna serwisu</a> " * 6 + "</div>"
    assert extraction.main_text(f"<html><body>{links}<div>{polish * 3}</div><div>{polish * 2}</div></body></html>") == f"{(polish * 3).strip()}\n{(polish * 2).strip()}"


def test_extraction_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None), (None, None, f"<article><p>{GOOD}</p></article>"), (2, "u", "")], PAGES).withColumn("text", F.lit("clash"))
    assert {tuple(r) for r in extraction.extract(rows).collect()} == {(1, "u", "", 0), (None, None, GOOD, len(GOOD)), (2, "u", "", 0)}
    assert extraction.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_surt():
    assert warc.surt("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.surt("http://m.example.org:8080") == "org,example,m:8080)/"
    assert warc.surt(None) == "-" and warc.surt("http://[bad") == "http://[bad" and warc.surt("x y") == "x%20y"


def test_round_trip_of_payloads(spark):
    data = [(5, "http://a.example/x", "<p>é</p>\r\n\r\n"), (3, "http://a.example/y", "<p>é</p>\r\n\r\n"), (9, None, None), (None, "http://b.example", ""), (7, "http://a.example/x", "other"), (7, "http://a.example/x", "other"), (8, "u\r\nX: 1", "z" * 100_000)]
    rows = spark.createDataFrame(data, PAGES).withColumns({"file": F.lit(1), "sha1": F.lit(2)})
    got = sorted(map(tuple, warc.archive_and_read(rows, with_payload=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("payload").cast("string")).collect()), key=str)
    html = {i: (h or "").encode() for i, _, h in data}
    assert len(got) == 7
    for i, n, sha1, kind, first, payload in got:
        assert (n, sha1) == (len(html[i]), warc.digest(html[i]))
        assert payload.encode() == (b"" if kind == "revisit" else html[i])
        assert (kind, first) == {5: ("revisit", 3), None: ("revisit", 9)}.get(i, ("response", None))
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_index_finds_every_key(spark, tmp_path):
    rows = [(f"com,a{i % 50})/{i % 7}", i % 90 if i % 11 else None, f"f{i % 3}", i, 1, "response") for i in range(1000)]
    manifest = spark.createDataFrame(rows, "surt string, page_id long, file string, offset long, length long, record_type string")
    parts = warc.index(manifest, str(tmp_path), lines=16)
    assert sum(p["lines"] for p in parts) == 1000 and sum(p["blocks"] for p in parts) >= 62
    reader = warc.Reader(f"file:{tmp_path}", parts, keep=2)
    for s, i in {(r[0], r[1]) for r in rows}:
        assert sorted(x[3] for x in reader.find(warc.sort_key((s, i)))) == sorted(r[3] for r in rows if r[:2] == (s, i))
    assert list(reader.find(warc.sort_key(("zz", 1)))) == []


def test_query_equals_sql(spark, data):
    from specloom.llm.sql import SQL

    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{data}/pages.parquet'")
    assert sorted(map(tuple, queries.op4_warc(spark, data).collect())) == sorted(c.execute(SQL["op4_warc"]).fetchall())
