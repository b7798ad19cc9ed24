"""Parts of pages and searches by value against fixtures and brute force."""

import random

import pytest

from tallymark.operators import pages, search

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title> A &amp; B
 page </title><title>second</title><meta name="Description" content=" What it is "><meta property="og:title" content="O"><meta name="description" content="again">
<base href="https://x.org/dir/"><script>var t = "<p>no</p>";</script><script type="application/ld+json">[{"b": 1, "a": [2]}, "s"]</script><script type="application/ld+json">{broken</script></head>
<body><!-- gone --><h2>Head <b>line</b></h2><p>One &lt;two&gt;<br>three <a href="a.html#f">link <i>text</i></a> and <a href='//y.org/z'></a></p>
<ul><li>first<ol><li>inner</ol><li>last</ul><img src="i.png" alt="pic"><img src="/j.png"><a href="http://[bad">bad</a><style>p{}</style><blockquote>said</blockquote><p>open"""


def test_page_parts():
    title, meta, links, images, data, text, marked = pages.parsed(PAGE, "https://site.net/q?x=1")
    assert title == "A & B page"
    assert meta == {"charset": "utf-8", "description": "What it is", "og:title": "O"}
    assert links == ["https://x.org/dir/a.html#f", "https://y.org/z", "http://[bad"]
    assert images == ["https://x.org/dir/i.png", "https://x.org/j.png"]
    assert data == ['{"a": [2], "b": 1}', '"s"']
    assert text.split("\n") == ["Head line", "One <two>", "three link text and", "first", "inner", "last", "pic bad", "said", "open"]
    assert marked.split("\n") == ["## Head line", "One <two>", "three [link text](https://x.org/dir/a.html#f) and", "- first", "1. inner", "- last", "![pic](https://x.org/dir/i.png) ![](https://x.org/j.png) [bad](http://[bad)", "> said", "open"]
    assert pages.parsed(None, None) == ("", {}, [], [], [], "", "") == pages.parsed("", "u")
    assert pages.parsed("<title>open", None)[0] == "open" and pages.parsed("<a href=b>" * 3000 + "<div>" * 3000, "http://h/")[2] == ["http://h/b"] * 3000


def test_pages_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/", "<title>t</title><a href='x'>y</a>", "c"), (2, None, None, None)], "id int, url string, html string, title string")
    rows = {r.id: r for r in pages.extract(df, "id", "url", "html").collect()}
    assert rows[1].title == "t" and rows[1].links == ["http://h/x"] and rows[1].text == "y" and rows[2].text == "" and rows[2].meta == {}
    assert pages.extract(df.limit(0), "id", "url", "html").count() == 0


@pytest.mark.parametrize("mode", ["exact", "prefix"])
def test_searches_by_value(spark, mode):
    rng = random.Random(3)
    docs = [(k, rng.choice([None, "", "  ", "Ab", "ab c", "ABC d", " ab", "b", "a", "abc"])) for k in range(200)]
    asked = [(k, t) for k, t in enumerate([None, "a", "AB", "abc ", "zz", "b", "ab", "a"])]
    norm = lambda t: (t or "").strip().lower()
    want = set()
    for q, t in asked:
        hits = [d for d, x in docs if (norm(x) == norm(t) if mode == "exact" else norm(x).startswith(norm(t)))]
        want |= {(q, d, r) for r, d in enumerate(sorted(hits, reverse=True)[:5], 1)}
    got = search.value_hits(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), mode, 5).collect()
    assert len(got) == len(want) and {(r.query_id, r.doc_id, r["rank"]) for r in got} == want
    empty = spark.createDataFrame([], "query_id long, text string")
    assert search.value_hits(empty, spark.createDataFrame(docs, "doc_id long, text string"), mode, 5).count() == 0


def test_titles_keep_unfinished_references():
    of = lambda title: pages.parsed(f"<p>a &amp b</p><title>{title}</title><title>&lt;</title><p>c &lt d", None)
    assert [of(t)[0] for t in ("x &amp;&amp;&amp", "&amp", "&ampx; &lt;b&gt; &quot", "a &#38; &#38 &nbsp;b", "&#; x")] == ["x &&&amp", "&amp", "&ampx; <b> &quot", "a & &#38 b", "&#; x"]
    assert of("x")[5] == "a & b\nc < d"
