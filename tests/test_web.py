from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import html, web


def test_links(spark):
    page = '<a href="/a">1</a> <A class="x" href="http://s.org/docs/b?q=1">2</A><a href="#top">3</a><a href="/docs/b/">4</a><a href="x.html">5</a>'
    pages = spark.createDataFrame([(1, "http://s.org/docs/i", page)], "page_id long, url string, html string")
    rows = web.page_links(pages).orderBy("ord").collect()
    assert [(r.url, r.slug) for r in rows] == [("http://s.org/docs/i", "docs-i"), ("http://s.org/docs/b", "docs-b"), ("http://s.org/docs/x.html", "docs-x-html")]
    assert web.page_links(pages, max_pages=1).count() == 1
    titles = web.page_titles(spark.createDataFrame([(1, "<title>A | B | C</title>"), (2, "<title> D </title>")], "page_id long, html string"))
    assert sorted(tuple(r) for r in titles.collect()) == [(1, "A", "C"), (2, "D", "")]


def extract(text, base="http://s.org/p"):
    return html.extract(text, base, "chrome-strip")


def test_content_and_markdown():
    body = "word " * 120
    x = extract(f"<html lang=en><head><title> T </title><meta property='og:title' content=' O '></head><body><nav>menu</nav><article><header>h</header><h2>Head</h2><p>{body}<p><b>bold</b> and <a href='/x'>link</a><br>next<ul><li>one<li>two</ul><pre class='language-py'><code>x = 1\n</code></pre><script>no()</script></article></body></html>")
    assert x["title"] == "T" and x["meta"]["og:title"] == "O" and x["lang"] == "en"
    md = x["markdown"]
    assert md.startswith("## Head\n\nword") and "**bold** and [link](/x)" in md and "- one\n- two" in md and "```py\nx = 1\n```" in md and "menu" not in md and "no()" not in md
    short = extract("<body><article>short</article><p>outside</p><footer>f</footer></body>")  # under 500 letters the body counts
    assert short["markdown"] == "short\n\noutside"
    assert extract(None, None)["markdown"] == ""


def test_math():
    x = extract("<body><p>Let $x_1$ cost $5 and $6 and \\(y\\).</p><p>$$\\sum x$$</p><span class='katex'><annotation encoding='application/x-tex'>a^2</annotation></span><script type='math/tex; mode=display'>b</script><math><mi>q</mi></math><code>$z$</code></body>")
    assert "$x_1$" in x["markdown"] and "$a^2$" in x["markdown"] and "$$\n\\sum x\n$$" in x["markdown"] and "`$z$`" in x["markdown"]
    assert x["counts"]["katex"] == 1 and x["counts"]["raw_delim"] >= 3 and x["warnings"]


def test_images():
    x = extract("<body><img src='/a.png' alt=A><img data-src='/a.png'><img src='data:x'><img srcset='/b.png 2x, /c.png'><svg><title>S</title><svg></svg></svg></body>")
    assert [i["absolute"] for i in x["images"]] == ["http://s.org/a.png", "http://s.org/b.png"]
    assert x["counts"]["found"] == 5 and x["counts"]["skipped"] == 1 and x["svgs"][0]["alt"] == "S" and x["svgs"][0]["name"].startswith("svg_001_")


def test_metadata(spark):
    pages = spark.createDataFrame([(1, "u", "<html><meta name='author' content='A'><meta property='og:locale' content='de'><meta property='date' content='d'></html>"), (2, "v", None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in web.metadata_of(html.extract_pages(pages)).collect()}
    assert (rows[1].author, rows[1].language, rows[1].published, rows[1].title) == ("A", "de", "d", None) and rows[2].title is None


def test_stitch_and_profiles(spark):
    sections = spark.createDataFrame([("c", 2, "B", "u2", "bb"), ("c", 1, "A", "u1", "aa")], "crawl_id string, ord int, title string, url string, body string")
    crawl = spark.createDataFrame([("c", "http://h/x", "", None, "p", "now", ["w"])], "crawl_id string, url string, site_title string, site_name string, prefix string, fetched_at string, warnings array<string>")
    text = web.stitch(sections, crawl).first().content
    assert text.index("## A") < text.index("## B") and "title: \"Documentation crawl of h\"" in text and "*Warnings: 1" in text
    counts = "struct<found:int,downloaded:int,skipped:int,failed:int>", "struct<katex:int,mathjax_script:int,mathml:int,raw_delim:int>"
    profile = spark.createDataFrame([("c", 2, (1, 1, 0, 0), (0, 0, 0, 2), ["b"]), ("c", 1, (2, 1, 1, 0), (1, 0, 0, 0), ["a"])], f"crawl_id string, ord int, images {counts[0]}, math {counts[1]}, warnings array<string>")
    row = web.crawl_profile(profile).first()
    assert (row.images_found, row.math_raw_delim, row.inline_svgs, row.warnings) == (3, 2, 0, ["a", "b"])
    have, new = spark.createDataFrame([("a", 0)], "name string, ord int"), spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "name string, ord int")
    assert sorted(tuple(r) for r in web.merge_figures(have, new).collect()) == [("a", 0), ("b", 2)]


def test_bundles(spark):
    clip = spark.createDataFrame([(1, "T", "  body ", "", "u", None, "X", "now", [("v", "figures/image_1.png"), ("w", None)]), (2, "T", " ", None, None, None, None, "now", [])], "clip_id long, title string, text string, author string, url string, published string, platform string, fetched_at string, images array<struct<url:string,path:string>>")
    rows = web.clip_bundle(clip).collect()
    assert len(rows) == 1 and rows[0].content == '---\ntitle: "T"\nurl: u\nsite_name: "X"\nfetched_at: now\n---\n\n# T\n\nbody\n\n![image_1](figures/image_1.png)\n'
    assert '"author":null' in rows[0].metadata and '"images":{"requested":2,"downloaded":1}' in rows[0].profile
    page = spark.createDataFrame([(1, "u", "f", None, None, "now", "a\n\n\n\nb")], "page_id long, url string, final_url string, title string, author string, fetched_at string, markdown string").withColumns({c: F.lit(None).cast("string") for c in ("published", "modified", "site_name", "description", "language")})
    assert web.web_bundle(page).first().content.endswith("# u\n\na\n\nb\n")
    staged = web.stage_source(spark.createDataFrame([("bundle", "s", None, "---\ntitle: \"My\"\n---\n![a](x.png) ![b](http://y) ![c](z.png)", ["x.png"], "d")], "name string, slug string, title string, content string, files array<string>, staged string")).first()
    assert "# Source: My" in staged.text and "![a](../assets/s/x.png) ![b](http://y) ![c](z.png)" in staged.text and staged.copied == 1


def test_readability():
    text = "A paragraph of the article, which has commas, and is long enough. " * 3
    side, note = "Side text, also with commas, and long enough to count here.", "Noted, here, at some length, and more."
    page = f"<body><div class='sidebar'><p>{side}</p></div><div id='content'><p>{text}</p><p>{text}<img src='/a.png'></p><svg><title>S</title></svg><div class='promo'>{note}</div><form>f</form></div><div><a href='/'>all links here</a></div></body>"
    x = html.extract(page, "http://s.org/p")
    assert x["extractor"] == "readability" and text.strip() in x["markdown"] and "http://s.org/a.png" in x["markdown"] and x["svgs"]
    assert not any(s in x["markdown"] for s in (side, note, "all links", "f\n"))
    many = f"<body><div><p>{text}</p></div><div class='footnote'>" + "<img src='/b.png'>" * 6 + "</div></body>"
    assert html.extract(many, "http://s.org/p")["extractor"] == "chrome-strip"  # its images would be lost
    assert html.extract("<p>short</p>", None)["extractor"] == "chrome-strip" and html.extract(None, None)["markdown"] == ""


def test_references_as_in_the_sql(tmp_path, spark):
    import duckdb
    from loomery.queries import ORACLE_SQL, QUERIES

    page = '<html lang="en"><head><title>A &quot;b&quot; &amp;lt; c&amp</title></head><body><article><p>x&amp</p><b>&quot;y&quot;</b> &lt;z &amp;</article><div class="ad"></div></body></html>'
    spark.createDataFrame([(1, "http://s.org/", page)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_metadata", "chrome_strip_stats"):
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == con.execute(ORACLE_SQL[name]).fetchall(), name
    # a caller gets all of them decoded, as browsers do, and a page's own private signs stay
    assert html.extract(page, None)["title"] == 'A "b" &lt; c&'
    assert html.parse("<p a='&b\ue000'>&eacute;\ue000&amp;&amp</p>", ("amp",)).html() == '<p a="&amp;b\ue000">&amp;eacute;\ue000&amp;&amp;amp</p>'
