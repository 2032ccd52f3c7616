from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomery.functions import text as t
from loomery.functions.udfs import url_join


@pytest.mark.parametrize(
    ("given", "want"),
    [("a\n\n12\n\nb\n", "a\nb\n"), ("co-\nop é-\né x  \ny", "coop éé x\ny\n"), ("a\n\n\n\nb", "a\n\nb\n"), ("p1\n 7 \n\n\n8\nq", "p1\nq\n"), ("", "")],
)
def test_cleanup(value, given, want):
    assert value(t.cleanup(F.lit(given))) == want


def test_frontmatter(value):
    text = '---\nslug: a\n# note\ntitle: "T: x"\ntags: [b, "c"]\nempty: []\nslug: b # kept\nno colon\n---\nbody\n'
    assert value(t.frontmatter(F.lit(text))) == {"slug": "b # kept", "title": "T: x", "tags": '[b, "c"]', "empty": "[]"}
    assert value(t.frontmatter_lists(F.lit(text))) == {"tags": ["b", "c"], "empty": []}
    assert value(t.body_of(F.lit(text))) == "body\n"
    assert value(t.frontmatter(F.lit("---\na: 1\n---"))) is None  # no line end after the fence
    assert value(F.regexp_extract(F.lit("---\n---\nbody\n---\nx\n"), t.FRONTMATTER, 1)) == "---\nbody"  # an empty block swallows text
    assert value(t.strip_frontmatter(F.lit("---\na: 1\n---\n\n  x"))) == "x"
    assert value(t.strip_frontmatter(F.lit("x\n---\ny"))) == "x\n---\ny"


def test_links(value):
    assert value(t.wiki_links(F.lit("![[fig.png]] [[#h]] [[ a ]] [[b#h|c]]"))) == ["fig.png", "a", "b"]
    assert value(t.image_embeds(F.lit("x ![a](b.png) [c](d) ![](e)"))) == ["![a](b.png)", "![](e)"]


def test_slugs(value):
    assert value(t.slug_url(F.lit("https://docs.example.com/docs/build/semantic-models?x=1#y"))) == "docs-build-semantic-models"
    assert value(t.slug_url(F.lit("https://docs.example.com/"))) == "index"
    assert value(t.slug_clip(F.lit(" Über  den_Fluß -- hin! "))) == "über-den-fluß-hin"
    assert value(t.slug_book(F.lit("!!"))) == "section"
    assert value(t.slug_tex(F.lit("Größe: 5"), "x")) == "gr-e-5"
    assert value(t.slug_tikz(F.lit(""), F.lit(7))) == "tikz_007"
    assert value(t.slug_title(F.lit("a b c d e f g h i j"))) == "a-b-c-d-e-f-g-h"
    assert value(t.title_of_slug(F.lit("docs-build"))) == "Docs Build"


def test_urls(value):
    assert value(t.canonical_url(F.lit("http://a.b/c//?q=1"))) == "http://a.b/c"
    assert value(t.default_prefix(F.lit("http://a.b/c/d/"))) == "http://a.b/c"
    assert value(url_join(F.lit("http://a.b/c/d"), F.lit("../e"))) == "http://a.b/e"
    for ref in ("x/y", "/x", "//h/x", "http://q/r", "#f", ""):
        assert value(t.resolve_simple(F.lit("http://a.b/c/d"), F.lit(ref))) == value(url_join(F.lit("http://a.b/c/d"), F.lit(ref)))
    assert value(t.asset_name(F.lit("http://a/b/my pic.PNG?x"), F.lit(None), F.lit(1))).startswith("my-pic_")
    assert value(t.asset_name(F.lit("http://a/b/pic"), F.lit("image/jpeg; q=1"), F.lit(1))).endswith(".jpg")
    assert value(t.asset_name(F.lit("http://a/"), F.lit(None), F.lit(3))).startswith("img_003_")
    assert value(t.clip_image_name(F.lit(b"x"), F.lit(None), F.lit("http://a/b.webp?x"))).endswith(".webp")


@pytest.mark.parametrize("raw", ["2003.02320v3", "arXiv:2003.02320v3", "https://arxiv.org/abs/2003.02320v3", "https://arxiv.org/pdf/2003.02320v3.pdf"])
def test_arxiv(value, raw):
    assert (value(t.arxiv_id(F.lit(raw))), value(t.arxiv_version(F.lit(raw)))) == ("2003.02320", "3")


def test_ids(value):
    assert value(t.arxiv_id(F.lit("math.GT/0309136"))) == "math.GT/0309136"
    assert value(t.arxiv_version(F.lit("2003.02320"))) is None
    assert value(t.youtube_id(F.lit("https://www.youtube.com/embed/abcdefghijk?x"))) == "abcdefghijk"


def test_times(value):
    assert [value(t.format_time(F.lit(x))) for x in (65, 3723.9, 0)] == ["1:05", "1:02:03", "0:00"]
    assert [value(t.vtt_time(F.lit(x))) for x in ("00:01:02.500", "01:02.500", "1:00:00,5")] == [62.5, 62.5, 3600.5]


def test_pages(value):
    q = lambda text, native, pages=1: value(t.quality_score(F.lit(text), F.lit(native), F.lit(pages)))
    assert q("x" * 500, 1000) == 0.5
    assert q("  ", 1000) == 0.0
    assert q("x" * 400, 0) == 0.5
    assert q("x" * 994 + "%%%%%%", 1000) == pytest.approx(0.95)
    assert value(t.word_count(F.lit(" \n "))) == 0
    assert value(t.thin_reason(F.lit("Please Sign in"))) == "auth-gated"
    assert value(t.thin_reason(F.lit("x " * 30))) is None
    assert [value(t.read_folio(F.lit(x))) for x in ("a\n12\nb\nc", "x\n(7)\n", "0\nx\ny\nz", "a\nb\n9\nend", "", "12345")] == [12, 7, None, 9, None, None]
    assert [value(t.looks_like_math(F.lit(x))) for x in ("x", "N_t", "a = b + c", "5 dollars that you pay me", "", "costs and")] == [True, True, True, False, False, False]
    assert value(t.math_signal(F.lit("a ∑ b"))) and value(t.math_signal(F.lit("\\frac12"))) and not value(t.math_signal(F.lit("plain")))


def test_latex_text(value):
    assert value(t.strip_comments(F.lit("a % b\nc \\% d\n%e"))) == "a \nc \\% d\n"
    assert value(t.include_targets(F.lit("\\input{a} \\import{d/}{b} \\subimport{}{c}"))) == ["a", "d/b", "c"]
    assert value(t.unhandled_includes(F.lit("\\input foo \\lstinputlisting{x}"))) == ["\\input foo", "\\lstinputlisting{x}"]
    assert value(t.section_title(F.lit("x \\section*{A \n b}"))) is None  # titles don't cross lines
    assert value(t.section_title(F.lit("x \\section*{A   b} y"))) == "A b"
    tex = "pre\\begin{document}one\\end{document}two\\end{document}post"
    assert value(t.document_body(F.lit(tex))) == "one\\end{document}two"
    assert value(t.preamble_of(F.lit(tex))) == "pre"
    assert value(t.document_body(F.lit("no document"))) is None


def test_sniffers(value):
    assert value(t.is_pdf(F.lit(b"%PDF-1.7"))) and value(t.is_gzip(F.lit(b"\x1f\x8bx"))) and not value(t.is_gzip(F.lit(b"abc")))
    assert value(t.bundle_type(F.array(F.lit("metadata.json"), F.lit("clip_profile.json")))) == "clip"
    assert value(t.bundle_type(F.array(F.lit("metadata.json")))) == "pdf"
    assert value(t.json_ascii(F.lit('a"b'))) == '"a\\"b"'
    assert value(t.rename_slug(F.lit("slug: a\n[[a]] slug: a"), F.lit("a"), F.lit("a-2"))) == "slug: a-2\n[[a]] slug: a"
