"""Text scalars as Column functions: all built-in expressions, so they stay in the scan's stage.

Python's idea of white space and word characters is kept with (?U) in the patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WIKI_LINK = r"\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
IMAGE_EMBED = r"!\[[^\]]*\]\([^)]+\)"
FRONTMATTER = r"\A---\n(?s:(.*?))\n---\n"
ARXIV_ID = r"(?:arXiv:)?(?:https?://arxiv\.org/(?:abs|pdf|e-print)/)?(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:v(\d+))?(?:\.pdf)?"
YOUTUBE_ID = r"(?:youtube\.com/(?:watch\?v=|embed/|v/)|youtu\.be/)([a-zA-Z0-9_-]{11})"
MATH_SIGNAL = (
    r"(?=[\\Γ-ω∀-⊗])(?:"  # most places fail at one look
    "[∑∫∂∇≤≥≠≈∞αβγδθλμπρσφψωΓΔΘΛΣΦΨΩ∈∉⊂⊃⊆⊇∪∩⊕⊗]"
    r"|\\(?:frac|sum|int|prod|partial|nabla|sqrt|mathbb|mathcal|begin\{(?:equation|align|matrix|cases)))"
)
#: What looks like a formula, any of these: (characters at most, patterns that must be found, pattern that must not).
MATH_RULES = ((8, (), r"\s\s|\bthat\b|\bthe\b|\band\b|\bis\b"), (None, (r"[\\_^{}]",), None), (30, (r"[=+\-*/<>]", "[a-zA-Z]"), None))
UNHANDLED_INCLUDE = r"\\(?:includestandalone|InputIfFileExists|subfileinclude|lstinputlisting|verbatiminput)\s*\{[^}]*\}|\\inputminted\s*\{[^}]*\}\s*\{[^}]*\}|\\input\s+[A-Za-z0-9_./-]+"
INCLUDE = r"\\(?:input|include|subfile)\s*\{([^}]+)\}|\\(?:import|subimport)\s*\{([^}]*)\}\s*\{([^}]+)\}"
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}


#: White space as Python strips it.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(BLANKS))


def if_blank(x: Column, other: Column | str) -> Column:
    return F.when(x == "", F.lit(other) if isinstance(other, str) else other).otherwise(x)


def word_count(x: Column) -> Column:
    """Words between white space; 0 for blank text and null."""
    bare = strip(F.coalesce(x, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("long")


# Slugs: five rules that differ on purpose.


def slug_clip(x: Column) -> Column:
    """Word characters and dashes of the lower-cased text, up to 60, runs as one dash."""
    s = F.regexp_replace(strip(F.lower(x)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(F.substring(s, 1, 60), "^-+|-+$", "")


def slug_book(x: Column, fallback: str = "section") -> Column:
    s = strip(F.regexp_replace(F.lower(x), r"(?U)[^\w\s-]", ""))
    return if_blank(F.regexp_replace(F.substring(F.regexp_replace(s, r"(?U)[\s_-]+", "-"), 1, 60), "^-+|-+$", ""), fallback)


def slug_tex(x: Column, fallback: Column | str) -> Column:
    return if_blank(F.lower(F.regexp_replace(F.regexp_replace(x, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")), fallback)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def slug_url(url: Column) -> Column:
    """The path's letters and digits, case kept; host, query and fragment don't count."""
    return if_blank(F.regexp_replace(F.regexp_replace(url_path(url), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""), "index")


def slug_tikz(label: Column, n: Column) -> Column:
    return slug_tex(F.coalesce(label, F.lit("")), F.concat(F.lit("tikz_"), F.lpad(n.cast("string"), 3, "0")))


def slug_title(title: Column) -> Column:
    """A page's slug from the first eight words of its title."""
    return slug_clip(F.array_join(F.slice(F.split(strip(title), r"(?U)\s+"), 1, 8), " "))


def title_of_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


# URLs.


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def default_prefix(url: Column) -> Column:
    """The URL of the parent directory."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(url_origin(url), F.regexp_replace(path, "/[^/]*$", ""))


def resolve_simple(base: Column, ref: Column) -> Column:
    """The absolute form of references without dot segments; see functions.udfs.url_join for all."""
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref).when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(url_origin(base), ref)).when(ref.startswith("#"), F.concat(F.substring_index(base, "#", 1), ref)).when(ref == "", base)
        .otherwise(F.concat(url_origin(base), if_blank(folder, "/"), ref))
    )


def is_external(ref: Column) -> Column:
    return ref.startswith("http://") | ref.startswith("https://") | ref.startswith("/") | ref.startswith("data:")


def asset_name(url: Column, content_type: Column, n: Column) -> Column:
    """A readable, unique file name of an image: cleaned stem, eight digits of the URL's hash, extension."""
    base = F.regexp_extract(url_path(url), r"([^/]*)/*$", 1)
    base = if_blank(base, F.concat(F.lit("img_"), F.lpad(n.cast("string"), 3, "0")))
    ext = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    bare = F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))
    guessed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), bare), F.lit(".bin"))
    stem = F.regexp_replace(F.substring(base, F.lit(1), F.length(base) - F.length(ext)), "[^A-Za-z0-9._-]+", "-")
    return F.concat(F.substring(stem, 1, 40), F.lit("_"), F.substring(F.sha1(url), 1, 8), if_blank(ext, guessed))


def svg_name(svg: Column, n: Column) -> Column:
    return F.concat(F.lit("svg_"), F.lpad(n.cast("string"), 3, "0"), F.lit("_"), F.substring(F.sha1(svg), 1, 8), F.lit(".svg"))


def clip_image_name(content: Column, content_type: Column, url: Column) -> Column:
    """image_ and twelve digits of the content's hash, with the extension of the type, else of the URL, else .bin."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    tail = F.nullif(F.regexp_extract(F.lower(F.substring_index(url, "?", 1)), r"(\.(?:jpg|jpeg|png|gif|webp|svg))$", 1), F.lit(""))
    return F.concat(F.lit("image_"), F.substring(F.sha2(content, 256), 1, 12), F.coalesce(known, tail, F.lit(".bin")))


# Frontmatter and links.


def has_frontmatter(x: Column) -> Column:
    return F.coalesce(x.rlike(FRONTMATTER), F.lit(False))


def frontmatter_entries(x: Column) -> Column:
    """ARRAY<STRUCT<key, value, items>>: lines with a colon; of equal keys the last. items is null for plain values."""
    lines = F.split(F.regexp_extract(x, FRONTMATTER, 1), r"\r\n|\r|\n")
    used = F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)\s+\z", "")), lambda s: (s != "") & ~s.startswith("#") & s.contains(":"))
    pairs = F.transform(used, lambda s: F.struct(strip(F.substring_index(s, ":", 1)).alias("key"), strip(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value")))

    def typed(p: Column) -> Column:
        v = p["value"]
        inner = strip(F.substring(v, F.lit(2), F.length(v) - 2))
        items = F.transform(F.split(inner, ","), lambda s: F.regexp_replace(F.regexp_replace(strip(s), '^"+|"+$', ""), "^'+|'+$", ""))
        listed = v.startswith("[") & v.endswith("]")
        quoted = (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
        return F.struct(
            p["key"].alias("key"),
            F.when(listed | ~quoted, v).otherwise(F.substring(v, F.lit(2), F.length(v) - 2)).alias("value"),
            F.when(listed, F.when(inner == "", F.array().cast("array<string>")).otherwise(items)).alias("items"),
        )

    made = F.transform(pairs, typed)
    return F.filter(made, lambda p, i: ~F.exists(F.slice(made, i + 2, F.size(made)), lambda q: q["key"] == p["key"]))


def frontmatter(x: Column) -> Column:
    """MAP of the values; null without a frontmatter block."""
    return F.when(has_frontmatter(x), F.map_from_entries(F.transform(frontmatter_entries(x), lambda p: F.struct(p["key"], p["value"]))))


def frontmatter_lists(x: Column) -> Column:
    """MAP of the values that are lists."""
    listed = F.filter(frontmatter_entries(x), lambda p: p["items"].isNotNull())
    return F.when(has_frontmatter(x), F.map_from_entries(F.transform(listed, lambda p: F.struct(p["key"], p["items"]))))


def body_of(x: Column) -> Column:
    """What follows the frontmatter block, or all."""
    return F.regexp_replace(x, FRONTMATTER, "")


def strip_frontmatter(x: Column) -> Column:
    """The variant by lines: the first line is --- and any later line is exactly that; the rest without leading white space."""
    lines = F.split(x, "\n")
    end = F.array_position(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.lit("---"))
    rest = F.regexp_replace(F.array_join(F.slice(lines, (end + 2).cast("int"), F.size(lines)), "\n"), r"(?U)^\s+", "")
    return F.when((strip(F.get(lines, F.lit(0))) == "---") & (end > 0), rest).otherwise(x)


def wiki_links(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(WIKI_LINK), F.lit(1)), strip)


def image_embeds(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(IMAGE_EMBED), F.lit(0))


# Identifiers and times.


def arxiv_id(x: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(x), ARXIV_ID, 1), F.lit(""))


def arxiv_version(x: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(x), ARXIV_ID, 2), F.lit(""))


def youtube_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, YOUTUBE_ID, 1), F.lit(""))


def format_time(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour; fractions are cut."""
    t = F.floor(seconds).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), F.floor(t % 3600 / 60).cast("long"), t % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s)))


def vtt_time(x: Column) -> Column:
    p = F.split(F.replace(x, F.lit(","), F.lit(".")), ":")
    n = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).otherwise(n(0) * 60 + n(1))


# Page text.


def cleanup(x: Column) -> Column:
    """Joins hyphenated words, then collapses blank runs, then drops lines that are a page number, then trailing blanks, in this order."""
    s = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    s = F.regexp_replace(s, "\n{3,}", "\n\n")
    s = F.regexp_replace(s, r"(?Umd)^\s*\d{1,4}\s*$\n?", "")
    s = F.regexp_replace(s, "[ \t]+\n", "\n")
    return F.when(x == "", x).otherwise(F.concat(strip(s), F.lit("\n")))


def math_signal(x: Column) -> Column:
    return F.coalesce(x.rlike(MATH_SIGNAL), F.lit(False))


def page_type(chars: Column, images: Column) -> Column:
    return F.when((chars < 50) & (images >= 1), "scanned").when(chars > 200, "native").otherwise("mixed")


def quality_score(x: Column, native_chars: Column, pages: Column) -> Column:
    """From 0 to 1: the share of the expected characters less runs of signs; by density where no page is native."""
    n = F.length(x).cast("double")
    runs = F.regexp_count(x, F.lit(r"(?U)[^\w\s]{6,}")) / F.greatest(F.lit(1.0), n / 1000)
    dense = F.least(F.lit(1.0), n / F.greatest(F.lit(1), pages) / 800)
    return F.when(strip(F.coalesce(x, F.lit(""))) == "", 0.0).when(native_chars == 0, dense).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / F.greatest(F.lit(1), native_chars)) - 0.05 * runs))


def looks_like_math(x: Column) -> Column:
    s = strip(x)
    found = F.lit(False)
    for most, present, absent in MATH_RULES:
        tests = [s.rlike(f"(?U){p}") for p in present] + ([F.length(s) <= most] if most else []) + ([~s.rlike(f"(?U){absent}")] if absent else [])
        found = found | reduce(Column.__and__, tests)
    return (s != "") & found


def thin_reason(body: Column) -> Column:
    """Why a page of fewer than 30 words is left out; null for others."""
    return F.when(word_count(body) < 30, F.when(F.lower(body).rlike("sign in|log in|okta"), "auth-gated").otherwise("too thin"))


def read_folio(x: Column) -> Column:
    """The printed page number: a number alone on the last, the second last, the first or the second line that isn't blank."""
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")

    def at(i: int) -> Column:
        n = F.try_element_at(lines, F.lit(i))
        value = F.regexp_extract(n, r"^\(?(\d{1,4})\)?$", 1)
        number = F.when(value != "", value.cast("int"))
        return F.when(number.between(1, 9999), number)

    return F.coalesce(at(-1), at(-2), at(1), at(2))


def json_ascii(x: Column) -> Column:
    """A JSON string in ASCII: other letters are escaped, those beyond U+FFFF as their two halves."""
    quoted = F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    other = r"[^\x00-\x7f]"

    def escape(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")

    hits = F.regexp_extract_all(quoted, F.lit(other), F.lit(0))
    return F.array_join(F.zip_with(F.split(quoted, other), F.transform(hits, escape), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def json_text(x: Column) -> Column:
    """A JSON string with its letters as they are."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def collapse_blank(x: Column) -> Column:
    return F.regexp_replace(x, "\n{3,}", "\n\n")


def rename_slug(x: Column, old: Column, new: Column) -> Column:
    """The first 'slug: old' of a page becomes 'slug: new'; links in the body stay."""
    needle = F.concat(F.lit("slug: "), old)
    at = F.instr(x, needle)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit("slug: "), new, F.substring(x, at + F.length(needle), F.length(x)))).otherwise(x)


# LaTeX text that is regular.


def strip_comments(tex: Column) -> Column:
    return F.regexp_replace(tex, r"(?md)(?<!\\)%.*$", "")


def include_targets(tex: Column) -> Column:
    """Files of input, include, subfile and (dir joined) import commands."""
    whole = F.regexp_extract_all(tex, F.lit(INCLUDE), F.lit(0))

    def one(m: Column) -> Column:
        d, f = F.trim(F.regexp_extract(m, INCLUDE, 2)), F.trim(F.regexp_extract(m, INCLUDE, 3))
        joined = F.when(d != "", F.concat(F.regexp_replace(d, "/+$", ""), F.lit("/"), f)).otherwise(f)
        return if_blank(F.trim(F.regexp_extract(m, INCLUDE, 1)), joined)

    return F.transform(whole, one)


def unhandled_includes(tex: Column) -> Column:
    return F.regexp_extract_all(tex, F.lit(UNHANDLED_INCLUDE), F.lit(0))


def section_title(tex: Column) -> Column:
    found = F.regexp_extract(tex, r"\\(?:section|chapter)\*?\s*\{(.+?)\}", 1)
    return F.nullif(F.substring(F.regexp_replace(strip(found), r"(?U)\s+", " "), 1, 80), F.lit(""))


def preamble_of(tex: Column) -> Column:
    return F.substring_index(tex, r"\begin{document}", 1)


def document_body(tex: Column) -> Column:
    """Between the first begin and the last end of the document; null where one is missing or out of order."""
    begin, end = F.instr(tex, r"\begin{document}"), F.length(F.substring_index(F.concat(F.lit(" "), tex), r"\end{document}", -1))
    last = F.length(tex) - end - F.length(F.lit(r"\end{document}")) + 1
    return F.when((begin > 0) & tex.contains(r"\end{document}") & (last > begin), F.substring(tex, begin + 16, last - begin - 16))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def is_gzip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(b"\x1f\x8b")


def bundle_type(files: Column) -> Column:
    """The kind of a bundle, by the first marker among its files."""
    has = lambda name: F.array_contains(files, name)
    return F.when(has("raw/structure.json"), "arxiv").when(has("video_profile.json"), "video").when(has("web_profile.json"), "web").when(has("clip_profile.json"), "clip").when(has("deep_research_profile.json"), "deep-research").when(has("metadata.json"), "pdf")
