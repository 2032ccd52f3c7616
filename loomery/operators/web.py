"""Crawls over stored pages: link discovery, thin pages, stitching, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as t

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*\"([^\"]*)\""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PAGE_CAP = 40


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


def page_links(pages: DataFrame, prefix: str | None = None, max_pages: int | None = PAGE_CAP) -> DataFrame:
    """page_id, ord, url, slug: the page itself first, then its links that hold the prefix and no '#', without query and final slash, each once.

    Without a prefix, the parent directory of the page's URL counts. max_pages cuts the list before anything is fetched; None doesn't.
    """
    want = F.lit(prefix) if prefix is not None else t.default_prefix(F.col("base"))
    own = pages.select("page_id", F.substring_index("url", "#", 1).alias("base"), "html")
    found = own.select("page_id", "base", F.posexplode(anchors(F.col("html"))).alias("pos", "ref")).withColumn("full", t.resolve_simple(F.col("base"), F.col("ref")))
    kept = found.where(~F.col("full").contains("#") & F.contains(F.col("full"), want)).select("page_id", "pos", t.canonical_url(F.col("full")).alias("url"))
    seed = own.select("page_id", F.lit(-1).alias("pos"), t.canonical_url(F.col("base")).alias("url"))
    # a seed that is among its own links keeps its place there
    first = kept.where("url != ''").unionByName(seed).groupBy("page_id", "url").agg(F.coalesce(F.min(F.when(F.col("pos") >= 0, F.col("pos"))), F.lit(-1)).alias("pos"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    return (ranked if max_pages is None else ranked.where(F.col("ord") <= max_pages)).select("page_id", "ord", "url", t.slug_url(F.col("url")).alias("slug"))


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, site_title, site_name: the first and the last part of the title between bars; the name is empty without a bar."""
    title = F.regexp_extract("html", TITLE, 1)
    parts = F.split(title, r"\|")
    return pages.select("page_id", t.strip(F.get(parts, F.lit(0))).alias("site_title"), F.when(F.size(parts) > 1, t.strip(F.element_at(parts, -1))).otherwise("").alias("site_name"))


def thin_pages(sections: DataFrame, body: str = "body") -> DataFrame:
    """The sections with words and reason; reason is null for those that stay."""
    return sections.withColumns({"words": t.word_count(F.col(body)), "reason": t.thin_reason(F.coalesce(body, F.lit("")))})


def stitch(sections: DataFrame, crawls: DataFrame) -> DataFrame:
    """crawl_id, content of sections (crawl_id, ord, title, url, body) and crawls (crawl_id, url, site_title, site_name, prefix, fetched_at, warnings)."""
    part = F.concat(F.lit("---\n\n## "), "title", F.lit("\n\n*Source: <"), "url", F.lit(">*\n\n\n"), "body", F.lit("\n"))
    body = sections.groupBy("crawl_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"]), "\n").alias("parts"))
    title = F.coalesce(F.nullif("site_title", F.lit("")), F.concat(F.lit("Documentation crawl of "), F.regexp_extract("url", "://([^/?#]*)", 1)))
    name = t.json_ascii(F.coalesce("site_name", F.lit("")))
    front = F.concat(F.lit("---\nurl: "), "url", F.lit("\ntitle: "), t.json_ascii(title), F.lit("\nauthor: "), name, F.lit("\nsite_name: "), name, F.lit("\nfetched_at: "), "fetched_at", F.lit("\n---\n\n"))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("*Warnings: "), F.size("warnings").cast("string"), F.lit(" — see web_profile.json.*\n\n"))).otherwise("")
    return crawls.join(body, "crawl_id").select("crawl_id", F.concat(front, F.lit("# "), title, F.lit("\n\n*Assembled from "), F.col("n").cast("string"), F.lit(" pages crawled under `"), "prefix", F.lit("`.*\n\n"), warned, F.lit("\n"), "parts").alias("content"))


def crawl_profile(profiles: DataFrame) -> DataFrame:
    """crawl_id and the sums of the pages' image and maths counters, with all warnings in order."""
    sums = [F.coalesce(F.sum(f"{group}.{k}"), F.lit(0)).alias(f"{group}_{k}") for group, keys in (("images", ("found", "downloaded", "skipped", "failed")), ("math", ("katex", "mathjax_script", "mathml", "raw_delim"))) for k in keys]
    return profiles.groupBy("crawl_id").agg(*sums, F.lit(0).cast("long").alias("inline_svgs"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "warnings"))), lambda x: x["warnings"])).alias("warnings"))


def merge_figures(have: DataFrame, new: DataFrame) -> DataFrame:
    """The figures that are there, and the new ones (name, ord, ...) of other names, the first of each."""
    order = Window.partitionBy("name").orderBy("ord")
    fresh = new.join(have.select("name"), "name", "left_anti").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return have.unionByName(fresh.select(have.columns))


def metadata_of(found: DataFrame) -> DataFrame:
    """page_id and the metadata fields from meta MAP, title and lang (as operators.html gives them), each by its chain of keys."""
    m = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("meta", F.lit(k)), F.lit("")) for k in keys])
    return found.select(
        "page_id", "url", F.coalesce(m("og:title", "twitter:title"), F.nullif("title", F.lit(""))).alias("title"), m("author", "article:author", "og:author").alias("author"),
        m("article:published_time", "datePublished", "date").alias("published"), m("article:modified_time", "dateModified").alias("modified"), m("og:site_name").alias("site_name"),
        m("description", "og:description").alias("description"), F.coalesce(F.nullif("lang", F.lit("")), m("og:locale")).alias("language"),
    )


def web_bundle(pages: DataFrame) -> DataFrame:
    """page_id, content, metadata of pages (page_id, url, final_url, fetched_at, markdown and the metadata fields)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    front = F.concat(F.lit("---\nurl: "), "url", F.lit("\nfinal_url: "), "final_url", F.lit("\ntitle: "), t.json_ascii(title), F.lit("\nauthor: "), t.json_ascii(blank("author")), F.lit("\npublished: "), blank("published"), F.lit("\nsite_name: "), t.json_ascii(blank("site_name")), F.lit("\nfetched_at: "), "fetched_at", F.lit("\n---\n\n"))
    fields = [c for c in ("url", "final_url", "title", "author", "published", "modified", "site_name", "description", "language", "fetched_at") if c in pages.columns]
    return pages.select("page_id", F.concat(front, F.lit("# "), title, F.lit("\n\n"), t.collapse_blank(t.strip(blank("markdown"))), F.lit("\n")).alias("content"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata"))


def clip_bundle(clips: DataFrame) -> DataFrame:
    """clip_id, content, metadata, profile of pasted texts (clip_id, title, text, author, url, published, platform, fetched_at, images); blank texts go."""
    field = lambda label, c, value: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n{label}: "), value)).otherwise("")
    none = lambda c: F.nullif(c, F.lit(""))
    kept = clips.withColumn("text", t.strip(F.coalesce("text", F.lit("")))).where("text != ''")
    front = F.concat(F.lit("---\ntitle: "), t.json_ascii(F.col("title")), field("url", "url", F.col("url")), field("author", "author", t.json_ascii(F.col("author"))), field("published", "published", F.col("published")), field("site_name", "platform", t.json_ascii(F.col("platform"))), F.lit("\nfetched_at: "), "fetched_at", F.lit("\n---\n\n"))
    names = F.transform(F.filter("images", lambda x: x["path"].isNotNull()), lambda x: F.concat(F.lit("!["), F.regexp_extract(x["path"], r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("]("), x["path"], F.lit(")")))
    shown = F.when(F.size(names) > 0, F.concat(F.lit("\n\n"), F.array_join(names, "\n"))).otherwise("")
    metadata = F.struct("title", none("author").alias("author"), none("url").alias("url"), none("published").alias("published"), none("platform").alias("site_name"), "fetched_at")
    profile = F.struct(F.lit("clip").alias("source"), none("platform").alias("platform"), none("url").alias("original_url"), F.struct(F.size("images").alias("requested"), F.size(names).alias("downloaded")).alias("images"))
    js = lambda s: F.to_json(s, {"ignoreNullFields": "false"})
    return kept.select("clip_id", F.concat(front, F.lit("# "), "title", F.lit("\n\n"), "text", shown, F.lit("\n")).alias("content"), js(metadata).alias("metadata"), js(profile).alias("profile"))


def stage_source(bundles: DataFrame) -> DataFrame:
    """slug, text, copied of bundles (name, slug, title, content, files): the source document of a page, with its local images under assets."""
    own = F.regexp_extract(F.regexp_extract("content", t.FRONTMATTER, 1), r"(?m)^title:\s*(.+)$", 1)
    bare = F.regexp_replace(F.regexp_replace(t.strip(own), '^"+|"+$', ""), "^'+|'+$", "")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(bare, F.lit("")), "slug")
    body = t.strip(t.body_of(F.col("content")))
    pattern = r"!\[[^\]]*\]\([^)]+\)"
    refs, gaps = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.split(body, pattern)
    target = lambda m: F.trim(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1))
    local = lambda m: ~t.is_external(target(m)) & F.array_contains("files", target(m))
    new = F.transform(refs, lambda m: F.when(local(m), F.concat(F.regexp_extract(m, r"^(!\[[^\]]*\]\()", 1), F.lit("../assets/"), "slug", F.lit("/"), target(m), F.lit(")"))).otherwise(m))
    joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")
    head = F.concat(F.lit("---\nslug: "), "slug", F.lit("-source\npaper: "), "slug", F.lit("\nsource: "), "name", F.lit("\nstaged: "), "staged", F.lit("\n---\n\n# Source: "), title, F.lit("\n\n> Complete source text staged from bundle `"), "name", F.lit("`. The synthesised view is [["), "slug", F.lit("]].\n\n"))
    return bundles.select("slug", F.concat(head, joined, F.lit("\n")).alias("text"), F.size(F.filter(refs, local)).alias("copied"))


def stage_assets(bundles: DataFrame) -> DataFrame:
    """slug, file, target, refs of bundles (slug, content, files): the copies that the staged sources' local images need, and how often each is referred to."""
    refs = F.regexp_extract_all(t.body_of(F.col("content")), F.lit(t.IMAGE_EMBED), F.lit(0))
    found = bundles.select("slug", "files", F.explode(refs).alias("m")).select("slug", "files", F.trim(F.regexp_extract("m", r"\]\(([^)]+)\)$", 1)).alias("file"))
    local = found.where(~t.is_external(F.col("file")) & F.array_contains("files", F.col("file")))
    return local.groupBy("slug", "file").agg(F.count("*").alias("refs")).select("slug", "file", F.concat(F.lit("assets/"), "slug", F.lit("/"), "file").alias("target"), "refs")
