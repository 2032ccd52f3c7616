"""Queries over bundles (pages, clips, papers, books, videos, vaults) that are made from the tables, with their SQL for DuckDB."""

from __future__ import annotations

import shutil
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as t
from loomery.operators import audit, book, html, latex, media, merge, pdf, reconcile, validate, web
from loomery.operators.predicates import parse_predicates
from loomery.plans import derived as d
from loomery.queries import AUDIT, CORPORA, TOC, VAULT, query
from loomery.sinks import vaults as sinks
from loomery.sources import vaults as sources

lit = F.lit


def text(*parts) -> Column:
    """Columns (strings name them) and literals (in lists) one after another."""
    return F.concat(*[lit(p[0]) if isinstance(p, list) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def _table(spark, sf_dir, name: str) -> DataFrame:
    return d.table(spark, sf_dir, name)


def _parts(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


PARTS = "with p as (select p_partkey as k, p_name as name, p_brand as brand, p_size as size from part)\n"
#: A text as a JSON string in ASCII.
JSON = "'\"' || array_to_string(list_transform(string_split(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), ''), lambda c: case when unicode(c) > 127 then printf('\\u%04x', unicode(c)) else c end), '') || '\"'"

# ---- names ----


@query(r"""with u as (select page_id, url, case page_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg; charset=x' end as ctype, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path from pages),
b as (select *, case when regexp_extract(path, '([^/]*)/*$', 1) = '' then 'img_' || lpad(cast(page_id as varchar), 3, '0') else regexp_extract(path, '([^/]*)/*$', 1) end as base from u),
e as (select *, regexp_extract(base, '[^.](\.[^.]+)$', 1) as ext, case page_id % 3 when 0 then '.png' when 1 then '.jpg' else '.bin' end as guess from b)
select page_id, left(regexp_replace(left(base, length(base) - length(ext)), '[^A-Za-z0-9._-]+', '-', 'g'), 40) || '_' || left(sha1(url), 8) || case when ext = '' then guess else ext end as asset,
'svg_' || lpad(cast(page_id % 1000 as varchar), 3, '0') || '_' || left(sha1(url), 8) || '.svg' as svg,
'image_' || left(sha256(url), 12) || guess as clip, url like 'http://%' or url like 'https://%' as external, regexp_replace(path, '^/', '') like '/%' as relative_external from e""")
def asset_names(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "image/jpeg; charset=x").alias("ctype"))
    u, n = F.col("url"), F.col("page_id")
    relative = F.regexp_replace(t.url_path(u), "^/", "")
    return rows.select("page_id", t.asset_name(u, F.col("ctype"), n).alias("asset"), t.svg_name(u, n % 1000).alias("svg"), t.clip_image_name(u.cast("binary"), F.col("ctype"), F.regexp_replace(u, r"\?.*", "")).alias("clip"), t.is_external(u).alias("external"), t.is_external(relative).alias("relative_external"))


@query(PARTS + r"""select k, case when k % 4 = 0 then 'tikz_' || lpad(cast(k % 1000 as varchar), 3, '0') else lower(regexp_replace(regexp_replace(brand, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) end as tikz,
'Concept ' || k || ' Of' as title, array_to_string(string_split(lower(name), ' ')[1:8], '-') as slug from p""")
def page_names(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    return rows.select("k", t.slug_tikz(F.when(F.col("k") % 4 != 0, F.col("brand")), F.col("k") % 1000).alias("tikz"), t.title_of_slug(text(["concept-"], "k", ["-of"])).alias("title"), t.slug_title(F.col("name")).alias("slug"))


@query(PARTS + r""", x as (select k, array_to_string(string_split(lower(name), ' ')[1:8], '-') || case when k % 10 = 0 then '-3' else '' end as slug from p), r as (select *, row_number() over (partition by slug order by k) as r from x),
u as (select regexp_extract(slug, '^(.*)-(\d+)$', 1) as stem, max(cast(regexp_extract(slug, '^(.*)-(\d+)$', 2) as bigint)) as most from x where regexp_matches(slug, '-\d+$') group by stem)
select k as seq, case when r = 1 then slug else slug || '-' || greatest(coalesce(most, 1), 1) + r - 1 end as slug from r left join u on u.stem = slug""")
def title_slugs(spark, sf_dir):
    rows = _parts(spark, sf_dir).select(F.col("k").alias("seq"), F.concat("name", F.when(F.col("k") % 10 == 0, " 3").otherwise("")).alias("title"))
    return merge.page_slugs(rows)


@query(PARTS + r""", x as (select k, unnest([name, 'x_' || size, size || ' + y', ' ' || brand || '  ', 'a the', 'is', '', size || '=' || size, name || ' \alpha']) as s from p)
select distinct s, trim(s) <> '' and ((length(trim(s)) <= 8 and not regexp_matches(trim(s), '\s\s|\bthat\b|\bthe\b|\band\b|\bis\b')) or regexp_matches(trim(s), '[\\_^{}]') or (length(trim(s)) <= 30 and regexp_matches(trim(s), '[=+\-*/<>]') and regexp_matches(trim(s), '[a-zA-Z]'))) as math from x""")
def math_rules(spark, sf_dir):
    made = F.array(F.col("name"), text(["x_"], "size"), text("size", [" + y"]), text([" "], "brand", ["  "]), lit("a the"), lit("is"), lit(""), text("size", ["="], "size"), text("name", [" \\alpha"]))
    return _parts(spark, sf_dir).select(F.explode(made).alias("s")).distinct().select("s", t.looks_like_math(F.col("s")).alias("math"))


@query(rf"""with x as (select doc_id, regexp_replace(split_part(text, chr(10), 1), '[\x00-\x1f\x7f]', '', 'g') || '"\' as s from documents where text is not null)
select doc_id, {JSON.format("s")} as ascii from x""")
def json_titles(spark, sf_dir):
    first = F.concat(F.regexp_replace(F.substring_index("text", "\n", 1), r"[\x00-\x1f\x7f]", ""), lit('"\\'))
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.json_ascii(first).alias("ascii"))


@query(r"select doc_id, regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') as text from documents")
def collapsed_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", t.collapse_blank(F.col("text")).alias("text"))


@query(PARTS + r"""select k, '---' || chr(10) || 'slug: part-' || k || '-2' || chr(10) || '---' || chr(10) || 'See [[part-' || k || ']], slug: part-' || k || '.' as renamed,
case k % 4 when 0 then 'Body ' || name when 1 then 'no front' || chr(10) || '---' || chr(10) || name when 2 then '---' || chr(10) || 'open: 1' else '' end as stripped from p""")
def page_rewrites(spark, sf_dir):
    own, k = text(["part-"], "k"), F.col("k") % 4
    page = F.concat(lit("---\nslug: "), own, lit("\n---\nSee [["), own, lit("]], slug: "), own, lit("."))
    fronted = F.when(k == 0, text(["---\na: 1\nb: 2\n---\n\n \nBody "], "name")).when(k == 1, text(["no front\n---\n"], "name")).when(k == 2, "---\nopen: 1").otherwise("")
    return _parts(spark, sf_dir).select("k", t.rename_slug(page, own, F.concat(own, lit("-2"))).alias("renamed"), t.strip_frontmatter(fronted).alias("stripped"))


@query(PARTS + r"""select k, k % 3 = 0 as pdf, k % 3 = 1 as gzip, case when k % 2 = 0 then 'arxiv' when k % 3 = 0 then 'video' when k % 5 = 0 then 'web' when k % 7 = 0 then 'clip' when k % 11 = 0 then 'deep-research' when k % 13 <> 0 then 'pdf' end as kind from p""")
def bundle_kinds(spark, sf_dir):
    k = F.col("k")
    content = F.when(k % 3 == 0, text(["%PDF-1."], "k").cast("binary")).when(k % 3 == 1, F.unhex(lit("1f8b08"))).otherwise(F.col("name").cast("binary"))
    names = {2: "raw/structure.json", 3: "video_profile.json", 5: "web_profile.json", 7: "clip_profile.json", 11: "deep_research_profile.json"}
    files = F.array_compact(F.array(lit("content.md"), F.when(k % 13 != 0, "metadata.json"), *[F.when(k % n == 0, x) for n, x in names.items()]))
    return _parts(spark, sf_dir).select("k", t.is_pdf(content).alias("pdf"), t.is_gzip(content).alias("gzip"), t.bundle_type(files).alias("kind"))


# ---- pages, crawls, clips ----


@query(rf"""select page_id, '---' || chr(10) || 'url: ' || url || chr(10) || 'final_url: ' || url || chr(10) || 'title: ' || case when page_id % 4 = 0 then '"' || url || '"' else '"Page \"' || page_id || '\" \u00fc"' end || chr(10) || 'author: "' || case when page_id % 2 = 0 then 'A' else '' end || '"' || chr(10)
|| 'published: ' || chr(10) || 'site_name: ""' || chr(10) || 'fetched_at: now' || chr(10) || '---' || chr(10) || chr(10) || '# ' || case when page_id % 4 = 0 then url else 'Page "' || page_id || '" ü' end || chr(10) || chr(10) || 'One' || chr(10) || chr(10) || page_id || chr(10) as content,
'{{"url":"' || url || '","final_url":"' || url || '","title":' || case when page_id % 4 = 0 then 'null' else '"Page \"' || page_id || '\" ü"' end || ',"author":' || case when page_id % 2 = 0 then '"A"' else 'null' end || ',"published":null,"site_name":null,"fetched_at":"now"}}' as metadata from pages""")
def web_bundles(spark, sf_dir):
    n = F.col("page_id")
    none = lit(None).cast("string")
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.col("url").alias("final_url"), F.when(n % 4 != 0, text(['Page "'], "page_id", ['" ü'])).alias("title"), F.when(n % 2 == 0, "A").alias("author"), none.alias("published"), none.alias("site_name"), lit("now").alias("fetched_at"), text(["\nOne\n\n\n\n"], "page_id", ["\n \n"]).alias("markdown"))
    return web.web_bundle(rows)


REGIONS = "with r as (select r_regionkey as rk, r_name as region from region), n as (select n_nationkey as nk, n_name as nation, n_regionkey as rk from nation)\n"


def _regions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region")), _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("rk"))


@query(REGIONS + r"""select rk as crawl_id, '---' || chr(10) || 'url: http://r' || rk || '.org/docs' || chr(10) || 'title: "' || title || '"' || chr(10) || 'author: "' || site || '"' || chr(10) || 'site_name: "' || site || '"' || chr(10) || 'fetched_at: now' || chr(10) || '---' || chr(10) || chr(10)
|| '# ' || title || chr(10) || chr(10) || '*Assembled from ' || n || ' pages crawled under `http://r' || rk || '.org`.*' || chr(10) || chr(10) || case when rk = 2 then '*Warnings: 1 — see web_profile.json.*' || chr(10) || chr(10) else '' end || chr(10) || parts as content
from (select *, case when rk = 1 then 'Documentation crawl of r1.org' else region end as title, case when rk = 3 then '' else 'S' || rk end as site from r)
join (select rk, count(*) as n, string_agg('---' || chr(10) || chr(10) || '## ' || nation || chr(10) || chr(10) || '*Source: <http://r' || rk || '.org/' || nk || '>*' || chr(10) || chr(10) || chr(10) || 'About ' || nation || '.' || chr(10), chr(10) order by nk) as parts from n group by rk) using (rk)""")
def crawl_books(spark, sf_dir):
    regions, nations = _regions(spark, sf_dir)
    sections = nations.select(F.col("rk").alias("crawl_id"), F.col("nk").alias("ord"), F.col("nation").alias("title"), text(["http://r"], "rk", [".org/"], "nk").alias("url"), text(["About "], "nation", ["."]).alias("body"))
    crawls = regions.select(F.col("rk").alias("crawl_id"), text(["http://r"], "rk", [".org/docs"]).alias("url"), F.when(F.col("rk") != 1, F.col("region")).otherwise("").alias("site_title"), F.when(F.col("rk") != 3, text(["S"], "rk")).alias("site_name"), text(["http://r"], "rk", [".org"]).alias("prefix"), lit("now").alias("fetched_at"), F.when(F.col("rk") == 2, F.array(lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return web.stitch(sections, crawls)


@query(REGIONS + """select rk as crawl_id, cast(sum(nk) as bigint) as images_found, cast(sum(nk % 3) as bigint) as images_downloaded, cast(0 as bigint) as images_skipped, cast(count(*) as bigint) as images_failed, cast(sum(nk % 2) as bigint) as math_katex, cast(0 as bigint) as math_mathjax_script, cast(0 as bigint) as math_mathml, cast(sum(nk % 5) as bigint) as math_raw_delim,
cast(0 as bigint) as inline_svgs, coalesce(string_agg(nation || '!', ',' order by nk) filter (where nk % 2 = 0), '') as warnings from n group by rk""")
def crawl_profiles(spark, sf_dir):
    zero, nk = lit(0).cast("long"), F.col("nk").cast("long")
    rows = _regions(spark, sf_dir)[1].select(F.col("rk").alias("crawl_id"), nk.alias("ord"), F.struct(nk.alias("found"), (nk % 3).alias("downloaded"), zero.alias("skipped"), lit(1).cast("long").alias("failed")).alias("images"), F.struct((nk % 2).alias("katex"), zero.alias("mathjax_script"), zero.alias("mathml"), (nk % 5).alias("raw_delim")).alias("math"), F.when(nk % 2 == 0, F.array(text("nation", ["!"]))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return web.crawl_profile(rows).withColumn("warnings", F.array_join("warnings", ","))


@query("""with have as (select distinct 'f' || p_size || '.png' as name, 0 as ord, 'there' as source from part where p_size % 3 = 0), new as (select 'f' || p_size || '.png' as name, p_partkey as ord, 'page-' || p_partkey as source from part)
select * from have union all select name, ord, source from (select *, row_number() over (partition by name order by ord) as r from new where name not in (select name from have)) where r = 1""")
def figure_merge(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(text(["f"], "p_size", [".png"]).alias("name"), F.col("p_partkey").alias("ord"), text(["page-"], "p_partkey").alias("source"), "p_size")
    have = rows.where("p_size % 3 = 0").select("name", lit(0).cast("long").alias("ord"), lit("there").alias("source")).distinct()
    return web.merge_figures(have, rows.drop("p_size"))


@query("""select doc_id as clip_id, '---' || chr(10) || 'title: "Clip ' || doc_id || '"' || chr(10) || 'url: http://c.org/' || doc_id || case when doc_id % 2 = 0 then chr(10) || 'author: "' || source || '"' else '' end || chr(10) || 'site_name: "web"' || chr(10) || 'fetched_at: now' || chr(10) || '---' || chr(10) || chr(10) || '# Clip ' || doc_id || chr(10) || chr(10)
|| regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || case when doc_id % 3 = 0 then chr(10) || chr(10) || '![a' || doc_id || '](figures/a' || doc_id || '.png)' else '' end || chr(10) as content,
'{"source":"clip","platform":"web","original_url":"http://c.org/' || doc_id || '","images":{"requested":' || case when doc_id % 3 = 0 then '2,"downloaded":1' else '1,"downloaded":0' end || '}}' as profile from documents where regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> ''""".replace("\\\\", "\\"))
def clip_bundles(spark, sf_dir):
    n, none = F.col("doc_id"), lit(None).cast("string")
    image = lambda p: F.struct(p.alias("path"))
    rows = _table(spark, sf_dir, "documents").select(n.alias("clip_id"), text(["Clip "], "doc_id").alias("title"), "text", F.when(n % 2 == 0, F.col("source")).alias("author"), text(["http://c.org/"], "doc_id").alias("url"), none.alias("published"), lit("web").alias("platform"), lit("now").alias("fetched_at"), F.when(n % 3 == 0, F.array(image(text(["figures/a"], "doc_id", [".png"])), image(none))).otherwise(F.array(image(none))).alias("images"))
    return web.clip_bundle(rows).select("clip_id", "content", "profile")


BUNDLES = """with b as (select s_suppkey as k, 's-' || s_suppkey as slug, s_name as name, s_suppkey % 3 = 0 as own, s_suppkey % 2 = 0 as has from supplier)
"""


def _bundles(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    front = F.when(k % 3 == 0, F.concat(lit('---\ntitle: "T of '), "s_name", lit('"\n---\n'))).otherwise("")
    body = F.concat(front, lit("Intro ![a](figures/a.png) and ![b]( figures/b.png ) then ![a](figures/a.png), ![w](http://x.org/a.png) ![r](/a.png)\n"))
    return _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), text(["s-"], "s_suppkey").alias("slug"), F.when(k % 5 == 0, "Given").alias("title"), body.alias("content"), F.when(k % 2 == 0, F.array(lit("figures/a.png"), lit("figures/b.png"))).otherwise(F.array(lit("figures/a.png"))).alias("files"), lit("today").alias("staged"))


@query(BUNDLES + """select slug, '---' || chr(10) || 'slug: ' || slug || '-source' || chr(10) || 'paper: ' || slug || chr(10) || 'source: ' || name || chr(10) || 'staged: today' || chr(10) || '---' || chr(10) || chr(10) || '# Source: ' || case when k % 5 = 0 then 'Given' when own then 'T of ' || name else slug end || chr(10) || chr(10)
|| '> Complete source text staged from bundle `' || name || '`. The synthesised view is [[' || slug || ']].' || chr(10) || chr(10) || 'Intro ![a](../assets/' || slug || '/figures/a.png) and ' || case when has then '![b](../assets/' || slug || '/figures/b.png)' else '![b]( figures/b.png )' end
|| ' then ![a](../assets/' || slug || '/figures/a.png), ![w](http://x.org/a.png) ![r](/a.png)' || chr(10) as text, case when has then 3 else 2 end as copied from b""")
def staged_sources(spark, sf_dir):
    return web.stage_source(_bundles(spark, sf_dir))


@query(BUNDLES + """select slug, 'figures/a.png' as file, 'assets/' || slug || '/figures/a.png' as target, cast(2 as bigint) as refs from b union all select slug, 'figures/b.png', 'assets/' || slug || '/figures/b.png', 1 from b where has""")
def staged_assets(spark, sf_dir):
    return web.stage_assets(_bundles(spark, sf_dir))


# ---- HTML ----


def _web_pages(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    long = F.repeat(lit("word "), 120)
    maths = F.concat(lit('<p>So <script type="math/tex">a_'), k.cast("string"), lit('</script> and $x_2$ cost $5 or \\(y^2\\).</p><script type="math/tex; mode=display">z</script><span class="katex"><math><semantics><annotation encoding="application/x-tex">q</annotation></semantics></math></span><math display="block"><annotation encoding="application/x-tex">m</annotation></math><pre>$n$</pre>'))
    images = F.concat(lit('<img src="/i/'), k.cast("string"), lit('.png" alt="One"><img data-src="/i/'), k.cast("string"), lit('.png"><img src="data:x"><img srcset="b.png 2x, c.png 3x"><svg><title>Sign</title></svg>'))
    inner = F.concat(lit("<h2>Head "), F.col("name"), lit('</h2><nav>Menu</nav><p>'), long, lit("</p><ul><li>A</li><li>B</li></ul><pre><code class=\"language-py\">x = 1</code></pre>"), F.when(k % 2 == 0, maths).otherwise(images))
    box = F.when(k % 3 == 0, F.concat(lit("<article>"), inner, lit("</article>"))).when(k % 3 == 1, F.concat(lit("<article>short</article><div class='x post-content'>"), inner, lit("</div>"))).otherwise(F.concat(lit("<main>tiny</main>"), inner))
    head = F.concat(lit('<html lang="en"><head><title>T '), k.cast("string"), lit('</title><meta name="author" content="Au"><meta property="og:title" content=" Og "></head><body><header>Top</header>'))
    return _parts(spark, sf_dir).select(k.alias("page_id"), text(["http://h.org/d/"], "k").alias("url"), F.concat(head, box, lit("<footer>End</footer><script>s</script></body></html>")).alias("html"), "name")


WEB = PARTS + """, w as (select k as page_id, name, k % 2 = 0 as maths, 'http://h.org/i/' || k || '.png' as image from p)
"""


@query(WEB + r"""select page_id, case when page_id % 3 = 2 then 'tiny' || chr(10) || chr(10) else '' end || '## Head ' || name || chr(10) || chr(10) || trim(repeat('word ', 120)) || chr(10) || chr(10) || '- A' || chr(10) || '- B' || chr(10) || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || chr(10) ||
case when maths then 'So  and $x_2$ cost $5 or $y^2$.' || chr(10) || chr(10) || '$q$' || chr(10) || chr(10) || '$$' || chr(10) || 'm' || chr(10) || '$$' || chr(10) || chr(10) || '```' || chr(10) || '$n$' || chr(10) || '```'
else '![One](' || image || ')![](' || image || ')![](data:x)![](http://h.org/d/b.png)![Sign](figures/SVG)' end as markdown from w""")
def page_markdown(spark, sf_dir):
    """The chrome strip takes scripts out, those with formulas too."""
    found = html.extract_pages(_web_pages(spark, sf_dir), "chrome-strip")
    return found.select("page_id", F.regexp_replace("markdown", r"svg_001_[0-9a-f]{8}\.svg", "SVG").alias("markdown"))


@query(WEB + """select page_id, case when maths then '' else '1:' || image || ',4:http://h.org/d/b.png' end as images, cast(case when maths then 0 else 5 end as bigint) as found, cast(case when maths then 0 else 1 end as bigint) as skipped, cast(case when maths then 1 else 0 end as bigint) as katex, cast(0 as bigint) as mathjax_script,
cast(case when maths then 1 else 0 end as bigint) as mathml, cast(case when maths then 2 else 0 end as bigint) as raw_delim, cast(case when maths then 0 else 1 end as bigint) as inline_svgs, ' Og ' as og, 'Au' as author, 'en' as lang from w""".replace("' Og '", "'Og'"))
def page_counters(spark, sf_dir):
    found = html.extract_pages(_web_pages(spark, sf_dir), "chrome-strip")
    shown = F.array_join(F.transform("images", lambda x: F.concat(x["ord"].cast("string"), lit(":"), x["absolute"])), ",")
    return found.select("page_id", shown.alias("images"), *[F.col(f"counts.{c}").cast("long").alias(c) for c in ("found", "skipped", "katex", "mathjax_script", "mathml", "raw_delim", "inline_svgs")], F.col("meta")["og:title"].alias("og"), F.col("meta")["author"].alias("author"), "lang")


@query(PARTS + r"""select k as page_id, case when k % 3 = 2 then 'chrome-strip' else 'readability' end as extractor,
case when k % 3 = 2 then 'Side text, of ' || name || ', is here, and long enough to count.' || chr(10) || chr(10) else '' end || 'First paragraph of ' || name || ', which is long, and has commas.' || chr(10) || chr(10) || 'Second one, about the same, of ' || k || ', with ![P](http://h.org/p.png) in it.'
|| case when k % 3 = 1 then chr(10) || chr(10) || '- an item of a list' || chr(10) || '- another item of it' else '' end || case when k % 3 = 2 then chr(10) || chr(10) || repeat('![](http://h.org/x.png)', 5) else '' end as markdown from p""")
def readable_pages(spark, sf_dir):
    """The densest box without the side bar; a page that would lose nearly all of many images is stripped of chrome instead."""
    k = F.col("k")
    side = F.concat(lit('<div class="{}"><p>Side text, of ').alias("s"), "name", lit(", is here, and long enough to count.</p></div>"))
    text_ = F.concat(lit("<p>First paragraph of "), "name", lit(", which is long, and has commas.</p><p>Second one, about the same, of "), k.cast("string"), lit(', with <img src="/p.png" alt="P"> in it.</p>'))
    side = F.replace(side, lit("{}"), F.when(k % 3 == 2, "side").otherwise("sidebar"))
    box = F.concat(lit('<div class="post">'), text_, F.when(k % 3 == 1, "<ul><li>an item of a list</li><li>another item of it</li></ul><div class='widget'>Buy, buy, buy</div>").otherwise(""), lit("</div>"))
    more = F.when(k % 3 == 2, F.concat(lit("<div>"), F.repeat(lit('<img src="/x.png">'), 5), lit("</div>"))).otherwise("")
    rows = _parts(spark, sf_dir).select(k.alias("page_id"), lit("http://h.org/a").alias("url"), F.concat(lit("<html><body>"), side, box, more, lit("<footer><a href='/'>End</a></footer></body></html>")).alias("html"))
    return html.extract_pages(rows).select("page_id", "extractor", "markdown")


# ---- videos and books ----


@query("""with v as (select conv_id, count(*) as turns from conversations group by conv_id)
select conv_id as video_id, '---' || chr(10) || 'title: "Talk ' || conv_id || '"' || chr(10) || 'channel: "ü"' || chr(10) || 'url: http://v.org/' || conv_id || chr(10) || 'duration: ' || (turns * 30) // 60 || ':' || lpad(cast(turns * 30 % 60 as varchar), 2, '0') || chr(10) || 'transcript_source: yt-dlp-subs' || chr(10) || '---' || chr(10) || chr(10) || '# Talk ' || conv_id || chr(10) || chr(10)
|| case when turns % 2 = 0 then '## Chapters' || chr(10) || chr(10) || '- [0:00] Start' || chr(10) || '- Rest' || chr(10) || chr(10) else '' end || '## Transcript' || chr(10) || chr(10) || '````text' || chr(10) || turns || ' turns' || chr(10) || '````' || chr(10) as content,
'{"source":"video-transcript","transcript_source":"yt-dlp-subs","url":"http://v.org/' || conv_id || '"}' as profile from v""")
def video_bundles(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("turns"))
    candidates = turns.select("video_id", F.explode(F.array(lit("faster-whisper"), lit("yt-dlp-subs"), lit("other"))).alias("source"))
    chapters = F.when(F.col("turns") % 2 == 0, F.array(F.struct(lit(0.0).alias("start_time"), lit("Start").alias("title")), F.struct(lit(None).cast("double").alias("start_time"), lit("Rest").alias("title")))).otherwise(F.from_json(lit("[]"), "array<struct<start_time:double,title:string>>"))
    videos = turns.join(media.choose_source(candidates), "video_id").select("video_id", text(["Talk "], "video_id").alias("title"), lit("ü").alias("channel"), text(["http://v.org/"], "video_id").alias("url"), (F.col("turns") * 30).alias("duration"), "transcript_source", chapters.alias("chapters"), text("turns", [" turns\n\n"]).alias("text"))
    return media.video_content(videos).join(media.video_profile(videos), "video_id")


BOOK = TOC + """, rng as (select *, cast(least(page, 110) as bigint) as lo, cast(greatest(least(page, 110), least(coalesce((select b.page - 1 from e b where b.idx > a.idx and b.level <= a.level order by b.idx limit 1), 110), 110)) as bigint) as hi, regexp_replace(lower(title), '[\\s_]+', '-', 'g') as slug from e a)
""".replace("\\\\", "\\")


@query(BOOK.replace("with toc", "with toc", 1) + """, sel as (select cast(idx as varchar) as sel from e union select lower(slug) from rng union select upper(left(title, 4)) from e union select 'nothing'),
c as (select sel, idx, level, title, slug, lo, hi, case when regexp_matches(sel, '^[0-9]+$') and cast(idx as varchar) = sel then 1 when slug = lower(sel) then 2 when contains(lower(title), lower(sel)) then 3 end as rank from sel, rng)
select sel, cast(idx as bigint) as idx, title, lo as physical_start, hi as physical_end, rank from (select *, row_number() over (partition by sel order by rank, idx) as r from c where rank is not null) where r = 1""")
def section_choice(spark, sf_dir):
    ranges = book.toc_ranges(d.toc(spark, sf_dir), 110)
    made = ranges.select("book", F.explode(F.array(F.col("idx").cast("string"), F.col("slug"), F.upper(F.substring("title", 1, 4)), lit("nothing"))).alias("sel")).distinct()
    return book.resolve_sections(ranges, made).select("sel", "idx", "title", "physical_start", "physical_end", "rank")


@query(PARTS + """select k, cast(size as bigint) as first, cast(case when k % 3 = 0 then size else size + k % 7 end as bigint) as last, cast(case when k % 2 = 0 then size when k % 5 <> 0 then size + 13 else 900 + k end as bigint) as start from p""")
def range_choice(spark, sf_dir):
    k = F.col("k")
    spec = book.parse_range(F.when(k % 3 == 0, F.col("size").cast("string")).otherwise(text("size", ["-"], F.col("size") + k % 7)))
    section = F.struct((k + 900).cast("int").alias("first"), (k + 901).cast("int").alias("last"))
    rows = _parts(spark, sf_dir).select("k", spec.alias("r"), section.alias("s"))
    chosen = book.choose_range(F.when(k % 2 == 0, F.col("r")), F.when(k % 5 != 0, F.col("r")), lit(13), F.col("s"))
    return rows.select("k", *[x.cast("long").alias(c) for c, x in (("first", F.col("r.first")), ("last", F.col("r.last")), ("start", chosen["first"]))])


PAGES = "with pg as (select source as book, row_number() over (partition by source order by doc_id) as n, doc_id from documents)\n"


def _book_pages(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("page_num"), "doc_id")
    head = F.when((F.col("page_num") == 3) & (F.col("book") != "none"), "x\nThe Contents\n").otherwise("A page\n")
    return rows.withColumn("text", F.concat(head, F.col("doc_id").cast("string")))


@query(PAGES + "select book, n as page_num, doc_id from pg join (select book, max(n) as m from pg group by book) using (book) where n between 2 and 2 + m // 2")
def book_slices(spark, sf_dir):
    pages = _book_pages(spark, sf_dir)
    ranges = pages.groupBy("book").agg(lit(2).alias("first"), (2 + F.floor(F.max("page_num") / 2)).alias("last"))
    return book.slice_pages(pages, ranges).select("book", "page_num", "doc_id")


@query(PAGES + """, m as (select book, max(n) as m from pg group by book), g as (select book, m, case when m >= 3 then 2 else 0 end as lo, case when m >= 3 then least(16, m) else least(30, m) end as hi from m)
select book, lo, cast(hi as bigint) as hi, string_agg('===== PHYSICAL PAGE ' || n || ' =====' || chr(10) || case when n = 3 then 'x' || chr(10) || 'The Contents' || chr(10) else 'A page' || chr(10) end || doc_id, chr(10) || chr(10) order by n) as text from pg join g using (book) where n > lo and n <= hi group by all""")
def toc_probes(spark, sf_dir):
    pages = _book_pages(spark, sf_dir)
    region = book.toc_region(pages)
    return region.join(book.dump_pages(pages, region), "book").select("book", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("long").alias("hi"), "text")


@query(BOOK + """select sel, '{"source_pdf":"w.pdf","book_slug":"world","selection":"' || sel || '","label":"' || slug || '","physical_start":' || lo || ',"physical_end":' || hi || ',"pages":' || hi - lo + 1 || ',"mode":"quick","extract_rc":0}' as record from (select *, cast(idx as varchar) as sel from rng)""")
def section_records(spark, sf_dir):
    ranges = book.toc_ranges(d.toc(spark, sf_dir), 110)
    found = book.resolve_sections(ranges, ranges.select("book", F.col("idx").cast("string").alias("sel")))
    chosen = found.select("book", "sel", F.col("slug").alias("label"), "physical_start", "physical_end", lit("quick").alias("mode"), lit(0).alias("extract_rc"), lit("w.pdf").alias("source_pdf"))
    return book.section_record(chosen).select("sel", "record")


@query(BOOK + """select '{"source_pdf":"w.pdf","book_slug":"world","page_count":110,"toc_source":"outline","delta":0,"metadata":{"title":"W"},"entries":[' || string_agg('{"level":' || level || ',"title":"' || title || '","slug":"' || slug || '","physical_start":' || lo || ',"physical_end":' || hi || ',"pages":' || hi - lo + 1 || '}', ',' order by idx) || ']}' as record from rng""")
def book_maps(spark, sf_dir):
    books = spark.createDataFrame([("world", "w.pdf", 110, 0, "W", None)], "book string, source_pdf string, page_count int, delta int, title string, author string")
    return book.book_map(book.toc_ranges(d.toc(spark, sf_dir), 110), books).select("record")


@query("""with m as (select doc_id, unnest(['$a_{' || doc_id || '}$', '$b_{' || doc_id || '$', '$$' || chr(10) || 'c}' || chr(10) || '$$', '$\\{d$']) as snippet, unnest([true, false, false, true]) as good from documents) select doc_id, snippet from m where not good""".replace("\\\\", "\\"))
def latex_checks(spark, sf_dir):
    own = F.col("doc_id").cast("string")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(lit("So $a_{"), own, lit("}$ and $b_{"), own, lit("$ then\n$$\nc}\n$$\nand $\\{d$ end")).alias("text"))
    return pdf.latex_warnings(rows)


@query(PAGES + """, z as (select book, max(n) as m from pg group by book), r as (select *, greatest(floor(m * 0.15), 5) as lo from z), y as (select *, greatest(m - 2, lo + 1) as hi from r), x as (select *, greatest(floor((hi - lo) / 20), 1) as step from y),
f as (select book, n as physical, n - 4 - case when doc_id % 7 = 0 then 1 else 0 end as folio from pg join x using (book) where n - 1 >= lo and n - 1 < hi and (n - 1 - lo) % step = 0)
select * from (select book, row_number() over (partition by book order by physical) as rank, physical, cast(folio as bigint) as folio, cast(physical - folio as bigint) as delta from f where folio between 1 and 9999) where rank <= 5""")
def delta_evidence(spark, sf_dir):
    folio = F.col("page_num") - 4 - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    pages = _book_pages(spark, sf_dir).withColumn("text", F.concat("text", lit("\n"), folio.cast("string")))
    return book.delta_evidence(pages, 5).select("book", *[F.col(c).cast("long").alias(c) for c in ("rank", "physical", "folio", "delta")])


@query("""with p as (select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')) as chars, doc_id % 3 as images from documents),
t as (select *, case when chars < 50 and images >= 1 then 'scanned' when chars > 200 then 'native' else 'mixed' end as type from p)
select source as doc_group, doc_id as page_num from (select *, bool_and(type = 'native') over (partition by source) as clean from t) where clean or type <> 'native'""".replace("\\\\", "\\"))
def render_worklist(spark, sf_dir):
    """Where no candidate is good enough."""
    profiles = pdf.profile_pages(d.pdf_pages(spark, sf_dir))
    docs = pdf.profile_docs(profiles)
    strategies = F.explode(F.array(*[lit(x) for x in ("pymupdf", "marker", "nougat", "ocr")]))
    bad = docs.select("doc_group", strategies.alias("strategy"), lit("!!!!!!! " * 3).alias("text"))
    return pdf.render_worklist(pdf.run_ladder(docs, bad, threshold=1.1), profiles)


@query(REGIONS + """select 'book' as kind, 'b' || rk as book, region as title, 10 as n from r union all select 'entry', 'b' || rk, nation, cast(nk + 1 as integer) from n""")
def outlines(spark, sf_dir):
    regions, nations = _regions(spark, sf_dir)
    lists = nations.groupBy("rk").agg(F.transform(F.array_sort(F.collect_list(F.struct("nk", "nation"))), lambda x: F.array(lit("1"), x["nation"], (x["nk"] + 1).cast("string"))).alias("outline"))
    files = regions.join(lists, "rk").select(text(["b"], "rk").alias("book"), F.to_json(F.struct(F.struct(F.col("region").alias("title"), lit("").alias("author")).alias("metadata"), lit(10).alias("page_count"), "outline")).alias("text"))
    books, entries = sources.read_outlines(files)
    return books.select(lit("book").alias("kind"), "book", "title", F.col("page_count").alias("n")).unionByName(entries.select(lit("entry").alias("kind"), "book", "title", F.col("page").cast("int").alias("n")))


@query("select true as first, false as second, false as empty, count(*) as n, 'i1,i2' as ingests from (select 1 from region union all select 1 from nation)")
def ingests(spark, sf_dir):
    """Two ingests, one of them tried twice, and an empty one."""
    regions, nations = _regions(spark, sf_dir)
    folder, own = _folder(spark)
    path = f"{folder}/table"
    rows = regions.select(F.col("rk").cast("long").alias("k"))
    first, second = sinks.ingest(rows, path, "i1"), sinks.ingest(rows, path, "i1")
    sinks.ingest(nations.select(F.col("nk").cast("long").alias("k")), path, "i2")
    empty = sinks.ingest(rows.limit(0), path, "i3")
    table = spark.read.parquet(path)
    counts = table.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("ingest")), ",").alias("ingests"))
    return _gathered(spark, folder, own, counts.select(lit(first).alias("first"), lit(second).alias("second"), lit(empty).alias("empty"), "n", "ingests"))


# ---- LaTeX ----


def _papers(spark, sf_dir) -> DataFrame:
    """bundle_id, file, text of a paper for each part: even ones are cut at their includes, odd ones at their sections."""
    k = F.col("k")
    even = F.concat(lit("\\documentclass{a} % note\n\\begin{document}\nHello\n\\input{sections/one}\nBetween\n\\include{two.tex}\n\\input{gone}\nBye\n\\end{document}\nrest"))
    odd = F.concat(lit("\\documentclass{a}\n\\begin{document}\nHead\n\\section{First "), "name", lit("}\nA % gone\n\\input{sections/one}\n\\section*{Second}\nB 5\\% of\n\\end{document}\n"))
    main = F.when(k % 2 == 0, even).otherwise(odd)
    rows = F.array(
        F.struct(F.when(k % 3 == 0, "paper.tex").otherwise("a/b/main.tex").alias("file"), F.when(k % 3 == 0, main).otherwise("\\documentclass{x}").alias("text")),
        F.struct(F.when(k % 3 == 0, "z.tex").otherwise("ms.tex").alias("file"), F.when(k % 3 == 0, lit("\\documentclass{a}\\begin{document}no\\end{document}")).otherwise(main).alias("text")),
        F.struct(lit("sections/one.tex").alias("file"), F.concat(lit("\\section{One of "), "name", lit("}\nInner\n\\input{sections/deep}")).alias("text")),
        F.struct(lit("sections/deep.tex").alias("file"), lit("Deep % x\n\\input{sections/one}").alias("text")),
        F.struct(lit("two.tex").alias("file"), lit("No title here").alias("text")),
    )
    return _parts(spark, sf_dir).select(k.alias("bundle_id"), F.explode(rows).alias("f")).select("bundle_id", "f.file", "f.text")


@query(PARTS + "select k as bundle_id, case when k % 3 = 0 then 'paper.tex' else 'ms.tex' end as main from p")
def tex_mains(spark, sf_dir):
    return latex.main_file(_papers(spark, sf_dir))


@query(PARTS + r""", one as (select *, '\section{One of ' || name || '}' || chr(10) || 'Inner' || chr(10) || 'Deep ' || chr(10) as "inner" from p)
select k as bundle_id, 0 as ord, 'sections/01_front-matter.tex' as file, 'front-matter' as title_hint, case when k % 2 = 0 then 'Hello' else 'Head' end as content from one
union all select k, 1, 'sections/02_one-of-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.tex', left('One of ' || name, 80), "inner" from one where k % 2 = 0
union all select k, 1, 'sections/02_first-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.tex', 'First ' || name, '\section{First ' || name || '}' || chr(10) || 'A ' || chr(10) from one where k % 2 = 1
union all select k, 2, 'sections/03_interlude-1.tex', 'interlude-1', 'Between' from one where k % 2 = 0 union all select k, 3, 'sections/04_two.tex', 'two', 'No title here' from one where k % 2 = 0
union all select k, 4, 'sections/05_unresolved-2.tex', 'unresolved-2', '\input{gone}' from one where k % 2 = 0 union all select k, 5, 'sections/06_tail-3.tex', 'tail-3', 'Bye' from one where k % 2 = 0
union all select k, 2, 'sections/03_one-of-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.tex', 'One of ' || name, "inner" from one where k % 2 = 1
union all select k, 3, 'sections/04_second.tex', 'Second', chr(10) || '\section*{Second}' || chr(10) || 'B 5\% of' || chr(10) from one where k % 2 = 1""")
def tex_parts(spark, sf_dir):
    return latex.tex_sections(_papers(spark, sf_dir)).select("bundle_id", "ord", "file", "title_hint", "content")


@query(PARTS + r"""select k as bundle_id, 'raw/preamble.tex' as path, '\documentclass{a}' || chr(10) as text from p
union all select k, 'raw/refs.bib', 'second' from p union all select k, 'raw/figures.json', '{"figures":[],"stats":{"total":0,"with_image":0,"tikz_only":0,"missing":0}}' from p
union all select k, 'raw/sections/01_front-matter.tex', case when k % 2 = 0 then 'Hello' else 'Head' end || chr(10) from p
union all select k, 'raw/structure.json', '{"arxiv_id":"1234.' || k || '","version":null,"main_tex":"' || case when k % 3 = 0 then 'paper.tex' else 'ms.tex' end || '","sections":[{"file":"sections/01_front-matter.tex","title_hint":"front-matter"},{"file":"sections/02_' || regexp_replace(lower(case when k % 2 = 0 then 'one of ' else 'first ' end || name), '[^a-z0-9]+', '-', 'g') || '.tex","title_hint":"' || case when k % 2 = 0 then 'One of ' else 'First ' end || name || '"},'
|| case when k % 2 = 0 then '{"file":"sections/03_interlude-1.tex","title_hint":"interlude-1"},{"file":"sections/04_two.tex","title_hint":"two"},{"file":"sections/05_unresolved-2.tex","title_hint":"unresolved-2"},{"file":"sections/06_tail-3.tex","title_hint":"tail-3"}],"warnings":["cyclic include skipped: sections/one.tex","unresolved include: gone"]}'
else '{"file":"sections/03_one-of-' || regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') || '.tex","title_hint":"One of ' || name || '"},{"file":"sections/04_second.tex","title_hint":"Second"}],"warnings":["cyclic include skipped: sections/one.tex"]}' end from p""")
def paper_files(spark, sf_dir):
    """Without the sections after the first, which tex_parts shows."""
    files = _papers(spark, sf_dir)
    papers = _parts(spark, sf_dir).select(F.col("k").alias("bundle_id"), text(["1234."], "k").alias("arxiv_id"), lit(None).cast("string").alias("version"))
    bib = papers.select("bundle_id", F.explode(F.map_from_arrays(F.array(lit("a/refs.bib"), lit("b/refs.bib")), F.array(lit("first"), lit("second")))).alias("file", "text"))
    sections = latex.tex_sections(files)
    none = latex.copied_names(files).limit(0)
    made = latex.paper_bundle(papers, files.unionByName(bib), sections, latex.tex_figures(sections, none))
    return made.where(~F.col("path").rlike("raw/sections/0[2-9]"))


@query(PARTS + r"""select k, '\input sections/' || k as unhandled, 'Deep ' || name as title, 'a/b' || k || ',c,d' as targets, '\documentclass{a}' as preamble, case when k % 2 = 0 then ' one \end{document} two ' end as body from p""")
def tex_scalars(spark, sf_dir):
    tex = F.concat(lit("\\documentclass{a}\\begin{document} one \\end{document} two "), F.when(F.col("k") % 2 == 0, "\\end{document} end").otherwise(""))
    found = F.concat(lit("\\subimport{a/}{b"), F.col("k").cast("string"), lit("}\\input{c}\\import{}{d} \\input sections/"), F.col("k").cast("string"), lit("\n\\chapter*{ Deep   "), "name", lit(" }"))
    # an odd part's document ends once only: its body is what is between
    body = t.document_body(F.when(F.col("k") % 2 == 0, tex).otherwise("\\end{document}\\begin{document}"))
    return _parts(spark, sf_dir).select("k", F.array_join(t.unhandled_includes(found), ",").alias("unhandled"), t.section_title(found).alias("title"), F.array_join(t.include_targets(found), ",").alias("targets"), t.preamble_of(tex).alias("preamble"), body.alias("body"))


def _figure_sections(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    one = F.concat(lit("Text\n\\begin{figure}\n\\includegraphics[w]{img/a.pdf}\\includegraphics{img/a.pdf}\n\\caption[s]{A {big} "), "name", lit("\\label{fig:a}}\n\\end{figure}\nMore"))
    two = lit("\n\\begin{figure*}\\begin{tikzpicture}\\draw (0,0);\\end{tikzpicture}\\label{fig:t}\\end{figure*}\n\\begin{figure}\\begin{subfigure}{1}\\includegraphics{b}\\caption{Sub}\\end{subfigure}\\caption{Out}\\end{figure}\\begin{figure}\\includegraphics{lost}")
    done = F.when(k % 2 == 0, lit("\\end{figure}")).otherwise("")
    sections = _parts(spark, sf_dir).select(k.alias("bundle_id"), lit(0).alias("ord"), lit("sections/00-x.tex").alias("file"), F.concat(one, two, done).alias("content"))
    files = sections.select("bundle_id", F.explode(F.array(lit("img/a.pdf"), lit("deep/a.png"), lit("img/b.PNG"), lit("c.txt"))).alias("file"))
    return sections, files


@query(PARTS + """select k as bundle_id, 'a.png' as name, 'deep/a.png' as source from p union all select k, 'b.PNG', 'img/b.PNG' from p""")
def figure_copies(spark, sf_dir):
    return latex.copied_names(_figure_sections(spark, sf_dir)[1])


def _figures(spark, sf_dir) -> DataFrame:
    sections, files = _figure_sections(spark, sf_dir)
    return latex.tex_figures(sections, latex.copied_names(files).withColumn("name", F.lower("name")))


@query(PARTS + r"""select k as bundle_id, 0 as ord, 'fig:a' as label, 'A {big} ' || name as caption, 'img/a.pdf,img/a.pdf' as refs, 'figures/a.png,figures/a.png' as paths, false as tikz, true as available, '' as subs from p
union all select k, 1, 'fig:t', null, '', '', true, true, '' from p union all select k, 2, null, 'Out', '', '', false, true, 'Sub:figures/b.png' from p union all select k, 3, null, null, 'lost', '', false, false, '' from p where k % 2 = 0""")
def figure_records(spark, sf_dir):
    subs = F.transform("subfigures", lambda s: F.concat(F.coalesce(s["caption"], lit("")), lit(":"), F.array_join(s["resolved_paths"], "+")))
    return _figures(spark, sf_dir).select("bundle_id", "ord", "label", "caption", F.array_join("image_refs", ",").alias("refs"), F.array_join("resolved_paths", ",").alias("paths"), F.col("has_tikz").alias("tikz"), "available", F.array_join(subs, ",").alias("subs"))


@query(PARTS + "select k as bundle_id, cast(case when k % 2 = 0 then 4 else 3 end as bigint) as total, cast(1 as bigint) as with_image, cast(1 as bigint) as tikz_only, cast(case when k % 2 = 0 then 1 else 0 end as bigint) as missing from p")
def figure_counts(spark, sf_dir):
    return latex.figure_stats(_figures(spark, sf_dir))


@query(PARTS + r"""select k as bundle_id, '---' || chr(10) || 'title: "' || name || '"' || chr(10) || 'arxiv_id: 1234.' || k || chr(10) || '---' || chr(10) || chr(10) || '````latex' || chr(10) || '% ==== preamble.tex ====' || chr(10) || '\usepackage{x}' || chr(10) || '````' || chr(10) || chr(10) || '% ==== sections/00-x.tex ====' || chr(10) || 'Text' || chr(10)
|| '![fig:a](raw/figures/a.png)' || chr(10) || chr(10) || '> **fig:a** — A {big} ' || name || chr(10) || 'More' || chr(10) || '_No rendered image — raw TikZ source:_' || chr(10) || chr(10) || '````latex' || chr(10) || '\begin{tikzpicture}\draw (0,0);\end{tikzpicture}' || chr(10) || '````' || chr(10)
|| '\begin{figure}\begin{subfigure}{1}\includegraphics{b}\caption{Sub}\end{subfigure}\caption{Out}\end{figure}\begin{figure}\includegraphics{lost}' || case when k % 2 = 0 then '\end{figure}' else '' end || chr(10) || chr(10)
|| '## Figures' || chr(10) || chr(10) || '_Figures whose position in the text could not be determined:_' || chr(10) || chr(10) || '### figure-1 — `sections/00-x.tex`' || chr(10) || chr(10) || '> **figure-1** — Out' || chr(10) || chr(10) || '![figure-1.1](raw/figures/b.png)' || chr(10) || chr(10) || '> **figure-1.1** — Sub' || chr(10)
|| case when k % 2 = 0 then chr(10) || '### figure-2 — `sections/00-x.tex`' || chr(10) else '' end as content from p""")
def paper_texts(spark, sf_dir):
    sections, _ = _figure_sections(spark, sf_dir)
    papers = _parts(spark, sf_dir).select(F.col("k").alias("bundle_id"), F.col("name").alias("title"), text(["1234."], "k").alias("arxiv_id"), lit("\\usepackage{x}\n").alias("preamble"))
    return latex.paper_content(sections, _figures(spark, sf_dir), papers)


@query("""with b as (select l_orderkey as k, l_linenumber as n, 'd' || l_quantity % 3 as x from lineitem), q as (select *, row_number() over (partition by k, x order by n) as i from b), r as (select *, row_number() over (partition by k, x order by n desc) as i from b)
select q.k as bundle_id, q.n as block_seq, 10 - r.n as picture_seq from q join r on q.k = r.k and q.x = r.x and q.i = r.i where q.k % 5 <> 0""")
def picture_matches(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").alias("n"), F.concat(lit("d"), (F.col("l_quantity") % 3).cast("string")).alias("x"))
    blocks = lines.select("bundle_id", F.col("n").alias("seq"), F.concat("x", lit(" \n;")).alias("text"))
    rendered = lines.select("bundle_id", (10 - F.col("n")).alias("seq"), F.concat(lit(" "), "x", lit(";")).alias("text"))
    spare = lines.where("bundle_id % 5 = 0").select("bundle_id").distinct().select("bundle_id", lit(99).cast(rendered.schema["seq"].dataType).alias("seq"), lit("more").alias("text"))
    return latex.match_pictures(blocks, rendered.unionByName(spare))


STAND_INS = latex.STAND_INS.replace("'", "''")


@query(PARTS + rf"""select k, '\usepackage{{tikz}}' || chr(10) || chr(10) || '\providecommand{{\x}}{{' || name || '}}\\' || case when k % 2 = 0 then 'Z' else '' end as clean,
'\documentclass[border=2pt]{{standalone}}' || chr(10) || '\usepackage{{tikz}}' || chr(10) || '\usepackage{{amsmath,amssymb}}' || chr(10) || '{STAND_INS}' || '\def\a{{1}}' || chr(10) || '\begin{{document}}' || chr(10) || 'P' || k || chr(10) || '\end{{document}}' || chr(10) as standalone from p""")
def standalone_pictures(spark, sf_dir):
    raw = F.concat(lit("\\documentclass[a[b]c]{acm}\\usepackage{tikz}\n\\usepackage[x]{ geometry , other}\\title[s]{A {nested} title}\\acmConference[a]{b}{c}{d}\n\\renewcommand{\\x}{"), "name", lit("}\\\\"), F.when(F.col("k") % 2 == 0, "Z").otherwise(""), lit("\\maketitle\\pdfoutput=1\\thanks{open"))
    return _parts(spark, sf_dir).select("k", latex.clean_preamble(raw).alias("clean"), latex.build_standalone(lit("\\def\\a{1}\\date{x}"), text(["P"], "k")).alias("standalone"))


# ---- reports of graphs ----


@query(AUDIT + """, pick as (
  select 'A' as bucket, -total_in as a, nseq as b, slug, '  ' || rpad(slug, 38, ' ') || ' ' || lpad(cast(n_d as varchar), cast(greatest(2, length(cast(n_d as varchar))) as integer), ' ') || ' discusser(s), ' || lpad(cast(related_only_count as varchar), cast(greatest(2, length(cast(related_only_count as varchar))) as integer), ' ') || ' related-to-from-concepts' as line from x where defined_by = '' and total_in > 0
  union all select 'B', 0, 0, slug, '  ' || slug from x where total_in = 0
  union all select 'C', 0, 0, slug, '  ' || rpad(slug, 38, ' ') || ' defined by ' || replace(defined_by, ',', ', ') from x where papers_count = 1 and defined_by <> ''
  union all select 'D', -related_only_count, nseq, slug, '  ' || rpad(slug, 38, ' ') || ' related-to×' || related_only_count from x where anchor_count = 0 and related_only_count > 0 and defined_by <> ''),
heads(bucket, line) as (values ('A', '=== A. Mentioned but never DEFINED — ingest the foundational paper ==='), ('B', '=== B. Orphan concepts — no incoming edges (stale?) ==='), ('C', '=== C. Single-paper concepts — sibling paper would deepen them ==='), ('D', '=== D. Weakly anchored — only related-to edges, no is-a / part-of ==='))
select bucket, cast(0 as bigint) as rank, line from heads union all select bucket, 1, '  (none)' from heads where bucket not in (select bucket from pick)
union all select bucket, row_number() over (partition by bucket order by a, b, slug), line from pick""".replace("from x ", "from (select audit.*, n.seq as nseq, case when discussed_by = '' then 0 else len(string_split(discussed_by, ',')) end as n_d from audit join nodes n using (slug)) ").replace("audit.*, n.seq", "audit.*, n.seq"))
def audit_report(spark, sf_dir):
    return audit.report_lines(audit.audit_concepts(d.nodes(spark, sf_dir), d.edges(spark, sf_dir)))


@query(VAULT + "select cast((select count(*) from pages) as bigint) as pages, cast((select count(*) from vedges) as bigint) as edges")
def index_totals(spark, sf_dir):
    return validate.index_totals(validate.read_pages(d.vault_files(spark, sf_dir)), d.faulty_edges(spark, sf_dir))


def _root(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The root graph of the corpora: bridges, same-as edges with their place, and candidates of two regions."""
    nodes = d.corpus_nodes(spark, sf_dir)
    bridges = reconcile.confirmed_bridges(nodes)
    same = reconcile.same_as_edges(bridges).withColumn("seq", F.xxhash64("from", "to")).withColumn("context", lit(None).cast("string"))
    return reconcile.root_nodes(nodes, bridges), same


@query(CORPORA + "select * from bridges")
def bridge_groups(spark, sf_dir):
    """The corpora of each bridge; in which order they are named depends on the edges, so they are sorted here."""
    return reconcile.bridge_groups(*_root(spark, sf_dir)).select("slug", F.array_join(F.array_sort("corpora"), ",").alias("corpora"))


@query(CORPORA + """, rn as (select corpus || '/' || slug as slug, slug as local, title, corpus from cn where type = 'concept' and slug in (select slug from bridges)), c as (select *, row_number() over (partition by corpus order by slug) as i from rn)
select '- **' || coalesce(a.title, a.slug) || '** (' || a.corpus || ') ↔ **' || case when a.i % 3 = 0 then 'gone' else b.title || '' end || '** (' || case when a.i % 3 = 0 then '?' else b.corpus end || ')' || case when a.i % 2 = 0 then '  — near' else '' end as line, a.i as rank
from c a join c b on a.i = b.i where a.corpus = (select r_name from region where r_regionkey = 0) and b.corpus = (select r_name from region where r_regionkey = 1)""")
def synonym_lines(spark, sf_dir):
    from pyspark.sql import Window

    nodes, _ = _root(spark, sf_dir)
    names = [r.r_name for r in _table(spark, sf_dir, "region").where("r_regionkey < 2").orderBy("r_regionkey").collect()]
    place = nodes.withColumn("i", F.row_number().over(Window.partitionBy("corpus").orderBy("slug")))
    a, b = (place.where(F.col("corpus") == n).select(F.col("slug").alias(c), "i") for n, c in zip(names, ("from", "to"), strict=True))
    edges = a.join(b, "i").select("from", F.when(F.col("i") % 3 == 0, "gone").otherwise(F.col("to")).alias("to"), lit("same-as?").alias("predicate"), F.when(F.col("i") % 2 == 0, "near").alias("context"), F.col("i").cast("long").alias("seq"))
    return reconcile.synonym_lines(nodes, edges).select("line", F.col("rank").cast("long").alias("rank"))


@query(CORPORA + """select 'node' as kind, corpus || '/' || slug as a, title as b from cn where type = 'concept' and slug in (select slug from bridges) union all select 'node', 'theme/own', 'Own'
union all select 'edge', a.corpus || '/' || a.slug, b.corpus || '/' || b.slug from (select distinct slug, corpus from cn where type = 'concept') a join (select distinct slug, corpus from cn where type = 'concept') b on a.slug = b.slug and a.corpus < b.corpus union all select 'edge', 'theme/own', 'x'""")
def root_graph(spark, sf_dir):
    """What an earlier run added by hand stays: a theme with its edge; its same-as edges and confirmed nodes are made anew."""
    nodes, edges = _root(spark, sf_dir)
    theme = spark.createDataFrame([("theme/own", None, None, "Own", "theme")], nodes.schema)
    old_edges = spark.createDataFrame([("theme/own", "x", "covers"), ("gone", "gone too", "same-as")], "`from` string, `to` string, predicate string")
    kept_nodes, kept_edges = reconcile.carry_over(nodes, edges, theme.unionByName(nodes.withColumn("title", lit("stale"))), old_edges)
    return kept_nodes.select(lit("node").alias("kind"), F.col("slug").alias("a"), F.col("title").alias("b")).unionByName(kept_edges.select(lit("edge").alias("kind"), F.col("from").alias("a"), F.col("to").alias("b")))


# ---- files ----


def _folder(spark) -> tuple[str, bool]:
    """A folder that driver and executors share, and whether it is a temporary one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}", False
    return f"file://{tempfile.mkdtemp(prefix='loomery-')}", True


def _gathered(spark, folder: str, own: bool, df: DataFrame) -> DataFrame:
    """df, which reads files of a temporary folder, as rows of its own; the files of one small table are bounded by it."""
    if not own:
        return df
    rows = spark.createDataFrame(df.collect(), df.schema)
    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    return rows


@query(REGIONS + """, x as (select region as corpus, 'n-' || nk // 2 as slug, nation as title, nk from n join r using (rk))
select corpus, slug, max_by(title, nk) as title, 'concept' as type from x group by corpus, slug""")
def graph_files(spark, sf_dir):
    """The graphs of all corpora, written as files and read again; of nodes of one slug the last holds."""
    regions, nations = _regions(spark, sf_dir)
    nodes = nations.join(regions, "rk").select(F.col("region").alias("corpus"), text(["n-"], F.floor(F.col("nk") / 2)).alias("slug"), F.col("nation").alias("title"), lit("concept").alias("type"), F.col("nk").cast("long").alias("seq"))
    folder, own = _folder(spark)
    entry = F.struct("slug", "title", "type")
    graphs = nodes.groupBy("corpus").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("seq", entry.alias("x")))), lambda x: x["x"]).alias("nodes"), F.from_json(lit("[]"), "array<string>").alias("edges"))).alias("text"))
    hidden = spark.createDataFrame([(".trash", '{"nodes": [{"slug": "no"}], "edges": []}')], "corpus string, text string")
    sinks.write_files(graphs.unionByName(hidden).select(text("corpus", ["/graph.json"]).alias("path"), "text"), folder)
    return _gathered(spark, folder, own, reconcile.latest_nodes(sources.read_graphs(spark, folder)[0]).select("corpus", "slug", "title", "type"))


@query(REGIONS + """select 'page' as kind, 'n' || nk as name, nation as value from n union all select 'source', 'n' || nk || '-source', '' from n where nk % 2 = 0 union all select 'node', 'n' || nk, nation from n union all select 'edge', 'n' || nk, 'n' || nk + 1 from n where nk < 24
union all values ('predicate', 'cites', 'paper'), ('predicate', 'near', '*')""")
def vault_files(spark, sf_dir):
    """A vault of a page for each nation, written as files and read again."""
    nations = _regions(spark, sf_dir)[1]
    folder, own = _folder(spark)
    slug = text(["n"], "nk")
    pages = nations.select(F.concat(lit("pages/concepts/"), slug, lit(".md")).alias("path"), F.concat(lit("---\nslug: "), slug, lit("\ntitle: "), "nation", lit("\n---\nText")).alias("text"))
    docs = nations.where("nk % 2 = 0").select(F.concat(lit("sources/"), slug, lit("-source.md")).alias("path"), lit("Text").alias("text"))
    nodes = nations.select(slug.alias("slug"), F.col("nation").alias("title"), lit("concept").alias("type"), F.col("nk").cast("long").alias("seq"))
    edges = nations.where("nk < 24").select(slug.alias("from"), text(["n"], F.col("nk") + 1).alias("to"), lit("near").alias("predicate"), lit("c").alias("context"), F.col("nk").cast("long").alias("seq"))
    graph = sinks.graph_json(nodes, edges).select(lit("graph.json").alias("path"), "text")
    schema = spark.createDataFrame([("_schema.json", '{"predicates": {"cites": {"from_type": "paper", "to_type": "paper"}, "near": "any two"}}')], "path string, text string")
    sinks.write_files(reduce(DataFrame.unionByName, (pages, docs, graph, schema)), folder)
    vault = sources.read_vault(spark, folder)
    found = [
        validate.read_pages(vault["files"]).select(lit("page").alias("kind"), F.col("slug").alias("name"), F.col("fm")["title"].alias("value")), vault["source_docs"].select(lit("source"), "stem", lit("")), vault["nodes"].select(lit("node"), "slug", "title"),
        vault["edges"].select(lit("edge"), "from", "to"), vault["predicates"].select(lit("predicate"), "name", F.coalesce("from_type", lit("*"))),
    ]
    return _gathered(spark, folder, own, reduce(DataFrame.union, found))


@query("select true as made, false as again, cast(0 as bigint) as nodes, cast(16 as bigint) as predicates")
def vault_start(spark, sf_dir):
    """An empty vault is made where there is none; a second time nothing is done."""
    folder, own = _folder(spark)
    made, again = sinks.init_vault(spark, folder), sinks.init_vault(spark, folder)
    vault = sources.read_vault(spark, folder)
    counts = vault["nodes"].agg(F.count("*").alias("nodes")).select(lit(made).alias("made"), lit(again).alias("again"), "nodes", lit(vault["predicates"].count()).cast("long").alias("predicates"))
    return _gathered(spark, folder, own, counts)


@query(PARTS + """select 'p' || k as name, 'from' || size as from_type, k % 2 = 0 as is_typed from p where k % 2 = 0 union all select 'p' || k, '*', false from p where k % 2 = 1""")
def schema_predicates(spark, sf_dir):
    one = F.when(F.col("k") % 2 == 0, F.concat(lit('{"from_type": "from'), F.col("size").cast("string"), lit('", "to_type": "t"}'))).otherwise(lit('"words"'))
    files = _parts(spark, sf_dir).select(F.concat(lit('{"predicates": {"p'), F.col("k").cast("string"), lit('": '), one, lit("}}")).alias("text"))
    return parse_predicates(files).select("name", F.coalesce("from_type", lit("*")).alias("from_type"), "is_typed")


@query(PARTS + """select '1234.' || k as arxiv_id, name || ' two' as title, 'A,' || brand as authors, 'An abstract of ' || name as abstract, 'cs.X' as primary_class, 'cs.X,' || size as categories, case when k % 2 = 0 then '3' end as version from p""")
def atom_feeds(spark, sf_dir):
    k = F.col("k").cast("string")
    xml = F.concat(
        lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1234.'), k, F.when(F.col("k") % 2 == 0, "v3").otherwise(""), lit("</id><title>"), "name", lit("\n  two</title><summary>\n An  abstract of "), "name", lit("\n</summary><author><name>A</name></author><author><name>"), "brand",
        lit('</name></author><primary_category term="cs.X"/><category term="cs.X"/><category term="'), F.col("size").cast("string"), lit('"/></entry></feed>'),
    )
    found = sources.atom_metadata(_parts(spark, sf_dir).select(text(["1234."], "k").alias("arxiv_id"), xml.alias("xml")))
    return found.select("arxiv_id", "title", F.array_join("authors", ",").alias("authors"), "abstract", "primary_class", F.array_join("categories", ",").alias("categories"), "version")


def _blobs(rows):
    """k, content: a bare file, a gzipped one, or an archive of two, by k."""
    import gzip
    import io
    import tarfile

    for batch in rows:
        out = []
        for k, name in zip(batch["k"], batch["name"], strict=True):
            raw = f"text of {name}".encode()
            if k % 3 == 1:
                raw = gzip.compress(raw, mtime=0)
            elif k % 3 == 2:
                store = io.BytesIO()
                with tarfile.open(fileobj=store, mode="w:gz") as archive:
                    for file, data in (("./main.tex", raw), ("img/a.txt", b"a"), ("../evil", b"x")):
                        info = tarfile.TarInfo(file)
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
                raw = store.getvalue()
            out.append(raw)
        yield batch.assign(content=out)[["k", "content"]].rename(columns={"k": "bundle_id"})


@query(PARTS + "select k as bundle_id, 'main.tex' as file, 'text of ' || name as text from p union all select k, 'img/a.txt', 'a' from p where k % 3 = 2")
def source_archives(spark, sf_dir):
    """The table of parts is small, so a file of it may be one task; what it makes for each part isn't."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = _parts(spark, sf_dir).select("k", "name").repartition(n, "k").mapInPandas(_blobs, "bundle_id long, content binary")
    return sources.unpack_sources(blobs).select("bundle_id", "file", "text")
