"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontaminate, html_wrapper, line_dedup, packing, pii, simhash, spotsigs, tokenfile, toxicity, wordpieces
from loomery.llm.shared import new_path, table

#: The key of the surrogates. Without the deployment's own there is a new secret one in each run, so no one can work the surrogates out.
PII_KEY = os.environ.get("LOOMERY_PII_KEY") or secrets.token_hex(32)


def tokenizer(name: str) -> str:
    """Where the file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY)


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_next(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.count_pieces(table(spark, sf_dir, "documents"), wordpieces.vocabulary(tokenizer("piece_bpe_32k.model")), keep=["doc_id"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return tokenfile.read_digest(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_html_wrappers, op3_decontamination, op4_spotsigs, op5_best_fit_packing, op6_token_counts, op7_toxicity, op8_line_dedup, op9_simhash, op10_token_files, pipeline)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, m, w[i : i + m - 1] as win
       from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, m, i, w[i : i + m - 1] as win
       from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from bw) where len(w) >= m)),
occ as (select doc_id, item_id, dw.m, i from dw join bw on dw.m = bw.m and dw.win = bw.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from occ) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from occ) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)""",
    "op8_line_dedup": r"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
f as (select doc_id, k, line, trim(regexp_replace(line, '\s+', ' ', 'g')) as s from l),
p as (select *, sum(case when s <> '' then 1 else 0 end) over (partition by doc_id order by k) as place from f),
n as (select doc_id, place, s, lead(s, 1) over w as s2, lead(s, 2) over w as s3 from p where s <> '' window w as (partition by doc_id order by place)),
o as (select doc_id, place, row_number() over (partition by s, s2, s3 order by doc_id, place) as r from n where s3 is not null),
g as (select distinct doc_id, place + x as place from o, (select unnest([0, 1, 2]) as x) where r > 1),
c as (select p.*, g.place is not null as gone from p left join g on p.doc_id = g.doc_id and p.place = g.place)
select doc_id, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as text,
       cast(count(*) filter (where s <> '') as bigint) as n_lines, cast(count(*) filter (where s <> '' and gone) as bigint) as n_removed
from c group by doc_id""",
}
