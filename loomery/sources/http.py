"""Fetching over HTTP: rows of URLs to rows of answers. A task asks for its rows one after another; what went wrong is a status, not an error."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import NamedTuple
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text as t

AGENT = "loomery"
#: Attempts, seconds until an answer, and seconds before the second attempt, which double from then on.
TRIES, TIMEOUT, PAUSE = 3, 60.0, 3.0
IMAGE_BYTES = 10 << 20
#: Answers after which asking again is of no use.
FINAL = {404: "missing", 429: "limited"}


class Answer(NamedTuple):
    """status: ok, missing, limited (the server wants a longer pause), too large, or failed."""

    status: str
    body: bytes | None = None
    final_url: str | None = None
    content_type: str | None = None
    error: str | None = None


def get(url: str, accept: str = "*/*", tries: int = TRIES, timeout: float = TIMEOUT, pause: float = PAUSE, most: int | None = None) -> Answer:
    """The answer to a GET, redirects followed; up to `most` bytes."""
    problem = "no attempt"
    for k in range(tries):
        if k:
            time.sleep(pause * 2 ** (k - 1))
        try:
            with urlopen(Request(url, headers={"User-Agent": AGENT, "Accept": accept}), timeout=timeout) as reply:
                about = {"final_url": reply.url, "content_type": reply.headers.get("Content-Type")}
                announced = int(reply.headers.get("Content-Length") or 0)
                body = b"" if most and announced > most else reply.read(most + 1) if most else reply.read()
                if most and max(announced, len(body)) > most:
                    return Answer("too large", **about)
                return Answer("ok", body, **about)
        except HTTPError as e:
            if e.code in FINAL:
                return Answer(FINAL[e.code], error=str(e))
            problem = str(e)
        except (OSError, ValueError) as e:  # no connection, no time left, no URL
            problem = str(e)
    return Answer("failed", error=problem)


def fetch(rows: DataFrame, url: str = "url", accept: str = "*/*", tries: int = TRIES, timeout: float = TIMEOUT, pause: float = PAUSE, most: int | None = None, between: float = 0.0) -> DataFrame:
    """rows with status, body, final_url, content_type and error. between: seconds that a task waits after each row. A null URL fails. Run again, a lost task asks again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for x in batch[url]:
                answers.append(get(x, accept, tries, timeout, pause, most) if x else Answer("failed", error="no URL"))
                time.sleep(between)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(answers, columns=Answer._fields)], axis=1)

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "status string, body binary, final_url string, content_type string, error string"]))


def eprint_url(arxiv_id: Column, version: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/e-print/"), arxiv_id, F.coalesce(F.concat(F.lit("v"), version), F.lit("")))


def metadata_url(arxiv_id: Column) -> Column:
    return F.concat(F.lit("https://export.arxiv.org/api/query?id_list="), arxiv_id)


def pages_of(fetched: DataFrame) -> DataFrame:
    """The columns of fetched with html: the body by the charset that its type names, else UTF-8; null where the page didn't come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body, kind in zip(batch["body"], batch["content_type"], strict=True):
                charset = (kind or "").lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
                try:
                    out.append(None if body is None else bytes(body).decode(charset, "replace"))
                except LookupError:
                    out.append(bytes(body).decode("utf-8", "replace"))
            yield batch.assign(html=out)

    return fetched.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fetched.schema), "html string"]))


def harvest(images: DataFrame, most: int = IMAGE_BYTES, **how) -> DataFrame:
    """page_id, ord, absolute, status, local (figures/name, or the URL where it didn't come), content of images (page_id, ord, absolute): each URL of a page once."""
    one = images.groupBy("page_id", "absolute").agg(F.min("ord").alias("ord"))
    got = fetch(one, "absolute", most=most, **how)
    local = F.when(F.col("status") == "ok", F.concat(F.lit("figures/"), t.asset_name(F.col("absolute"), F.col("content_type"), F.col("ord")))).otherwise(F.col("absolute"))
    return got.select("page_id", "ord", "absolute", "status", local.alias("local"), F.when(F.col("status") == "ok", F.col("body")).alias("content"))


def harvest_counts(harvested: DataFrame) -> DataFrame:
    """page_id, downloaded, skipped (too large), failed, warnings."""
    status = F.col("status")
    said = F.when(status == "too large", F.concat(F.lit("image too large, skipped: "), "absolute")).when(status != "ok", F.concat(F.lit("image fetch failed: "), "absolute"))
    return harvested.groupBy("page_id").agg(F.count_if(status == "ok").alias("downloaded"), F.count_if(status == "too large").alias("skipped"), F.count_if(~status.isin("ok", "too large")).alias("failed"), F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("ord", said.alias("w"))))), lambda x: x["w"]).alias("warnings"))
