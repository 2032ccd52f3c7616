"""A training corpus from documents: five stages, each over all that the one before it kept.

In all of them a null text is an empty one, repeated rows are rows like any other, an empty table gives an empty one, and all but the last keep
the columns as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import decontaminate, line_dedup, packing, simhash, toxicity
from loomery.llm.queries import tokenizer
from loomery.llm.shared import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.7 or more go, whether labelled or not; rows of one text go or stay together."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go from all but their first place, by doc_id (null last), text and line; n_chars follows the text. Null texts stay null, with a null n_chars."""
    from pyspark.sql import functions as F

    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document of the least doc_id stays, of several rows of it the least one. Empty and null texts are one component."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Those without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; an empty document is a piece of its end id."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: The learnt model, the SimHash components and the tokenizer have no SQL; a test compares each stage but the first, whose model has its own tests,
#: with a brute-force version, and the first with the operator's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            forget(before)
    return docs
