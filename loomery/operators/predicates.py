"""The predicate vocabulary: a small table that decides which edges may join which page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default predicates and the page types that they join.
PAPER_TO_PAPER = "cites extends compares-with criticizes applies surveys motivates disambiguates same-topic".split()
PAPER_TO_CONCEPT = "defines discusses introduces".split()
CONCEPT_TO_CONCEPT = "is-a part-of alternative-to related-to".split()
PAPER_LIKE = ("paper", "video", "pdf")
REQUIRED = {"paper": ("slug", "title", "source", "type", "ingested"), "video": ("slug", "title", "source", "type", "ingested"), "pdf": ("slug", "title", "source", "type", "ingested"), "concept": ("slug", "title", "type", "ingested")}
SCHEMA = "name string, is_typed boolean, from_type string, to_type string, raw_json string"


def default_predicates(spark: SparkSession) -> DataFrame:
    """name, is_typed, from_type, to_type, raw_json."""
    rows = [(n, "paper", "paper") for n in PAPER_TO_PAPER] + [(n, "paper", "concept") for n in PAPER_TO_CONCEPT] + [(n, "concept", "concept") for n in CONCEPT_TO_CONCEPT]
    return spark.createDataFrame([(n, True, a, b, f'{{"from_type":"{a}","to_type":"{b}"}}') for n, a, b in rows], SCHEMA)


def parse_predicates(schema_json: DataFrame, text: str = "text") -> DataFrame:
    """The predicates of _schema.json texts (other columns kept); a definition may be an object or a bare description."""
    found = schema_json.withColumn("p", F.from_json(F.get_json_object(text, "$.predicates"), "map<string,string>"))
    keep = [c for c in schema_json.columns if c != text]
    typed = F.col("raw_json").startswith("{")
    field = lambda name: F.when(typed, F.get_json_object("raw_json", f"$.{name}"))
    return found.select(*keep, F.explode("p").alias("name", "raw_json")).select(*keep, "name", typed.alias("is_typed"), field("from_type").alias("from_type"), field("to_type").alias("to_type"), "raw_json")


def is_paper_like(kind: Column) -> Column:
    return kind.isin(*PAPER_LIKE)
