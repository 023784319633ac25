"""A training-data pipeline over documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import decontamination, language_id, line_dedup, mixing, near_duplicates
from lodestream.llm.shared import documents, materialise, prepare, scratch

#: A text is rejected when its best language contains less than this part of its n-grams.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled documents are in; null and letterless texts go."""
    prepare(spark)
    return language_id.drop_unidentified(docs, language_id.fit(docs), MIN_LANGUAGE_SCORE)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; documents of nothing else go."""
    prepare(spark)
    return line_dedup.drop_lines(docs, short=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first by doc_id; of rows that repeat id and text, one."""
    prepare(spark)
    return near_duplicates.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item; each row is judged by its own text."""
    prepare(spark)
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, size, target, copies, taken) of the documents that the mix takes, at least once each."""
    taken = mixing.mix(docs).filter("copies > 0")
    langs = docs.select("doc_id", "lang").dropDuplicates(["doc_id"])
    return taken.join(langs, "doc_id", "left").select("doc_id", "source", "lang", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
    return docs


#: Similarity search, learned filters and random rounding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
