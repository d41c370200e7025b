"""A training-corpus pipeline of five operators; each stage is written and read again.

Toxic documents go, of equal and of nearly equal documents one stays, sources are mixed to
target weights, and what remains is packed into sequences. All stages but the last return the
columns of documents, whatever further ones there are.

Nulls: a null text counts as empty, a null source is a source of its own, rows without an id or
with a repeated one are rows like others (a row without an id has no label). A document without
words can't be taken by the mix. Empty tables give empty results.

Stages move keys and places of rows; texts stay where they are until the rows that stay are
written.
"""

from pyspark.sql import DataFrame, SparkSession

from pairlocus.llm import exact, minhash, mixing, packing, toxicity
from pairlocus.llm.queries import table, tokenizer_file
from pairlocus.llm.text import scratch, temporary


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit pack", best_fit_pack),
]

#: Scores, sketches and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
