"""A pipeline over the documents: toxic ones go, one document of each near-duplicate class stays, documents with benchmark passages go, personal
data is masked, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvspark.llm.decontaminate import decontaminated
from pvspark.llm.jaccard_join import deduplicated
from pvspark.llm.packing import VOCABULARY, packed
from pvspark.llm.pii import redacted
from pvspark.llm.shared import mark, released, stored
from pvspark.llm.toxicity import without_toxic

#: Near-duplicates in the pipeline: five words, a similarity of 0.8.
WORDS, SIMILARITY = 5, 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. Null and empty texts score what the bias gives; repeated rows and null ids are judged by their texts; without
    documents there are no rows."""
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id stays. Rows without an id, or whose text is null or has no words, stay; rows that
    share an id are judged each by its own text."""
    return deduplicated(docs, WORDS, SIMILARITY)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, each row for its own text; null texts and ids stay."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in every row; no row goes, a null text stays null."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; a null or empty text is one end token, repeated rows are packed each."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]

#: Trained models and a byte-pair tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written as Parquet and read again for the next. What a stage stored meanwhile, and the rows it
    read, are removed once its own rows are written."""
    docs, since = _table(spark, sf_dir, "documents"), mark()
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = stored(out)
        released(since, but=docs)
