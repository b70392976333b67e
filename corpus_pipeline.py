"""From documents to token files: STAGES, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import quality
from tickloom.llm.common import shared_dir, staged_until_end
from tickloom.llm.decontaminate import decontaminate
from tickloom.llm.mixing import mix_sources
from tickloom.llm.near_dedup import drop_near_duplicates
from tickloom.llm.queries import held_out, table, tokenizer_path
from tickloom.llm.token_files import token_files


# Each stage takes rows with null ids, null, empty or very long texts, repeated rows and no rows at all, and any further
# columns; it judges each row by its text alone, a null text as an empty one, so that equal rows fare alike unless said.


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model learns from labels whose doc_id is in docs; without any it rejects nothing (all score 0.5)."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return quality.quality_scores(docs, model).filter("predicted = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id (a null one last; of equal ids one
    row). Texts without words are linked with nothing and all stay."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; one without words is not."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources, the null one too, get the same share of as many rows as there are; a document may come several times.
    Rows with the same doc_id draw alike, rows without one each for itself."""
    return mix_sources(docs, seed=42).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the rows come, which mixing has left to chance, and what is read from them; an
    empty text has the end id alone."""
    return token_files(docs, tokenizer_path(), as_read=True)


STAGES = [("quality classifier", good_documents), ("MinHash near-dedup", one_of_each), ("benchmark decontamination", without_benchmark),
          ("mixing to target weights", mixed), ("token files", tokens)]

#: Trained models, signatures and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has staged for itself goes once its result is stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES, 1):
        if i == len(STAGES):
            return function(spark, docs, sf_dir)
        path = shared_dir(spark)
        with staged_until_end(spark):
            after = function(spark, docs, sf_dir)
            after.write.parquet(path)
        docs = spark.read.schema(after.schema).parquet(path)
    return docs
