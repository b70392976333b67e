"""Tables, partitions and batches whose texts are all null, empty or without words: every operator and every stage of the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickloom.llm import language, quality
from tickloom.llm.decontaminate import decontaminate
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.line_dedup import remove_repeated_lines
from tickloom.llm.mixing import mix_sources
from tickloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from tickloom.llm.queries import tokenizer_path
from tickloom.llm.repeats import remove_repeats
from tickloom.llm.token_files import token_files
from tickloom.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = {"null": [None] * 3, "empty": [""] * 2, "blank": [" \n", "\t", " "], "marks": ["!!", "?", ". ."]}


@pytest.fixture(scope="module", params=["null", "apart", "none"])
def docs(spark, request):
    """All rows of one kind; rows of every kind, each in a partition of its own; and no rows."""
    if request.param == "none":
        return spark.createDataFrame([], SCHEMA)
    if request.param == "apart":
        texts = [*sum(EMPTY.values(), []), "five words are enough here", None]
        return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(len(texts), "doc_id")
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(EMPTY[request.param])], SCHEMA)


def test_operators(spark, docs):
    n = docs.count()
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    trees, net = quality.train(docs, labels), language.train(docs)
    for f in (near_duplicates, exact_dedup, remove_repeats, remove_repeated_lines, lambda d: decontaminate(d, bench), lambda d: quality.quality_scores(d, trees),
              lambda d: language.identify(d, net), lambda d: token_files(d, tokenizer_path()),
              lambda d: url_filter(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), d.select(F.col("doc_id").alias("page_id"), F.lit(1).alias("bad")))):
        assert f(docs).count() == n
    assert drop_near_duplicates(docs).count() == n  # empty sets are linked with nothing, "!!" and "?" are other words
    assert mix_sources(docs).columns == [*docs.columns, "n_copies", "copy", "shuffle_key"]


def test_empty_sets_are_linked_with_nothing(spark):
    rows = near_duplicates(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(i, 0, i, True) for i in (1, 2, 3)]


def test_token_files_of_empty_texts(docs):
    rows = token_files(docs, tokenizer_path()).filter("n_tokens < 1").count()
    assert rows == 0


@pytest.mark.parametrize("step", range(len(cp.STAGES)))
def test_stages(spark, docs, step):
    name, function = cp.STAGES[step]
    out = function(spark, docs, SF)
    texts = docs.count()
    if name in ("MinHash near-dedup", "benchmark decontamination"):  # none has words to share
        assert out.count() == texts
    elif step == len(cp.STAGES) - 1:  # a row of the files for each document
        assert out.count() == texts
    elif texts == 0:
        assert out.count() == 0
    else:
        assert out.join(docs.select("text").distinct(), out["text"].eqNullSafe(docs["text"]), "left_anti").count() == 0
    if step < len(cp.STAGES) - 1:
        assert sorted(out.columns) == sorted(docs.columns)


def test_statistics_of_nothing():
    import pyarrow as pa

    assert np.isfinite(quality.statistics(pa.array([None, ""], pa.string()))).all()
