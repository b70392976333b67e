"""Exact dedup through content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: A chunk ends behind the first vowel and blank after MIN characters, or at MAX.
MIN, MAX = 768, 4096
CHUNK = rf"(?s).{{{MIN}}}(?:.{{0,{MAX - MIN}}}?[aeiou][ \n]|.{{{MAX - MIN}}})|.+"


def chunks(text: Column) -> Column:
    """Cut where the content says so: an insertion moves only the cuts near it."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, normalise=ascii_lower, identifier=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs.

    Equal texts are those with the same recipe, the ordered list of their chunks'
    identifiers. A chunk's identifier is its 64-bit hash (or what else is given); hashes that
    two different chunks share are looked up by comparing the chunks themselves, and these
    chunks stand in the recipe as well. A recipe is all that moves of a long document.

    Null text counts as empty, and all empty texts are equal. Rows that repeat a
    doc_id each count in group_size; where the largest doc_id repeats, all rows with it
    are kept. A null doc_id is kept only if its group has no other. Further columns
    are ignored; an empty table gives no rows.
    """
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select(F.col("doc_id"), text.alias("t"))
    cut = base.select("doc_id", "t", chunks(F.col("t")).alias("c"))

    distinct = (base.select(F.explode(chunks(F.col("t"))).alias("chunk"))
                .select(identifier(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").count())
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stage(shared.select("h"))

    recipe = F.transform("c", lambda x: identifier(x))
    rows = cut.select("doc_id", recipe.alias("recipe"), F.array().cast("array<string>").alias("exact"),
                      F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
    if shared.head(1):
        # Chunks of such a hash stand in the recipe themselves.
        keyed = stage(base.withColumn("row", F.monotonically_increasing_id()))
        own = (keyed.select("row", F.posexplode(chunks(F.col("t"))).alias("pos", "chunk"))
               .withColumn("h", identifier(F.col("chunk"))).join(shared, "h", "left_semi")
               .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("x")))
        rows = (keyed.join(own, "row", "left").withColumn("c", chunks(F.col("t")))
                .select("doc_id", recipe.alias("recipe"),
                        F.coalesce(F.col("x.chunk"), F.array().cast("array<string>")).alias("exact"),
                        F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")))
    groups = stage(rows.groupBy("recipe", "exact").agg(F.max("doc_id").alias("keep_id"),
                                                       F.count(F.lit(1)).alias("group_size")))
    return (rows.join(groups, ["recipe", "exact"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
