"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, partitions, stage

#: exp(-rate) must stay a normal number: larger rates are sums of draws of at most this mean.
LARGEST_RATE = 64.0
#: No row is exploded into more copies than this at once.
BLOCK = 4096


def uniform(seed: int, key: Column, draw: Column) -> Column:
    """In [0, 1), from the first 13 hexadecimal digits of md5("seed:key:draw")."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, as far as doubles tell the sums apart."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")

    def step(a, i):
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda a: a["sums"])


def poisson(u: Column, table: Column) -> Column:
    """The least k with u < P(X <= k)."""
    return F.size(F.filter(table, lambda c: c <= u)).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str) -> DataFrame:
    """s, draws, table: each source's number of draws, and the distribution of each, whose means
    add up to the number of copies that brings the source to its share of total rows."""
    counts = docs.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        weighed = counts.join(table, F.col("s").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["w"])
    weighed = stage(weighed)
    sums = weighed.agg(F.sum("n").alias("rows"), F.sum("w").alias("ws")).first()
    rows, ws = float(sums["rows"] or 0), float(sums["ws"] or 0)
    goal = float(total) if total is not None else rows
    rate = F.lit(goal) * F.col("w") / F.lit(ws) / F.col("n") if ws > 0 else F.lit(0.0)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")
    rated = weighed.select("s", rate.alias("rate")).withColumn("draws", draws)
    return stage(rated.select("s", "draws", poisson_table(F.col("rate") / F.col("draws")).alias("table")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None,
                seed: int = 42, key: str = "doc_id", source: str = "source", shuffle: bool = True) -> DataFrame:
    """Each row as often as an inverted Poisson distribution says, in a globally shuffled order.

    weights gives the share of each source (a source that is missing has weight 0; None:
    all alike); total the expected number of rows of the result (None: as many as docs).
    A row's mean number of copies is total * share / rows of its source. The draw comes
    from md5 of seed and key, so a lost task draws the same again. Adds n_copies, copy
    (from 0) and shuffle_key, an md5 that deals the rows to partitions and sorts each of them.

    A null source is a source of its own; with weights it has weight 0. Rows with the
    same key draw alike; rows without a key draw by what is in their columns, so equal ones alike, wherever they are read.
    Empty tables give no rows. Texts are not looked at. Columns of docs named n_copies, copy
    or shuffle_key, in any case, are replaced; other names may be any.
    """
    own = Carried(docs, ["n_copies", "copy", "shuffle_key"])
    rows = own.rows.select("*", F.coalesce(own.col(key).cast("string"), F.concat(F.lit("row "), F.md5(F.to_json(F.struct(*own.rows.columns))))).alias("k"),
                           own.col(source).alias("source"))
    rates = source_rates(rows.select("source"), weights, total, "source")
    rated = rows.join(rates, F.col("source").eqNullSafe(F.col("s")))
    first = poisson(uniform(seed, F.col("k"), F.lit(0)), F.col("table"))
    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0).cast("long"),
                       lambda a, i: a + poisson(uniform(seed, F.col("k"), i), F.col("table")))
    counted = rated.select(*own.rows.columns, "k", (first + F.when(F.col("draws") > 1, more).otherwise(F.lit(0))).alias("n_copies"))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(n_copies - 1) div {BLOCK}"))
    copies = (counted.filter("n_copies > 0").withColumn("block", F.explode(blocks))
              .withColumn("copy", F.explode(F.sequence(F.col("block") * BLOCK,
                          F.least(F.col("block") * BLOCK + BLOCK, F.col("n_copies")) - 1)))
              .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), "k", F.col("copy").cast("string")))))
    out = own.restored(copies)
    return out.repartition(partitions(docs), "shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out
