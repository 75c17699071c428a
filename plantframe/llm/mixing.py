"""Mixing sources to target weights by Poisson replication. Only DataFrame and SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bucket of all sources that have no weight of their own.
REST = "*"


def repetition_rates(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, total: float | None = None, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Per bucket of the weights: ``bucket``, ``size`` (characters) and ``rate``, the mean number of copies.

    The result has a row for each weight and one for the rest at most. Weights are shares of the mixed corpus in
    characters; ``total`` is its size, that of the input by default. A bucket without characters has rate zero.
    """
    known = F.col(source_column).isin(*weights) if weights else F.lit(False)
    bucket = F.when(known, F.col(source_column)).otherwise(REST)
    sizes = docs.groupBy(bucket.alias("bucket")).agg(F.coalesce(F.sum(F.length(text_column)), F.lit(0)).cast("double").alias("size"))
    weight = F.coalesce(*[F.when(F.col("bucket") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(float(rest)))
    all_rows = Window.partitionBy()  # one row per weight
    target = F.lit(float(total)) if total is not None else F.sum("size").over(all_rows)
    share = weight / F.sum(weight).over(all_rows)
    return sizes.select("bucket", "size", F.when(F.col("size") > 0, share * target / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Per bucket the Poisson distribution function at 0, 1, 2, ... as array ``cdf``.

    It ends ten standard deviations and 40 above the mean, where what is left is below the resolution of the draws.
    """
    most = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 40)
    upto = Window.partitionBy("bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rates.select("bucket", "rate", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))).alias("k"))
    rows = rows.withColumn("log_factorial", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto))
    log_p = F.when(F.col("rate") > 0, F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial")).otherwise(F.when(F.col("k") == 0, 0.0))
    rows = rows.withColumn("cdf", F.sum(F.coalesce(F.exp(log_p), F.lit(0.0))).over(upto))
    pairs = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("pairs"))
    return pairs.select("bucket", F.col("pairs.cdf").alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float], rest: float = 1.0, total: float | None = None, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Copies of the rows of ``docs`` in a global random order, each source near its target weight.

    A document's number of copies is the Poisson quantile, at the mean its source needs, of a number drawn from the
    hash of the seed and its id; the order is that of the hash of seed, id and copy. Both are the same in every run.
    Result: ``row`` (all columns as a struct), ``copy`` (from 1) and ``mix_key`` (hex), sorted by the key. Rows that
    share an id draw alike; a null id or source counts as the empty id or as a source without a weight. Null texts have no size but
    are copied as their source is. An empty table gives an empty result.

    The rates are a table of a row for each weight given, so they are broadcast; no row moves before it is copied.
    """
    tables = poisson_tables(repetition_rates(docs, weights, rest, total, source_column, text_column))
    known = F.coalesce(F.col(source_column).isin(*weights), F.lit(False)) if weights else F.lit(False)
    name = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"draw:{seed}:"), name)), 1, 13), 16, 10).cast("double")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"),
        F.when(known, F.col(source_column)).otherwise(REST).alias("bucket"), ((draw + 0.5) / float(1 << 52)).alias("u"),
    )
    drawn = rows.join(F.broadcast(tables), "bucket").withColumn("n", F.size(F.filter("cdf", lambda c: c < F.col("u"))))
    copies = drawn.filter("n > 0").select("row", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.md5(F.concat(F.lit(f"order:{seed}:"), "name", F.lit(":"), F.col("copy").cast("string")))
    return copies.select("row", "copy", key.alias("mix_key")).orderBy("mix_key")
