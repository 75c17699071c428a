"""Writers for result tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table; CSV gets a header."""
    out = _flat(df) if fmt == "csv" else df
    writer = out.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """One nested row from small result tables: a struct for one row, an array of structs else.

    Sections are summaries with a row per class, rule or method.
    """
    whole = None
    for name, df in sections.items():
        packed = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("v")).select("v").scalar()
        base = whole if whole is not None else df.sparkSession.range(1).select()
        whole = base.withColumn(name, packed)
    return whole


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    report(sections).coalesce(1).write.json(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table; with ``once`` take what is there and stop."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


LEDGER = "_ledger"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_batches(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream to a table batch by batch, each exactly once.

    A batch goes to a folder of its own, and after that into the ledger with its number of rows. A batch that comes
    again after a failure changes nothing if the ledger has it, and replaces what it left behind if not.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = f"{path}/{LEDGER}/batch={number}"
        if _there(spark, f"{entry}/_SUCCESS"):
            return
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{path}/batch={number}")
        written.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(entry)

    writer = df.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in the ledger with their ``batch``; what a failed batch left behind is not seen."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if not _there(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], whole)
    known = spark.read.schema("n LONG, batch LONG").parquet(f"{path}/{LEDGER}").select("batch")
    return spark.read.schema(whole).parquet(path).join(known, "batch", "left_semi").select(*whole.fieldNames())
