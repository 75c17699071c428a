"""Readers of text tables by the headers of their files; no type is inferred from data."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.columns import MICROS, epoch_us, first_present, one_value, strip_names, to_instant, to_number

# Columns of a flow table.
FLOW_TEXT = [
    "sAddress", "rAddress", "sMACs", "rMACs", "sIPs", "rIPs", "protocol", "startDate", "endDate",
]
FLOW_NUMBERS = [
    "start", "end", "startOffset", "endOffset", "duration",
    "sLoad", "rLoad", "sPackets", "rPackets",
    "sBytesSum", "rBytesSum", "sBytesAvg", "rBytesAvg", "sBytesMin", "rBytesMin", "sBytesMax", "rBytesMax",
    "sPayloadSum", "rPayloadSum", "sPayloadAvg", "rPayloadAvg", "sPayloadMin", "rPayloadMin",
    "sPayloadMax", "rPayloadMax", "sInterPacketAvg", "rInterPacketAvg", "sttl", "rttl",
    "sAckRate", "rAckRate", "sUrgRate", "rUrgRate", "sFinRate", "rFinRate", "sPshRate", "rPshRate",
    "sSynRate", "rSynRate", "sRstRate", "rRstRate", "sWinTCP", "rWinTCP", "sFragmentRate", "rFragmentRate",
    "sAckDelayMax", "rAckDelayMax", "sAckDelayMin", "rAckDelayMin", "sAckDelayAvg", "rAckDelayAvg",
]
FLOW_LABELS = ["IT_B_Label", "IT_M_Label", "NST_B_Label", "NST_M_Label"]

ATTACK_COLUMNS = [
    "attack", "startStamp", "endStamp", "startTime", "endTime", "attackerMAC", "attackerIP", "description",
]

TIME_NAMES = ("timestamp", "time", "Timestamp", "Time")
LABEL_NAMES = ("attack", "Attack", "label", "Label", "anomaly")


def _headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """First line of each file, read by tasks; per distinct line the files that have it."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            lines = []
            for name in pdf["path"]:
                store, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with store.open_input_stream(place) as stream:
                    text = b""
                    while b"\n" not in text and (more := stream.read(1 << 16)):
                        text += more
                lines.append(text.split(b"\n")[0].decode("utf-8-sig").rstrip("\r"))
            yield pd.DataFrame({"path": pdf["path"], "header": lines})

    files = spark.read.format("binaryFile").load(path).select("path")
    found: dict[str, list[str]] = {}
    for row in files.mapInPandas(first_lines, "path string, header string").collect():  # a row per file
        if row["header"]:
            found.setdefault(row["header"], []).append(row["path"])
    return found


def text_table(spark: SparkSession, path: str | list[str], file: str | None = None, **options) -> DataFrame:
    """CSV files with headers, every column as text under its stripped name.

    Files may order or choose their columns differently: those of one header are read together, and the parts are
    united by name, null where a file lacks a column. ``file`` names a column for the files' places.
    """
    parts = None
    for files in _headers(spark, path).values() or [path]:
        raw = spark.read.options(header=True, **options).csv(files)
        part = strip_names(raw)
        if file:
            part = part.withColumn(file, F.col("_metadata.file_path"))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def read_flows(
    spark: SparkSession, path: str, numbers: Sequence[str] = FLOW_NUMBERS,
    texts: Sequence[str] = (*FLOW_TEXT, *FLOW_LABELS),
) -> DataFrame:
    """Flows: the known columns that are present, numbers that do not parse as null."""
    raw = text_table(spark, path)
    return raw.select(
        *[to_number(c).alias(c) if c in numbers else F.col(c) for c in raw.columns if c in numbers or c in texts]
    )


def read_snapshots(spark: SparkSession, path: str, sensors: Sequence[str], series: str) -> DataFrame:
    """Snapshots of one controller: time, whole and elapsed seconds, the sensors that are present."""
    raw = text_table(spark, path)
    present = [s for s in sensors if s in raw.columns]
    parsed = raw.select(
        to_instant("time").alias("ts"), F.lit(series).alias("series"),
        *[to_number(s).alias(s) for s in present],
    ).filter("ts IS NOT NULL")
    first = one_value(parsed.agg(F.min(F.unix_micros("ts")).alias("t0")))
    elapsed = (F.unix_micros("ts") - first["t0"]) / F.lit(float(MICROS))
    return parsed.select(
        "ts", F.floor(F.unix_micros("ts") / F.lit(MICROS)).alias("unix_ts"), elapsed.alias("elapsed_s"),
        "series", *[F.col(f"`{s}`") for s in present],
    )


def read_attack_windows(spark: SparkSession, path: str) -> DataFrame:
    """Attack intervals with parsed start and end; empty files give an empty table."""
    raw = text_table(spark, path)
    return raw.select(
        F.trim("attack").alias("attack"),
        to_number("startStamp").alias("start_stamp"), to_number("endStamp").alias("end_stamp"),
        to_instant("startTime").alias("start_ts"), to_instant("endTime").alias("end_ts"),
    )


def resolve_columns(
    df: DataFrame, times: Sequence[str] = TIME_NAMES, labels: Sequence[str] = LABEL_NAMES,
    row_number: str | None = None,
) -> DataFrame:
    """The first time and label name found become ``ts`` and ``attack``; a missing label is 0.

    A table without a time column is ordered by ``row_number``, one row per second.
    """
    t, y = first_present(df, times), first_present(df, labels)
    if t is None and row_number is None:
        raise ValueError(f"no column of {list(times)}, and no row number to stand in")
    if t is None:
        when = F.timestamp_seconds(F.col(row_number).cast("long"))
    elif isinstance(df.schema[t].dataType, (T.TimestampType, T.TimestampNTZType)):
        when = F.timestamp_micros(epoch_us(df, t))
    else:
        when = to_instant(t)
    truth = F.coalesce(F.expr(f"try_cast(`{y}` AS int)"), F.lit(0)) if y else F.lit(0)
    rest = [c for c in df.columns if c not in (t, y)]
    return df.select(when.alias("ts"), truth.alias("attack"), *[F.col(f"`{c}`") for c in rest])


def read_tagged(spark: SparkSession, folder: str, role: str, columns: Sequence[str]) -> DataFrame:
    """Process tables of one role, chosen by file name and read together.

    Training files are named ``train``, or ``normal`` if there are none of these. ``columns`` are the
    tag columns; a file without one of them gives nulls.
    """
    globs = {"train": ["*train*", "*normal*"], "test": ["*test*"]}[role]
    anchor = folder.rstrip("/").rsplit("/", 1)[-1]
    for glob in globs:
        try:
            headers = _headers(spark, f"{folder}/{glob}")
        except AnalysisException:  # the pattern matches nothing
            continue
        parts = None
        for files in headers.values():
            raw = resolve_columns(text_table(spark, files, file="_file"))
            keep = [c for c in columns if c in raw.columns]
            part = raw.select(
                "ts", "attack", *[to_number(c).alias(c) for c in keep],
                F.regexp_extract("_file", f".*/\\Q{anchor}\\E/([^/]+)", 1).alias("file"),
            ).filter("ts IS NOT NULL")
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        if parts is not None:
            return parts
    raise FileNotFoundError(f"no {role} file in {folder}")


READING_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("series", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def stream_readings(
    spark: SparkSession, path: str, files_per_trigger: int = 1000, schema: T.StructType = READING_SCHEMA,
    name_filter: str | None = None,
) -> DataFrame:
    """Readings as they arrive as Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)
