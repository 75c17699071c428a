"""Row order without one task per key.

A sensor's history, or the history of one plant, can be a large share of all rows, so a window
partitioned by the key alone would put that share into one task. Everything here works on *slices*:
a key's time line cut at fixed instants. Rows are ordered inside a slice only; what crosses a slice
edge travels either as a copy of the rows near the edge (sliding windows) or as one summary row
per slice (the other functions). Slices are cut by the clock, so every recomputation of a lost task
cuts them the same way.

``t`` is a LONG column in microseconds and ``tie`` a column that makes the order unique.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import MICROS, few, floor_to, join_keys

SLICE = "_slice"
#: Rows whose frames a task works out, on average; their copies and events are sorted in its memory.
TASK_ROWS = 100_000
#: Default length of a cooldown slice, in gaps.
SLICE_GAPS = 64


def with_slice(df: DataFrame, t: str, slice_s: float) -> DataFrame:
    return df.withColumn(SLICE, floor_to(F.col(t), int(slice_s * MICROS)))


def _frame_slices(t: str, before: int, after: int, width: int) -> Column:
    """Starts of the slices with frames that a row belongs to; two at most, as a slice is as wide as a frame."""
    first, last = floor_to(F.col(t) - after, width), floor_to(F.col(t) + before, width)
    return F.array_distinct(F.array(first, floor_to(F.col(t), width), last))


def sliding_count(
    df: DataFrame, keys: Sequence[str], t: str, counted: Column, before_s: float, after_s: float = 0.0, slice_s: float | None = None, name: str = "n",
) -> DataFrame:
    """Add the number of counted rows of the same key within [t - before, t + after].

    A counted row enters all frames at one instant and leaves them at another, so the number is a running sum of
    entries less exits. It takes time in the number of rows, however many a frame holds.
    """
    before, after = int(before_s * MICROS), int(after_s * MICROS)
    width = max(int((slice_s or 0) * MICROS), before + after, 1)
    empty = F.lit(None).cast(df.schema)

    def event(start: Column, at: Column, n: int, row: Column) -> Column:
        return F.struct(start.alias("slice"), at.alias("at"), F.lit(n).alias("n"), row.alias("row"))

    enter, leave = F.col(t) - after, F.col(t) + before + 1
    moves = F.flatten(F.transform(_frame_slices(t, before, after, width), lambda s: F.array(event(s, enter, 1, empty), event(s, leave, -1, empty))))
    moves = F.when(counted, F.filter(moves, lambda e: e["at"] < e["slice"] + width)).otherwise(F.array().cast(T.ArrayType(T.StructType.fromDDL(f"slice LONG, at LONG, n INT, row {df.schema.simpleString()}"))))
    asked = F.array(event(floor_to(F.col(t), width), F.col(t), 0, F.struct(*df.columns)))
    events = df.select(*keys, F.explode(F.concat(asked, moves)).alias("_e"))
    line = Window.partitionBy(*keys, F.col("_e.slice")).orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_n", F.sum("_e.n").over(line)).filter("_e.n = 0").select("_e.row.*", F.col("_n").alias(name))


def sliding_variance(
    df: DataFrame, keys: Sequence[str], t: str, value: str, before_s: float, after_s: float = 0.0, slice_s: float | None = None,
    count: str = "n_window", variance: str = "rolling_var",
) -> DataFrame:
    """Add the count and the population variance of the values of the same key within [t - before, t + after].

    Count, sum and sum of squares run as entries less exits, so time is linear in the rows. Values are centred at their
    slice's mean first; what is left of rounding is of the order of 1e-16 times the slice's sum of squares. Neighbours
    that differ are counted the same way, so a frame of equal values has the variance zero exactly. A null value is no
    value; its row gets the frame of the others.
    """
    before, after = int(before_s * MICROS), int(after_s * MICROS)
    width = max(int((slice_s or 0) * MICROS), before + after, 1)
    others = [c for c in df.columns if c not in keys]
    # a row travels with its copy in its own slice only, and without the keys
    copies = df.select(*keys, F.struct(*others).alias("_row"), F.col(t).alias("_t"), F.col(value).cast("double").alias("_v"), F.explode(_frame_slices(t, before, after, width)).alias(SLICE))
    copies = copies.withColumn("_row", F.when(F.col(SLICE) == floor_to(F.col("_t"), width), F.col("_row")))
    # as many tasks as the rows need: with a fixed number, a task's memory grows with the table
    copies = copies.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), *keys, SLICE)
    inside = Window.partitionBy(*keys, SLICE)
    # only rows with a value have neighbours
    known, at = inside.orderBy(F.col("_v").isNull(), "_t"), F.struct("_t", "_v")
    copies = copies.withColumn("_p", F.lag(at).over(known)).withColumn("_f", F.lead(at).over(known)).withColumn("_c", F.avg("_v").over(inside))
    enter, leave = F.col("_t") - after, F.col("_t") + before + 1
    has, d = F.col("_v").isNotNull().cast("int"), F.coalesce(F.col("_v") - F.col("_c"), F.lit(0.0))
    # two neighbours that differ are both in a frame from the later one's entry to the earlier one's exit
    parted = F.coalesce((F.col("_p._v") != F.col("_v")) & (F.col("_p._t") + before + 1 > enter), F.lit(False)).cast("int")
    parts = F.coalesce((F.col("_f._v") != F.col("_v")) & (leave > F.col("_f._t") - after), F.lit(False)).cast("int")

    def event(at: Column, n: Column, changes: Column, row: Column) -> Column:
        return F.struct(at.alias("at"), n.alias("n"), (n * d).alias("s"), (n * d * d).alias("q"), changes.alias("c"), row.alias("row"))

    zero, row, no_row = F.lit(0), F.col("_row"), F.lit(None).cast(df.select(F.struct(*others).alias("_row")).schema["_row"].dataType)
    # a row that enters when it asks does both at once
    events = [event(enter, has, parted, no_row if after else row), event(leave, -has, -parts, no_row)] + ([event(F.col("_t"), zero, zero, row)] if after else [])
    matter = lambda e: (e["at"] < F.col(SLICE) + width) & ((e["n"] != 0) | e["row"].isNotNull())
    events = copies.select(*keys, SLICE, F.explode(F.filter(F.array(*events), matter)).alias("_e"))
    line = inside.orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0)
    run = events.select(*keys, F.col("_e.row").alias("_row"), *[F.sum(f"_e.{c}").over(line).alias(f"_{c}") for c in "nsqc"]).filter("_row IS NOT NULL")
    mean = F.col("_s") / F.col("_n")
    spread = F.when(F.col("_n") == 0, F.lit(None)).when(F.col("_c") == 0, 0.0).otherwise(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return run.select(*[F.col(c if c in keys else f"_row.{c}") for c in df.columns], F.col("_n").alias(count), spread.alias(variance))


def _carry(
    df: DataFrame, keys: Sequence[str], summary: Column, over_previous, name: str
) -> DataFrame:
    """One row per slice, holding what the earlier slices of the key hand over."""
    per_slice = df.groupBy(*keys, SLICE).agg(summary.alias("_s"))
    line = Window.partitionBy(*keys).orderBy(SLICE)
    return per_slice.select(*keys, SLICE, over_previous(F.col("_s"), line).alias(name))


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: str,
    cols: Sequence[str],
    slice_s: float,
    prefix: str = "prev_",
) -> DataFrame:
    """Add the named columns of the row before, however far back it lies."""
    sliced = with_slice(df, t, slice_s)
    payload = F.struct(*cols)
    inside = sliced.withColumn(
        "_prev", F.lag(payload).over(Window.partitionBy(*keys, SLICE).orderBy(t, tie))
    )
    carry = _carry(
        sliced,
        keys,
        F.max_by(payload, F.struct(t, tie)),
        lambda s, line: F.lag(s).over(line),
        "_edge",
    )
    joined = join_keys(inside, carry, [*keys, SLICE], "left").withColumn(
        "_prev", F.coalesce("_prev", "_edge")
    )
    return joined.select(
        *df.columns, *[F.col("_prev")[c].alias(prefix + c) for c in cols]
    )


def row_ordinal(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, slice_s: float, name: str = "ord"
) -> DataFrame:
    """Add the 0-based position of the row within its key."""
    sliced = with_slice(df, t, slice_s)
    carry = _carry(
        sliced,
        keys,
        F.count(F.lit(1)),
        lambda s, line: F.coalesce(
            F.sum(s).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
        "_before",
    )
    inside = sliced.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(t, tie))
    )
    return join_keys(inside, carry, [*keys, SLICE]).select(
        *df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name)
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, value: str, slice_s: float, name: str
) -> DataFrame:
    """Add the last non-null value at or before the row."""
    sliced = with_slice(df, t, slice_s)
    known = F.col(value).isNotNull()
    carry = _carry(
        sliced,
        keys,
        F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(t, tie))),
        lambda s, line: F.last(s, ignorenulls=True).over(
            line.rowsBetween(Window.unboundedPreceding, -1)
        ),
        "_edge",
    )
    run = Window.partitionBy(*keys, SLICE).orderBy(t, tie).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.withColumn("_in", F.last(value, ignorenulls=True).over(run))
    return join_keys(inside, carry, [*keys, SLICE], "left").select(
        *df.columns, F.coalesce("_in", "_edge").alias(name)
    )


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: str,
    how_many: Column,
    slice_s: float,
) -> DataFrame:
    """The first rows of each key. ``how_many`` is an expression over ``n``, the key's row count.

    Counts per slice tell which slice holds the last row wanted; only that slice is ordered. Its row is
    the cut, one per key, and the rest is a filter.
    """
    sliced = with_slice(df.select(*keys, t, tie), t, slice_s)
    line = Window.partitionBy(*keys)
    holding = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("n", F.sum("_c").over(line))
        .withColumn("_upto", F.sum("_c").over(line.orderBy(SLICE)))
        .select(
            *keys, SLICE, (F.col("_upto") - F.col("_c")).alias("_before"), "_upto",
            F.least(how_many, F.col("n")).alias("_k"),
        )
        .filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_upto")))
    )
    cut = (
        join_keys(sliced, few(holding, "holding"), [*keys, SLICE])
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(t, tie)))
        .filter(F.col("_before") + F.col("_rn") == F.col("_k"))
        .select(*keys, F.col(t).alias("_cut_t"), F.col(tie).alias("_cut_tie"))
    )
    upto = (F.col(t) < F.col("_cut_t")) | ((F.col(t) == F.col("_cut_t")) & (F.col(tie) <= F.col("_cut_tie")))
    return join_keys(df, few(cut, "cut"), keys).filter(upto).select(*df.columns)


def segments(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, flag: str, slice_s: float
) -> DataFrame:
    """Runs of true flags as inclusive ordinal ranges, one row each.

    A missing instant does not end a run; only a false row does.
    """
    numbered = row_ordinal(df.select(*keys, t, tie, flag), keys, t, tie, slice_s)
    sliced = with_slice(numbered, t, slice_s).withColumn("_on", F.col(flag).cast("int") == 1)
    # runs inside a slice: the ordinal minus the count of true rows so far is constant in a run
    whole = Window.partitionBy(*keys, SLICE)
    run = whole.orderBy("ord")
    bounds = [F.min("start_ord"), F.max("end_ord"), F.min("start_t"), F.max("end_t")]
    names = ["start_ord", "end_ord", "start_t", "end_t"]
    pieces = (
        sliced.withColumn("_island", F.col("ord") - F.sum(F.col("_on").cast("long")).over(run))
        .withColumn("_lo", F.min("ord").over(whole))
        .withColumn("_hi", F.max("ord").over(whole))
        .filter("_on")
        .groupBy(*keys, SLICE, "_island")
        .agg(
            F.min("ord").alias("start_ord"),
            F.max("ord").alias("end_ord"),
            F.min(t).alias("start_t"),
            F.max(t).alias("end_t"),
            F.first("_lo").alias("_lo"),
            F.first("_hi").alias("_hi"),
        )
        .withColumn("_edge", (F.col("start_ord") == F.col("_lo")) | (F.col("end_ord") == F.col("_hi")))
    )
    # only pieces at a slice edge can go on in the next slice: at most two per slice are left to order
    line = Window.partitionBy(*keys).orderBy("start_ord")
    opened = F.when(F.lag("end_ord").over(line) == F.col("start_ord") - 1, 0).otherwise(1)
    stitched = (
        pieces.filter("_edge")
        .withColumn("_new", opened)
        .withColumn("_run", F.sum("_new").over(line))
        .groupBy(*keys, "_run")
        .agg(*[b.alias(n) for b, n in zip(bounds, names)])
        .select(*keys, *names)
    )
    return pieces.filter("NOT _edge").select(*keys, *names).unionByName(stitched)


def _last_of_chain(times: np.ndarray, gap: int) -> np.ndarray:
    """For each start, the last instant kept when every kept instant silences the next ``gap``."""
    n = len(times)
    step = np.append(np.searchsorted(times, times + gap), n)
    last = np.append(np.arange(n), n)
    while (step[:-1] < n).any():
        reach = step < n
        last[reach] = last[step[reach]]
        step = step[step]
    return times[last[:-1]]


def cooldown(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, gap_s: float, slice_s: float | None = None
) -> DataFrame:
    """Keep a row only if it comes at least ``gap_s`` after the last *kept* row of its key.

    The rule is greedy, so it is a chain through the whole history. A slice depends on the past only
    through the last kept instant, and that matters only while its silence reaches into the slice.
    So: per slice, the outcome for each possible first kept row; then one pass over these summaries
    per key; then the rows of each slice with the known entry state. A slice is 64 gaps long unless its
    length is given; one task orders the rows of a slice, and its summary holds those of its first gap.
    """
    gap = max(int(gap_s * MICROS), 1)
    slice_s = max(slice_s or SLICE_GAPS * gap_s, gap_s)
    # of rows at the same instant only the first can be kept
    single = (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, t).orderBy(tie)))
        .filter("_rn = 1")
        .drop("_rn")
    )
    sliced = with_slice(single, t, slice_s)
    key_fields = [single.schema[k] for k in keys]
    columns = single.columns

    summary_schema = T.StructType(
        [*key_fields, T.StructField(SLICE, T.LongType()),
         T.StructField("starts", T.ArrayType(T.LongType())),
         T.StructField("ends", T.ArrayType(T.LongType()))]
    )

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf[t].to_numpy())
        begin = int(pdf[SLICE].iloc[0])
        ends = _last_of_chain(times, gap)
        n = min(int(np.searchsorted(times, begin + gap)) + 1, len(times))
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, SLICE: begin, "starts": times[:n], "ends": ends[:n]}])

    summaries = sliced.select(*keys, SLICE, t).groupBy(*keys, SLICE).applyInPandas(
        summarise, summary_schema
    )

    entry_schema = T.StructType(
        [*key_fields, T.StructField(SLICE, T.LongType()), T.StructField("_ready", T.LongType())]
    )

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ready = [], None
        pdf = pdf.sort_values(SLICE)
        for begin, starts, ends in zip(pdf[SLICE], pdf["starts"], pdf["ends"]):
            rows.append((*key, begin, begin if ready is None else ready))
            at = 0 if ready is None else int(np.searchsorted(starts, ready))
            if at < len(starts):
                ready = int(ends[at]) + gap
        return pd.DataFrame(rows, columns=[*keys, SLICE, "_ready"])

    entries = summaries.groupBy(*keys).applyInPandas(chain, entry_schema)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        times = pdf[t].to_numpy()
        at = int(np.searchsorted(times, int(pdf["_ready"].iloc[0])))
        kept = []
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + gap))
        return pdf.iloc[kept][columns]

    return (
        join_keys(sliced, entries, [*keys, SLICE])
        .groupBy(*keys, SLICE)
        .applyInPandas(keep, single.schema)
    )
