"""The same questions on streams: Structured Streaming with event time and watermarks.

Readings have ``series, sensor, ts, row_id, value``. Append mode gives a window once it is closed,
that is once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.baseline import NO_STD, NO_VARIANCE
from ..operators.constraints import FROZEN, Constraint, apply_constraints
from ..operators.rolling import (
    COLLAPSE, COLLAPSE_SHARE, COOLDOWN_S, CROSS, MIN_STD, MIN_VALUES, MIN_VARIANCE, PROMOTE_OTHERS,
    PROMOTE_S, SPIKE, WINDOW_S, Z_HIGH, Z_SPIKE,
)


def window_start(name: str = "window"):
    return F.unix_timestamp(F.col(f"{name}.start"))


def tumbling_stats(
    readings: DataFrame, width: str, delay: str, keys: Sequence[str] = ("series", "sensor")
) -> DataFrame:
    """Variance and range per closed window and sensor."""
    return (
        readings.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *keys)
        .agg(
            F.count("value").alias("n"),
            F.var_samp("value").alias("var"),
            (F.max("value") - F.min("value")).alias("range"),
        )
    )


def sliding_variance(
    readings: DataFrame, width: str, step: str, delay: str, keys: Sequence[str] = ("series", "sensor")
) -> DataFrame:
    """Population variance over sliding windows: the grid form of the rolling variance."""
    return (
        readings.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, step), *keys)
        .agg(F.count("value").alias("n"), F.var_pop("value").alias("rolling_var"))
    )


def limit_violations(
    readings: DataFrame, tags: DataFrame, baseline: DataFrame, width: str, delay: str,
    keys: Sequence[str] = ("series", "sensor"),
) -> DataFrame:
    """Bounds and frozen-sensor rules on closed windows; limits and baseline are static tables."""
    stats = (
        readings.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), *keys)
        .agg(
            F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.var_samp("value").alias("var"),
        )
    )
    limits = tags.select(F.col("tag").alias("sensor"), "min_val", "max_val")
    base = baseline.select(*keys, F.col("variance").alias("base_var"))
    known = stats.join(limits, "sensor", "left").join(base, list(keys), "left")
    rules = [
        Constraint(
            "GC1", "saturation-bounds", "definite", 0.95,
            (F.col("lo") < F.col("min_val")) | (F.col("hi") > F.col("max_val")),
        ),
        Constraint(
            "FROZEN", "frozen-sensor", "probable", 0.9,
            (F.col("n") >= 2) & (F.col("var") < FROZEN * F.col("base_var")),
        ),
    ]
    return apply_constraints(known, ["window", *keys], rules)


def loop_violations(
    readings: DataFrame, loops: DataFrame, baseline: DataFrame, width: str, delay: str, series: str = "series"
) -> DataFrame:
    """Tracking and cross-layer rules on closed windows.

    The loops of a specification are few, so their tags become columns of one window row; the baseline
    (``series, tag, std, variance``) is a static table turned the same way.
    """
    pairs = [
        (kind, row["loop_id"], driver, row["process_var_tag"])
        for row in loops.collect()
        for kind, driver in [("GC3", row["setpoint_tag"]), *[("GC4", x) for x in row["cross_layer_inputs"]]]
        if driver and row["process_var_tag"] and not (kind == "GC3" and driver == row["process_var_tag"])
    ]
    tags = sorted({x for _, _, d, p in pairs for x in (d, p)})
    number = {tag: i for i, tag in enumerate(tags)}
    order = F.struct("ts", "row_id")
    aggs, base_aggs = [], []
    for tag, i in number.items():
        mine = F.col("sensor") == tag
        x = F.when(mine, F.col("value"))
        known = mine & F.col("value").isNotNull()
        aggs += [
            F.count(x).alias(f"n{i}"), (F.max(x) - F.min(x)).alias(f"range{i}"), F.var_samp(x).alias(f"var{i}"),
            F.min_by(x, F.when(known, order)).alias(f"first{i}"), F.max_by(x, F.when(known, order)).alias(f"last{i}"),
        ]
        of = F.col("tag") == tag
        base_aggs += [
            F.max(F.when(of, F.col("std"))).alias(f"std{i}"), F.max(F.when(of, F.col("variance"))).alias(f"base{i}"),
        ]
    windows = readings.withWatermark("ts", delay).groupBy(F.window("ts", width), series).agg(*aggs)
    known = windows.join(baseline.groupBy(series).agg(*base_aggs), series, "left")
    rules = []
    for kind, loop, driver, follower in pairs:
        d, p = number[driver], number[follower]
        std, var = F.coalesce(f"std{d}", F.lit(NO_STD)), F.coalesce(f"base{p}", F.lit(NO_VARIANCE))
        still = (F.col(f"n{d}") >= 2) & (F.col(f"n{p}") >= 2) & (F.col(f"var{p}") < FROZEN * (var + 1e-12))
        if kind == "GC3":
            rules.append(Constraint(kind, f"tracking-invariant-{loop}", "definite", 0.9, still & (F.col(f"range{d}") >= 2.0 * std)))
        else:
            moved = F.abs(F.col(f"last{d}") - F.col(f"first{d}")) > 3.0 * std + 1e-9
            rules.append(Constraint(kind, f"cross-layer-{driver}->{follower}", "definite", 0.8, still & moved))
    return apply_constraints(known, ["window", series], rules)


def fuse_layers(
    readings: DataFrame, flows: DataFrame, width: str, delay: str, series: str = "series"
) -> DataFrame:
    """Sensor windows with the flow count of the same window, 0 where no flow came in."""
    sensor = (
        readings.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), series)
        .agg(F.count("value").alias("n_readings"), F.var_samp("value").alias("var"))
    )
    counts = (
        flows.withWatermark("ts", delay)
        .groupBy(F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("n_flows"))
    )
    return sensor.join(counts, "window", "left").withColumn(
        "n_flows", F.coalesce("n_flows", F.lit(0))
    )


def alert_sessions(
    alerts: DataFrame, gap: str, delay: str, keys: Sequence[str] = ("series",)
) -> DataFrame:
    """Bursts of alerts: a session ends after a pause of ``gap``."""
    return (
        alerts.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), *keys)
        .agg(F.count(F.lit(1)).alias("n_alerts"))
    )


ALERT_SCHEMA = (
    "series STRING, sensor STRING, ts TIMESTAMP, t_us LONG, row_id LONG, alert_type STRING, "
    "z_score DOUBLE, rolling_var DOUBLE, baseline_var DOUBLE, confidence STRING"
)
ALERT_NAMES = [part.split()[0] for part in ALERT_SCHEMA.split(", ")]
DETECTOR_STATE = (
    "t ARRAY<LONG>, v ARRAY<DOUBLE>, last_spike LONG, last_collapse LONG, "
    "waiting_t ARRAY<LONG>, waiting_v ARRAY<DOUBLE>, waiting_row ARRAY<LONG>, mean DOUBLE, std DOUBLE, variance DOUBLE"
)
LONG_AGO = -(1 << 62)


def detector(
    readings: DataFrame, baseline: DataFrame, delay: str, window_s: float = WINDOW_S,
    cooldown_s: float = COOLDOWN_S,
) -> DataFrame:
    """Spike and collapse alerts with the trailing window and the last alerts as state.

    Rows wait until the watermark has passed them and are then handled in time order, so the alerts don't depend on
    how rows fall into batches. Spark drops and counts rows that come behind the watermark (``dropped_rows``). The
    state of a sensor is the values of one window and of the delay. Needs ``t_us``.
    """
    width, gap = int(window_s * 1e6), int(cooldown_s * 1e6)
    base = baseline.select("series", "sensor", "mean", "std", "variance").filter(F.col("std") >= MIN_STD)
    ready = (
        readings.filter(F.col("value").isNotNull())
        .withWatermark("ts", delay)
        .join(base, ["series", "sensor"])
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            old_t, old_v, last_spike, last_collapse, *waiting, mean, std, variance = state.get
        else:
            old_t, old_v, last_spike, last_collapse, waiting = [], [], LONG_AGO, LONG_AGO, ([], [], [])
        parts = [pd.DataFrame(dict(zip(("t_us", "value", "row_id"), waiting))).astype({"t_us": "int64", "value": float, "row_id": "int64"})]
        if not state.hasTimedOut:
            for pdf in batches:
                parts.append(pdf[["t_us", "value", "row_id"]])
                mean, std, variance = (float(pdf[c].iloc[0]) for c in ("mean", "std", "variance"))
        rows = pd.concat([x for x in parts if len(x)] or parts[:1]).sort_values(["t_us", "row_id"])
        open_ = rows["t_us"].to_numpy(np.int64) > state.getCurrentWatermarkMs() * 1000
        later, rows = rows[open_], rows[~open_]
        t = np.concatenate([np.array(old_t, np.int64), rows["t_us"].to_numpy(np.int64)])
        v = np.concatenate([np.array(old_v, float), rows["value"].to_numpy(float)])
        if len(rows):
            here = np.arange(len(old_t), len(t))
            # rows at one instant see the same window, as a RANGE frame does
            low, high = np.searchsorted(t, t[here] - width), np.searchsorted(t, t[here], "right")
            count = high - low
            centred = v - mean
            sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (centred, centred**2))
            rough = (squares[high] - squares[low]) / count - ((sums[high] - sums[low]) / count) ** 2
            z = centred[here] / std
            limit = COLLAPSE_SHARE * variance
            enough = count >= MIN_VALUES
            spikes = np.flatnonzero(enough & (np.abs(z) >= Z_SPIKE))
            # running sums only preselect; the value that decides is computed from the window itself
            near = np.flatnonzero(enough & (rough < limit * 1.001) & (variance > MIN_VARIANCE))
            frozen = np.array([i for i in near if np.var(v[low[i] : high[i]]) < limit], dtype=int)

            def kept(found: np.ndarray, last: int) -> tuple[list, int]:
                chosen, times = [], t[here[found]]
                at = int(np.searchsorted(times, last + gap))
                while at < len(found):
                    chosen.append(found[at])
                    last = int(times[at])
                    at = int(np.searchsorted(times, last + gap))
                return chosen, last

            out = []
            ts, ids = pd.to_datetime(rows["t_us"].to_numpy(), unit="us").to_numpy(), rows["row_id"].to_numpy()
            chosen, last_spike = kept(spikes, last_spike)
            for i in chosen:
                var = float(np.var(v[low[i] : high[i]]))
                out.append((*key, ts[i], int(t[here[i]]), int(ids[i]), SPIKE, round(float(z[i]), 3), round(var, 6),
                            round(variance, 6), "high" if abs(z[i]) > Z_HIGH else "medium"))
            chosen, last_collapse = kept(frozen, last_collapse)
            for i in chosen:
                var = float(np.var(v[low[i] : high[i]]))
                out.append((*key, ts[i], int(t[here[i]]), int(ids[i]), COLLAPSE, float("nan"), round(var, 9),
                            round(variance, 6), "high" if var < limit / 10 else "medium"))
            if out:
                yield pd.DataFrame(out, columns=ALERT_NAMES)
        first = int(np.searchsorted(t, t[-1] - width)) if len(t) else 0
        state.update(
            (t[first:].tolist(), v[first:].tolist(), last_spike, last_collapse,
             later["t_us"].tolist(), later["value"].tolist(), later["row_id"].tolist(), mean, std, variance)
        )
        if len(later):
            state.setTimeoutTimestamp(max(int(later["t_us"].iloc[0]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return ready.groupBy("series", "sensor").applyInPandasWithState(
        step, ALERT_SCHEMA, DETECTOR_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


PROMOTED_SCHEMA = "series STRING, sensor STRING, t_us LONG, row_id LONG, alert_type STRING"
PROMOTER_STATE = "t ARRAY<LONG>, sensor ARRAY<STRING>, row ARRAY<LONG>, done ARRAY<BOOLEAN>"


def promoter(alerts: DataFrame, delay: str, within_s: float = PROMOTE_S) -> DataFrame:
    """Collapse alerts with at least two others nearby in their series become cross-layer alerts.

    The rule looks ahead, so an alert is given out once the watermark has passed its neighbourhood.
    The state is the collapse alerts of two neighbourhoods.
    """
    reach = int(within_s * 1e6)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [list(x) for x in state.get] if state.exists else [[], [], [], []]
        if not state.hasTimedOut:
            for pdf in batches:
                kept[0] += pdf["t_us"].tolist()
                kept[1] += pdf["sensor"].tolist()
                kept[2] += pdf["row_id"].tolist()
                kept[3] += [False] * len(pdf)
        closed = state.getCurrentWatermarkMs() * 1000
        order = np.argsort(np.array(kept[0], dtype=np.int64), kind="stable")
        t = np.array(kept[0], dtype=np.int64)[order]
        near = np.searchsorted(t, t + reach, "right") - np.searchsorted(t, t - reach, "left") - 1
        out, left = [], [[], [], [], []]
        for i, at in enumerate(order):
            time, sensor, row, done = int(t[i]), kept[1][at], int(kept[2][at]), kept[3][at]
            if not done and time + reach < closed:
                kind = CROSS if near[i] >= PROMOTE_OTHERS else COLLAPSE
                out.append((*key, sensor, time, row, kind))
                done = True
            if time + 2 * reach >= closed:
                for part, item in zip(left, (time, sensor, row, done)):
                    part.append(item)
        if left[0]:
            state.update(tuple(left))
            waiting = [x for x, d in zip(left[0], left[3]) if not d]
            wake = (min(waiting) + reach) // 1000 + 1 if waiting else (max(left[0]) + 2 * reach) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["series", "sensor", "t_us", "row_id", "alert_type"])

    collapse = alerts.filter(F.col("alert_type") == COLLAPSE).withWatermark("ts", delay)
    return collapse.groupBy("series").applyInPandasWithState(
        step, PROMOTED_SCHEMA, PROMOTER_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def dropped_rows(query) -> int:
    """Rows the stateful operators dropped because the watermark had passed them."""
    return sum(
        op["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
