"""Event-level and row-level scores of detections, and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import one_value
from ..functions.ordered import segments
from ..session import stage
from .intervals import overlapping


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def event_scores(
    labelled: DataFrame, keys: Sequence[str], t: str, tie: str, buffer_steps: int, slice_s: float,
    truth: str = "truth", flagged: str = "flagged",
) -> DataFrame:
    """Per key: share of flagged runs near a true run, share of true runs hit, and their F1.

    A flagged run counts if it overlaps [start - buffer, end + buffer] of a true run, a true run if a
    flagged one overlaps [start - buffer, end]. Steps are positions, not time.
    """
    # both kinds of runs come from one pass with the kind as a further key
    kinds = F.explode(
        F.array(
            F.struct(F.lit("true").alias("kind"), F.col(truth).cast("int").alias("on")),
            F.struct(F.lit("flagged").alias("kind"), F.col(flagged).cast("int").alias("on")),
        )
    )
    rows = labelled.select(*keys, t, tie, kinds.alias("_f")).select(
        *keys, t, tie, F.col("_f.kind").alias("_kind"), F.col("_f.on").alias("_flag")
    )
    runs = stage(segments(rows, [*keys, "_kind"], t, tie, "_flag", slice_s), "runs")
    actual = runs.filter(F.col("_kind") == "true").drop("_kind")
    found = runs.filter(F.col("_kind") == "flagged").drop("_kind")
    hit = overlapping(actual, found, keys, buffer_steps, 0)
    # a flagged run overlaps the widened true run exactly if the true run overlaps it widened alike
    valid = overlapping(found, actual, keys, buffer_steps, buffer_steps)

    def counted(df: DataFrame, what: str) -> DataFrame:
        return df.select(*keys, F.lit(what).alias("_what"))

    everyone = labelled.select(*keys).distinct().withColumn("_what", F.lit("series"))
    what = everyone
    for df, name in ((actual, "actual"), (found, "found"), (hit, "hit"), (valid, "valid")):
        what = what.unionByName(counted(df, name))
    n = lambda name: F.count(F.when(F.col("_what") == name, 1))
    counts = what.groupBy(*keys).agg(
        n("actual").alias("n_true_events"), n("found").alias("n_pred_clusters"),
        n("hit").alias("_hit"), n("valid").alias("_valid"),
    )
    scored = counts.withColumn(
        "etap",
        F.when(F.col("n_pred_clusters") == 0, F.lit(1.0)).otherwise(F.col("_valid") / F.col("n_pred_clusters")),
    ).withColumn(
        "etar",
        F.when(F.col("n_true_events") == 0, F.lit(1.0)).otherwise(F.col("_hit") / F.col("n_true_events")),
    )
    return scored.select(
        *keys, "n_true_events", "n_pred_clusters", "etap", "etar",
        f1(F.col("etap"), F.col("etar")).alias("etapr_f1"),
    )


def point_scores(
    labelled: DataFrame, keys: Sequence[str], truth: str = "truth", flagged: str = "flagged"
) -> DataFrame:
    """Row-wise precision, recall and F1, 0 where undefined."""
    t, p = F.col(truth).cast("int") == 1, F.col(flagged).cast("int") == 1
    n = labelled.groupBy(*keys).agg(
        F.count(F.when(t & p, 1)).alias("_tp"),
        F.count(F.when(~t & p, 1)).alias("_fp"),
        F.count(F.when(t & ~p, 1)).alias("_fn"),
    )
    return (
        n.withColumn("std_precision", safe_ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")))
        .withColumn("std_recall", safe_ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")))
        .withColumn("std_f1", f1(F.col("std_precision"), F.col("std_recall")))
        .select(*keys, "std_precision", "std_recall", "std_f1")
    )


def event_report(
    labelled: DataFrame, keys: Sequence[str], t: str, tie: str, slice_s: float,
    buffer_steps: int = 60, buffer_seconds: float | None = None, step_s: float | None = None,
    truth: str = "truth", flagged: str = "flagged",
) -> DataFrame:
    """Both kinds of score, four decimals. A buffer in seconds is turned into steps of ``step_s``."""
    if buffer_seconds is not None:
        if not step_s:
            raise ValueError("buffer_seconds needs step_s, the length of one step in seconds")
        buffer_steps = int(buffer_seconds // step_s)
    events = event_scores(labelled, keys, t, tie, buffer_steps, slice_s, truth, flagged)
    points = point_scores(labelled, keys, truth, flagged)
    return events.join(points, list(keys)).select(
        *keys, "n_true_events", "n_pred_clusters",
        *[F.round(c, 4).alias(c) for c in ("std_precision", "std_recall", "std_f1", "etap", "etar", "etapr_f1")],
        F.lit(buffer_steps).alias("buffer_steps"),
    )


def window_false_positives(windows: DataFrame, truth: str = "truth", flagged: str = "flagged") -> DataFrame:
    """Share of normal windows that were flagged."""
    normal = F.col(truth).cast("int") == 0
    both = normal & (F.col(flagged).cast("int") == 1)
    return windows.agg(
        F.count(F.when(normal, 1)).alias("n_normal"), F.count(F.when(both, 1)).alias("n_flagged")
    ).withColumn("window_fpr", safe_ratio(F.col("n_flagged"), F.col("n_normal")))


# ---- classes ---------------------------------------------------------------------------------


def confusion(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per pair of classes and their share of the true class."""
    counts = df.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*keys, label).agg(F.sum("n").alias("_row"))
    return counts.join(rows, [*keys, label]).select(
        *keys, label, predicted, "n", (F.col("n") / F.col("_row")).alias("share")
    )


def class_metrics(df: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where undefined."""
    counts = df.groupBy(*keys, label, predicted).agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.lit("true").alias("side")),
                F.struct(F.col(predicted).alias("class"), F.lit("pred").alias("side")),
            )
        ).alias("s"),
        "n", (F.col(label) == F.col(predicted)).alias("_ok"),
    )
    per = sides.groupBy(*keys, F.col("s.class").alias("class")).agg(
        F.sum(F.when(F.col("s.side") == "true", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "pred", F.col("n")).otherwise(0)).alias("_pred"),
        F.sum(F.when((F.col("s.side") == "true") & F.col("_ok"), F.col("n")).otherwise(0)).alias("_tp"),
    )
    return (
        per.withColumn("precision", safe_ratio(F.col("_tp"), F.col("_pred")))
        .withColumn("recall", safe_ratio(F.col("_tp"), F.col("support")))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .select(*keys, "class", "precision", "recall", "f1", "support", F.col("_tp").alias("n_right"))
    )


def overall_metrics(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro F1 and accuracy from the class rows."""
    return per_class.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), safe_ratio(F.sum("n_right"), F.sum("support")).alias("accuracy")
    )


def recall_delta(baseline: DataFrame, fused: DataFrame) -> DataFrame:
    """Recall per model and class with and without the added layer."""
    a = baseline.select("model", "class", F.col("recall").alias("baseline_recall"))
    b = fused.select("model", "class", F.col("recall").alias("fused_recall"))
    return a.join(b, ["model", "class"]).select(
        "model", "class", F.round("baseline_recall", 4).alias("baseline_recall"),
        F.round("fused_recall", 4).alias("fused_recall"),
        F.round(F.col("fused_recall") - F.col("baseline_recall"), 4).alias("delta"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * count) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.withColumn("_t", one_value(totals)).select(
        label, "n", (F.col("_t.total") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )


def coverage_by_stratum(windows: DataFrame, ids: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """Per stratum and over all: share of attack windows in which each rule fires, and in which none does.

    ``windows`` holds attack windows only, with ``ids`` (the rules fired) as an array.
    """
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return (
        windows.rollup(stratum)
        .agg(
            F.grouping(stratum).alias("_all"),
            F.count(F.lit(1)).alias("n_atk_win"),
            *[pct(F.array_contains("ids", i)).alias(f"{i}_pct") for i in ids],
            pct(F.size("ids") == 0).alias("invisible_pct"),
        )
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col(stratum)).alias("process"),
            "n_atk_win", *[f"{i}_pct" for i in ids], "invisible_pct",
        )
    )


def process_stratum(active: Column) -> Column:
    """Name of the one active process, ``multi-process`` or ``normal``."""
    return (
        F.when(F.size(active) == 0, "normal").when(F.size(active) == 1, F.get(active, F.lit(0))).otherwise("multi-process")
    )


def method_row(scores: DataFrame, method: str, target: str = "replay") -> DataFrame:
    """One line of a method comparison from class metrics."""
    of = F.col("class") == target
    return scores.agg(
        F.lit(method).alias("method"),
        F.coalesce(F.max(F.when(of, F.col("recall"))), F.lit(0.0)).alias("target_recall"),
        F.coalesce(F.max(F.when(of, F.col("f1"))), F.lit(0.0)).alias("target_f1"),
        F.avg("f1").alias("macro_f1"),
    )


# ---- distance from normal --------------------------------------------------------------------


def row_zscore(
    readings: DataFrame, baseline: DataFrame, keys: Sequence[str], base_keys: Sequence[str],
    floor: float = 1e-9,
) -> DataFrame:
    """Largest |value - mean| / deviation per key over all sensors; a missing value is the mean."""
    base = baseline.select(*base_keys, "mean", "std")
    sd = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(floor))
    z = F.abs((F.coalesce(F.col("value"), F.col("mean")) - F.col("mean")) / sd)
    return readings.join(base, list(base_keys)).groupBy(*keys).agg(F.max(z).alias("score"))
