"""Specifications as tables: ``tag_specs`` and ``loop_specs`` of many systems, and ``reviews``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import one_value

WIDE_SPAN = 1e6  # a range wider than this is suspicious


def items(tags: DataFrame, loops: DataFrame) -> DataFrame:
    """Tags and loops as one list of things to review."""
    return tags.select("spec_name", F.lit("tag").alias("kind"), F.col("tag").alias("item"), "confidence").unionByName(
        loops.select(
            "spec_name", F.lit("loop").alias("kind"), F.col("loop_id").alias("item"), "confidence"
        )
    )


def to_review(tags: DataFrame, loops: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items below full confidence that nobody has reviewed."""
    return (
        items(tags, loops)
        .filter(F.col("confidence") < 1.0)
        .join(reviews, ["spec_name", "kind", "item"], "left_anti")
    )


def suspicious_bounds(tags: DataFrame) -> DataFrame:
    """Limits with an empty or a very wide range."""
    span = F.col("max_val") - F.col("min_val")
    return tags.filter((span <= 0) | (span > WIDE_SPAN)).select("spec_name", "tag", "min_val", "max_val")


def approve(tags: DataFrame, loops: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviewed items get full confidence; per specification the overall confidence and status."""

    def lifted(table: DataFrame, kind: str, item: str) -> DataFrame:
        done = (
            reviews.filter(F.col("kind") == kind)
            .select("spec_name", F.col("item").alias(item), F.lit(True).alias("_done"))
            .distinct()
        )
        return table.join(done, ["spec_name", item], "left").select(
            *[
                F.when(F.col("_done"), F.lit(1.0)).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c)
                for c in table.columns
            ]
        )

    listed = items(tags, loops)
    done = reviews.select("spec_name", "kind", "item", F.lit(1).alias("_done")).distinct()
    any_review = reviews.select("spec_name", F.lit(1).alias("_any")).distinct()
    status = (
        listed.join(done, ["spec_name", "kind", "item"], "left")
        .groupBy("spec_name")
        .agg(F.count(F.lit(1)).alias("n_items"), F.count("_done").alias("n_reviewed"))
        .join(any_review, "spec_name", "left")
        .select(
            "spec_name", "n_items", "n_reviewed",
            F.round(0.85 + 0.15 * F.col("n_reviewed") / F.col("n_items"), 3).alias("confidence"),
            F.when(F.col("n_reviewed") == F.col("n_items"), "approved")
            .when(F.col("_any") == 1, "reviewed")
            .otherwise("pending")
            .alias("status"),
        )
    )
    return lifted(tags, "tag", "tag"), lifted(loops, "loop", "loop_id"), status


def inventory(tags: DataFrame, loops: DataFrame, status: DataFrame) -> DataFrame:
    """Per specification: counts, confidence, status."""
    counted = items(tags, loops).groupBy("spec_name").agg(
        F.count(F.when(F.col("kind") == "tag", 1)).alias("n_tags"),
        F.count(F.when(F.col("kind") == "loop", 1)).alias("n_loops"),
    )
    return counted.join(status.select("spec_name", "confidence", "status"), "spec_name", "left")


def compare_tags(one: DataFrame, other: DataFrame) -> DataFrame:
    """Every tag of either specification: where it is, and by how much its limits differ."""
    a = one.select("tag", F.col("min_val").alias("a_min"), F.col("max_val").alias("a_max"), F.lit(1).alias("_a"))
    b = other.select("tag", F.col("min_val").alias("b_min"), F.col("max_val").alias("b_max"), F.lit(1).alias("_b"))
    return a.join(b, "tag", "full_outer").select(
        "tag",
        F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").otherwise("both").alias("side"),
        F.abs(F.col("b_min") - F.col("a_min")).alias("err_lo"),
        F.abs(F.col("b_max") - F.col("a_max")).alias("err_hi"),
    )


def compare_specs(tags_a: DataFrame, tags_b: DataFrame, loops_a: DataFrame, loops_b: DataFrame) -> DataFrame:
    """One row: tag coverage, missing, extra, wrong limits, loops in common and with equal limiter."""
    tags = compare_tags(tags_a, tags_b).agg(
        F.count(F.when(F.col("side") == "both", 1)).alias("n_common"),
        F.count(F.when(F.col("side") != "extra", 1)).alias("n_expected"),
        F.count(F.when(F.col("side") == "missing", 1)).alias("n_missing"),
        F.count(F.when(F.col("side") == "extra", 1)).alias("n_extra"),
        F.count(F.when((F.col("err_lo") > 0) | (F.col("err_hi") > 0), 1)).alias("n_bound_errors"),
    )
    a = loops_a.select("loop_id", F.col("has_rate_limiter").alias("_a"))
    b = loops_b.select("loop_id", F.col("has_rate_limiter").alias("_b"))
    loops = a.join(b, "loop_id").agg(
        F.count(F.lit(1)).alias("n_loops_common"),
        F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("n_limiters_right"),
    )
    return tags.select(
        "*",
        F.round(F.col("n_common") / F.greatest(F.col("n_expected"), F.lit(1)), 3).alias("coverage"),
        one_value(loops).alias("_l"),
    ).select("*", "_l.*").drop("_l")


# Fixed values of the public test bed's manual: limits per tag.
PROCESS_TAGS = [
    # tag, min, max, unit, page, description
    ("P1_B2016", 0.0, 10.0, "bar", 12, "pressure demand"),
    ("P1_PIT01", 0.0, 10.0, "bar", 13, "pressure"),
    ("P1_PCV01D", 0.0, 100.0, "%", 13, "pressure valve position"),
    ("P1_B3004", 0.0, 720.0, "mm", 12, "boiler level demand"),
    ("P1_LIT01", 0.0, 720.0, "mm", 13, "boiler level"),
    ("P1_LCV01D", 0.0, 100.0, "%", 13, "level valve position"),
    ("P1_B3005", 0.0, 10.0, "m³/h", 12, "flow demand"),
    ("P1_FCV03D", 0.0, 100.0, "%", 13, "flow valve position"),
    ("P1_FIT01", 0.0, 10.0, "m³/h", 13, "flow"),
    ("P1_B3003", 0.0, 500.0, "°C", 12, "temperature demand"),
    ("P1_TIT01", 0.0, 500.0, "°C", 13, "temperature"),
    ("P2_AutoSD", 0.0, 3200.0, "RPM", 13, "turbine speed demand"),
    ("P2_SIT01", 0.0, 3200.0, "RPM", 14, "turbine speed"),
    ("P2_RTR", 0.0, 2880.0, "RPM", 14, "trip speed"),
    ("P2_SCO", 0.0, 100.0, "%", 14, "speed control output"),
    ("P3_LIT01", 0.0, 1000.0, "mm", 14, "water storage level"),
    ("P3_LCV01", 0.0, 100.0, "%", 14, "water level valve"),
    ("P4_ST_PS", 0.0, 100.0, "%", 15, "scheduled turbine power"),
    ("P4_HT_PS", 0.0, 100.0, "%", 15, "scheduled heating power"),
]

# Control loops of the same manual.
PROCESS_LOOPS = [
    # loop, set point, process value, control output, inputs of other layers, page, figure
    ("P1-PC", "P1_B2016", "P1_PIT01", "P1_PCV01D", [], 7, "Figure 4"),
    ("P1-LC", "P1_B3004", "P1_LIT01", "P1_LCV01D", [], 7, "Figure 5"),
    ("P1-FC", "P1_B3005", "P1_FIT01", "P1_FCV03D", [], 7, "Figure 6"),
    ("P2-SC", "P2_AutoSD", "P2_SIT01", "P2_SCO", ["P4_ST_PS"], 10, "Figure 11"),
    ("P3-LC", "P3_LIT01", "P3_LIT01", "P3_LCV01", ["P4_HT_PS"], 11, "Figure 13"),
]

# Tags behind a rate limiter or ramp.
RATE_LIMITED = ["P1_PCV01D", "P1_LCV01D", "P1_FCV03D", "P2_AutoSD", "P3_LCV01"]

TAG_SCHEMA = (
    "spec_name STRING, tag STRING, min_val DOUBLE, max_val DOUBLE, unit STRING, description STRING, "
    "document STRING, page_number INT, figure_id STRING, quote STRING, extracted_by STRING, confidence DOUBLE"
)
LOOP_SCHEMA = (
    "spec_name STRING, loop_id STRING, setpoint_tag STRING, process_var_tag STRING, "
    "control_var_tag STRING, has_saturation BOOLEAN, has_rate_limiter BOOLEAN, "
    "cross_layer_inputs ARRAY<STRING>, document STRING, page_number INT, figure_id STRING, "
    "quote STRING, extracted_by STRING, confidence DOUBLE"
)


def process_spec(spark, spec_name: str = "process-plant") -> tuple[DataFrame, DataFrame]:
    """Tag and loop tables of the process plant."""
    tags = [
        (spec_name, t, lo, hi, unit, text, "manual", page, "Table 1", f"{t}: [{lo}, {hi}] {unit}", "manual", 1.0)
        for t, lo, hi, unit, page, text in PROCESS_TAGS
    ]
    loops = [
        (spec_name, i, sp, pv, cv, True, True, inputs, "manual", page, figure, "", "manual", 1.0)
        for i, sp, pv, cv, inputs, page, figure in PROCESS_LOOPS
    ]
    return spark.createDataFrame(tags, TAG_SCHEMA), spark.createDataFrame(loops, LOOP_SCHEMA)


def water_spec(spark, spec_name: str = "water-plant") -> tuple[DataFrame, DataFrame]:
    """Tag and loop tables of the water plant."""
    tags = [
        (spec_name, "tank_level_value(2)", 0.0, 1.0, "m", "water level in tank", "register layout", 1, "", "", "manual", 1.0),
        (spec_name, "tank_output_flow_value(7)", 0.0, 0.0001, "m³/s", "output flow", "instrument data", 1, "", "", "manual", 1.0),
    ]
    # The loop names the column the flow counts are joined in as, so that the generic rule can fire.
    loops = [
        (
            spec_name, "fill-drain-cycle", "tank_level_min(3)", "tank_level_value(2)",
            "tank_input_valve_status(0)", False, False, ["net_flow_count"], "process description", 1, "", "",
            "manual", 1.0,
        )
    ]
    return spark.createDataFrame(tags, TAG_SCHEMA), spark.createDataFrame(loops, LOOP_SCHEMA)
