"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, packets
from ..operators.profile import skew
from .base import BUCKETED, FLOW_FEATURES, FLOWS, READINGS, SENSORS, Tables, query, r


@query(
    "prj_numeric_coerce",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x FROM events",
)
def prj_numeric_coerce(t: Tables):
    text = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")).alias("x")
    )
    return text.select("event_id", C.to_number("x").alias("x"))


@query(
    "prj_time_coerce",
    "SELECT event_id, epoch_us(ts) AS t_us FROM events WHERE event_type <> 'error'",
)
def prj_time_coerce(t: Tables):
    text = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "??").otherwise(F.col("ts").cast("string")).alias("when")
    )
    parsed = text.select("event_id", C.to_instant("when").alias("ts")).dropna(subset=["ts"])
    return parsed.select("event_id", F.unix_micros("ts").alias("t_us"))


@query(
    "prj_elapsed",
    f"WITH {READINGS} SELECT row_id, round((t_us - min(t_us) OVER (PARTITION BY series)) / 1e6, 6) AS elapsed_s FROM readings",
)
def prj_elapsed(t: Tables):
    return align.with_elapsed(t.readings, ["series"], "t_us").select("row_id", r("elapsed_s"))


@query(
    "prj_clock_offset",
    """SELECT round((epoch_us(min(o_orderdate)) - (SELECT epoch_us(min(l_shipdate)) FROM lineitem)) / 1e6, 3) AS offset_s,
    epoch_us(min(o_orderdate)) + 7200000000 AS shifted_us FROM orders""",
)
def prj_clock_offset(t: Tables):
    o = t.orders.select(C.epoch_us(t.orders, "o_orderdate").alias("t_us"))
    found = align.clock_offset(o, "t_us", t.flows, "t_us")
    shifted = o.agg(F.min(C.shift_clock(F.col("t_us"), 7200)).alias("shifted_us"))
    return found.select(r("offset_s", 3), shifted.scalar().alias("shifted_us"))


@query(
    "prj_time_bucket",
    f"WITH {READINGS} SELECT row_id, (t_us // 30000000) * 30 AS b30, (t_us // 60000000) * 60 AS b60 FROM readings",
)
def prj_time_bucket(t: Tables):
    us = F.col("t_us")
    return t.readings.select("row_id", C.time_bucket(us, 30).alias("b30"), C.epoch_bucket(us / 1e6, 60).alias("b60"))


@query(
    "prj_leakage_drop",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def prj_leakage_drop(t: Tables):
    return C.drop_leakage(t.orders, names=["o_custkey"], parts=["date", "PRIORITY"])


@query(
    "prj_numeric_only",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def prj_numeric_only(t: Tables):
    li = t.lineitem
    return li.select(*C.numeric_columns(li, skip=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


@query(
    "prj_one_hot",
    """SELECT o_orderkey, CAST(p = 'F' AS INTEGER) AS "p_F", CAST(p = 'O' AS INTEGER) AS "p_O", CAST(p = 'unknown' AS INTEGER) AS p_unknown
    FROM (SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS p FROM orders)""",
)
def prj_one_hot(t: Tables):
    o = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("p"))
    return align.one_hot(o, "p").drop("p")


NULLED = """nulled AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS a,
  CASE WHEN event_type <> 'view' THEN value END AS b FROM events)"""


def nulled(t: Tables):
    return t.events.select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("b"),
    )


@query(
    "prj_impute",
    f"""WITH {NULLED} SELECT event_id, coalesce(a, 0) AS zero_a, round(coalesce(a, avg(a) OVER ()), 6) AS mean_a,
    round(coalesce(a, (SELECT median(a) FROM nulled)), 6) AS median_a,
    round(coalesce(b, (SELECT median(b) FROM nulled)), 6) AS median_b FROM nulled""",
)
def prj_impute(t: Tables):
    n = nulled(t)
    wide = n.select("event_id", F.col("a").alias("zero_a"), F.col("a").alias("mean_a"), F.col("a").alias("median_a"), F.col("b").alias("median_b"))
    wide = align.fill_missing(wide, ["zero_a"], "zero")
    wide = align.fill_missing(wide, ["mean_a"], "mean")
    wide = align.fill_missing(wide, ["median_a", "median_b"], "median")
    return wide.select("event_id", "zero_a", r("mean_a"), r("median_a"), r("median_b"))


@query(
    "prj_clip_log1p",
    """SELECT event_id, round(CASE WHEN abs((SELECT skewness(value - 20) FROM events)) > 1.5
    THEN ln(1 + greatest(value - 20, 0)) ELSE value - 20 END, 6) AS x, user_id FROM events""",
)
def prj_clip_log1p(t: Tables):
    e = t.events.select("event_id", (F.col("value") - 20).alias("x"), "user_id")
    skewed = {row["feature"] for row in skew(e, ["x", "user_id"], 1.5).collect()}
    return e.select("event_id", *[r(C.clip_log1p(F.col(c)), 6, c) if c in skewed else F.col(c) for c in ("x", "user_id")])


@query(
    "prj_feature_groups",
    """SELECT 'price' AS grp, avg(l_extendedprice) * 0 + count(*) * 1 AS n_values FROM lineitem
    UNION ALL SELECT 'rate', count(*) * 2 FROM lineitem UNION ALL SELECT 'rest', count(*) * 1 FROM lineitem""",
)
def prj_feature_groups(t: Tables):
    li = t.lineitem.select(*FLOW_FEATURES)
    groups = C.feature_groups(
        li.columns, {"price": {"suffix": ["price"]}, "rate": {"prefix": ["l_disc"], "contains": ["tax"]}}, "rest"
    )
    packed = li.agg(
        F.array(
            *[
                F.struct(F.lit(g).alias("grp"), sum((F.count(c) for c in cols), F.lit(0)).cast("double").alias("n_values"))
                for g, cols in groups.items()
            ]
        ).alias("a")
    )
    return packed.select(F.explode("a").alias("s")).select("s.*")


@query(
    "prj_melt",
    """SELECT flow_id, sensor, value FROM (
    UNPIVOT (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flow_id, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
    ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME sensor VALUE value)""",
)
def prj_melt(t: Tables):
    return align.melt(t.flows, ["flow_id"], FLOW_FEATURES)


# The factor lets a decimal half such as 178.35 round up although its binary form lies a little below.
@query(
    "prj_serialize_row",
    """WITH long AS (
      SELECT k, name, value, row_number() OVER (PARTITION BY k ORDER BY abs(value) DESC, name) AS rn FROM (
        UNPIVOT (SELECT event_id AS k, value, CAST(user_id AS DOUBLE) AS user_id, value / 3 AS third FROM events)
        ON value, user_id, third INTO NAME name VALUE value))
    SELECT k AS event_id, string_agg(name || '=' || printf('%.4g', value * (1 + 1e-12)), ', ' ORDER BY rn) AS text
    FROM long WHERE rn <= 2 GROUP BY k""",
)
def prj_serialize_row(t: Tables):
    e = t.events.select("event_id", "value", F.col("user_id").cast("double").alias("user_id"), (F.col("value") / 3).alias("third"))
    return e.select("event_id", C.serialize_top(e, ["value", "user_id", "third"], 2).alias("text"))


HEX = """lpad(to_hex(event_id % 65536), 4, '0') || '0000' || lpad(to_hex(6 + user_id % 4), 4, '0')
  || lpad(to_hex(user_id % 256), 2, '0') || lpad(to_hex(event_id * 7919 % 16777216), 6, '0')
  || lpad(to_hex(user_id * 31 % 65536), 4, '0')"""


def packet_table(t: Tables):
    """Packets with a payload composed from the numbers of each event."""
    e = t.events

    def hexed(c, width):
        return F.lpad(F.hex(c.cast("long")), width, "0")

    payload = F.concat(
        hexed(F.col("event_id") % 65536, 4), F.lit("0000"), hexed(6 + F.col("user_id") % 4, 4),
        hexed(F.col("user_id") % 256, 2), hexed(F.col("event_id") * 7919 % 16777216, 6),
        hexed(F.col("user_id") * 31 % 65536, 4),
    )
    return e.select(
        "event_id", C.epoch_us(e, "ts").alias("t_us"), (F.col("user_id") % 7).cast("string").alias("conn"),
        (F.col("event_id") * 31 % 64).alias("txid"),
        F.when(F.col("event_type") == "click", "tcp").when(F.col("event_type") == "view", "UDP").otherwise("arp").alias("proto"),
        F.when(F.col("event_type") != "error", payload).otherwise("").alias("payload_hex"),
    )


@query(
    "map_mbap",
    f"""WITH p AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN {HEX} ELSE '' END AS h FROM events),
    q AS (SELECT event_id, upper(h) AS h, length(h) AS n FROM p)
    SELECT event_id, CASE WHEN n >= 4 THEN event_id % 65536 END AS transaction_id, CASE WHEN n >= 8 THEN 0 END AS protocol_id,
      CASE WHEN n >= 12 THEN CAST('0x' || substr(h, 9, 4) AS BIGINT) END AS length,
      CASE WHEN n >= 14 THEN CAST('0x' || substr(h, 13, 2) AS BIGINT) END AS unit_id,
      coalesce(CASE WHEN n > 18 THEN CAST('0x' || substr(h, 15, 4) AS BIGINT) || ',' || CAST('0x' || substr(h, 19, 4) AS BIGINT) END, '') AS words
    FROM q""",
)
def map_mbap(t: Tables):
    d = packets.decode(packet_table(t))
    return d.select(
        "event_id", "transaction_id", "protocol_id", "length", "unit_id",
        F.array_join(F.col("words").cast("array<string>"), ",").alias("words"),
    )


ANSWER = """answers AS (SELECT event_id, event_type,
  CASE event_id % 5 WHEN 0 THEN 'This is a ' || upper(event_type) || '.' WHEN 1 THEN 'no idea' WHEN 2 THEN 'view or click'
  WHEN 3 THEN substr(event_type, 1, 3) ELSE 'Error' END AS answer FROM events)"""
MATCHED = ANSWER + """, matched AS (SELECT *, CASE
  WHEN contains(lower(answer), 'click') OR contains('click', lower(answer)) THEN 'click'
  WHEN contains(lower(answer), 'error') OR contains('error', lower(answer)) THEN 'error'
  WHEN contains(lower(answer), 'purchase') OR contains('purchase', lower(answer)) THEN 'purchase'
  WHEN contains(lower(answer), 'signup') OR contains('signup', lower(answer)) THEN 'signup'
  WHEN contains(lower(answer), 'view') OR contains('view', lower(answer)) THEN 'view' ELSE 'unknown' END AS predicted FROM answers)"""


def matched(t: Tables):
    kind = F.col("event_id") % 5
    answer = (
        F.when(kind == 0, F.concat(F.lit("This is a "), F.upper("event_type"), F.lit(".")))
        .when(kind == 1, "no idea").when(kind == 2, "view or click")
        .when(kind == 3, F.substring("event_type", 1, 3)).otherwise("Error")
    )
    return t.events.select("event_id", "event_type", answer.alias("answer")).withColumn(
        "predicted", C.match_label(F.col("answer"), SENSORS)
    )


@query(
    "prj_match_label",
    f"""WITH {MATCHED} SELECT event_type, predicted, CAST(count(*) AS BIGINT) AS n,
    CAST(sum(CASE WHEN event_type = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM matched GROUP BY 1, 2""",
)
def prj_match_label(t: Tables):
    return matched(t).groupBy("event_type", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == F.col("predicted"), 1)).alias("n_right")
    )


@query("flt_label", "SELECT l_returnflag, l_quantity FROM lineitem WHERE l_returnflag <> 'N' OR l_linestatus = 'F'")
def flt_label(t: Tables):
    return t.lineitem.filter("l_returnflag <> 'N' OR l_linestatus = 'F'").select("l_returnflag", "l_quantity")


@query(
    "flt_presence",
    f"""WITH {BUCKETED} SELECT series, sensor, bucket, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean
    FROM bucketed GROUP BY 1, 2, 3 HAVING count(value) >= 8""",
)
def flt_presence(t: Tables):
    return (
        t.bucketed.groupBy("series", "sensor", "bucket")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean")).filter("n >= 8")
        .select("series", "sensor", "bucket", "n", r("mean"))
    )


@query(
    "flt_status_band",
    """SELECT user_id, round(rec, 6) AS recall, CASE WHEN rec > 0.85 THEN 'good' WHEN rec > 0.60 THEN 'fair' ELSE 'poor' END AS band
    FROM (SELECT user_id, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS rec FROM events GROUP BY 1)""",
)
def flt_status_band(t: Tables):
    per = t.events.groupBy("user_id").agg(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)).alias("recall"))
    return per.select("user_id", r("recall"), C.recall_band(F.col("recall")).alias("band"))
