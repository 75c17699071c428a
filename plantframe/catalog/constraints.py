"""Rules over windows, specifications as tables, and detection scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, baseline, constraints as con, rolling, scoring, specs
from ..plans import evaluate as ev
from ..session import stage
from .aggregates import (
    FIRED, IDS, SCORES, STREAM_BASE, TAG_BASE, WARM_BUCKETS, big_values, sample_results, sample_violations, tag_base,
    warm_by_buckets, warm_readings,
)
from .base import BUCKET_S, BUCKETED, READINGS, SENSORS, WINDOWS, Tables, query, r
from .joins import OVERLAP_LABEL, SEG, labelled_rows
from .ordered import rolled_sql

KEYS, BASE_KEYS = ["series", "bucket"], ["series"]
SLICE = 86_400

# Readings cubed: jumps then stand out from the usual steps, so that every rule finds something.
CUBED = """readings AS (
  SELECT event_id AS row_id, CAST(user_id % 2 AS VARCHAR) AS series, event_type AS sensor,
         epoch_us(ts) AS t_us, value * value * value / 10000.0::DOUBLE AS value FROM events),
  bucketed AS (SELECT *, (t_us // 21600000000) * 21600 AS bucket FROM readings)"""


def cubed(df):
    return df.withColumn("value", F.col("value") * F.col("value") * F.col("value") / 10000.0)


# A specification over the five sensors: limits and two loops.
TAG_LIMITS = [("click", 0.0, 2700.0), ("error", 0.0, 800.0), ("view", 0.0, 1500.0), ("purchase", 0.000001, 2200.0), ("signup", 0.0, 100000.0)]
SPEC_SQL = """tags(tag, min_val, max_val) AS (VALUES ('click', 0.0::DOUBLE, 2700.0::DOUBLE), ('error', 0, 800), ('view', 0, 1500), ('purchase', 0.000001, 2200), ('signup', 0, 100000)),
  loops(loop_id, sp, pv, cv, lim, inp) AS (VALUES ('L1', 'click', 'view', 'error', true, 'purchase'), ('L2', 'error', 'signup', 'purchase', true, 'click'))"""
STATS = """stats AS (SELECT series, bucket, sensor AS tag, count(value) AS n, min(value) AS lo, max(value) AS hi, var_samp(value) AS var,
    arg_min(value, t_us) AS fst, arg_max(value, t_us) AS lst, max(step) AS max_step
  FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY series, bucket, sensor ORDER BY t_us, row_id)) AS step FROM bucketed) GROUP BY 1, 2, 3)"""
GC = {
    "GC1": "SELECT s.series, s.bucket, 'GC1' AS cid, tag AS what FROM stats s JOIN tags USING (tag) WHERE lo < min_val OR hi > max_val",
    "GC2": "SELECT s.series, s.bucket, 'GC2', loop_id FROM stats s JOIN loops ON cv = tag LEFT JOIN tbase b ON b.series = s.series AND b.tag = s.tag "
    "WHERE lim AND coalesce(max_delta_per_step, 1.0) > 0 AND max_step > 3.0 * coalesce(max_delta_per_step, 1.0)",
    "GC3": "SELECT p.series, p.bucket, 'GC3', loop_id FROM loops JOIN stats p ON p.tag = pv JOIN stats d ON d.tag = sp AND d.series = p.series AND d.bucket = p.bucket "
    "LEFT JOIN tbase bp ON bp.series = p.series AND bp.tag = pv LEFT JOIN tbase bd ON bd.series = p.series AND bd.tag = sp "
    "WHERE sp <> pv AND p.n >= 2 AND d.n >= 2 AND d.hi - d.lo >= 2.0 * coalesce(bd.std, 1e-3) AND p.var < 0.05 * (coalesce(bp.variance, 1e-6) + 1e-12)",
    "GC4": "SELECT p.series, p.bucket, 'GC4', loop_id FROM loops JOIN stats p ON p.tag = pv JOIN stats d ON d.tag = inp AND d.series = p.series AND d.bucket = p.bucket "
    "LEFT JOIN tbase bp ON bp.series = p.series AND bp.tag = pv LEFT JOIN tbase bd ON bd.series = p.series AND bd.tag = inp "
    "WHERE p.n >= 2 AND d.n >= 2 AND abs(d.lst - d.fst) > 3.0 * coalesce(bd.std, 1e-3) + 1e-9 AND p.var < 0.05 * (coalesce(bp.variance, 1e-6) + 1e-12)",
}
HEAD = f"WITH {CUBED}, {TAG_BASE}, {SPEC_SQL}, {STATS}"
ALL_GC = " UNION ALL ".join(GC.values())


def spec_tables(t: Tables):
    tags = t.spark.createDataFrame(
        [("plant", n, lo, hi, "u", "", "manual", 1, "Table 1", n, "manual", 1.0) for n, lo, hi in TAG_LIMITS], specs.TAG_SCHEMA
    )
    loops = t.spark.createDataFrame(
        [
            ("plant", "L1", "click", "view", "error", True, True, ["purchase"], "manual", 1, "F1", "", "manual", 1.0),
            ("plant", "L2", "error", "signup", "purchase", True, True, ["click"], "manual", 2, "F2", "", "manual", 1.0),
        ],
        specs.LOOP_SCHEMA,
    )
    return tags, loops


def stats_and_base(t: Tables):
    return con.window_stats(cubed(t.bucketed), KEYS), tag_base(t, cubed(t.readings))


def _plain(v):
    return v.select(*KEYS, "constraint_id", "constraint_name", "severity", "confidence", "spec_page")


def gc_sql(cid: str, name: str, severity: str, confidence: float, page: str = "1") -> str:
    rule = GC[cid] if cid == "GC1" else "SELECT * FROM (" + GC[cid] + ") q(series, bucket, cid, what)"
    return (
        f"{HEAD} SELECT series, bucket, '{cid}' AS constraint_id, {name} AS constraint_name, '{severity}' AS severity, "
        f"{confidence}::DOUBLE AS confidence, CAST({page} AS INTEGER) AS spec_page FROM ({rule})"
    )


LOOP_PAGE = "CASE what WHEN 'L1' THEN 1 ELSE 2 END"


@query("con_gc1_bounds", gc_sql("GC1", "'saturation-bounds'", "definite", 0.95))
def con_gc1_bounds(t: Tables):
    tags, _ = spec_tables(t)
    return _plain(con.bounds_rule(con.window_stats(cubed(t.bucketed), KEYS), tags, KEYS))


@query("con_gc2_rate", gc_sql("GC2", "'rate-limiter-' || what", "probable", 0.85, LOOP_PAGE))
def con_gc2_rate(t: Tables):
    _, loops = spec_tables(t)
    steps = con.window_steps(cubed(t.bucketed), KEYS, 3600)
    return _plain(con.rate_rule(steps, tag_base(t, cubed(t.readings)), con.rate_limited_loops(loops), KEYS, BASE_KEYS))


@query("con_gc3_tracking", gc_sql("GC3", "'tracking-invariant-' || what", "definite", 0.9, LOOP_PAGE))
def con_gc3_tracking(t: Tables):
    _, loops = spec_tables(t)
    return _plain(con.tracking_rule(*stats_and_base(t), loops, KEYS, BASE_KEYS))


@query(
    "con_gc4_cross_layer",
    gc_sql("GC4", "CASE what WHEN 'L1' THEN 'cross-layer-purchase->view' ELSE 'cross-layer-click->signup' END", "definite", 0.8, LOOP_PAGE),
)
def con_gc4_cross_layer(t: Tables):
    _, loops = spec_tables(t)
    return _plain(con.coupling_rule(*stats_and_base(t), loops, KEYS, BASE_KEYS))


# The process plant's tag names put on the five sensors.
PROCESS_NAMES = {"click": "P2_AutoSD", "error": "P1_PCV01D", "purchase": "P4_ST_PS", "signup": "P1_LIT01", "view": "P2_SIT01"}
NAMES_SQL = "names(sensor, tag) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PROCESS_NAMES.items()) + ")"
PROCESS_LIMITS = "lims(tag, lo_lim, hi_lim) AS (VALUES " + ", ".join(
    f"('{tag}', {lo}::DOUBLE, {hi}::DOUBLE)" for tag, lo, hi, *_ in specs.PROCESS_TAGS if tag in PROCESS_NAMES.values()
) + ")"
PHEAD = f"WITH {CUBED}, {TAG_BASE}, {STATS}, {NAMES_SQL}, {PROCESS_LIMITS}, ps AS (SELECT s.* REPLACE (n.tag AS tag) FROM stats s JOIN names n ON n.sensor = s.tag), " \
    "pb AS (SELECT b.* REPLACE (n.tag AS tag) FROM tbase b JOIN names n ON n.sensor = b.tag)"


def renamed(t: Tables, df):
    names = F.create_map(*[F.lit(x) for pair in PROCESS_NAMES.items() for x in pair])
    return df.withColumn("sensor", F.element_at(names, F.col("sensor")))


def process_parts(t: Tables):
    rows = renamed(t, cubed(t.bucketed))
    return rows, con.window_stats(rows, KEYS), tag_base(t, renamed(t, cubed(t.readings)))


@query(
    "con_hai_c1_bounds",
    f"{PHEAD} SELECT series, bucket, count(*) AS n, 1.0::DOUBLE AS confidence FROM ps JOIN lims USING (tag) WHERE lo < lo_lim OR hi > hi_lim GROUP BY 1, 2",
)
def con_hai_c1_bounds(t: Tables):
    tags, _ = specs.process_spec(t.spark)
    _, stats, _ = process_parts(t)
    return con.bounds_rule(stats, tags, KEYS, "C1", 1.0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query(
    "con_hai_c2_rate",
    f"""{PHEAD} SELECT s.series, s.bucket, count(*) AS n FROM ps s LEFT JOIN pb b ON b.series = s.series AND b.tag = s.tag
    WHERE s.tag IN ('P1_PCV01D', 'P2_AutoSD') AND max_step > 3.0 * coalesce(max_delta_per_step, 1.0) AND coalesce(max_delta_per_step, 1.0) > 0 GROUP BY 1, 2""",
)
def con_hai_c2_rate(t: Tables):
    rows, _, base = process_parts(t)
    steps = con.window_steps(rows.filter(F.col("sensor").isin(specs.RATE_LIMITED)), KEYS, 3600)
    v = con.rate_rule(steps, base, ev.process_rate_tags(t.spark), KEYS, BASE_KEYS, "C2")
    return v.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(
    "con_hai_c3_tracking",
    f"""{PHEAD} SELECT p.series, p.bucket, 'C3' AS constraint_id FROM ps p JOIN ps d ON d.series = p.series AND d.bucket = p.bucket AND d.tag = 'P2_AutoSD'
    JOIN pb b ON b.series = p.series AND b.tag = 'P2_SIT01' WHERE p.tag = 'P2_SIT01' AND p.n >= 2 AND d.n >= 2 AND d.hi - d.lo > 50 AND p.var < 0.05 * (b.variance + 1e-9)""",
)
def con_hai_c3_tracking(t: Tables):
    _, stats, base = process_parts(t)
    v = con.tracking_rule(stats, base, ev.speed_loop(t.spark), KEYS, BASE_KEYS, "C3", 0.95, F.col("sp_range") > ev.SPEED_RAMP, 1e-9)
    return v.select(*KEYS, "constraint_id")


@query(
    "con_hai_c4_coupling",
    f"""{PHEAD} SELECT p.series, p.bucket, 'C4' AS constraint_id FROM ps p JOIN ps d ON d.series = p.series AND d.bucket = p.bucket AND d.tag = 'P4_ST_PS'
    JOIN pb b ON b.series = p.series AND b.tag = 'P2_SIT01' JOIN pb e ON e.series = p.series AND e.tag = 'P4_ST_PS'
    WHERE p.tag = 'P2_SIT01' AND p.n >= 2 AND d.n >= 2 AND abs(d.lst - d.fst) > 3 * e.std + 1e-9 AND p.var < 0.05 * (b.variance + 1e-9)""",
)
def con_hai_c4_coupling(t: Tables):
    _, stats, base = process_parts(t)
    return con.coupling_rule(stats, base, ev.speed_loop(t.spark), KEYS, BASE_KEYS, "C4", 0.80, 1e-9).select(*KEYS, "constraint_id")


# The water plant's registers made of the five sensors.
REG = con.PlantTags()
PLANT_SQL = f"""plant AS (SELECT row_id, series, t_us, bucket, CASE sensor WHEN 'click' THEN 'level' WHEN 'view' THEN CASE WHEN row_id % 2 = 0 THEN 'lmin' ELSE 'lmax' END
      WHEN 'error' THEN 'inv' WHEN 'signup' THEN CASE WHEN row_id % 2 = 0 THEN 'outv' ELSE 'flow' END ELSE 'net' END AS reg,
    CASE sensor WHEN 'click' THEN value WHEN 'view' THEN CASE WHEN row_id % 2 = 0 THEN value / 10 ELSE value + 60 END
      WHEN 'error' THEN (value > 15)::INT::DOUBLE WHEN 'signup' THEN CASE WHEN row_id % 2 = 0 THEN (value > 12)::INT::DOUBLE ELSE value * 1e-6 END ELSE value END AS value FROM bucketed),
  pl AS (SELECT series, bucket, median(value) FILTER (reg = 'lmin') AS llo, median(value) FILTER (reg = 'lmax') AS lhi, min(value) FILTER (reg = 'level') AS vlo, max(value) FILTER (reg = 'level') AS vhi,
      avg(value) FILTER (reg = 'outv') AS om, avg((value > 0.5)::INT) FILTER (reg = 'outv') AS oo, avg(value) FILTER (reg = 'flow') AS fm, avg((abs(value) < 0.00005)::INT) FILTER (reg = 'flow') AS fs,
      coalesce(var_samp(value) FILTER (reg = 'inv'), 0) AS iv, coalesce(var_samp(value) FILTER (reg = 'outv'), 0) AS ov, sum(value) FILTER (reg = 'net') AS net FROM plant GROUP BY 1, 2),
  pout AS (SELECT p.series, p.bucket, avg(coalesce(value < llo OR value > lhi, false)::INT) AS oob FROM plant p JOIN pl ON pl.series = p.series AND pl.bucket = p.bucket WHERE reg = 'level' GROUP BY 1, 2)"""
PLANT_ROWS = """prow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t_us, row_id) AS rn, count(*) OVER (PARTITION BY series) AS nr FROM plant) WHERE rn <= greatest(10, floor(0.15 * nr))),
  pbase AS (SELECT series, var_pop(value) FILTER (reg = 'inv') + 1e-12 AS ib, avg(value) FILTER (reg = 'net') AS nb FROM prow GROUP BY 1)"""
PLANT_HEAD = f"WITH {BUCKETED}, {PLANT_SQL}, {PLANT_ROWS}"


def plant_readings(t: Tables):
    even = F.col("row_id") % 2 == 0
    s, v = F.col("sensor"), F.col("value")
    reg = (
        F.when(s == "click", REG.level).when(s == "view", F.when(even, REG.level_min).otherwise(REG.level_max))
        .when(s == "error", REG.in_valve).when(s == "signup", F.when(even, REG.out_valve).otherwise(REG.flow)).otherwise(REG.traffic)
    )
    value = (
        F.when(s == "click", v).when(s == "view", F.when(even, v / 10).otherwise(v + 60))
        .when(s == "error", (v > 15).cast("int").cast("double"))
        .when(s == "signup", F.when(even, (v > 12).cast("int").cast("double")).otherwise(v * 1e-6)).otherwise(v)
    )
    return t.bucketed.select("row_id", "series", "t_us", "bucket", reg.alias("sensor"), value.alias("value"))


def plant_violations(t: Tables, cid: str):
    rows = plant_readings(t)
    base = tag_base(t, rows)
    windows = con.plant_windows(rows, base, KEYS, BASE_KEYS)
    rules = [x for x in con.plant_constraints() if x.constraint_id == cid]
    return con.apply_constraints(windows, KEYS, rules).select(*KEYS, "constraint_id", "severity", "confidence")


def plant_sql(cid: str, severity: str, confidence: float, where: str) -> str:
    return f"{PLANT_HEAD} SELECT series, bucket, '{cid}' AS constraint_id, '{severity}' AS severity, {confidence}::DOUBLE AS confidence FROM pl JOIN pbase USING (series) WHERE {where}"


@query("con_plant_c1_setpoint", plant_sql("C1", "definite", 1.0, "vhi > lhi OR vlo < llo"))
def con_plant_c1_setpoint(t: Tables):
    return plant_violations(t, "C1")


@query("con_plant_c2_state_flow", plant_sql("C2", "probable", 1.0, "om > 0.8 AND fm < 0.00005"))
def con_plant_c2_state_flow(t: Tables):
    return plant_violations(t, "C2")


@query("con_plant_c3_valve_cycle", plant_sql("C3", "probable", 0.9, "iv < 0.05 * ib"))
def con_plant_c3_valve_cycle(t: Tables):
    return plant_violations(t, "C3")


@query("con_plant_c4_net_valve", plant_sql("C4", "definite", 0.9, "net > 1.8 * nb AND iv < 0.05 * ib"))
def con_plant_c4_net_valve(t: Tables):
    return plant_violations(t, "C4")


STATIC_HEAD = f"""WITH {BUCKETED}, {PLANT_SQL}, nflow AS (SELECT bucket, count(*) AS nf FROM bucketed WHERE value > 150 GROUP BY 1),
  rk AS (SELECT series, bucket, row_number() OVER (PARTITION BY series ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY series) AS nb FROM (SELECT DISTINCT series, bucket FROM bucketed)),
  w5 AS (SELECT series, bucket FROM rk WHERE rn <= greatest(5, floor(0.15 * nb))),
  vb AS (SELECT series, CASE WHEN count(value) FILTER (reg = 'inv') >= 5 THEN coalesce(nullif(var_samp(value) FILTER (reg = 'inv'), 0), 1e-12) END AS ib,
      CASE WHEN count(value) FILTER (reg = 'outv') >= 5 THEN coalesce(nullif(var_samp(value) FILTER (reg = 'outv'), 0), 1e-12) END AS ob FROM plant JOIN w5 USING (series, bucket) GROUP BY 1),
  fb AS (SELECT series, avg(coalesce(nf, 0)) AS flows_base FROM w5 LEFT JOIN nflow USING (bucket) GROUP BY 1),
  st AS (SELECT pl.*, oob, coalesce(nf, 0) AS nf, flows_base, coalesce(ib > 1e-10, false) AS im, coalesce(ob > 1e-10, false) AS omm, coalesce(ib > 1e-10 AND iv < 0.05 * ib, false) AS ifz, coalesce(ob > 1e-10 AND ov < 0.05 * ob, false) AS ofz
    FROM pl JOIN vb USING (series) JOIN fb USING (series) LEFT JOIN pout USING (series, bucket) LEFT JOIN nflow USING (bucket))"""


def static_violations(t: Tables, cid: str):
    rows = plant_readings(t)
    warm = rows.join(baseline.warmup_buckets(rows, ["series"], "bucket", 0.15, 5), KEYS, "left_semi")
    base = baseline.window_baseline(warm).withColumnRenamed("sensor", "tag")
    windows = con.plant_windows(rows, base, KEYS, BASE_KEYS)
    flows = t.bucketed.filter("value > 150").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_flows"))
    counted = align.with_count(windows, flows, ["bucket"], "n_flows")
    usual = align.with_count(warm.select(*KEYS).distinct(), flows, ["bucket"], "n_flows").groupBy("series").agg(F.avg("n_flows").alias("flows_base"))
    rules = [x for x in con.static_constraints() if x.constraint_id == cid]
    return con.apply_constraints(counted.join(usual, "series"), KEYS, rules).select(*KEYS, "constraint_id", "severity")


def static_sql(cid: str, where: str) -> str:
    return f"{STATIC_HEAD} SELECT series, bucket, '{cid}' AS constraint_id, 'definite' AS severity FROM st WHERE {where}"


@query("con_static_c1", static_sql("C1", "lhi > llo AND oob > 0.10"))
def con_static_c1(t: Tables):
    return static_violations(t, "C1")


@query("con_static_c2", static_sql("C2", "oo > 0.6 AND fs > 0.6"))
def con_static_c2(t: Tables):
    return static_violations(t, "C2")


@query("con_static_c3", static_sql("C3", "(ifz OR ofz) AND (NOT im OR ifz) AND (NOT omm OR ofz)"))
def con_static_c3(t: Tables):
    return static_violations(t, "C3")


@query("con_static_c4", static_sql("C4", "nf > 1.8 * greatest(flows_base, 1.0) AND (ifz OR ofz)"))
def con_static_c4(t: Tables):
    return static_violations(t, "C4")


def all_violations(t: Tables):
    tags, loops = spec_tables(t)
    rows = cubed(t.bucketed)
    stats = stage(con.window_stats(rows, KEYS), "windows")
    base = stage(tag_base(t, cubed(t.readings)), "baseline")
    return stats, ev.generic_violations(rows, stats, base, tags, loops, KEYS, BASE_KEYS, 3600)


def all_results(t: Tables):
    stats, found = all_violations(t)
    return con.window_results(stats.select(*KEYS).distinct(), stage(found, "violations"), KEYS, ev.GENERIC)


RESULTS = f"""v AS ({ALL_GC}), res AS (SELECT w.series, w.bucket, count(cid) AS n_viols, count(cid) > 0 AS flagged,
    coalesce(array_to_string(list_sort(list_distinct(list(cid) FILTER (cid IS NOT NULL))), '+'), 'clean') AS flag_reason
    FROM (SELECT DISTINCT series, bucket FROM bucketed) w LEFT JOIN v ON v.series = w.series AND v.bucket = w.bucket GROUP BY 1, 2)"""


@query("con_project", f"{HEAD}, {RESULTS} SELECT series, bucket, n_viols, flagged, flag_reason FROM res")
def con_project(t: Tables):
    return all_results(t).select(*KEYS, "n_viols", "flagged", "flag_reason")


@query(
    "con_select_set",
    f"""SELECT CAST(user_id % 4 AS BIGINT) AS plant, CASE user_id % 4 WHEN 0 THEN 'process' WHEN 1 THEN 'water' WHEN 2 THEN 'generic' ELSE 'generic' END AS rules,
    CASE user_id % 4 WHEN 0 THEN 'named process' WHEN 1 THEN 'named water' WHEN 2 THEN '{REG.traffic} is missing' ELSE 'no rules of its own' END AS reason, count(*) AS n_rows FROM events GROUP BY 1, 2, 3""",
)
def con_select_set(t: Tables):
    counts = t.events.groupBy((F.col("user_id") % 4).alias("plant")).agg(F.count(F.lit(1)).alias("n_rows"))
    chosen = [ev.choose_rules(*c) for c in (("process-plant", []), ("water-plant", [REG.traffic]), ("water-plant", SENSORS), ("other", SENSORS))]
    of = [F.get(F.array(*[F.lit(c[i]) for c in chosen]), F.col("plant").cast("int")) for i in (0, 1)]
    return counts.select("plant", of[0].alias("rules"), of[1].alias("reason"), "n_rows")


TRUTH = """truth AS (SELECT series, bucket, bool_or(sensor = 'error' AND value > 337.5) AS truth FROM bucketed GROUP BY 1, 2)"""


def truth_windows(t: Tables):
    return ev.window_truth(cubed(t.bucketed).withColumn("attack", (F.col("sensor") == "error") & (F.col("value") > 337.5)), KEYS)


@query("con_window_truth", f"WITH {CUBED}, {TRUTH} SELECT * FROM truth")
def con_window_truth(t: Tables):
    return truth_windows(t)


def event_sql(keys: str, buffer: int) -> str:
    """Event scores in SQL over ``lab(keys, ord, truth, flagged)``."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"p.{c} = t.{c}" for c in k)
    seg = lambda flag: (
        f"(SELECT {keys}, min(ord) AS s, max(ord) AS e FROM (SELECT {keys}, ord, ord - row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS g "
        f"FROM lab WHERE {flag}) GROUP BY {keys}, g)"
    )
    return f"""ts AS {seg('truth')}, fs AS {seg('flagged')},
    tn AS (SELECT {keys}, count(*) AS n, sum(EXISTS (SELECT 1 FROM fs p WHERE {on} AND p.e >= greatest(0, t.s - {buffer}) AND p.s <= t.e)::INT) AS hit FROM ts t GROUP BY {keys}),
    fn AS (SELECT {keys}, count(*) AS n, sum(EXISTS (SELECT 1 FROM ts p WHERE {on} AND t.e >= greatest(0, p.s - {buffer}) AND t.s <= p.e + {buffer})::INT) AS hit FROM fs t GROUP BY {keys}),
    pt AS (SELECT {keys}, count(*) FILTER (truth AND flagged)::DOUBLE AS tp, count(*) FILTER (flagged)::DOUBLE AS pp, count(*) FILTER (truth)::DOUBLE AS tt FROM lab GROUP BY {keys}),
    ev AS (SELECT {keys}, coalesce(tn.n, 0) AS n_true_events, coalesce(fn.n, 0) AS n_pred_clusters, coalesce(fn.hit / fn.n::DOUBLE, 1.0) AS etap, coalesce(tn.hit / tn.n::DOUBLE, 1.0) AS etar,
      coalesce(tp / nullif(pp, 0), 0) AS sp, coalesce(tp / nullif(tt, 0), 0) AS sr FROM pt LEFT JOIN tn USING ({keys}) LEFT JOIN fn USING ({keys})),
    rep AS (SELECT *, CASE WHEN etap + etar > 0 THEN 2 * etap * etar / (etap + etar) ELSE 0 END AS ef, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0 END AS sf FROM ev)"""


REPORT_COLS = """n_true_events, n_pred_clusters, round(sp, 4) AS std_precision, round(sr, 4) AS std_recall, round(sf, 4) AS std_f1,
  round(etap, 4) AS etap, round(etar, 4) AS etar, round(ef, 4) AS etapr_f1"""


@query(
    "con_per_rule_report",
    f"""WITH {BUCKETED}, {FIRED}, lab AS (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY bucket) - 1 AS ord, list_contains(coalesce(ids, []), rule) AS flagged, tr AS truth
      FROM fired JOIN (SELECT bucket, bool_or(sensor = 'error' AND value > 150) AS tr FROM bucketed GROUP BY 1) USING (bucket), (VALUES ('C1'), ('C2'), ('C3')) r(rule)),
    {event_sql('rule', 2)} SELECT rule, {REPORT_COLS} FROM rep""",
)
def con_per_rule_report(t: Tables):
    attack = (F.col("sensor") == "error") & (F.col("value") > 150)
    truth = ev.window_truth(t.bucketed.withColumn("attack", attack), ["bucket"])
    windows = sample_results(t).join(truth, "bucket").select("bucket", "ids", "truth", F.lit("all").alias("series"), (F.col("bucket") * C.MICROS).alias("t_us"))
    return ev.rule_report(stage(windows, "results"), list(IDS), 30 * 86400, 2).drop("series", "buffer_steps")


def evaluation(t: Tables):
    """The whole evaluation over the cubed readings, learnt from the warm-up part, by the rules that the name asks for."""
    tags, loops = spec_tables(t)
    rows = cubed(t.readings)
    labelled = rows.withColumn("attack", (F.col("sensor") == "error") & (F.col("value") > 337.5))
    return ev.evaluate(labelled, tags, loops, "plant", BUCKET_S, buffer_steps=2, slice_s=SLICE, train=baseline.warmup_rows(rows, ["series"], 0.15, SLICE))


@query(
    "con_evaluate",
    f"""{HEAD}, {RESULTS}, {TRUTH}, lab AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY bucket) - 1 AS ord, truth, flagged FROM res JOIN truth USING (series, bucket)),
    {event_sql('series', 2)} SELECT series, 'generic' AS rules, 'no rules of its own' AS reason, (SELECT count(*) FROM v) AS n_violations, {REPORT_COLS} FROM rep""",
)
def con_evaluate(t: Tables):
    e = evaluation(t)
    found = e.violations.agg(F.count(F.lit(1)).alias("n_violations"))
    report = e.report.drop("buffer_steps").withColumn("_n", C.one_value(found))
    return report.select("*", F.lit(e.rules).alias("rules"), F.lit(e.reason).alias("reason"), F.col("_n.n_violations").alias("n_violations")).drop("_n")


@query(
    "con_evaluate_rules",
    f"""{HEAD}, {RESULTS}, {TRUTH}, fired AS (SELECT DISTINCT series, bucket, cid AS rule FROM v),
    lab AS (SELECT w.series, r.rule, row_number() OVER (PARTITION BY w.series, r.rule ORDER BY w.bucket) - 1 AS ord, truth, f.rule IS NOT NULL AS flagged
      FROM res w JOIN truth USING (series, bucket) CROSS JOIN (VALUES ('GC1'), ('GC2'), ('GC3'), ('GC4')) r(rule) LEFT JOIN fired f ON f.series = w.series AND f.bucket = w.bucket AND f.rule = r.rule),
    {event_sql('series, rule', 2)} SELECT series, rule, {REPORT_COLS} FROM rep""",
)
def con_evaluate_rules(t: Tables):
    return evaluation(t).per_rule.drop("buffer_steps")


def with_evidence(rule: str, evidence: str) -> str:
    head, tail = rule.split(" FROM ", 1)
    return f"{head}, {evidence} FROM {tail}"


EVIDENCE = " UNION ALL ".join(
    [
        with_evidence(GC["GC1"].replace(" AS cid", "").replace(" AS what", ""), "printf('%s: [%.3g, %.3g] u outside spec [%.6g, %.6g] u', tag, lo, hi, min_val, max_val)"),
        with_evidence(GC["GC2"], "printf('%s step=%.4g vs limit %.4g', s.tag, max_step, 3.0 * coalesce(max_delta_per_step, 1.0))"),
        with_evidence(GC["GC3"], "printf('%s range=%.3g but %s var=%.3g (warm-up %.3g)', sp, d.hi - d.lo, pv, p.var, coalesce(bp.variance, 1e-6))"),
        with_evidence(GC["GC4"], "printf('%s change=%.3g but %s var=%.3g', inp, abs(d.lst - d.fst), pv, p.var)"),
    ]
)


@query(
    "con_evidence",
    f"{HEAD}, e(series, bucket, constraint_id, what, evidence) AS ({EVIDENCE}) SELECT series, bucket, constraint_id, evidence FROM e",
)
def con_evidence(t: Tables):
    _, found = all_violations(t)
    return found.select(*KEYS, "constraint_id", "evidence")


# ---- specifications as tables ----------------------------------------------------------------

BIG_SPECS = """bt AS (SELECT 'spec-' || CAST(l_suppkey % 50 AS VARCHAR) AS spec_name, 'T' || CAST(l_linenumber AS VARCHAR) AS tag, min(l_extendedprice) AS min_val,
      CASE WHEN l_linenumber = 1 THEN min(l_extendedprice) WHEN l_linenumber = 2 THEN max(l_extendedprice) + 1e6 ELSE max(l_extendedprice) END AS max_val,
      CASE WHEN l_linenumber % 3 = 0 THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM lineitem GROUP BY l_suppkey % 50, l_linenumber),
  bl AS (SELECT 'spec-' || CAST(l_suppkey % 50 AS VARCHAR) AS spec_name, 'L-' || l_returnflag AS loop_id, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.75 END::DOUBLE AS confidence FROM lineitem GROUP BY l_suppkey % 50, l_returnflag),
  rv AS (SELECT spec_name, 'tag' AS kind, tag AS item FROM bt WHERE CAST(substr(spec_name, 6) AS INT) % 3 = 0 OR (CAST(substr(spec_name, 6) AS INT) % 3 = 1 AND tag = 'T1')
    UNION ALL SELECT spec_name, 'loop', loop_id FROM bl WHERE CAST(substr(spec_name, 6) AS INT) % 3 = 0),
  it AS (SELECT spec_name, 'tag' AS kind, tag AS item, confidence FROM bt UNION ALL SELECT spec_name, 'loop', loop_id, confidence FROM bl),
  stt AS (SELECT spec_name, count(*) AS n_items, count(r.item) AS n_reviewed FROM it i LEFT JOIN rv r USING (spec_name, kind, item) GROUP BY 1),
  st2 AS (SELECT *, round(0.85 + 0.15 * n_reviewed / n_items, 3) AS conf, CASE WHEN n_reviewed = n_items THEN 'approved' WHEN n_reviewed > 0 THEN 'reviewed' ELSE 'pending' END AS status FROM stt)"""


def big_specs(t: Tables):
    """Fifty specifications taken from the line items, with some of their items reviewed."""
    li = t.lineitem
    number = F.col("l_suppkey") % 50
    name = F.concat(F.lit("spec-"), number.cast("string"))
    n = F.col("l_linenumber")
    top = F.max("l_extendedprice")
    tags = li.groupBy(number.alias("no"), "l_linenumber").agg(F.min("l_extendedprice").alias("min_val"), top.alias("top")).select(
        F.concat(F.lit("spec-"), F.col("no").cast("string")).alias("spec_name"), F.concat(F.lit("T"), n.cast("string")).alias("tag"), "min_val",
        F.when(n == 1, F.col("min_val")).when(n == 2, F.col("top") + 1e6).otherwise(F.col("top")).alias("max_val"),
        F.when(n % 3 == 0, 1.0).otherwise(0.85).alias("confidence"), "no",
    )
    loops = li.select(name.alias("spec_name"), number.alias("no"), F.concat(F.lit("L-"), "l_returnflag").alias("loop_id")).distinct().withColumn(
        "confidence", F.when(F.col("loop_id") == "L-N", 1.0).otherwise(0.75)
    )
    done = tags.filter("no % 3 = 0 OR (no % 3 = 1 AND tag = 'T1')").select("spec_name", F.lit("tag").alias("kind"), F.col("tag").alias("item"))
    reviews = done.unionByName(loops.filter("no % 3 = 0").select("spec_name", F.lit("loop").alias("kind"), F.col("loop_id").alias("item")))
    return tags.drop("no"), loops.drop("no"), reviews


@query(
    "spec_review",
    f"""WITH {BIG_SPECS} SELECT spec_name, kind, item, 'review' AS reason FROM it ANTI JOIN rv USING (spec_name, kind, item) WHERE confidence < 1
    UNION ALL SELECT spec_name, 'tag', tag, 'bounds' FROM bt WHERE max_val - min_val <= 0 OR max_val - min_val > 1e6""",
)
def spec_review(t: Tables):
    tags, loops, reviews = big_specs(t)
    todo = specs.to_review(tags, loops, reviews).select("spec_name", "kind", "item", F.lit("review").alias("reason"))
    odd = specs.suspicious_bounds(tags).select("spec_name", F.lit("tag").alias("kind"), F.col("tag").alias("item"), F.lit("bounds").alias("reason"))
    return todo.unionByName(odd)


@query(
    "spec_approve",
    f"""WITH {BIG_SPECS} SELECT st2.spec_name, n_items, n_reviewed, conf AS confidence, status, round(m, 6) AS mean_tag_confidence FROM st2 JOIN (
      SELECT spec_name, avg(CASE WHEN r.item IS NOT NULL THEN 1.0 ELSE confidence END) AS m FROM bt LEFT JOIN (SELECT * FROM rv WHERE kind = 'tag') r ON r.spec_name = bt.spec_name AND r.item = bt.tag GROUP BY bt.spec_name) q USING (spec_name)""".replace("SELECT spec_name, avg(CASE", "SELECT bt.spec_name, avg(CASE"),
)
def spec_approve(t: Tables):
    tags, loops, reviews = big_specs(t)
    lifted, _, status = specs.approve(tags, loops, reviews)
    mean = lifted.groupBy("spec_name").agg(F.avg("confidence").alias("mean_tag_confidence"))
    return status.join(mean, "spec_name").select("spec_name", "n_items", "n_reviewed", "confidence", "status", r("mean_tag_confidence"))


@query(
    "spec_inventory",
    f"""WITH {BIG_SPECS} SELECT spec_name, count(*) FILTER (kind = 'tag') AS n_tags, count(*) FILTER (kind = 'loop') AS n_loops, any_value(conf) AS confidence, any_value(status) AS status
    FROM it JOIN st2 USING (spec_name) GROUP BY 1""",
)
def spec_inventory(t: Tables):
    tags, loops, reviews = big_specs(t)
    _, _, status = specs.approve(tags, loops, reviews)
    return specs.inventory(tags, loops, status)


# ---- scores ----------------------------------------------------------------------------------

EVENT_LAB = "lab AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, event_type = 'error' AS truth, value > 60 AS flagged FROM events)"


@query(
    "met_etapr",
    f"WITH {EVENT_LAB}, {event_sql('k', 2)} SELECT k, n_true_events, n_pred_clusters, round(etap, 6) AS etap, round(etar, 6) AS etar, round(ef, 6) AS etapr_f1 FROM rep",
)
def met_etapr(t: Tables):
    s = scoring.event_scores(labelled_rows(t), ["k"], "t_us", "event_id", 2, 86400)
    return s.select("k", "n_true_events", "n_pred_clusters", r("etap"), r("etar"), r("etapr_f1"))


@query("met_etapr_report", f"WITH {EVENT_LAB}, {event_sql('k', 1)} SELECT k, {REPORT_COLS}, 1 AS buffer_steps FROM rep")
def met_etapr_report(t: Tables):
    return scoring.event_report(labelled_rows(t), ["k"], "t_us", "event_id", 86400, buffer_steps=1)


@query(
    "met_attack_window_scores",
    f"""WITH {WINDOWS} SELECT win_id, attack, round((end_us - start_us) / 1e6, 1) AS duration_s, count(t_us) > 0 AS detected, count(t_us) AS n_alerts, round((min(t_us) - start_us) / 1e6, 2) AS latency_s,
      coalesce(array_to_string(list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))), ', '), '') AS alert_types
    FROM windows LEFT JOIN (SELECT t_us, CASE WHEN value > 160 THEN 'z_score_spike' ELSE 'variance_collapse' END AS kind FROM readings WHERE value > 120) ON t_us BETWEEN start_us AND end_us GROUP BY 1, 2, start_us, end_us""",
)
def met_attack_window_scores(t: Tables):
    s = rolling.score_windows(t.windows, ["win_id"], big_values(t), 6 * 3600)
    return s.select("win_id", "attack", "duration_s", "detected", "n_alerts", "latency_s", "alert_types")


@query(
    "met_window_fpr",
    f"""{HEAD}, {RESULTS}, {TRUTH} SELECT count(*) FILTER (NOT truth) AS n_normal, count(*) FILTER (NOT truth AND flagged) AS n_flagged,
    round(count(*) FILTER (NOT truth AND flagged) / count(*) FILTER (NOT truth)::DOUBLE, 6) AS window_fpr FROM res JOIN truth USING (series, bucket)""",
)
def met_window_fpr(t: Tables):
    w = all_results(t).join(truth_windows(t), KEYS)
    return scoring.window_false_positives(w).select("n_normal", "n_flagged", r("window_fpr"))


DETECT = f"""WITH RECURSIVE {WINDOWS}, {STREAM_BASE}, {rolled_sql(7200)},
  c0 AS (SELECT r.series, r.sensor, r.t_us, r.row_id, u.kind FROM rolled r JOIN base b ON b.series = r.series AND b.sensor = r.sensor, (VALUES ('z_score_spike'), ('variance_collapse')) u(kind)
    WHERE n_window >= 3 AND b.std >= 1e-5 AND CASE kind WHEN 'z_score_spike' THEN abs((value - mean) / std) >= 3.5 ELSE rolling_var < 0.05 * variance AND variance > 1e-8 END),
  cn AS (SELECT *, min(t_us) OVER (PARTITION BY series, sensor, kind ORDER BY t_us RANGE BETWEEN 3600000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM c0),
  kp AS (SELECT series, sensor, kind, min(t_us) AS t_us FROM c0 GROUP BY 1, 2, 3 UNION ALL
    SELECT k.series, k.sensor, k.kind, n.nt FROM kp k JOIN cn n ON n.series = k.series AND n.sensor = k.sensor AND n.kind = k.kind AND n.t_us = k.t_us WHERE n.nt IS NOT NULL),
  al AS (SELECT c.row_id, c.series, c.sensor, c.t_us, CASE WHEN c.kind = 'variance_collapse' AND count(*) FILTER (c.kind = 'variance_collapse') OVER (PARTITION BY c.series ORDER BY c.t_us RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING) >= 3
      THEN 'cross_layer' ELSE c.kind END AS alert_type FROM kp JOIN c0 c ON c.series = kp.series AND c.sensor = kp.sensor AND c.kind = kp.kind AND c.t_us = kp.t_us)"""


@query("det_alerts", f"{DETECT} SELECT row_id, series, sensor, alert_type FROM al")
def det_alerts(t: Tables):
    base = baseline.detector_baseline(warm_readings(t))
    alerts = rolling.detect(t.readings, base, ("series", "sensor"), 7200, 3600, 21600, 6 * 86400)
    return alerts.select("row_id", "series", "sensor", "alert_type")
