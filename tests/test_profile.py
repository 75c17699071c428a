import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantframe.operators import cluster, profile, scoring


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    parts = [rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 8)]
    noise = rng.uniform(-20, 20, (6, 3))
    return np.vstack([*parts, noise])


def vectors(spark, points, labels=None):
    rows = [(i, [float(v) for v in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id long, x array<double>, label long")


def test_skew_is_bias_corrected(spark):
    x = pd.Series(np.random.default_rng(1).exponential(size=50))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert profile.skew(df, ["x"], 0.0).first()["skew"] == pytest.approx(x.skew(), rel=1e-9)


def test_chi_square_is_corrected_for_two_by_two(spark):
    table = [("a", "y", 20), ("a", "n", 10), ("b", "y", 8), ("b", "n", 22)]
    df = spark.createDataFrame([(c, l) for c, l, n in table for _ in range(n)], "c string, l string")
    r = profile.chi_square(df, ["c"], "l").first()
    # 60 * (|20*22 - 10*8| - 30)^2 / (30*30*28*32)
    want = 60 * (abs(20 * 22 - 10 * 8) - 30) ** 2 / (30 * 30 * 28 * 32)
    assert (r.chi2, r.dof) == (pytest.approx(want), 1)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(want / 2)))
    assert r.cramers_v == pytest.approx(math.sqrt(want / 60))


@pytest.mark.parametrize("x,dof,p", [(5.991464547, 2, 0.05), (7.814727903, 3, 0.05), (18.30703805, 10, 0.05), (3.841458821, 1, 0.05)])
def test_chi_square_tail(x, dof, p):
    assert profile._chi2_tail(x, dof) == pytest.approx(p, rel=1e-6)


def test_mann_whitney_by_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 40).astype(float), rng.integers(2, 12, 30).astype(float)
    df = spark.createDataFrame([(v, 1) for v in a.tolist()] + [(v, 0) for v in b.tolist()], "x double, y int")
    r = profile.mann_whitney(df, ["x"], F.col("y") == 1).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    _, ties = np.unique(np.concatenate([a, b]), return_counts=True)
    n = 70
    sd = math.sqrt(40 * 30 / 12 * ((n + 1) - (ties**3 - ties).sum() / (n * (n - 1))))
    z = (abs(u - 600) - 0.5) / sd
    assert r.u == u
    assert r.effect == pytest.approx(abs(2 * u / 1200 - 1))
    assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_cronbach_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, None)], "a double, b double")
    got = {r.group: r.alpha for r in profile.cronbach_alpha(df, {"one": ["a"], "two": ["a", "b"]}, F.lit("all")).collect()}
    assert got == {"one": None, "two": 1.0}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("n", float(v)) for v in range(11)], "l string, x double")
    h = {r.bin: r.n for r in profile.histogram(df, ["x"], "l", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_density_clusters_by_brute_force(spark, points):
    eps, least = 1.0, 10
    got = {r.row_id: r.cluster for r in cluster.density_clusters(vectors(spark, points), "x", "row_id", eps, least).collect()}
    d = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps
    core = d.sum(1) >= least
    name = {}
    for i in range(len(points)):
        if core[i] and i not in name:
            stack = [i]
            while stack:
                j = stack.pop()
                if j in name:
                    continue
                name[j] = i
                stack += [k for k in np.flatnonzero(d[j] & core) if k not in name]
    for i in range(len(points)):
        near = np.flatnonzero(d[i] & core)
        want = name[i] if core[i] else name[near[0]] if len(near) else -1
        assert got[i] == want


def test_all_rows_get_the_cluster_of_the_nearest_sample_row(spark, points):
    got = cluster.density_clusters_for_all(vectors(spark, points), "x", "row_id", sample_size=200)
    assert got.filter("row_id < 40").select("cluster").distinct().count() <= 2
    assert got.count() == len(points)


def test_silhouette_by_brute_force(spark, points):
    labels = np.repeat([0, 1, 2, 1], [40, 40, 40, 6])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    s = []
    for i in range(len(points)):
        a = d[i][labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1)
        b = min(d[i][labels == k].mean() for k in set(labels) - {labels[i]})
        s.append((b - a) / max(a, b))
    q = cluster.cluster_quality(vectors(spark, points, labels), "x", "label", "row_id").first()
    assert q.silhouette == pytest.approx(np.mean(s), rel=1e-6)
    one = cluster.cluster_quality(vectors(spark, points, np.zeros(len(points))), "x", "label", "row_id").first()
    assert one.davies_bouldin is None and one.calinski_harabasz is None


def test_agreement_limits(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 5, 0) for i in range(30)], "a int, b int, c int")
    same = cluster.agreement(df, "a", "b").first()
    assert (same.ari, same.nmi) == (pytest.approx(1.0), pytest.approx(1.0))
    none = cluster.agreement(df, "a", "c").first()
    assert (none.ari, none.nmi) == (pytest.approx(0.0), pytest.approx(0.0))


def test_recall_is_consistent_with_the_confusion_counts(spark):
    df = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")], "y string, p string")
    m = {r["class"]: r for r in scoring.class_metrics(df, "y", "p").collect()}
    assert (m["a"].recall, m["a"].precision, m["c"].recall, m["c"].f1) == (0.75, 0.75, 0.0, 0.0)
    assert scoring.overall_metrics(scoring.class_metrics(df, "y", "p")).first()["accuracy"] == pytest.approx(5 / 7)


@pytest.mark.parametrize("x", [0.0, 1.5, 123456.0, 0.00012346, 0.0000123, -2.0, 99999.9, 1e20, 3.14159, 100.0])
def test_general_text(spark, x):
    from plantframe.functions.columns import general

    assert spark.range(1).select(general(F.lit(x), 4).alias("g")).first()["g"] == f"{x:.4g}"


def test_feature_groups_and_labels(spark):
    from plantframe.functions import columns as C

    cols = ["sBytes", "rBytes", "sttl", "duration"]
    assert C.feature_groups(cols, {"bytes": {"suffix": ["Bytes"]}, "s": {"prefix": ["s"]}}, "rest") == {
        "bytes": ["sBytes", "rBytes"], "s": ["sBytes", "sttl"], "rest": ["duration"]
    }
    df = spark.createDataFrame([("It is DDoS!",), ("scan",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(C.match_label(F.col("t"), ["ddos", "ip-scan", "port-scan"])).collect()]
    assert got == ["ddos", "ip-scan", "unknown"]


def test_packet_header(spark):
    from plantframe.operators import packets

    df = spark.createDataFrame([("0001000000060103006B0003FF",), ("0001",), ("",)], "payload_hex string")
    r = packets.decode(df).collect()
    assert (r[0].transaction_id, r[0].protocol_id, r[0].length, r[0].unit_id, r[0].words) == (1, 0, 6, 1, [0x0300, 0x6B00, 0x03FF])
    assert (r[1].transaction_id, r[1].protocol_id, r[1].words) == (1, None, [])
    assert r[2].transaction_id is None


def test_chi2_tail_of_many_degrees():
    assert profile._chi2_tail(2000.0, 2000) == pytest.approx(0.4958, abs=1e-3)
    assert profile._chi2_tail(2100.0, 2001) == pytest.approx(0.0601, abs=2e-3)
    assert 0 < profile._chi2_tail(3000.0, 2000) < 1e-30
    assert profile._chi2_tail(0.0, 4) == 1.0


def test_neighbours_in_blocks_far_from_the_origin(spark, monkeypatch):
    from plantframe.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) + 1e6
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "row_id long, x array<double>, label long")
    sample = df.filter("row_id < 20")
    d = np.sqrt(((x[:, None] - x[None, :20]) ** 2).sum(-1))
    got = {r.row_id: r.knn_distance for r in cluster.neighbour_distance(df, "x", sample, 4).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(np.sort(d, axis=1)[:, 3].tolist(), rel=1e-6)
    names = {r.row_id: r.cluster for r in cluster.nearest_label(df, "x", sample, "label").collect()}
    assert [names[i] for i in range(40)] == [int(j) % 3 for j in d.argmin(1)]


def test_correlation_of_many_columns_in_one_pass(spark):
    """Pairwise-complete against pandas: nulls, NaN, a constant, a column far from zero, one without values."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    x[:, 3], x[:, 4] = 7.1, x[:, 4] * 1e-3 + 1e6
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(12)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    pdf["f5"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), ", ".join(f"f{i} double" for i in range(12))).repartition(5)
    df = df.withColumn("f6", F.coalesce("f6", F.lit(float("nan"))))
    want = pdf.corr(min_periods=2)
    got = {(r.a, r.b): r.r for r in profile.correlation(df, list(pdf.columns)).collect()}
    assert len(got) == 144
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None and (np.isnan(w) or "f3" in (a, b))) or abs(r - w) < 1e-8, (a, b, r, w)


def test_histogram_of_odd_columns(spark):
    """Null labels and values, a constant, a column without values."""
    rows = [("a", 1.0, 5.0, None), ("a", 3.0, 5.0, None), ("a", None, 5.0, None), (None, 2.0, 1.0, None), (None, 2.5, 2.0, None)]
    df = spark.createDataFrame(rows, "y string, u double, v double, w double")
    got = {(r.y, r.feature, r.bin): (r.n, round(r.density, 9)) for r in profile.histogram(df, ["u", "v", "w"], "y", 4).collect()}
    assert got == {
        ("a", "u", 0): (1, 1.0), ("a", "u", 3): (1, 1.0), ("a", "v", 2): (3, 4.0), (None, "u", 0): (1, 4.0), (None, "u", 3): (1, 4.0), (None, "v", 0): (1, 2.0), (None, "v", 3): (1, 2.0),
    }
