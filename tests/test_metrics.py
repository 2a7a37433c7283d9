"""Scores against brute force on small data, and their edge cases."""

import math
import random

import pytest
from florapark.operators import metrics as M, stratify as K


def pairwise_auroc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def step_auprc(rows):
    p = sum(y for _, y in rows)
    if not p:
        return None
    area = tp = fp = 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        dp = sum(1 for v, y in rows if v == s and y == 1)
        tp, fp = tp + dp, fp + sum(1 for v, y in rows if v == s and y == 0)
        area += dp / p * tp / (tp + fp)
    return area


def gain_curve_auprg(rows):
    """Recall gain and precision gain at every threshold, clipped at recall gain 0, then trapezoids."""
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    if not p or not n:
        return None
    pts, tp, fp = [(0.0, 0.0)], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(1 for v, y in rows if v == s and y == 1)
        fp += sum(1 for v, y in rows if v == s and y == 0)
        pts.append((tp, fp))
    c = p * p / (p + n)
    kept = []
    for (t0, f0), (t1, f1) in zip(pts, pts[1:]):
        if t0 < c <= t1:
            kept.append((c, f0 + (c - t0) / (t1 - t0) * (f1 - f0)))
        if t1 >= c:
            kept.append((t1, f1))
    rg = [1 - (p / n) * (p - t) / t for t, _ in kept]
    pg = [1 - (p / n) * f / t for t, f in kept]
    return sum((rg[i] - rg[i - 1]) * (pg[i] + pg[i - 1]) / 2 for i in range(1, len(rg)))


def close(a, b):
    return (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9)


@pytest.fixture(scope="module")
def random_predictions():
    rng = random.Random(3)
    rows = []
    for species in range(25):
        levels = rng.choice([2, 5, 1000])
        shift = rng.choice([0.0, 0.3])
        squeeze = rng.choice([1.0, 1e-6])
        for loc in range(rng.choice([2, 10, 80])):
            y = rng.choice([0, 1, 1, None]) if species % 2 else int(rng.random() < 0.15)
            s = min(1.0, (rng.randrange(levels) / levels + shift * (y or 0))) * squeeze
            rows.append((species, loc, s, y))
    return rows


def test_scores_equal_brute_force(spark, random_predictions):
    df = spark.createDataFrame(random_predictions, "species_id int, location_id int, probability double, label int")
    got = {r["species_id"]: r for r in M.compute_metrics(df, ("auroc", "auprc", "auprg", "f1")).collect()}
    for species in {r[0] for r in random_predictions}:
        rows = [(s, y) for k, _, s, y in random_predictions if k == species and y is not None]
        if not rows:
            assert species not in got
            continue
        r = got[species]
        assert close(r["auroc"], pairwise_auroc(rows))
        assert close(r["auprc"], step_auprc(rows))
        assert close(r["auprg"], gain_curve_auprg(rows))
        tp = sum(y for s, y in rows if s >= 0.5)
        fp = sum(1 - y for s, y in rows if s >= 0.5)
        fn = sum(y for s, y in rows if s < 0.5)
        assert close(r["f1"], 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None)


def test_edge_species(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0.2, 1), (1, 0.4, 1),  # no negatives
        (2, 0.2, 0), (2, 0.4, 0),  # no positives
        (3, 0.5, 1), (3, 0.5, 0), (3, 0.5, 0),  # all tied
        (4, 0.1, None), (4, 0.9, -1),  # all ignored
        (5, 0.7, 1),  # one row
        (6, nan, 1), (6, inf, 0), (6, 0.9, 1), (6, 0.1, 0),  # unusable scores
        (7, 0.0, 0), (7, 1.0, 1),  # the ends of the scale
    ]
    df = spark.createDataFrame(rows, "species_id int, probability double, label int")
    got = {r["species_id"]: r for r in M.compute_metrics(df, ("auroc", "auprg", "auprc")).collect()}
    assert got[1]["auroc"] is None and got[1]["auprg"] is None and got[1]["auprc"] == 1.0
    assert got[2]["auroc"] is None and got[2]["auprg"] is None and got[2]["auprc"] is None
    assert got[3]["auroc"] == 0.5
    assert 4 not in got
    assert got[5]["auroc"] is None
    assert got[6]["auroc"] == 1.0 and got[6]["n_pos"] == 1
    assert got[7]["auroc"] == 1.0


def test_empty_input(spark):
    df = spark.createDataFrame([], "species_id int, probability double, label int")
    assert M.compute_metrics(df).count() == 0
    assert M.confusion(df).count() == 0


def test_unknown_metric(spark):
    df = spark.createDataFrame([], "species_id int, probability double, label int")
    with pytest.raises(ValueError, match="auroc"):
        M.compute_metrics(df, ("accuracy",))


def test_hot_species_is_split_and_right(spark):
    """One species holds most rows; its running sums come from many bands."""
    df = spark.range(40000).selectExpr(
        "CAST(if(id % 3 = 0, id % 50, 0) AS int) AS species_id", "pmod(hash(id), 100003) / 100003.0D AS probability",
        "CAST(pmod(hash(id, 7), 4) = 0 AS int) AS label")
    rows = [(r["probability"], r["label"]) for r in df.where("species_id = 0").collect()]
    ranks = sorted(rows)
    order, i = {}, 0
    while i < len(ranks):
        j = i
        while j < len(ranks) and ranks[j][0] == ranks[i][0]:
            j += 1
        order[ranks[i][0]] = (i + j + 1) / 2
        i = j
    p = sum(y for _, y in rows)
    want = (sum(order[s] for s, y in rows if y) - p * (p + 1) / 2) / (p * (len(rows) - p))
    got = M.compute_metrics(df, ("auroc",)).where("species_id = 0").first()["auroc"]
    assert math.isclose(got, want, abs_tol=1e-12)


def test_bad_modes(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "species_id int, v double, n_pos int")
    with pytest.raises(ValueError):
        M.average(df, "v", mode="harmonic")
    with pytest.raises(ValueError):
        K.grouped_deltas(df.selectExpr("species_id", "v v1", "v v2"), ["species_id"], "mode")


def test_missing_property_gives_message(spark):
    m = spark.createDataFrame([(1, "auroc", 0.5)], "species_id int, metric string, value double")
    p = spark.createDataFrame([(1, 0.5)], "species_id int, sampling_effort double")
    assert "relative_prevalence" in K.stratified_report(m, p).first()["message"]


def test_strata_ignore_species_without_axes(spark):
    rows = [(i, float(i), float(-i)) for i in range(10)] + [(10, None, 1.0), (11, float("nan"), 1.0), (12, float("inf"), 1.0)]
    p = spark.createDataFrame(rows, "species_id int, sampling_effort double, relative_prevalence double")
    ranks = K.ordinal_ranks(p)
    assert ranks.count() == 10 and ranks.first()["n_species"] == 10


def test_region_counts_follow_the_definition(spark):
    rng = random.Random(1)
    n = 57
    rows = [(i, rng.random(), rng.random()) for i in range(n)]
    p = spark.createDataFrame(rows, "species_id int, sampling_effort double, relative_prevalence double")
    got = {(r["species_id"], r["region"]) for r in K.regions(K.ordinal_ranks(p)).collect()}
    x = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    y = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    m, t = n // 2, n // 10
    want = set()
    for s in range(n):
        a, b = x[s], y[s]
        want.add((s, ("bottom" if b <= m else "top") + "_" + ("left" if a <= m else "right")))
        corner = a <= t and b <= t
        if b <= t and a <= m and not (corner and a < b):
            want.add((s, "L1_bottom_left"))
        if b <= t and a > m:
            want.add((s, "L2_bottom_right"))
        if a <= t and b <= m and not (corner and a >= b):
            want.add((s, "L3_left_lower"))
        if a <= t and b > m:
            want.add((s, "L4_left_upper"))
    assert got == want


def test_engineered_example_has_the_known_signs(spark):
    """A model that helps sparse and infrequent species and hurts dense and frequent ones."""
    noise = "conv(substr(md5(concat_ws(':', '{0}', species_id, location_id)), 1, 8), 16, 10) / 4294967296.0D"
    species = spark.range(300).selectExpr(
        "id AS species_id", "(id % 17 + 0.5D) / 17 AS se", "(id % 19 + 0.5D) / 19 AS rp")
    locations = spark.range(150).selectExpr("id AS location_id", "1 AS k")
    pairs = species.selectExpr("*", "1 AS k").join(locations, "k")
    rows = pairs.selectExpr(
        "species_id", "location_id", f"{noise.format('y')} < 0.3 AS present", f"{noise.format('m')} < 0.2 AS ignored",
        f"{noise.format('a')} AS na", f"{noise.format('b')} AS nb", "0.45D * (1 - se) + 0.45D * (1 - rp) - 0.45D AS gain")
    pred = rows.selectExpr(
        "species_id", "location_id", "IF(ignored, -1, CAST(present AS int)) AS label",
        "na * 0.7D + IF(present, 0.15D, 0D) AS base", "least(1D, greatest(0D, nb * 0.5D + IF(present, 0.15D + gain * 0.5D, 0D))) AS model")
    long = [M.to_long(M.compute_metrics(pred, ("auroc",), score=s), ["auroc"]) for s in ("model", "base")]
    props = species.selectExpr("species_id", "se AS sampling_effort", "rp AS relative_prevalence")
    report = {r["region"]: r["score"] for r in K.stratified_report(long[0], props, reference=long[1]).collect()}
    assert report["bottom_left"] > 0 > report["top_right"]
    assert report["bottom_left"] > report["bottom_right"] > report["top_right"]
    assert report["bottom_left"] > report["top_left"] > report["top_right"]
