"""Draws, ranks and splits, with groups that hold a large share of all rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from florapark.operators import experiments as E, ranking as K, sampling as S, weights as W
from pyspark.sql import functions as F


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 0 holds a third of the rows."""
    return spark.range(9000).selectExpr("IF(id % 3 = 0, 0, id % 40) AS g", "id", "pmod(hash(id), 1000) / 10.0D AS v").cache()


def test_global_index_is_the_sort_order(spark, skewed):
    rows = [(r["v"], r["id"]) for r in skewed.collect()]
    got = {(r["v"], r["id"]): r["i"] for r in K.global_index(skewed, ["v", "id"], "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(rows))}


def test_top_n_per_group(spark, skewed):
    want = defaultdict(list)
    for r in skewed.collect():
        want[r["g"]].append((r["v"], r["id"]))
    got = defaultdict(list)
    for r in K.top_n_per_group(skewed, ["g"], ["v", "id"], 17).collect():
        got[r["g"]].append((r["v"], r["id"]))
    assert {g: sorted(x) for g, x in got.items()} == {g: sorted(x)[:17] for g, x in want.items()}


def test_running_sum_and_quantiles_in_slices(spark, skewed):
    rows = defaultdict(list)
    for r in skewed.collect():
        rows[r["g"]].append((r["v"], r["id"]))
    got = {(r["g"], r["id"]): r["s"] for r in K.running_sum_in_group(
        skewed, ["g"], F.floor(F.col("v") / 7), ["v", "id"], F.col("v"), "s").collect()}
    for g, vals in rows.items():
        total = 0.0
        for v, i in sorted(vals):
            total += v
            assert math.isclose(got[(g, i)], total, abs_tol=1e-6)
    med = {r["g"]: r["m"] for r in K.group_median(skewed, ["g"], "v", "m").collect()}
    for g, vals in rows.items():
        s = sorted(v for v, _ in vals)
        n = len(s)
        assert math.isclose(med[g], (s[(n - 1) // 2] + s[n // 2]) / 2, abs_tol=1e-9)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    got = sorted((r["k"] or -1, r["v"], r["r"]) for r in K.rank_in_group(df, ["k"], F.lit(0), ["v"], "r", nullable=["k"]).collect())
    assert got == [(-1, 1, 1), (-1, 2, 2), (1, 3, 1)]


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 10, 20)], "v double")
    r = K.quantiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], list("abcde")).first()
    assert [round(x, 9) for x in r] == [1.0, 1.4, 2.0, 16.0, 20.0]


def test_signed_bands_do_not_decrease(spark):
    rng = random.Random(2)
    vals = sorted([rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 4) for _ in range(3000)] + [0.0])
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", K.value_band("v").alias("b"))
    bands = [r["b"] for r in df.orderBy("v").collect()]
    assert bands == sorted(bands)


@pytest.fixture(scope="module")
def plots(spark):
    """30 species from very common to single records, 1,500 locations, some of them empty, five areas."""
    rng = random.Random(4)
    pairs = set()
    for s in range(30):
        for _ in range(max(1, int(900 / (s + 1) ** 1.4))):
            pairs.add((rng.randrange(1400), s))
    presence = spark.createDataFrame(sorted(pairs), "location_id int, species_id int").cache()
    locations = spark.range(1500).selectExpr("CAST(id AS int) AS location_id", "CAST(id % 5 AS int) AS area_code").cache()
    ranges = spark.createDataFrame([(s, a) for s in range(30) for a in range(5) if (s + a) % 3], "species_id int, area_code int").cache()
    return presence, locations, ranges


def test_split_keeps_the_minimum(spark, plots):
    presence, locations, _ = plots
    split = {r["location_id"]: r["split"] for r in S.stratified_split(presence, locations, 0.2, 20, 1).collect()}
    assert len(split) == 1500 and set(split.values()) == {"val", "test"}
    total, test = Counter(), Counter()
    for r in presence.collect():
        total[r["species_id"]] += 1
        test[r["species_id"]] += split[r["location_id"]] == "test"
    assert all(test[s] >= min(20, total[s]) for s in total)
    assert 0.1 < sum(v == "val" for v in split.values()) / 1500 < 0.3


def test_cap_takes_the_smallest_digests(spark, plots):
    presence, locations, ranges = plots
    ok = {(r["species_id"], r["area_code"]) for r in ranges.collect()}
    want = defaultdict(list)
    for r in presence.collect():
        if (r["species_id"], r["location_id"] % 5) in ok:
            want[r["species_id"]].append((md5(6, r["species_id"], r["location_id"]), r["location_id"]))
    want = {(s, loc) for s, v in want.items() for _, loc in sorted(v)[:12]}
    drawn = S.cap_per_species(presence, 12, 6, locations, ranges)
    assert {(r["species_id"], r["location_id"]) for r in drawn.collect()} == want


@pytest.mark.parametrize("model,cap", [("maxent", None), ("logistic", None), ("logistic", 10)])
def test_background_rules(spark, plots, model, cap):
    presence, locations, ranges = plots
    ok = {(r["species_id"], r["area_code"]) for r in ranges.collect()}
    rows = S.presence_background(presence, locations, ranges, model, cap, seed=2).collect()
    assert len({(r["species_id"], r["location_id"]) for r in rows}) == len(rows)
    pos, bg = defaultdict(set), defaultdict(set)
    for r in rows:
        (pos if r["label"] else bg)[r["species_id"]].add(r["location_id"])
    for s in pos:
        assert all((s, loc % 5) in ok for loc in bg[s])
        free = {loc for loc in range(1500) if (s, loc % 5) in ok} - pos[s]
        limit = 10_000 if model == "maxent" else len(pos[s])
        assert len(bg[s]) == (len(free) if len(free) < len(pos[s]) else min(limit, len(free)))
        assert cap is None or len(pos[s]) <= cap


@pytest.mark.parametrize("pool", [3, 40, 333, 10_000])
def test_background_is_the_first_part_of_the_draw(spark, plots, pool):
    """Rows taken by arithmetic on runs are those that ranking the whole draw gives."""
    presence, locations, ranges = plots
    rows = S.presence_background(presence, locations, ranges, "maxent", None, seed=2, pool=pool).collect()
    seen = defaultdict(set)
    for r in presence.collect():
        seen[r["species_id"]].add(r["location_id"])
    demand = spark.createDataFrame([(s, max(pool, len(v)) + len(v)) for s, v in seen.items()], "species_id int, span bigint")
    draw = defaultdict(list)
    for r in S.draw_background(demand, ranges, locations, 2).collect():
        if r["location_id"] not in seen[r["species_id"]]:
            draw[r["species_id"]].append((r["share"], r["area_code"], r["turn"], r["location_id"]))
    want = {(s, x[3]) for s, v in draw.items() for x in sorted(v)[:len(v) if len(v) < len(seen[s]) else pool]}
    assert {(r["species_id"], r["location_id"]) for r in rows if r["label"] == 0} == want


def test_background_rows_are_opened_last(spark, plots):
    plan = S.presence_background(*plots, "maxent", None, seed=2)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    opened = next(i for i, line in enumerate(plan) if "AS slot" in line or "slot#" in line and "Generate" in line)
    assert not any("Join" in line or "Window" in line or "Aggregate" in line for line in plan[:opened])


def test_draw_of_every_area_is_checked_without_rows(spark, sf_dir):
    from florapark.plans.catalog import QUERIES

    plan = QUERIES["p4_background_by_area"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" not in plan


def test_draws_repeat(spark, plots):
    presence, locations, ranges = plots
    a, b = (sorted(map(tuple, S.presence_background(presence, locations, ranges, "logistic", None, seed=2).collect())) for _ in range(2))
    c = sorted(map(tuple, S.presence_background(presence, locations, ranges, "logistic", None, seed=3).collect()))
    assert a == b != c


def test_pairs_change_with_the_epoch(spark):
    rows = spark.range(200).withColumnRenamed("id", "location_id")
    bg = spark.range(37).withColumnRenamed("id", "bg_index")
    one, again, two = (sorted(map(tuple, S.pair_background(rows, bg, e).collect())) for e in (1, 1, 2))
    assert len(one) == 200 and one == again != two


def test_unknown_species_is_an_error(spark, plots):
    presence, locations, ranges = plots
    species = spark.createDataFrame([(1, "a")], "species_id int, species_name string")
    places = locations.selectExpr("*", "0.0D AS lon", "0.0D AS lat")
    with pytest.raises(ValueError, match="unknown species"):
        S.species_points(species, presence, places, ranges, "b")
    assert S.species_points(species, presence, places, ranges, "a").count() > 0


def test_weight_methods(spark):
    df = spark.createDataFrame([(0,), (5,)], "n int")
    got = df.select(*[W.species_weight(F.col("n"), F.lit(1000), m).alias(m) for m in W.METHODS]).collect()
    assert got[0]["inversely_proportional"] == 1000.0 and got[1]["inversely_proportional"] == 200.0
    assert got[1]["inversely_proportional_clipped"] == 20.0 and got[1]["inversely_proportional_not_normalized"] == 0.2
    with pytest.raises(ValueError):
        W.species_weight(F.col("n"), F.lit(1), "cubic")


def test_hyperparameter_ties_and_undefined(spark):
    rows = [(1, 0.5, 0.7), (1, 1.0, 0.7), (1, 2.0, None), (2, 0.5, None), (2, 1.0, float("nan")), (3, 2.0, 0.1), (3, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "species_id int, param double, value double")
    got = {r["species_id"]: r["param"] for r in E.select_hyperparameter(df, (0.5, 1.0, 2.0)).collect()}
    assert got == {1: 0.5, 3: 1.0}


def test_missing_metric_lists_the_available(spark):
    m = spark.createDataFrame([(1, "auroc", 0.5)], "species_id int, metric string, value double")
    s = spark.createDataFrame([(1, "a")], "species_id int, species_name string")
    with pytest.raises(ValueError, match="auroc"):
        E.model_score(m, s, "tss")
