import numpy as np
import pytest
from florapark.llm import mixing as m
from texts import SCHEMA, corpus, empty, odd


def weighed(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.4, 0.4], n)
    tokens = rng.integers(1, 500, n)
    return p, tokens, spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))],
                                            "doc_id long, tokens long, posterior array<double>")


@pytest.mark.parametrize("goal,most", [([0.6, 0.3, 0.1], None), ([0.9, 0.05, 0.05], None), ([0.2, 0.2, 0.1], 1.0)])
def test_totals_reach_the_targets(spark, goal, most):
    p, tokens, df = weighed(spark)
    target = np.array(goal) * tokens.sum()
    steps, momentum, reached = m.fit_rates(df, target.tolist(), most)
    rate = np.array([r["rate"] for r in m.with_rates(df, steps, momentum, most).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and (most is None or (rate <= most).all())
    assert np.allclose((tokens * rate) @ p, reached)
    assert np.abs(reached - target).max() <= 2e-3 * target.sum()


def test_unreachable_targets_end_at_the_least_squares_solution(spark):
    p, tokens, df = weighed(spark, 120)
    target = np.array([1.0, 0.05, 0.05]) * tokens.sum()
    _, _, reached = m.fit_rates(df, target.tolist(), 1.0, rounds=200)
    rate = np.ones(len(p))  # plain projected gradient in place
    for _ in range(20_000):
        rate = np.clip(rate - p @ ((tokens * rate) @ p - target) / tokens.sum(), 0, 1)
    assert np.abs(reached - (tokens * rate) @ p).max() <= 5e-3 * target.sum()


def test_domains_are_learned_from_labels(spark):
    rows = corpus(400, seed=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]] + [(None, "en"), (1, None)], "doc_id long, domain string")
    model = m.fit_domains(docs, labels, shards=2)
    assert model.domains == ["de", "en", "fr"]
    right = n = 0
    for r in m.posteriors(docs, model).collect():
        text, lang = rows[r["doc_id"]][1], rows[r["doc_id"]][2]
        assert r["tokens"] == len(text.split()) and abs(sum(r["posterior"]) - 1) < 1e-9
        if r["doc_id"] >= 300 and r["tokens"] > 10:
            n += 1
            right += model.domains[int(np.argmax(r["posterior"]))] == lang
    assert right / n > 0.95


def test_copies_meet_the_rates(spark):
    rows = corpus(300, seed=6)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, domain string")
    out = m.mix(docs, m.fit_domains(docs, labels, shards=2), {"en": 0.6, "de": 0.2, "fr": 0.2}).collect()
    total = sum(r["tokens"] for r in out)
    assert abs(sum(r["rate"] * r["tokens"] for r in out) - total) < 0.01 * total
    assert all(np.floor(r["rate"]) <= r["copies"] <= np.ceil(r["rate"]) for r in out)


def test_odd_rows_and_empty_tables(spark):
    none = m.fit_domains(empty(spark), spark.createDataFrame([], "doc_id long, domain string"))
    out = m.mix(odd(spark), none, {"all": 1.0}).collect()
    assert len(out) == 11 and all(abs(r["rate"] - 1) < 0.01 for r in out)
    assert m.mix(empty(spark), none, {"all": 1.0}).count() == 0


def test_stage_keeps_the_clean(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    out = m.stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    clean = docs.join(labels, "doc_id").count()
    assert out.join(labels, "doc_id").count() >= 0.98 * clean
