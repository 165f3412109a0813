import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.operators import metrics, questions as Q, runner, sampling, similarity as S, splits

SCHEMA = "id string, dataset string, split string, question string, choices struct<label: array<string>, text: array<string>>, answerKey string, subject string"


def rows(spark, data):
    full = [(i, d, s, q, (["A", "B"], ["1", "2"]), "A", sub) for i, d, s, q, sub in data]
    return spark.createDataFrame(full, SCHEMA)


strata = st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(subjects=strata, n=st.integers(1, 30))
def test_stratified_sample_has_exact_size(spark, subjects, n):
    df = rows(spark, [(f"q{i:03}", "d", "train", "x", s) for i, s in enumerate(subjects)])
    got = [r["id"] for r in sampling.stratified(df, n).collect()]
    assert len(got) == len(set(got)) == min(n, len(subjects))
    assert sorted(got) == sorted(r["id"] for r in sampling.stratified(df.repartition(3), n).collect())


def test_stratified_sample_keeps_small_strata(spark):
    df = rows(spark, [(f"a{i}", "d", "train", "x", "a") for i in range(50)] + [("b0", "d", "train", "x", "b")])
    assert {r["subject"] for r in sampling.stratified(df, 10).collect()} == {"a", "b"}


def test_group_split_keeps_groups_together(spark):
    df = rows(spark, [(f"q{i}", "d", "test", f"group {i % 7}", None) for i in range(70)])
    pooled = splits.pools(df, test=3).select("question", "pool").distinct().collect()
    assert len(pooled) == 7 and {r["pool"] for r in pooled} == {"train", "test"}
    # A dataset smaller than four times the test size has no train pool.
    assert {r["pool"] for r in splits.pools(df, test=100).collect()} == {"test"}


def test_no_leaks(spark):
    long = "p" * 250
    df = rows(spark, [("a", "d", "train", long + "1", None), ("b", "d", "test", long + "2", None), ("c", "d", "test", "free", None), ("e", "d", "test", long + "1", None)])
    tr, te, candidates = splits.build(df)
    assert [r["id"] for r in te.collect()] == ["c"] and [r["id"] for r in tr.collect()] == ["a"]
    only = splits.disjointness(tr, te).first()
    assert (only["shared_ids"], only["shared_texts"], only["shared_prefixes"]) == (0, 0, 0)


def test_empty_tables(spark):
    none = rows(spark, [])
    tr, te, _ = splits.build(none)
    assert tr.count() == te.count() == splits.manifest(none).count() == 0
    assert Q.validate(none).count() == 0 and sampling.halves(none, ["dataset"]).count() == 0


def test_type_label(spark):
    flags = spark.createDataFrame([(True, False), (None, None), (True, True)], "a boolean, b boolean")
    got = flags.select(Q.type_label({"a": F.col("a"), "b": F.col("b")}, {"a": "x", "b": "y"}).alias("l"))
    assert [r["l"] for r in got.collect()] == ["x", "unspecified", "x+y"]


def test_validate_checks_every_row(spark):
    df = spark.createDataFrame([("1", "d", "train", "q", (["A"], ["1", "2"]), None, None), ("2", "d", "train", None, None, "A", None)], SCHEMA)
    r = Q.validate(df).first()
    assert (r["n"], r["null_question"], r["null_key"], r["null_choices"], r["unequal_choices"]) == (2, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        Q.validate(df.drop("choices"))


def test_quantile_bins_follow_pandas(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4)] + [(None,)], "x double")
    got = sorted(metrics.quantile_bins(df, "x").collect(), key=lambda r: (r["x"] is None, r["x"]))
    # Edges 1, 1.5, 2.75 and 4: the two lowest ones are equal.
    assert [r["bin"] for r in got] == [0, 0, 0, 1, 2, 2, None]


def test_prompt_is_filled_once(spark):
    df = rows(spark, [("1", "d", "test", "what is {options}?", None)])
    text = df.select(runner.prompt(F.col("question"), F.col("choices"))).first()[0]
    assert "what is {options}?" in text and "A) 1\nB) 2" in text


def test_generator_errors_stay_in_their_batch(spark):
    df = rows(spark, [(str(i), "d", "test", "q", None) for i in range(6)]).withColumns({"model": F.lit("m"), "hf_model": F.lit("h"), "prompt": F.col("id")})

    def load():
        def answer(prompts):
            if "3" in prompts:
                raise RuntimeError("boom")
            return [{"raw_response": "FINAL ANSWER: A", "wall_time_s": 0.1, "prompt_tokens": 1, "gen_tokens": 3} for _ in prompts]

        return answer

    made = runner.records(runner.generate(df.coalesce(1), load, batch=2), is_mock=False).collect()
    failed = [r for r in made if r["raw_response"].startswith("__ERROR__")]
    assert len(made) == 6 and len(failed) == 2 and all(r["gen_tokens"] is None and not r["valid"] for r in failed)
    assert all(r["correct"] for r in made if r not in failed)


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "k long, v array<double>")
    got = {r["query"]: r["neighbour"] for r in S.nearest(df, df.where("k % 10 = 0"), "k", "v", block=7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T - 9 * np.eye(60)
    assert got == {i: int(sims[i].argmax()) for i in range(0, 60, 10)}


def test_cohesion_closed_form(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((12, 4))
    df = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(x)], "g int, k long, v array<double>")
    got = {(r["a"], r["b"]): r["cohesion"] for r in S.dense_cohesion(df, "g", "k", "v", 6).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for a in range(3):
        for b in range(3):
            block = s[np.ix_(range(a, 12, 3), range(b, 12, 3))]
            want = (block.sum() - np.trace(block)) / (block.size - len(block)) if a == b else block.mean()
            assert abs(got[a, b] - want) < 1e-5


def test_latent_vectors_are_those_of_the_svd(spark):
    import numpy as np

    from sparrowmill.operators import cluster

    rng = np.random.default_rng(3)
    texts = [(f"d{k}", " ".join(f"term{rng.integers(12)}" for _ in range(8))) for k in range(30)] + [("none", "the of")]
    df = spark.createDataFrame(texts, "id string, question string")
    weights = S.tfidf(df, "id", F.col("question"), []).collect()
    ids, terms = sorted({r["id"] for r in weights}), sorted({r["term"] for r in weights})
    x = np.zeros((len(ids), len(terms)))
    for r in weights:
        x[ids.index(r["id"]), terms.index(r["term"])] = r["w"]
    got = {r["id"]: np.array(r["vector"]) for r in cluster.latent(df, "id", F.col("question"), components=4, passes=12).collect()}
    assert sorted(got) == ids
    y = np.array([got[i] for i in ids])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :4] * s[:4]
    assert np.abs(y @ y.T - want @ want.T).max() < 1e-4
    assert cluster.latent(df.where("id = 'none'"), "id", F.col("question")).count() == 0


def test_numbers_follow_the_order_over_all_parts(spark):
    from sparrowmill.operators import sampling

    rows = [(f"k{n * 7919 % 1000:04}", "a" if n % 3 else None) for n in range(1000)]
    got = sampling.numbered(spark.createDataFrame(rows, "id string, g string"), ["g"], [F.col("id")]).collect()
    for group in ("a", None):
        mine = sorted((r["_rank"], r["id"]) for r in got if r["g"] == group)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and [i for _, i in mine] == sorted(i for _, i in mine)
    assert sampling.numbered(spark.createDataFrame([], "id string, g string"), ["g"], [F.col("id")]).count() == 0


def test_bootstrap_interval(spark):
    from sparrowmill.operators import metrics

    rows = [("d", "m", k < 300) for k in range(400)] + [("d", "none", None), (None, "m", True)]
    got = {r["model"]: r for r in metrics.accuracy_bootstrap(spark.createDataFrame(rows, "dataset string, model string, correct boolean")).collect()}
    assert set(got) == {"m", "none"} and got["none"]["low"] is None
    half = 1.96 * (0.75 * 0.25 / 400) ** 0.5
    assert got["m"]["accuracy"] == 0.75 and abs(got["m"]["low"] - 0.75 + half) < 0.01 and abs(got["m"]["high"] - 0.75 - half) < 0.01


def test_quantiles_by_sketch_are_near_the_exact_ones(spark):
    rows = [("m", "d", "test", f"q{k}", float(k % 997), True, 5, "a b") for k in range(3000)]
    kind = "model string, dataset string, split string, id string, wall_time_s double, correct boolean, gen_tokens int, raw_response string"
    records = spark.createDataFrame(rows, kind).withColumns({"valid": F.lit(True), "strict_format": F.lit(True)})
    exact, near = (metrics.run_metrics_full(records, a).first() for a in (None, 1000))
    assert abs(exact["p50_latency_s"] - near["p50_latency_s"]) < 5 and abs(exact["p95_latency_s"] - near["p95_latency_s"]) < 5
    assert abs(metrics.box_stats(records, accuracy=1000).first()["q1"] - metrics.box_stats(records).first()["q1"]) < 5
