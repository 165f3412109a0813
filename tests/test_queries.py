"""Every query of the core against its SQL statement, and the contract of the entry file."""

import pytest

from sparrowmill.plans import catalogue

from .conftest import SMALL

QUERIES, SQL = catalogue.queries(), catalogue.oracles()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SMALL), SQL[name])


def test_queries_without_sql_are_the_iterative_ones():
    assert set(QUERIES) - set(SQL) == {"svd_cohesion", "cluster_quota_sample"}


def test_cluster_quota_sample_has_exact_size(spark):
    rows = QUERIES["cluster_quota_sample"](spark, SMALL).collect()
    base = catalogue.base(spark, SMALL).where("dataset IN ('aqua', 'gsm8k')")
    sizes = {r[0]: min(r[1], catalogue.TEST) for r in base.groupBy("dataset").count().collect()}
    assert len({r["id"] for r in rows}) == len(rows) == sum(sizes.values())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["extract_answers", "run_metrics", "decontaminate", "text_stats"])
def test_plans_have_no_cartesian_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_whole_work_is_listed(spark, oracle, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, done = 1300, 300
    choices = pa.array([{"label": ["A"], "text": ["1"]}] * n, pa.struct([("label", pa.list_(pa.string())), ("text", pa.list_(pa.string()))]))
    text = lambda v: pa.array([v] * n, pa.string())
    ids = [f"q{i:04}" for i in range(n)]
    tables = {
        "questions": pa.table({"id": ids, "dataset": text("d"), "split": text("Train "), "question": text("x"), "choices": choices, "answerKey": text("A"), "subject": text(None)}),
        "model_registry": pa.table({"alias": ["m", "k"], "hf_id": ["h", "i"]}),
        "responses": pa.table({"id": ids[:done], "model": ["m"] * done, "dataset": ["d"] * done, "split": ["train"] * done, "raw_response": ["__ERROR__ x"] * done}),
    }
    for name, rows in tables.items():
        pq.write_table(rows, tmp_path / f"{name}.parquet")
    todo, cost = (QUERIES[q](spark, str(tmp_path)) for q in ("resume_todo", "plan_cost"))
    assert todo.count() == 2 * n - done and cost.first()["calls"] == 2 * n
    oracle(todo, SQL["resume_todo"], str(tmp_path))
    oracle(cost, SQL["plan_cost"], str(tmp_path))


def test_the_limit_counts_finished_rows(spark):
    from sparrowmill.operators import runner

    work = spark.createDataFrame([(m, "d", "s", f"q{i}") for m in "ab" for i in range(5)], "model string, dataset string, split string, id string")
    done = spark.createDataFrame([("a", "d", "s", "q1", "x"), ("a", "d", "s", "q4", "__ERROR__")], "model string, dataset string, split string, id string, raw_response string")
    got = lambda **k: sorted((r["model"], r["id"]) for r in runner.todo(work, done, **k).collect())
    assert got(limit=2) == [("a", "q0"), ("b", "q0"), ("b", "q1")]
    assert len(got()) == 8 and len(got(retry_errors=True)) == 9
    models, asked = spark.createDataFrame([("a",), ("b",)], "alias string"), work.where("model = 'a'")
    assert [runner.plan_cost(asked, models, limit=k).first()["calls"] for k in (2, 9, None)] == [4, 10, 10]
