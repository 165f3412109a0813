import json

from pyspark.sql import functions as F

from sparrowmill.operators import runner, splits
from sparrowmill.operators.questions import canonical
from sparrowmill.plans import catalogue
from sparrowmill.sources import files
from sparrowmill.streaming.resume import answer_stream

from .conftest import SMALL


def test_records_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    made = catalogue._mock(spark, SMALL).where("model = 'quill-7b'")
    records = runner.records(made, is_mock=True)
    files.append_records(records, folder)
    (tmp_path / "out" / "blank.jsonl").write_text("\n\n")
    back = files.read_records(spark, folder)
    assert back.count() == records.count()
    assert back.where("pred IS NULL").count() == records.where("pred IS NULL").count() > 0
    line = next(p for p in (tmp_path / "out").rglob("*.json")).read_text().splitlines()[0]
    assert "pred" in json.loads(line) and files.done_ids(spark, folder).count() == records.select("id").distinct().count()
    assert runner.todo(made, back).count() == 0
    assert files.read_records(spark, str(tmp_path / "none")).count() == 0


def test_errors_are_not_retried_unless_asked(spark):
    work = spark.createDataFrame([("m", "d", "s", "1"), ("m", "d", "s", "2")], "model string, dataset string, split string, id string")
    done = work.where("id = '1'").withColumn("raw_response", F.lit("__ERROR__ x"))
    assert [r["id"] for r in runner.todo(work, done).collect()] == ["2"]
    assert runner.todo(work, done, retry_errors=True).count() == 2
    assert runner.todo(work, done, limit=1).count() == 0  # the limit counts finished rows


def test_manifest_round_trip(spark, tmp_path):
    b = catalogue.base(spark, SMALL)
    table = splits.manifest(b)
    path = str(tmp_path / "manifest.json")
    files.write_manifest(table, path, {"note": "x"})
    back = files.read_manifest(spark, path)
    key = lambda df: sorted((r["dataset"], r["piece"], r["n"], r["sha"]) for r in df.collect())
    assert key(back) == key(table)
    frozen = catalogue.frozen_splits(spark, SMALL)
    assert files.verify_manifest(spark, path, frozen).where("NOT rows_match OR NOT sha_match").count() == 0
    wrong = frozen.limit(5)
    assert files.verify_manifest(spark, path, wrong).where("NOT rows_match").count() > 0


def test_splits_and_files(spark, tmp_path):
    b = canonical(spark.read.parquet(f"{SMALL}/questions.parquet"))
    folder = str(tmp_path / "splits")
    files.write_splits(b.where("split IS NOT NULL"), folder)
    assert spark.read.parquet(folder).where("dataset = 'arc'").count() == b.where("dataset = 'arc' AND split IS NOT NULL").count()
    try:
        files.write_splits(b, folder)
        raise AssertionError("existing splits were overwritten")
    except Exception as e:
        assert "already exists" in str(e).lower()
    data = str(tmp_path / "data")
    b.limit(3).write.parquet(f"{data}/arc/arc_train.parquet")
    b.limit(2).drop("answerKey").write.parquet(f"{data}/arc/arc_test.parquet")
    report = {r["file"]: r["status"] for r in files.verify_files(spark, data, {"arc": ["arc_train.parquet", "arc_test.parquet", "gone.parquet"]}).collect()}
    assert report == {"arc_train.parquet": "ok", "arc_test.parquet": "schema", "gone.parquet": "missing"}
    unified = files.read_unified(spark, {"arc": [f"{data}/arc/arc_train.parquet", f"{data}/arc/arc_test.parquet"]})
    assert {r["split"]: r["count"] for r in unified.groupBy("split").count().collect()} == {"train": 3, "test": 2}
    assert files.read_first(spark, f"{data}/nowhere", f"{data}/arc/arc_train.parquet").count() == 3
    assert files.remove_orphans(spark, f"{data}/arc", {"arc_train.parquet"}) == ["arc_test.parquet"]
    assert files.record_file("Quill 7B", "arc", "test") == "quill_7b__arc__test.jsonl"
    files.write_table(b.groupBy("dataset").count(), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == b.select("dataset").distinct().count()


def test_stream_answers_each_question_once(spark, tmp_path):
    models = spark.read.parquet(f"{SMALL}/model_registry.parquet").limit(2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    some = canonical(spark.read.parquet(f"{SMALL}/questions.parquet")).where("split = 'test'").limit(10)
    some.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(some.schema).parquet(source)
        answer_stream(spark, stream, models, out, str(tmp_path / "state")).awaitTermination()
    # Delivered again, they are known.
    spark.read.parquet(source).write.mode("append").parquet(source)
    answer_stream(spark, spark.readStream.schema(some.schema).parquet(source), models, out, str(tmp_path / "state")).awaitTermination()
    assert files.read_records(spark, out).count() == 20


def test_a_broken_run_goes_on_from_its_last_chunk(spark, tmp_path):
    models = spark.read.parquet(f"{SMALL}/model_registry.parquet").limit(2)
    asked = canonical(spark.read.parquet(f"{SMALL}/questions.parquet")).where("split = 'test'")
    root, calls = str(tmp_path / "out"), []
    work = runner.work_list(asked, models)

    def commit(rows, *key):
        if len(calls) == 3:
            raise RuntimeError("killed")
        files.append_run(rows, root, *key)
        calls.append(key)

    try:
        runner.run(work, runner.mock, commit, True, chunk=5, say=lambda line: None)
        raise AssertionError("the run was not broken off")
    except RuntimeError:
        pass
    kept = files.read_records(spark, root).count()
    assert 0 < kept < work.count()
    left = runner.todo(work, files.read_records(spark, root))
    lines = []
    assert runner.run(left, runner.mock, lambda rows, *key: files.append_run(rows, root, *key), True, chunk=1000, say=lines.append) == work.count() - kept
    back = files.read_records(spark, root)
    assert back.count() == back.select("model", "id").distinct().count() == work.count() and lines
    model, dataset, split = calls[0]
    assert (tmp_path / "out" / files.record_file(model, dataset, split)).exists()


def test_an_interrupt_ends_a_run_behind_a_chunk(spark, tmp_path):
    asked = canonical(spark.read.parquet(f"{SMALL}/questions.parquet")).where("split = 'test'")
    work, seen = runner.work_list(asked, spark.read.parquet(f"{SMALL}/model_registry.parquet").limit(1)), []

    def commit(rows, *key):
        if seen:
            raise KeyboardInterrupt
        seen.append(rows.count())

    lines = []
    assert runner.run(work, runner.mock, commit, True, chunk=1000, say=lines.append) == seen[0]
    assert "interrupted" in lines[-1]


def test_fetch_skips_what_is_there(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / "from" / name / "train.parquet"))
    sources = {n: str(tmp_path / "from" / n) for n in ("a", "b")}
    folder = str(tmp_path / "to")
    assert files.fetch_missing(spark, {"a": sources["a"]}, folder) == ["a"]
    assert files.fetch_missing(spark, sources, folder) == ["b"]
    assert files.fetch_missing(spark, sources, folder) == []
    assert spark.read.parquet(f"{folder}/b/train.parquet").count() == 3
