"""Reading and writing question tables, records and manifests."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import infer_split, slug
from ..schemas import QUESTION, RECORD, REQUIRED


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_questions(spark: SparkSession, path: str, schema: T.StructType = QUESTION) -> DataFrame:
    """Parquet files with a declared schema; missing optional columns are null."""
    return spark.read.schema(schema).parquet(path)


def read_unified(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """The union of all files of all datasets; the split comes from each file's (or table folder's) name."""
    frames = [
        spark.read.parquet(path).withColumns({"dataset": F.lit(name), "split": infer_split(F.lit(path.rstrip("/")))})
        for name, paths in files.items()
        for path in paths
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several places that exists; raises where none does."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(paths)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records below a folder with the declared schema; blank lines are skipped; no folder, no rows."""
    if not exists(spark, folder):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(folder)


def done_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct ids that have a record."""
    return read_records(spark, folder).select("id").distinct()


def append_records(records: DataFrame, folder: str) -> None:
    """Append JSON lines, one folder for each model, dataset and split; nulls are written out.

    Records without a time get the present one as local ISO text.
    """
    if "ts" not in records.columns:
        records = records.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    keyed = records.withColumns({"_m": slug(F.col("model")), "_d": F.col("dataset"), "_s": F.col("split")})
    keyed.write.mode("append").option("ignoreNullFields", False).partitionBy("_m", "_d", "_s").json(folder)


def append_run(records: DataFrame, folder: str, model: str, dataset: str, split: str) -> None:
    """Append the records of one run as JSON lines under the run's published name (a folder of line files)."""
    if "ts" not in records.columns:
        records = records.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    records.write.mode("append").option("ignoreNullFields", False).json(f"{folder}/{record_file(model, dataset, split)}")


def fetch_missing(spark: SparkSession, sources: dict[str, str], folder: str, present: str = "train.parquet") -> list[str]:
    """Copy each named source folder below ``folder`` unless its ``present`` file is there; the names that were copied.

    A copy is made under another name and then renamed, so that one broken off is not taken for whole.
    """
    made = []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    for name, source in sources.items():
        if exists(spark, f"{folder}/{name}/{present}"):
            continue
        (there, at), (here, part), (_, whole) = _fs(spark, source), _fs(spark, f"{folder}/_{name}.part"), _fs(spark, f"{folder}/{name}")
        here.delete(part, True)
        util.copy(there, at, here, part, False, True, conf)
        here.delete(whole, True)
        here.rename(part, whole)
        made.append(name)
    return made


def write_splits(splits: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Frozen splits, partitioned by dataset and split; existing ones are kept unless ``mode`` is overwrite."""
    splits.write.mode(mode).partitionBy("dataset", "split").parquet(folder)


def write_table(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str, meta: dict | None = None) -> None:
    """A JSON object with one entry for each frozen split; the table has one row a split."""
    spark = manifest.sparkSession
    entries = {f"{r['dataset']}_{r['piece']}": {k: r[k] for k in ("n", "seed", "sha", "removed_for_leaks")} for r in manifest.collect()}
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"_meta": meta or {}, **entries}, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, piece, n, seed, sha``; entries without a row count, such as ``_meta``, are skipped."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<n: bigint, seed: int, sha: string, removed_for_leaks: bigint>>"
    return (
        text.select(F.explode(F.from_json("value", kind)).alias("key", "x")).where("x.n IS NOT NULL")
        .select(F.regexp_replace("key", "_[^_]*$", "").alias("dataset"), F.regexp_extract("key", "_([^_]*)$", 1).alias("piece"), "x.*")
    )


def verify_manifest(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Every entry of a manifest against the rows read again: ``dataset, piece, rows_match, sha_match``."""
    from ..operators.splits import digest

    actual = digest(ids, ["dataset", "piece"]).toDF("dataset", "piece", "rows", "found")
    both = read_manifest(spark, path).join(actual, ["dataset", "piece"], "full_outer")
    return both.select("dataset", "piece", F.col("n").eqNullSafe(F.col("rows")).alias("rows_match"), F.col("sha").eqNullSafe(F.col("found")).alias("sha_match"))


def verify_files(spark: SparkSession, folder: str, expected: dict[str, list[str]], deprecated: tuple[str, ...] = ()) -> DataFrame:
    """``dataset, file, status, n, message`` of every expected file, and of folders that should be gone."""
    out = []
    for dataset, names in expected.items():
        for name in names:
            path = f"{folder}/{dataset}/{name}"
            if not exists(spark, path):
                out.append((dataset, name, "missing", None, "no such file"))
                continue
            df = spark.read.parquet(path)
            lacking = sorted(set(REQUIRED) - set(df.columns))
            kind = df.schema["choices"].dataType if "choices" in df.columns else None
            if lacking:
                out.append((dataset, name, "schema", None, f"missing columns {lacking}"))
            elif not isinstance(kind, T.StructType) or not {"label", "text"} <= set(kind.names):
                out.append((dataset, name, "schema", None, "choices without label and text"))
            else:
                n = df.count()
                out.append((dataset, name, "ok" if n else "empty", n, ""))
    out += [(name, "", "deprecated", None, "folder should be removed") for name in deprecated if exists(spark, f"{folder}/{name}")]
    return spark.createDataFrame(out, "dataset string, file string, status string, n long, message string")


def remove_orphans(spark: SparkSession, folder: str, expected: set[str]) -> list[str]:
    """Delete children of a folder that are not expected; those that cannot be deleted stay."""
    fs, at = _fs(spark, folder)
    gone = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name not in expected:
            try:
                fs.delete(status.getPath(), True)
                gone.append(name)
            except Exception:  # noqa: BLE001
                continue
    return sorted(gone)


def record_file(model: str, dataset: str, split: str) -> str:
    """The name of a run's file in the flat layout."""
    import re

    return f"{re.sub('[^a-z0-9]+', '_', (model or '').lower()).strip('_')}__{dataset}__{split}.jsonl"


def results_root(folder: str, mock: bool) -> str:
    """Mock results never share a folder with real ones."""
    return f"{folder}/mock" if mock else f"{folder}/real"
