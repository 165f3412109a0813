"""The queries of this subpackage, each with its parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import allocate, components, defects, diverse, encode, fold, leak, near_pairs, overlap
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs.near_pairs(table(spark, sf_dir, "questions"), "id", "question", 0.7).select("id_a", "id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs.near_groups(table(spark, sf_dir, "questions"), "id", "question", 0.7)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [table(spark, sf_dir, name) for name in ("questions", "anchor_questions")]
    return defects.settled(components.cut(defects.classify(table(spark, sf_dir, "responses"), *asked)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).where("defect IS NOT NULL").select("rec_id", "defect")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defect_report(_settled(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.truncated(_settled(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.truncation_report(_settled(spark, sf_dir))


def _allocated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    goal, members, total = allocate.cells(table(spark, sf_dir, "questions"), table(spark, sf_dir, "sample_targets"))
    return members, allocate.allocation(goal, members, total)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, allocated = _allocated(spark, sf_dir)
    names = allocated.select("plan_id", "cell", "dataset", "subject")
    drawn = allocate.sample(members, allocated)
    return drawn.join(names, ["plan_id", "cell"]).select("plan_id", "dataset", "subject", "id", "rank")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.report(_allocated(spark, sf_dir)[1])


def p4_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "sample_plans").where("purpose = 'varied'")
    return diverse.choose(table(spark, sf_dir, "questions"), "id", "question", plans).select("plan_id", "id", "rank")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    passage = components.passage_of(F.col("context"), F.col("question"))
    manual = components.manual_of(F.col("dataset"), F.col("subject"))
    return components.related(table(spark, sf_dir, "questions"), "id", [passage, manual])


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_plans").where("purpose = 'grouped'")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.stars(components.cut(_related(spark, sf_dir)))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = components.cut(_related(spark, sf_dir))
    assigned = components.assign(members, _grouped(spark, sf_dir))
    return assigned.select("plan_id", "id", F.hex("component").alias("component"), "piece")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, plans = components.cut(_related(spark, sf_dir)), _grouped(spark, sf_dir)
    return components.split_report(components.assign(members, plans), plans)


def _overlaps(spark: SparkSession, sf_dir: str, coverage: bool = False) -> DataFrame:
    questions = table(spark, sf_dir, "questions")
    return overlap.overlaps(questions, "id", "question", overlap.split_side(F.col("split")), coverage=coverage)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("id_a", "id_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "questions")
    return overlap.partners(questions, "id", "question", overlap.split_side(F.col("split")))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "questions"), _overlaps(spark, sf_dir, True))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leak.leaks(documents, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leak.leaks(documents, "doc_id", "text", items, "item_id", "text", max_edits=1)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_items(_leaks(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fold.same_look(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fold.looks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold(table(spark, sf_dir, "documents"), "doc_id", "text", "form").select("doc_id", "form")


def queries() -> dict:
    own = [p1_found, p1_groups, p2_found, p2_report, p3_sample, p3_report, p4_subset, p5_found, p5_splits, p5_report, p6_found, p6_groups, p6_report, p7_found, p7_report, p8_ids, p9_found, p9_near, p9_items, p10_found, p10_groups, p10_forms]
    return {f.__name__: f for f in own}
