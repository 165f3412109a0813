"""Canonical question tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_name, stripped
from ..schemas import REQUIRED
from .sampling import numbered


def canonical(questions: DataFrame) -> DataFrame:
    """One row an id, all columns as strings, split names in one spelling, ``n_choices`` counted.

    A null question counts as an empty one; rows delivered twice are one; ``context`` is kept where there is one.
    """
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    kept = ["context"] if "context" in questions.columns else []
    return questions.dropDuplicates(["id"]).select(
        F.col("id").cast("string").alias("id"),
        "dataset",
        split_name(F.col("split")).alias("split"),
        F.coalesce(F.col("question").cast("string"), F.lit("")).alias("question"),
        F.struct(text("choices.label").alias("label"), text("choices.text").alias("text")).alias("choices"),
        F.col("answerKey").cast("string").alias("answerKey"),
        "subject",
        *kept,
        F.coalesce(F.size("choices.text"), F.lit(0)).alias("n_choices"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def from_stems(raw: DataFrame, dataset: str, order: str) -> DataFrame:
    """A table of question stems: ids are numbered within each split from 0 by ``order``."""
    return numbered(raw, ["split"], [F.col(order)]).select(
        F.format_string(f"{dataset}_%s_%05d", F.col("split"), F.col("_rank") - 1).alias("id"),
        F.col("question_stem").alias("question"),
        "choices",
        "answerKey",
        "split",
    )


def from_passages(raw: DataFrame, dataset: str, order: str, letters: str = "ABCD", flags: dict[str, str] | None = None) -> DataFrame:
    """A table of passages, questions and options with the answer as an index from 0.

    ``flags`` maps boolean columns to the parts of the subject's label.
    """
    labels = F.array(*map(F.lit, letters))
    context = stripped(F.col("text"))
    return numbered(raw, ["split"], [F.col(order)]).select(
        F.format_string(f"{dataset}_%s_%05d", F.col("split"), F.col("_rank") - 1).alias("id"),
        F.concat(context, F.lit("\n\n"), F.col("question")).alias("question"),
        F.struct(labels.alias("label"), F.col("options").alias("text")).alias("choices"),
        F.try_element_at(labels, F.col("answer") + 1).alias("answerKey"),
        context.alias("context"),
        type_label({c: F.col(c) for c in flags or {}}, flags or {}).alias("subject"),
        "split",
    )


def type_label(flags: dict[str, Column], names: dict[str, str]) -> Column:
    """The names of the flags that are set, joined by ``+``; ``unspecified`` for none."""
    parts = [F.when(F.coalesce(flag, F.lit(False)), names[c]) for c, flag in flags.items()]
    return F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("unspecified"))


def validate(questions: DataFrame) -> DataFrame:
    """Per dataset: rows, and rows with a null id, question, answer key or choices, or unequal choices.

    The check runs over every row. Missing columns raise.
    """
    missing = set(REQUIRED) - set(questions.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    unequal = F.coalesce(F.size("choices.label") != F.size("choices.text"), F.lit(False))
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return questions.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("id").isNull(), "null_id"),
        count(F.col("question").isNull(), "null_question"),
        count(F.col("answerKey").isNull(), "null_key"),
        count(F.col("choices").isNull(), "null_choices"),
        count(unequal, "unequal_choices"),
    )
