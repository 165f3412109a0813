"""Profiles of question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import numeric_density, option_length, prefix, tokens
from .sampling import SEED, uniform

SPLITS = ["train", "validation", "test"]


def overview(questions: DataFrame) -> DataFrame:
    """Rows by dataset and split, totals, and the most frequent number of choices (the least on ties)."""
    counts = questions.groupBy("dataset").pivot("split", SPLITS).agg(F.count("id")).na.fill(0)
    mode = questions.groupBy("dataset").agg(F.mode("n_choices", True).alias("n_choices"))
    total = F.col("train") + F.col("validation") + F.col("test")
    return counts.withColumns({"total": total, "train_validation": F.col("train") + F.col("validation")}).join(mode, "dataset")


def shares(df: DataFrame, group: str, value: str, digits: int = 3) -> DataFrame:
    """Rows of each value within its group and their share; null is a value."""
    total = F.sum("n").over(W.partitionBy(group))
    return df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.bround(F.col("n") / total, digits))


def text_stats(questions: DataFrame, rows: int = 200, seed: int = SEED) -> DataFrame:
    """Per dataset the length and numeric density of all questions, vocabulary of all and of a sample, type-token ratio of the sample."""
    bags = questions.select("dataset", "id", tokens(F.col("question")).alias("bag"))
    lengths = bags.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg(F.size("bag")), 3).alias("mean_tokens"),
        F.median(F.size("bag")).alias("median_tokens"),
        F.bround(F.avg(numeric_density(F.col("bag"))), 3).alias("numeric_density"),
    )
    whole = bags.select("dataset", F.explode("bag").alias("w")).groupBy("dataset").agg(F.count_distinct("w").alias("vocabulary"))
    drawn = uniform(bags, ["dataset"], rows, seed).select("dataset", F.explode("bag").alias("w")).groupBy("dataset").agg(
        F.count_distinct("w").alias("sample_vocabulary"),
        F.bround(F.count_distinct("w") / F.nullif(F.count("w"), F.lit(0)), 3).alias("type_token_ratio"),
    )
    return lengths.join(whole, "dataset", "left").join(drawn, "dataset", "left")


def option_stats(questions: DataFrame) -> DataFrame:
    length = option_length(F.col("choices.text"))
    return questions.groupBy("dataset").agg(
        F.bround(F.avg(length), 3).alias("mean_option_tokens"), F.bround(F.median(length), 3).alias("median_option_tokens")
    )


def vocabulary_overlap(questions: DataFrame, rows: int = 300, seed: int = SEED) -> DataFrame:
    """Jaccard similarity of the sampled vocabularies of every ordered pair of datasets, with itself too."""
    drawn = uniform(questions.select("dataset", "id", "question"), ["dataset"], rows, seed)
    words = drawn.select("dataset", F.explode(tokens(F.col("question"))).alias("w")).distinct()
    sizes = words.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    both = words.toDF("a", "w").join(words.toDF("b", "w"), "w").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    # One row a dataset on either side.
    every = sizes.toDF("a", "na").crossJoin(sizes.toDF("b", "nb")).join(both, ["a", "b"], "left")
    common = F.coalesce("common", F.lit(0))
    return every.select("a", "b", F.bround(common / (F.col("na") + F.col("nb") - common), 3).alias("jaccard"))


def leakage(questions: DataFrame) -> DataFrame:
    """Per dataset: rows, distinct prefixes, most rows of a prefix, prefixes in both train and test."""
    side = F.col("split").isin("train", "validation")
    per = questions.groupBy("dataset", prefix(F.col("question")).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce(side, F.lit(False))).alias("trained"),
        F.max(F.coalesce(F.col("split") == "test", F.lit(False))).alias("tested"),
    )
    return per.groupBy("dataset").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("prefixes"),
        F.max("n").alias("most_per_prefix"),
        F.sum((F.col("trained") & F.col("tested")).cast("int")).alias("shared_prefixes"),
    )
