"""Train and test splits without leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import norm_text, prefix, seeded
from ..session import materialised
from .sampling import SEED, first_rows, stratified

TRAIN, TEST = 1000, 250


def group_test(df: DataFrame, test: int = TEST, seed: int = SEED) -> DataFrame:
    """``dataset, prefix`` of the groups that become the test pool.

    Groups of questions with the same prefix are shuffled and taken whole until at least
    four times ``test`` rows are reached; a smaller dataset is taken entirely.
    """
    groups = df.groupBy("dataset", prefix(F.col("question")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    order = [seeded(seed, F.col("prefix")), F.col("prefix")]
    # A group has a row at least, so more than 4 * test groups are never taken.
    near = first_rows(groups, ["dataset"], 4 * test, order)
    before = F.sum("n").over(W.partitionBy("dataset").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return near.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < 4 * test).select("dataset", "prefix")


def pools(questions: DataFrame, test: int = TEST, seed: int = SEED) -> DataFrame:
    """``questions`` with ``pool``: train (train and validation rows) or test.

    The test rows of a dataset without train rows are divided by groups. Rows of no split belong to no pool.
    """
    named = questions.where(F.col("split").isin("train", "validation", "test"))
    trained = named.groupBy("dataset").agg(F.max(F.col("split") != "test").alias("_trained"))
    rows = named.join(trained, "dataset")
    given = rows.where("_trained").withColumn("pool", F.when(F.col("split") == "test", "test").otherwise("train"))
    alone = rows.where("NOT _trained").withColumn("prefix", prefix(F.col("question")))
    chosen = group_test(alone, test, seed).withColumn("_chosen", F.lit(True))
    divided = alone.join(chosen, ["dataset", "prefix"], "left").withColumn(
        "pool", F.when(F.col("_chosen"), "test").otherwise("train")
    )
    names = [*questions.columns, "pool"]
    return given.select(names).unionByName(divided.select(names))


def without_leaks(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """Candidates of which neither the prefix nor the text is a prefix or text of the dataset's train rows.

    Two equality joins against one relation; one condition with OR would compare all pairs.
    """
    banned = (
        train.select("dataset", prefix(F.col("question")).alias("_banned"))
        .unionByName(train.select("dataset", F.col("question").alias("_banned")))
        .distinct()
    )
    ds = candidates["dataset"] == banned["dataset"]
    by_prefix = candidates.join(banned, ds & (prefix(candidates["question"]) == banned["_banned"]), "left_anti")
    return by_prefix.join(banned, ds & (by_prefix["question"] == banned["_banned"]), "left_anti")


def build(questions: DataFrame, train: int = TRAIN, test: int = TEST, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(train rows, test rows, test candidates)`` of every dataset."""
    # Both are read several times; written once, they cut what would else be planned again and again.
    pooled = materialised(pools(questions, test, seed))
    tr = materialised(stratified(pooled.where("pool = 'train'"), train, seed=seed))
    candidates = materialised(without_leaks(pooled.where("pool = 'test'"), tr))
    return tr, stratified(candidates, test, seed=seed), candidates


def digest(ids: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the row count and a digest of its ids that ignores their order; groups are frozen splits."""
    joined = F.array_join(F.array_sort(F.collect_list("id")), "")
    return ids.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha2(joined, 256), 1, 12).alias("sha"))


def manifest(questions: DataFrame, train: int = TRAIN, test: int = TEST, seed: int = SEED) -> DataFrame:
    """One row a frozen split: rows, seed, digest, and test rows removed for leaks."""
    tr, te, candidates = build(questions, train, test, seed)
    both = tr.select("dataset", "id", F.lit("train").alias("piece")).unionByName(te.select("dataset", "id", F.lit("test").alias("piece")))
    pool = pools(questions, test, seed).where("pool = 'test'").groupBy("dataset").agg(F.count(F.lit(1)).alias("pool"))
    left = candidates.groupBy("dataset").agg(F.count(F.lit(1)).alias("left"))
    removed = pool.join(left, "dataset", "left").select("dataset", (F.col("pool") - F.coalesce("left", F.lit(0))).alias("gone"))
    rows = digest(both, ["dataset", "piece"]).join(removed, "dataset", "left")
    return rows.select(
        "dataset",
        "piece",
        "n",
        F.lit(seed).alias("seed"),
        "sha",
        F.when(F.col("piece") == "test", F.coalesce("gone", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("removed_for_leaks"),
    )


def disjointness(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per dataset the ids, texts and prefixes that a test row shares with the train rows; all should be 0."""
    out = None
    for name, key in (("ids", F.col("id")), ("texts", F.col("question")), ("prefixes", prefix(F.col("question")))):
        seen = train.select("dataset", key.alias("_k")).distinct()
        shared = (
            test.select("dataset", key.alias("_k")).distinct().join(seen.withColumn("_hit", F.lit(1)), ["dataset", "_k"], "left")
            .groupBy("dataset").agg(F.count("_hit").alias(f"shared_{name}"))
        )
        out = shared if out is None else out.join(shared, "dataset", "full_outer")
    return out


def decontaminate(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows whose normalised text is no test row's."""
    keys = test.select(norm_text(F.col("question")).alias("_k")).distinct()
    return train.withColumn("_k", norm_text(F.col("question"))).join(keys, "_k", "left_anti").drop("_k")


def dedup(df: DataFrame, text: str = "question", order: str = "id") -> DataFrame:
    """The first row by ``order`` of each normalised text."""
    first = df.groupBy(norm_text(F.col(text)).alias("_k")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")
