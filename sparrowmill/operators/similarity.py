"""Text vectors and similarity as relations.

A vector is its non-zero weights, one row each; products are joins on the term, so
only texts that share a term meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]{2,}"
# The default stop words; the list is a parameter of every function.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how "
    "if in into is it its may more most no not of on one or other our out over she so some such than that the their them "
    "then there these they this those to under up was we were what when where which while who will with would you your".split()
)


def term_counts(df: DataFrame, key: str, text: str, by: list[str], stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``by..., key, term, n`` of all terms that are no stop words."""
    terms = df.select(*by, key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    return terms.where(~F.col("term").isin(*stop)).groupBy(*by, key, "term").agg(F.count(F.lit(1)).alias("n"))


def fit_idf(counts: DataFrame, sizes: DataFrame, by: list[str], features: int = 20_000) -> DataFrame:
    """``by..., term, idf`` of the most frequent terms of each group; ties go to the lesser term.

    ``sizes`` is ``by..., docs``: documents of each group, those without terms too.
    """
    from .sampling import first_rows

    per = counts.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    top = first_rows(per, by or [F.lit(0)], features, [F.desc("cf"), F.col("term")])
    joined = top.join(sizes, by) if by else top.crossJoin(F.broadcast(sizes))
    return joined.select(*by, "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, idf: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``by..., key, term, w``: sublinear tf times idf, rows of unit length; unknown terms are dropped."""
    raw = counts.join(idf, [*by, "term"]).withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = raw.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [*by, key]).select(*by, key, "term", (F.col("w") / F.col("norm")).alias("w"))


def tfidf(df: DataFrame, key: str, text: str, by: list[str], features: int = 20_000) -> DataFrame:
    """Weights of a table by its own counts."""
    counts = term_counts(df, key, text, by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"))
    return weigh(counts, fit_idf(counts, sizes, by, features), key, by)


def similarities(train: DataFrame, test: DataFrame, features: int = 20_000) -> DataFrame:
    """``dataset, id, train_id, sim``: cosine of test and train questions that share a term; counts are the train rows'."""
    by = ["dataset"]
    counts = term_counts(train, "id", "question", by)
    idf = fit_idf(counts, train.groupBy(*by).agg(F.count(F.lit(1)).alias("docs")), by, features)
    x = weigh(counts, idf, "id", by).select("dataset", "term", F.col("id").alias("train_id"), F.col("w").alias("wx"))
    y = weigh(term_counts(test, "id", "question", by), idf, "id", by)
    return y.join(x, ["dataset", "term"]).groupBy("dataset", "id", "train_id").agg(F.sum(F.col("w") * F.col("wx")).alias("sim"))


def top_similarities(train: DataFrame, test: DataFrame, k: int = 5, features: int = 20_000) -> DataFrame:
    """``dataset, id, top1, top_k_mean`` of every test row; rows without a partner, and missing partners, count 0."""
    from .sampling import first_rows

    sims = similarities(train, test, features)
    best = first_rows(sims, ["dataset", "id"], k, [F.desc("sim"), F.col("train_id")])
    per = best.groupBy("dataset", "id").agg(F.max("sim").alias("top1"), F.sum("sim").alias("total"))
    docs = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("docs"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        test.select("dataset", "id").join(per, ["dataset", "id"], "left").join(docs, "dataset", "left")
        .select(
            "dataset",
            "id",
            F.bround(zero("top1"), 6).alias("top1"),
            F.bround(zero(F.col("total") / F.least(F.lit(k), F.nullif("docs", F.lit(0)))), 6).alias("top_k_mean"),
        )
    )


def retrieval_report(tops: DataFrame, near: float = 0.3) -> DataFrame:
    """Per dataset the mean, median and 90 % quantile of top-1 similarity and the percentage of at least ``near``."""
    return tops.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg("top1"), 3).alias("mean_top1"),
        F.bround(F.median("top1"), 3).alias("median_top1"),
        F.bround(F.percentile("top1", F.lit(0.9)), 3).alias("p90_top1"),
        F.bround(F.avg("top_k_mean"), 3).alias("mean_top_k"),
        F.bround(F.avg((F.col("top1") >= near).cast("int")) * 100, 1).alias("percent_near"),
    )


def cohesion(weights: DataFrame, group: str, key: str, part: str, weight: str, digits: int = 3) -> DataFrame:
    """Mean cosine within and between groups of unit vectors: ``a, b, cohesion``.

    With s the sum of a group's vectors, the mean between groups is s_a . s_b over n_a n_b,
    and within a group (|s|^2 - n) over n (n - 1), leaving out each vector with itself;
    no pair of vectors is formed. Within a group of one it is null.
    """
    sums = weights.groupBy(group, part).agg(F.sum(weight).alias("s"))
    sizes = weights.select(group, key).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    dots = sums.toDF("a", part, "sa").join(sums.toDF("b", part, "sb"), part).groupBy("a", "b").agg(F.sum(F.col("sa") * F.col("sb")).alias("dot"))
    # One row a group on either side.
    every = sizes.toDF("a", "na").crossJoin(sizes.toDF("b", "nb")).join(dots, ["a", "b"], "left")
    dot = F.coalesce("dot", F.lit(0.0))
    inner = (dot - F.col("na")) / F.nullif(F.col("na") * (F.col("na") - 1), F.lit(0))
    return every.select("a", "b", F.bround(F.when(F.col("a") == F.col("b"), inner).otherwise(dot / (F.col("na") * F.col("nb"))), digits).alias("cohesion"))


def dense_cohesion(df: DataFrame, group: str, key: str, vector: str, digits: int = 3) -> DataFrame:
    """``cohesion`` of dense vectors, which are brought to unit length; zero vectors are left out."""
    rows = df.select(group, key, F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.withColumn("norm", norm).where("norm > 0").select(group, key, "norm", F.posexplode("v").alias("i", "x"))
    return cohesion(unit.withColumn("w", F.col("x") / F.col("norm")), group, key, "i", "w", digits)


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 1, block: int = 2048) -> DataFrame:
    """``query, neighbour, cosine``: the ``k`` nearest rows of each query row, itself left out.

    Rows and queries are gathered into blocks of bounded size and every block of queries is compared
    with every block of rows by one matrix product; ties go to the lesser key. The index is
    exact, so recall is 1.
    """

    def blocks(rows: DataFrame, tag: str) -> DataFrame:
        # The number of blocks follows the number of rows, so a block keeps its size.
        total = F.broadcast(rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).alias("parts")))
        part = F.pmod(F.xxhash64(key), F.col("parts"))
        one = F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))
        return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).crossJoin(total).groupBy(part.alias(f"{tag}_part")).agg(F.collect_list(one).alias(tag))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, x in zip(pdf.q, pdf.x):
                qk, xk = (np.array([r["k"] for r in side]) for side in (q, x))
                qv, xv = (np.array([r["v"] for r in side], float) for side in (q, x))
                qv, xv = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1) for v in (qv, xv))
                sims = np.where(qk[:, None] == xk[None, :], -np.inf, qv @ xv.T)
                for i, row in enumerate(sims):
                    order = np.lexsort((xk, -row))[:k]
                    order = order[np.isfinite(row[order])]
                    yield pd.DataFrame({"query": np.repeat(qk[i], len(order)), "neighbour": xk[order], "cosine": row[order]})

    pairs = blocks(queries, "q").crossJoin(blocks(df, "x")).select("q", "x")
    found = pairs.mapInPandas(run, "query long, neighbour long, cosine double")
    from .sampling import first_rows

    best = first_rows(found, ["query"], k, [F.desc("cosine"), F.col("neighbour")])
    return best.select("query", "neighbour", F.bround("cosine", 6).alias("cosine"))


def impact(reasoning: DataFrame, density: DataFrame, inner: DataFrame, tops: DataFrame) -> DataFrame:
    """Expected effect of reflection per dataset: 2 points for procedural errors, 1 each for similarity and cohesion from the median up.

    0 and 1 point are low, 2 medium, 3 and 4 high.
    """
    table = reasoning.join(density, "dataset", "full_outer").join(inner, "dataset", "full_outer").join(tops, "dataset", "full_outer")
    medians = table.agg(F.median("mean_top1").alias("_t"), F.median("cohesion").alias("_c"))
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = 2 * point(F.col("error_type") == "process") + point(F.col("mean_top1") >= F.col("_t")) + point(F.col("cohesion") >= F.col("_c"))
    scored = table.crossJoin(F.broadcast(medians)).withColumn("score", score).drop("_t", "_c")
    return scored.withColumn("impact", F.when(F.col("score") <= 1, "low").when(F.col("score") == 2, "medium").otherwise("high"))
