"""Latent vectors and clusters of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .sampling import SEED
from .similarity import tfidf


def latent(
    df: DataFrame, key: str, text: str, components: int = 50, features: int = 20_000, spare: int = 10, passes: int = 4, seed: int = SEED
) -> DataFrame:
    """``key, vector``: the rows of the uncentred truncated SVD of the tf-idf matrix; texts without a term get none.

    Randomised: a basis of ``components + spare`` directions is multiplied by the matrix and its transpose
    ``passes`` times, one job each, and rotated to the leading singular directions. What travels is
    a matrix of ``features`` by the basis, whatever the number of texts. The number of
    components is cut to what the matrix has.
    """
    spark = df.sparkSession
    weights = materialised(tfidf(df, key, text, [], features))
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").limit(features).collect()]
    kind = dict(df.dtypes)[key]
    if not terms:
        return df.select(key).limit(0).withColumn("vector", F.array().cast("array<double>"))
    index = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, i int")
    rows = materialised(
        weights.join(F.broadcast(index), "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("x"))
        .select(key, F.transform("x", lambda e: e["i"]).alias("i"), F.transform("x", lambda e: e["w"]).alias("w"))
    )
    width = len(terms)
    basis = np.random.default_rng(seed).standard_normal((width, min(components + spare, width)))
    for _ in range(passes):
        basis, _ = np.linalg.qr(basis)
        sent = spark.sparkContext.broadcast(basis)

        def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(sent.value)
            for pdf in filter(len, batches):
                sizes = pdf["i"].str.len().to_numpy()
                at, w = np.concatenate(pdf["i"].to_list()), np.concatenate(pdf["w"].to_list())[:, None]
                inner = np.add.reduceat(w * sent.value[at], np.cumsum(sizes) - sizes)
                outer, order = w * np.repeat(inner, sizes, axis=0), np.argsort(at, kind="stable")
                terms_met, first = np.unique(at[order], return_index=True)
                total[terms_met] += np.add.reduceat(outer[order], first)
            yield pd.DataFrame({"m": [total.tobytes()]})

        # One matrix a partition, added up in a tree.
        shape = basis.shape
        image = rows.select("i", "w").mapInPandas(product, "m binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(shape)).treeReduce(np.add)
        before, basis = basis, image
    # The image is the Gram matrix applied to the last orthonormal basis.
    values, rotation = np.linalg.eigh(before.T @ image)
    order = np.argsort(-values)[:components]
    right = before @ rotation[:, order[values[order] > 1e-12]]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [np.asarray(w) @ right[np.asarray(i)] for i, w in zip(pdf["i"], pdf["w"])]
            yield pd.DataFrame({key: pdf[key], "vector": vectors})

    return rows.mapInPandas(project, f"`{key}` {kind}, vector array<double>")


def kmeans(df: DataFrame, key: str, vector: str, k: int = 25, seed: int = SEED, starts: int = 3) -> DataFrame:
    """``key, cluster`` of dense vectors: of ``starts`` seeded starts the one with the least cost."""
    rows = materialised(df.select(key, array_to_vector(vector).alias("features")))
    fits = [KMeans(k=k, seed=seed + n, featuresCol="features", predictionCol="cluster").fit(rows) for n in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(rows).select(key, "cluster")
