"""Metrics of inference records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import word_count

KEYS = ["model", "dataset", "split"]


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def _round(value: Column | str, digits: int) -> Column:
    """Half to even; first to nine digits, so that the order of a sum does not decide a tie."""
    return F.bround(F.bround(value, 9), digits)


def _quantile(value: str, share: float, accuracy: int | None) -> Column:
    """Interpolated and exact, which keeps the distinct values of a group in one buffer, or a sketch whose rank is off by 1 in ``accuracy``."""
    return F.percentile(value, F.lit(share)) if accuracy is None else F.percentile_approx(value, share, accuracy)


def _keyed(records: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of which no key is null."""
    return records.dropna(subset=keys)


def run_metrics(records: DataFrame) -> DataFrame:
    """Per model, dataset and split: rows, accuracy, invalid and strict share, mean latency."""
    return _keyed(records).groupBy(*KEYS).agg(
        F.count("id").alias("n"),
        _round(_rate("correct"), 3).alias("accuracy"),
        _round(1 - _rate("valid"), 3).alias("invalid"),
        _round(_rate("strict_format"), 3).alias("strict"),
        _round(F.avg("wall_time_s"), 3).alias("mean_latency_s"),
    )


def run_metrics_full(records: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``run_metrics`` with latency quantiles, generated tokens, their speed, and reasoning words.

    The speed uses ``gen_duration_s`` where the backend reports it, else the wall time. With ``accuracy`` the
    quantiles come from a sketch of bounded size.
    """
    seconds = F.coalesce("gen_duration_s", "wall_time_s") if "gen_duration_s" in records.columns else F.col("wall_time_s")
    return _keyed(records).groupBy(*KEYS).agg(
        F.count("id").alias("n"),
        _round(_rate("correct"), 3).alias("accuracy"),
        _round(1 - _rate("valid"), 3).alias("invalid"),
        _round(_rate("strict_format"), 3).alias("strict"),
        _round(F.avg("wall_time_s"), 3).alias("mean_latency_s"),
        _round(_quantile("wall_time_s", 0.5, accuracy), 3).alias("p50_latency_s"),
        _round(_quantile("wall_time_s", 0.95, accuracy), 3).alias("p95_latency_s"),
        _round(F.avg("gen_tokens"), 3).alias("mean_gen_tokens"),
        _round(F.avg(F.col("gen_tokens") / F.nullif(seconds, F.lit(0.0))), 3).alias("tokens_per_s"),
        _round(F.avg(word_count(F.col("raw_response"))), 3).alias("reasoning_words"),
    )


def quantile_bins(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """``df`` with ``bin``: the right-closed quantile bin of ``column`` over all rows, from 0.

    Edges are interpolated; equal edges are one, so there may be fewer bins. A null has no bin.
    """
    points = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    # One row, whatever the size of the table.
    edges = df.agg(F.array_distinct(F.percentile(F.col(column), points)).alias("_edges"))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    found = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.col(column).isNotNull(), found)).drop("_edges")


def accuracy_by_length(records: DataFrame, bins: int = 4) -> DataFrame:
    """Accuracy by quantile of the reasoning length, with edges over all records."""
    rows = _keyed(records, ["model", "dataset"]).withColumn("words", word_count(F.col("raw_response")))
    return quantile_bins(rows.select("model", "dataset", "words", "correct"), "words", bins).where("bin IS NOT NULL").groupBy(
        "model", "dataset", "bin"
    ).agg(F.count(F.lit(1)).alias("n"), _round(_rate("correct"), 3).alias("accuracy"))


def prediction_shares(records: DataFrame) -> DataFrame:
    """Per model the share of each predicted letter among valid rows."""
    total = F.sum("n").over(W.partitionBy("model"))
    valid = _keyed(records.where("valid"), ["model", "pred"])
    return valid.groupBy("model", "pred").agg(F.count(F.lit(1)).alias("n")).withColumn("share", _round(F.col("n") / total, 3))


def method_shares(records: DataFrame) -> DataFrame:
    """Per model the share of each extraction method; none is a method too."""
    total = F.sum("n").over(W.partitionBy("model"))
    rows = _keyed(records, ["model"]).groupBy("model", "extraction_method").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", _round(F.col("n") / total, 3))


def box_stats(records: DataFrame, value: str = "wall_time_s", by: tuple[str, ...] = ("dataset", "model"), accuracy: int | None = None) -> DataFrame:
    """Quartiles and whiskers (the most extreme values within 1.5 interquartile ranges) of each group; ``accuracy`` as in ``run_metrics_full``."""
    keys = list(by)
    rows = _keyed(records, [*keys, value]).select(*keys, F.col(value).alias("v"))
    q = rows.groupBy(*keys).agg(*(_quantile("v", k / 4, accuracy).alias(f"q{k}") for k in (1, 2, 3)))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = rows.join(q, keys)
    within = joined.where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    return within.groupBy(*keys, "q1", "q2", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high")).select(
        *keys, *(_round(c, 6).alias(c) for c in ("low", "q1", "q2", "q3", "high"))
    )


def histogram(records: DataFrame, bins: int = 40) -> DataFrame:
    """``model, bin, n``: equal-width bins of the reasoning length over the common range."""
    rows = _keyed(records, ["model"]).select("model", word_count(F.col("raw_response")).alias("w")).where("w IS NOT NULL")
    ends = rows.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    at = F.least(F.floor((F.col("w") - F.col("lo")) * bins / width), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")).groupBy("model", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy_interval(records: DataFrame) -> DataFrame:
    """Accuracy by dataset and model with its 95 % interval by the normal approximation."""
    rows = _keyed(records, ["dataset", "model"]).groupBy("dataset", "model").agg(F.count("correct").alias("n"), _rate("correct").alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.nullif(F.col("n"), F.lit(0)))
    return rows.select(
        "dataset", "model", "n", _round(F.col("p"), 3).alias("accuracy"), _round(F.col("p") - half, 3).alias("low"), _round(F.col("p") + half, 3).alias("high")
    )


def accuracy_bootstrap(records: DataFrame, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Accuracy by dataset and model with its bootstrap interval (percentiles over ``draws`` resamples).

    The correct rows of a resample are binomial in the rows and the accuracy, so only the counts of each group are resampled.
    """
    counts = _keyed(records, ["dataset", "model"]).groupBy("dataset", "model").agg(F.count("correct").alias("n"), F.count_if("correct").alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["dataset", "model", "n"]].copy()
            out["accuracy"], out["low"], out["high"] = None, None, None
            for row in pdf.index[pdf.n > 0]:
                n, k = int(pdf.n[row]), int(pdf.k[row])
                means = np.random.default_rng(seed).binomial(n, k / n, draws) / n
                ends = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
                out.loc[row, ["accuracy", "low", "high"]] = [round(k / n, 3), *(round(float(e), 3) for e in ends)]
            yield out.astype({c: float for c in ("accuracy", "low", "high")})

    return counts.mapInPandas(run, "dataset string, model string, n long, accuracy double, low double, high double")


def any_mock(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.bool_or("mock"), F.lit(False)).alias("any_mock"))
