"""A sample whose shares follow given targets.

The targets of a plan form a tree: the plan, its datasets, their
subjects. Quotas go down the tree: the size of the sample is divided in whole rows among the datasets by the
sums of their shares, none getting less than the minima below it, and a dataset's quota among its
targets likewise, so that a minimum takes from its siblings first. What a target cannot supply is passed on to its
siblings (other targets of its dataset) while they have rows left, and only then
to its cousins (targets of other datasets), each time in proportion to their
shares. Rows are drawn by their dense rank under a seeded permutation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_sequence
from .ranking import ranked, unit_hash


def apportion(total: int, weights: np.ndarray) -> np.ndarray:
    """``total`` in whole parts proportional to ``weights``, by largest remainder; ties go to the first."""
    if total <= 0 or weights.sum() <= 0:
        return np.zeros(len(weights), int)
    exact = total * weights / weights.sum()
    parts = np.floor(exact + 1e-9).astype(int)
    order = np.argsort(-(exact - parts), kind="stable")
    parts[order[: total - parts.sum()]] += 1
    return parts


def pour(amount: int, room: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Up to ``amount`` divided by ``weights``, no part beyond its ``room``."""
    given = np.zeros(len(room), int)
    while amount > 0 and ((room - given > 0) & (weights > 0)).any():
        part = np.minimum(apportion(amount, np.where(room - given > 0, weights, 0.0)), room - given)
        given, amount = given + part, amount - part.sum()
    return given


def bounded(total: int, weights: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``total`` apportioned by ``weights``, no part below its ``least``; what that takes is ceded by the parts above theirs."""
    parts = np.maximum(apportion(total, weights), least)
    surplus = int(parts.sum() - total)
    while surplus > 0 and (parts > least).any():
        less = pour(surplus, parts - least, (parts - least).astype(float))
        parts, surplus = parts - less, surplus - int(less.sum())
    return parts


def nodes(values: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    return np.array([values[rows].sum() for rows in own])


def descend(size: int, shares: np.ndarray, least: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """The quota of each target: that of the plan is divided among datasets, that of a dataset among its targets."""
    out = np.zeros(len(shares), int)
    for part, rows in zip(bounded(size, nodes(shares, own), nodes(least, own)), own):
        out[rows] = bounded(int(part), shares[rows], least[rows])
    return out


def quotas(size: int, shares: np.ndarray, least: np.ndarray, available: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Rows to draw for each target of a plan; ``parent`` names its dataset."""
    shares = np.maximum(np.nan_to_num(shares.astype(float)), 0.0)
    own = [np.flatnonzero(parent == family) for family in dict.fromkeys(parent)]
    wanted = descend(size, shares, least, own)
    drawn = np.minimum(wanted, available)
    # A target without a share still takes what nobody else can.
    weights = np.maximum(shares, 1e-9)
    for rows in own:
        drawn[rows] += pour(int((wanted - drawn)[rows].sum()), (available - drawn)[rows], weights[rows])
    # What a dataset lacks goes up to the plan and down again through the other datasets.
    unmet = int(wanted.sum() - drawn.sum())
    for part, rows in zip(pour(unmet, nodes(available - drawn, own), nodes(weights, own)), own):
        drawn[rows] += pour(int(part), (available - drawn)[rows], weights[rows])
    return drawn


def plain(name: Column) -> Column:
    """A category name without regard to letter case, blanks and punctuation; null without a word."""
    return F.nullif(F.array_join(word_sequence(name), " "), F.lit(""))


def cells(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(one row a target, (plan_id, cell, id) of its records, one row with the number of records)``.

    A record belongs to the target of its dataset and subject, or else to that of its whole dataset.
    Names are compared by their words in lower case. Null ids are left out, rows with the same id are one
    record, a null dataset or one without a target belongs nowhere; other columns are not read; with no records
    every target draws nothing, with no targets the sample is empty.
    """
    one = cut(
        records.select("id", plain(F.col("dataset")).alias("d"), plain(F.col("subject")).alias("s"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min(F.struct("d", "s")).alias("x"))
        .select("id", "x.d", "x.s")
    )
    goal = targets.select(
        "plan_id",
        "sample_frac",
        "dataset",
        "subject",
        "target_share",
        "min_rows",
        plain(F.col("dataset")).alias("d"),
        plain(F.col("subject")).alias("s"),
    ).withColumn("cell", F.concat_ws("/", "d", "s"))
    exact = one.join(goal.where("s IS NOT NULL").select("plan_id", "cell", "d", "s"), ["d", "s"])
    named = goal.where("s IS NOT NULL").select("plan_id", "d", "s")
    whole = one.join(goal.where("s IS NULL").select("plan_id", "cell", "d"), "d").join(named, ["plan_id", "d", "s"], "left_anti")
    names = ["plan_id", "cell", "id"]
    return goal, exact.select(names).unionByName(whole.select(names)), one.agg(F.count(F.lit(1)).alias("total"))


def allocation(goal: DataFrame, members: DataFrame, total: DataFrame) -> DataFrame:
    """Every target with ``available``, ``wanted`` and ``drawn`` rows; a plan is one small group."""
    counted = members.groupBy("plan_id", "cell").agg(F.count(F.lit(1)).alias("available"))
    rows = goal.join(counted, ["plan_id", "cell"], "left").crossJoin(F.broadcast(total)).na.fill(0, ["available", "min_rows"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", kind="stable")
        size = math.floor(float(pdf.sample_frac.fillna(0).max()) * int(pdf.total.iloc[0]) + 0.5)
        # A cell that is named twice is one target; its later rows draw nothing of their own.
        room = np.where(pdf.cell.duplicated(), 0, pdf.available).astype(int)
        least, shares = pdf.min_rows.to_numpy(int), pdf.target_share.fillna(0).to_numpy(float)
        out = pdf[["plan_id", "cell", "dataset", "subject", "target_share", "min_rows", "available"]].copy()
        out["size"] = size
        own = [np.flatnonzero(pdf.d.fillna("").to_numpy() == family) for family in dict.fromkeys(pdf.d.fillna(""))]
        out["wanted"] = np.maximum(descend(size, np.maximum(shares, 0.0), np.zeros(len(pdf), int), own), least)
        out["drawn"] = quotas(size, shares, least, room, pdf.d.fillna("").to_numpy())
        return out

    return rows.groupBy("plan_id").applyInPandas(
        run,
        "plan_id string, cell string, dataset string, subject string, target_share double, min_rows int, "
        "available long, size long, wanted long, drawn long",
    )


def sample(members: DataFrame, allocated: DataFrame, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``plan_id, cell, id, rank`` of the rows drawn."""
    quota = allocated.groupBy("plan_id", "cell").agg(F.sum("drawn").alias("quota"))
    placed = members.withColumn("_u", unit_hash(F.col("id"), F.col("plan_id"), F.lit(seed)))
    return ranked(placed, ["plan_id", "cell"], F.col("_u"), ["_u", "id"], quota, buckets).drop("_u")


def report(allocated: DataFrame) -> DataFrame:
    """Every target with what was reached and, where it was not met, the reason."""
    reached = F.col("drawn") / F.nullif(F.col("size"), F.lit(0))
    reason = (
        F.when(F.col("drawn") < F.col("min_rows"), "fewer rows than the minimum")
        .when(F.col("drawn") < F.col("wanted"), F.when(F.col("available") <= F.col("drawn"), "too few rows").otherwise("rows ceded to minima"))
        .when(F.col("drawn") > F.col("wanted"), "filled up for other targets")
    )
    return allocated.select(
        "plan_id",
        "dataset",
        "subject",
        "target_share",
        "min_rows",
        "available",
        "wanted",
        "drawn",
        F.round(reached, 6).alias("reached_share"),
        (F.col("drawn") >= F.greatest("wanted", "min_rows")).alias("met"),
        reason.alias("reason"),
    )
