"""Exact-size seeded samples.

Every sample is the rows with the least seeded hashes, so it is the same on every run
and cluster. Limits are constants in the window's filter, which Spark turns into a
limit per group before the shuffle; no group is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import seeded
from ..session import materialised

SEED = 42


def first_rows(df: DataFrame, groups: list[str], n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def uniform(df: DataFrame, groups: list[str], n: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """``n`` rows of each group, or all of a smaller one."""
    return first_rows(df, groups, n, [seeded(seed, F.col(key)), F.col(key)])


def stratified(df: DataFrame, n: int, stratum: str = "subject", floor: int = 1, seed: int = SEED, key: str = "id") -> DataFrame:
    """Per dataset ``n`` rows (or all of fewer), divided by ``stratum``.

    A stratum gets its share of ``n`` rounded half to even, at least ``floor`` and at most its rows; then the
    whole is cut down at random or filled up from what is left to exactly ``n``. In a
    dataset with the stratum column, null is a stratum of its own; without one the
    sample is uniform.
    """
    per_dataset = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("_all"), F.count(stratum).alias("_known"))
    named = df.join(per_dataset, "dataset").withColumn(
        "_s", F.when(F.col("_known") > 0, F.coalesce(stratum, F.lit("nan"))).otherwise("")
    )
    sizes = named.groupBy("dataset", "_s").agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.lit(n), F.col("_all"))
    share = F.bround(size * F.col("_n") / F.col("_all")).cast("long")
    part = F.least(F.greatest(share, F.lit(floor)), F.col("_n"))
    own = F.row_number().over(W.partitionBy("dataset", "_s").orderBy(seeded(seed, F.col(key)), key))
    # No stratum gives more than n rows, and no dataset more than n beyond them.
    ordered = named.withColumn("_own", own).where(F.col("_own") <= 2 * n)
    picked = ordered.join(sizes, ["dataset", "_s"]).withColumn("_late", (F.col("_own") > part).cast("int"))
    final = first_rows(picked, ["dataset"], n, ["_late", seeded(seed + 1, F.col(key)), F.col(key)])
    return final.select(*df.columns)


def numbered(df: DataFrame, groups: list[str], order: list, out: str = "_rank") -> DataFrame:
    """``df`` with ``out``: the place of each row in its group, from 1.

    Rows are parted by ranges of the group and the order, so that a group is spread over many tasks; a place is the
    number of rows in the group's earlier parts and the place within the own one.
    """
    keys = [f"_o{k}" for k in range(len(order))]
    placed = df.withColumns(dict(zip(keys, (o if not isinstance(o, str) else F.col(o) for o in order))))
    placed = materialised(placed.repartitionByRange(*groups, *keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*groups).orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(*keys))
    met = placed.alias("p").join(before.alias("b"), [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, "_part"]])
    return met.select("p.*", "_before").withColumn(out, F.col("_before") + own).drop("_part", "_before", *keys)


def halves(df: DataFrame, groups: list[str], seed: int = SEED, key: str = "id") -> DataFrame:
    """``df`` with ``half`` 0 or 1: a random half of each group, rounded down, is 0."""
    count = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(df, groups, [seeded(seed, F.col(key)), F.col(key)]).join(count, groups).withColumn(
        "half", (F.col("_rank") > F.floor(F.col("_n") / 2)).cast("int")
    ).drop("_rank", "_n")
