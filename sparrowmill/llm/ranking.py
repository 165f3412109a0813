"""The first rows of each group by a distributed rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ranked(df: DataFrame, groups: list[str], place: Column, order: list[str], quota: DataFrame, buckets: int = 1024) -> DataFrame:
    """The rows of ``df`` whose rank in their group is within the group's ``quota``, with ``rank``.

    ``place`` maps a row into [0, 1) and agrees with ``order``; ``order`` ends with a
    column that differs between rows. Rows are counted per group and bucket
    of ``place``; buckets that lie beyond the quota are dropped, and a row's rank is the
    number of rows in earlier buckets plus its number within its own, so that no task
    ever sorts more than a bucket. ``quota`` is ``groups, quota``, one row a group.
    """
    rows = df.withColumn("_bucket", F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int"))
    keys = [*groups, "_bucket"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*groups).orderBy("_bucket")) - F.col("_n")
    open_buckets = counts.withColumn("_before", earlier).join(quota, groups).where("_before < quota").drop("_n")
    own = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        rows.join(open_buckets, keys)
        .withColumn("rank", (F.col("_before") + own).cast("int"))
        .where("rank <= quota")
        .drop("_bucket", "_before", "quota")
    )


def unit_hash(*columns: Column) -> Column:
    """A hash of the columns, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))
