"""Splits that keep related records together.

Records that share an entity belong together, and so does what they are chained
with. Of the graph of records and entities only the part between entities is
searched: a record with several entities links them, equal links
count once, and a record's component is that of any of its entities. A hot entity
is thereby one node, however many records hold it. Components are found by
alternating large-star and small-star steps, whose every step is a join and an
aggregation by minimum, until no link changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, digest, spread_join, word_sequence


def _directed(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    around = _directed(links)
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(moved.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component``: each node of ``links`` (u, v) with the least node it is connected to."""
    current = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(current)
    while before[0]:
        current = cut(small_star(large_star(current)))
        after = state(current)
        if after == before:
            break
        before = after
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def related(records: DataFrame, id_col: str, entities: list[Column]) -> DataFrame:
    """``id, component`` for every distinct id.

    ``entities`` are expressions with one value per record; records with an equal
    non-null value of the same expression are related, and relatedness is
    passed on. A record without an entity is a component of its own. Rows with
    a null id are left out; rows with the same id are one record with all their
    entities; an empty table gives an empty result.
    """
    marks = F.array(*(F.when(e.isNotNull(), digest(F.concat(F.lit(f"{k}:"), e))) for k, e in enumerate(entities)))
    rows = cut(
        records.select(F.col(id_col).alias("id"), F.array_compact(marks).alias("e")).where("id IS NOT NULL").distinct()
    )
    own = digest(F.concat(F.lit("id:"), F.col("id").cast("string")))
    # An id that comes with different entities links them through a node of its own.
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    tied = rows.join(several, "id", "left_semi").select(own.alias("u"), F.explode("e").alias("v"))
    between = rows.where("size(e) > 1").select(F.col("e")[0].alias("u"), F.explode(F.expr("slice(e, 2, size(e) - 1)")).alias("v"))
    found = components(between.unionByName(tied))
    first = rows.select("id", F.coalesce(F.get("e", F.lit(0)), own).alias("node"))
    return (
        spread_join(first, found, "node", "id", "left")
        .select("id", F.coalesce("component", "node").alias("component"))
        .groupBy("id")
        .agg(F.min("component").alias("component"))
    )


def stars(members: DataFrame) -> DataFrame:
    """``id_first, id_other``: the least id of each component with every other one."""
    first = members.groupBy("component").agg(F.min("id").alias("id_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        spread_join(members, first, "component", "id").where("id <> id_first").select("id_first", F.col("id").alias("id_other"))
    )


def assign(members: DataFrame, plans: DataFrame, large: float = 0.005) -> DataFrame:
    """``plan_id, id, component, piece``: every component in one piece of each plan.

    ``plans`` is ``plan_id, piece, share``. Components that hold more than ``large``
    of the records (fewer than ``1 / large``, so that they fit one task) go
    first, from the largest down, each to the piece that lacks most; the hash
    of every other component's identifier falls into ranges proportional to what
    the pieces then lack.
    """
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n").alias("total"))
    big = sizes.crossJoin(F.broadcast(total)).where(F.col("n") > large * F.col("total"))
    pieces = plans.groupBy("plan_id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "share"))).alias("pieces")
    )
    listed = big.agg(F.sort_array(F.collect_list(F.struct("n", "component")), asc=False).alias("big"))
    plan = pieces.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(total))
    lacks = "transform(pieces, p -> p.share * coalesce(total, 0))"
    # State: what each piece lacks, and the piece of each large component.
    step = (
        f"aggregate(big, named_struct('lacks', {lacks}, 'at', CAST(array() AS array<int>)), (s, b) -> "
        "named_struct('lacks', transform(s.lacks, (x, i) -> x - CASE WHEN i + 1 = array_position(s.lacks, array_max(s.lacks)) "
        "THEN b.n ELSE 0 END), 'at', array_append(s.at, CAST(array_position(s.lacks, array_max(s.lacks)) AS int))))"
    )
    placed = plan.withColumn("s", F.expr(step)).withColumn(
        "open", F.expr("transform(s.lacks, x -> greatest(x, 0D))")
    )
    # With nothing left to share out, the ranges are those of the plan.
    placed = placed.withColumn(
        "open", F.expr("CASE WHEN array_max(open) > 0D THEN open ELSE transform(pieces, p -> greatest(p.share, 1e-9D)) END")
    )
    fixed = placed.select(
        "plan_id",
        "pieces",
        F.explode(F.arrays_zip(F.col("big.component").alias("component"), F.col("s.at").alias("at"))).alias("x"),
    ).select("plan_id", F.col("x.component").alias("component"), F.expr("pieces[x.at - 1].piece").alias("piece"))
    ranges = placed.select("plan_id", "pieces", "open", F.expr("aggregate(open, 0D, (a, x) -> a + x)").alias("whole")).select(
        "plan_id",
        F.posexplode("pieces").alias("k", "p"),
        "open",
        "whole",
    ).select(
        "plan_id",
        F.col("p.piece").alias("piece"),
        "k",
        F.expr("aggregate(slice(open, 1, k), 0D, (a, x) -> a + x) / whole").alias("lo"),
        F.expr("CASE WHEN k + 1 = size(open) THEN 2D ELSE aggregate(slice(open, 1, k + 1), 0D, (a, x) -> a + x) / whole END").alias("hi"),
    )
    point = (F.xxhash64("component", "plan_id") / F.lit(2.0**64)) + 0.5
    small = sizes.join(big, "component", "left_anti").select("component")
    drawn = (
        small.crossJoin(F.broadcast(plans.select("plan_id").distinct()))
        .withColumn("point", point)
        .join(F.broadcast(ranges.withColumnRenamed("plan_id", "r")), F.expr("r = plan_id AND point >= lo AND point < hi"))
        .select("plan_id", "component", "piece")
    )
    return spread_join(members, fixed.unionByName(drawn), "component", "id").select("plan_id", "id", "component", "piece")


def split_report(assigned: DataFrame, plans: DataFrame) -> DataFrame:
    """Share wanted and reached of every piece of every plan."""
    got = assigned.groupBy("plan_id", "piece").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("component").alias("components")
    )
    both = plans.select("plan_id", "piece", "share").join(got, ["plan_id", "piece"], "left").na.fill(0, ["records", "components"])
    total = F.sum("records").over(W.partitionBy("plan_id"))
    return both.select(
        "plan_id",
        "piece",
        "share",
        "records",
        "components",
        F.round(F.col("records") / F.nullif(total, F.lit(0)), 6).alias("reached"),
    )


def passage_of(context: Column, question: Column) -> Column:
    """The words of a record's passage, joined; null without a passage or words.

    That is ``context``, or where it is null the part of ``question`` before its first blank line.
    """
    at = F.instr(question, "\n\n")
    start = F.when(at > 0, F.substring(question, F.lit(1), at - 1))
    return F.nullif(F.array_join(word_sequence(F.coalesce(context, start)), " "), F.lit(""))


def manual_of(dataset: Column, subject: Column) -> Column:
    """The words of an oil_and_gas record's manual, joined; null otherwise."""
    return F.nullif(F.when(dataset == "oil_and_gas", F.array_join(word_sequence(subject), " ")), F.lit(""))
