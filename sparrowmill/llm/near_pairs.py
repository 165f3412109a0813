"""Records that share most of their words.

The similarity of two records is the number of distinct words in both over the
number of distinct words in either. Written as matrices it is the product
``M * M'`` of the record by word incidence, kept only where the overlap reaches
what the sizes of the two rows demand. The product is never formed as a whole:

* Records with equal word sets are one row of ``M`` (a class).
* For a threshold ``t`` two rows of sizes ``a`` and ``b`` must overlap in
  ``o = t / (1 + t) * (a + b)`` words. With every row sorted from rare to frequent
  words, the j-th common word then lies among the first ``size - ceil(t * size) + j``
  words of both rows. A column of the blocked product is therefore a word
  n-gram taken from these beginnings: one word where it is rare, otherwise the
  word with the next common one, or the next two, so that frequent words never
  form a column alone. Which of the three it is depends only on the words' own
  counts, so both rows of a pair emit the same column. Counts are those of
  ``BUCKETS`` buckets of words: their order decides no result, only the size of the blocks.
* Longer rows are held to shorter n-grams, so that no row has more than ``16 * size``
  columns at any word counts; a row whose partners may be held to another length emits the
  columns of both.
* Each row carries a 128-bit parity sketch of its words. The number of
  differing bits is a lower bound of the symmetric difference, and the sizes bound
  the latter by ``(1 - t) / (1 + t) * (a + b)``; pairs beyond that bound are
  discarded in their block.
* For what is left the columns that met are accumulated. Every word that both beginnings share
  starts a common column, but for the last two, so the number of different first words
  bounds the overlap; pairs that cannot reach ``o`` are discarded.
* The overlap of the rest is counted exactly, on 64-bit hashes of the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, COLUMN_ROWS, Keep, blocked_pairs, bucket_counts, column_rows, cut, lists, mixed, pairs_by_key, sketches, spread_join, within, word_sequence
from .components import components

EPS = 1e-9
#: Columns a word may lead to at most, on the average over the words of a row.
COLUMNS = 16


def hashed_words(text: Column) -> Column:
    """The distinct words of a text as sorted hashes; null for a null text."""
    return F.sort_array(F.array_distinct(F.transform(word_sequence(text), lambda w: F.xxhash64(w))))


def hash_digest(hashes: Column) -> Column:
    """16 bytes that stand for an array of hashes."""
    return F.unhex(F.md5(F.array_join(hashes.cast("array<string>"), " ").cast("binary")))


def classes_of(records: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: id -> cls, and cls -> h (the hashes of its words).

    Rows with a null id, a null text or no word are left out. Rows with the
    same id are one record; if their texts differ, the class with the least key
    counts. The texts are read once.
    """
    rows = records.select(F.col(id_col).alias("id"), hashed_words(F.col(text_col)).alias("h")).where("id IS NOT NULL AND size(h) > 0")
    keyed = cut(rows.select("id", hash_digest(F.col("h")).alias("cls"), "h"))
    return keyed.groupBy("id").agg(F.min("cls").alias("cls")), keyed.groupBy("cls").agg(F.first("h").alias("h"))


def lead(size: np.ndarray, threshold: float) -> np.ndarray:
    """How far the first common word of a row may stand."""
    return size - np.ceil(threshold * size - EPS).astype(np.int64) + 1


def gram(size: np.ndarray, threshold: float) -> np.ndarray:
    """The longest n-gram of rows of these sizes: 1 to 3, as common words and the bound of the columns allow."""
    m = lead(size, threshold).astype(float)
    most = COLUMNS * size
    by_bound = np.where(m * (m + 1) * (m + 2) / 6 + m * (m + 1) / 2 <= most, 3, np.where(m * (m + 1) / 2 + m <= most, 2, 1))
    return np.minimum(by_bound, np.ceil(threshold * size - EPS)).astype(np.int64)


def lengths(size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether rows of these sizes emit columns of pairs held to 1, 2 and 3 words."""
    known, back = np.unique(size, return_inverse=True)
    emitted = np.zeros((len(known), 4), bool)
    for k, n in enumerate(known.tolist()):
        partners = np.arange(max(1, math.ceil(threshold * n - EPS)), math.floor(n / threshold + EPS) + 1)
        emitted[k, np.minimum(gram(partners, threshold), gram(np.array([n]), threshold))] = True
    return tuple(emitted[back, k] for k in (1, 2, 3))


def grams(hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, total: int, threshold: float, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, place of the first word)`` of all columns of rows of distinct word hashes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    d = counts[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
    order = np.lexsort((hashes, d, row))
    w, d = mixed(hashes[order]), d[order].astype(float)
    start, place = np.cumsum(sizes) - sizes, within(sizes)
    ahead = lead(sizes, threshold)
    one, two, three = (np.repeat(x, sizes) for x in lengths(sizes, threshold))
    end2 = np.repeat(start + np.minimum(sizes, ahead + 1), sizes)
    end3 = np.repeat(start + np.minimum(sizes, ahead + 2), sizes)
    at = np.flatnonzero(place < np.repeat(ahead, sizes))
    single = at[(d[at] <= rare) | one[at]]
    i = at[(d[at] > rare) & (two | three)[at]]
    more = np.maximum(end2[i] - i - 1, 0)
    j = np.repeat(i + 1, more) + within(more)
    i = np.repeat(i, more)
    thin = d[i] * d[j] <= rare * total
    pair = two[i] | (three[i] & thin)
    pi, pj = i[pair], j[pair]
    i, j = i[three[i] & ~thin], j[three[i] & ~thin]
    more = np.maximum(end3[i] - j - 1, 0)
    k = np.repeat(j + 1, more) + within(more)
    i, j = np.repeat(i, more), np.repeat(j, more)
    joined = mixed(w[pi] * np.uint64(3) ^ w[pj])
    tripled = mixed(mixed(w[i] * np.uint64(3) ^ w[j]) * np.uint64(5) ^ w[k])
    first = np.concatenate([single, pi, i])
    return row[first], np.concatenate([w[single], joined, tripled]), place[first]


def columns_of(classes: DataFrame, threshold: float, rare: int) -> DataFrame:
    """Incidence of classes and n-gram columns: the rows for ``blocked_pairs``."""
    counts = bucket_counts(classes, "h")
    total = classes.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["h"].offsets.to_numpy())
            # So many rows at a time that their columns stay below two million.
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes * COLUMNS) // 2_000_000)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(part[0], len(part))
                h, n = lists(rows["h"])
                s0, s1 = sketches(h, n)
                row, key, pos = grams(h, n, counts, total, threshold, rare)
                yield column_rows(key, rows["cls"].take(pa.array(row)), pos, n[row], s0[row], s1[row], np.zeros(len(row)))

    return classes.select("cls", "h").mapInArrow(run, COLUMN_ROWS)


def bounds(threshold: float) -> Keep:
    """Whether two rows may be ``threshold`` alike, by their sizes and sketches."""
    # Single precision with room for its rounding: what is let through is counted exactly later.
    share = np.float32((1 - threshold) / (1 + threshold))

    def keep(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        bits = np.bitwise_count(a["s0"] ^ b["s0"]) + np.bitwise_count(a["s1"] ^ b["s1"])
        near = bits <= a["n"] * share + (b["n"] * share + np.float32(1e-3))
        room, least = np.float32(1 + 1e-5), np.float32(threshold)
        return near & (a["n"] * room >= b["n"] * least) & (b["n"] * room >= a["n"] * least)

    return keep


def alike(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of classes at least ``threshold`` alike, with ``common`` and ``likeness``; ``met`` is optional."""
    left = classes.select(F.col("cls").alias("a"), F.col("h").alias("ha"))
    right = classes.select(F.col("cls").alias("b"), F.col("h").alias("hb"))
    na, nb = F.size("ha"), F.size("hb")
    both = pairs.join(left, "a").join(right, "b")
    if "met" in pairs.columns:
        # Beyond the shared beginnings no more words can be common than the longer end holds.
        rest = F.greatest(*(F.ceil(threshold * n - EPS) - 1 for n in (na, nb)))
        longer = F.greatest(na, nb)
        collapsed = F.greatest(longer - F.ceil(threshold * longer - EPS) + 1 - 64, F.lit(0))
        both = both.where(F.col("met") + collapsed + 2 + rest >= threshold / (1 + threshold) * (na + nb) - EPS)
    # A generated row, so that the words are compared once and not for each use of the result.
    counted = F.inline(F.array(F.struct(F.size(F.array_intersect("ha", "hb")).alias("common"), (na + nb).alias("all"))))
    return (
        both.select("a", "b", counted)
        .where(F.expr(f"common >= {threshold}D * (all - common) - {EPS}D"))
        .select("a", "b", "common", (F.col("common") / (F.col("all") - F.col("common"))).alias("likeness"))
    )


def class_pairs(classes: DataFrame, threshold: float = 0.7, rare: int = 256, block: int = 2048) -> DataFrame:
    """Pairs of different classes at least ``threshold`` alike: ``a, b, common, likeness``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    met = blocked_pairs(columns_of(classes, threshold, rare), bounds(threshold), block)
    firsts = F.bit_or(F.expr("shiftleft(1L, least(p, 63))"))
    pairs = met.groupBy("a", "b").agg(F.bit_count(firsts).alias("met"))
    return alike(pairs, classes, threshold)


def expand(pairs: DataFrame, members: DataFrame, block: int = 2048) -> DataFrame:
    """Pairs of record ids from pairs of classes, with all pairs within a class."""
    left = spread_join(members.select(F.col("id").alias("x"), F.col("cls").alias("a")), pairs.select("a", "b", "likeness"), "a", "x")
    across = spread_join(members.select(F.col("id").alias("y"), F.col("cls").alias("b")), left, "b", "y").select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "likeness"
    )
    within_class = pairs_by_key(members, "cls", "id", block).select(
        F.col("a_id").alias("id_a"), F.col("b_id").alias("id_b"), F.lit(1.0).alias("likeness")
    )
    return across.unionByName(within_class)


def near_pairs(
    records: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, rare: int = 256, block: int = 2048
) -> DataFrame:
    """All pairs of records whose word sets are at least ``threshold`` alike: ``id_a, id_b, likeness``.

    Null ids, null texts and texts without a word have no partner; rows with the
    same id are one record; an empty table gives an empty result; other columns
    are not read. The result is exact for every threshold above 0.
    """
    members, classes = classes_of(records, id_col, text_col)
    members, classes = cut(members), cut(classes)
    return expand(class_pairs(classes, threshold, rare, block), members, block)


def near_groups(
    records: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, rare: int = 256, block: int = 2048
) -> DataFrame:
    """``id, group_id, links``: every record with a word, the least id of its group, and its number of partners.

    A group is what chains of pairs connect. Copies are counted, not expanded into pairs. Nulls, repeated ids
    and empty tables are treated as in ``near_pairs``.
    """
    members, classes = classes_of(records, id_col, text_col)
    members, classes = cut(members), cut(classes)
    pairs = cut(class_pairs(classes, threshold, rare, block).select("a", "b"))
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("least"))
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = ends.join(sizes.select(F.col("cls").alias("b"), "k"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("k").alias("across"))
    grouped = (
        sizes.join(found.withColumnRenamed("node", "cls"), "cls", "left")
        .join(across, "cls", "left")
        .select("cls", "least", F.coalesce("component", "cls").alias("component"), (F.coalesce("across", F.lit(0)) + F.col("k") - 1).alias("links"))
    )
    first = grouped.groupBy("component").agg(F.min("least").alias("group_id"))
    return members.join(grouped.join(first, "component"), "cls").select("id", "group_id", "links")
