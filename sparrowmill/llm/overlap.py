"""Records of one side that appear again on the other, exactly or nearly.

Every text is a sequence of words. The rolling hashes of its ``gram``-word runs
are winnowed: of every ``window`` consecutive ones the least is a fingerprint,
least by the count of the run's bucket and then by hash, so that a
shared run of ``gram + window - 1`` words always yields a shared fingerprint and a
frequent phrase is chosen only where nothing rarer stands near. Fingerprints are
joined across the two sides; a parity sketch of the words and the sizes
discard joins that cannot reach the threshold. The likeness (distinct words in both over
distinct words in either) of what is left is computed exactly. Where coverages are asked for, the shared
fingerprints of a pair are seeds: the longest collinear chain of them is extended by
alignment, word by word in both directions, which gives the part of each text that is covered.

Pairs of texts that reach the threshold but share no run of ``gram + window - 1``
words are not found by fingerprints: a text and its own words in another order, or with an edit in
every fifth word. ``reordered`` adds them, from the blocked product of ``near_pairs``, so that the result is exact.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, COLUMN_ROWS, Keep, blocked_pairs, bucket_counts, column_rows, cut, lists, mixed, sketches, spread_join, within, word_sequence
from .near_pairs import alike, bounds, columns_of, hash_digest


def texts_of(records: DataFrame, id_col: str, text_col: str, sides: Column) -> tuple[DataFrame, DataFrame]:
    """``(members, texts)``: id, cls, side; and the distinct word sequences as hashes with the sides that hold them (bits 1 and 2)."""
    sequence = F.transform(word_sequence(F.col(text_col)), lambda w: F.xxhash64(w))
    rows = records.select(F.col(id_col).alias("id"), sequence.alias("seq"), sides.alias("side")).where("id IS NOT NULL AND size(seq) > 0 AND side IS NOT NULL")
    keyed = cut(rows.select("id", "side", hash_digest(F.col("seq")).alias("cls"), "seq"))
    members = keyed.groupBy("id").agg(F.min(F.struct("cls", "side")).alias("x")).select("id", "x.cls", "x.side")
    texts = keyed.groupBy("cls").agg(F.first("seq").alias("seq"), F.bit_or(F.when(F.col("side") == 0, 1).otherwise(2)).alias("side"))
    return members, texts.withColumn("h", F.sort_array(F.array_distinct("seq")))


def runs(words: np.ndarray, sizes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes of the runs of gram words, number of runs of each text)``; a shorter text is one run."""
    count = np.maximum(sizes - gram + 1, 1)
    start = np.repeat(np.cumsum(sizes) - sizes, count) + within(count)
    end = np.repeat(np.cumsum(sizes), count)
    key = np.zeros(len(start), np.uint64)
    for k in range(gram):
        at = start + k
        key = np.where(at < end, mixed(key * np.uint64(0x100000001B3) ^ words[np.minimum(at, len(words) - 1)]), key)
    return key, count


def winnow(key: np.ndarray, count: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, its first place)`` of the fingerprints of each text."""
    d = counts[(key & np.uint64(BUCKETS - 1)).astype(np.int64)]
    windows = np.maximum(count - window + 1, 1)
    begin = np.repeat(np.cumsum(count) - count, windows) + within(windows)
    end = np.repeat(np.cumsum(count), windows)
    best = begin
    for k in range(1, window):
        other = np.minimum(begin + k, end - 1)
        less = (d[other] < d[best]) | ((d[other] == d[best]) & (key[other] < key[best]))
        best = np.where(less, other, best)
    best = np.unique(best)
    text, place = np.repeat(np.arange(len(count)), count)[best], within(count)[best]
    # Of the places of a hash the first counts.
    order = np.lexsort((place, key[best], text))
    t, h, p = text[order], key[best][order], place[order]
    fresh = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])) if len(t) else np.empty(0, bool)
    return t[fresh], h[fresh], p[fresh]


def fingerprints(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """The winnowed hashes of each text, one position a hash: the rows for ``blocked_pairs``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = lists(batch.column(0))
            key, count = runs(words, sizes, gram)
            offsets = np.append(0, np.cumsum(count)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64)))], ["runs"])

    counts = bucket_counts(texts.select("seq").mapInArrow(hashed, "runs array<long>"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["seq"].offsets.to_numpy())
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(part[0], len(part))
                h, n = lists(rows["h"])
                s0, s1 = sketches(h, n)
                row, key, pos = winnow(*runs(*lists(rows["seq"]), gram), counts, window)
                side = rows["side"].to_numpy(zero_copy_only=False)[row]
                yield column_rows(key, rows["cls"].take(pa.array(row)), pos, n[row], s0[row], s1[row], side)

    return texts.select("cls", "seq", "h", "side").mapInArrow(run, COLUMN_ROWS)


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds that rise in both texts."""
    best: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    for k, (_, y) in enumerate(seeds):
        at = bisect_left(best, y)
        back.append(ends[at - 1] if at else -1)
        best[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int:
    """Words matched when the chained seeds are extended in both directions."""
    x = y = matched = 0  # the first words that no earlier extension has taken
    for p, q in chain(seeds):
        if p < x or q < y or a[p] != b[q]:
            continue
        while p > x and q > y and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        while p < len(a) and q < len(b) and a[p] == b[q]:
            p, q, matched = p + 1, q + 1, matched + 1
        # A word changed between two seeds is left out; those behind it are reached
        # backwards from the next seed.
        x, y = p, q
    return matched


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for a, b, wa, wb, seeds in zip(pdf.a, pdf.b, pdf.wa, pdf.wb, pdf.seeds):
            wa, wb = wa.tolist(), wb.tolist()
            n = aligned(wa, wb, [(s["p"], s["q"]) for s in seeds])
            rows.append((a, b, n / len(wa), n / len(wb)))
        yield pd.DataFrame(rows, columns=["a", "b", "coverage_a", "coverage_b"])


def across(threshold: float) -> Keep:
    """The bounds of ``near_pairs``, and that one row has the first side and the other the second."""
    near = bounds(threshold)

    def keep(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        x, y = a["side"], b["side"]
        return (((x & 1) & (y >> 1)) | ((x >> 1) & (y & 1))).astype(bool) & near(a, b)

    return keep


def text_overlaps(
    members: DataFrame, texts: DataFrame, threshold: float, gram: int, window: int, block: int, coverage: bool, reordered: bool
) -> DataFrame:
    """Pairs of different texts of the two sides: ``a, b, likeness``, with ``coverage`` also ``coverage_a, coverage_b``."""
    keep = across(threshold)
    met = blocked_pairs(fingerprints(texts, gram, window), keep, block)
    pairs = met.select("a", "b").distinct()
    if reordered:
        products = columns_of(texts, threshold, 256).join(texts.select("cls", "side"), "cls").withColumn("tag", F.col("side"))
        pairs = pairs.unionByName(blocked_pairs(products, keep, block).select("a", "b")).distinct()
    found = alike(pairs, texts, threshold).select("a", "b", "likeness")
    if not coverage:
        return found
    found = cut(found)
    seeds = met.join(found.select("a", "b"), ["a", "b"]).groupBy("a", "b").agg(F.collect_list(F.struct("p", "q")).alias("seeds"))
    sequences = texts.select(F.col("cls").alias("a"), F.col("seq").alias("wa")), texts.select(F.col("cls").alias("b"), F.col("seq").alias("wb"))
    covered = seeds.join(sequences[0], "a").join(sequences[1], "b").mapInPandas(_align, "a binary, b binary, coverage_a double, coverage_b double")
    return found.join(covered, ["a", "b"], "left").na.fill(0.0, ["coverage_a", "coverage_b"])


def overlaps(
    records: DataFrame,
    id_col: str,
    text_col: str,
    side: Column,
    threshold: float = 0.7,
    gram: int = 3,
    window: int = 3,
    block: int = 2048,
    coverage: bool = False,
    reordered: bool = False,
) -> DataFrame:
    """Pairs of a side-0 and a side-1 record: ``id_a, id_b, likeness``, id_a < id_b; with ``coverage`` also ``coverage_a, coverage_b``.

    ``side`` is 0, 1, or null for a record of neither. Null ids, null texts and
    texts without a word have no partner; rows with the same id are one record;
    an empty table gives an empty result; other columns are not read. Pairs that only ``reordered`` finds
    have no seed and a coverage of 0.
    """
    members, texts = texts_of(records, id_col, text_col, side)
    members, texts = cut(members), cut(texts)
    found = text_overlaps(members, texts, threshold, gram, window, block, coverage, reordered)
    extra = [c for c in found.columns if c not in ("a", "b")]
    x = members.select(F.col("id").alias("x"), F.col("cls").alias("a"), F.col("side").alias("sx"))
    y = members.select(F.col("id").alias("y"), F.col("cls").alias("b"), F.col("side").alias("sy"))
    first = F.col("x") < F.col("y")
    ends = [F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "likeness"]
    swapped = [F.when(first, F.col(f"coverage_{k}")).otherwise(F.col(f"coverage_{m}")).alias(f"coverage_{k}") for k, m in ("ab", "ba")]
    different = spread_join(y, spread_join(x, found, "a", "x"), "b", "y").where("sx <> sy").select(*ends, *(swapped if coverage else []))
    # Texts with equal words have all fingerprints in common. The two sides of a text are joined with
    # each other, not all copies with all.
    both = members.join(texts.where("side = 3").select("cls"), "cls", "left_semi")
    one, other = (both.where(F.col("side") == k).select("cls", F.col("id").alias(n)) for k, n in ((0, "x"), (1, "y")))
    equal = spread_join(one, other, "cls", "x").select(*ends[:2], *(F.lit(1.0).alias(c) for c in extra))
    return different.unionByName(equal)


def partners(
    records: DataFrame, id_col: str, text_col: str, side: Column, threshold: float = 0.7, gram: int = 3, window: int = 3, block: int = 2048
) -> DataFrame:
    """``id, cls, links``: of every record of either side that has a word, the least id with its words, and the number of its partners.

    The bounded form of ``overlaps``: copies are counted, not expanded into pairs.
    """
    members, texts = texts_of(records, id_col, text_col, side)
    members, texts = cut(members), cut(texts)
    found = text_overlaps(members, texts, threshold, gram, window, block, False, False).select("a", "b")
    sizes = members.groupBy("cls").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), F.min("id").alias("least"))
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(sizes.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    # A partner of a side-0 record is a side-1 record of a class linked to its own, and the other way round.
    linked = ends.join(sizes.select(F.col("cls").alias("b"), "n0", "n1"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    linked = linked.join(sizes.select("cls", "least"), "cls")
    return spread_join(members, linked, "cls", "id").select("id", F.col("least").alias("cls"), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")).alias("links"))


def split_name(split: Column) -> Column:
    """``split`` without regard to letter case and outer blanks."""
    return F.regexp_replace(F.lower(split), r"(?U)\A\s++|(?<!\s)\s++\z", "")


def split_side(split: Column) -> Column:
    """0 for train, 1 for validation and test, else null."""
    name = split_name(split)
    return F.when(name == "train", 0).when(name.isin("validation", "test"), 1)


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and dataset of the validation and test records: records, those found in train, pairs, coverage."""
    facts = (
        records.select("id", "dataset", split_name(F.col("split")).alias("split"))
        .where("id IS NOT NULL AND split IN ('validation', 'test')")
        .groupBy("id")
        .agg(F.min("dataset").alias("dataset"), F.min("split").alias("split"))
    )
    ends = pairs.select(F.col("id_a").alias("id"), F.col("coverage_a").alias("coverage")).unionByName(
        pairs.select(F.col("id_b").alias("id"), F.col("coverage_b").alias("coverage"))
    )
    per = ends.groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.max("coverage").alias("coverage"))
    return (
        facts.join(per, "id", "left")
        .groupBy("split", "dataset")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count("pairs").alias("records_found"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
            F.round(F.avg("coverage"), 6).alias("mean_coverage"),
        )
    )
