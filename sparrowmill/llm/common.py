"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that stand for the counts of hashed values; bounds what is sent to the driver and the workers.
BUCKETS = 1 << 18
#: A word is a maximal run of letters or digits.
WORD = r"[\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_sequence(text: Column) -> Column:
    """The words of a text in order, in lower case; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    """The distinct words of a text, sorted; null for a null text."""
    return F.sort_array(F.array_distinct(word_sequence(text)))


def digest(value: Column) -> Column:
    """16 bytes that stand for a string."""
    return F.unhex(F.md5(value.cast("binary")))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the cluster's checkpoint folder and read it from there.

    The folder is the one named in ``spark.checkpoint.dir``, shared by all
    executors, so that the loss of one loses no data. Where that setting is
    missing, a folder of this machine is used in local mode, and a cluster raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", least: int = 4096, share: int = 8192) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which ``left`` may hold very many rows.

    A key of more than ``least`` rows and more than one in ``share`` of all rows is
    cut into parts by the hash of the column ``by``, and the rows of ``right`` go to each
    part. There are fewer than ``share`` such keys, so that their list may be
    broadcast. Rows with a null key find nothing and are spread likewise. ``how`` is inner or left.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = F.broadcast(counts.agg(F.greatest(F.lit(least), F.ceil(F.coalesce(F.sum("_n"), F.lit(0)) / share)).alias("_limit")))
    hot = counts.where(F.col(key).isNotNull() & (F.col("_n") > least)).crossJoin(limit).where("_n > _limit")
    parts = F.broadcast(hot.select(key, F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_parts")))
    place = F.xxhash64(by, F.lit(29))
    spread = left.join(parts, key, "left").withColumn(
        "_part", F.pmod(place, F.when(F.col(key).isNull(), share).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    )
    copies = right.join(parts, key, "left").withColumn("_part", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)")))
    return spread.drop("_parts").join(copies.drop("_parts"), [key, "_part"], how).drop("_part")


def pairs_by_key(df: DataFrame, key: str, order: str, block: int, keep: Column | None = None) -> DataFrame:
    """All unordered pairs of rows with an equal ``key``, as columns ``a_*`` and ``b_*``.

    A key of one row yields nothing and is dropped before the join. Rows of a
    key held by at most ``block`` rows are joined on the key. A hotter key is
    cut into blocks of about ``block`` rows and each pair of blocks becomes a
    join key of its own, so that no task sees more than two blocks at once and
    nothing is dropped. ``keep`` is a condition over the ``a_*`` and ``b_*``
    columns that becomes part of the join. ``order`` is a column that differs
    between the rows of a key; the row with the lower value is ``a``.
    """
    names = [c for c in df.columns if c != key]

    def side(rows: DataFrame, tag: str, *extra: str) -> DataFrame:
        return rows.select(key, *extra, *(F.col(c).alias(f"{tag}_{c}") for c in names))

    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    sized = df.where(F.col(key).isNotNull()).join(size, key)
    met = F.col(f"a_{order}") < F.col(f"b_{order}")
    ends = [f"{t}_{c}" for t in "ab" for c in names]

    cold = sized.where(F.col("_rows") <= block)
    few = side(cold, "a").join(side(cold, "b"), key).where(met if keep is None else met & keep)

    hot = (
        sized.where(F.col("_rows") > block)
        .withColumn("_blocks", F.ceil(F.col("_rows") / F.lit(block)).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64(order, F.lit(17)), F.col("_blocks")).cast("int"))
    )
    left = hot.withColumn("_i", F.col("_block")).withColumn("_j", F.explode(F.expr("sequence(_block, _blocks - 1)")))
    right = hot.withColumn("_j", F.col("_block")).withColumn("_i", F.explode(F.expr("sequence(0, _block)")))
    crossed = side(left, "x", "_i", "_j").join(side(right, "y", "_i", "_j"), [key, "_i", "_j"])
    crossed = crossed.where(
        ((F.col("_i") < F.col("_j")) & (F.col(f"x_{order}") != F.col(f"y_{order}")))
        | (F.col(f"x_{order}") < F.col(f"y_{order}"))
    )
    first = F.col(f"x_{order}") < F.col(f"y_{order}")
    many = crossed.select(
        key,
        *(F.when(first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"a_{c}") for c in names),
        *(F.when(first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}")).alias(f"b_{c}") for c in names),
    )
    many = many if keep is None else many.where(keep)
    return few.select(key, *ends).unionByName(many.select(key, *ends))


# --- work on Arrow batches ----------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters their bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(all values, length of each list)`` of a column of lists of longs without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(column.offsets.to_numpy())


def within(sizes: np.ndarray) -> np.ndarray:
    """The place of each value in its list, from 0."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits of each list of hashes, of which none is empty: every hash flips one of them."""
    bit, upper = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) & np.uint64(1)
    start = np.cumsum(sizes) - sizes
    return tuple(np.bitwise_xor.reduceat(np.where(upper == half, bit, np.uint64(0)), start) for half in (0, 1))


def bucket_counts(df: DataFrame, column: str) -> np.ndarray:
    """How many values of an array column of hashes fall into each of ``BUCKETS`` buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            values, _ = lists(batch.column(0))
            total += np.bincount((values & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = df.select(column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


#: Which pairs stay, from the facts ``n, s0, s1, side, own`` of both rows; the two sides are of equal shape, or a column and a line.
Keep = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]
#: ``size`` holds a row's place in the upper and its number of words in the lower 32 bits, ``tag`` its side in two bits below its part.
_FACTS = [("key", "long"), ("cls", "binary"), ("size", "long"), ("s0", "long"), ("s1", "long"), ("tag", "int")]
COLUMN_ROWS = ", ".join(f"{c} {t}" for c, t in _FACTS)


def column_rows(key: np.ndarray, cls: pa.Array, pos: np.ndarray, n: np.ndarray, s0: np.ndarray, s1: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
    """Rows for ``blocked_pairs``."""
    size = (pos.astype(np.int64) << 32) | n.astype(np.int64)
    made = [pa.array(x) for x in (key.view(np.int64), size, s0.view(np.int64), s1.view(np.int64), side.astype(np.int32))]
    return pa.RecordBatch.from_arrays([made[0], cls, *made[1:]], [c for c, _ in _FACTS])


def _met(rows: DataFrame, keep: Keep, block: int) -> DataFrame:
    """The pairs of rows in blocks of up to ``block``, as ``a, b, p, q``; rows of longer blocks are returned as they are."""
    arrow = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("p", pa.int32()), ("q", pa.int32()), *((c, arrow[t]) for c, t in _FACTS)])

    def aside(held: pa.Table) -> list[pa.RecordBatch]:
        gap = [pa.nulls(len(held), f.type) for f in list(schema)[:4]]
        return pa.Table.from_arrays(gap + [held[c] for c, _ in _FACTS], schema=schema).to_batches()

    def crossed(held: pa.Table) -> Iterator[pa.RecordBatch]:
        key = held["key"].to_numpy()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
        size = np.diff(np.append(first, len(key)))
        if (size > block).any():
            yield from aside(held.filter(pa.array(np.repeat(size > block, size))))
        rows_of, size = size, np.where(size > block, 0, size)
        if not (size > 1).any():
            return
        cls = held["cls"].combine_chunks()
        ends = np.frombuffer(cls.buffers()[2], ">u8").reshape(-1, 2)[cls.offset : cls.offset + len(cls)]
        packed, tag = held["size"].to_numpy(), held["tag"].to_numpy()
        pos = (packed >> 32).astype(np.int32)
        facts = {c: held[c].to_numpy().view(np.uint64) for c in ("s0", "s1")}
        facts |= {"n": (packed & 0xFFFFFFFF).astype(np.float32), "side": (tag & 3).astype(np.int8), "own": tag >> 2}

        def stay(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
            kept = keep(a, b)
            return kept & ((a["own"] == 0) | (a["own"] != b["own"])) if facts["own"].any() else kept

        def small(rows: np.ndarray, behind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Row r meets those behind it in its block, about a million pairs at a time."""
            total = np.cumsum(behind)
            for part in np.split(np.arange(len(rows)), np.searchsorted(total, np.arange(1 << 20, total[-1], 1 << 20)) if len(total) else []):
                x = np.repeat(rows[part], behind[part])
                y = x + 1 + within(behind[part])
                near = stay({c: v[x] for c, v in facts.items()}, {c: v[y] for c, v in facts.items()})
                yield x[near], y[near]

        def large(lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Some rows of a block meet all from them on as a matrix that fits the cache."""
            step = max(1, (1 << 17) // (hi - lo))
            for at in range(lo, hi, step):
                end = min(hi, at + step)
                x, y = np.nonzero(stay({c: v[at:end, None] for c, v in facts.items()}, {c: v[None, at:hi] for c, v in facts.items()}))
                yield x[y > x] + at, y[y > x] + at

        def output(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            above = (ends[x, 0] > ends[y, 0]) | ((ends[x, 0] == ends[y, 0]) & (ends[x, 1] > ends[y, 1]))
            same = (ends[x] == ends[y]).all(axis=1)
            x, y = np.where(above, y, x)[~same], np.where(above, x, y)[~same]
            gap = [pa.nulls(len(x), f.type) for f in list(schema)[4:]]
            made = [cls.take(pa.array(x)), cls.take(pa.array(y)), pa.array(pos[x]), pa.array(pos[y])]
            return pa.RecordBatch.from_arrays(made + gap, schema=schema)

        wide = size > 64
        behind = np.maximum(np.repeat(np.where(wide, 0, size), rows_of) - within(rows_of) - 1, 0)
        ahead = np.flatnonzero(behind)
        sources = chain([small(ahead, behind[ahead])], (large(lo, lo + m) for lo, m in zip(first[wide].tolist(), size[wide].tolist())))
        xs, ys, waiting = [], [], 0
        for x, y in chain.from_iterable(sources):
            if len(x):
                xs, ys, waiting = [*xs, x], [*ys, y], waiting + len(x)
            if waiting > 10_000:
                yield output(np.concatenate(xs), np.concatenate(ys))
                xs, ys, waiting = [], [], 0
        if waiting:
            yield output(np.concatenate(xs), np.concatenate(ys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot = None  # the key of a block that is being set aside
        for batch in batches:
            if not batch.num_rows:
                continue
            if hot is not None:
                end = int(np.searchsorted(batch["key"].to_numpy(), hot, side="right"))
                yield from aside(pa.Table.from_batches([batch.slice(0, end)]))
                batch = batch.slice(end)
                if not batch.num_rows:
                    continue
                hot = None
            held.append(batch)
            last = batch["key"][-1].as_py()
            if held[0]["key"][0].as_py() != last:
                rows = pa.Table.from_batches(held)
                open_at = int(np.searchsorted(rows["key"].to_numpy(), last))
                yield from crossed(rows.slice(0, open_at).combine_chunks())
                held = rows.slice(open_at).combine_chunks().to_batches()
            if sum(b.num_rows for b in held) > block:
                yield from aside(pa.Table.from_batches(held))
                held, hot = [], last
        if held:
            yield from crossed(pa.Table.from_batches(held).combine_chunks())

    ordered = rows.select(*(c for c, _ in _FACTS)).repartition("key").sortWithinPartitions("key")
    return cut(ordered.mapInArrow(run, "a binary, b binary, p int, q int, " + COLUMN_ROWS))


def blocked_pairs(df: DataFrame, keep: Keep, block: int) -> DataFrame:
    """The pairs of rows of ``df`` with an equal ``key`` that are kept: ``a, b, p, q``, where a < b.

    ``df`` is made of ``column_rows``, with ``cls`` of 16 bytes. Rows are sorted by key
    and the blocks of up to ``block`` rows are crossed by whole arrays; ``keep`` tells from the facts of both rows
    which pairs stay. A longer block is dealt to parts of about ``block`` rows, and each pair of
    parts becomes a block of its own, so that no task holds more than two parts at once and nothing is dropped. ``p`` and ``q`` are
    the places in a and b.
    """
    ends, facts = ["a", "b", "p", "q"], [c for c, _ in _FACTS]
    met = _met(df, keep, block)
    cold, hot = met.where("b IS NOT NULL").select(*ends), met.where("b IS NULL").select(*facts)
    if hot.isEmpty():
        return cold
    parts = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("cls", F.lit(31)), F.col("parts")).cast("int")
    dealt = spread_join(hot, parts, "key", "cls").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    # Within one part all rows meet, otherwise only those of different parts.
    cells = dealt.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).withColumn(
        "tag", F.when(F.col("own") == F.col("other"), F.col("tag")).otherwise(F.shiftleft(F.col("own") + 1, 2) + F.col("tag"))
    )
    return cold.unionByName(_met(cells, keep, 1 << 40).select(*ends))
