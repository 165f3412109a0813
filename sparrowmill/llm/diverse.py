"""A subset of a given size that covers the variety of the texts.

The subset is chosen greedily to maximise the determinant of a kernel: identity
plus ``strength`` times the inner products of the texts' hashed, idf-weighted word
vectors. A text much like one already chosen adds little to the determinant,
whatever number of such texts there is. The greedy step keeps the Cholesky factor
of the chosen rows and updates it by one column at a time.

Texts with equal word sets are one candidate. Candidates are dealt to blocks of
bounded size by hash; each block yields a core-set, twice its part of the subset.
One greedy pass goes over all core-sets together: what the chosen rows say about a
further one is held in a matrix of the size of a vector, whatever their number, and
gains only fall. So each round fetches the rows of highest gain, chooses among them
while the best gain is above all that was left behind, and sends the matrix back; the order is
that of a pass over all rows at once, for any size of the rounds. Orders are nested: a smaller
subset is the beginning of a larger one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, word_set
from .ranking import ranked, unit_hash

#: Buckets of the document counts; bounds what is sent to the workers.
COUNTS = 1 << 16
DIMENSIONS = 256
#: Coordinates a word is spread over. With one, the odd word of a near copy that
#: falls on a coordinate still free makes the copy look new.
PLACES = 4
STRENGTH = 50.0


def bucket(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))


def vectors(texts: pd.Series, counts: np.ndarray, total: int) -> np.ndarray:
    """Unit vectors of word lists, rounded to half precision, so that more of them can be held; a text without words has a zero vector."""
    n, sizes = len(texts), np.fromiter(map(len, texts), int, len(texts))
    h = bucket(list(chain.from_iterable(texts)))
    weight = np.log((1 + total) / (1 + counts[h % COUNTS])) + 1
    first, out = np.repeat(np.arange(n) * DIMENSIONS, sizes), np.zeros(n * DIMENSIONS)
    for place in range(PLACES):
        mixed = (h + np.uint32(place * 0x9E3779B9 % (1 << 32))) * np.uint32(2654435761)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
        sign = np.where(mixed >> np.uint32(31), 1.0, -1.0)
        out += np.bincount(first + (mixed >> np.uint32(8)) % DIMENSIONS, weight * sign, n * DIMENSIONS)
    out = out.reshape(n, DIMENSIONS).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float16).astype(np.float32)


def greedy(x: np.ndarray, size: int, strength: float = STRENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(rows in the order chosen, their gains in log determinant)``; ties go to the first row."""
    n, size = len(x), min(size, len(x))
    factor = np.zeros((n, size), np.float32)
    left = 1 + strength * (x * x).sum(axis=1).astype(np.float64)
    order, gains = np.empty(size, int), np.empty(size)
    for t in range(size):
        j = int(np.argmax(left))
        order[t], gains[t] = j, math.log(max(left[j], 1e-12))
        kernel = strength * (x @ x[j])
        kernel[j] += 1
        column = (kernel - factor[:, :t] @ factor[j, :t]) / math.sqrt(max(left[j], 1e-12))
        factor[:, t] = column
        left -= column.astype(np.float64) ** 2
        left[order[: t + 1]] = -np.inf
    return order, gains


def quadratic(x: np.ndarray, inverse: np.ndarray, step: int = 4096) -> np.ndarray:
    """``x' inverse x`` of each row; the gain of a row is ``log(1 + strength * x' inverse x)``."""
    parts = (x[at : at + step].astype(float, copy=False) for at in range(0, len(x), step))
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", y @ inverse, y) for y in parts)])


def decay(before: np.ndarray, after: np.ndarray) -> float:
    """The greatest share of its quadratic form in ``before`` that any vector keeps in ``after``."""
    root = np.linalg.inv(np.linalg.cholesky((before + before.T) / 2))
    kept = np.linalg.eigvalsh(root @ ((after + after.T) / 2) @ root.T)[-1]
    return min(1.0, float(kept) * (1 + 1e-6))


def proceed(
    x: np.ndarray, size: int, inverse: np.ndarray, floor: float = -np.inf, strength: float = STRENGTH, width: int = 512
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows in the order chosen, their gains, inverse)`` of a greedy pass that goes on from ``inverse``.

    ``inverse`` belongs to the identity plus ``strength`` times the sum of the outer products of the rows
    chosen before. Beyond the first row, rows are chosen while their quadratic form is above what rows elsewhere can
    have, which is ``floor`` at first and falls as ``inverse`` does. Rows are taken from the best ``width`` of the best
    eight times ``width``; the others are measured again once one of them could be the best.
    """
    inverse, left, order, gains = inverse.copy(), np.ones(len(x), bool), [], []
    size = min(size, len(x))
    # Half precision is slow to read again and again.
    x = x.astype(float if len(x) <= 1 << 14 else np.float32)

    def few(rows: np.ndarray, floor: float) -> None:
        """Chooses at least one of ``rows``, and more while they are above ``floor``."""
        y = x[rows].astype(float)
        ahead = y @ inverse
        kernel = ahead @ y.T
        value, most = np.diag(kernel).copy(), min(len(rows), size - len(order))
        factor, sides = np.zeros((len(rows), most)), np.zeros((most, y.shape[1]))
        for t in range(most):
            j = int(np.argmax(value))
            if t and value[j] <= floor:
                break
            scale = 1 + strength * value[j]
            order.append(rows[j])
            gains.append(math.log(scale))
            share = math.sqrt(strength / scale)
            own = factor[j, :t].copy()
            factor[:, t] = (kernel[:, j] - factor[:, :t] @ own) * share
            sides[t] = (ahead[j] - own @ sides[:t]) * share
            value -= factor[:, t] ** 2
            value[j] = -np.inf
            left[rows[j]] = False
        inverse[:] -= sides.T @ sides

    def some(rows: np.ndarray, floor: float, widths: list[int]) -> None:
        """The same for any number of rows: the best of them go first, against the best of the others."""
        if not widths:
            return few(rows, floor)
        start, began, bound, done = inverse.copy(), len(order), floor, len(order)
        while len(order) < size and len(rows := rows[left[rows]]):
            value = quadratic(x[rows], inverse)
            top = value.max()
            # Fewer rows than there are coordinates leave some vector as it is.
            if top <= bound and len(order) - done >= x.shape[1]:
                bound, done = floor * decay(start, inverse), len(order)
            if top <= bound and len(order) > began:
                return
            best = np.lexsort((rows, -value))
            out = max(bound, value[best[widths[0]]]) if len(rows) > widths[0] else bound
            some(np.sort(rows[best[: widths[0]]]), out, widths[1:])

    if size:
        some(np.arange(len(x)), floor, [8 * width, width])
    return np.array(order, int), np.array(gains), inverse


#: Bits of a value that its level leaves out; a level is one in 1,024 of a power of two.
FINE = 42


def levels(value: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values, none of which is below zero."""
    return np.maximum(value, 0.0).view(np.int64) >> FINE


#: A key holds the number of a block above the place in its core-set.
PLACE = 24


def unpacked(block: int, blob: bytes, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, places, vectors)`` of a core-set, without the keys in ``done``, which are sorted."""
    x = np.frombuffer(blob, np.float16).reshape(-1, DIMENSIONS)
    key = (block << PLACE) + np.arange(len(x))
    gone = done[slice(*np.searchsorted(done, [block << PLACE, (block + 1) << PLACE]))] - (block << PLACE)
    at = np.delete(np.arange(len(x)), gone)
    return key[at], at, x[at]


def chosen(cores: DataFrame, size: int, work: int) -> DataFrame:
    """``key, place, gain`` of the first ``size`` rows of a greedy pass over ``cores`` (``block, ids, x``).

    The driver holds ``work`` vectors at a time, and the keys and gains of the rows chosen. A round counts the rows by
    value first, so that only those that go to the driver are moved.
    """
    inverse = np.eye(DIMENSIONS)
    keys, gains = np.empty(0, np.int64), np.empty(0)
    kind = dict(cores.dtypes)["ids"][6:-1]
    while len(keys) < size:
        done = np.sort(keys)

        def counted(batches: Iterator[pa.RecordBatch], done: np.ndarray = done, inverse: np.ndarray = inverse) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, blob in zip(batch["block"].to_pylist(), batch["x"]):
                    _, _, x = unpacked(block, blob.as_buffer(), done)
                    level, n = np.unique(levels(quadratic(x, inverse)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], ["level", "n"])

        seen = cores.select("block", "x").mapInArrow(counted, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toArrow()
        if not seen.num_rows:
            break
        level, n = seen["level"].to_numpy(), seen["n"].to_numpy()
        down = np.argsort(-level)
        level, fits = level[down], int(np.searchsorted(np.cumsum(n[down]), work, side="right"))
        least = level[max(fits, 1) - 1]

        def measured(
            batches: Iterator[pa.RecordBatch], done: np.ndarray = done, inverse: np.ndarray = inverse, least: int = least
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, blob in zip(batch["block"].to_pylist(), batch["ids"], batch["x"]):
                    key, at, x = unpacked(block, blob.as_buffer(), done)
                    value = quadratic(x, inverse)
                    near = np.flatnonzero(levels(value) >= least)
                    if len(near):
                        some = [pa.array(key[near]), ids.values.take(pa.array(at[near])), pa.array([row.tobytes() for row in x[near]]), pa.array(value[near])]
                        yield pa.RecordBatch.from_arrays(some, ["key", "id", "x", "value"])

        near = cores.mapInArrow(measured, f"key long, id {kind}, x binary, value double")
        if fits:
            # All rows elsewhere are below the least level here.
            top, floor = near.toArrow(), np.int64(least << FINE).view(np.float64) if fits < len(level) else -np.inf
        else:
            top = near.orderBy(F.desc("value"), "id").limit(work + 1).toArrow()
            floor = top["value"][work].as_py() if top.num_rows > work else -np.inf
            top = top.slice(0, work)
        # Ties go to the least id, whatever the round.
        top = top.select(["key", "id", "x"]).sort_by("id")
        x = np.empty((top.num_rows, DIMENSIONS), np.float16)
        for k, blob in enumerate(top["x"]):
            x[k] = np.frombuffer(blob.as_buffer(), np.float16)
        more, gain, inverse = proceed(x, size - len(keys), inverse, floor)
        keys, gains = np.append(keys, top["key"].to_numpy()[more]), np.append(gains, gain)
    rows = pa.table({"key": keys, "place": np.arange(len(keys)), "gain": gains})
    return cores.sparkSession.createDataFrame(rows)


def choose(
    records: DataFrame, id_col: str, text_col: str, plans: DataFrame, block: int = 2048, spare: float = 2.0, work: int = 65536
) -> DataFrame:
    """``plan_id, id, rank, gain`` of each plan's subset, of exactly ``share`` of the distinct ids.

    ``plans`` is ``plan_id, share``. Rows with the same id are one record, null
    ids none. Records without a word and further records with the words of a candidate
    come last, so the size holds as long as there are records. An empty table or no
    plan gives an empty result; other columns are not read.
    """
    one = (
        records.select(F.col(id_col).alias("id"), word_set(F.col(text_col)).alias("words"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("words").alias("words"))
    )
    one = cut(one.select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    texts = cut(one.where("size(words) > 0").groupBy("words").agg(F.min("id").alias("id")))
    n, total = texts.count(), one.count()
    plan = plans.groupBy("plan_id").agg(F.max("share").alias("share"))
    largest = plan.agg(F.max("share")).first()[0] or 0.0
    # At most COUNTS numbers, whatever the size of the table.
    crc = F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(COUNTS)).cast("int")
    rows = texts.select(F.explode("words").alias("w")).groupBy(crc.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    counts = np.zeros(COUNTS)
    for r in rows:
        counts[r["b"]] = r["c"]
    wanted = min(1.0, spare * largest * total / max(n, 1))

    def core(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = vectors(pdf.words, counts, n)
        order, _ = greedy(x, math.ceil(wanted * len(pdf)))
        return pd.DataFrame({"block": pdf.block[:1].to_numpy(), "ids": [pdf.id.to_numpy()[order]], "x": [x[order].astype(np.float16).tobytes()]})

    kind = dict(one.dtypes)["id"]
    blocks = max(1, math.ceil(n / block))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)))
    cores = cut(dealt.groupBy("block").applyInPandas(core, f"block long, ids array<{kind}>, x binary"))
    quota = plan.select("plan_id", F.round(F.col("share") * total).cast("long").alias("quota"))
    size = quota.agg(F.max("quota")).first()[0] or 0
    keyed = cores.select("block", F.posexplode("ids").alias("at", "id")).select((F.shiftleft("block", PLACE) + F.col("at")).alias("key"), "id")
    gained = keyed.join(chosen(cores, size, work), "key").drop("key")
    rest = F.when(F.size("words") > 0, -1.0).otherwise(-2.0)
    every = cut(one.join(gained, "id", "left").select("id", "place", F.coalesce("gain", rest).alias("gain")))
    # Rows beyond those chosen follow by hash.
    u = unit_hash(F.col("id"), F.lit(6))
    place = F.when(F.col("place").isNotNull(), 0.5 * F.col("place") / F.lit(float(max(size, 1)))).otherwise(
        F.when(F.col("gain") > -1.5, 0.5 + 0.25 * u).otherwise(0.75 + 0.25 * u)
    )
    spread = every.withColumn("_place", place).crossJoin(F.broadcast(quota.select("plan_id")))
    return ranked(spread, ["plan_id"], F.col("_place"), ["_place", "id"], quota).select("plan_id", "id", "rank", "gain")
