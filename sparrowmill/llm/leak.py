"""Passages of held-out items inside a corpus.

A passage is a run of ``length`` consecutive words of an item; texts are first brought to
the form in which what looks the same is equal. Every passage-sized window of
every item and document is embedded by a random walk (CGK): a pointer passes
over the window and at each step the word under it is written
out, then the pointer moves on or stays, by one random bit drawn for that step and
word. Windows at a small edit distance get outputs at a small Hamming distance.
Each repetition has a walk of its own and samples a few positions of its output, and
windows whose samples agree are candidates (bit-sampling LSH). How often a
passage with ``max_edits`` edits agrees with itself is measured by simulation, and from it
follows the number of repetitions that reaches the recall wanted. Windows without an edit agree
in every repetition, so that ``max_edits = 0`` needs one and misses nothing.

The keys of the items set bits in a map of fixed size, and windows of documents without a bit go no further. What
is left carries its words, and each candidate is verified where it was met: the edit distance between
the item's passage and the best run of words of the document around the window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lists, mixed, spread_join, within, word_sequence
from .fold import fold

#: Bits of the map of item keys; bounds what is sent to the workers (a byte each).
BITS = 1 << 22
#: Sampled positions of a walk.
SAMPLED = 5
_PAD = np.uint64(0x9E3779B97F4A7C15)


def walks(repeats: int, length: int, seed: int = 11) -> list[np.ndarray]:
    """The sampled positions of each repetition, from the steps in which a walk seldom leaves its window."""
    rng = np.random.default_rng(seed)
    steps = 3 * length // 2
    return [np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)) for _ in range(repeats)]


def sample_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, positions: np.ndarray, seed: int) -> np.ndarray:
    """The LSH key of the window that begins at each ``start``; behind ``end`` there is padding."""
    at = start.copy()
    key = np.full(len(start), seed, np.uint64)
    wanted = set(positions.tolist())
    for step in range(int(positions[-1]) + 1):
        word = np.where(at < end, words[np.minimum(at, len(words) - 1)], _PAD)
        if step in wanted:
            key = mixed(key * np.uint64(0x100000001B3) ^ word)
        bit = mixed(word + np.uint64((seed * 1000003 + step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)
        at += bit.astype(np.int64)
    return key


def edited(rng: np.random.Generator, words: np.ndarray, edits: int) -> np.ndarray:
    """A copy with so many words changed, inserted or left out."""
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(out))), int(rng.integers(3))
        out[at : at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
    return np.array(out, np.uint64)


def plan(length: int, max_edits: int, recall: float, trials: int = 2000) -> list[np.ndarray]:
    """The sampled positions of as many repetitions as reach ``recall`` for passages with ``max_edits`` edits."""
    if max_edits == 0:
        return walks(1, length)
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(trials):
        passage, tail = rng.integers(1, 1 << 62, length).astype(np.uint64), rng.integers(1, 1 << 62, (2, 2 * length)).astype(np.uint64)
        pairs.append((np.append(passage, tail[0]), np.append(edited(rng, passage, max_edits), tail[1])))
    x, y = (np.concatenate(side) for side in zip(*pairs))
    nx, ny = (np.cumsum([len(s) for s in side]) for side in zip(*pairs))
    most = 256
    met = np.zeros(trials, bool)
    for k, chosen in enumerate(walks(most, length)):
        one = sample_keys(x, np.append(0, nx[:-1]), nx, chosen, k + 1)
        met |= one == sample_keys(y, np.append(0, ny[:-1]), ny, chosen, k + 1)
        # One more than seems enough: the simulation is a sample itself.
        if met.mean() >= recall:
            return walks(min(most, k + 2), length)
    raise ValueError("the recall cannot be reached with so many edits in so short a passage")


def windows(rows: DataFrame, length: int, spare: int, positions: list[np.ndarray], marked: np.ndarray | None, pad: int) -> DataFrame:
    """``id, key, w``: the windows of each row (``id, hashes``), their keys, and their words with ``spare`` before and twice as many behind.

    Only windows whose key's bit is ``marked`` are returned, and each once a row.
    """
    width = length + 3 * spare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["hashes"].offsets.to_numpy())
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // 500_000)) + 1):
                if not len(part):
                    continue
                piece = batch.slice(part[0], len(part))
                words, size = lists(piece["hashes"])
                count = np.maximum(size - (length - spare) + 1, 0)
                owner = np.repeat(np.arange(len(part)), count)
                begin, stop = np.cumsum(size) - size, np.cumsum(size)
                start = begin[owner] + within(count)
                for k, chosen in enumerate(positions):
                    key = sample_keys(words, start, stop[owner], chosen, k + 1)
                    kept = np.flatnonzero(marked[(key & np.uint64(BITS - 1)).astype(np.int64)]) if marked is not None else np.arange(len(key))
                    if not len(kept):
                        continue
                    at = start[kept, None] + np.arange(-spare, width - spare)
                    inside = (at >= begin[owner[kept], None]) & (at < stop[owner[kept], None])
                    w = np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(pad))
                    whole = np.zeros(len(kept), np.uint64)
                    for c in range(width):
                        whole = mixed(whole * np.uint64(3) ^ w[:, c])
                    _, first = np.unique(np.stack([owner[kept].astype(np.uint64), key[kept], whole]), axis=1, return_index=True)
                    offsets = np.arange(0, (len(first) + 1) * width, width, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece["id"].take(pa.array(owner[kept][first])),
                            pa.array(key[kept][first].view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(offsets), pa.array(w[first].reshape(-1).view(np.int64))),
                        ],
                        ["id", "key", "w"],
                    )

    return rows.mapInArrow(run, "id long, key long, w array<long>")


def marks(keys: DataFrame) -> np.ndarray:
    """Which of ``BITS`` bits the keys set."""
    bits = keys.select(F.col("key").bitwiseAND(BITS - 1).cast("int").alias("bit")).distinct().toArrow()
    marked = np.zeros(BITS, bool)
    marked[bits["bit"].to_numpy()] = True
    return marked


def distances(passages: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The edit distance between each passage and the best run of words of the row beside it."""
    row = np.zeros((len(passages), around.shape[1] + 1), np.int16)
    for i in range(passages.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(around.shape[1]):
            changed = row[:, j] + (passages[:, i] != around[:, j])
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, changed)
        row = new
    return row.min(axis=1)


def leaks(
    documents: DataFrame,
    doc_id: str,
    doc_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    length: int = 12,
    max_edits: int = 0,
    recall: float = 0.95,
) -> DataFrame:
    """``doc_id, item_id`` of each document that holds a passage of an item, with up to ``max_edits`` words changed, inserted or left out.

    Null texts and items of fewer than ``length`` words hold and are held by
    nothing; repeated rows count once; empty tables give an empty result;
    other columns, of whatever name, are not read. Exact for ``max_edits = 0``,
    otherwise complete with about the probability ``recall`` for each passage. Words are compared by 64-bit hashes.
    """
    if not 0 <= max_edits < length:
        raise ValueError("fewer edits than words")
    positions = plan(length, max_edits, recall)

    def words(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
        folded = fold(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text")
        hashes = F.transform(word_sequence(F.col("folded")), lambda w: F.xxhash64(w))
        return folded.select("id", hashes.alias("hashes")).where(f"id IS NOT NULL AND size(hashes) >= {least}")

    i = cut(windows(words(items, item_id, item_text, length), length, 0, positions, None, 1).select(F.col("id").alias("i"), "key", F.col("w").alias("wi")))
    found = windows(words(documents, doc_id, doc_text, length - max_edits), length, max_edits, positions, marks(i), 2)
    d = cut(found.select(F.col("id").alias("d"), "key", F.col("w").alias("wd")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                wi, wd = (lists(batch[c])[0].reshape(batch.num_rows, -1) for c in ("wi", "wd"))
                near = (wi == wd).all(axis=1) if max_edits == 0 else distances(wi, wd) <= max_edits
                yield batch.select(["d", "i"]).filter(pa.array(near))

    met = spread_join(d, i, "key", "d").select("d", "i", "wi", "wd")
    return met.mapInArrow(verify, "d long, i long").distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def leaked_items(found: DataFrame, items: DataFrame, item_id: str, doc_id: str) -> DataFrame:
    """Every item with the number of documents that hold a passage of it."""
    per = found.groupBy(item_id).agg(F.count(doc_id).alias("documents"))
    return (
        items.select(item_id).distinct().join(per, item_id, "left")
        .select(item_id, F.coalesce("documents", F.lit(0)).alias("documents"), F.col("documents").isNotNull().alias("leaked"))
    )
