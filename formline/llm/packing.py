"""Packs token pieces into sequences of fixed capacity by the sum-of-squares rule.

Each piece goes where the sum, over all residual gaps, of the squared number of open sequences with that gap becomes
smallest; ties go to the tightest gap. Pieces come largest first. Sequences that are left with a gap above
``slack`` are then opened again and their pieces placed best-fit, largest first, where that takes fewer sequences.

Pieces are dealt evenly by a hash of their stored row number into groups of about ``group_rows``, and each group is packed by
itself; what that costs is part of one sequence a group.

Defined results: a null text is empty and gives one piece (the end token alone); ids may be null or repeated, each row is
packed by itself; an empty table gives no pieces. Texts of more than ``capacity`` ids are cut, the first piece
being the shorter one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.byte_tokens import encode, vocabulary_files
from formline.llm.common import id_text, query, slices, table
from formline.session import stored

CAPACITY = 2048


def piece_lengths(n: int, capacity: int) -> list[int]:
    k = -(-n // capacity)
    return [n - capacity * (k - 1)] + [capacity] * (k - 1)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence number of each piece; pieces are taken in the given order."""
    open_ = np.zeros(capacity + 1, dtype=np.int64)  # sequences by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        if size < capacity:
            n = open_[size:capacity]
            change = np.where(n > 0, 2 * (open_[:capacity - size] - n) + 2, 1 << 60)
            if n[0]:
                change[0] = 1 - 2 * n[0]  # it becomes full and is open no more
            j = int(change.argmin())
            if change[j] <= 2 * open_[capacity - size] + 1:
                where[i] = b = stacks[size + j].pop()
                open_[size + j] -= 1
                if j:
                    open_[j] += 1
                    stacks[j].append(b)
                continue
            open_[capacity - size] += 1
            stacks[capacity - size].append(used)
        where[i] = used
        used += 1
    return where


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    open_ = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), dtype=np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        fits = open_[size:] > 0
        j = int(fits.argmax())
        if fits[j]:
            b = stacks[size + j].pop()
            open_[size + j] -= 1
            gap = j
        else:
            b, gap, used = used, capacity - size, used + 1
        where[i] = b
        if gap:
            open_[gap] += 1
            stacks[gap].append(b)
    return where


def pack(lengths: np.ndarray, capacity: int, slack: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number (dense) and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    where = sum_of_squares(sizes, capacity)
    fill = np.bincount(where, weights=sizes)
    loose = fill < capacity * (1 - slack)
    mine = loose[where]
    if mine.any():
        again = best_fit(sizes[mine], capacity)
        if again.max() + 1 < loose.sum():
            where[mine] = again + len(fill)
    where = np.unique(where, return_inverse=True)[1]
    by_sequence = np.argsort(where, kind="stable")
    before = np.cumsum(sizes[by_sequence]) - sizes[by_sequence]
    heads = np.searchsorted(where[by_sequence], np.arange(where.max(initial=-1) + 1))
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    sequence[order] = where
    offset[order[by_sequence]] = before - before[heads][where[by_sequence]]
    return sequence, offset


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit, if asked for)."""
    vocabulary, merges = vocabulary_files()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 22):
            rows: list[tuple] = []
            blobs: list[bytes] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text, vocabulary, merges), np.uint32(end)).astype("<u4")
                start = 0
                for piece, size in enumerate(piece_lengths(len(ids), capacity)):
                    blob = ids[start:start + size].tobytes()
                    rows.append((doc, piece, start, size, zlib.crc32(blob)))
                    if keep_ids:
                        blobs.append(blob)
                    start += size
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)] + ([pa.array(blobs, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def packed(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = 16384, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset."""
    pieces = stored(token_pieces(docs, capacity, keep_ids=keep_ids).withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid", ignore_index=True)  # the same result however the rows arrive
        sequence, offset = pack(group["length"].to_numpy(), capacity)
        group["sequence_id"] = sequence + (group["grp"].to_numpy() << 32)
        group["offset"] = offset
        return group.drop(columns=["grp", "rid"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long," + "ids binary," * keep_ids + "sequence_id long, offset long"
    return pieces.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups))).groupBy("grp").applyInPandas(place, schema)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
