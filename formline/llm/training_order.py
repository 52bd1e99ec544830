"""Training-order materialisation of token sequences.

Texts become ids and an end token, cut into sequences of ``length`` ids. Sequences are numbered densely (first the write
task, then the place in it, as stored), and a keyed Feistel permutation with cycle-walking gives each number its global
slot: a bijection of [0, n) that needs no sort and no table. A range of ``per_shard`` slots is one shard: a row with
the ids of its slots one after another, little-endian unsigned 16-bit, ``length`` ids for each, padded with the end token. The
sequence at a slot is therefore at byte (slot % per_shard) * length * 2 of shard slot // per_shard.

Slots are dense, so the borders of the ranges are known without a sample: ``per_file`` shards are one range, one task and one
file, whose number is that of the range, with its shards in order. Reading goes on at any slot and opens no file before it
(``read_from``, ``sequences_from``). More input gives more files of the same size.

Defined results: a null or empty text is one sequence that holds the end token alone; ids may be null or repeated, each
row is materialised by itself; an empty table gives no shards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.llm.byte_tokens import END, encode, vocabulary_files
from formline.llm.common import id_text, query, slices, table
from formline.session import scratch

LENGTH, PER_SHARD, PER_FILE, ROUNDS = 512, 512, 32, 6
SHARDS = "shard long, first_slot long, ids binary, doc_id array<long>, piece array<int>, n array<int>"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit hash."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    """A permutation of [0, 4 ** half)."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        left, right = right, left ^ (mixed(right, key) & mask)
    return left << np.uint64(half) | right


def slots(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number of [0, n); walks on along the cycle while it is outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [int(k) for k in mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64), key & (1 << 63) - 1)]
    x = feistel(numbers.astype(np.uint64), half, keys)
    while (out := x >= n).any():
        x[out] = feistel(x[out], half, keys)
    return x.astype(np.int64)


def tokenised(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """part, first (number of its first sequence within the part), doc_id, n (ids with the end token), ids (16 bit)."""
    vocabulary, merges = vocabulary_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in slices(batches, 1 << 22):
            ids = [np.append(encode(t, vocabulary, merges), END).astype("<u2") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids])
            counts = -(-sizes // length)
            first = done + np.cumsum(counts) - counts
            done += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(first, pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                                              pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "first", "doc_id", "n", "ids"])

    rows = id_text(docs).withColumn("part", F.spark_partition_id())
    return rows.mapInArrow(run, "part int, first long, doc_id long, n long, ids binary")


def materialise(docs: DataFrame, path: str, key: int, length: int = LENGTH, per_shard: int = PER_SHARD, per_file: int = PER_FILE) -> None:
    """Writes the shards of ``docs`` to ``path``."""
    spark = docs.sparkSession
    kept = scratch(spark, "tokenised")
    tokenised(docs, length).write.option("compression", "zstd").parquet(kept)
    rows = spark.read.parquet(kept)
    count = F.ceil(F.col("n") / length)
    # one row for each write task, so this window is as small as the list of files
    sizes = rows.groupBy("part").agg(F.sum(count).alias("held"))
    base = sizes.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    total = sizes.agg(F.sum("held")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(slots(number.to_numpy(), total, key))

    # broadcast: base has one row of 16 bytes for each write task, so ids need no shuffle to meet it
    each = rows.join(F.broadcast(base), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("first")).alias("number"), F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece"))
    each = each.select("doc_id", "piece", (F.col("number") + F.col("piece")).alias("number"), F.least(F.lit(length), F.col("n") - F.col("piece") * length).cast("int").alias("n"),
                       F.substring("ids", F.col("piece") * (2 * length) + 1, F.lit(2 * length)).alias("ids"))
    each = each.withColumn("slot", slot("number")).drop("number")

    pad = np.full(length, END, dtype="<u2").tobytes()

    def packed(rows: pa.Table) -> pa.RecordBatch:
        ids = b"".join((x + pad)[:2 * length] for x in rows["ids"].to_pylist())
        first = rows["slot"][0].as_py()
        return pa.RecordBatch.from_pydict({"shard": [first // per_shard], "first_slot": [first], "ids": pa.array([ids], pa.binary()),
                                           **{x: pa.array([rows[x].to_pylist()], pa.list_(rows[x].type)) for x in ("doc_id", "piece", "n")}})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slot; a shard goes out when the next one begins."""
        held: list[pa.Table] = []
        for batch in batches:
            numbers = batch.column("slot").to_numpy() // per_shard
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if held and held[-1]["slot"][0].as_py() // per_shard != numbers[low]:
                    yield packed(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
        if held:
            yield packed(pa.concat_tables(held))

    files = max(1, -(-total // (per_shard * per_file)))
    ranges = each.repartitionById(files, F.floor(F.col("slot") / (per_shard * per_file)).cast("int")).sortWithinPartitions("slot")
    ranges.mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(path)


def files_from(spark: SparkSession, path: str, shard: int, per_file: int = PER_FILE) -> list[str]:
    """The files that hold ``shard`` and those after it, in order."""
    numbered = sorted((int(re.search(r"part-(\d+)", f.rsplit("/", 1)[1])[1]), f) for f in spark.read.schema(SHARDS).parquet(path).inputFiles())
    return [f for k, f in numbered if k >= shard // per_file]


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int = PER_SHARD, per_file: int = PER_FILE) -> DataFrame:
    """The shards from the one that holds ``slot`` on, read from their files alone; in training order inside each file."""
    shard = slot // per_shard
    files = files_from(spark, path, shard, per_file)
    return (spark.read.schema(SHARDS).parquet(*files) if files else spark.createDataFrame([], SHARDS)).filter(F.col("shard") >= shard)


def sequences_from(spark: SparkSession, path: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD, per_file: int = PER_FILE) -> Iterator[tuple[int, bytes]]:
    """(slot, ids) of all sequences from ``slot`` on in training order; one file is held at a time."""
    for file in files_from(spark, path, slot // per_shard, per_file):
        for r in sorted(spark.read.schema(SHARDS).parquet(file).filter(F.col("shard") >= slot // per_shard).collect(), key=lambda r: r.shard):
            for i in range(max(0, slot - r.first_slot), len(r.n)):
                yield r.first_slot + i, bytes(r.ids[2 * length * i:2 * length * (i + 1)])


@query("op1_training_order")
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence: doc_id, piece, slot, shard, byte_offset, n_tokens (end token included), ids_crc32 (as stored, without padding)."""
    path = scratch(spark, "shards")
    materialise(table(spark, sf_dir, "documents"), path, key=20240229)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k = len(r["n"])
                stride = 2 * LENGTH
                crc = [zlib.crc32(r["ids"][i * stride:i * stride + 2 * n]) for i, n in enumerate(r["n"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(r["piece"], pa.int32()), pa.array(r["first_slot"] + np.arange(k)), pa.array([r["shard"]] * k),
                     pa.array(np.arange(k) * stride), pa.array(r["n"], pa.int32()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).mapInArrow(digest, "doc_id long, piece int, slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long")
