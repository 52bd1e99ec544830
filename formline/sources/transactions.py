"""Transactional tables (S08, S12): a Python data source whose tasks report row hashes and whose driver publishes by one pointer.

``<base>/data`` holds files that no reader looks for by itself. A task writes one file and sends its name, rows and row hashes as its commit message; when
all tasks have succeeded the driver writes a manifest (all files of the version, row count, fingerprint, the version before) and then
moves the pointer ``<base>/_latest``, a file of one line, onto it. A job that fails, or a driver that dies before the move, leaves
the earlier version in place: its files are in no manifest. The frame is computed once; the fingerprint needs no second pass.

``mode("overwrite")`` publishes the new rows alone, ``mode("append")`` those of the version before as well, without reading them. Readers follow the
pointer once and then read plain Parquet files, so Spark prunes and pushes down as ever. Writers that race end in one order of pointers; an append that
finds another version published meanwhile fails rather than losing it. A pointer is moved by rename, which the file system must do as one step.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MASK = (1 << 64) - 1


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _read_text(path: str) -> str | None:
    where, at = _open(path)
    if where.get_file_info(at).type != fs.FileType.File:
        return None
    with where.open_input_stream(at) as f:
        return f.read().decode()


def _publish(path: str, text: str) -> None:
    """The text under ``path`` in one step: written beside it and moved."""
    where, at = _open(path)
    where.create_dir(at.rpartition("/")[0])
    beside = f"{at}.{uuid.uuid4().hex}"
    with where.open_output_stream(beside) as f:
        f.write(text.encode())
    where.move(beside, at)


def _values(column: pa.Array) -> np.ndarray:
    """A column's values as numbers or texts to be hashed; what stands at nulls is of no account."""
    kind = column.type
    if pa.types.is_floating(kind):
        return pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    if pa.types.is_temporal(kind):
        wide = column.cast(pa.int32()).cast(pa.int64()) if pa.types.is_date32(kind) else column.cast(pa.int64())
        return pc.fill_null(wide, 0).to_numpy(zero_copy_only=False)
    if pa.types.is_nested(kind):
        return np.array([json.dumps(v, default=str, sort_keys=True) for v in column.to_pylist()], dtype=object)
    if pa.types.is_decimal(kind):
        column = column.cast(pa.string())
    return np.array(["" if v is None else v for v in column.to_pylist()], dtype=object)


def row_hashes(rows: pa.RecordBatch) -> np.ndarray:
    """A 64-bit hash of each row's values, the same wherever the row lies. Nulls differ from every value; nested values count by their text."""
    total = np.zeros(rows.num_rows, dtype=np.uint64)
    for name, column in zip(rows.schema.names, rows.columns):
        own = pd.util.hash_array(_values(column), categorize=False)
        own[pc.is_null(column).to_numpy(zero_copy_only=False)] = 1
        # columns are mixed by their name, so that swapped values differ
        mark = np.uint64(int.from_bytes(hashlib.md5(name.encode()).digest()[:8], "little") | 1)
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own * mark
    return total


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: sums of row hashes do not depend on the order or the split of the rows."""

    file: str | None
    rows: int
    total: int
    xor: int


class Writer(DataSourceArrowWriter):
    def __init__(self, base: str, schema: StructType, overwrite: bool) -> None:
        self.base, self.schema, self.overwrite = base, schema, overwrite
        self.version = uuid.uuid4().hex
        self.before = _read_text(f"{base}/_latest")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, sink, rows, total, xor = f"{self.version}-{uuid.uuid4().hex}.parquet", None, 0, 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    where, at = _open(f"{self.base}/data/{name}")
                    where.create_dir(at.rpartition("/")[0])
                    sink = pq.ParquetWriter(at, batch.schema, filesystem=where)
                sink.write_batch(batch)
                hashes = row_hashes(batch)
                rows, total, xor = rows + len(hashes), (total + int(hashes.sum(dtype=np.uint64))) & MASK, xor ^ int(np.bitwise_xor.reduce(hashes))
        finally:
            if sink is not None:
                sink.close()
        return Written(name if sink is not None else None, rows, total, xor)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        held = {"files": [], "rows": 0, "total": 0, "xor": 0}
        if not self.overwrite and self.before is not None:
            held = json.loads(_read_text(f"{self.base}/manifests/{self.before}.json"))
        told = {
            "files": held["files"] + [m.file for m in done if m.file], "rows": held["rows"] + sum(m.rows for m in done), "total": (held["total"] + sum(m.total for m in done)) & MASK,
            "xor": held["xor"], "before": self.before, "schema": self.schema.json()}
        for m in done:
            told["xor"] ^= m.xor
        told["fingerprint"] = f"{told['total'] ^ told['rows']:016x}{told['xor']:016x}"
        _publish(f"{self.base}/manifests/{self.version}.json", json.dumps(told))
        if not self.overwrite and _read_text(f"{self.base}/_latest") != self.before:
            raise RuntimeError("another version was published during this append")
        _publish(f"{self.base}/_latest", self.version)

    def abort(self, messages: list[Written | None]) -> None:
        """Files of finished tasks go; those of killed tasks are in no manifest."""
        for m in messages:
            if m is not None and m.file:
                where, at = _open(f"{self.base}/data/{m.file}")
                where.delete_file(at)


class Transactional(DataSource):
    """``df.write.format("transactional").mode(...).save(base)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "transactional"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transactional)


def write_transaction(df: DataFrame, base: str, append: bool = False) -> dict:
    """Publishes the rows of ``df`` and gives the manifest of the new version."""
    register(df.sparkSession)
    df.write.format("transactional").mode("append" if append else "overwrite").save(base)
    return manifest(base)


def manifest(base: str, version: str | None = None) -> dict:
    """Manifest of a version (the published one by default), with its name."""
    version = version or _read_text(f"{base.rstrip('/')}/_latest")
    if version is None:
        raise FileNotFoundError(f"{base} has no published version")
    return {**json.loads(_read_text(f"{base.rstrip('/')}/manifests/{version}.json")), "version": version}


def read_transaction(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """The rows of a version (the published one by default)."""
    told = manifest(base, version)
    schema = StructType.fromJson(json.loads(told["schema"]))
    if not told["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base.rstrip('/')}/data/{f}" for f in told["files"]])
