"""Where a user's own code plugs in (X family)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formline.functions.scalar import arr_sum
from formline.operators import audits
from formline.operators.history import field, with_past


def map_columns(df: DataFrame, exprs: Mapping[str, Callable[[Callable[[str], Column]], Column]]) -> DataFrame:
    """Column -> Column functions; stays in generated code."""
    return df.withColumns({name: fn(F.col) for name, fn in exprs.items()})


def map_batches(df: DataFrame, out: str, cols: Sequence[str], fn: Callable[..., pd.Series], kind: str = "double") -> DataFrame:
    """Vectorised user code over Arrow batches, for what no expression covers."""
    def call(*series: pd.Series) -> pd.Series:
        return fn(*series)
    udf = F.pandas_udf(call, kind)
    return df.withColumn(out, udf(*cols))


def apply_history(long: DataFrame, cols: Sequence[str], n: int, fn: Callable[[pd.DataFrame], pd.Series], out: str,
                  kind: str = "double", strict: str = "time") -> DataFrame:
    """User code over each row's last ``n`` earlier rows.

    ``fn`` gets a frame with one list per column and row. History is a bounded list on the row, so
    an entity with very many rows is spread over tasks like any other.
    """
    past = with_past(long, cols, n, strict)
    names = list(cols)

    def call(*series: pd.Series) -> pd.Series:
        return fn(pd.DataFrame(dict(zip(names, series))))

    udf = F.pandas_udf(call, kind)
    return past.withColumn(out, udf(*[field(F.col("past"), c).cast("array<double>") for c in cols])).drop("past")


def fold_history(long: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], start: Callable[[], Any],
                 step: Callable[[Any, pa.RecordBatch], tuple[Any, pa.Array]], out: str, kind: str = "double") -> DataFrame:
    """User code over the whole history of each entity, in order, with a state it carries.

    ``step(state, batch)`` gets the next rows of one entity (``order`` and ``cols``) and gives the state after them and a value for each row; ``start()`` makes
    the state of an entity. Rows come in Arrow batches and none are kept, so memory holds a batch and a state, however long
    the history is. An entity is one task, as its state passes from row to row; entities are dealt by hash. Null keys are an entity of
    their own; equal keys of ``order`` come in any order. Returns ``key``, ``order`` and ``out``.
    """
    held = [key, *order, *[c for c in cols if c not in (key, *order)]]
    # the sort within partitions is by key first, which is all that grouping asks for, so rows of a group stay in order
    sorted_ = long.select(*held).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = start(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(c)[i].as_py() for c in order) for i in (0, batch.num_rows - 1)]
            if last is not None and None not in last + ends[0] and ends[0] < last:
                raise RuntimeError("rows of an entity came out of order")
            last = ends[1]
            state, values = step(state, batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *order)], values], names=[key, *order, out])

    kinds = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in (key, *order))
    return sorted_.groupBy(key).applyInArrow(run, f"{kinds}, {out} {kind}")


def table_function(df: DataFrame, partition: Sequence[str], order: Sequence[str], columns: Callable[[StructType, Mapping[str, Any]], StructType],
                   start: Callable[..., Any], step: Callable[[Any, pa.RecordBatch], tuple[Any, pa.Table | None]], finish: Callable[[Any], pa.Table | None],
                   options: Mapping[str, Any] | None = None, name: str | None = None) -> DataFrame:
    """User code as an Arrow table function over ``df`` partitioned and ordered by the given columns: any rows in, any rows out.

    ``columns(schema, options)`` computes what comes out from the input's schema and the options, before anything runs. ``start(**options)`` makes the state
    of a partition, ``step(state, batch)`` gives the state after its next rows and any output, ``finish(state)`` the last output; nothing but
    the state is kept, so memory does not follow the partition. With a ``name`` the function can also be called in SQL, with these options, on tables of this
    schema: ``SELECT * FROM name(TABLE(t) PARTITION BY ... ORDER BY (...))``.
    """
    chosen = dict(options or {})

    class Handler:
        def __init__(self) -> None:
            self.begun, self.state = False, None

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                if not self.begun:
                    self.begun, self.state = True, start(**chosen)
                self.state, out = step(self.state, rows)
                if out is not None:
                    yield out

        def terminate(self) -> Iterator[pa.Table]:
            out = finish(self.state) if self.begun else None
            if out is not None:
                yield out

    function = F.arrow_udtf(Handler, returnType=columns(df.schema, chosen))
    if name is not None:
        df.sparkSession.udtf.register(name, function)
    return function(df.asTable().partitionBy(*partition).orderBy(*order))


def one_to_many(df: DataFrame, keep: Sequence[str], rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One input row to several output rows in the same pass."""
    return df.select(*keep, F.inline(F.array(*[F.struct(*[c.alias(k) for k, c in r.items()]) for r in rows])))


def decayed_mean(values: Column, decay: float) -> Column:
    """Weighted mean of a list, newest last, weight ``decay`` to the age."""
    size = F.size(values)
    weights = F.transform(values, lambda v, i: F.pow(F.lit(decay), (size - 1 - i).cast("double")))
    return F.try_divide(arr_sum(F.zip_with(values, weights, lambda v, w: v * w)), arr_sum(weights))


class LeakageError(ValueError):
    """A split audit failed."""


def guarded(df: DataFrame, op: Callable[[DataFrame], DataFrame], part: str = "part", advisory: Sequence[str] = ()) -> DataFrame:
    """Run ``op`` only when the split of ``df`` passes its audits; ``advisory`` checks never block."""
    soft = {"advised_gap", "min_length", "max_length", *advisory}
    found = audits.split_integrity(df, part).unionByName(audits.test_period(df, part))
    bad = [f"{r['check']}({r['subject']})={r['value']}" for r in found.filter("passed = 0").collect() if r["check"] not in soft]
    if bad:
        raise LeakageError("; ".join(bad))
    return op(df)
