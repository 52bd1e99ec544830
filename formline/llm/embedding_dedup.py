"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is its sign pattern under random orthogonal rotations, CODE_BITS signs. Tables of ``bits`` code bits each deal vectors
into buckets, as many tables as would keep the chance to miss a pair at the threshold below ``miss`` if tables were independent; as
all draw from the same CODE_BITS it is larger (for 1e-5 about 1e-4 with 50,000 vectors, 7e-4 with 15 million). About n * 2 ** -bits
vectors share a bucket by chance. Inside a bucket the first rotation's code o of a vector x, with its stored correction
factor <o, x>, estimates the inner product with any unit vector y without bias as <o, y> / <o, x>, with an error of
about sqrt(1 - <x, y>**2) * sqrt(1 - <o, x>**2) / <o, x> / sqrt(d - 1). Only pairs whose bound reaches the threshold are
computed again exactly, in double precision. A pair is looked at in the first table where it shares a bucket and in
no other, so counts add up without a list of all pairs. Buckets of over ``block`` vectors are cut into blocks, and each
pair of blocks is a task of its own.

Vectors with equal components are one class first; a class counts with its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
nothing (n_links 0, component_id = vec_id); vectors of different lengths never link; repeated rows are vectors of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import query, table
from formline.llm.components import components
from formline.session import stored

CODE_BITS, EPSILON = 512, 5.0


@functools.cache
def rotations(dim: int) -> np.ndarray:
    """Random orthogonal matrices side by side, for CODE_BITS code bits or a few more."""
    rng = np.random.default_rng(20230517 + dim)
    made = []
    for _ in range(-(-CODE_BITS // dim)):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        made.append(q * np.sign(np.diag(r)))
    return np.concatenate(made, axis=1)


@functools.cache
def table_bits(dim: int, tables: int, bits: int) -> np.ndarray:
    """Which code bits make the key of each table."""
    rng = np.random.default_rng(7 + dim)
    return np.array([rng.choice(rotations(dim).shape[1], size=bits, replace=False) for _ in range(tables)])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys_of(signs: np.ndarray, dim: int, tables: int, bits: int) -> np.ndarray:
    """By (vector, table): the bucket within the table."""
    chosen = table_bits(dim, tables, bits)
    weights = 1 << np.arange(chosen.shape[1], dtype=np.int64)
    return np.stack([signs[:, c] @ weights for c in chosen], axis=1)


def shape_of_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables."""
    bits = min(40, max(6, math.ceil(math.log2(max(n, 1) / 16 + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def coded(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """The given columns vec_id, size, v and the keys of all tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                signs = (_vectors(part.column("v")) @ rotations(int(dim)) > 0).astype(np.int64)
                keys = keys_of(signs, int(dim), tables, bits)
                # the key of a bucket: table, length and code bits
                wide = (np.arange(tables, dtype=np.int64) << 50) ^ (np.int64(dim & 1023) << 40) ^ keys
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(wide), pa.list_(pa.int64()))], names=[*part.schema.names, "keys"])

    return vectors.mapInArrow(run, f"vec_id long, size long, v {vectors.schema['v'].dataType.simpleString()}, keys array<long>")


def near_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Of the pairs (left, right) of unit vectors, which reach the threshold exactly."""
    dim = x.shape[1]
    turned = x @ rotations(dim)[:, :dim]
    code = np.where(turned > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dim))
    factor = np.einsum("ij,ij->i", code, turned)
    turned = turned.astype(np.float32)
    out = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), 1 << 17):
        i, j = left[at:at + (1 << 17)], right[at:at + (1 << 17)]
        estimate = np.einsum("ij,ij->i", code[i], turned[j]) / factor[i]
        spread = math.sqrt(1 - threshold ** 2) * np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / factor[i] / math.sqrt(max(dim - 1, 1))
        open_ = np.flatnonzero(estimate + EPSILON * spread + 1e-4 >= threshold) if dim > 2 else np.arange(len(i))
        out[at + open_] = np.einsum("ij,ij->i", x[i[open_]], x[j[open_]]) >= threshold
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) join two trees of the others before them."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = np.zeros(len(a), dtype=bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            keep[k] = True
    return keep


def pairs_in_runs(run: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of places with equal values in the sorted ``run``, about ``limit`` at a time."""
    n = len(run)
    end = np.searchsorted(run, run, side="right")
    ahead = end - np.arange(n) - 1
    at = 0
    total = np.cumsum(ahead)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        count = ahead[at:stop]
        left = np.repeat(np.arange(at, stop), count)
        if len(left):
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        at = stop


def links(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-5, block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Counts (vec_id, n) to be summed and linking edges (a, b) between ``vectors`` (vec_id, size, v)."""
    bits, tables = shape_of_tables(vectors.count(), threshold, miss)
    rows = coded(vectors, tables, bits).select("vec_id", "size", "v", F.explode("keys").alias("key"))
    hot = rows.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # a row of a hot bucket goes to each pair of blocks that holds its own block
    rows = rows.join(hot, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int"))
    other = F.explode(F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(0))))
    rows = rows.select("key", "vec_id", "size", "v", "own", other.alias("other")).withColumn("own", F.coalesce("own", F.lit(0)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "vec_id", "size", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            # whole buckets at a time: the partition is sorted by bucket
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held:
                last = held[-1]
                if any(last.column(c)[last.num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in ("key", "p", "q")):
                    cut = np.concatenate([[0], cut])
            if len(cut) and size + cut[-1] > 20000:
                yield from one(pa.Table.from_batches([*held, batch.slice(0, cut[-1])]))
                held, size = [batch.slice(cut[-1])], batch.num_rows - int(cut[-1])
            else:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield from one(pa.Table.from_batches(held))

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        key = np.stack([rows[c].to_numpy() for c in ("key", "p", "q")])
        own, ids, weight = rows["own"].to_numpy(), rows["vec_id"].to_numpy(), rows["size"].to_numpy()
        run = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
        dims = pc.list_value_length(rows["v"]).to_numpy()
        for dim in np.unique(dims):  # a bucket holds one length
            mine = np.flatnonzero(dims == dim)
            v = rows["v"].take(pa.array(mine)).combine_chunks()
            x = unit(_vectors(v))
            keys = keys_of((x @ rotations(int(dim)) > 0).astype(np.int64), int(dim), tables, bits).astype(np.int64)
            k, p, q, o = key[0][mine], key[1][mine], key[2][mine], own[mine]
            this = (k >> 50).astype(np.int64)
            linked_a, linked_b = [], []
            for i, j in pairs_in_runs(run[mine], 1 << 20):
                ok = (o[i] != o[j]) | (p[i] == q[i])  # in a pair of two blocks only across them
                i, j = i[ok], j[ok]
                for t in range(int(this[i].max(initial=0))):  # seen in an earlier table
                    if not len(i):
                        break
                    seen = (keys[i, t] == keys[j, t]) & (t < this[i])
                    i, j = i[~seen], j[~seen]
                if len(i):
                    near = near_pairs(x, i, j, threshold)
                    linked_a.append(i[near])
                    linked_b.append(j[near])
            if not linked_a:
                continue
            a, b = np.concatenate(linked_a), np.concatenate(linked_b)
            if not len(a):
                continue
            n = np.bincount(a, weights=weight[mine][b], minlength=len(mine)) + np.bincount(b, weights=weight[mine][a], minlength=len(mine))
            at = np.flatnonzero(n)
            own_ids = ids[mine]
            yield pa.RecordBatch.from_arrays([pa.array(own_ids[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at].astype(np.int64))], names=["a", "b", "n"])
            names, at_name = np.unique(own_ids, return_inverse=True)
            tree = forest(at_name[a], at_name[b], len(names))
            yield pa.RecordBatch.from_arrays([pa.array(own_ids[a[tree]]), pa.array(own_ids[b[tree]]), pa.nulls(int(tree.sum()), pa.int64())], names=["a", "b", "n"])

    found = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "a long, b long, n long")
    found = stored(found, "vector-links")
    return found.filter("b is null").select(F.col("a").alias("vec_id"), "n"), found.filter("b is not null").select("a", "b")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    # floats travel as floats and are computed on as doubles
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.filter("good").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    # classes get numbers of their own, as an id may be repeated with another vector
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "vec_id", "size", "v"), "vector-classes")
    counts, edges = links(classes.select(F.col("class").alias("vec_id"), "size", "v"), threshold, miss)
    counts = counts.groupBy("vec_id").agg(F.sum("n").alias("n")).withColumnRenamed("vec_id", "class")
    nodes = components(edges).toDF("class", "label")
    labelled = stored(classes.join(counts, "class", "left").join(nodes, "class", "left").select(
        "v", "vec_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "class").alias("label")), "vector-labels")
    least = labelled.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    by_class = labelled.select("v", "n_links", "label").join(least, "label").drop("label")
    linked = rows.filter("good").join(by_class, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Every pair compared; for tables of the size of the tests.
SQL = """
with recursive rows as (select row_number() over () rid, vec_id, embedding::double[] v from embeddings),
good as (select rid, vec_id, v, sqrt(list_dot_product(v, v)) size from rows
  where vec_id is not null and len(v) > 0 and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0 and list_dot_product(v, v) > 0),
pairs as materialized (select a.rid x, b.rid y from good a join good b on a.rid < b.rid and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / a.size / b.size >= 0.9),
both_ways as materialized (select x, y from pairs union all select y, x from pairs),
reach as (select distinct x n, x m from both_ways union select r.n, b.y from reach r join both_ways b on r.m = b.x),
least as (select r.n rid, min(g.vec_id) component_id from reach r join good g on g.rid = r.m group by 1),
links as (select x rid, count(*) n from both_ways group by 1)
select vec_id, coalesce(n, 0) n_links, coalesce(component_id, vec_id) component_id, vec_id is not distinct from coalesce(component_id, vec_id) kept
from rows left join links using (rid) left join least using (rid)"""


@query("op4_near_vectors", SQL)
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
