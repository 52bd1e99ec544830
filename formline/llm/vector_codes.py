"""Vector codes by active-entry Lloyd: a vector is cut into equal parts, and each part is coded as its nearest codebook entry.

Components become integers floor(1024 * x). A part position's codebook starts as that part of the vectors with the smallest ids. A round assigns every
part to its nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of its parts' mean; unused
entries stay. The rows carry each part's entry and exact distance. In a later round a part whose own entry did not move is compared with the moved
entries only: no entry that stayed can beat the stored distance, nor tie with it at a lower index, as none could when the distance was stored. A part whose
entry moved scans the whole codebook. So work falls as the entries settle, and the codes equal those of full scans.

A round is one pass over written rows: tasks fold their parts into sums and counts an entry, which are added up by entry before the
driver takes the floors; it holds only the codebooks, whose size the call sets. The rows with their entries are written once a round, as integers in a
dictionary encoding, and read twice: for the sums and by the next round. A round's table goes when the next is written.

Defined results: rows whose vector is null or empty, or holds null or non-finite components, are dropped, and so are vectors of another length than the
commonest one (the longest of equally common lengths). Lengths that no equal parts fill are filled up with zeros. Integers
beyond 2 ** 26 in size count as that. Null ids come last, equal ids in the order of their vectors; with fewer vectors than entries the codebooks are as short.
Repeated rows are coded alike and count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import query, table
from formline.session import scratch

SCALE, LARGEST, PIECE = 1024, 1 << 26, 2048


def whole_numbers(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label, x (array<long>, a multiple of ``parts`` long) of the rows that take part, and the length of a part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", "label", v.alias("v")).filter(F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first().d or 0
    width, bound = -(-common // parts), float(LARGEST)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))).cast("long"))
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), width * parts - common)) if width * parts > common else x
    return rows.filter(F.size("v") == common).select("vec_id", "label", x.alias("x")), width


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """By (part, entry, position): the parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    return np.array([r.x for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: in floating point where every intermediate sum is an exact integer."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    if 4 * x.shape[1] * top ** 2 < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * x @ book.T


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, dist: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of the rows of one part position; ``code`` and ``dist`` are those of the codebook before ``moved`` entries moved."""
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    stale = moved[code]
    for at in range(0, len(x), PIECE):
        full = at + np.flatnonzero(stale[at:at + PIECE])
        if len(full):
            d = distances(x[full], book)
            code[full] = d.argmin(axis=1)  # the first of equals
            dist[full] = d[np.arange(len(full)), code[full]]
        rest = at + np.flatnonzero(~stale[at:at + PIECE])
        if len(rest) and len(active):
            d = distances(x[rest], book[active])
            best = d.argmin(axis=1)
            near, entry = d[np.arange(len(rest)), best], active[best]
            wins = (near < dist[rest]) | ((near == dist[rest]) & (entry < code[rest]))
            code[rest], dist[rest] = np.where(wins, entry, code[rest]), np.where(wins, near, dist[rest])
    return code, dist


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``rows`` with code and dist (a value a part) by ``books``; without ``moved`` every part scans its whole codebook."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column("x"))
            if moved is None:
                code, dist = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=np.int64)
            else:
                code, dist = as_matrix(batch.column("code")).astype(np.int64), as_matrix(batch.column("dist")).copy()
            for p in range(parts):
                which = np.ones(entries, dtype=bool) if moved is None else moved[p]
                code[:, p], dist[:, p] = reassign(x[:, p * width:(p + 1) * width], books[p], code[:, p], dist[:, p], which)
            out = [batch.column(c) for c in ("vec_id", "label", "x")] + [pa.array(list(code.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(dist), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "x", "code", "dist"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<long>, code array<int>, dist array<long>")


def renewed(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose used entries are the floors of their parts' means."""
    parts, entries, width = books.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = as_matrix(batch.column("x")), as_matrix(batch.column("code"))
            for p in range(parts):
                at = p * entries + code[:, p]
                order = np.argsort(at, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
                sums[at[order[cut]]] += np.add.reduceat(x[order, p * width:(p + 1) * width], cut, axis=0)
                count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["at", "n", "s"])

    partial = rows.select("x", "code").mapInArrow(fold, "at long, n long, s array<long>")
    total = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))
    out = books.copy()
    for r in total.collect():  # parts x entries rows at most
        out[r.at // entries, r.at % entries] = [v // r.n for v in r.s]
    return out


def without_table(spark: SparkSession, path: str) -> None:
    """Deletes a working table whose reader has finished."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fitted(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with their final code and dist, and the final codebooks."""
    spark, moved, before = rows.sparkSession, None, None
    for k in range(rounds + 1):
        path = scratch(spark, "vector-codes")
        assigned(rows, books, moved).write.parquet(path)
        if before is not None:
            without_table(spark, before)
        rows, before = spark.read.parquet(path), path
        if k < rounds:
            new = renewed(rows, books)
            moved, books = (new != books).any(axis=2), new
    return rows, books


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (entry of each part), dist (exact squared distance of each part) for ``vectors`` (vec_id, embedding, label), and the codebooks by
    (part, entry, position)."""
    rows, width = whole_numbers(vectors, parts)
    if not width:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.array().cast("array<long>").alias("dist")), np.zeros((parts, 0, 0), dtype=np.int64)
    books = first_codebooks(rows, parts, entries)
    found, books = fitted(rows, books, rounds)
    return found.select("vec_id", "label", "code", "dist"), books


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as (select r.nr, r.p, min(struct_pack(d := list_sum(list_transform(list_zip(r.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := b.e)) as best
  from pieces r join book{k} b on r.p = b.p group by r.nr, r.p),
code{k} as materialized (select nr, p, best.e as e, best.d as d from near{k})""")
        if k < rounds:
            steps.append(f"""
mean{k} as (select p, e, list(v order by i) as x from (select c.p, c.e, i, (sum(r.x[i]) - (sum(r.x[i]) % count(*) + count(*)) % count(*)) // count(*) as v
    from code{k} c join pieces r on c.nr = r.nr and c.p = r.p, range(1, len(r.x) + 1) t(i) group by c.p, c.e, i) group by p, e),
book{k + 1} as materialized (select b.p, b.e, coalesce(m.x::bigint[], b.x) as x from book{k} b left join mean{k} m on b.p = m.p and b.e = m.e)""")
    return f"""
with kept as materialized (select row_number() over (order by vec_id, embedding) - 1 as nr, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::double)::bigint) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0),
pieces as materialized (select nr, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] as x from kept, range({parts}) t(p)),
book0 as materialized (select p, nr as e, x from pieces where nr < {entries}),{','.join(steps)},
hash as (select sha256(string_agg(v::varchar, ',' order by p, e, i)) as h from (select p, e, i, x[i] as v from book{rounds}, range(1, len(x) + 1) t(i))),
coded as (select nr, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from code{rounds} group by nr),
rows as (select vec_id, label, code, error from kept join coded using (nr))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from rows, hash"""


@query("op13_vector_codes", _sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda s, d: s + d)
    rows = found.select("vec_id", "label", code.alias("code"), error.alias("error"))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
