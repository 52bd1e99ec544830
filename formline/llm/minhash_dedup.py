"""Near-duplicate documents by HyperMinHash registers.

Documents with equal shingle sets are one class. Each class has 128 registers of 16 bits (leading zeros and mantissa bits);
bands of five registers deal classes into buckets. Buckets with the same members are kept once. Inside a bucket the
collision-corrected Jaccard estimate, with five standard errors of room, sorts out the pairs that may link.

Not all of these pairs are checked at first. Of each bucket a spanning forest, the most similar pairs first, is checked on the
full shingle sets; where it links a group, the other pairs inside the group cannot change its component. Then all
remaining pairs between different components are checked, inside the tasks that hold their bucket, and only links come
out. So no link that matters to a component is left out, and a large group of near copies costs about one check a member. Buckets of over ``block`` classes are cut into blocks, and
each pair of blocks is a task of its own.

Chance to miss a pair with Jaccard exactly 0.85 through all 25 bands: 4e-7 (0.8: 5e-5).

Defined results: null or empty texts and texts without words have an empty set and link with nothing; rows with a null id link
with nothing; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import id_text, query, slices, table
from formline.llm.components import components
from formline.llm.embedding_dedup import forest, pairs_in_runs
from formline.llm.hyperminhash import BANDS, REGISTERS, ROWS, band_keys, estimated, registers, set_key, shingle_sets
from formline.session import stored


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, key1, key2 (of the set) and registers of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist())
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "text_key", "n_shingles", "key1", "key2", "regs"])

    return id_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, key1 long, key2 long, regs binary")


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def members(classes: DataFrame) -> DataFrame:
    """key, n, class: the members of every bucket with two classes or more, of buckets with the same members only one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_registers(batch.column("regs")))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(list(keys), pa.list_(pa.int64()))], names=["class", "keys"])

    rows = classes.select("class", "regs").mapInArrow(run, "class long, keys array<long>").select("class", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.bit_xor(F.xxhash64("class")).alias("mark")).filter("n > 1")
    unique = buckets.groupBy("n", "lo", "hi", "mark").agg(F.min("key").alias("key")).select("key", "n")
    return rows.join(unique, "key").select("key", "n", "class")


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """The rows (key, n, class, ...) of buckets by pair of blocks (p, q); a bucket of up to ``block`` classes is one block."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "n")


def bucketwise(each: Callable[[pa.Table], Iterator[pa.RecordBatch]], limit: int = 1 << 25) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``each`` with whole buckets, several at a time, of a partition that is sorted by (key, p, q)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in ("key", "p", "q")):
                cut = np.concatenate([[0], cut])
            if len(cut) and size + batch.nbytes > limit:
                yield from each(pa.Table.from_batches([*held, batch.slice(0, cut[-1])]))
                held = [batch.slice(cut[-1])]
                size = held[0].nbytes
            else:
                held.append(batch)
                size += batch.nbytes
        if held:
            yield from each(pa.Table.from_batches(held))
    return run


class Buckets:
    """The pairs of classes inside the buckets of a table whose estimates reach ``least``."""

    def __init__(self, t: pa.Table, least: float, labels: bool) -> None:
        self.key = np.stack([t[c].to_numpy() for c in ("key", "p", "q")])
        self.own, self.ids, self.sizes = (t[c].to_numpy() for c in ("own", "class", "n_shingles"))
        self.labels = t["label"].to_numpy() if labels else None
        self.regs = _registers(t["regs"])
        self.run = np.concatenate([[0], np.cumsum((self.key[:, 1:] != self.key[:, :-1]).any(axis=0))])
        self.least = least

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j in pairs_in_runs(self.run, 1 << 19):
            ok = (self.own[i] != self.own[j]) | (self.key[1][i] == self.key[2][i])  # in a pair of two blocks only across them
            if self.labels is not None:
                ok &= self.labels[i] != self.labels[j]
            # no two sets can be more similar than the smaller size through the larger
            ok &= np.minimum(self.sizes[i], self.sizes[j]) >= self.least * np.maximum(self.sizes[i], self.sizes[j])
            i, j = i[ok], j[ok]
            rate = estimated(self.regs, i, j, self.sizes)
            near = rate >= self.least
            yield i[near], j[near], rate[near]


def first_checks(rows: DataFrame, classes: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs (a, b): a spanning forest of each bucket's candidates, the most similar first."""
    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        b = Buckets(t, least, labels=False)
        for i, j, rate in b.pairs():
            if not len(i):
                continue
            order = np.lexsort((-rate, b.run[i]))
            i, j = i[order], j[order]
            keep = forest(i, j, len(b.run))
            x, y = b.ids[i[keep]], b.ids[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = dealt(rows.select("key", "n", "class").join(classes.select("class", "n_shingles", "regs"), "class"), block)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(bucketwise(each), "a long, b long").distinct()


def still_open(rows: DataFrame, classes: DataFrame, least: float, block: int) -> DataFrame:
    """(key, p, q, own, class, label): the classes of a bucket that have a candidate there with another label."""
    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        b = Buckets(t, least, labels=True)
        hit = np.zeros(t.num_rows, dtype=bool)
        for i, j, _ in b.pairs():
            hit[i] = hit[j] = True
        out = t.select(["key", "p", "q", "own", "class", "label"]).filter(pa.array(hit))
        yield from out.to_batches()

    rows = dealt(rows.select("key", "n", "class", "label").join(classes.select("class", "n_shingles", "regs"), "class"), block)
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(bucketwise(each), "key long, p int, q int, own int, class long, label long")


def last_checks(open_: DataFrame, kept: DataFrame, classes: DataFrame, texts: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between the classes of ``open_`` with different labels, on the full sets, inside the tasks.

    A pair is checked in one bucket: the one with the smallest key that both are in. ``kept``: class, keys (of its buckets)."""
    def each(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        b = Buckets(t, least, labels=True)
        sets = shingle_sets(t["text"].to_pylist())
        bands = band_keys(b.regs)
        for n, keys in enumerate(t["keys"].to_pylist()):  # bands whose bucket was not kept meet nobody
            bands[n][~np.isin(bands[n], np.array(keys))] = -1 - n
        root = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        links = []
        for i, j, _ in b.pairs():
            shared = np.where(bands[i] == bands[j], bands[i], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            here = shared == b.key[0][i]
            for x, y in zip(i[here].tolist(), j[here].tolist()):
                u, v = find(b.labels[x]), find(b.labels[y])
                if u != v:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        root[max(u, v)] = min(u, v)
                        links.append((b.ids[x], b.ids[y]))
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=np.iinfo(np.int64).max)), pa.array(pairs.max(axis=1, initial=-1))], names=["a", "b"])

    rows = open_.join(classes.select("class", "n_shingles", "regs"), "class").join(kept, "class").join(texts, "class")
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(bucketwise(each), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets have 100 * intersection >= percent * union."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20, "left"):
            left, right = shingle_sets(batch.column("left").to_pylist()), shingle_sets(batch.column("right").to_pylist())
            good = []
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    rows = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
    return rows.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def near_documents(docs: DataFrame, percent: int = 85, block: int = 1024) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept and label (one number for each component, null without shingles) for each row of ``docs``."""
    t = percent / 100
    least = t - 5 * (t * (1 - t) / (ROWS * BANDS)) ** 0.5
    rows = stored(sketches(docs), "sketches")
    usable = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    buckets = stored(members(classes), "buckets")
    first = stored(first_checks(buckets, classes, least, block), "pairs")
    texts = stored(_texts(docs, classes, first), "texts")
    links = stored(verified(first, texts, percent), "links")
    label = components(links).toDF("class", "label")
    labelled = buckets.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    split = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_ = stored(still_open(labelled.join(split, "key"), classes, least, block), "open")
    kept = buckets.join(open_.select("class").distinct(), "class").groupBy("class").agg(F.collect_list("key").alias("keys"))  # at most one a band
    links = links.unionByName(last_checks(open_, kept, classes, texts, least, percent))
    label = components(links).toDF("class", "label")
    named = stored(classes.select("class", "key1", "key2", "doc_id").join(label, "class", "left").select("key1", "key2", "doc_id", F.coalesce("label", "class").alias("label")), "named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(smallest, "label").select("key1", "key2", "component_id", "label")
    grouped = usable.join(by_set, ["key1", "key2"])
    alone = rows.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")).withColumn("label", F.lit(None).cast("long"))
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "label"]
    out = grouped.select(columns).unionByName(alone.select(columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the smallest (id, text hash). Rows that repeat id
    and text are one document; rows without words or without an id stay."""
    rows = stored(near_documents(docs, percent), "near")
    best = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("best")).select("best.*")
    stay = best.union(rows.filter("label is null").select("doc_id", "text_key")).distinct().toDF("stay_id", "stay_key")
    row = docs.select(F.struct("*").alias("row"))
    key = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    met = row.join(stay, F.col("row.doc_id").eqNullSafe(F.col("stay_id")) & (key == F.col("stay_key")))
    return met.dropDuplicates(["stay_id", "stay_key"]).select("row.*")


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """class and the text of one of its documents, for all classes in ``pairs``."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = classes.select("class", "doc_id", "key1", "key2").join(needed, "class")
    found = id_text(docs).join(wanted, "doc_id")

    def right_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A repeated id may have other texts too."""
        for batch in slices(batches, 1 << 20):
            keys = [set_key(s) for s in shingle_sets(batch.column("text").to_pylist())]
            keep = pa.array([k == w for k, w in zip(keys, zip(batch.column("key1").to_pylist(), batch.column("key2").to_pylist()))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("class").filter(keep), batch.column("text").filter(keep)], names=["class", "text"])

    found = found.select("class", "text", "key1", "key2").mapInArrow(right_one, "class long, text string")
    return found.dropDuplicates(["class"])


#: Shingles joined as texts; for tables of the size of the tests.
SQL = r"""
with recursive rows as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as materialized (select rid, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from rows),
each as materialized (select rid, len(s) n, unnest(s) g from sets where doc_id is not null),
met as (select a.rid x, b.rid y, a.n nx, b.n ny, count(*) c from each a join each b on a.g = b.g and a.rid < b.rid group by all),
pairs as materialized (select x, y from met where 100 * c >= 85 * (nx + ny - c)),
both_ways as materialized (select x, y from pairs union all select y, x from pairs),
reach as (select distinct x n, x m from both_ways union select r.n, b.y from reach r join both_ways b on r.m = b.x),
least as (select r.n rid, min(g.doc_id) component_id from reach r join sets g on g.rid = r.m group by 1)
select doc_id, len(s) n_shingles, coalesce(component_id, doc_id) component_id, doc_id is not distinct from coalesce(component_id, doc_id) kept from sets left join least using (rid)"""


@query("op6_near_documents", SQL)
def op6_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
