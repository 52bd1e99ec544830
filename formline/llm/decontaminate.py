"""Benchmark decontamination by templates.

Words (runs without white space, stripped to letters and digits) are put into a canonical form: words with a digit become
the placeholder of numbers, words with only the first letter in upper case inside a sentence that of names, unit words
after a number that of units, all others their lower case. Windows of WINDOW words are joined by hash between documents and
benchmark items: all of them by their surface words (lower case, so copies in other case match), and those with placeholders, at least
half of the words literal, by their canonical words too. A window whose surface words are the item's counts by itself. Windows
with changed values count, for one item at one shift inside one document, if the words under their placeholders map one to
one (slot consistency): a re-parameterised question replaces every occurrence of a value by the same other value. A document
is contaminated by an item if its windows cover at least ``share`` of all the item's windows, or of those that are half literal.

An item of fewer than WINDOW words is one window of its own length. A fixed-size bitmap of the benchmark's window hashes
keeps windows without any partner out of the join; a false hit there only costs a row, the join decides.

Defined results: null or empty texts match nothing; items whose windows are mostly placeholders match by their surface words only; a null id is an
id of its own; repeated rows of a document give one result row; either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import query, slices, table
from formline.llm.language_id import letter_tables
from formline.session import stored

WINDOW, SHARE, BITS = 8, 0.3, 24
#: Unit words, fixed.
UNITS = ("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons lb lbs pound pounds oz "
         "ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
         "percent usd eur dollar dollars euro euros cent cents mph kmh degree degrees meter meters metre metres").split()
BASE = 0x9E3779B97F4A7C15 | 1
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base ** (done + i) = base ** done * base ** i
        k = min(done, n - done)
        out[done:done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


def range_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of code[start:end], mixed, for many ranges."""
    n = len(code) + 1
    total = np.zeros(n, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:-1], out=total[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), n)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Canonical:
    """Canonical words of several texts: owner, token, hash of the surface form, and whether it is a placeholder."""

    owner: np.ndarray
    token: np.ndarray
    surface: np.ndarray
    slot: np.ndarray


def _unit_hashes() -> np.ndarray:
    code = np.frombuffer("".join(UNITS).encode("utf-32-le"), dtype=np.uint32)
    end = np.cumsum([len(u) for u in UNITS])
    return np.sort(range_hashes(code, end - [len(u) for u in UNITS], end))


def canonical(texts: list[str]) -> Canonical:
    letters, lower = letter_tables()
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    digit = (code >= 48) & (code <= 57)
    kept = digit | letters[code]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    rank = np.concatenate([[0], np.cumsum(kept)])
    a, b = rank[start], rank[end]
    full = b > a
    start, end, a, b = start[full], end[full], a[full], b[full]
    chars = lower[code[kept]]
    upper = chars != code[kept]
    owner = np.searchsorted(begin, start, side="right") - 1
    surface = range_hashes(chars, a, b)
    digits = np.concatenate([[0], np.cumsum(digit)])
    number = digits[end] > digits[start]
    last = code[end - 1]
    stops = (last == 46) | (last == 33) | (last == 63) | (last == 58)
    lines = np.concatenate([[0], np.cumsum(code == 10)])
    opens = np.ones(len(start), dtype=bool)  # of a sentence
    opens[1:] = stops[:-1] | (lines[start[1:]] > lines[end[:-1]])
    second = np.minimum(a + 1, len(chars) - 1)
    name = ~number & ~opens & (upper[a] if len(upper) else a > 0) & ~((b > a + 1) & (upper[second] if len(upper) else a > 0))
    units = _unit_hashes()
    after_number = np.concatenate([[False], number[:-1] & (owner[1:] == owner[:-1])])[:len(number)]
    unit = ~number & ~name & after_number & (units[np.minimum(np.searchsorted(units, surface), len(units) - 1)] == surface)
    token = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, surface)))
    return Canonical(owner, token, surface, number | name | unit)


def window_hashes(c: Canonical, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a window of n words of one text starts, and the windows' hashes, of surface words first: every window by
    its surface words, then those with placeholders, half literal at least, by their canonical words."""
    m = len(c.token) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    held = np.concatenate([[0], np.cumsum(c.slot)])
    inside, slots = c.owner[:m] == c.owner[n - 1:], held[n:] - held[:m]
    every, templates = np.flatnonzero(inside), np.flatnonzero(inside & (slots > 0) & (2 * slots <= n))
    hashes = []
    for at, words, seed in ((every, c.surface, n + (1 << 32)), (templates, c.token, n)):
        h = np.full(len(at), seed, dtype=np.uint64)
        for j in range(n):
            h = (h + words[at + j]) * np.uint64(0xD6E8FEB86659FD93 | 1)
            h ^= h >> np.uint64(32)
        hashes.append(mix(h))
    return np.concatenate([every, templates]), np.concatenate(hashes), np.arange(len(every) + len(templates)) < len(every)


def _rows(c: Canonical, at: np.ndarray, h: np.ndarray, exact: np.ndarray, n: int, first: np.ndarray) -> list[pa.Array]:
    """hash, n, place and slots; a window by its surface words has null slots."""
    surface = c.surface.view(np.int64)
    slots = [None if e else surface[i:i + n][c.slot[i:i + n]] for i, e in zip(at, exact)]
    return [pa.array(h.view(np.int64)), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array((at - first[c.owner[at]]).astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))]


def _firsts(c: Canonical, texts: int) -> np.ndarray:
    return np.searchsorted(c.owner, np.arange(texts))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, hash, n (words), place, slots and literal (half the words at least) of every window of the benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 19):
            texts, ids = batch.column("text").to_pylist(), np.array(batch.column("item_id"))
            c = canonical(texts)
            first = _firsts(c, len(texts))
            words = np.bincount(c.owner, minlength=len(texts))
            for n in sorted({min(WINDOW, w) for w in words.tolist()} - {0}):
                at, h, exact = window_hashes(c, n)
                fits = np.minimum(words[c.owner[at]], WINDOW) == n
                at, h, exact = at[fits], h[fits], exact[fits]
                held = np.concatenate([[0], np.cumsum(c.slot)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[c.owner[at]], batch.column("item_id").type), *_rows(c, at, h, exact, n, first), pa.array(2 * (held[at + n] - held[at]) <= n)],
                                                 names=["item_id", "hash", "n", "place", "slots", "literal"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    return items.mapInArrow(run, "item_id long, hash long, n int, place int, slots array<long>, literal boolean")


def bitmap(windows: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each residue of the hashes, at most 2 ** bits of them whatever the benchmark's size."""
    bit = F.pmod(F.col("hash"), F.lit(1 << bits))
    words = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {1 << bits}) & 63 as int))")).alias("set"))
    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    for r in words.collect():
        out[r.word] = r.set
    return out


def document_windows(docs: DataFrame, present: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, text_key, hash, n, place and slots of the document windows whose bit is set."""
    held = docs.sparkSession.sparkContext.broadcast(present)
    size = len(present) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            c = canonical(texts)
            first = _firsts(c, len(texts))
            for n in lengths:
                at, h, exact = window_hashes(c, n)
                bit = h & np.uint64(size - 1)
                hit = (held.value[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63))) & np.uint64(1) > 0
                at, h, exact = at[hit], h[hit], exact[hit]
                row = pa.array(c.owner[at])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_key").take(row), *_rows(c, at, h, exact, n, first)],
                                                 names=["doc_id", "text_key", "hash", "n", "place", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id long, text_key long, hash long, n int, place int, slots array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, n_windows, item_windows, coverage, reparameterised for each contaminated document and item."""
    items = stored(item_windows(benchmark), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    sizes = items.filter("slots is null").groupBy("item_id").agg(F.count("*").alias("item_windows"), F.count_if("literal").alias("literal_windows"))
    side = items.select("item_id", "hash", F.col("n").alias("n"), F.struct("place", "literal").alias("item_place"), F.col("slots").alias("item_slots"))
    pairs = document_windows(docs, bitmap(items), lengths).join(side, ["hash", "n"])
    changed = F.col("slots") != F.col("item_slots")
    shifts = pairs.groupBy("doc_id", "text_key", "item_id", (F.col("place") - F.col("item_place.place")).alias("shift")).agg(
        F.collect_set(F.when(F.col("slots").isNull(), F.col("item_place"))).alias("same"), F.collect_set(F.when(changed, F.col("item_place"))).alias("changed"),
        F.array_distinct(F.flatten(F.collect_set(F.when(changed, F.arrays_zip("item_slots", "slots"))))).alias("slots"))
    n = F.size("slots")
    consistent = (n == F.size(F.array_distinct("slots.item_slots"))) & (n == F.size(F.array_distinct("slots.slots")))
    # windows with the item's own words count whatever the changed ones do
    places = F.when(consistent, F.array_union("same", "changed")).otherwise(F.col("same"))
    found = shifts.groupBy("doc_id", "text_key", "item_id").agg(
        F.array_distinct(F.flatten(F.collect_list(places))).alias("places"), F.max(consistent & (F.size("changed") > 0)).alias("reparameterised"))
    found = found.select("*", F.size("places").alias("n_windows"), F.size(F.filter("places", lambda p: p["literal"])).alias("n_literal"))
    found = found.join(sizes, "item_id").withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    # a window of mostly placeholders cannot match with changed values, so the literal windows alone may decide too
    enough = (F.col("coverage") >= share) | ((F.col("literal_windows") > 0) & (F.col("n_literal") >= share * F.col("literal_windows")))
    return found.filter(enough).select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "coverage", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item contaminates."""
    bad = contamination(docs, benchmark, share).select("doc_id", "text_key").distinct().toDF("bad_id", "bad_key")
    row = docs.select(F.struct("*").alias("row"))
    hit = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_key"))
    return row.join(bad, hit, "left_anti").select("row.*")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key").dropDuplicates(["doc_id", "item_id"])
