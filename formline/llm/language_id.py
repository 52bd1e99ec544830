"""Language spans of mixed-language text.

Script ranges narrow the candidates of a word to the languages that use its script; character n-gram scores rate the
candidates; Viterbi with a penalty for each switch labels the words, and runs of equal labels are the spans.
A document's language is the one with most letters in its spans, its score that language's share of the letters.

The model is fitted on a sample of labelled rows whose expected size is ``per_language`` rows of each label (a row is
in the sample by a hash of its text); it holds hashed n-gram counts, at most 3 * BUCKETS numbers for each language.

Texts are cut into segments of SEGMENT words. The best paths of all segments from every possible first label are
found side by side and then joined, so one huge text costs as much a word as many short ones, and the result is
that of one Viterbi pass over the whole text.

Defined results: a null or empty text, or one without letters, gives ``und``, score 0 and no spans; ids may be null or
repeated (one result row for each input row); an empty table gives no rows; without labelled rows all texts are ``und``.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import id_text, query, slices, table

BUCKETS = 1 << 14
SEGMENT = 2048
#: First code points of script ranges (Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic, Thai, Georgian, Hangul jamo,
#: Latin extended, kana, Han, Hangul, rest).
SCRIPTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x3040, 0x3100, 0x3130, 0x3190, 0xAC00, 0xD7B0])


@functools.cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case where that is one character."""
    letters = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] == "L":
            letters[c] = True
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    return letters, lower


@dataclass
class Words:
    """Words of several texts: owner, first and last + 1 character within the owner, script, and features by position."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of the word's features
    features: np.ndarray  # bucket by (feature position, order)


def words_of(texts: list[str]) -> Words:
    letters, lower = letter_tables()
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[code]
    before = np.concatenate([[False], is_letter[:-1]])
    start, end = np.flatnonzero(is_letter & ~before), np.flatnonzero(~is_letter & before)
    z0 = np.where(is_letter, lower[code], 0).astype(np.uint64)
    z1 = np.concatenate([[np.uint64(0)], z0[:-1]])
    z2 = np.where(z1 > 0, np.concatenate([[np.uint64(0)], z1[:-1]]), np.uint64(0))
    at = np.flatnonzero(is_letter | before)  # each letter, and the place behind each word
    a, b, c = z0[at], z1[at], z2[at]
    features = np.empty((len(at), 2), dtype=np.int32)
    for j, (h, shift) in enumerate(((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F), 0),
                                    (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9), BUCKETS))):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        features[:, j] = (h >> np.uint64(50)).astype(np.int32) + shift
    owner = np.searchsorted(begin, start, side="right") - 1
    return Words(owner, start - begin[owner], end - begin[owner], np.searchsorted(SCRIPTS, code[start], side="right") - 1,
                 np.searchsorted(at, start), features)


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # log-probability by (bucket, language)
    allowed: np.ndarray  # by (script, language): 0, or a large negative number
    switch: float


def _hashed_share(col: Column) -> Column:
    """A number in [0, 1) from the text."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) / float(1 << 30)


def fit(labelled: DataFrame, per_language: int = 1500, switch: float = 12.0, script_share: float = 0.01) -> Model:
    """Learns from the columns text and lang of all given rows, sampled to about ``per_language`` rows of each lang."""
    rows = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    size = 2 * BUCKETS + len(SCRIPTS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1 << 20):
            w = words_of(batch.column("text").to_pylist())
            of_word = np.array(batch.column("lang").to_pylist(), dtype=object)[w.owner]
            spread = np.repeat(np.arange(len(w.first)), np.diff(np.append(w.first, len(w.features))))
            for lang in set(of_word):
                mine = of_word == lang
                t = total.setdefault(lang, np.zeros(size, dtype=np.int64))
                t += np.bincount(w.features[mine[spread]].ravel(), minlength=size)
                t[2 * BUCKETS:] += np.bincount(w.script[mine], minlength=len(SCRIPTS))
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(t[at])], names=["lang", "bucket", "n"])

    score = np.zeros((2 * BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    if langs:
        share = functools.reduce(lambda acc, lang: acc.when(F.col("lang") == lang, min(1.0, per_language / counts[lang])), langs, F.when(F.lit(False), 0.0))
        sample = rows.filter(_hashed_share(F.col("text")) < share)
        table = np.zeros((size, len(langs)))
        for r in sample.mapInArrow(features, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
            table[r.bucket, langs.index(r.lang)] = r.n
        for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
            score[part] = np.log((table[part] + 0.05) / (table[part].sum(axis=0) + 0.05 * BUCKETS))
        scripts = table[2 * BUCKETS:]
    allowed = np.where(scripts >= script_share * np.maximum(scripts.sum(axis=0), 1), 0.0, -1e4)
    allowed[allowed.max(axis=1, initial=-1e4) < 0] = 0.0  # a script that no language is known to use decides nothing
    return Model(langs, score.astype(np.float32), allowed.astype(np.float32), switch)


def emissions(model: Model, w: Words) -> np.ndarray:
    """By (word, language), the best language at 0."""
    rated = model.score[w.features[:, 0]] + model.score[w.features[:, 1]]
    e = np.add.reduceat(rated, w.first, axis=0) + model.allowed[w.script]
    return e - e.max(axis=1, keepdims=True)


def best_paths(e: np.ndarray, owner: np.ndarray, switch: float) -> np.ndarray:
    """The label of every word: exact Viterbi over the words of each owner."""
    n, k = e.shape
    new_owner = np.flatnonzero(np.diff(owner, prepend=-1))
    in_owner = np.arange(n) - np.repeat(new_owner, np.diff(np.append(new_owner, n)))
    first = np.flatnonzero(in_owner % SEGMENT == 0)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    steps = np.arange(k)
    came = np.zeros((n, k, k), dtype=np.int8)  # by (word, label of the segment's first word, label): the label before
    value = np.full((len(first), k, k), -1e30, dtype=np.float64)
    value[:, steps, steps] = e[first]
    active = len(first)
    for t in range(1, int(length[0])):
        while active and length[active - 1] <= t:
            active -= 1
        v = value[:active]
        top = v.argmax(axis=2)
        jump = np.take_along_axis(v, top[:, :, None], 2) - switch
        came[first[:active] + t] = np.where(v >= jump, steps, top[:, :, None])
        value[:active] = np.maximum(v, jump) + e[first[:active] + t][:, None, :]
    # join the segments of an owner: the best label at the end of each, and with which first label it was reached
    last_label, first_label = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    by_place = np.argsort(first, kind="stable")
    group: list[int] = []
    places = [*by_place, -1]
    for at, s in enumerate(places):
        if group and (s < 0 or in_owner[first[s]] == 0):
            total, back = None, []
            for g in group:
                if total is None:
                    enter, source = np.zeros(k), steps
                else:
                    best = int(total.argmax())
                    enter, source = np.maximum(total, total[best] - switch), np.where(total >= total[best] - switch, steps, best)
                through = value[g] + enter[:, None]  # by (first label, last label)
                chosen = through.argmax(axis=0)
                back.append((chosen, source))
                total = through.max(axis=0)
            label = int(total.argmax())
            for g, (chosen, source) in zip(reversed(group), reversed(back)):
                last_label[g], first_label[g] = label, chosen[label]
                label = int(source[chosen[label]])
            group = []
        group.append(s)
    labels = np.zeros(n, dtype=np.int64)
    labels[first + length - 1] = last_label
    for t in range(int(length[0]) - 1, 0, -1):
        a = int(np.searchsorted(-length, -t, side="left"))  # segments with more than t words
        at = first[:a] + t
        labels[at - 1] = came[at, first_label[:a], labels[at]]
    return labels


def label(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text."""
    langs, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    w = words_of(texts)
    if not len(w.owner) or not model.langs:
        return langs, scores, spans
    labels = best_paths(emissions(model, w), w.owner, model.switch)
    k = len(model.langs)
    letters = np.bincount(w.owner * k + labels, weights=w.end - w.start, minlength=len(texts) * k).reshape(len(texts), k)
    best = letters.argmax(axis=1)
    for i in np.flatnonzero(letters.sum(axis=1)):
        langs[i], scores[i] = model.langs[best[i]], float(letters[i, best[i]] / letters[i].sum())
    opens = np.flatnonzero((np.diff(w.owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
    closes = np.append(opens[1:], len(labels)) - 1
    for a, b in zip(opens, closes):
        spans[w.owner[a]].append({"start": int(w.start[a]), "end": int(w.end[b]), "lang": model.langs[labels[a]]})
    return langs, scores, spans


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def labeller(model: Model):
    """An Arrow function from a text column to lang_pred, score and spans."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        langs, scores, spans = label(model, texts)
        cols = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(langs), pa.array(scores), pa.array(spans, RESULT.field("spans").type)], names=[*names, "lang_pred", "score", "spans"])
    return run


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans (characters, end exclusive) for each row of ``docs``."""
    run = labeller(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            yield run(batch)

    return id_text(docs).mapInArrow(go, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def in_known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a share of ``least`` or more of its letters."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            langs, scores, _ = label(model, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([x != "und" and y >= least for x, y in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return language_spans(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", F.col("score"), F.size("spans").alias("n_spans"))
