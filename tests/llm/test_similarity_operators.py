import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import embedding_dedup, hyperminhash, line_dedup, minhash_dedup, substring_dedup
from formline.llm.components import components
from tests.llm import brute


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def pairs_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    tree = brute.Union(3000)
    for a, b in edges:
        tree.join(a, b)
    want = sorted((x, tree.find(x)) for x in {x for a, b in edges for x in (a, b) if a != b})
    assert rows_of(components(spark.createDataFrame(edges, "a long, b long"))) == sorted(want, key=str)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 16))
    y = [v + rng.normal(size=16) * np.linalg.norm(v) * 0.11 for v in x[:30] for _ in range(10)]
    vectors = [v.tolist() for v in np.concatenate([x, y])]
    vectors += [vectors[0], vectors[0], [2 * c for c in vectors[0]], None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [1.0], [1.0, 2.0], [float("inf")] * 16]
    ids = list(range(len(vectors)))
    ids[5], ids[8] = None, 7
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("v", "size", "class", "n", "key", "label", "good")])
    want = brute.near_vectors(list(zip(ids, vectors)))
    assert rows_of(embedding_dedup.near_vectors(df).drop("kept")) == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_blocks(spark):
    """A bucket cut into blocks gives the same links, each once."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=8)
    vectors = [(v + rng.normal(size=8) * 0.2).tolist() for _ in range(120)]
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(vectors)], "vec_id long, size long, v array<double>")
    counts, edges = embedding_dedup.links(df, block=16)
    want = {d: n for d, n, _ in brute.near_vectors(list(enumerate(vectors))) if n}
    assert {r.vec_id: r.n for r in counts.groupBy("vec_id").agg(F.sum("n").alias("n")).collect()} == want


def family_rows(seed=4):
    """Documents that share a long passage (Jaccard about 0.6) with pairs of near copies among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base, rows = [rng.choice(words) for _ in range(200)], []
    for i in range(120):
        text = base + [rng.choice(words) for _ in range(70)]
        rows.append(" ".join(text))
        for step, n in ((4, 1), (5, 5)):
            if i % step == 0:
                other = text[:]
                for _ in range(n):
                    other[rng.randrange(len(other))] = "q"
                rows.append(" ".join(other))
    rows += ["", None, "one two", "One  TWO\tthree", "one two", "É b c d e", "é b c d e", " ".join(words * 5)]
    ids = list(range(len(rows)))
    ids[3], ids[9] = None, 8
    return list(zip(ids, rows))


@pytest.mark.parametrize("percent,block", [(85, 1024), (80, 16)])
def test_near_documents(spark, percent, block):
    rows = family_rows()
    got = minhash_dedup.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent, block)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == brute.near_documents(rows, percent)


def test_near_documents_of_a_table(spark, folder, odd_docs, no_docs):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = minhash_dedup.op6_near_documents(spark, folder)
    assert rows_of(got.drop("kept")) == brute.near_documents(pairs_of(docs), 85)
    got = minhash_dedup.near_documents(odd_docs)
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == brute.near_documents(pairs_of(odd_docs), 85)
    assert minhash_dedup.near_documents(no_docs).count() == 0
    kept = minhash_dedup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted([1, 4, 5, 6, 7, 8, 10, 10, -5, 11, 12, 13, 14]) and kept.filter("doc_id is null").count() == 1
    assert minhash_dedup.one_of_each(no_docs).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, size=900, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:600]), np.unique(pool[150:])
        true = 450 / (600 + 750 - 450)
        regs = np.stack([hyperminhash.registers(a), hyperminhash.registers(b)])
        errors.append(hyperminhash.estimated(regs, np.array([0]), np.array([1]), np.array([len(a), len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.07


def mutated(rng, text, n):
    chars = list(text)
    for _ in range(n):
        kind, i = rng.randrange(3), rng.randrange(len(chars) + 1)
        if kind == 0:
            chars.insert(i, rng.choice("abé"))
        elif chars and kind == 1:
            del chars[i % len(chars)]
        elif chars:
            chars[i % len(chars)] = rng.choice("abé")
    return "".join(chars)


def test_banded_distance(spark):
    rng, pairs = random.Random(5), []
    for _ in range(600):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append((a, mutated(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), t).alias("near")).collect()
        assert all(r.near == (brute.edit_distance(r.a, r.b) <= t) for r in got)


def line_docs():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 60))) for _ in range(80)]
    docs = []
    for d in range(60):
        lines = [rng.choice(base) if rng.random() < 0.5 else mutated(rng, rng.choice(base), rng.randint(1, 3)) if rng.random() < 0.7 else "x" for _ in range(rng.randint(1, 8))]
        docs.append((d if d != 4 else None, "\n".join(lines)))
    return docs + [(200, None), (201, ""), (5, docs[5][1]), (6, "other text that is long enough\n" + base[0]), (202, base[1] * 300), (203, base[1] * 300 + "y")]


def plain_removed(df, threshold, least):
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    seen = [((r.doc_id is None, r.doc_id or 0, r.k, i), line) for r in rows if r.text is not None for i, line in enumerate(r.text.split("\n")) if len(line) >= least]
    first = {}
    for place, line in seen:
        first[line] = min(first.get(line, place), place)
    later = {a for a in first for b in first if first[b] < first[a] and abs(len(a) - len(b)) <= threshold and brute.edit_distance(a, b) <= threshold}
    gone = {}
    for place, line in seen:
        if place > first[line] or line in later:
            gone.setdefault((None if place[0] else place[1], place[2]), set()).add(place[3])
    return gone


@pytest.mark.parametrize("threshold", [1, 2])
def test_removed_lines(spark, threshold):
    df = spark.createDataFrame([d for d in line_docs() if len(d[1] or "") < 2000], "doc_id long, text string")
    got = {(r.doc_id, r.text_key): set(r.removed) for r in line_dedup.removed_lines(df, threshold, 24).collect()}
    assert got == plain_removed(df, threshold, 24)


def test_edits_follow_the_length(spark):
    """A changed word, date or number is found in lines of any length; the pairs are those of brute force."""
    rng = random.Random(8)
    rows = [(0, "Report of 12 March, all rooms open"), (1, "Report of 15 April, all rooms open"), (2, "Report of 17 March, all rooms open"),
            (3, "The committee met on Monday 3 May 2021 in the large hall and closed the meeting at noon as planned by all"),
            (4, "The committee met on Friday 8 May 2021 in the large hall and closed the meeting at noon as planned by all")]
    for n in [24, 27, 28, 29, 33, 34, 39, 40, 60, 95, 130, 250, 420]:
        line = "".join(rng.choice("abcdefghijé ") for _ in range(n))
        rows += [(len(rows) + i, mutated(rng, line, e)) for i, e in enumerate([0, 1, 2, n // 25, n // 18, n // 15])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bands = line_dedup.edit_bands()
    lines = [(d, t) for d, t in rows if len(t) >= 24]
    allowed = {t: max(b for b in bands if b[0] <= len(t))[1] for _, t in lines}
    near = {d for i, (d, a) in enumerate(lines) for _, b in lines[:i]
            if abs(len(a) - len(b)) <= (e := allowed[min(a, b, key=len)]) and (a == b or brute.edit_distance(a, b) <= e)}
    assert {r.doc_id for r in line_dedup.removed_lines(df).collect()} == near and {2, 4} <= near and len(near) > 30
    assert all(lo >= edits * 10 and lo <= 20 * edits + 19 for lo, edits, _, _ in bands)
    pairs = [(mutated(rng, a, rng.randint(0, 20)), a) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(60, 90))) for _ in range(60))]
    for t in (5, 14):
        got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), t).alias("near")).collect()
        assert all(r.near == (brute.edit_distance(r.a, r.b) <= t) for r in got)


def test_without_lines(spark, odd_docs, no_docs):
    df = spark.createDataFrame(line_docs(), "doc_id long, text string")
    assert line_dedup.removed_lines(df).filter("doc_id = 203").count() == 1  # one more sign in a very long line
    out = line_dedup.without_lines(odd_docs, line_dedup.removed_lines(odd_docs))
    assert out.columns == odd_docs.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (11, "Mail a.b@c.de or 10.0.0.1\nshort") in texts and (4, None) in texts and (5, "") in texts
    assert not any(d in (3, 9) for d, _ in texts) and any(d == 1 for d, _ in texts)
    assert line_dedup.removed_lines(no_docs).count() == 0 and line_dedup.without_lines(no_docs, line_dedup.removed_lines(no_docs)).count() == 0


def test_lines_meet_in_passes_and_leave_no_shuffle_files(spark, monkeypatch):
    """Edited copies on both sides of every border of a group, found alike in one pass and in many; one pass's keys go before the next ones come."""
    rng, rows = random.Random(5), []
    for lo, edits, _, _ in line_dedup.edit_bands(24, 400):
        for n in (lo - 1, lo, lo + edits - 1):
            line = "".join(rng.choice("abcdefghij ") for _ in range(max(n, 24)))
            rows += [(len(rows), line), (len(rows) + 1, mutated(rng, line, 2))]
            rows.append((len(rows), line + "xy"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id for r in line_dedup.removed_lines(df).collect()}
    monkeypatch.setattr(line_dedup, "PASS_CHARS", 100)
    texts = df.select(F.xxhash64("text").alias("h"), F.hash("text").alias("g"), F.col("text").alias("line")).distinct()
    parts = line_dedup.passes(line_dedup.line_keys(texts, 24))
    groups = line_dedup.key_groups(line_dedup.edit_bands())
    assert len(parts) > 4 and all(a <= b for a, b in parts) and [a for a, _ in parts] == sorted({a for a, _ in parts})
    assert all(line_dedup.edit_bands()[i - 1][1] <= most and k + w - 1 <= lo // (e + 1) for i, _, most, k, w in groups for lo, e, _, _ in [line_dedup.edit_bands()[i - 1]])
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: set(folder.getAllFiles().mkString("|").split("|"))
    before = kept()
    got = line_dedup.near_by_length(texts, 24)
    assert {f for f in kept() - before if "shuffle_" in f} == set()
    assert got.count() > 60 and {r.doc_id for r in line_dedup.removed_lines(df).collect()} == whole
    near = {r.doc_id for r in df.collect() for d, t in rows if d < r.doc_id and (t == r.text or abs(len(t) - len(r.text)) <= 2 and brute.edit_distance(t, r.text) <= 2)}
    assert near <= whole


def test_line_dedup_runs_no_python(spark, folder):
    plan = line_dedup.op10_line_dedup(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert line_dedup.op10_line_dedup(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def digest(df, **options):
    return rows_of(substring_dedup.without_repeats(df, substring_dedup.repeated(df, **options)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)))


def test_without_repeats(spark, odd_docs, no_docs):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 90))) for _ in range(40)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abé ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(400, None), (401, ""), (402, "a" * 500), (403, "a" * 300), (404, "ab" * 200), (405, "a" * 49), (None, rows[0][1] * 3), (5, rows[5][1]), (5, rows[8][1]), (-3, rows[9][1]),
             (406, rows[2][1] * 20)]
    assert digest(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=3000) == brute.without_repeats(rows)
    small = odd_docs.filter("length(text) < 5000 or text is null")
    assert digest(small) == brute.without_repeats(pairs_of(small))
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_pieces_miss_no_window(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    raws = [b"x" * n for n in (0, 49, 50, 149, 150, 1000)]
    seen = {(int(o), int(b) + i) for pieces, owner, base in substring_dedup.batches_of_pieces(raws, 100) for p, o, b in zip(pieces, owner, base) for i in range(len(p) - 49)}
    assert seen == {(i, s) for i, r in enumerate(raws) for s in range(len(r) - 49)}


def test_substring_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows_of(substring_dedup.op8_substring_dedup(spark, folder)) == brute.without_repeats(pairs_of(docs))
