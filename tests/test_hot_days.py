"""A third of all rows on one key and one day: days are cut into id ranges that hand their tails on."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from formline.operators import history as h
from formline.operators import ledger as led
from formline.operators import ratings as e

DAY = datetime.date(2021, 3, 1)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    out = []
    for i in range(600):
        ent, day = (1, 5) if i % 3 == 0 else (draw.randrange(1, 5), draw.randrange(12))
        out.append((i * 7 % 4201, DAY + datetime.timedelta(days=day), ent, "H", draw.choice([1, 0, -1, None]), float(draw.randrange(9))))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "match_id long, match_date date, ent long, venue string, res int, x double")


def by_entity(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        found.setdefault(r[2], []).append(r)
    return found


def test_no_range_is_much_larger_than_asked(table):
    cut = led.day_ranges(table, ["ent"], "match_date", "match_id", 20)
    sizes = [r.n for r in cut.groupBy("ent", "_t").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 24 and sum(sizes) == 600
    order = cut.select("ent", "_t", "match_date", "match_id").orderBy("ent", "_t", "match_id").collect()
    assert [(r.ent, r.match_date, r.match_id) for r in order] == sorted((r.ent, r.match_date, r.match_id) for r in order)
    whole = led.day_ranges(table, ["ent"], "match_date", "match_id")
    assert whole.filter(F.col("_t") != F.col("match_date")).count() == 0


@pytest.mark.parametrize("size", [1, 20, 1_000])
def test_last_rows_cross_ranges(table, rows, size):
    got = {r.match_id: [x.x for x in r.past] for r in led.last_rows_before(table, ["ent"], "match_date", "match_id", ["x"], 5, rows=size).collect()}
    want = {}
    for games in by_entity(rows).values():
        for i, r in enumerate(games):
            want[r[0]] = [g[5] for g in games[max(0, i - 5):i]]
    assert got == want


@pytest.mark.parametrize("size", [20, 1_000])
def test_neighbours_cross_ranges(table, rows, size):
    out = h.row_neighbour(table, ["ent"], "x", [2, -1, -3], rows=size)
    assert set(out.columns) == {*table.columns, "x_lag2", "x_lead1", "x_lead3"}
    got = {r.match_id: (r.x_lag2, r.x_lead1, r.x_lead3) for r in out.collect()}
    for games in by_entity(rows).values():
        at = lambda i: games[i][5] if 0 <= i < len(games) else None
        for i, r in enumerate(games):
            assert got[r[0]] == (at(i - 2), at(i + 1), at(i + 3))


@pytest.mark.parametrize("size", [20, 1_000])
def test_counter_crosses_ranges(table, rows, size):
    got = {r.match_id: r.counter for r in e.bounded_counter(table, rows=size).collect()}
    step = {1: 0.1, -1: -0.05, 0: -0.02, None: 0.0}
    for games in by_entity(rows).values():
        x = 0.5
        for r in games:
            assert got[r[0]] == pytest.approx(x, abs=1e-9)
            x = min(1.0, max(0.0, x + step[r[4]]))


def test_null_ids_stand_first(spark):
    data = [(None if i == 3 else i, DAY, 1, float(i)) for i in range(9)]
    df = spark.createDataFrame(data, "match_id long, match_date date, ent long, x double")
    got = {r.match_id: [x.x for x in r.past] for r in led.last_rows_before(df, ["ent"], "match_date", "match_id", ["x"], 2, rows=3).collect()}
    assert got[None] == [] and got[0] == [3.0] and got[4] == [1.0, 2.0] and got[8] == [6.0, 7.0]
    assert led.last_rows_before(df.limit(0), ["ent"], "match_date", "match_id", ["x"], 2).count() == 0
