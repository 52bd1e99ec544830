"""Every game is replayed once, in runs without a repeated entity, whatever the blocks; compared with a plain walk."""

import datetime
import random

import numpy as np
import pytest

from formline.operators import ratings as e

SCHEMA = "match_id long, match_date date, pool int, home long, away long, result string"


def log(spark, seed, n, entities, days):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        home = 1 if i % 3 == 0 else draw.randrange(1, entities)  # one entity holds a third of all games
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=draw.randrange(days))
        pool = draw.choice([1, 1, 1, 2])
        rows.append((i, day, pool, home, draw.randrange(1, entities), draw.choice(["H", "D", "A", None])))
    return spark.createDataFrame(rows, SCHEMA), rows


def walk(rows, rule):
    """(ratings before each game, last ratings), one game after another."""
    total, ratings, games, before = {}, {}, {}, {}
    for _, _, pool, home, away, result in rows:
        for ent in (home, away) if result else ():
            total[pool, ent] = total.get((pool, ent), 0) + 1
    for mid, _, pool, home, away, result in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        sides = (pool, home), (pool, away)
        count = total if rule.count_mode == "total" else games
        new = [rule.k_new is not None and count.get(s, 0) < rule.new_below for s in sides]
        rh, ra = (ratings.get(s, rule.init_new if fresh else rule.init) for s, fresh in zip(sides, new))
        before[mid] = rh, ra
        if result:
            score = {"H": 1.0, "D": 0.5, "A": 0.0}[result]
            expected = 1 / (1 + 10 ** ((ra - rh) / 400))
            ratings[sides[0]] = rh + (rule.k_new if new[0] else rule.k) * (score - expected)
            ratings[sides[1]] = ra + (rule.k_new if new[1] else rule.k) * (expected - score)
            for s in sides:
                games[s] = games.get(s, 0) + 1
    return before, ratings


@pytest.mark.parametrize("rule", [e.EloRule(), e.EloRule(k_new=50.0, new_below=6), e.EloRule(k_new=50.0, new_below=12, count_mode="total")])
@pytest.mark.parametrize("rows_per_task", [10_000, 120])
def test_equals_a_plain_walk(spark, rule, rows_per_task):
    df, rows = log(spark, 3, 600, 90, 25)
    before, last = walk(rows, rule)
    got = e.elo_history(df, rule, rows_per_task).collect()
    assert len(got) == len(before)
    for r in got:
        assert (r.home_elo, r.away_elo) == pytest.approx(before[r.match_id], abs=1e-7)
    final = {(r.pool, r.ent): r.elo for r in e.elo_final(df, rule, rows_per_task).collect()}
    assert final.keys() == last.keys() and all(final[k] == pytest.approx(last[k], abs=1e-7) for k in last)


def test_runs_hold_no_entity_twice_and_are_as_long_as_they_can_be():
    draw = np.random.default_rng(5)
    h, a = draw.integers(0, 40, 300), draw.integers(0, 40, 300)
    cuts = e._runs(h, a)
    assert cuts[0] == 0 and cuts[-1] == 300
    for start, end in zip(cuts, cuts[1:]):
        games = [{int(x), int(y)} for x, y in zip(h[start:end], a[start:end])]
        assert len(set().union(*games)) == sum(map(len, games))
        if end < 300:
            assert {int(h[end]), int(a[end])} & set().union(*games)
    assert e._runs(h[:0], a[:0]) == [0, 0]


def test_games_without_a_day_stand_first_in_blocks_too(spark):
    df, rows = log(spark, 4, 60, 12, 9)
    rows = [(r[0], None if r[0] % 10 == 0 else r[1], *r[2:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    want, _ = walk([(r[0], r[1] or datetime.date.min, *r[2:]) for r in rows], e.EloRule())
    for size in (1_000, 10):
        got = {r.match_id: (r.home_elo, r.away_elo) for r in e.elo_history(df, rows_per_task=size).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_entity_of_two_pools_is_rated_in_each(spark):
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(1, day, 1, 1, 2, "H"), (2, day, 2, 1, 3, "A")], SCHEMA)
    assert {(r.pool, r.ent): r.elo for r in e.elo_final(df).collect()} == {(1, 1): 1516.0, (1, 2): 1484.0, (2, 1): 1484.0, (2, 3): 1516.0}
    empty = df.limit(0)
    assert e.elo_history(empty).count() == 0 and e.elo_final(empty).count() == 0


def test_short_runs_are_rated_one_by_one_with_the_same_numbers(monkeypatch):
    rng = np.random.default_rng(5)
    for rule in (e.EloRule(), e.EloRule(k_new=50.0, new_below=40), e.EloRule(k_new=50.0, new_below=500, count_mode="total")):
        batches = [(rng.integers(0, 20, 3_000), rng.integers(0, 20, 3_000), rng.choice([0.0, 0.5, 1.0, np.nan], 3_000), (rng.integers(0, 1000, 3_000), rng.integers(0, 1000, 3_000))) for _ in range(3)]
        seen = []
        for short in (0, e.SHORT_RUN):
            called = []
            monkeypatch.setattr(e, "SHORT_RUN", short)
            one = e._Pool._one_by_one
            monkeypatch.setattr(e._Pool, "_one_by_one", lambda self, *a, one=one, called=called: called.append(1) or one(self, *a))
            pool = e._Pool(rule)
            out = [pool.play(*b) for b in batches]
            monkeypatch.undo()
            seen.append((out, pool.elo, pool.games))
            assert len(called) == (3 if short else 0)
        for (h, a), (x, y) in zip(seen[0][0], seen[1][0]):
            assert np.allclose(h, x, rtol=0, atol=1e-9) and np.allclose(a, y, rtol=0, atol=1e-9)
        assert np.array_equal(seen[0][2], seen[1][2])
