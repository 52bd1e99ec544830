"""Hand-made frames: frame edges, leakage invariants, skew, exactness of the distributed forms."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formline.functions import market as mk
from formline.functions import scalar as s
from formline.operators import audits as v
from formline.operators import evaluation as ev
from formline.operators import history as h
from formline.operators import hooks as hk
from formline.operators import joins as j
from formline.operators import normalise as n
from formline.operators import ordered as o
from formline.operators import ratings as e
from formline.operators import selection as sel
from formline.operators import training as tr
from formline.operators.shape import to_long
from formline.operators.standings import positions_before
from formline.session import scratch
from formline.sources import readers as rd
from formline.sources import sinks as sk
from formline.sources.contests import contests, contests_long
from formline.streaming import twins as st

SCHEMA = ("match_id long, match_date date, season int, pool int, home long, away long, result string, home_goals long, "
          "away_goals long, home_xg double, away_xg double")


def day(k):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=k)


def log(spark, games):
    """games: (id, day offset, home, away, home goals, away goals)."""
    rows = []
    for i, d, a, b, x, y in games:
        r = "H" if x > y else "A" if x < y else "D"
        season = day(d).year - (1 if day(d).month < 8 else 0)
        rows.append((i, day(d), season, 0, a, b, r, x, y, float(x) + 0.5, float(y) + 0.25))
    return spark.createDataFrame(rows, SCHEMA)


def random_games(seed, n=400, ents=8, days=120, hot=None):
    """``hot``: an entity that takes part in about a third of all sides."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = hot if hot is not None and rnd.random() < 0.66 else rnd.randrange(ents)
        b = rnd.choice([x for x in range(ents) if x != a])
        if rnd.random() < 0.5:
            a, b = b, a
        out.append((i, rnd.randrange(days), a, b, rnd.randrange(4), rnd.randrange(4)))
    return out


def brute_last(games, ent, when, n, strict_id=None):
    """Points of the last n earlier games of an entity, oldest first."""
    past = []
    for i, d, a, b, x, y in games:
        if ent not in (a, b):
            continue
        if d < when or (strict_id is not None and d == when and i < strict_id):
            own, opp = (x, y) if ent == a else (y, x)
            past.append((d, i, 3 if own > opp else 1 if own == opp else 0))
    return [p for _, _, p in sorted(past)[-n:]]


@pytest.mark.parametrize("hot", [None, 3])
def test_form_equals_brute_force_with_ties_and_a_hot_entity(spark, hot):
    games = random_games(1, hot=hot)
    got = h.form_points(to_long(log(spark, games))).collect()
    assert len(got) == 2 * len(games)
    when = {g[0]: g[1] for g in games}
    for r in got:
        past = brute_last(games, r["ent"], when[r["match_id"]], 5)
        want = sum(past) / (3 * len(past)) if past else 0.5
        assert r["form"] == pytest.approx(want)


@pytest.mark.parametrize("hot", [None, 3])
def test_row_order_history_equals_brute_force(spark, hot):
    games = random_games(2, hot=hot)
    got = h.rolling(to_long(log(spark, games)), ["points"], [5], strict="row").collect()
    when = {g[0]: g[1] for g in games}
    for r in got:
        past = brute_last(games, r["ent"], when[r["match_id"]], 5, strict_id=r["match_id"])
        assert r["points_mean_5"] == (pytest.approx(sum(past) / len(past)) if past else None)


def test_same_day_rows_do_not_see_each_other(spark):
    m = log(spark, [(1, 0, 0, 1, 2, 0), (2, 5, 0, 1, 1, 0), (3, 5, 0, 2, 0, 3)])
    rows = {(r["match_id"], r["ent"]): r for r in h.cumulative_record(to_long(m)).collect()}
    assert rows[(2, 0)]["games"] == 1 and rows[(3, 0)]["games"] == 1
    rest = {(r["match_id"], r["ent"]): r["days_rest"] for r in h.days_rest(to_long(m)).collect()}
    assert rest[(1, 0)] == 7 and rest[(2, 0)] == 5 and rest[(3, 0)] == 0


def test_future_rows_never_change_past_features(spark):
    games = random_games(3)
    early = [g for g in games if g[1] < 60]

    def features(gs):
        m = log(spark, gs)
        long = to_long(m)
        x = h.h2h_points(h.form_points_split(m, long))
        x = h.windowed_winrate(h.season_points(x, long), long)
        x = positions_before(x, long)
        x = x.join(e.elo_history(m).select("match_id", "home_elo", "away_elo"), "match_id")
        cols = ["home_form", "away_form", "h2h", "winrate", "season_points_diff", "position_value", "home_elo", "away_elo"]
        return {r["match_id"]: tuple(round(r[c], 9) for c in cols) for r in x.collect()}

    whole, part = features(games), features(early)
    assert all(whole[k] == part[k] for k in part)


def test_input_order_does_not_matter(spark):
    games = random_games(4, n=200)
    mixed = random.Random(9).sample(games, len(games))
    run = lambda gs: {(r["match_id"], r["venue"]): r["slope"] for r in h.result_slope(to_long(log(spark, gs))).collect()}
    assert run(games) == run(mixed)


def test_feature_set_season_points_equal_the_operator(spark):
    from formline.plans.features import FeatureSet
    m = log(spark, random_games(13, n=200, days=300))
    long = to_long(m)
    got = FeatureSet.only("season", "form", "xg").build(m, long)
    want = h.season_points(m, long)
    key = lambda df: sorted((r["match_id"], r["home_season_points"], r["season_points_diff"]) for r in df.collect())
    assert key(got) == key(want)


def test_league_position_equals_brute_force(spark):
    games = random_games(5, n=300, days=100)
    m = log(spark, games)
    got = {r["match_id"]: r for r in positions_before(m, to_long(m)).collect()}
    for i, d, a, b, _, _ in games:
        season = lambda k: day(k).year - (1 if day(k).month < 8 else 0)
        pts = {}
        for _, d2, a2, b2, x2, y2 in games:
            if d2 < d and season(d2) == season(d):
                pts[a2] = pts.get(a2, 0) + (3 if x2 > y2 else 1 if x2 == y2 else 0)
                pts[b2] = pts.get(b2, 0) + (3 if y2 > x2 else 1 if x2 == y2 else 0)
        order = [ent for ent, _ in sorted(pts.items(), key=lambda kv: (-kv[1], kv[0]))]
        pos = lambda ent: order.index(ent) + 1 if ent in pts else 10
        assert (got[i]["home_position"], got[i]["away_position"]) == (pos(a), pos(b))
        assert got[i]["position_value"] == pytest.approx(0.5 if not pts else (pos(b) - pos(a) + 20) / 40)


def test_elo_is_zero_sum_and_blocks_give_the_same_ratings(spark):
    m = log(spark, random_games(6, n=300))
    one = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in e.elo_history(m).collect()}
    cut = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in e.elo_history(m, rows_per_task=40).collect()}
    assert one == cut
    final = e.elo_final(m).collect()
    assert sum(r["elo"] for r in final) == pytest.approx(1500 * len(final))
    again = {(r["ent"], round(r["elo"], 9)) for r in e.elo_final(m, rows_per_task=40).collect()}
    assert again == {(r["ent"], round(r["elo"], 9)) for r in final}


def test_elo_blocks_with_new_entity_rule(spark):
    m = log(spark, random_games(7, n=300))
    for mode in ("so_far", "total"):
        rule = e.EloRule(k_new=50.0, new_below=30, count_mode=mode)
        one = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in e.elo_history(m, rule).collect()}
        cut = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in e.elo_history(m, rule, rows_per_task=50).collect()}
        assert one == cut


def test_bounded_counter_equals_sequential_walk(spark):
    games = random_games(8, n=250, hot=2)
    got = {(r["match_id"], r["ent"]): r["counter"] for r in e.bounded_counter(to_long(log(spark, games))).collect()}
    state = {}
    for i, d, a, b, x, y in sorted(games, key=lambda g: (g[1], g[0])):
        for ent, own, opp in ((a, x, y), (b, y, x)):
            assert got[(i, ent)] == pytest.approx(state.get(ent, 0.5))
        for ent, own, opp in ((a, x, y), (b, y, x)):
            step = 0.1 if own > opp else -0.05 if own < opp else -0.02
            state[ent] = min(1.0, max(0.0, state.get(ent, 0.5) + step))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1501])
def test_exact_quantiles(spark, size):
    rnd = random.Random(size)
    vals = [rnd.choice([0.0, rnd.random(), rnd.randrange(5)]) for _ in range(size)]
    df = spark.createDataFrame([(float(x),) for x in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = {r["p"]: r["q"] for r in o.exact_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p))), p


def test_exact_quantiles_when_one_value_owns_a_third(spark):
    vals = [1.0] * 700 + [i / 7 for i in range(1400)]
    df = spark.createDataFrame([(x,) for x in vals], "x double").repartition(5)
    got = {r["p"]: r["q"] for r in o.exact_quantiles(df, ["x"], [0.05, 0.33, 0.66]).collect()}
    assert got == pytest.approx({p: float(np.quantile(vals, p)) for p in (0.05, 0.33, 0.66)})


def test_row_numbers_and_cuts_with_a_hot_day(spark):
    rnd = random.Random(3)
    rows = [(i, day(0 if rnd.random() < 0.4 else rnd.randrange(30))) for i in rnd.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "match_id long, match_date date").repartition(7)
    want = {i: k + 1 for k, (i, d) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["match_id"]: r["rn"] for r in o.with_row_number(df, "match_date", "match_id").collect()} == want
    folds = {r["match_id"]: r["fold"] for r in ev.time_series_folds(df, 4).collect()}
    size = 900 // 5
    assert folds == {i: -1 if k <= 900 - 4 * size else (k - (900 - 4 * size) - 1) // size for i, k in want.items()}
    parts = {r["match_id"]: r["part"] for r in ev.last_n_split(df, 380).collect()}
    assert parts == {i: "test" if k > 520 else "train" for i, k in want.items()}
    assert {r["part"] for r in ev.last_n_split(df, 5000).collect()} == {"test"}
    # The forms for days too large for one task.
    assert {r["match_id"]: r["rn"] for r in o.with_row_number(df, "match_date", "match_id", small=0).collect()} == want
    ranks = F.array(F.lit(1), F.lit(200), F.lit(360), F.lit(900))
    found = {r["rank"]: r["match_id"] for r in o.keys_at_ranks(df, "match_date", "match_id", ranks, small=0).collect()}
    assert found == {k: i for i, k in want.items() if k in (1, 200, 360, 900)}


def test_running_counts_in_buckets(spark):
    rnd = random.Random(12)
    rows = [(c, float(x), rnd.randrange(1, 5)) for c in "ab" for x in rnd.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "col string, value double, n long")
    get = lambda small: {(r["col"], r["value"]): r["n_before"] for r in o.running_counts(df, "value", ["n"], ["col"], small=small).collect()}
    assert get(0) == get(10_000) == {(c, x): sum(n2 for c2, x2, n2 in rows if c2 == c and x2 < x) for c, x, _ in rows}


def test_average_ranks_match_pandas(spark):
    rnd = random.Random(4)
    vals = [float(rnd.randrange(20)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in vals], "x double")
    got = sorted((r["x"], r["x_rank"]) for r in o.average_ranks(df, ["x"]).collect())
    assert got == sorted(zip(vals, pd.Series(vals).rank().tolist()))


def test_pair_statistics_without_pairs(spark):
    rnd = random.Random(5)
    vals = [rnd.random() for _ in range(57)]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, v double")
    got = j.pair_difference_stats(df, "k", "v").first()
    diffs = [vals[a] - vals[b] for a in range(57) for b in range(a + 1, 57)]
    assert (got["pairs"], got["mean"], got["std"], got["min"], got["max"]) == pytest.approx(
        (len(diffs), np.mean(diffs), np.std(diffs), min(diffs), max(diffs)))


def test_as_of_is_strict_unless_asked(spark):
    left = spark.createDataFrame([(1, 1, day(0)), (2, 1, day(5)), (3, 1, day(9)), (4, 2, day(5))], "id long, e long, t date")
    right = spark.createDataFrame([(1, day(5), "a"), (1, day(2), "b")], "e long, t date, v string")
    get = lambda eq: {r["id"]: r["v"] for r in j.as_of(left, right, ["e"], "t", ["v"], eq).collect()}
    assert get(False) == {1: None, 2: "b", 3: "a", 4: None}
    assert get(True) == {1: None, 2: "a", 3: "a", 4: None}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "c double, x double")
    assert sel.pearson_pairs(df, ["c", "x"]).first()["r"] is None
    cols = ["c"]
    assert {r["c_norm"] for r in n.min_max(df, n.fit(df, cols), cols).collect()} == {0.5}
    assert {r["c_norm"] for r in n.iqr_robust(df, n.fit_iqr(df, cols), cols).collect()} == {0.5}
    assert {r["c_norm"] for r in n.auto(df, n.fit(df, cols), cols).collect()} == {0.5}
    assert {r["c_norm"] for r in n.standard(df, n.fit_standard(df, cols), cols).collect()} == {0.0}


def test_one_bookmaker_and_zero_denominators(spark):
    df = spark.createDataFrame([(2.0, None, None)], "a double, b double, c double")
    cols = [F.col(x) for x in "abc"]
    r = df.select(mk.row_std(cols).alias("s"), mk.row_mean(cols).alias("m"), mk.implied(F.lit(0.0)).alias("z"),
                  s.ratio(F.col("a"), F.lit(0), 0.5).alias("q"), s.clip(F.col("b"), 0, 1).alias("n")).first()
    assert (r["s"], r["m"], r["z"], r["q"], r["n"]) == (None, 2.0, 0.0, 0.5, None)
    row = spark.createDataFrame([(1,)], "x int").select(
        h.efficiency_value(F.lit(2.0), F.lit(0.0), "null_if_zero").alias("a"),
        h.efficiency_value(F.lit(2.0), F.lit(0.0), "bounded").alias("b")).first()
    assert (row["a"], row["b"]) == (None, 3.0)


def test_season_border(spark):
    df = spark.createDataFrame([(datetime.date(2020, 7, 31),), (datetime.date(2020, 8, 1),)], "d date")
    assert [r[0] for r in df.select(s.season_label(F.col("d"))).collect()] == ["2019-2020", "2020-2021"]


def test_push_keeps_the_list_bounded(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 4.0), ([1.0], None)], "a array<double>, x double")
    assert [list(r[0]) for r in df.select(s.push(F.col("a"), F.col("x"), 3)).collect()] == [[2.0, 3.0, 4.0], [1.0]]


# --- validator cases ------------------------------------------------------------------------------

@pytest.mark.parametrize("rows, failing", [
    ([(0.1, 0), (0.9, 1), (0.5, 2)], set()),
    ([(None, 0), (0.9, 1)], {"nulls"}),
    ([(0.1, 0), (0.5, 3)], {"bad_target"}),
    ([(-0.1, 0), (1.5, 1)], {"not_normalised"}),
])
def test_validator(spark, rows, failing):
    df = spark.createDataFrame(rows, "a double, y int")
    assert {r["check"] for r in v.schema_and_domain(df, ["a"], "y", [0, 1, 2]).filter("passed = 0").collect()} == failing


def test_validator_names_missing_columns(spark):
    df = spark.createDataFrame([(0.1, 0)], "a double, y int")
    bad = v.schema_and_domain(df, ["a", "b"], "y", [0, 1, 2]).filter("passed = 0").collect()
    assert [(r["check"], r["subject"]) for r in bad] == [("missing_columns", "b")]


def test_guard_blocks_overlapping_splits(spark):
    m = log(spark, random_games(10, n=40, days=60))
    good = ev.split_by_date(m, "2020-02-01")
    assert hk.guarded(good, lambda df: df, advisory=("shared",)).count() == 40
    leaky = good.withColumn("part", F.when(F.col("match_id") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(hk.LeakageError):
        hk.guarded(leaky, lambda df: df)


def test_fingerprint(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    mark = lambda d: sk.content_fingerprint(d).first()["fingerprint"]
    assert mark(df) == mark(df.repartition(7)) == mark(df.orderBy(F.desc("id")))
    assert mark(df) != mark(df.withColumn("x", F.when(F.col("id") == 57, 0).otherwise(F.col("x"))))


# --- sources --------------------------------------------------------------------------------------

def test_embedded_json_plain_and_hex(spark):
    rec = '[{"id":"7","datetime":"2020-01-02 15:00:00","h":{"title":"A"},"a":{"title":"B"},"goals":{"h":"2","a":"1"},"xG":{"h":"1.5","a":"0.25"}}]'
    hexed = "".join(f"\\x{b:02x}" for b in rec.encode())
    pages = spark.createDataFrame([(1, f"<script>var datesData = JSON.parse('{hexed}');</script>"),
                                   (2, f"<script>var x = JSON.parse('{rec}')</script>"), (3, "<p>none</p>")], "page_id long, html string")
    got = rd.xg_records(rd.embedded_json(pages, "html")).collect()
    assert [(r["home"], r["away"], r["home_goals"], r["away_xg"]) for r in got] == [("A", "B", 2, 0.25)] * 2


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert rd.nan_to_null(df).agg(F.avg("x")).first()[0] == 2.0


def test_versions_and_history(spark):
    base = scratch(spark, "t")
    sk.write_versioned(spark.range(3).toDF("a"), base, "2024_01_01_000000")
    sk.write_versioned(spark.range(5).toDF("a"), base, "2024_01_02_000000")
    assert sk.read_latest(spark, base).count() == 5
    path = scratch(spark, "h")
    for k in range(2):
        sk.append_history(spark.range(1).select(F.lit(k).alias("k")), path)
    assert spark.read.schema("k int").json(path).count() == 2


# --- evaluation -----------------------------------------------------------------------------------

def test_auc_matches_pair_counting(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(2), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ev.roc_auc(df, F.col("y") == 1, "p").first()["auc"] == pytest.approx(want)


def test_report_of_absent_class_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (2, 0)], "actual int, pred int")
    rows = {r["label"]: r for r in ev.class_report(ev.confusion(df)).collect()}
    assert rows["1"]["f1"] == 0 and rows["2"]["recall"] == 0 and rows["0"]["precision"] == 0.5


def test_bootstrap_agrees_with_row_resampling(spark):
    rnd = random.Random(7)
    rows = [(rnd.random() < 0.6, rnd.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, "a boolean, b boolean")
    got = ev.bootstrap_scores(df, F.col("a"), F.col("b"), 2000, 1).agg(F.avg("a"), F.stddev("a"), F.stddev(F.col("a") - F.col("b"))).first()
    arr = np.array(rows, dtype=float)
    gen = np.random.default_rng(0)
    draws = np.array([arr[gen.integers(0, 400, 400)].mean(axis=0) for _ in range(2000)])
    assert got[0] == pytest.approx(draws[:, 0].mean(), abs=0.005)
    assert got[1] == pytest.approx(draws[:, 0].std(), rel=0.1)
    assert got[2] == pytest.approx((draws[:, 0] - draws[:, 1]).std(), rel=0.1)


def test_vote_ties_take_the_smallest_class(spark):
    df = spark.createDataFrame([(2, 1, 0), (2, 2, 0), (1, 2, 2)], "a int, b int, c int")
    assert [r[0] for r in df.select(ev.hard_vote([F.col(x) for x in "abc"])).collect()] == [0, 2, 2]


def test_greedy_prune_drops_the_less_informative():
    pairs = [("a", "b", 0.9), ("b", "c", 0.85), ("a", "d", 0.1)]
    assert sel.greedy_prune(pairs, {"a": 0.3, "b": 0.5, "c": 0.1, "d": 0.2}, 0.8) == ["b", "d"]


def test_oversample_stays_on_segments_with_a_repeated_row(spark):
    rnd = random.Random(8)
    rows = [(i, 1, *((0.5, 0.5) if i < 100 else (rnd.random(), rnd.random()))) for i in range(300)]
    df = spark.createDataFrame([*rows, (999, 0, 9.0, 9.0)], "match_id long, y int, a double, b double")
    got = tr.oversample(df, ["a", "b"], "y", 1, "match_id", copies=2).collect()
    assert len(got) == 600 and all(0 <= r["a"] <= 1 and 0 <= r["b"] <= 1 and r["y"] == 1 for r in got)
    again = tr.oversample(df.repartition(5), ["a", "b"], "y", 1, "match_id", copies=2)
    assert sorted((r["match_id"], r["copy"], round(r["a"], 9)) for r in again.collect()) == sorted(
        (r["match_id"], r["copy"], round(r["a"], 9)) for r in got)


def test_calibrated_probabilities_sum_to_one(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(300):
        p = sorted(rnd.random() for _ in range(2))
        rows.append((rnd.randrange(3), p[0], p[1] - p[0], 1 - p[1]))
    df = spark.createDataFrame(rows, "y int, p_h double, p_d double, p_a double")
    out = tr.calibrate(df, tr.fit_calibrator(df, "y")).select(F.col("cal_p_h") + F.col("cal_p_d") + F.col("cal_p_a")).collect()
    assert all(r[0] == pytest.approx(1.0) for r in out)


# --- streams --------------------------------------------------------------------------------------

def test_sessions_join_across_midnight(spark):
    ts = lambda text: datetime.datetime.fromisoformat(text)
    rows = [(1, ts("2024-01-01 23:50:00")), (1, ts("2024-01-02 00:10:00")), (1, ts("2024-01-02 03:00:00")), (2, ts("2024-01-01 23:59:00"))]
    df = spark.createDataFrame(rows, "u long, ts timestamp")
    got = sorted((r["u"], r["start"], r["n"]) for r in st.sessions(df, "u", "ts", "1 hour").collect())
    assert got == [(1, rows[0][1], 2), (1, rows[2][1], 1), (2, rows[3][1], 1)]


def test_day_barrier_releases_closed_days_from_the_state_before_them(spark):
    games = random_games(14, n=60, ents=4, days=10)
    long = to_long(log(spark, games))
    rows = long.select("ent", st.day_start(F.col("match_date")).alias("ts"), F.unix_date("match_date").alias("day"), "match_id", "venue",
                       F.col("points").cast("long").alias("points"))
    rows = rows.unionByName(st.end_of_log(rows))
    cuts = [(0, 4), (4, 7), (7, 10), (10, 99)]
    first = F.unix_date(F.lit(day(0)))
    stream = st.replay(rows, [(F.col("day") - first >= a) & (F.col("day") - first < b) for a, b in cuts], rows_per_file=10)
    got = {(r["match_id"], r["ent"]): (r["games"], r["points"]) for r in st.run(st.day_barrier(stream)).collect()}
    want = {(r["match_id"], r["ent"]): (r["games"], r["total_points"]) for r in h.cumulative_record(long).collect()}
    assert got == want


def test_stream_ratings_equal_batch_ratings(spark):
    m = log(spark, random_games(11, n=120))
    score = F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)
    rows = m.select(F.col("pool").cast("long").alias("pool"), F.col("match_date").cast("timestamp").alias("ts"), "match_id", "home", "away",
                    score.alias("score"))
    mid = F.lit("2020-02-15").cast("timestamp")
    out = st.run(st.elo(st.replay(rows, [F.col("ts") < mid, F.col("ts") >= mid], rows_per_file=50)))
    got = {r["match_id"]: round(r["home_elo"], 9) for r in out.collect()}
    assert got == {r["match_id"]: round(r["home_elo"], 9) for r in e.elo_history(m).collect()}


# --- plans ----------------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark, folder):
    text = plan(contests(spark, folder).filter(F.col("season") >= 1999).select("match_id", "result"))
    assert "o_totalprice" not in text and "lineitem" not in text


def test_rolling_history_stays_in_the_jvm_and_off_single_tasks(spark, folder):
    text = plan(h.rolling(contests_long(spark, folder), ["xg"], [5, 10]))
    assert "Python" not in text and "Arrow" not in text and "SinglePartition" not in text
    assert "WindowGroupLimit" in text


def test_normaliser_adds_no_shuffle_to_the_facts(spark, folder):
    m = contests(spark, folder)
    out = n.min_max(m, n.fit(m, ["home_xg"]), ["home_xg"])
    main = plan(out).split("Subquery")[0]
    assert "Exchange hashpartitioning" not in main and "CartesianProduct" not in plan(out)


def test_no_query_uses_a_cross_join_of_rows(spark, folder):
    from formline.plans.catalog import QUERIES
    for name in ("j10_pair_difference_stats", "n10_dynamic_difference", "n01_min_max", "a01_value_share", "m02_time_series_folds"):
        text = plan(QUERIES[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(0, 0.0, 0.5, 0.5)], "actual int, p_h double, p_d double, p_a double")
    loss = df.select(ev.row_log_loss(F.col("actual"), [F.col(p) for p in ev.PROBS])).first()[0]
    assert loss == pytest.approx(-math.log(1e-15), rel=1e-6)
