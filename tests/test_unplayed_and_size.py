"""Rows without a result, odd literals, tiny fractions and very large counts."""

import datetime

import pytest
from pyspark.sql import functions as F

from formline.functions import scalar as s
from formline.operators import aggregates
from formline.operators import evaluation as ev
from formline.operators import history as h
from formline.operators import joins as j
from formline.operators import ratings as e
from formline.operators import shape, audits
from formline.sources import readers as rd
from formline.sources import sinks as sk

DAY = datetime.date(2020, 1, 1)


def games(spark, results):
    rows = [(i + 1, DAY + datetime.timedelta(days=i), 1, 1, 2, r, 2020) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "match_id long, match_date date, pool int, home long, away long, result string, season int")


def test_ratings_skip_unplayed(spark):
    got = {r.match_id: (r.home_elo, r.away_elo) for r in e.elo_history(games(spark, ["H", None, "H"])).collect()}
    want = {r.match_id: (r.home_elo, r.away_elo) for r in e.elo_history(games(spark, ["H", "H"])).collect()}
    assert len(got) == 3 and got[1] == want[1] and got[2] == got[3] == want[2]


@pytest.mark.parametrize("results,share,games_,rate", [
    (["H", None, "D"], {1: 0.5, 2: 1.0, 3: 1.0}, {1: 0, 2: 1, 3: 1}, {3: 1.0}),
    ([None, "A", None, None, "H"], {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}, {2: 0, 5: 1}, {5: 0.0})])
def test_head_to_head_skips_unplayed(spark, results, share, games_, rate):
    got = {r.match_id: r.h2h for r in h.h2h_points(games(spark, results), 2).collect()}
    assert got == share
    rows = {r.match_id: r for r in h.h2h_winrate(games(spark, results)).collect()}
    assert {k: rows[k].h2h_games for k in games_} == games_ and {k: rows[k].h2h_winrate for k in rate} == rate


def test_last_n_looks_past_unplayed_days(spark):
    got = {r.match_id: r.h2h for r in h.h2h_points(games(spark, ["H", "A", None, None, None, "D", None, "H"]), 2).collect()}
    assert got[6] == 0.5 and got[7] == pytest.approx(1 / 6) and got[8] == pytest.approx(1 / 6)


def test_counter_skips_unplayed(spark):
    rows = [(1, DAY, 7, "H", 1), (2, DAY + datetime.timedelta(days=1), 7, "H", None), (3, DAY + datetime.timedelta(days=2), 7, "H", 1)]
    long = spark.createDataFrame(rows, "match_id long, match_date date, ent long, venue string, res int")
    got = {r.match_id: r.counter for r in e.bounded_counter(long).collect()}
    assert got[2] == got[3]


@pytest.mark.parametrize("text,want", [('{"r":0.25}', 0.25), ('{"r":-3}', -3.0), ('{"r":1234567890123}', 1234567890123.0), ('{"r":1e-3}', 0.001), ('{"r":"x"}', 9.0), ("{}", 9.0), (None, 9.0)])
def test_json_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(s.json_number(F.col("t"), "$.r", 9.0)).first()[0] == want


def test_literals_that_mix_escapes(spark):
    page = r"""var datesData = JSON.parse('\x5B{"id":"1","h":{"title":"K\xc3\xb6ln"}}]');"""
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r.rec.h.title for r in rd.embedded_json(df, "html").collect()] == ["Köln"]
    out = spark.createDataFrame([(r"a\x62\xZZc\x",), ("",), (None,)], "t string").select(s.unescape_hex(F.col("t")).alias("t")).collect()
    assert [r.t for r in out] == [r"ab\xZZc\x", "", None]


def test_tiny_fractions(spark):
    df = spark.range(2_000_000).withColumnRenamed("id", "k")
    assert 0 < shape.hash_sample(df, "k", 5e-6, 1).count() < 40
    assert shape.hash_sample(df, "k", 1.0, 1).count() == 2_000_000 and shape.hash_sample(df, "k", 0.0, 1).count() == 0


def test_counts_beyond_long_products(spark):
    """4e9 rows a class: the products pass 2**63."""
    counts = spark.createDataFrame([(0.0, 4_000_000_000, 0), (1.0, 0, 4_000_000_000)], "value double, pos long, neg long")
    auc = counts.agg((F.sum("pos").cast("double") * F.sum("neg")).alias("x")).first().x
    assert auc == 1.6e19
    body = spark.range(3).select(F.lit(2147483646).cast("decimal(20,0)").alias("d"))
    assert body.agg(F.sum(F.col("d") * 4_000_000_000).alias("s")).first().s == 2147483646 * 4_000_000_000 * 3


def test_variance_far_from_zero(spark):
    """Values near 1e9 with variance 1: no cancelling."""
    state = spark.createDataFrame([(i, 1e9 + (i % 2) * 2.0) for i in range(40)], "ent long, elo double")
    got = j.pair_difference_stats(state, "ent", "elo").first()
    values = [1e9 + (i % 2) * 2.0 for i in range(40)]
    pairs = [a - b for n, a in enumerate(values) for b in values[n + 1:]]
    mean = sum(pairs) / len(pairs)
    assert got.mean == pytest.approx(mean, abs=1e-6) and got.std == pytest.approx((sum((p - mean) ** 2 for p in pairs) / len(pairs)) ** 0.5, rel=1e-6)


def test_absent_columns_fail_the_audit(spark):
    name = next(iter(audits.PLAUSIBLE))
    rows = audits.plausible(spark.createDataFrame([(1.0,)], "other double"), {name: (0, 1)}).collect()
    assert [(r.check, r.subject, r.passed) for r in rows] == [("missing_column", name, 0)]


def test_fingerprint_depends_on_rows_only(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    one = sk.content_fingerprint(df).first().fingerprint
    assert one == sk.content_fingerprint(df.repartition(7)).first().fingerprint != sk.content_fingerprint(df.filter("id > 0")).first().fingerprint


def test_baselines_and_auc_still_agree(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.6), (1, 0.6), (1, 0.9)], "y int, p double")
    assert ev.roc_auc(df, F.col("y") == 1, "p").first().auc == 0.875


def test_games_without_a_result_are_not_counted(spark):
    m = games(spark, ["H", None, "A", None]).withColumns({"home_goals": F.when(F.col("result") == "H", 2).when(F.col("result") == "A", 0), "away_goals": F.when(F.col("result") == "H", 1).when(F.col("result") == "A", 1)})
    long = shape.to_long(m)
    assert {(r.lo_wins, r.hi_wins, r.draws, r.games) for r in e.pair_state(m, "2021-01-01").collect()} == {(1, 1, 0, 2)}
    assert {r.ent: r.games for r in aggregates.points_table(long).collect()} == {1: 2, 2: 2}
    assert {r.ent: r.games for r in aggregates.appearances(long).collect()} == {1: 2, 2: 2}
    assert {r.games for r in aggregates.side_stats(long, ["gf"]).collect()} == {2}
    assert {(r.match_id, r.games) for r in h.cumulative_record(long).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {r.match_id: r.winrate for r in h.windowed_winrate(m, long, 60, 2).collect()} == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5}
    assert {r.match_id: r.winrate for r in h.windowed_winrate(m, long, 60, 1).collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.5}
    state = {r.ent: r for r in e.state_as_of(m, long, "2021-01-01").collect()}
    assert state[1].games == 2 and state[1].points_mean_5 == 1.5 and str(state[1].last_day) == "2020-01-03"


def test_selection_frequency_counts_empty_runs(spark):
    runs = spark.createDataFrame([(["a", "b"],), (["a"],), ([],), (None,)], "selected array<string>")
    assert {r.feature: (r.n, r.frequency) for r in aggregates.selection_frequency(runs).collect()} == {"a": (2, 0.5), "b": (1, 0.25)}


def test_season_days_reach_the_scan(spark, folder):
    from formline.sources.contests import contests, season_days

    m = contests(spark, folder)
    for first, last in ((1996, 1998), (None, 1995), (1997, None)):
        cut = contests(spark, folder, **season_days(first, last))
        want = m.filter((F.col("season") >= (first or 0)) & (F.col("season") <= (last or 9999)))
        assert cut.count() == want.count() > 0 and cut.select("match_id").exceptAll(want.select("match_id")).isEmpty()
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in plan or "LessThan(o_orderdate" in plan


def test_buckets_follow_the_number_of_rows(spark):
    from formline.operators import ordered as o

    assert [o.buckets_for(n, 10) for n in (0, 1, 10, 11, 1_000)] == [1, 1, 1, 2, 100]
    rows = [(i, DAY + datetime.timedelta(days=0 if i % 3 else i % 5), float(i % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "match_id long, match_date date, x double")
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for small in (1, 7, 60, 1_000):
        assert {r.match_id: r.rn for r in o.with_row_number(df, "match_date", "match_id", small=small).collect()} == want
        found = o.keys_at_ranks(df, "match_date", "match_id", F.array(F.lit(1), F.lit(250), F.lit(400)), small=small).collect()
        assert {r["rank"]: r.match_id for r in found} == {k: i for i, k in want.items() if k in (1, 250, 400)}
    assert o.with_row_number(df.limit(0), "match_date", "match_id").count() == 0
