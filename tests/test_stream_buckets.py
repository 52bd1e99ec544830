import os

import pandas as pd
from pyspark.sql import functions as F

from formline.session import scratch
from formline.streaming import twins as st
from formline.streaming.processors import BothSides, BucketLast, BucketPairs


class Handle:
    """State of one bucket, kept in a dict."""

    def __init__(self):
        self.held = {}

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


def _fed(processor, rows):
    handle, out = Handle(), []
    processor.init(handle)
    for batch in rows:
        out.append([r for df in processor.handleInputRows((0,), iter([pd.DataFrame(batch)]), None) for r in df.astype(object).where(df.notna(), None).to_dict("records")])
    return out, handle


def test_sides_of_many_games_meet_in_one_bucket():
    side = lambda game, venue, mean: {"ts": pd.Timestamp("2020-01-01"), "match_id": game, "venue": venue, "mean": mean}
    out, handle = _fed(BothSides(["ts", "match_id"]), [[side(1, "H", 1.0), side(1, "A", None), side(2, "A", 3.0), side(3, "H", None)], [side(2, "H", 4.0)], [side(3, "A", 5.0)]])
    assert [[(r["match_id"], r["home_mean"], r["away_mean"]) for r in o] for o in out] == [[(1, 1.0, None)], [(2, 4.0, 3.0)], [(3, None, 5.0)]]
    assert not handle.held


def test_pairs_of_one_bucket_count_apart_and_mark_late_rows():
    game = lambda i, lo, hi, home, result: {"ts": pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), "match_id": i, "lo": lo, "hi": hi, "home": home, "result": result}
    out, _ = _fed(BucketPairs(["match_id"]), [[game(5, 1, 2, 1, "H"), game(6, 3, 4, 3, "D"), game(7, 1, 2, 2, "H"), game(8, 1, 2, 1, None)], [game(4, 1, 2, 1, "H"), game(9, 1, 2, 1, "A"), game(5, 3, 4, 3, "H"), game(10, 3, 4, 4, "H")]])
    counts = [{r["match_id"]: (r["lo_wins"], r["hi_wins"], r["draws"], r["games"]) for r in o} for o in out]
    assert counts[0] == {5: (0, 0, 0, 0), 6: (0, 0, 0, 0), 7: (1, 0, 0, 1), 8: (1, 1, 0, 2)}
    assert counts[1][9] == (1, 1, 0, 2) and counts[1][10] == (0, 0, 1, 1) and counts[1][4] == (None,) * 4


def test_entities_of_one_bucket_keep_apart_their_last_values():
    side = lambda i, ent, value, venue="H": {"ts": pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), "match_id": i, "ent": ent, "venue": venue, "value": value}
    first = [side(5, 1, 1.0), side(6, 2, 10.0), side(7, 1, None), side(8, 1, 4.0), side(9, 1, 7.0), side(10, 2, 20.0), side(11, 3, None)]
    second = [side(4, 1, 100.0), side(9, 2, 100.0), side(9, 1, 0.0, "A"), side(12, 1, 5.0), side(13, 2, 40.0), side(14, 2, 0.0), side(12, 3, 2.0)]
    out, handle = _fed(BucketLast(2, ["match_id", "ent", "venue"]), [first, second])
    means = [{(r["ent"], r["match_id"], r["venue"]): (r["mean"], r["n"]) for r in o} for o in out]
    assert means[0] == {(1, 5, "H"): (None, 0), (1, 7, "H"): (1.0, 1), (1, 8, "H"): (1.0, 1), (1, 9, "H"): (2.5, 2), (2, 6, "H"): (None, 0), (2, 10, "H"): (10.0, 1), (3, 11, "H"): (None, 0)}
    late = (None, None)
    assert means[1] == {(1, 4, "H"): late, (2, 9, "H"): late, (1, 9, "A"): (5.5, 2), (1, 12, "H"): (3.5, 2), (2, 13, "H"): (15.0, 2), (2, 14, "H"): (30.0, 2), (3, 12, "H"): (None, 0)}
    assert {k: v[0] for k, v in handle.held.items()} == {(1,): [0.0, 5.0], (2,): [40.0, 0.0], (3,): [2.0]}


def test_features_of_a_stream_keep_their_state_in_as_many_partitions_as_asked(spark):
    games = spark.range(30).select(F.timestamp_seconds((F.col("id") + 1) * 86_400).alias("ts"), F.lit(1).cast("long").alias("pool"), F.col("id").alias("match_id"), (F.col("id") % 3).alias("home"), (F.col("id") % 3 + 3).alias("away"),
                                   F.lit("H").alias("result"), F.lit(1.0).alias("score"), (F.col("id") % 5).alias("home_goals"), (F.col("id") % 2).alias("away_goals"))
    at, session = scratch(spark, "features"), spark.conf.get(st.PARTITIONS)
    stream = st.replay(games, [F.col("match_id") < 15, F.col("match_id") >= 15]).withWatermark("ts", "0 seconds")
    assert st.state_partitions(spark) <= min(int(session), spark.sparkContext.defaultParallelism)
    got = {r["match_id"]: r for r in st.run(st.game_features(stream), at=at, partitions=2).collect()}
    for operator in range(4):
        assert sorted(x for x in os.listdir(f"{at.removeprefix('file:')}/state/state/{operator}") if x.isdigit()) == ["0", "1"]
    assert spark.conf.get(st.PARTITIONS) == session
    assert len(got) == 30
    for i, r in got.items():
        earlier = [j for j in range(i) if j % 3 == i % 3][-5:]
        assert r["home_mean"] == (sum(j % 5 for j in earlier) / len(earlier) if earlier else None) and r["away_mean"] == (sum(j % 2 for j in earlier) / len(earlier) if earlier else None)
        assert r["games"] == r["lo_wins"] == i // 3
