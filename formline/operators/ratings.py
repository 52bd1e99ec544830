"""Order-dependent state (E family): ratings, clamped counters, snapshots.

A rating chain is sequential inside a pool. Games stream through Arrow batches in (t, id) order and the only thing kept is one
rating per entity, so a pool of any size needs bounded memory. Inside a batch, games are cut into runs in which no entity plays
twice: games of a run do not depend on each other and are rated as one numpy step. Where runs hold fewer than SHORT_RUN games on
average (pools of few entities), a numpy step costs more than its games and they are rated one by one.

A pool with more than ``rows_per_task`` games is cut into blocks of time. A block takes the ratings its forerunner closed with from
a written table and hands its own on, so every game is replayed once, and a lost executor costs the block at hand, not the chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.operators.ledger import RANGE_ROWS, day_ranges
from formline.session import scratch

# Fixed values of the reference ratings.
INIT, K, SCALE = 1500.0, 32.0, 400.0
K_NEW, NEW_BELOW, INIT_NEW = 50.0, 76, 1400.0
UNSEEN_STD_SHARE = 0.5
LOOKBACK_MONTHS = 18
DIFF_SHIFT, DIFF_SPAN = 800.0, 1600.0
UP, DOWN, DECAY = 0.1, -0.05, -0.02
COUNTER_START = 0.5
ROWS_PER_TASK = 5_000_000
SHORT_RUN = 32  # games a run must hold on average to be worth a numpy step


@dataclass(frozen=True)
class EloRule:
    init: float = INIT
    k: float = K
    k_new: float | None = None      # K of an entity that still counts as new
    new_below: int = NEW_BELOW
    init_new: float = INIT_NEW
    count_mode: str = "so_far"      # or 'total': games in the whole table, which looks ahead


# kind 1: a game and the ratings before it; kind 0: an entity (home), its rating and games after the last one
ROWS = "kind int, pool long, match_id long, home long, away long, home_elo double, away_elo double, games long"
NO_ENTITY = np.iinfo(np.int64).min  # stands for a null entity inside a task


class _Pool:
    """Ratings and games of the entities of one pool; ids are sorted, a rating not yet set is NaN."""

    def __init__(self, rule: EloRule) -> None:
        self.rule = rule
        self.ids, self.elo, self.games = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def admit(self, ids: np.ndarray) -> None:
        merged = np.union1d(self.ids, ids)
        if len(merged) > len(self.ids):
            at = np.searchsorted(merged, self.ids)
            elo, games = np.full(len(merged), np.nan), np.zeros(len(merged), np.int64)
            elo[at], games[at] = self.elo, self.games
            self.ids, self.elo, self.games = merged, elo, games

    def open(self, ids: np.ndarray, elo: np.ndarray, games: np.ndarray) -> None:
        self.admit(ids)
        at = np.searchsorted(self.ids, ids)
        self.elo[at], self.games[at] = elo, games

    def play(self, home: np.ndarray, away: np.ndarray, score: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ratings of both sides before each game; games in order, NaN scores change nothing."""
        rule = self.rule
        self.admit(np.concatenate([home, away]))
        h, a = np.searchsorted(self.ids, home), np.searchsorted(self.ids, away)
        before = np.empty(len(h)), np.empty(len(h))
        cuts = _runs(h, a)
        if len(h) < SHORT_RUN * (len(cuts) - 1):
            return self._one_by_one(h, a, score, totals)
        for start, end in zip(cuts, cuts[1:]):
            sides = h[start:end], a[start:end]
            if rule.count_mode == "total":
                new = [t[start:end] < rule.new_below for t in totals]
            else:
                new = [self.games[x] < rule.new_below for x in sides]
            rated = []
            for x, fresh in zip(sides, new):
                opening = np.where(fresh, rule.init_new, rule.init) if rule.k_new is not None else rule.init
                rated.append(np.where(np.isnan(self.elo[x]), opening, self.elo[x]))
            rh, ra = rated
            before[0][start:end], before[1][start:end] = rh, ra
            s = score[start:end]
            done = ~np.isnan(s)
            expected = 1.0 / (1.0 + np.power(10.0, (ra - rh) / SCALE))
            steps = [np.where(fresh, rule.k_new, rule.k) if rule.k_new is not None else rule.k for fresh in new]
            after = rh + steps[0] * (s - expected), ra + steps[1] * ((1.0 - s) - (1.0 - expected))
            for x, value in zip(sides, after):
                self.elo[x[done]] = value[done]
                self.games[x[done]] += 1
        return before

    def _one_by_one(self, h: np.ndarray, a: np.ndarray, score: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``play`` without numpy steps; ``h`` and ``a`` are places in ``ids``."""
        rule, looks_ahead = self.rule, self.rule.count_mode == "total"
        used, at = np.unique(np.concatenate([h, a]), return_inverse=True)
        elo, games = self.elo[used].tolist(), self.games[used].tolist()
        init_new, k_new = (rule.init, rule.k) if rule.k_new is None else (rule.init_new, rule.k_new)
        before_h, before_a = [], []
        for x, y, s, th, ta in zip(at[:len(h)].tolist(), at[len(h):].tolist(), score.tolist(), *(t.tolist() for t in totals)):
            new_h, new_a = (th if looks_ahead else games[x]) < rule.new_below, (ta if looks_ahead else games[y]) < rule.new_below
            rh, ra = elo[x], elo[y]
            if rh != rh:
                rh = init_new if new_h else rule.init
            if ra != ra:
                ra = init_new if new_a else rule.init
            before_h.append(rh)
            before_a.append(ra)
            if s == s:
                expected = 1.0 / (1.0 + 10.0 ** min((ra - rh) / SCALE, 308.0))
                elo[x] = rh + (k_new if new_h else rule.k) * (s - expected)
                elo[y] = ra + (k_new if new_a else rule.k) * ((1.0 - s) - (1.0 - expected))
                games[x] += 1
                games[y] += 1
        self.elo[used], self.games[used] = elo, games
        return np.array(before_h, np.float64), np.array(before_a, np.float64)

    def close(self, pool: int | None) -> pa.RecordBatch:
        known = ~np.isnan(self.elo)
        n, ids = int(known.sum()), self.ids[known]
        none = pa.nulls(n, pa.int64())
        return _batch(0, [pool] * n, none, pa.array(ids, mask=ids == NO_ENTITY), none, pa.array(self.elo[known]),
                      pa.nulls(n, pa.float64()), pa.array(self.games[known]))


def _runs(h: np.ndarray, a: np.ndarray) -> list[int]:
    """Borders of the longest runs of games, from the left, in which no entity stands in two games."""
    flat = np.stack([h, a], 1).ravel()
    order = np.argsort(flat, kind="stable")
    again = flat[order[1:]] == flat[order[:-1]]
    last = np.full(len(flat), -1)
    last[order[1:][again]] = order[:-1][again] // 2
    last[last == np.arange(len(flat)) // 2] = -1  # an entity against itself is one game
    cuts = [0]
    for i, game in enumerate(last.reshape(-1, 2).max(1).tolist() if len(flat) else []):
        if game >= cuts[-1]:
            cuts.append(i)
    return [*cuts, len(h)]


def _batch(kind: int, pool, match_id, home, away, home_elo, away_elo, games) -> pa.RecordBatch:
    n = len(home)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(pool, pa.int64()), match_id, home, away, home_elo, away_elo, games],
        names=[c.split()[0] for c in ROWS.split(", ")])


def _replay(rule: EloRule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream of rows ordered by (pool, kind, t, id) -> ``ROWS``. kind 0 opens an entity (home, score = rating, hg = games); kind 1 is a
    game (score of the home side, hg and ag the total games of its sides)."""

    def ints(column: pa.Array, missing: int) -> np.ndarray:
        return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pools, kinds = ints(batch["pool"], NO_ENTITY), ints(batch["kind"], 1)
            parts = np.flatnonzero(np.diff(pools) | np.diff(kinds)) + 1
            for start, end in zip([0, *parts], [*parts, batch.num_rows]):
                rows = batch.slice(start, end - start)
                if state is None or pools[start] != key:
                    if state is not None:
                        yield state.close(None if key == NO_ENTITY else key)
                    key, state = pools[start], _Pool(rule)
                home, score = ints(rows["home"], NO_ENTITY), rows["score"].to_numpy(zero_copy_only=False)
                if kinds[start] == 0:
                    state.open(home, score, ints(rows["hg"], 0))
                    continue
                totals = ints(rows["hg"], 0), ints(rows["ag"], 0)
                rh, ra = state.play(home, ints(rows["away"], NO_ENTITY), score, totals)
                yield _batch(1, rows["pool"], rows["match_id"].cast(pa.int64()), rows["home"].cast(pa.int64()), rows["away"].cast(pa.int64()),
                             pa.array(rh), pa.array(ra), pa.nulls(len(rh), pa.int64()))
        if state is not None:
            yield state.close(None if key == NO_ENTITY else key)

    return run


def _games(df: DataFrame, rule: EloRule) -> DataFrame:
    score = F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).when(F.col("result") == "A", 0.0)  # null: not played yet
    g = df.select(F.col("pool").cast("long").alias("pool"), "match_id", "match_date", "home", "away", score.alias("score"))
    if rule.count_mode == "total":
        sides = g.filter(F.col("score").isNotNull()).select("pool", F.explode(F.array("home", "away")).alias("ent"))
        total = sides.groupBy("pool", "ent").agg(F.count(F.lit(1)).alias("n"))
        for side in ("home", "away"):
            part = total.select("pool", F.col("ent").alias(side), F.col("n").alias(f"{side[0]}g"))
            g = g.join(part, ["pool", side], "left")
        return g
    return g.withColumns({"hg": F.lit(0).cast("long"), "ag": F.lit(0).cast("long")})


def _replayed_once(games: DataFrame, openings: DataFrame | None, rule: EloRule) -> DataFrame:
    cols = ["pool", "kind", "match_date", "match_id", "home", "away", "score", "hg", "ag"]
    rows = games.withColumn("kind", F.lit(1)).select(*cols)
    if openings is not None:
        rows = rows.unionByName(openings.select("pool", "kind", "home", F.col("home_elo").alias("score"), F.col("games").alias("hg")),
                                allowMissingColumns=True)
    ordered = rows.repartition("pool").sortWithinPartitions("pool", "kind", "match_date", "match_id")
    return ordered.mapInArrow(_replay(rule), ROWS)


def _in_blocks(games: DataFrame, rows_per_task: int) -> DataFrame:
    """``games`` plus blk: consecutive days of a pool, closed by the day with which it passes ``rows_per_task`` games."""
    days = games.groupBy("pool", "match_date").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("pool").orderBy("match_date").rowsBetween(W.unboundedPreceding, -1)
    blk = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / rows_per_task).alias("blk")
    cut = days.select(F.col("pool").alias("_pool"), F.col("match_date").alias("_day"), blk)
    here = F.col("pool").eqNullSafe(F.col("_pool")) & F.col("match_date").eqNullSafe(F.col("_day"))
    return games.join(cut, here).drop("_pool", "_day")


def _replayed(df: DataFrame, rule: EloRule, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """(games with the ratings before them, entities with their last ones), both as ``ROWS``."""
    games = _games(df, rule)
    largest = games.groupBy("pool").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if largest <= rows_per_task:
        rows = _replayed_once(games, None, rule)
        return rows.filter("kind = 1"), rows.filter("kind = 0")
    spark = games.sparkSession
    home = scratch(spark, "elo-blocks")
    _in_blocks(games, rows_per_task).write.partitionBy("blk").parquet(f"{home}/games")
    cut = spark.read.parquet(f"{home}/games")
    state = None
    for blk in sorted(r.blk for r in cut.select("blk").distinct().collect()):
        path = f"{home}/rows/blk={blk}"
        _replayed_once(cut.filter(F.col("blk") == blk), state, rule).write.parquet(path)
        state = spark.read.parquet(path).filter("kind = 0")  # a pool without games in this block passes through
    return spark.read.parquet(f"{home}/rows").filter("kind = 1"), state


def elo_history(df: DataFrame, rule: EloRule = EloRule(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(pool, match_id, home, away, home_elo, away_elo): ratings before each game."""
    return _replayed(df, rule, rows_per_task)[0].select("pool", "match_id", "home", "away", "home_elo", "away_elo")


def elo_final(df: DataFrame, rule: EloRule = EloRule(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(pool, ent, elo): rating of each entity after its last game with a result."""
    return _replayed(df, rule, rows_per_task)[1].select("pool", F.col("home").alias("ent"), F.col("home_elo").alias("elo"))


def elo_warm_start(df: DataFrame, cutoff: str, months: int = LOOKBACK_MONTHS, rule: EloRule = EloRule()) -> DataFrame:
    """(pool, ent, elo, seen): ratings from the look-back window; every other known entity gets mean - std/2."""
    day = F.lit(cutoff).cast("date")
    past = df.filter(F.col("match_date") < day)
    recent = elo_final(past.filter(F.col("match_date") >= F.add_months(day, -months)), rule)
    known = past.select(F.col("pool").cast("long").alias("pool"), F.explode(F.array("home", "away")).alias("ent")).distinct()
    default = recent.agg((F.avg("elo") - UNSEEN_STD_SHARE * F.stddev_pop("elo")).alias("d")).scalar()
    out = known.join(recent, ["pool", "ent"], "left")
    return out.withColumns({"seen": F.col("elo").isNotNull().cast("int"),
                            "elo": F.coalesce(F.col("elo"), default, F.lit(rule.init))})


def shifted_diff(diff: Column) -> Column:
    """(d + 800) / 1600 clipped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (diff + DIFF_SHIFT) / DIFF_SPAN))


# --- clamped counter ---------------------------------------------------------------------------

def _clamp(x: float) -> float:
    return 0.0 if x < 0.0 else 1.0 if x > 1.0 else x


def _fold_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ent, cell, id, delta) in order -> one map x -> min(hi, max(lo, x + c)) per (ent, cell)."""
    key, c, lo, hi = None, 0.0, 0.0, 1.0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("ent", "day", "range", "c", "lo", "hi"), (*key, c, lo, hi))})

    for batch in batches:
        d = batch.to_pydict()
        done: list[tuple] = []
        for *cell, delta in zip(d["ent"], d["day"], d["range"], d["delta"]):
            if tuple(cell) != key:
                if key is not None:
                    done.append((*key, c, lo, hi))
                key, c, lo, hi = tuple(cell), 0.0, 0.0, 1.0
            c, lo, hi = c + delta, _clamp(lo + delta), _clamp(hi + delta)
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("ent", "day", "range", "c", "lo", "hi"), map(list, zip(*done)))))
    if key is not None:
        yield emit()


def _open_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps of an entity's cells in order -> its counter before each cell."""
    who, x = None, COUNTER_START
    for batch in batches:
        d = batch.to_pydict()
        before = []
        for ent, c, lo, hi in zip(d["ent"], d["c"], d["lo"], d["hi"]):
            if ent != who:
                who, x = ent, COUNTER_START
            before.append(x)
            x = min(hi, max(lo, x + c))
        yield pa.RecordBatch.from_pydict({"ent": d["ent"], "day": d["day"], "range": d["range"], "x": before})


def _inside_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, x = None, COUNTER_START
    for batch in batches:
        d = batch.to_pydict()
        before = []
        for *cell, start, delta in zip(d["ent"], d["day"], d["range"], d["x"], d["delta"]):
            if cell != key:
                key, x = cell, start
            before.append(x)
            x = _clamp(x + delta)
        yield pa.RecordBatch.from_pydict({"match_id": d["match_id"], "venue": d["venue"], "ent": d["ent"], "counter": before})


def bounded_counter(long: DataFrame, up: float = UP, down: float = DOWN, decay: float = DECAY, rows: int = RANGE_ROWS) -> DataFrame:
    """(match_id, venue, ent, counter): the clamped momentum of each side before each game.

    Clamped steps compose into one clamped step, so each (entity, day) folds on its own, the days
    of an entity chain on a small ledger, and the games of a day replay from the day's opening value.
    A day of more than ``rows`` games of one entity is cut into id ranges, which fold and replay like days.
    """
    delta = F.when(F.col("res") == 1, up).when(F.col("res") == -1, down).when(F.col("res") == 0, decay).otherwise(0.0)
    steps = day_ranges(long.select("ent", F.unix_date("match_date").cast("long").alias("day"), "match_id", "venue", delta.alias("delta")),
                       ["ent"], "day", "match_id", rows)
    part = F.col("_t")["range"] if steps.schema["_t"].dataType.typeName() == "struct" else F.lit(0)
    steps = steps.withColumn("range", part.cast("long")).drop("_t")
    cell = ["ent", "day", "range"]
    fold = steps.repartition(*cell).sortWithinPartitions(*cell, "match_id").mapInArrow(
        _fold_days, "ent long, day long, range long, c double, lo double, hi double")
    opened = fold.repartition("ent").sortWithinPartitions(*cell).mapInArrow(_open_days, "ent long, day long, range long, x double")
    joined = steps.join(opened, cell)
    return joined.repartition(*cell).sortWithinPartitions(*cell, "match_id").mapInArrow(
        _inside_days, "match_id long, venue string, ent long, counter double")


# --- snapshots ---------------------------------------------------------------------------------

def state_as_of(matches: DataFrame, long: DataFrame, cutoff: str, w: int = 5) -> DataFrame:
    """Per pool and entity: rating, record and means of the last ``w`` games with a result strictly before the cut-off."""
    from formline.functions.scalar import arr_mean, tail

    day = F.lit(cutoff).cast("date")
    past = long.filter((F.col("match_date") < day) & F.col("res").isNotNull())
    record = past.groupBy("pool", "ent").agg(
        F.count(F.lit(1)).alias("games"), F.sum((F.col("res") == 1).cast("int")).alias("wins"),
        F.sum((F.col("res") == 0).cast("int")).alias("draws"), F.sum((F.col("res") == -1).cast("int")).alias("losses"),
        F.sum("points").alias("points"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
        F.max("match_date").alias("last_day"))
    newest = W.partitionBy("pool", "ent").orderBy(F.desc("match_date"), F.desc("match_id"))
    last = (past.select("pool", "ent", "match_date", "match_id", "points", "gf").withColumn("rn", F.row_number().over(newest))
            .filter(F.col("rn") <= w).groupBy("pool", "ent").agg(F.array_sort(F.collect_list(
                F.struct("match_date", "match_id", "points", "gf"))).alias("last")))
    elo = elo_final(matches.filter(F.col("match_date") < day))
    out = record.join(last, ["pool", "ent"]).join(elo, ["pool", "ent"], "left")
    means = {f"{c}_mean_{w}": arr_mean(F.transform(tail(F.col("last"), w), lambda x: x[c])) for c in ("points", "gf")}
    return out.withColumns(means)


def pair_state(matches: DataFrame, cutoff: str) -> DataFrame:
    """(lo, hi, lo_wins, hi_wins, draws, games) of each unordered pair before the cut-off."""
    lo_home = F.col("home") < F.col("away")
    lo_won = F.when(lo_home, F.col("result") == "H").otherwise(F.col("result") == "A")
    hi_won = F.when(lo_home, F.col("result") == "A").otherwise(F.col("result") == "H")
    past = matches.filter((F.col("match_date") < F.lit(cutoff).cast("date")) & F.col("result").isNotNull())
    return past.groupBy(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).agg(
        F.sum(lo_won.cast("int")).alias("lo_wins"), F.sum(hi_won.cast("int")).alias("hi_wins"),
        F.sum((F.col("result") == "D").cast("int")).alias("draws"), F.count("result").alias("games"))


def state_summary(state: DataFrame, value: str = "elo") -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("entities"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                     F.min(value).alias("min"), F.max(value).alias("max"))
