"""Point-in-time features (W family). ``long`` is the two-rows-per-contest view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.functions.scalar import arr_mean, arr_std, arr_sum, clip, tail
from formline.operators.ledger import (RANGE_ROWS, attach, attach_sides, day_ranges, last_n_before, last_n_state,
                                       last_rows_before, sums_before)

ENT, T, ID = "ent", "match_date", "match_id"

# Fixed values of the reference features.
NEUTRAL = 0.5
FIRST_REST_DAYS = 7
DECAY, DECAY_GAMES = 0.93, 10
SLOPE_GAMES, SLOPE_HISTORY = 5, 8
VOLATILITY_GAMES, VOLATILITY_MIN = 8, 3
FLAT_WINRATE_DAYS, FLAT_WINRATE_MIN = 60, 3
EFFICIENCY_FLOOR, EFFICIENCY_LOW, EFFICIENCY_HIGH = 0.5, 0.3, 3.0
EPSILON = 1e-6
UNSEEN_POSITION, TABLE_SPAN = 10, 20
PRESSURE_DAYS = 200
PERF_MIN = 5


def field(arr: Column, name: str) -> Column:
    return F.transform(arr, lambda x: x[name])


def with_past(long: DataFrame, cols: Sequence[str], n: int, strict: str = "time", keys: Sequence[str] = (ENT,),
              out: str = "past") -> DataFrame:
    """``strict='time'``: rows of earlier days. ``strict='row'``: earlier rows in (t, id) order."""
    if strict == "row":
        return last_rows_before(long, keys, T, ID, cols, n, out)
    return attach(long, last_n_before(long, keys, T, ID, cols, n, out), keys, T)


def from_past(long: DataFrame, cols: Sequence[str], n: int, values: Mapping[str, Column], strict: str = "time") -> DataFrame:
    """``long`` plus expressions over its ``past``.

    With day-strict history the expressions run on the ledger, so the join back to the rows carries
    finished numbers instead of lists. A row without history sees an empty list.
    """
    if strict == "row":
        return last_rows_before(long, [ENT], T, ID, cols, n, "past").withColumns(dict(values)).drop("past")
    ledger = last_n_before(long, [ENT], T, ID, cols, n, "past")
    return attach(long, ledger.select(ENT, T, *[v.alias(k) for k, v in values.items()]), [ENT], T)


def null_sum(arr: Column) -> Column:
    kept = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, arr_sum(kept))


def rolling(long: DataFrame, cols: Sequence[str], windows: Sequence[int], how: str = "mean",
            strict: str = "row") -> DataFrame:
    """``<col>_<how>_<w>`` over the previous ``w`` games; all windows share one history."""
    fn = {"mean": arr_mean, "sum": null_sum}[how]
    n = max(windows)
    cut = lambda w: F.col("past") if w == n else tail(F.col("past"), w)
    return from_past(long, cols, n, {f"{c}_{how}_{w}": fn(field(cut(w), c)) for c in cols for w in windows}, strict)


def efficiency_value(num: Column, den: Column, mode: str) -> Column:
    """Ratio of two sums under one of three zero-denominator policies."""
    if mode == "null_if_zero":
        return F.try_divide(num, den)
    if mode == "epsilon":
        return num / F.when(den.isNotNull(), F.greatest(den, F.lit(EPSILON)))
    if mode == "bounded":
        safe = F.when(den.isNotNull(), F.greatest(den, F.lit(EFFICIENCY_FLOOR)))
        return clip(num / safe, EFFICIENCY_LOW, EFFICIENCY_HIGH)
    raise ValueError(mode)


def efficiency(long: DataFrame, num: str, den: str, w: int, mode: str = "null_if_zero", strict: str = "row") -> DataFrame:
    a, b = null_sum(field(F.col("past"), num)), null_sum(field(F.col("past"), den))
    return from_past(long, [num, den], w, {f"eff_{w}": efficiency_value(a, b, mode)}, strict)


def momentum(long: DataFrame, col: str, w: int) -> DataFrame:
    """Rolling mean of the last ``w`` games minus the same mean as it stood ``w`` games earlier."""
    past = with_past(long, [col], 2 * w, "row")
    items = field(F.col("past"), col)
    n = F.size(items)
    now = arr_mean(tail(items, w))
    older = F.slice(items, F.greatest(n - 2 * w + 1, F.lit(1)), F.greatest(n - w, F.lit(0)))
    return past.withColumn(f"{col}_momentum_{w}", F.when(n > w, now - arr_mean(older))).drop("past")


def form_points(long: DataFrame, w: int = 5, default: float = NEUTRAL) -> DataFrame:
    pts = field(F.col("past"), "points")
    return from_past(long, ["points"], w, {"form": F.coalesce(F.try_divide(arr_sum(pts), 3.0 * F.size(pts)), F.lit(default))})


def split_past(long: DataFrame, cols: Sequence[str], w: int, out: str = "past") -> DataFrame:
    """Ledger (ent, t): last k home and last k away games before t, merged, newest ``w`` kept; k = w//2 + 1."""
    k = w // 2 + 1
    states = last_n_state(long, [ENT, "venue"], T, ID, [T, *cols], k, cluster=[ENT])
    days = states.groupBy(ENT, T).agg(
        F.first(F.when(F.col("venue") == "H", F.col("state")), ignorenulls=True).alias("h"),
        F.first(F.when(F.col("venue") == "A", F.col("state")), ignorenulls=True).alias("a"))
    before = W.partitionBy(ENT).orderBy(T).rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    both = days.select(ENT, T, last("h").alias("h"), last("a").alias("a"))
    none = F.slice(F.coalesce("h", "a"), 1, 0)
    merged = F.concat(F.coalesce("h", none), F.coalesce("a", none))
    by_time = F.transform(merged, lambda x: F.struct(x[T].alias(T), x["id"].alias("id"), *[x[c].alias(c) for c in cols]))
    return both.select(ENT, T, F.array_sort(by_time).alias("_all")).select(ENT, T, tail(F.col("_all"), w).alias(out))


def form_points_split(matches: DataFrame, long: DataFrame, w: int = 5) -> DataFrame:
    ledger = split_past(long, ["points"], w)
    pts = field(F.col("past"), "points")
    form = ledger.select(ENT, T, F.try_divide(arr_sum(pts), 3.0 * F.size(pts)).alias("form"))
    out = attach_sides(matches, form, ["form"])
    return out.withColumns({f"{s}_form": F.coalesce(f"{s}_form", F.lit(NEUTRAL)) for s in ("home", "away")})


def shots_corners_split(matches: DataFrame, long: DataFrame, w: int = 5) -> DataFrame:
    """Mean shots, mean corners and share of shots over the split window."""
    cols = ["shots", "shots_against", "corners"]
    ledger = split_past(long, cols, w)
    own, opp = (arr_sum(field(F.col("past"), c)) for c in ("shots", "shots_against"))
    vals = ledger.select(ENT, T, arr_mean(field(F.col("past"), "shots")).alias("shots_avg"),
                         arr_mean(field(F.col("past"), "corners")).alias("corners_avg"),
                         F.try_divide(own, own + opp).alias("shot_share"))
    out = attach_sides(matches, vals, ["shots_avg", "corners_avg", "shot_share"])
    fills = {"shots_avg": 0.0, "corners_avg": 0.0, "shot_share": NEUTRAL}
    return out.withColumns({f"{s}_{c}": F.coalesce(f"{s}_{c}", F.lit(v)) for s in ("home", "away") for c, v in fills.items()})


def _pairs(matches: DataFrame) -> DataFrame:
    return matches.withColumns({"lo": F.least("home", "away"), "hi": F.greatest("home", "away")})


def h2h_points(matches: DataFrame, w: int = 5) -> DataFrame:
    """Share of points today's home side took in the last ``w`` meetings at either venue."""
    m = _pairs(matches)
    played = F.col("result").isin("H", "D", "A")
    pts = F.when(F.col("result") == "D", F.lit(1)).when((F.col("result") == "H") == (F.col("home") == F.col("lo")), 3).otherwise(0)
    opp = F.when(F.col("result") == "D", F.lit(1)).otherwise(F.lit(3) - pts)
    m = m.withColumns({"lo_points": F.when(played, pts), "hi_points": F.when(played, opp)})
    # a meeting without a result has a day in the ledger, but is no meeting
    ledger = last_n_before(m, ["lo", "hi"], T, ID, ["lo_points", "hi_points"], w, only="lo_points")
    share = {f"{s}_share": F.try_divide(arr_sum(field(F.col("past"), f"{s}_points")), 3.0 * F.size("past")) for s in ("lo", "hi")}
    out = attach(m, ledger.select("lo", "hi", T, *[v.alias(k) for k, v in share.items()]), ["lo", "hi"], T)
    mine = F.when(F.col("home") == F.col("lo"), F.col("lo_share")).otherwise(F.col("hi_share"))
    return out.withColumn("h2h", F.coalesce(mine, F.lit(NEUTRAL))).drop(
        "lo", "hi", "lo_points", "hi_points", "lo_share", "hi_share")


def h2h_winrate(matches: DataFrame, min_games: int = 1) -> DataFrame:
    m = _pairs(matches)
    lo_won = ((F.col("result") == "H") & (F.col("home") == F.col("lo"))) | ((F.col("result") == "A") & (F.col("away") == F.col("lo")))
    ledger = sums_before(m, ["lo", "hi"], T, {
        "games": F.count("result"),
        "lo_wins": F.sum(lo_won.cast("int")),
        "hi_wins": F.sum((~lo_won & (F.col("result") != "D")).cast("int"))})
    out = attach(m, ledger, ["lo", "hi"], T)
    mine = F.when(F.col("home") == F.col("lo"), F.col("lo_wins")).otherwise(F.col("hi_wins"))
    rate = F.when(F.col("games") >= min_games, mine / F.col("games")).otherwise(NEUTRAL)
    return out.withColumns({"h2h_games": F.coalesce("games", F.lit(0)), "h2h_winrate": rate}).drop(
        "games", "lo_wins", "hi_wins", "lo", "hi")


def windowed_winrate(matches: DataFrame, long: DataFrame, days: int = FLAT_WINRATE_DAYS,
                     min_games: int = FLAT_WINRATE_MIN) -> DataFrame:
    ledger = sums_before(long, [ENT], T, {"games": F.count("res"), "wins": F.sum((F.col("res") == 1).cast("int"))},
                         {"": days})
    out = attach_sides(matches, ledger, ["games", "wins"])
    ready = (F.col("home_games") >= min_games) & (F.col("away_games") >= min_games)
    value = (F.col("home_wins") / F.col("home_games") + 1 - F.col("away_wins") / F.col("away_games")) / 2
    return out.withColumn("winrate", F.when(ready, value).otherwise(NEUTRAL)).drop(
        "home_games", "away_games", "home_wins", "away_wins")


def days_rest(long: DataFrame, strict: str = "row", default: int = FIRST_REST_DAYS) -> DataFrame:
    """Days since the previous game. In row order a second game on one day rests 0 days."""
    days = long.groupBy(ENT, T).agg(F.min(ID).alias("_first"))
    gap = days.withColumn("_gap", F.date_diff(F.col(T), F.lag(T).over(W.partitionBy(ENT).orderBy(T))))
    out = long.join(gap, [ENT, T], "left")
    rest = F.col("_gap") if strict == "time" else F.when(F.col(ID) == F.col("_first"), F.col("_gap")).otherwise(0)
    return out.withColumn("days_rest", F.coalesce(rest, F.lit(default))).drop("_gap", "_first")


def congestion_counts(long: DataFrame, spans: Sequence[int] = (14, 30)) -> DataFrame:
    ledger = sums_before(long, [ENT], T, {"games": F.count(F.lit(1))}, {f"_{d}d": d for d in spans})
    cols = [f"games_{d}d" for d in spans]
    return attach(long, ledger, [ENT], T).withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})


def season_points(matches: DataFrame, long: DataFrame) -> DataFrame:
    """Points of both sides in the running season, strictly before the day; missing = 0."""
    ledger = sums_before(long, ["season", ENT], T, {"pts": F.sum("points")})
    out = attach_sides(matches, ledger, ["pts"], also=["season"])
    out = out.withColumns({f"{s}_season_points": F.coalesce(f"{s}_pts", F.lit(0)) for s in ("home", "away")})
    return out.withColumn("season_points_diff", F.col("home_season_points") - F.col("away_season_points")).drop(
        "home_pts", "away_pts")


def decay_form(matches: DataFrame, long: DataFrame, decay: float = DECAY, n: int = DECAY_GAMES) -> DataFrame:
    """Decayed win rate: the home side over its home games, the away side over its away games."""
    ledger = last_n_before(long, [ENT, "venue"], T, ID, ["res"], n)
    wins = F.transform(field(F.col("past"), "res"), lambda r: (r == 1).cast("double"))
    size = F.size(wins)
    weight = lambda i: F.pow(F.lit(decay), (size - 1 - i).cast("double"))
    num = arr_sum(F.transform(wins, lambda x, i: x * weight(i)))
    den = arr_sum(F.transform(wins, lambda x, i: weight(i)))
    ledger = ledger.select(ENT, "venue", T, F.try_divide(num, den).alias("decay_form"))
    out = matches
    for side, venue in (("home", "H"), ("away", "A")):
        part = ledger.filter(F.col("venue") == venue).select(
            F.col(ENT).alias(side), T, F.col("decay_form").alias(f"{side}_decay_form"))
        out = out.join(part, [side, T], "left").withColumn(
            f"{side}_decay_form", F.coalesce(f"{side}_decay_form", F.lit(NEUTRAL)))
    return out


def result_slope(long: DataFrame, w: int = SLOPE_GAMES) -> DataFrame:
    y = F.transform(field(F.col("past"), "res"), lambda r: (r + 1).cast("double"))
    mid = (w - 1) / 2.0
    spread = sum((i - mid) ** 2 for i in range(w))
    slope = arr_sum(F.transform(y, lambda v, i: v * (i - mid))) / spread
    return from_past(long, ["res"], w, {"slope": F.when(F.size("past") >= w, (slope + 2) / 4).otherwise(NEUTRAL)})


def result_volatility(long: DataFrame, n: int = VOLATILITY_GAMES, least: int = VOLATILITY_MIN) -> DataFrame:
    y = F.transform(field(F.col("past"), "res"), lambda r: (r + 1).cast("double"))
    return from_past(long, ["res"], n, {"volatility": F.when(F.size("past") >= least, arr_std(y) / 2).otherwise(NEUTRAL)})


def perf_momentum(long: DataFrame, include_current: bool = False) -> DataFrame:
    """perf_w minus perf_w of w games earlier for w = 3 and 5, and the change of that difference.

    ``include_current=True`` keeps the row's own result in the window: the leaking variant, for audits.
    """
    past = with_past(long, ["res"], 11, "row")
    held = field(F.col("past"), "res")
    if include_current:
        held = F.concat(held, F.array(F.col("res")))

    def values(items: Column) -> Column:
        def mean_at(w: int, back: int) -> Column:
            stop = F.size(items) - back
            start = F.greatest(stop - w + 1, F.lit(1))
            return F.when(stop >= 1, arr_mean(F.slice(items, start, F.greatest(stop - start + 1, F.lit(0)))))

        def mom(w: int, shift: int = 0) -> Column:
            return F.coalesce(mean_at(w, shift) - mean_at(w, shift + w), F.lit(0.0))

        zero = F.lit(0.0)
        ok = F.lit(True) if include_current else F.size(items) >= PERF_MIN
        return F.struct(F.when(ok, mom(3)).otherwise(zero).alias("momentum_3"), F.when(ok, mom(5)).otherwise(zero).alias("momentum_5"),
                        F.when(ok & (F.size(items) >= 2), mom(3) - mom(3, 1)).otherwise(zero).alias("acceleration"))

    names = ["momentum_3", "momentum_5", "acceleration"]
    # the list is built once a row, and only finished numbers go on
    out = past.withColumn("_v", F.element_at(F.transform(F.array(held), values), 1)).drop("past")
    out = out.withColumns({c: F.col("_v")[c] for c in names}).drop("_v")
    if include_current:
        # only entities of too few games travel to the rows
        few = long.groupBy(ENT).agg(F.count(F.lit(1)).alias("_games")).filter(F.col("_games") < PERF_MIN)
        out = out.filter(F.col(ENT).isNotNull()).join(few, ENT, "left")
        out = out.withColumns({c: F.when(F.col("_games").isNull(), F.col(c)).otherwise(0.0) for c in names}).drop("_games")
    return out


def unshifted_mean(long: DataFrame, col: str, w: int) -> DataFrame:
    """Rolling mean that includes the current row: the negative control of the leakage audits."""
    past = with_past(long, [col], w - 1, "row")
    return past.withColumn(f"{col}_unshifted_{w}", arr_mean(F.concat(field(F.col("past"), col), F.array(F.col(col))))
                           ).drop("past")


def season_elapsed(df: DataFrame, t: str = T) -> DataFrame:
    """Days since the first row of the calendar year, and pressure = min(1, days/200)."""
    first = df.groupBy(F.year(t).alias("_y")).agg(F.min(t).alias("_first"))
    out = df.withColumn("_y", F.year(t)).join(first, "_y")
    days = F.date_diff(F.col(t), F.col("_first"))
    return out.withColumns({"season_days": days,
                            "pressure": F.when(days > PRESSURE_DAYS, 1.0).otherwise(days / float(PRESSURE_DAYS))}).drop("_y", "_first")


def row_neighbour(df: DataFrame, keys: Sequence[str], col: str, steps: Sequence[int], t: str = T, id: str = ID,
                  rows: int = RANGE_ROWS) -> DataFrame:
    """``<col>_lag<k>`` / ``<col>_lead<k>`` in (t, id) order with only one (key, day), or one id range of a day
    of more than ``rows`` rows, ordered per task.

    Values across a border come from the ledger of the nearest days and ranges.
    """
    back = max([k for k in steps if k > 0], default=0)
    ahead = max([-k for k in steps if k < 0], default=0)
    item = F.struct(F.col(id).alias("id"), F.col(col))
    out = df
    if back:
        out = last_rows_before(out, keys, t, id, [col], back, "_back", rows)
    if ahead:
        out = day_ranges(out, keys, t, id, rows)
        t = "_t"
        first = W.partitionBy(*keys, t).orderBy(F.asc(id))
        heads = (out.select(*keys, t, id, col).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= ahead)
                 .groupBy(*keys, t).agg(F.array_sort(F.collect_list(item)).alias("head")))
        frame = W.partitionBy(*keys).orderBy(t).rowsBetween(1, ahead)
        nxt = heads.select(*keys, t, F.flatten(F.collect_list("head").over(frame)).alias("_next"))
        today = W.partitionBy(*keys, t).orderBy(id).rowsBetween(1, ahead)
        out = out.withColumn("_today", F.collect_list(item).over(today)).join(nxt, [*keys, t], "left").withColumn(
            "_ahead", F.concat("_today", "_next")).drop("_today", "_next")
    cols = {}
    for k in steps:
        if k > 0:
            cols[f"{col}_lag{k}"] = F.when(F.size("_back") >= k, F.get("_back", F.size("_back") - k)[col])
        else:
            cols[f"{col}_lead{-k}"] = F.when(F.size("_ahead") >= -k, F.get("_ahead", F.lit(-k - 1))[col])
    return out.withColumns(cols).drop("_back", "_ahead", "_t")


def cumulative_record(long: DataFrame) -> DataFrame:
    """Games with a result, wins, draws, losses, goals and points of the entity over all earlier days."""
    ledger = sums_before(long, [ENT], T, {
        "games": F.count("res"), "wins": F.sum((F.col("res") == 1).cast("int")),
        "draws": F.sum((F.col("res") == 0).cast("int")), "losses": F.sum((F.col("res") == -1).cast("int")),
        "goals_for": F.sum("gf"), "goals_against": F.sum("ga"), "total_points": F.sum("points")})
    cols = ["games", "wins", "draws", "losses", "goals_for", "goals_against", "total_points"]
    return attach(long, ledger, [ENT], T).withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})


def match_week(df: DataFrame, keys: Sequence[str] = ("pool", "season"), t: str = T) -> DataFrame:
    """Dense rank of the day inside its season, on distinct days only."""
    days = df.select(*keys, t).distinct()
    ranked = days.withColumn("week", F.row_number().over(W.partitionBy(*keys).orderBy(t)))
    out = df.join(ranked, [*keys, t])
    return out.withColumns({"week_normalized": (F.col("week") - 1) / 37.0, "week_share": F.col("week") / 38.0})


def season_border(long: DataFrame, value: str) -> DataFrame:
    """Per entity and season: last value of the season and first value of its next season."""
    order = F.struct(F.col(T), F.col(ID))
    ends = long.groupBy(ENT, "season").agg(F.min_by(value, order).alias("first_value"),
                                           F.max_by(value, order).alias("last_value"))
    seasons = W.partitionBy(ENT).orderBy("season")
    return ends.withColumns({"next_season": F.lead("season").over(seasons),
                             "next_first": F.lead("first_value").over(seasons)})
