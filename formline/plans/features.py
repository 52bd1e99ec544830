"""Feature sets: one lazy plan per contest log, switched on by name."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import market as mk
from formline.functions import scalar as s
from formline.operators import history as h
from formline.operators.ledger import attach_sides, last_n_before, sums_before
from formline.operators.ratings import bounded_counter, elo_history, shifted_diff

# Neutral prices and fatigue defaults.
NEUTRAL_MARKET = 0.5
DEFAULT_REST, DEFAULT_CONGESTION = 7, 2


def over_under(df: DataFrame, over: str, under: str, out: str) -> DataFrame:
    """Margin-free probability of the over side; neutral when the columns are absent."""
    if over not in df.columns or under not in df.columns:
        return df.withColumn(out, F.lit(NEUTRAL_MARKET))
    return df.withColumn(out, F.coalesce(mk.two_way(F.col(over), F.col(under)), F.lit(NEUTRAL_MARKET)))


def rest_features(matches: DataFrame, long: DataFrame) -> DataFrame:
    """Rest, congestion and fatigue of both sides from one day ledger, strictly before the day."""
    from pyspark.sql.window import Window as W

    ledger = sums_before(long, ["ent"], "match_date", {"games": F.count(F.lit(1))}, {"_14d": 14, "_30d": 30})
    gap = F.date_diff(F.col("match_date"), F.lag("match_date").over(W.partitionBy("ent").orderBy("match_date")))
    out = attach_sides(matches, ledger.withColumn("rest", gap), ["games_14d", "games_30d", "rest"])
    sides = ("home", "away")
    out = out.withColumns({f"{x}_rest": F.coalesce(f"{x}_rest", F.lit(DEFAULT_REST)) for x in sides})
    out = out.withColumns({f"{x}_games_{n}d": F.coalesce(f"{x}_games_{n}d", F.lit(0)) for x in sides for n in (14, 30)})
    out = out.withColumns({
        "rest_advantage": s.rest_advantage(F.col("home_rest"), F.col("away_rest")),
        "congestion": s.congestion(F.col("home_games_14d") - F.col("away_games_14d"), F.col("home_games_30d") - F.col("away_games_30d"))})
    return out.withColumn("fatigue", s.fatigue_score(F.col("rest_advantage"), F.col("congestion")))


@dataclass(frozen=True)
class FeatureSet:
    """Which groups to build. Entity groups meet in one (entity, day) ledger before the contests are
    touched, so the contests move once per side however many groups are on."""

    elo: bool = True
    form: bool = True
    goals: bool = True
    xg: bool = True
    h2h: bool = True
    season: bool = True
    normalize: bool = True
    rest: bool = False
    market: bool = False
    state: bool = False
    context: bool = False

    def build(self, matches: DataFrame, long: DataFrame, w: int = 5) -> DataFrame:
        out = matches
        measures = [c for on, c in ((self.form, "points"), (self.goals, "gf"), (self.xg, "xg")) if on and c in long.columns]
        ledgers, cols = [], [f"{c}_{w}" for c in measures]
        if measures:
            past = last_n_before(long, ["ent"], "match_date", "match_id", measures, w)
            ledgers.append(past.select("ent", "match_date", *[s.arr_mean(h.field(F.col("past"), c)).alias(f"{c}_{w}") for c in measures]))
        if self.season:
            # A day lies in one season, so (entity, day) stays a key.
            points = sums_before(long, ["season", "ent"], "match_date", {"season_points": F.sum("points")})
            ledgers.append(points.select("ent", "match_date", F.coalesce("season_points", F.lit(0)).alias("season_points")))
            cols.append("season_points")
        if ledgers:
            both = ledgers[0] if len(ledgers) == 1 else ledgers[0].join(ledgers[1], ["ent", "match_date"])
            out = attach_sides(out, both, cols)
            out = out.withColumns({f"{c}_diff": F.col(f"home_{c}_{w}") - F.col(f"away_{c}_{w}") for c in measures})
        if self.season:
            out = out.withColumn("season_points_diff", F.col("home_season_points") - F.col("away_season_points"))
        if self.h2h:
            out = h.h2h_points(out)
        if self.elo:
            ratings = elo_history(matches).select("match_id", "home_elo", "away_elo")
            out = out.join(ratings, "match_id").withColumn("elo_diff", F.col("home_elo") - F.col("away_elo"))
        if self.rest:
            out = rest_features(out, long)
        if self.market:
            books = [F.col(c) for c in ("B365H", "B365D", "B365A")]
            fair = mk.margin_free(books)
            out = out.withColumns({"p_home": fair[0], "p_draw": fair[1], "p_away": fair[2], "market_entropy": mk.entropy(fair)})
        if self.state:
            counter = bounded_counter(long)
            side = lambda v: F.max(F.when(F.col("venue") == v, F.col("counter")))
            out = out.join(counter.groupBy("match_id").agg(((side("H") - side("A") + 1) / 2).alias("momentum")), "match_id", "left")
        if self.context:
            out = h.match_week(out)
        if self.normalize:
            ranges = {"points_diff": (-3.0, 3.0), "gf_diff": (-2.0, 2.0), "xg_diff": (-2.0, 2.0)}
            norm = {f"{c}_normalized": s.clip((F.col(c) - lo) / (hi - lo), 0.0, 1.0) for c, (lo, hi) in ranges.items() if c in out.columns}
            if self.elo:
                norm["elo_diff_normalized"] = shifted_diff(F.col("elo_diff"))
            out = out.withColumns(norm)
        return out

    @classmethod
    def only(cls, *names: str) -> "FeatureSet":
        return cls(**{f.name: f.name in names for f in fields(cls)})
