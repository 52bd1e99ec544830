"""W family: point-in-time features over the contest log and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import history as h
from formline.operators.shape import side_diff, to_long, to_wide
from formline.operators.standings import positions_before
from formline.plans.base_sql import C, L, P, with_unplayed
from formline.plans.fixtures import unplayed
from formline.plans.registry import ORACLES, R, query, r6
from formline.sources.contests import contests, contests_long, table

KEY = ["match_id", "venue"]
ROWS = "(partition by ent order by match_date, match_id rows between {} preceding and 1 preceding)"


def _long(df, cols):
    return df.select(*KEY, *[r6(c).alias(c) for c in cols])


@query("w01_shifted_rolling_mean", L(f"""select match_id, venue,
  {R('avg(xg) over ' + ROWS.format(5))} xg_mean_5, {R('avg(xg) over ' + ROWS.format(10))} xg_mean_10 from long"""))
def w01(spark, d):
    return _long(h.rolling(contests_long(spark, d), ["xg"], [5, 10], "mean"), ["xg_mean_5", "xg_mean_10"])


@query("w01b_event_rolling_mean", f"""select event_id, {R('''avg(value) over (partition by user_id order by ts, event_id
  rows between 5 preceding and 1 preceding)''')} value_mean_5 from events""")
def w01b(spark, d):
    from formline.functions.scalar import arr_mean
    from formline.operators.ledger import last_rows_before
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day"))
    # The timestamp is the order inside a day; struct items sort by it first.
    ev = ev.withColumn("pos", F.struct("ts", "event_id"))
    past = last_rows_before(ev, ["user_id"], "day", "pos", ["value"], 5)
    return past.select("event_id", r6(arr_mean(F.transform("past", lambda x: x["value"]))).alias("value_mean_5"))


@query("w02_shifted_rolling_sum", L(f"""select match_id, venue,
  {R('sum(gf) over ' + ROWS.format(5))} gf_sum_5, {R('sum(gf) over ' + ROWS.format(10))} gf_sum_10,
  {R('sum(xg) over ' + ROWS.format(5))} xg_sum_5, {R('sum(xg) over ' + ROWS.format(10))} xg_sum_10 from long"""))
def w02(spark, d):
    df = h.rolling(contests_long(spark, d), ["gf", "xg"], [5, 10], "sum")
    return _long(df, ["gf_sum_5", "gf_sum_10", "xg_sum_5", "xg_sum_10"])


@query("w03_rolling_efficiency", L(f"""select match_id, venue,
  {R('g / nullif(x, 0)')} eff_null, {R('case when x is not null then g / greatest(x, 1e-6) end')} eff_eps,
  {R('case when x is not null then greatest(0.3e0, least(3e0, g / greatest(x, 0.5e0))) end')} eff_bounded
  from (select match_id, venue, cast(sum(gf) over w as double) g, sum(xg) over w x from long
        window w as {ROWS.format(5)})"""))
def w03(spark, d):
    long = contests_long(spark, d)
    past = h.with_past(long, ["gf", "xg"], 5, "row")
    num, den = (h.null_sum(h.field(F.col("past"), c)) for c in ("gf", "xg"))
    return past.select(*KEY, r6(h.efficiency_value(num, den, "null_if_zero")).alias("eff_null"),
                       r6(h.efficiency_value(num, den, "epsilon")).alias("eff_eps"),
                       r6(h.efficiency_value(num, den, "bounded")).alias("eff_bounded"))


@query("w04_rolling_momentum", L(f"""select match_id, venue,
  {R('m - lag(m, 5) over (partition by ent order by match_date, match_id)', 5)} xg_momentum_5
  from (select *, avg(xg) over {ROWS.format(5)} m from long)"""))
def w04(spark, d):
    return h.momentum(contests_long(spark, d), "xg", 5).select(*KEY, r6("xg_momentum_5", 5).alias("xg_momentum_5"))


@query("w05_form_points", P(f"""select l.match_id, l.venue, {R('coalesce(sum(p.points) / (3e0 * count(p.points)), 0.5e0)')} form
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def w05(spark, d):
    return _long(h.form_points(contests_long(spark, d)), ["form"])


SPLIT = """, merged as (
  select *, row_number() over (partition by match_id, venue order by bdate desc, bid desc) rs from past where rnv <= 3),
 win as (select * from merged where rs <= 5),
 agg as (select l.match_id, l.venue, {} from long l
   left join win p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2)
 select c.match_id, {} from contests c join agg h on h.match_id = c.match_id and h.venue = 'H'
   join agg a on a.match_id = c.match_id and a.venue = 'A'"""


@query("w06_form_points_split", P(SPLIT.format(
    "coalesce(sum(p.points) / (3e0 * count(p.points)), 0.5e0) f", f"{R('h.f')} home_form, {R('a.f')} away_form")))
def w06(spark, d):
    m, long = contests(spark, d), contests_long(spark, d)
    return h.form_points_split(m, long).select("match_id", r6("home_form").alias("home_form"), r6("away_form").alias("away_form"))


@query("w07_shots_corners_avg", P(SPLIT.format(
    """coalesce(avg(p.shots), 0) s, coalesce(avg(p.corners), 0) k, coalesce(sum(coalesce(p.shots, 0)) /
       nullif(sum(coalesce(p.shots, 0)) + sum(coalesce(p.shots_against, 0)), 0), 0.5e0) r""",
    ", ".join(f"{R(f'{t}.{c}')} {s}_{n}" for t, s in (("h", "home"), ("a", "away"))
              for c, n in (("s", "shots_avg"), ("k", "corners_avg"), ("r", "shot_share"))))))
def w07(spark, d):
    df = h.shots_corners_split(contests(spark, d), contests_long(spark, d, shots=True))
    return df.select("match_id", *[r6(f"{s}_{c}").alias(f"{s}_{c}") for s in ("home", "away")
                                   for c in ("shots_avg", "corners_avg", "shot_share")])


MEET = """, meet as (
  select a.match_id, b.match_id bid, row_number() over (partition by a.match_id order by b.match_date desc, b.match_id desc) rn,
    case when b.result = 'D' then 1 when (b.result = 'H') = (b.home = a.home) then 3 else 0 end pts
  from contests a join contests b on least(a.home, a.away) = least(b.home, b.away)
   and greatest(a.home, a.away) = greatest(b.home, b.away) and b.match_date < a.match_date)"""


@query("w08_h2h_points", C(MEET[1:].replace(" meet as", ", meet as", 1) + f"""
  select c.match_id, {R('coalesce(sum(pts) / (3e0 * count(pts)), 0.5e0)')} h2h
  from contests c left join meet m on m.match_id = c.match_id and rn <= 5 group by 1"""))
def w08(spark, d):
    return h.h2h_points(contests(spark, d)).select("match_id", r6("h2h").alias("h2h"))


@query("w09_h2h_winrate", C(MEET[1:].replace(" meet as", ", meet as", 1) + f"""
  select c.match_id, count(pts) h2h_games,
   {R('case when count(pts) >= 2 then sum(case when pts = 3 then 1 else 0 end) / cast(count(pts) as double) else 0.5e0 end')} h2h_winrate
  from contests c left join meet m on m.match_id = c.match_id group by 1"""))
def w09(spark, d):
    return h.h2h_winrate(contests(spark, d), 2).select("match_id", "h2h_games", r6("h2h_winrate").alias("h2h_winrate"))


@query("w10_windowed_winrate", P(f""", agg as (
  select l.match_id, l.venue, count(p.res) n, sum(case when p.res = 1 then 1 else 0 end) w from long l left join past p
   on p.match_id = l.match_id and p.venue = l.venue and p.bdate >= l.match_date - interval 60 day group by 1, 2)
  select h.match_id, {R('case when h.n >= 3 and a.n >= 3 then (h.w / cast(h.n as double) + 1 - a.w / cast(a.n as double)) / 2 else 0.5e0 end')} winrate
  from agg h join agg a on h.match_id = a.match_id and h.venue = 'H' and a.venue = 'A'"""))
def w10(spark, d):
    return h.windowed_winrate(contests(spark, d), contests_long(spark, d)).select("match_id", r6("winrate").alias("winrate"))


@query("w10b_winrate_unplayed", with_unplayed(ORACLES["w10_windowed_winrate"]))
def w10b(spark, d):
    m = unplayed(spark, d)
    return h.windowed_winrate(m, to_long(m)).select("match_id", r6("winrate").alias("winrate"))


@query("w11_days_rest", L("""select match_id, venue, cast(coalesce(match_date - lag(match_date) over
  (partition by ent order by match_date, match_id), 7) as integer) days_rest from long"""))
def w11(spark, d):
    return h.days_rest(contests_long(spark, d)).select(*KEY, "days_rest")


@query("w12_matches_last_n_days", P("""select l.match_id, l.venue,
  count(case when p.bdate >= l.match_date - interval 14 day then 1 end) games_14d,
  count(case when p.bdate >= l.match_date - interval 30 day then 1 end) games_30d
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2"""))
def w12(spark, d):
    return h.congestion_counts(contests_long(spark, d)).select(*KEY, "games_14d", "games_30d")


@query("w13_season_points_before", L("""select c.match_id,
  cast(coalesce(hp, 0) as bigint) home_season_points, cast(coalesce(ap, 0) as bigint) away_season_points,
  cast(coalesce(hp, 0) - coalesce(ap, 0) as bigint) season_points_diff
  from contests c
  left join (select c.match_id, sum(l.points) hp from contests c join long l on l.ent = c.home and l.season = c.season
    and l.match_date < c.match_date group by 1) x on x.match_id = c.match_id
  left join (select c.match_id, sum(l.points) ap from contests c join long l on l.ent = c.away and l.season = c.season
    and l.match_date < c.match_date group by 1) y on y.match_id = c.match_id"""))
def w13(spark, d):
    df = h.season_points(contests(spark, d), contests_long(spark, d))
    return df.select("match_id", "home_season_points", "away_season_points", "season_points_diff")


@query("w14_table_position_before", L(f""", asked as (select distinct pool, season, match_date from contests),
  tab as (select q.pool, q.season, q.match_date, l.ent, sum(l.points) pts from asked q join long l
    on l.pool = q.pool and l.season = q.season and l.match_date < q.match_date group by 1, 2, 3, 4),
  pos as (select *, row_number() over (partition by pool, season, match_date order by pts desc, ent) p from tab)
  select c.match_id, cast(coalesce(h.p, 10) as bigint) home_position, cast(coalesce(a.p, 10) as bigint) away_position,
   {R('case when t.n is null then 0.5e0 else (coalesce(a.p, 10) - coalesce(h.p, 10) + 20) / 40e0 end')} position_value
  from contests c
  left join pos h on h.pool = c.pool and h.season = c.season and h.match_date = c.match_date and h.ent = c.home
  left join pos a on a.pool = c.pool and a.season = c.season and a.match_date = c.match_date and a.ent = c.away
  left join (select pool, season, match_date, count(*) n from tab group by 1, 2, 3) t
    on t.pool = c.pool and t.season = c.season and t.match_date = c.match_date"""))
def w14(spark, d):
    df = positions_before(contests(spark, d), contests_long(spark, d))
    return df.select("match_id", "home_position", "away_position", r6("position_value").alias("position_value"))


@query("w15_time_decay_form", P(f""", agg as (
  select l.match_id, l.venue, coalesce(sum(case when p.res = 1 then pow(0.93e0, p.rnv - 1) else 0 end) /
    sum(pow(0.93e0, p.rnv - 1)), 0.5e0) f from long l left join past p
    on p.match_id = l.match_id and p.venue = l.venue and p.bvenue = l.venue and p.rnv <= 10 group by 1, 2)
  select h.match_id, {R('h.f')} home_decay_form, {R('a.f')} away_decay_form from agg h join agg a
   on h.match_id = a.match_id and h.venue = 'H' and a.venue = 'A'"""))
def w15(spark, d):
    df = h.decay_form(contests(spark, d), contests_long(spark, d))
    return df.select("match_id", r6("home_decay_form").alias("home_decay_form"), r6("away_decay_form").alias("away_decay_form"))


@query("w16_result_slope", P(f"""select l.match_id, l.venue,
  {R('case when count(p.res) = 5 then (regr_slope(cast(p.res + 1 as double), cast(6 - p.rn as double)) + 2) / 4 else 0.5e0 end')} slope
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def w16(spark, d):
    return _long(h.result_slope(contests_long(spark, d)), ["slope"])


@query("w17_result_volatility", P(f"""select l.match_id, l.venue,
  {R('case when count(p.res) >= 3 then stddev_pop(cast(p.res + 1 as double)) / 2 else 0.5e0 end')} volatility
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 8 group by 1, 2"""))
def w17(spark, d):
    return _long(h.result_volatility(contests_long(spark, d)), ["volatility"])


def _momentum_sql(shift: int, total: bool) -> str:
    end = "1 preceding" if shift else "current row"
    f = lambda w: f"avg(cast(res as double)) over (o rows between {w if shift else w - 1} preceding and {end})"
    o = "(partition by ent order by match_date, match_id)"
    ok = "total >= 5" if total else "seen >= 5"
    return L(f""", p as (select *, {f(3)} p3, {f(5)} p5, row_number() over o - {shift} seen,
       count(*) over (partition by ent) total from long window o as {o}),
     m as (select *, coalesce(p3 - lag(p3, 3) over o, 0) m3, coalesce(p5 - lag(p5, 5) over o, 0) m5 from p window o as {o}),
     a as (select *, case when seen >= 2 then m3 - lag(m3) over o else 0 end acc from m window o as {o})
     select match_id, venue, {R(f'case when {ok} then m3 else 0 end')} momentum_3,
      {R(f'case when {ok} then m5 else 0 end')} momentum_5, {R(f'case when {ok} then acc else 0 end')} acceleration from a""")


@query("w18_rolling_perf_momentum", _momentum_sql(1, False))
def w18(spark, d):
    return _long(h.perf_momentum(contests_long(spark, d)), ["momentum_3", "momentum_5", "acceleration"])


@query("w18b_perf_momentum_with_current", _momentum_sql(0, True))
def w18b(spark, d):
    return _long(h.perf_momentum(contests_long(spark, d), True), ["momentum_3", "momentum_5", "acceleration"])


@query("w19_rolling_unshifted_mean", L(f"""select match_id, venue, {R('''avg(xg) over (partition by ent
  order by match_date, match_id rows between 4 preceding and current row)''')} xg_unshifted_5 from long"""))
def w19(spark, d):
    return _long(h.unshifted_mean(contests_long(spark, d), "xg", 5), ["xg_unshifted_5"])


@query("w20_last_n_before", P("""select l.match_id, l.venue, cast(count(p.bid) as integer) n,
  coalesce(string_agg(cast(p.bid as varchar), ',' order by p.rn desc), '') ids
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def w20(spark, d):
    past = h.with_past(contests_long(spark, d), ["points"], 5)
    ids = F.transform("past", lambda x: x["id"].cast("string"))
    return past.select(*KEY, F.size("past").alias("n"), F.array_join(ids, ",").alias("ids"))


@query("w21_side_diff", L(f""", r as (select match_id, venue, avg(xg) over {ROWS.format(5)} xg_mean_5,
    avg(gf) over {ROWS.format(5)} gf_mean_5 from long)
  select h.match_id, {R('h.xg_mean_5')} home_xg_mean_5, {R('a.xg_mean_5')} away_xg_mean_5, {R('h.gf_mean_5')} home_gf_mean_5,
   {R('a.gf_mean_5')} away_gf_mean_5, {R('h.xg_mean_5 - a.xg_mean_5')} xg_mean_5_diff, {R('h.gf_mean_5 - a.gf_mean_5')} gf_mean_5_diff
  from r h join r a on h.match_id = a.match_id and h.venue = 'H' and a.venue = 'A'"""))
def w21(spark, d):
    wide = side_diff(to_wide(h.rolling(contests_long(spark, d), ["xg", "gf"], [5]), ["xg_mean_5", "gf_mean_5"]))
    return wide.select("match_id", *[r6(c).alias(c) for c in wide.columns if c != "match_id"])


@query("w22_season_elapsed", C(f"""select match_id, cast(match_date - f as integer) season_days,
  {R('case when match_date - f > 200 then 1 else (match_date - f) / 200e0 end')} pressure
  from (select *, min(match_date) over (partition by year(match_date)) f from contests)"""))
def w22(spark, d):
    return h.season_elapsed(contests(spark, d)).select("match_id", "season_days", r6("pressure").alias("pressure"))


@query("w23_row_diff", L(f""", f as (select match_id, venue, ent, match_date, xg,
    abs(xg - lag(xg) over (partition by ent order by match_date, match_id)) jump from long)
  select ent, count(jump) pairs, count(case when jump > 0.3e0 then 1 end) jumps, {R('max(jump)')} max_jump from f group by ent"""))
def w23(spark, d):
    df = h.row_neighbour(contests_long(spark, d), ["ent"], "xg", [1])
    jump = F.abs(F.col("xg") - F.col("xg_lag1"))
    return df.groupBy("ent").agg(F.count(jump).alias("pairs"), F.count(F.when(jump > 0.3, 1)).alias("jumps"),
                                 r6(F.max(jump)).alias("max_jump"))


@query("w24_lead_target", C("""select match_id, lead(y, 1) over w y_lead1, lead(y, 2) over w y_lead2, lead(y, 3) over w y_lead3
  from (select *, case result when 'H' then 0 when 'D' then 1 else 2 end y from contests)
  window w as (partition by pool order by match_date, match_id)"""))
def w24(spark, d):
    from formline.functions.scalar import CLASS_CODE, code
    m = contests(spark, d).withColumn("y", code(F.col("result"), CLASS_CODE))
    return h.row_neighbour(m, ["pool"], "y", [-1, -2, -3]).select("match_id", "y_lead1", "y_lead2", "y_lead3")


@query("w25_cumulative_record", P("""select l.match_id, l.venue, count(p.res) games,
  cast(count(case when p.res = 1 then 1 end) as bigint) wins, cast(count(case when p.res = 0 then 1 end) as bigint) draws,
  cast(count(case when p.res = -1 then 1 end) as bigint) losses, cast(coalesce(sum(p.gf), 0) as bigint) goals_for,
  cast(coalesce(sum(p.ga), 0) as bigint) goals_against, cast(coalesce(sum(p.points), 0) as bigint) total_points
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2"""))
def w25(spark, d):
    return h.cumulative_record(contests_long(spark, d)).select(
        *KEY, "games", "wins", "draws", "losses", "goals_for", "goals_against", "total_points")


@query("w25b_record_unplayed", with_unplayed(ORACLES["w25_cumulative_record"]))
def w25b(spark, d):
    return h.cumulative_record(to_long(unplayed(spark, d))).select(
        *KEY, "games", "wins", "draws", "losses", "goals_for", "goals_against", "total_points")


@query("w26_matchweek", C(f"""select match_id, cast(w as integer) as week, {R('(w - 1) / 37e0')} week_normalized, {R('w / 38e0')} week_share
  from (select match_id, dense_rank() over (partition by pool, season order by match_date) w from contests)"""))
def w26(spark, d):
    return h.match_week(contests(spark, d)).select("match_id", "week", r6("week_normalized").alias("week_normalized"),
                                                   r6("week_share").alias("week_share"))


@query("w27_first_last_in_season", L("""select ent, season, first_value, last_value,
   lead(season) over (partition by ent order by season) next_season,
   lead(first_value) over (partition by ent order by season) next_first
  from (select ent, season, arg_min(points, (match_date, match_id)) first_value, arg_max(points, (match_date, match_id)) last_value
        from long group by 1, 2)"""))
def w27(spark, d):
    return h.season_border(contests_long(spark, d), "points").select(
        "ent", "season", "first_value", "last_value", "next_season", "next_first")
