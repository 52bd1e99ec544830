"""E family: ratings and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import aggregates as a
from formline.operators import normalise as n
from formline.operators import ratings as e
from formline.operators.shape import to_long, top_bottom
from formline.plans.base_sql import LONG, L, with_unplayed
from formline.plans.fixtures import unplayed
from formline.plans.registry import ORACLES, R, query, r6
from formline.sources.contests import contests, contests_long

# One recursive step per game of a pool; the state is the list of the pool's 20 ratings.


def _elo_sql(where: str = "true", k_home: str = "32e0", k_away: str = "32e0",
             opening: str = "1500e0") -> str:
    return "with recursive " + LONG.strip() + f""",
 cnt as (select ent, count(*) g from long group by 1),
 sofar as (select match_id, venue, row_number() over (partition by ent order by match_date, match_id) - 1 g from long),
 seqs as (select c.pool, c.match_id, c.home, c.away, cast(c.home % 100 as integer) + 1 hi, cast(c.away % 100 as integer) + 1 ai,
   case result when 'H' then 1e0 when 'D' then 0.5e0 else 0e0 end s, {k_home} kh, {k_away} ka,
   row_number() over (partition by c.pool order by c.match_date, c.match_id) rn
   from contests c left join cnt h on h.ent = c.home left join cnt a on a.ent = c.away
   left join sofar hs on hs.match_id = c.match_id and hs.venue = 'H' left join sofar aw on aw.match_id = c.match_id and aw.venue = 'A' where {where}),
 starts as (select p.pool, list({opening} order by i) r from (select distinct pool from seqs) p
   cross join range(20) u(i) left join cnt n on n.ent = p.pool * 100 + u.i group by 1),
 run as (
   select pool, cast(0 as bigint) rn, cast(null as bigint) match_id, cast(null as double) rh, cast(null as double) ra, r from starts
   union all
   select t.pool, t.rn, t.match_id, q.r[t.hi], q.r[t.ai],
     list_transform(q.r, lambda v, i: case
       when i = t.hi then v + t.kh * (t.s - 1e0 / (1e0 + pow(10e0, (q.r[t.ai] - q.r[t.hi]) / 400e0)))
       when i = t.ai then v + t.ka * ((1e0 - t.s) - (1e0 - 1e0 / (1e0 + pow(10e0, (q.r[t.ai] - q.r[t.hi]) / 400e0))))
       else v end)
   from run q join seqs t on t.pool = q.pool and t.rn = q.rn + 1),
 hist as (select match_id, rh, ra from run where rn > 0),
 fin as (select q.pool, q.r from run q join (select pool, max(rn) rn from run group by 1) m on m.pool = q.pool and m.rn = q.rn),
 seen as (select pool, home ent from seqs union select pool, away from seqs),
 final as (select s.pool, s.ent, f.r[cast(s.ent % 100 as integer) + 1] elo from seen s join fin f on f.pool = s.pool)
"""


HIST = f"select match_id, {R('rh', 4)} home_elo, {R('ra', 4)} away_elo from hist"


def _hist(df):
    return df.select("match_id", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"))


@query("e01_elo_history", _elo_sql() + HIST)
def e01(spark, d):
    return _hist(e.elo_history(contests(spark, d)))


@query("e01b_elo_time_blocks", _elo_sql() + HIST)
def e01b(spark, d):
    """The same ratings with every pool cut into blocks of time, as for a pool too large for one task."""
    m = contests(spark, d)
    return _hist(e.elo_history(m, rows_per_task=max(1, m.count() // 75)))


@query("e02_elo_new_entities", _elo_sql(
    k_home="case when h.g < 76 then 50e0 else 32e0 end", k_away="case when a.g < 76 then 50e0 else 32e0 end",
    opening="case when n.g < 76 then 1400e0 else 1500e0 end") + HIST)
def e02(spark, d):
    return _hist(e.elo_history(contests(spark, d), e.EloRule(k_new=e.K_NEW, count_mode="total")))


@query("e02b_elo_new_so_far", _elo_sql(
    k_home="case when hs.g < 76 then 50e0 else 32e0 end", k_away="case when aw.g < 76 then 50e0 else 32e0 end", opening="1400e0") + HIST)
def e02b(spark, d):
    return _hist(e.elo_history(contests(spark, d), e.EloRule(k_new=e.K_NEW)))


@query("e03_elo_warm_start", _elo_sql("match_date < date '1999-08-01' and match_date >= date '1998-02-01'") + f""",
 known as (select distinct pool, ent from long where match_date < date '1999-08-01')
 select k.pool, k.ent, {R('coalesce(f.elo, (select avg(elo) - 0.5e0 * stddev_pop(elo) from final))', 4)} elo,
  cast(f.elo is not null as integer) seen from known k left join final f on f.ent = k.ent""")
def e03(spark, d):
    return e.elo_warm_start(contests(spark, d), "1999-08-01").select("pool", "ent", r6("elo", 4).alias("elo"), "seen").withColumn(
        "pool", F.col("pool").cast("int"))


@query("e04_elo_diff_normalized", _elo_sql() + f"""select match_id, {R('greatest(0e0, least(1e0, (rh - ra + 800) / 1600e0))')} shifted,
  {R('(rh - ra - (select min(rh - ra) from hist)) / (select max(rh - ra) - min(rh - ra) from hist)')} min_max,
  {R('greatest(0e0, least(1e0, (rh - ra + 400) / 800e0))')} static from hist""")
def e04(spark, d):
    df = e.elo_history(contests(spark, d)).withColumn("diff", F.col("home_elo") - F.col("away_elo"))
    lo, hi = n.STATIC_RANGES["elo_diff"]
    out = n.min_max(df, n.fit(df, ["diff"]), ["diff"])
    return out.select("match_id", r6(e.shifted_diff(F.col("diff"))).alias("shifted"), r6("diff_norm").alias("min_max"),
                      r6(n.fixed_range(F.col("diff"), lo, hi)).alias("static"))


@query("e05_bounded_counter", L(f""", f as (select match_id, venue, list_reduce(list_prepend(0.5e0,
    coalesce(list(case res when 1 then 0.1e0 when -1 then -0.05e0 else -0.02e0 end) over (partition by ent order by match_date, match_id
      rows between unbounded preceding and 1 preceding), [])), lambda m, c: greatest(0e0, least(1e0, m + c))) m from long)
  select h.match_id, {R('(h.m - a.m + 1) / 2')} momentum from f h join f a on a.match_id = h.match_id and h.venue = 'H' and a.venue = 'A'"""))
def e05(spark, d):
    c = e.bounded_counter(contests_long(spark, d))
    side = lambda v: F.max(F.when(F.col("venue") == v, F.col("counter")))
    return c.groupBy("match_id").agg(r6((side("H") - side("A") + 1) / 2).alias("momentum"))


@query("e06_state_as_of", _elo_sql("match_date < date '1999-08-01'") + f""",
 past as (select *, row_number() over (partition by ent order by match_date desc, match_id desc) rn from long where match_date < date '1999-08-01')
 select p.ent, {R('max(f.elo)', 4)} elo, count(*) games, cast(count(case when res = 1 then 1 end) as bigint) wins,
  cast(count(case when res = 0 then 1 end) as bigint) draws, cast(count(case when res = -1 then 1 end) as bigint) losses,
  cast(sum(points) as bigint) points, cast(sum(gf) as bigint) goals_for, cast(sum(ga) as bigint) goals_against,
  cast(max(match_date) as varchar) last_day, {R('avg(case when rn <= 5 then points end)')} points_mean_5, {R('avg(case when rn <= 5 then gf end)')} gf_mean_5
 from past p left join final f on f.ent = p.ent group by 1""")
def e06(spark, d):
    st = e.state_as_of(contests(spark, d), contests_long(spark, d), "1999-08-01")
    return st.select("ent", r6("elo", 4).alias("elo"), "games", "wins", "draws", "losses", "points", "goals_for", "goals_against",
                     F.col("last_day").cast("string").alias("last_day"), r6("points_mean_5").alias("points_mean_5"), r6("gf_mean_5").alias("gf_mean_5"))


@query("e06b_pair_state", L("""select least(home, away) lo, greatest(home, away) hi,
  cast(count(case when (result = 'H' and home < away) or (result = 'A' and away < home) then 1 end) as bigint) lo_wins,
  cast(count(case when (result = 'H' and home > away) or (result = 'A' and away > home) then 1 end) as bigint) hi_wins,
  cast(count(case when result = 'D' then 1 end) as bigint) draws, count(*) games
  from contests where match_date < date '1999-08-01' group by 1, 2"""))
def e06b(spark, d):
    return e.pair_state(contests(spark, d), "1999-08-01")


@query("e06c_state_unplayed", with_unplayed(ORACLES["e06_state_as_of"].replace("from long where match_date", "from long where res is not null and match_date").replace(
    "on aw.match_id = c.match_id and aw.venue = 'A' where match_date", "on aw.match_id = c.match_id and aw.venue = 'A' where result is not null and match_date")))
def e06c(spark, d):
    m = unplayed(spark, d)
    st = e.state_as_of(m, to_long(m), "1999-08-01")
    return st.select("ent", r6("elo", 4).alias("elo"), "games", "wins", "draws", "losses", "points", "goals_for", "goals_against",
                     F.col("last_day").cast("string").alias("last_day"), r6("points_mean_5").alias("points_mean_5"), r6("gf_mean_5").alias("gf_mean_5"))


@query("e06d_pairs_unplayed", with_unplayed(ORACLES["e06b_pair_state"].replace("where match_date", "where result is not null and match_date")))
def e06d(spark, d):
    return e.pair_state(unplayed(spark, d), "1999-08-01")


@query("e07_state_summary", _elo_sql() + f"""select 'all' part, cast(null as bigint) ent, count(*) entities, {R('avg(elo)', 3)} mean, {R('stddev_pop(elo)', 3)} std,
  {R('min(elo)', 3)} as min, {R('max(elo)', 3)} as max from final
  union all select * from (select 'top', ent, cast(null as bigint), {R('elo', 3)}, null, null, null from final order by final.elo desc, ent limit 5)""")
def e07(spark, d):
    st = e.elo_final(contests(spark, d))
    cols = ("mean", "std", "min", "max")
    whole = e.state_summary(st).select(F.lit("all").alias("part"), F.lit(None).cast("long").alias("ent"), "entities", *[r6(c, 3).alias(c) for c in cols])
    top = top_bottom(st, "elo", "ent", 5).filter("side = 'top'").select(F.lit("top").alias("part"), "ent", r6("elo", 3).alias("mean"))
    return whole.unionByName(top, allowMissingColumns=True)


BASE_STATS = """, st as (select ent, count(*) games, avg(gf) gf from long group by 1),
  lg as (select (avg(home_goals) + avg(away_goals)) / 2 g from contests)"""


def _base_stats(spark, d):
    stats = a.side_stats(contests_long(spark, d), ["gf"]).withColumnRenamed("gf_mean", "goals_mean")
    league = a.grand_mean(contests(spark, d), "home_goals", "away_goals")
    return stats, league


@query("e08_robust_value", L(BASE_STATS + f" select ent, games, {R('coalesce(case when games >= 5 then gf end, g, 1.2e0)')} robust from st, lg"))
def e08(spark, d):
    stats, league = _base_stats(spark, d)
    return a.robust_value(stats, league, "goals").select("ent", "games", r6("robust").alias("robust"))


@query("e09_quality_multiplier", L(BASE_STATS + f""" select ent, games,
  {R('case when games >= 10 then greatest(0.7e0, least(1.3e0, gf / g)) else 1e0 end')} multiplier from st, lg"""))
def e09(spark, d):
    stats, league = _base_stats(spark, d)
    return a.quality_multiplier(stats, league, "goals").select("ent", "games", r6("multiplier").alias("multiplier"))
