"""SQL twins of the contest views, used as a prefix by the oracle queries."""

from formline.sources.contests import BOOKS

_ODDS = ",\n".join(
    f"  case when o_orderkey % {gap} <> 0 then 1.2e0 + cast((o_orderkey * {mult}) % 480 as double)/100 end as {name}"
    for name, mult, gap in BOOKS)

CONTESTS = f"""
lines as (
  select l_orderkey,
    sum(case when l_linenumber % 2 = 1 then l_quantity end) home_shots,
    sum(case when l_linenumber % 2 = 0 then l_quantity end) away_shots,
    cast(sum(case when l_linenumber % 2 = 1 then 1 else 0 end) as bigint) home_corners,
    cast(sum(case when l_linenumber % 2 = 0 then 1 else 0 end) as bigint) away_corners
  from lineitem group by l_orderkey),
raw as (
  select o.*, cast(o_orderdate as date) d, cast(floor(o_totalprice) as bigint) % 3 base, c_nationkey
  from orders o join customer on c_custkey = o_custkey),
contests as (
  select o_orderkey match_id, d match_date,
    cast(year(d) - case when month(d) < 8 then 1 else 0 end as integer) season,
    cast(c_nationkey as integer) pool,
    c_nationkey * 100 + o_custkey % 20 home,
    c_nationkey * 100 + (o_custkey % 20 + 1 + o_orderkey % 19) % 20 away,
    case o_orderstatus when 'F' then 'H' when 'O' then 'A' else 'D' end as result,
    base + case when o_orderstatus = 'F' then 1 + o_orderkey % 3 else 0 end home_goals,
    base + case when o_orderstatus = 'O' then 1 + o_orderkey % 3 else 0 end away_goals,
    case when o_orderkey % 23 <> 0 then base + cast(o_orderkey % 97 as double)/50 end home_xg,
    case when o_orderkey % 23 <> 0 then base + cast(o_orderkey % 89 as double)/50 end away_xg,
    home_shots, away_shots, home_corners, away_corners,
{_ODDS}
  from raw left join lines on l_orderkey = o_orderkey)"""

LONG = CONTESTS + """,
long as (
  select match_id, match_date, season, pool, home ent, away opp, 'H' venue, home_goals gf, away_goals ga,
    home_xg xg, away_xg xg_against, home_shots shots, away_shots shots_against,
    home_corners corners, away_corners corners_against,
    case when home_goals > away_goals then 3 when home_goals = away_goals then 1 else 0 end points,
    cast(sign(home_goals - away_goals) as integer) res from contests
  union all
  select match_id, match_date, season, pool, away, home, 'A', away_goals, home_goals,
    away_xg, home_xg, away_shots, home_shots, away_corners, home_corners,
    case when away_goals > home_goals then 3 when home_goals = away_goals then 1 else 0 end,
    cast(sign(away_goals - home_goals) as integer) from contests)"""

# Every strictly earlier game of the entity of each row, newest first.
PAST = LONG + """,
past as (
  select a.match_id, a.venue, a.ent, a.match_date, b.match_id bid, b.match_date bdate, b.venue bvenue,
    b.points, b.res, b.gf, b.ga, b.xg, b.shots, b.shots_against, b.corners, b.corners_against,
    row_number() over (partition by a.match_id, a.venue order by b.match_date desc, b.match_id desc) rn,
    row_number() over (partition by a.match_id, a.venue, b.venue order by b.match_date desc, b.match_id desc) rnv
  from long a join long b on a.ent = b.ent and b.match_date < a.match_date)"""


def C(body: str) -> str:
    return f"with {CONTESTS}\n{body}"


def L(body: str) -> str:
    return f"with {LONG}\n{body}"


def P(body: str) -> str:
    return f"with {PAST}\n{body}"


# The log with every seventh game not played yet.
UNPLAYED = CONTESTS.replace("\ncontests as (", "\nall_contests as (") + """,
contests as (select * replace (case when match_id % 7 <> 0 then result end as result, case when match_id % 7 <> 0 then home_goals end as home_goals,
  case when match_id % 7 <> 0 then away_goals end as away_goals) from all_contests)"""


def with_unplayed(sql: str) -> str:
    """The same SQL over the log with unplayed games."""
    return sql.replace(CONTESTS.strip(), UNPLAYED.strip())
