"""T and X families: streaming twins and user hooks."""

from __future__ import annotations

from dataclasses import fields

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from formline.operators import hooks as hk
from formline.operators import history as h
from formline.operators import ratings as e
from formline.operators import training as tr
from formline.plans.base_sql import C, L, P
from formline.plans.features import FeatureSet
from formline.plans import q_history, q_scalar  # noqa: F401  their SQL is part of a query here
from formline.plans.q_ratings import HIST, _elo_sql
from formline.plans.registry import ORACLES, R, query, r6
from formline.sources import sinks as sk
from formline.sources.contests import contests, contests_long, table
from formline.session import scratch, stored
from formline.streaming import twins as st

CUT = "1999-08-01"


def seasons(spark, d):
    """Season slices in order; the list has one entry per year of the log."""
    found = [r["season"] for r in contests(spark, d).select("season").distinct().orderBy("season").collect()]
    return [F.col("season") == s for s in found]


def _ts():
    return st.day_start(F.col("match_date")).alias("ts")


def _games(spark, d):
    score = F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).when(F.col("result") == "A", 0.0)
    return contests(spark, d).select(F.col("pool").cast("long").alias("pool"), _ts(), "match_id", "home", "away", "season", score.alias("score"))


@query("t01_stream_elo", _elo_sql() + HIST)
def t01(spark, d):
    out = st.run(st.elo(st.replay(_games(spark, d), seasons(spark, d))))
    return out.select("match_id", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"))


@query("t02_stream_last_n", L(f"""select match_id, venue, {R('list_avg(i)')} mean, cast(coalesce(len(i), 0) as integer) n from (
  select match_id, venue, list_reverse(list_reverse(coalesce(list(xg) filter (where xg is not null) over (partition by ent order by match_date, match_id
    rows between unbounded preceding and 1 preceding), []))[1:5]) i from long)"""))
def t02(spark, d):
    rows = contests_long(spark, d).select("ent", _ts(), "match_id", "venue", F.col("xg").alias("value"), "season")
    return st.run(st.last_n(st.replay(rows, seasons(spark, d)))).select("match_id", "venue", r6("mean").alias("mean"), "n")


@query("t03_stream_h2h", C("""select match_id, count(case when w = 1 then 1 end) over o lo_wins, count(case when w = -1 then 1 end) over o hi_wins,
   count(case when w = 0 then 1 end) over o draws, count(*) over o games from (select *, least(home, away) lo, greatest(home, away) hi,
    case when result = 'D' then 0 when (result = 'H') = (home < away) then 1 else -1 end w from contests)
  window o as (partition by lo, hi order by match_date, match_id rows between unbounded preceding and 1 preceding)"""))
def t03(spark, d):
    rows = contests(spark, d).select(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi"), _ts(), "match_id", "home", "result", "season")
    return st.run(st.pair_counts(st.replay(rows, seasons(spark, d)))).select("match_id", "lo_wins", "hi_wins", "draws", "games")


@query("t01b_out_of_order", _elo_sql("season > (select min(season) from contests)") + f"""select match_id, {R('rh', 4)} home_elo, {R('ra', 4)} away_elo, 0 as late from hist
  union all select match_id, null, null, 1 from contests where season = (select min(season) from contests)""")
def t01b(spark, d):
    """The first season arrives after all others: it goes to the late rows and changes no rating."""
    first, *others = seasons(spark, d)
    played, late = st.in_order(st.run(st.elo(st.replay(_games(spark, d), [*others, first]))))
    both = played.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    return both.select("match_id", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"), F.col("_late").alias("late"))


@query("t04_day_barrier", P("""select l.match_id, l.venue, count(p.res) games, cast(coalesce(sum(p.points), 0) as bigint) points
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2"""))
def t04(spark, d):
    """Every day; the last one is closed by the end of the log."""
    rows = contests_long(spark, d).select("ent", _ts(), F.unix_date("match_date").alias("day"), "match_id", "venue",
                                          F.col("points").cast("long").alias("points"), "season")
    log = rows.unionByName(st.end_of_log(rows))
    stream = st.replay(log, [*seasons(spark, d), F.col("season").isNull()])
    return st.run(st.day_barrier(stream)).select("match_id", "venue", "games", "points")


@query("t05_late_rows", C(""", w as (select max(match_date) m from contests where pool >= 5)
  select match_id, cast(case when pool < 5 and match_date < m - interval 400 day then 1 else 0 end as integer) late from contests, w"""))
def t05(spark, d):
    """Five pools arrive after all others; what is older than the high mark minus the delay is late."""
    rows = contests(spark, d).select("match_id", _ts(), "pool")
    stream = st.replay(rows, [F.col("pool") >= 5, F.col("pool") < 5])
    good, late = st.split_late(stream, "ts", "400 days")
    mark = lambda df, v: df.select("match_id", F.lit(v).alias("late"))
    return mark(good, 0).unionByName(mark(late, 1))


def _events(spark, d, cols, days):
    """The event log as a stream that ends ``days`` days after its last event."""
    half = F.lit("2024-01-15").cast("timestamp")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), *cols).withColumn("_end", F.lit(0))
    log = rows.unionByName(st.closing_row(rows, "ts", days))
    return st.replay(log, [(F.col("ts") < half) & F.col("_end").isNotNull(), (F.col("ts") >= half) & F.col("_end").isNotNull(), F.col("_end").isNull()]).drop("_end")


@query("t06_windowed_counts", "select strftime(date_trunc('day', ts), '%Y-%m-%d') start, event_type, count(*) n from events group by 1, 2")
def t06(spark, d):
    stream = _events(spark, d, ["event_type"], 3).withWatermark("ts", "0 seconds")
    return st.run(st.windowed_counts(stream, "ts", ["event_type"], "1 day")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def _sliding_sql(days: int) -> str:
    return f"""select strftime(s, '%Y-%m-%d') start, count(*) n from (
  select unnest(generate_series(date_trunc('day', ts) - interval {days - 1} day, date_trunc('day', ts), interval 1 day)) s from events) group by 1"""


def _sliding(spark, d, days):
    return st.run(st.sliding_append(_events(spark, d, [], days + 3), "ts", days)).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("t06b_sliding_counts", _sliding_sql(14))
def t06b(spark, d):
    """The sliding windows of the stream; ``sliding_counts`` is its batch twin."""
    return _sliding(spark, d, 14)


@query("t06c_sliding_month", _sliding_sql(30))
def t06c(spark, d):
    return _sliding(spark, d, 30)


SESSION_SQL = """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from (
   select *, sum(f) over (partition by user_id order by ts) g from (
    select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end f from events))
  group by user_id, g"""


@query("t07_sessions", SESSION_SQL)
def t07(spark, d):
    out = st.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("t07b_sessions_stream", SESSION_SQL)
def t07b(spark, d):
    stream = _events(spark, d, ["user_id"], 3).withWatermark("ts", "1 day")
    out = st.run(st.sessions_stream(stream, "user_id", "ts", "6 hours"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("t08_warm_start", _elo_sql() + f"select h.match_id, {R('rh', 4)} home_elo, {R('ra', 4)} away_elo from hist h join contests c on c.match_id = h.match_id where match_date >= date '{CUT}'")
def t08(spark, d):
    """Ratings as of the cut-off from a stored snapshot, then the later seasons as a stream."""
    day = F.lit(CUT).cast("date")
    path = scratch(spark, "snapshot")
    sk.write_snapshot(e.elo_final(contests(spark, d).filter(F.col("match_date") < day)), path, CUT)
    opening = sk.load_snapshot(spark, path, CUT).select("pool", "ent", "elo")
    later = _games(spark, d).filter(F.col("ts") >= st.day_start(day))
    out = st.run(st.elo(st.replay(later, [F.col("season") <= 1999, F.col("season") > 1999]), opening))
    return out.select("match_id", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"))


@query("t08b_restart_from_state", _elo_sql() + f"select h.match_id, {R('rh', 4)} home_elo, {R('ra', 4)} away_elo from hist h join contests c on c.match_id = h.match_id where match_date >= date '{CUT}'")
def t08b(spark, d):
    """The later seasons, from the state that a stream over the earlier ones held."""
    day, at = F.lit(CUT).cast("date"), scratch(spark, "ratings")
    games = _games(spark, d)
    early = games.filter(F.col("ts") < st.day_start(day))
    st.run(st.elo(st.replay(early, [F.col("season") <= 1996, F.col("season") > 1996])), at=at)
    opening = st.state_of(spark, at, "ratings")
    later = games.filter(F.col("ts") >= st.day_start(day))
    out = st.run(st.elo(st.replay(later, [F.col("season") <= 1999, F.col("season") > 1999]), opening))
    return out.select("match_id", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"))


@query("s13b_stream_snapshot", _elo_sql(f"match_date < date '{CUT}'") + f" select cast(pool as bigint) pool, ent, {R('elo', 4)} elo from final")
def s13b(spark, d):
    """Ratings as of a day out of the checkpoint of a stream that has long gone on: the state after the micro-batch of that season."""
    at, slices = scratch(spark, "ratings"), seasons(spark, d)
    st.run(st.elo(st.replay(_games(spark, d), slices)), at=at)
    batch = contests(spark, d).filter(F.col("match_date") < F.lit(CUT).cast("date")).agg(F.count_distinct("season").alias("n")).first()["n"] - 1
    return st.state_of(spark, at, "ratings", batch).select("pool", "ent", r6("elo", 4).alias("elo"))


def _feature_stream(spark, d):
    rows = contests(spark, d).select(_ts(), F.col("pool").cast("long").alias("pool"), "match_id", F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "result",
                                     F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).when(F.col("result") == "A", 0.0).alias("score"), "home_goals", "away_goals", "season")
    log = stored(rows.unionByName(st.closing_row(rows, "ts", 3)), "log")  # each slice reads it again
    stream = st.replay(log, [*seasons(spark, d), F.col("season").isNull()]).withWatermark("ts", "0 seconds")
    return st.game_features(stream.filter("match_id is not null or ts is null"))  # the closing row only moves the watermark


STREAM_SQL = _elo_sql() + """, form as (select match_id, venue, list_avg(list_reverse(list_reverse(coalesce(list(gf) over (partition by ent order by match_date, match_id
    rows between unbounded preceding and 1 preceding), []))[1:5])) m from long),
 met as (select match_id, count(case when w = 1 then 1 end) over o lo_wins, count(case when w = -1 then 1 end) over o hi_wins, count(case when w = 0 then 1 end) over o draws, count(*) over o games
   from (select *, least(home, away) lo, greatest(home, away) hi, case when result = 'D' then 0 when (result = 'H') = (home < away) then 1 else -1 end w from contests)
   window o as (partition by lo, hi order by match_date, match_id rows between unbounded preceding and 1 preceding))"""


@query("t09b_stream_features", STREAM_SQL + f""" select c.match_id, {R('h.m')} home_mean, {R('a.m')} away_mean, lo_wins, hi_wins, draws, games, {R('rh', 4)} home_elo, {R('ra', 4)} away_elo
  from contests c join form h on h.match_id = c.match_id and h.venue = 'H' join form a on a.match_id = c.match_id and a.venue = 'A' join met on met.match_id = c.match_id join hist on hist.match_id = c.match_id""")
def t09b(spark, d):
    """Features that arise inside one stream, row by row."""
    out = st.run(_feature_stream(spark, d), partitions=st.state_partitions(spark))
    return out.select("match_id", r6("home_mean").alias("home_mean"), r6("away_mean").alias("away_mean"), "lo_wins", "hi_wins", "draws", "games", r6("home_elo", 4).alias("home_elo"), r6("away_elo", 4).alias("away_elo"))


@query("t09c_stream_scores", _elo_sql() + f""", p as (select c.match_date, case result when 'H' then 0 when 'D' then 1 else 2 end y, 0.75e0 / (1 + pow(10e0, (ra - rh) / 400e0)) ph from hist join contests c on c.match_id = hist.match_id)
  select cast(match_date as varchar) as day, count(*) games, {R('avg(case when y = case when ph >= 0.375e0 then 0 else 2 end then 1e0 else 0e0 end)')} accuracy,
   {R('avg(-ln(case y when 0 then ph when 1 then 0.25e0 else 0.75e0 - ph end))')} log_loss from p group by 1""")
def t09c(spark, d):
    """Predictions of each game before its outcome counts, scored by day in the same query that builds the features: ratings share three quarters, a draw has one."""
    expected = 0.75 / (1 + F.pow(F.lit(10.0), (F.col("away_elo") - F.col("home_elo")) / 400.0))
    scored = _feature_stream(spark, d).withColumns({"p_h": expected, "p_d": F.lit(0.25), "p_a": 0.75 - expected, "pred": F.when(expected >= 0.375, 0).otherwise(2),
                                                    "actual": F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).when(F.col("result") == "A", 2)})
    return st.run(st.daily_scores(scored), partitions=st.state_partitions(spark)).select(F.col("day").cast("string").alias("day"), "games", r6("accuracy").alias("accuracy"), r6("log_loss").alias("log_loss"))


@query("t09_prequential")
def t09(spark, d):
    from formline.operators.aggregates import daily_accuracy
    from formline.operators.evaluation import PROBS, row_log_loss
    from formline.plans.q_models import FEATURES, matrix
    data = tr.stored(matrix(spark, d), "matrix")
    model = tr.logistic("y").fit(tr.assemble(data.filter(F.col("match_date") < F.lit(CUT).cast("date")), FEATURES))
    later = data.filter(F.col("match_date") >= F.lit(CUT).cast("date"))
    stream = tr.assemble(st.replay(later, [F.col("season") <= 1999, F.col("season") > 1999]), FEATURES)
    pred = st.prequential(stream, model, "y")
    return daily_accuracy(pred, row_log_loss(F.col("actual"), [F.col(p) for p in PROBS]))


@query("t10_refresh_stats", C(f""", s as (select season, sum(count(*)) over (order by season) n, from contests group by 1),
  c as (select s.season, n, (select avg(home_goals - away_goals) from contests x where x.season <= s.season) m,
    (select stddev_pop(home_goals - away_goals) from contests x where x.season <= s.season) sd, (select min(home_goals - away_goals) from contests x where x.season <= s.season) lo,
    (select max(home_goals - away_goals) from contests x where x.season <= s.season) hi from s),
  k as (select *, n // 50 st, coalesce(lag(n // 50) over (order by season), 0) ps from c)
  select cast(n as bigint) as rows, {R('m')} gd_mean, {R('sd')} gd_std, {R('lo')} gd_min, {R('hi')} gd_max from k where st > ps"""))
def t10(spark, d):
    rows = contests(spark, d).select("season", (F.col("home_goals") - F.col("away_goals")).alias("gd"))
    out = st.refresh_stats(st.replay(rows, seasons(spark, d)), ["gd"], 50)
    return out.select("rows", *[r6(c).alias(c) for c in ("gd_mean", "gd_std", "gd_min", "gd_max")])


@query("t11_stream_static_join", C("select match_id, n_name from contests left join nation on n_nationkey = pool"))
def t11(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").alias("pool"), "n_name")
    stream = st.replay(contests(spark, d).select("match_id", "pool", "season"), seasons(spark, d))
    return st.run(st.enrich(stream, dim, "pool")).select("match_id", "n_name")


# --- X -----------------------------------------------------------------------------------------

@query("x01_scalar_hook", C(f"select match_id, {R('home_xg * 2 + 1')} by_column, {R('home_xg * 2 + 1')} by_batch from contests"))
def x01(spark, d):
    m = hk.map_columns(contests(spark, d), {"by_column": lambda c: c("home_xg") * 2 + 1})
    m = hk.map_batches(m, "by_batch", ["home_xg"], lambda x: x * 2 + 1)
    return m.select("match_id", r6("by_column").alias("by_column"), r6("by_batch").alias("by_batch"))


def _spread(frame: pd.DataFrame) -> pd.Series:
    """Largest minus smallest of each history list."""
    return frame["gf"].map(lambda v: float(max(v) - min(v)) if v is not None and len(v) else None).astype("float64")


@query("x02_history_hook", P(f"""select l.match_id, l.venue, {R('max(p.gf) - min(p.gf)')} spread from long l
  left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def x02(spark, d):
    out = hk.apply_history(contests_long(spark, d), ["gf"], 5, _spread, "spread")
    return out.select("match_id", "venue", r6("spread").alias("spread"))


def _longest_run(state: tuple[int, int], rows: pa.RecordBatch) -> tuple[tuple[int, int], pa.Array]:
    """Longest run of games without a loss before each row; the state is the open run and the longest one."""
    run, best = state
    lost = np.nan_to_num(rows.column("res").to_numpy(zero_copy_only=False).astype(np.float64)) < 0
    n = np.arange(1, len(lost) + 1)
    since = np.maximum.accumulate(np.where(lost, n, -run))  # where the open run began
    length = n - since
    longest = np.maximum.accumulate(np.maximum(length, best))
    return (int(length[-1]), int(longest[-1])), pa.array(np.concatenate([[best], longest[:-1]]))


@query("x02b_history_fold", L("""select match_id, venue, coalesce(max(run) over (partition by ent order by match_date, match_id, venue rows between unbounded preceding and 1 preceding), 0) longest
  from (select *, row_number() over (partition by ent, g order by match_date, match_id, venue) - cast(g > 0 as integer) run from (
   select *, sum(case when res < 0 then 1 else 0 end) over (partition by ent order by match_date, match_id, venue) g from long))"""))
def x02b(spark, d):
    """An expanding statistic over all of an entity's rows, by user code that carries two numbers."""
    return hk.fold_history(contests_long(spark, d), "ent", ["match_date", "match_id", "venue"], ["res"], lambda: (0, 0), _longest_run, "longest", "long").select("match_id", "venue", "longest")


def _run_columns(schema: StructType, options: dict) -> StructType:
    """The entity as it is typed in the input, and the ends of the run by id, or by date as well."""
    out = [schema["ent"], StructField("res", IntegerType()), StructField("games", LongType()), StructField("first_id", schema["match_id"].dataType), StructField("last_id", schema["match_id"].dataType)]
    return StructType(out + ([StructField("first_day", schema["match_date"].dataType)] if options.get("days") else []))


def _run_start(at_least: int = 1, days: bool = False) -> dict:
    return {"least": at_least, "days": days, "open": None}


def _runs(state: dict, rows: pa.Table | None) -> tuple[dict, pa.Table | None]:
    """Runs of equal results that end in ``rows``; all that is open where there are none."""
    ended = []
    if rows is not None:
        rows = rows.filter(pc.is_valid(rows.column("res")))
        if not rows.num_rows:
            return state, None
        res = rows.column("res").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], res[1:] != res[:-1]]))
        col = {c: rows.column(c) for c in ("ent", "match_id", "match_date")}
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(res)]):  # a step a run
            run = {"ent": col["ent"][a], "res": int(res[a]), "games": b - a, "first_id": col["match_id"][a], "last_id": col["match_id"][b - 1], "first_day": col["match_date"][a]}
            held = state["open"]
            if held is not None and held["res"] == run["res"]:
                run = {**held, "games": held["games"] + run["games"], "last_id": run["last_id"]}
            elif held is not None:
                ended.append(held)
            state["open"] = run
    elif state["open"] is not None:
        ended.append(state["open"])
    ended = [r for r in ended if r["games"] >= state["least"]]
    if not ended:
        return state, None
    types = {"res": pa.int32(), "games": pa.int64()}
    names = ["ent", "res", "games", "first_id", "last_id", *(["first_day"] if state["days"] else [])]
    return state, pa.table({c: pa.array([r[c].as_py() if isinstance(r[c], pa.Scalar) else r[c] for r in ended], types.get(c) or ended[0][c].type) for c in names})


@query("x03b_table_function", L("""select ent, res, games, first_id, last_id, first_day from (
  select ent, res, count(*) games, arg_min(match_id, (match_date, match_id)) first_id, arg_max(match_id, (match_date, match_id)) last_id, min(match_date) first_day from (
   select *, row_number() over (partition by ent order by match_date, match_id) - row_number() over (partition by ent, res order by match_date, match_id) g from long) group by ent, res, g) where games >= 3"""))
def x03b(spark, d):
    """Runs of three and more equal results, by a table function over ordered partitions; its columns follow the options."""
    rows = contests_long(spark, d).select("ent", "match_date", "match_id", "res")
    return hk.table_function(rows, ["ent"], ["match_date", "match_id"], _run_columns, _run_start, _runs, lambda state: _runs(state, None)[1], {"at_least": 3, "days": True})


@query("x03_table_hook", L("select match_id, ent, venue, points from long"))
def x03(spark, d):
    m = contests(spark, d)
    sides = [{"ent": F.col("home"), "venue": F.lit("H"), "points": F.when(F.col("result") == "H", 3).when(F.col("result") == "D", 1).otherwise(0)},
             {"ent": F.col("away"), "venue": F.lit("A"), "points": F.when(F.col("result") == "A", 3).when(F.col("result") == "D", 1).otherwise(0)}]
    return hk.one_to_many(m, ["match_id"], sides)


@query("x04_custom_aggregate", P(f"""select l.match_id, l.venue, {R('sum(p.points * pow(0.9e0, p.rn - 1)) / sum(pow(0.9e0, p.rn - 1))')} decayed from long l
  left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def x04(spark, d):
    past = h.with_past(contests_long(spark, d), ["points"], 5)
    return past.select("match_id", "venue", r6(hk.decayed_mean(h.field(F.col("past"), "points"), 0.9)).alias("decayed"))


FLAG_SQL = """, f as (select l.match_id, l.venue, avg(p.points) pts, avg(p.gf) gf from long l
   left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2),
 meet as (select a.match_id, row_number() over (partition by a.match_id order by b.match_date desc, b.match_id desc) rn,
    case when b.result = 'D' then 1 when (b.result = 'H') = (b.home = a.home) then 3 else 0 end q
  from contests a join contests b on least(a.home, a.away) = least(b.home, b.away)
   and greatest(a.home, a.away) = greatest(b.home, b.away) and b.match_date < a.match_date),
 hh as (select c.match_id, coalesce(sum(q) / (3e0 * count(q)), 0.5e0) h2h from contests c left join meet m on m.match_id = c.match_id and rn <= 5 group by 1)"""


@query("x05_feature_set", P(FLAG_SQL + f""" select c.match_id, {R('h.pts')} home_points_5, {R('a.pts')} away_points_5, {R('h.pts - a.pts')} points_diff,
  {R('greatest(0e0, least(1e0, case when h.pts - a.pts is not null then (h.pts - a.pts + 3) / 6 end))')} points_diff_normalized,
  {R('h.gf - a.gf')} gf_diff, {R('h2h')} h2h from contests c join f h on h.match_id = c.match_id and h.venue = 'H'
  join f a on a.match_id = c.match_id and a.venue = 'A' join hh on hh.match_id = c.match_id""".replace(
      "greatest(0e0, least(1e0, case when h.pts - a.pts is not null then (h.pts - a.pts + 3) / 6 end))",
      "case when h.pts - a.pts is not null then greatest(0e0, least(1e0, (h.pts - a.pts + 3) / 6)) end")))
def x05(spark, d):
    df = FeatureSet.only("form", "goals", "h2h", "normalize").build(contests(spark, d), contests_long(spark, d))
    cols = ["home_points_5", "away_points_5", "points_diff", "points_diff_normalized", "gf_diff", "h2h"]
    return df.select("match_id", *[r6(c).alias(c) for c in cols])


_ALL = ["home_points_5", "away_points_5", "points_diff", "points_diff_normalized", "gf_diff", "gf_diff_normalized", "xg_diff", "xg_diff_normalized", "h2h", "home_season_points",
        "away_season_points", "season_points_diff", "elo_diff_normalized", "rest_advantage", "congestion", "fatigue", "p_home", "p_draw", "p_away", "market_entropy", "momentum", "week_normalized"]
_FAIR = [f"(1 / {b}) / (1 / B365H + 1 / B365D + 1 / B365A)" for b in ("B365H", "B365D", "B365A")]
_DIFFS_SQL = P(f""", f as (select l.match_id, l.venue, avg(p.xg) xg, avg(p.gf) gf from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2)
   select h.match_id, {R('h.xg - a.xg')} xg_diff, {R('case when h.xg - a.xg is not null then greatest(0e0, least(1e0, (h.xg - a.xg + 2) / 4)) end')} xg_diff_normalized,
    {R('case when h.gf - a.gf is not null then greatest(0e0, least(1e0, (h.gf - a.gf + 2) / 4)) end')} gf_diff_normalized
   from f h join f a on a.match_id = h.match_id and h.venue = 'H' and a.venue = 'A'""")
_MARKET_SQL = C(f"""select match_id, {R(_FAIR[0])} p_home, {R(_FAIR[1])} p_draw, {R(_FAIR[2])} p_away,
   {R('-(' + ' + '.join(f'{p} * ln({p} + 1e-10)' for p in _FAIR) + ') / ln(3e0)')} market_entropy from contests""")
_PARTS = [ORACLES[n] for n in ("w13_season_points_before", "e04_elo_diff_normalized", "f19_rest_and_fatigue", "e05_bounded_counter", "w26_matchweek")] + [_DIFFS_SQL, _MARKET_SQL]


@query("x05b_all_switches", f"""select match_id, {', '.join('shifted elo_diff_normalized' if c == 'elo_diff_normalized' else c for c in _ALL)}
  from ({ORACLES['x05_feature_set']}) """ + " ".join(f"join ({p}) using (match_id)" for p in _PARTS))
def x05b(spark, d):
    """Every switch on."""
    every = FeatureSet.only(*[f.name for f in fields(FeatureSet)])
    df = every.build(contests(spark, d, odds=True), contests_long(spark, d))
    return df.select("match_id", *[F.col(c) if c.endswith("_points") or c in ("season_points_diff", "rest_advantage") else r6(c).alias(c) for c in _ALL])


@query("x06_leakage_guard", C(f"select match_id, case when match_date < date '{CUT}' then 'train' else 'test' end part from contests"))
def x06(spark, d):
    from formline.operators.evaluation import split_by_date
    return hk.guarded(split_by_date(contests(spark, d), CUT), lambda df: df.select("match_id", "part"), advisory=("shared",))
