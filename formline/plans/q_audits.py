"""V and R families: audits, redundancy, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions.scalar import CLASS_CODE, code
from formline.operators import audits as v
from formline.operators import history as h
from formline.operators import normalise as n
from formline.operators import ratings as e
from formline.operators import selection as sel
from formline.operators.evaluation import split_by_date
from formline.operators.information import knn_mutual_information
from formline.plans.base_sql import C, CONTESTS, L, P
from formline.plans.q_ratings import _elo_sql
from formline.plans.registry import R, query, r6
from formline.sources.contests import contests, contests_long

CUT = "1999-08-01"


def rows(df):
    return df.select("check", "subject", r6("value").alias("value"), "threshold", "passed")


def A(src: str, *specs) -> str:
    """Audit rows in SQL: each spec is (check, subject, value, threshold, test on x)."""
    return " union all ".join(
        f"select '{c}' as check, '{s}' subject, {R('x')} as value, {float(t)!r}::double threshold, "
        f"coalesce(cast({test} as integer), {null}) passed from (select cast({val} as double) x from {src})"
        for c, s, val, t, test, null in [(*sp, 1)[:6] if len(sp) == 5 else sp for sp in specs])


NORM_SQL = f""", tr as (select * from contests where match_date < date '{CUT}'),
 st as (select min(home_xg) l1, max(home_xg) h1, min(home_shots) l2, max(home_shots) h2 from tr),
 z as (select c.*, (home_xg - l1) / (h1 - l1) home_xg_norm, (home_shots - l2) / (h2 - l2) home_shots_norm,
   case when match_date < date '{CUT}' then 'train' else 'test' end part, case result when 'H' then 0 when 'D' then 1 else 2 end y from contests c, st)"""
NORM = ["home_xg_norm", "home_shots_norm"]


def normed(spark, d):
    m = split_by_date(contests(spark, d, shots=True), CUT).withColumn("y", code(F.col("result"), CLASS_CODE))
    return n.min_max(m, n.fit(m.filter("part = 'train'"), ["home_xg", "home_shots"]), ["home_xg", "home_shots"])


@query("v01_schema_and_domain", C(NORM_SQL + A("z", ("missing_columns", "elo", "max(1)", 0, "x <= 0"), ("extra_columns", "match_id", "max(1)", 0, "x <= 0"),
    ("bad_target", "y", "count(case when y not in (0, 1) then 1 end)", 0, "x <= 0"),
    *[s for c in NORM for s in (("nulls", c, f"count(*) - count({c})", 0, "x <= 0"), ("not_normalised", c, f"count(case when {c} < 0 or {c} > 1 then 1 end)", 0, "x <= 0"))])))
def v01(spark, d):
    return rows(v.schema_and_domain(normed(spark, d).select("match_id", *NORM, "y"), [*NORM, "elo"], "y", [0, 1]))


@query("v02_ranges", C(NORM_SQL + A("z", *[s for c in NORM for s in (
    ("min", c, f"min({c})", -0.01, "x >= -0.01"), ("max", c, f"max({c})", 1.01, "x <= 1.01"), ("infinite", c, f"count(case when isinf({c}) or isnan({c}) then 1 end)", 0, "x <= 0"))])))
def v02(spark, d):
    return rows(v.ranges(normed(spark, d), NORM))


@query("v03_derived_consistency", L(", z as (select home_goals, away_goals, l.gf - l.ga gd, l.gf + l.ga tg from contests join long l on l.match_id = contests.match_id and l.venue = 'H')" + A(
    "z", ("derived", "gd", "max(abs(gd - (home_goals - away_goals)))", 1e-6, "x <= 1e-6"), ("derived", "tg", "max(abs(tg - (home_goals + away_goals)))", 1e-6, "x <= 1e-6"))))
def v03(spark, d):
    a, b = F.col("home_goals"), F.col("away_goals")
    side = contests_long(spark, d).filter("venue = 'H'").select("match_id", (F.col("gf") - F.col("ga")).alias("gd"), (F.col("gf") + F.col("ga")).alias("tg"))
    m = contests(spark, d).join(side, "match_id")
    return rows(v.derived(m, {"gd": a - b, "tg": a + b}))


SLICES = (("home_wins", "result = 'H'", 1.0, 9.0), ("draws", "result = 'D'", 0.0, 0.5))


@query("v04_slice_expectations", C(A("contests", *[s for name, cond, lo, hi in SLICES for s in (
    ("slice_low", name, f"avg(case when {cond} then home_goals - away_goals end)", lo, f"x >= {lo}"),
    ("slice_high", name, f"avg(case when {cond} then home_goals - away_goals end)", hi, f"x <= {hi}"))])))
def v04(spark, d):
    diff = F.col("home_goals") - F.col("away_goals")
    return rows(v.slice_expectations(contests(spark, d), [("home_wins", F.col("result") == "H", diff, 1.0, 9.0), ("draws", F.col("result") == "D", diff, 0.0, 0.5)]))


@query("v05_dominance", C(" union all ".join(f"""select 'dominance' as check, '{c}' subject, {R('m / cast(t as double)')} as value, 0.5e0 threshold, cast(m / cast(t as double) <= 0.5e0 as integer) passed
  from (select max(k) m from (select count(*) k from contests where {c} is not null group by {c})), (select count(*) t from contests)""" for c in ("result", "home_goals", "season"))))
def v05(spark, d):
    return rows(v.dominance(contests(spark, d), ["result", "home_goals", "season"]))


_SH = {k: f"avg(case when result = '{k}' then 1e0 else 0e0 end)" for k in "HDA"}
EXPECTED = {"H": 0.436, "D": 0.23, "A": 0.334}


@query("v06_class_balance", C(A("contests", *[("class_share_gap", k, f"abs({_SH[k]} - {t}e0)", 0.05, "x <= 0.05") for k, t in EXPECTED.items()],
    ("class_spread", "result", f"greatest({', '.join(_SH.values())}) - least({', '.join(_SH.values())})", 0.3, "x <= 0.3"))))
def v06(spark, d):
    return rows(v.class_balance(contests(spark, d), "result", EXPECTED))


@query("v07_result_consistency", C(A("contests", ("result_mismatch", "result", "count(case when result <> case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end then 1 end)", 0, "x <= 0"),
    *[("negative", m, f"count(case when {m} < 0 then 1 end)", 0, "x <= 0") for m in ("home_goals", "away_goals", "home_xg")])))
def v07(spark, d):
    return rows(v.result_consistency(contests(spark, d), ["home_goals", "away_goals", "home_xg"]))


@query("v08_low_variance", C(NORM_SQL + ", y as (select *, 1e0 const from z)" + A("y", *[s for c in (*NORM, "const") for s in (
    ("std", c, f"stddev_samp({c})", 1e-3, "x >= 1e-3", 0), ("variance", c, f"var_samp({c})", 1e-10, "x >= 1e-10", 0))])))
def v08(spark, d):
    return rows(v.low_variance(normed(spark, d).withColumn("const", F.lit(1.0)), [*NORM, "const"]))


_SK = lambda c: f"(select abs(avg(pow({c} - m, 3)) / pow(stddev_pop({c}), 3)) from z, (select avg({c}) m from z) where {c} is not null)"


@query("v09_skew_and_extremes", C(NORM_SQL + " union all ".join(
    f"""select 'skewness' as check, '{c}' subject, {R(_SK(c), 5)} as value, 3e0 threshold, cast({_SK(c)} <= 3 as integer) passed
    union all select 'extreme_share', '{c}', {R(f"avg(case when {c} < 0.1 or {c} > 0.9 then 1e0 else 0e0 end)", 5)}, 0.5e0, cast(avg(case when {c} < 0.1 or {c} > 0.9 then 1e0 else 0e0 end) <= 0.5 as integer) from z where {c} is not null""" for c in NORM)))
def v09(spark, d):
    return v.skew_and_extremes(normed(spark, d), NORM).withColumn("value", r6("value", 5))


@query("v10_forbidden_columns", C(A("(select 1 from contests limit 1)", ("forbidden", "home_goals", "max(1)", 0, "x <= 0"), ("forbidden", "attendance", "max(0)", 0, "x <= 0"))))
def v10(spark, d):
    return rows(v.forbidden_columns(contests(spark, d), ["home_goals", "attendance"]))


@query("v11_target_correlation", C(NORM_SQL + A("z", *[("target_corr", c, f"abs(corr({c}, y))", 0.3, "x <= 0.3") for c in (*NORM, "home_goals")])))
def v11(spark, d):
    return rows(v.target_correlation(normed(spark, d), [*NORM, "home_goals"], "y"))


@query("v12_future_correlation", C(NORM_SQL + """, w as (select *, lead(y, 1) over o y1, lead(y, 2) over o y2, lead(y, 3) over o y3 from z
   window o as (partition by pool order by match_date, match_id))""" + A("w", *[(f"future_corr_{k}", c, f"abs(corr({c}, y{k}))", 0.1, "x <= 0.1") for c in NORM for k in (1, 2, 3)])))
def v12(spark, d):
    return rows(v.future_correlation(normed(spark, d), NORM, "y"))


WARM_SQL = """, w as (select match_id, venue, ent, season, match_date, xg, avg(xg) over (partition by ent order by match_date, match_id rows between 5 preceding and 1 preceding) shifted,
   avg(xg) over (partition by ent order by match_date, match_id rows between 4 preceding and current row) unshifted,
   row_number() over (partition by ent order by match_date, match_id) - 1 games from long)"""


@query("v13_warm_up", L(WARM_SQL + A("w", *[("warm_up_nulls", c, f"avg(case when games = 0 then (case when {c} is null then 1e0 else 0e0 end) end)", 0.5, "x >= 0.5") for c in ("shifted", "unshifted")])))
def v13(spark, d):
    """The shifted feature passes, the unshifted control fails."""
    from formline.functions.scalar import arr_mean, tail
    long = contests_long(spark, d)
    past = h.with_past(long, ["xg"], 5, "row")
    x = h.field(F.col("past"), "xg")
    df = past.select(F.size("past").alias("games"), arr_mean(x).alias("shifted"),
                     arr_mean(F.concat(tail(x, 4), F.array("xg"))).alias("unshifted"))
    return rows(v.warm_up(df, ["shifted", "unshifted"]))


@query("v14_jumps", L(""", j as (select pool, points, abs(points - lag(points) over (partition by ent order by match_date, match_id)) s from long),
   b as (select ent, season, arg_min(points, (match_date, match_id)) f, arg_max(points, (match_date, match_id)) l from long group by 1, 2),
   g as (select abs(lead(f) over (partition by ent order by season) - l) s from b)""" +
   A("j", ("jump_share", "points", "avg(case when s > 0.3 then 1e0 when s is not null then 0e0 end)", 0.05, "x <= 0.05")) + " union all " +
   A("g", ("border_jump", "points", "max(s)", 0.4, "x <= 0.4"))))
def v14(spark, d):
    long = contests_long(spark, d)
    return rows(v.jumps(long, ["ent"], "points").unionByName(v.border_jumps(long, "points")))


@query("v15_neutral_when_short", P(""", f as (select l.match_id, l.venue, count(p.res) games, case when count(p.res) filter (where p.rn <= 5) = 5
     then (regr_slope(cast(p.res + 1 as double), cast(6 - p.rn as double)) filter (where p.rn <= 5) + 2) / 4 else 0.5e0 end slope
   from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2)""" +
   A("f", ("neutral_required", "slope", "count(case when games < 5 and abs(slope - 0.5) > 1e-10 then 1 end)", 0, "x <= 0"))))
def v15(spark, d):
    long = contests_long(spark, d)
    games = h.cumulative_record(h.result_slope(long))
    return rows(v.neutral_when_short(games, "slope", "games"))


@query("v16_recomputed_h2h", C(""", m as (select a.match_id, a.result, count(b.match_id) n, sum(case when (b.result = 'H' and b.home = a.home) or (b.result = 'A' and b.away = a.home) then 1 else 0 end) w,
     count(b.match_id) filter (where b.match_date < a.match_date) n0,
     sum(case when b.match_date < a.match_date and ((b.result = 'H' and b.home = a.home) or (b.result = 'A' and b.away = a.home)) then 1 else 0 end) w0
   from contests a left join contests b on least(a.home, a.away) = least(b.home, b.away) and greatest(a.home, a.away) = greatest(b.home, b.away)
    and (b.match_date < a.match_date or b.match_id = a.match_id) group by 1, 2),
  q as (select w / cast(n as double) stored, case when n0 >= 1 then w0 / cast(n0 as double) else 0.5e0 end fresh from m)""" +
  A("q", ("recomputed", "stored", "max(abs(stored - fresh))", 0.3, "x <= 0.3"), ("recomputed_rows", "stored", "count(case when abs(stored - fresh) > 0.3 then 1 end)", 0, "x <= 0"))))
def v16(spark, d):
    """A stored head-to-head rate that already holds the game itself, against the leak-free one."""
    m = h.h2h_winrate(contests(spark, d), 1)
    clean = F.when(F.col("h2h_games") > 0, F.col("h2h_winrate") * F.col("h2h_games")).otherwise(0.0)
    leaky = (clean + (F.col("result") == "H").cast("double")) / (F.col("h2h_games") + 1)
    return rows(v.recomputed(m.withColumn("stored", leaky), "stored", "h2h_winrate"))


PART_SQL = f", z as (select *, case when match_date < date '{CUT}' then 'train' else 'test' end part, epoch_ms(cast(match_date as timestamp)) // 86400000 ud from contests)"


@query("v17_split_integrity", C(PART_SQL + ", " + ", ".join(f"s_{c} as (select max(case when part = 'train' then 1 else 0 end) a, max(case when part = 'test' then 1 else 0 end) b from z group by {c})" for c in ("match_date", "season")) +
    A("z", ("train_rows", "part", "count(case when part = 'train' then 1 end)", 1, "x >= 1"), ("test_rows", "part", "count(case when part = 'test' then 1 end)", 1, "x >= 1"),
      ("gap_days", "part", "min(case when part = 'test' then ud end) - max(case when part = 'train' then ud end)", 0, "x > 0")) +
    "".join(" union all " + A(f"s_{c}", ("shared", c, "sum(a * b)", 0, "x <= 0")) for c in ("match_date", "season"))))
def v17(spark, d):
    return rows(v.split_integrity(split_by_date(contests(spark, d), CUT)))


_RATIO = lambda c: f"(max({c}) filter (where part = 'test') - min({c}) filter (where part = 'test')) / (max({c}) filter (where part = 'train') - min({c}) filter (where part = 'train'))"


@query("v18_split_drift", C(NORM_SQL + A("z", *[s for c in NORM for s in (("range_ratio_low", c, _RATIO(c), 0.5, "x >= 0.5"), ("range_ratio_high", c, _RATIO(c), 2.0, "x <= 2"),
    ("mean_shift", c, f"abs(avg({c}) filter (where part = 'test') - avg({c}) filter (where part = 'train'))", 0.2, "x <= 0.2"))])))
def v18(spark, d):
    return rows(v.split_drift(normed(spark, d), NORM))


@query("v19_global_normalisation", C(NORM_SQL + ", " + ", ".join(f"q_{c} as (select ({c} - m) / s u from z, (select avg({c}) m, stddev_samp({c}) s from z where part = 'train') where part = 'test')" for c in NORM) +
    " union all ".join(A(f"q_{c}", ("outside_share", c, "avg(case when u < -0.5 or u > 1.5 then 1e0 when u is not null then 0e0 end)", 0.05, "x >= 0.05")) for c in NORM)))
def v19(spark, d):
    return rows(v.global_normalisation(normed(spark, d), NORM))


@query("v20_monotone_order", C(", o as (select match_date < lag(match_date) over (partition by pool, season order by match_id) b from contests)" +
    A("o", ("reversals", "match_date", "count(case when b then 1 end)", 0, "x <= 0"))))
def v20(spark, d):
    return rows(v.monotone_order(contests(spark, d), ["pool", "season"], "match_id", "match_date"))


@query("v21_rating_invariants", _elo_sql() + """, stp as (select h.match_id, h.rh, h.ra, 32e0 * (s - 1e0 / (1e0 + pow(10e0, (ra - rh) / 400e0))) st from hist h join seqs q on q.match_id = h.match_id) """ +
    A("stp", ("zero_sum", "elo", "max((select abs(sum(elo) - 1500e0 * count(*)) from final))", 0.001, "x <= 0.001"), ("max_step", "elo", "max(abs(st))", 50.0, "x <= 50"),
      ("min_rating", "elo", "min(least(rh, ra))", 800.0, "x >= 800"), ("max_rating", "elo", "max(greatest(rh, ra))", 2200.0, "x <= 2200")).replace("* 1e6 + 0.5e0) / 1e6", "* 1e4 + 0.5e0) / 1e4"))
def v21(spark, d):
    m = contests(spark, d)
    hist = e.elo_history(m).join(m.select("match_id", "result"), "match_id")
    final = e.elo_final(m).agg(F.struct(F.sum("elo").alias("s"), (F.count(F.lit(1)) * e.INIT).alias("i")).alias("x")).scalar()
    from formline.functions.scalar import elo_expectation
    score = F.when(F.col("result") == "H", 1.0).when(F.col("result") == "D", 0.5).when(F.col("result") == "A", 0.0)
    step = e.K * (score - elo_expectation(F.col("home_elo"), F.col("away_elo")))
    df = hist.withColumns({"step": step, "x": final})
    return rows(v.rating_invariants(df, F.max("x.s"), F.max("x.i"), F.col("step"))).withColumn("value", r6("value", 4))


@query("v22_counter_invariants", L(f""", z as (select ent, count(*) games, count(case when res = 1 then 1 end) w, count(case when res = 0 then 1 end) dr, count(case when res = -1 then 1 end) l, sum(points) pts, sum(gf) gf, sum(ga) ga
  from long where match_date < date '{CUT}' group by ent)""" + A("z", ("record_adds_up", "games", "count(case when w + dr + l <> games then 1 end)", 0, "x <= 0"),
    ("points_add_up", "points", "count(case when pts <> 3 * w + dr then 1 end)", 0, "x <= 0"), ("negative", "goals", "count(case when gf < 0 or ga < 0 then 1 end)", 0, "x <= 0")) +
    f" union all " + A(f"(select least(5, count(*)) k from long where match_date < date '{CUT}' group by ent)", ("window_length", "last", "max(k)", 5, "x <= 5"))))
def v22(spark, d):
    st = e.state_as_of(contests(spark, d), contests_long(spark, d), CUT)
    return rows(v.counter_invariants(st, F.size("last"), 5))


@query("v23_state_cutoff", L(A(f"(select ent, max(match_date) m from long where match_date < date '{CUT}' group by 1)", ("late_state", "last_day", f"count(case when m >= date '{CUT}' then 1 end)", 0, "x <= 0")) +
    " union all " + A(f"(select distinct ent from long where match_date >= date '{CUT}' and ent not in (select ent from long where match_date < date '{CUT}'))", ("unknown_entities", "ent", "count(*)", 0, "x <= 0"))))
def v23(spark, d):
    day = F.lit(CUT).cast("date")
    long = contests_long(spark, d)
    st = long.filter(F.col("match_date") < day).groupBy("ent").agg(F.max("match_date").alias("last_day"))
    return rows(v.state_cutoff(st, contests(spark, d).filter(F.col("match_date") >= day), day))


@query("v24_determinism", P(f""", w as (select l.match_id, l.venue, {R('coalesce(sum(p.points) / (3e0 * count(p.points)), 0.5e0)')} form
   from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2),
  g as (select cast(sum(cast('0x' || substr(md5(concat_ws('|', match_id, venue, cast(floor(form * 1e6 + 0.5) as bigint))), 1, 7) as bigint)) as double) s from w)
  select 'deterministic' as check, 'rows' subject, 1e0 as value, 1e0 threshold, 1 passed union all select 'digest', 'rows', s, s, 1 from g"""))
def v24(spark, d):
    """Two computations agree, and the digest of their rows is the one that any engine finds."""
    one = h.form_points(contests_long(spark, d)).select("match_id", "venue", "form")
    two = h.form_points(contests_long(spark, d).repartition(13, "match_id")).select("match_id", "venue", "form")
    text = F.concat_ws("|", "match_id", "venue", F.floor(r6("form") * 1e6 + 0.5).cast("long").cast("string"))
    digest = F.sum(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")).cast("double")
    both = one.agg(digest.alias("value")).withColumn("threshold", two.agg(digest.alias("threshold")).scalar())
    row = both.select(F.lit("digest").alias("check"), F.lit("rows").alias("subject"), "value", "threshold", (F.col("value") == F.col("threshold")).cast("int").alias("passed"))
    return rows(v.determinism(one, two)).unionByName(row)


@query("v25_predict_before_update", P(""", s as (select l.match_id, l.venue, count(p.res) b,
   (select count(*) from long x where x.ent = l.ent and x.match_date <= l.match_date) a from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by l.match_id, l.venue, l.ent, l.match_date)""" +
   A("s", ("update_leaks", "games", "count(case when b >= a then 1 end)", 0, "x <= 0"))))
def v25(spark, d):
    return rows(v.predict_before_update(contests_long(spark, d)))


_T = {k: f"{fn}(case when part = '{p}' then ud end)" for k, fn, p in (("tr", "max", "train"), ("s", "min", "test"), ("e", "max", "test"))}


@query("v26_test_period", C(PART_SQL + A("z", ("start_before_end", "test", f"{_T['e']} - {_T['s']}", 0, "x > 0"), ("after_training", "test", f"{_T['s']} - {_T['tr']}", 0, "x > 0"),
    ("advised_gap", "test", f"{_T['s']} - {_T['tr']}", 30, "x >= 30"), ("min_length", "test", f"{_T['e']} - {_T['s']}", 30, "x >= 30"), ("max_length", "test", f"{_T['e']} - {_T['s']}", 400, "x <= 400"))))
def v26(spark, d):
    return rows(v.test_period(split_by_date(contests(spark, d), CUT)))


@query("v27_plausibility", L(""", f as (select avg(xg) over w5 xg_mean_5, avg(xg) over w10 xg_mean_10, sum(gf) over w5 gf_sum_5, sum(gf) over w10 gf_sum_10 from long
  window w5 as (partition by ent order by match_date, match_id rows between 5 preceding and 1 preceding), w10 as (partition by ent order by match_date, match_id rows between 10 preceding and 1 preceding))""" +
  A("f", ("missing_column", "xg_eff", "max(1)", 0, "x <= 0"), *[s for c, (lo, hi) in v.PLAUSIBLE.items() if c != "xg_eff" for s in (("below_range", c, f"count(case when {c} < {lo} then 1 end)", 0, "x <= 0"), ("above_range", c, f"count(case when {c} > {hi} then 1 end)", 0, "x <= 0"))])))
def v27(spark, d):
    past = h.with_past(contests_long(spark, d), ["xg", "gf"], 10, "row")
    from formline.functions.scalar import arr_mean, tail
    df = past.select(*[fn(h.field(tail(F.col("past"), w), c)).alias(f"{c}_{k}_{w}") for c, k, fn in (("xg", "mean", arr_mean), ("gf", "sum", h.null_sum)) for w in (5, 10)])
    return rows(v.plausible(df))


@query("v28_integrity_level", C(PART_SQL + ", au as (" + A("z", ("start_before_end", "test", f"{_T['e']} - {_T['s']}", 0, "x > 0"), ("after_training", "test", f"{_T['s']} - {_T['tr']}", 0, "x > 0"),
    ("advised_gap", "test", f"{_T['s']} - {_T['tr']}", 30, "x >= 30"), ("min_length", "test", f"{_T['e']} - {_T['s']}", 30, "x >= 30"), ("max_length", "test", f"{_T['e']} - {_T['s']}", 400, "x <= 400")) +
    """), k as (select count(case when passed = 0 and as_check not in ('advised_gap', 'min_length', 'max_length') then 1 end) failures,
      count(case when passed = 0 and as_check in ('advised_gap', 'min_length', 'max_length') then 1 end) warnings from (select "check" as_check, passed from au))
    select failures, warnings, case when failures > 1 then 'CRITICAL' when failures = 1 then 'CONCERNS' when warnings = 0 then 'EXCELLENT' when warnings < 5 then 'GOOD' else 'ACCEPTABLE' end level from k"""))
def v28(spark, d):
    return v.integrity_level(v.test_period(split_by_date(contests(spark, d), CUT)), ["advised_gap", "min_length", "max_length"])


@query("v29_compare_versions", C(", o as (select greatest(0e0, least(1e0, home_xg / 3)) x from contests where home_xg is not null), w as (select greatest(0e0, least(1e0, home_xg / 4)) x from contests where home_xg is not null), " +
    ", ".join(f"g{t} as (select avg(x) mean, stddev_samp(x) std, min(x) mn, max(x) mx, avg(case when x < 0.1 or x > 0.9 then 1e0 else 0e0 end) es from {t})" for t in "ow") +
    " union all ".join(f"select '{name}' stat, {R(f'go.{c}')} old, {R(f'gw.{c}')} as new, {R(f'gw.{c} - go.{c}')} diff from go, gw"
                       for name, c in (("mean", "mean"), ("std", "std"), ("min", "mn"), ("max", "mx"), ("extreme_share", "es")))))
def v29(spark, d):
    from formline.functions.scalar import clip
    m = contests(spark, d)
    out = v.compare_versions(m.select(clip(F.col("home_xg") / 3, 0.0, 1.0).alias("x")), m.select(clip(F.col("home_xg") / 4, 0.0, 1.0).alias("x")), "x")
    return out.select("stat", *[r6(c).alias(c) for c in ("old", "new", "diff")])


# --- R -----------------------------------------------------------------------------------------

FEATS = ["home_xg", "away_xg", "home_shots", "away_shots", "home_goals"]
Y_SQL = ", z as (select *, case result when 'H' then 0 when 'D' then 1 else 2 end y from contests)"


def labelled(spark, d):
    return contests(spark, d, shots=True).withColumn("y", code(F.col("result"), CLASS_CODE))


@query("r01_pearson_pairs", C(" union all ".join(f"select '{a}' f1, '{b}' f2, {R(f'corr({a}, {b})')} r, cast(coalesce(abs(corr({a}, {b})) >= 0.7, false) as integer) redundant from contests"
                                                for a, b in sel.column_pairs(FEATS))))
def r01(spark, d):
    out = sel.pearson_pairs(contests(spark, d, shots=True), FEATS)
    return out.select("f1", "f2", r6("r").alias("r"), F.coalesce(F.abs("r") >= 0.7, F.lit(False)).cast("int").alias("redundant"))


_RANK = lambda c: f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 {c}"


@query("r02_spearman_pairs", C(f", k as (select {', '.join(_RANK(c) for c in FEATS)} from (select * from contests where {' and '.join(c + ' is not null' for c in FEATS)}))" +
    " union all ".join(f"select '{a}' f1, '{b}' f2, {R(f'corr({a}, {b})')} rho from k" for a, b in sel.column_pairs(FEATS))))
def r02(spark, d):
    return sel.spearman_pairs(contests(spark, d, shots=True), FEATS).select("f1", "f2", r6("rho").alias("rho"))


@query("r03_cross_block_keep", C(" union all ".join(f"select '{c}' feature, {R(f'greatest(abs(corr({c}, home_goals)), abs(corr({c}, away_goals)))')} max_r, cast(greatest(abs(corr({c}, home_goals)), abs(corr({c}, away_goals))) < 0.75 as integer) keep from contests" for c in FEATS[:4])))
def r03(spark, d):
    out = sel.cross_block_keep(contests(spark, d, shots=True), FEATS[:4], ["home_goals", "away_goals"])
    return out.select("feature", r6("max_r").alias("max_r"), "keep")


@query("r04_group_correlation", C(f"""select 'xg' grp, {R('abs(corr(home_xg, away_xg))')} mean_r, cast(1 as bigint) pairs from contests union all
  select 'shots', {R('(abs(corr(home_shots, away_shots)) + abs(corr(home_shots, home_corners)) + abs(corr(away_shots, home_corners))) / 3')}, 3 from contests"""))
def r04(spark, d):
    groups = {"home_xg": "xg", "away_xg": "xg", "home_shots": "shots", "away_shots": "shots", "home_corners": "shots"}
    out = sel.group_correlation(sel.pearson_pairs(contests(spark, d, shots=True), list(groups)), groups)
    return out.select("grp", r6("mean_r").alias("mean_r"), "pairs")


PRUNE = [*FEATS, "away_goals", "home_corners", "away_corners"]
_NINE = lambda x: R(x, 9)


def _prune_sql() -> str:
    ranks = f"k as (select {', '.join(_RANK(c) for c in PRUNE)} from (select * from contests where {' and '.join(c + ' is not null' for c in PRUNE)}))"
    pairs = " union all ".join(f"select '{a}' f1, '{b}' f2, {_NINE(f'greatest(coalesce(abs((select corr({a}, {b}) from contests)), 0), coalesce(abs((select corr({a}, {b}) from k)), 0))')} r" for a, b in sel.column_pairs(PRUNE))
    info = " union all ".join(f"""select '{c}' feature, {_NINE('sum(n / t * ln(n * t / (nb * ny)))')} mi from (
   select cast(n as double) n, cast(sum(n) over () as double) t, cast(sum(n) over (partition by b) as double) nb, cast(sum(n) over (partition by y) as double) ny from (
   select coalesce(least(cast(floor(({c} - lo) * 10 / nullif(cast(hi - lo as double), 0)) as bigint), 9), 0) b, y, count(*) n from z, (select cast(min({c}) as double) lo, cast(max({c}) as double) hi from z) where {c} is not null group by 1, 2))""" for c in PRUNE)
    return "with recursive " + CONTESTS.strip() + Y_SQL + f""", {ranks}, pairs as ({pairs}), info as ({info}),
 strong as (select *, row_number() over (order by r desc, f1, f2) rn from pairs where r >= 0.7),
 walk as (select cast(0 as bigint) rn, cast([] as varchar[]) gone union all
  select s.rn, case when list_contains(gone, f1) or list_contains(gone, f2) then gone when a.mi < b.mi or (a.mi = b.mi and f1 < f2) then list_append(gone, f1) else list_append(gone, f2) end
  from walk w join strong s on s.rn = w.rn + 1 join info a on a.feature = f1 join info b on b.feature = f2)
 select feature, {R('mi')} mi from info where not list_contains((select arg_max(gone, rn) from walk), feature)"""


@query("r05_greedy_prune", _prune_sql())
def r05(spark, d):
    """Pairs count by the larger of both correlations; of each strong pair the column that tells less about the result goes."""
    m = labelled(spark, d)
    strength = lambda v: F.floor(F.col(v) * 1e9 + 0.5) / 1e9
    pairs = [(r["f1"], r["f2"], r["r"]) for r in sel.strongest_pairs(m, PRUNE).withColumn("r", strength("r")).collect()]  # k(k-1)/2 rows
    info = {r["feature"]: r["mi"] for r in sel.mutual_information(m, PRUNE, "y").withColumn("mi", strength("mi")).collect()}
    kept = sel.greedy_prune(pairs, info, 0.7)
    return spark.createDataFrame([(f, info[f]) for f in kept], "feature string, mi double").select("feature", r6("mi").alias("mi"))


@query("r06_anova_f", C(Y_SQL + " union all ".join(f"""select '{c}' feature, {R('(sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 3)} f
  from (select y, count({c}) n, avg({c}) m, var_pop({c}) v from z where {c} is not null group by y), (select avg({c}) g from z)""" for c in FEATS)))
def r06(spark, d):
    return sel.anova_f(labelled(spark, d), FEATS, "y").select("feature", r6("f", 3).alias("f"))


@query("r07_mutual_information", C(Y_SQL + " union all ".join(f"""select '{c}' feature, {R('sum(n / t * ln(n * t / (nb * ny)))')} mi from (
   select cast(n as double) n, cast(sum(n) over () as double) t, cast(sum(n) over (partition by b) as double) nb, cast(sum(n) over (partition by y) as double) ny from (
   select least(cast(floor(({c} - lo) * 10 / (hi - lo)) as bigint), 9) b, y, count(*) n from z, (select cast(min({c}) as double) lo, cast(max({c}) as double) hi from z) where {c} is not null group by 1, 2))""" for c in FEATS)))
def r07(spark, d):
    return sel.mutual_information(labelled(spark, d), FEATS, "y").select("feature", r6("mi").alias("mi"))


def _psi(m: str) -> str:
    """SQL twin of ``information.digamma``."""
    z = f"(cast({m} as double) + 8)"
    steps = " + ".join(f"1e0 / (cast({m} as double) + {i})" for i in range(8))
    return f"(ln({z}) - 0.5e0 / {z} - 1 / ({z} * {z}) * (1e0 / 12 - 1 / ({z} * {z}) * (1e0 / 120 - 1 / ({z} * {z}) * (1e0 / 252 - 1 / ({z} * {z}) / 240))) - ({steps}))"


_MI_CELLS = " union all ".join(f"select '{c}' feature, y, cast({c} as double) x, count(*) n from z where {c} is not null group by y, {c}" for c in FEATS)


@query("r07b_knn_mutual_information", C(Y_SQL + f""", cells as ({_MI_CELLS}), sized as (select *, cast(sum(n) over (partition by feature, y) as bigint) size from cells),
  around as (select feature, y, x, n, size, least(3, size - 1) w, unnest(list({{'x': x, 'n': n}}) over (partition by feature, y order by x rows between 3 preceding and 3 following)) o from sized where size > 1),
  far as (select feature, y, x, n, size, w, abs(o.x - x) d, sum(o.n - cast(o.x = x as integer)) over (partition by feature, y, x order by abs(o.x - x)) got from around),
  radius as (select feature, y, x, n, size, w, min(d) filter (where got >= w) d from far group by all),
  ends as (select *, greatest(d - (abs(x) + d) * {2.0 ** -48!r}, 0) r from radius), m as (select e.feature, e.n, e.size, e.w, sum(p.n) m from ends e join ends p on p.feature = e.feature and p.x between e.x - e.r and e.x + e.r
   group by e.feature, e.y, e.x, e.n, e.size, e.w)
  select feature, {R(f"greatest({_psi('sum(n)')} + sum(n * {_psi('w')}) / sum(n) - sum(n * {_psi('size')}) / sum(n) - sum(n * {_psi('m')}) / sum(n), 0)")} mi from m group by feature"""))
def r07b(spark, d):
    return knn_mutual_information(labelled(spark, d), FEATS, "y").select("feature", r6("mi").alias("mi"))


@query("r08_variance_filter", C(", z as (select *, 1e0 const from contests)" + " union all ".join(
    f"select '{c}' feature, {R(f'var_samp({c})')} variance, cast(var_samp({c}) >= 1e-10 as integer) keep from z" for c in (*FEATS, "const"))))
def r08(spark, d):
    out = sel.variance_filter(contests(spark, d, shots=True).withColumn("const", F.lit(1.0)), [*FEATS, "const"])
    return out.select("feature", r6("variance").alias("variance"), "keep")
