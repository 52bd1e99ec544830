"""F, N and K families: row expressions, normalisers, market features."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions import market as mk
from formline.functions import scalar as s
from formline.operators import history as h
from formline.operators import normalise as n
from formline.operators.joins import join_dimension, join_weather, pair_difference_stats
from formline.operators.shape import row_ffill
from formline.plans.base_sql import C, L, P
from formline.plans.q_tables import weather_tables
from formline.plans.registry import R, query, r6
from formline.sources.contests import contests, contests_long, table

ID = "match_id"


def _out(df, cols: dict, key=ID):
    return df.select(key, *[(r6(v) if k[0] != "=" else v).alias(k.lstrip("=")) for k, v in cols.items()])


# --- F -----------------------------------------------------------------------------------------

@query("f01_label_codes", C("""select match_id, case result when 'H' then 0 when 'D' then 1 else 2 end code, case result when 'H' then 1 when 'D' then 0 else -1 end signed,
  case result when 'H' then 2 when 'D' then 1 else 0 end val, case when home_goals > away_goals then 3 when home_goals = away_goals then 1 else 0 end points from contests"""))
def f01(spark, d):
    r = F.col("result")
    return contests(spark, d).select(ID, s.code(r, s.CLASS_CODE).alias("code"), s.code(r, s.SIGNED_CODE).alias("signed"),
                                     s.code(r, s.VALUE_CODE).alias("val"), s.points(F.col("home_goals"), F.col("away_goals")).alias("points"))


@query("f02_outcome_from_score", C("""select match_id, case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end outcome,
  cast(result = case when home_goals > away_goals then 'H' when home_goals < away_goals then 'A' else 'D' end as integer) consistent from contests"""))
def f02(spark, d):
    o = s.outcome(F.col("home_goals"), F.col("away_goals"))
    return contests(spark, d).select(ID, o.alias("outcome"), (o == F.col("result")).cast("int").alias("consistent"))


@query("f03_goal_difference", C("select match_id, home_goals - away_goals goal_diff, home_goals + away_goals goals from contests"))
def f03(spark, d):
    a, b = F.col("home_goals"), F.col("away_goals")
    return contests(spark, d).select(ID, (a - b).alias("goal_diff"), (a + b).alias("goals"))


@query("f04_date_parse", """select o_orderkey match_id, strftime(o_orderdate, '%Y-%m-%d') from_slash, strftime(o_orderdate, '%Y-%m-%d') from_iso,
  cast(null as varchar) from_junk from orders""")
def f04(spark, d):
    o = table(spark, d, "orders")
    slash = s.parse_date(F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy")
    iso = s.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias(ID), slash.cast("string").alias("from_slash"), iso.cast("string").alias("from_iso"),
                    s.parse_date(F.col("o_orderpriority")).cast("string").alias("from_junk"))


@query("f05_season_label", C("select match_id, season || '-' || (season + 1) label from contests"))
def f05(spark, d):
    return contests(spark, d).select(ID, s.season_label(F.col("match_date")).alias("label"))


@query("f06_date_parts", C("""select match_id, cast(month(match_date) as integer) as month, cast(isodow(match_date) - 1 as integer) as weekday,
  cast(isodow(match_date) >= 6 as integer) weekend, cast(year(match_date) as integer) as year, strftime(match_date, '%Y-%m') year_month,
  cast(month(match_date) in (12, 1) as integer) winter from contests"""))
def f06(spark, d):
    t = F.col("match_date")
    return contests(spark, d).select(ID, F.month(t).alias("month"), F.weekday(t).alias("weekday"), (F.weekday(t) >= 5).cast("int").alias("weekend"),
                                     F.year(t).alias("year"), F.date_format(t, "yyyy-MM").alias("year_month"), F.month(t).isin(12, 1).cast("int").alias("winter"))


@query("f07_cyclic_month", C(f"select match_id, {R('sin(2 * pi() * month(match_date) / 12)')} month_sin, {R('cos(2 * pi() * month(match_date) / 12)')} month_cos from contests"))
def f07(spark, d):
    a, b = s.cyclic(F.month("match_date"), 12)
    return _out(contests(spark, d), {"month_sin": a, "month_cos": b})


@query("f08_season_period", C("""select match_id, case when w <= 12 then 0e0 when w <= 26 then 0.5e0 else 1e0 end period
  from (select match_id, dense_rank() over (partition by pool, season order by match_date) w from contests)"""))
def f08(spark, d):
    return h.match_week(contests(spark, d)).select(ID, s.season_period(F.col("week")).alias("period"))


@query("f09_clip", C(f"select match_id, {R('case when home_xg is not null then greatest(0.5e0, least(2.5e0, home_xg)) end')} xg from contests"))
def f09(spark, d):
    return _out(contests(spark, d), {"xg": s.clip(F.col("home_xg"), 0.5, 2.5)})


@query("f10_safe_ratio", C(f"""select match_id, {R('home_goals / nullif(cast(away_goals as double), 0)')} ratio,
  {R('coalesce(home_goals / nullif(cast(away_goals as double), 0), 0.5e0)')} ratio_filled from contests"""))
def f10(spark, d):
    a, b = F.col("home_goals"), F.col("away_goals")
    return _out(contests(spark, d), {"ratio": s.ratio(a, b), "ratio_filled": s.ratio(a, b, 0.5)})


@query("f11_logistic", C(f"""select match_id, {R('1 / (1 + exp(-(home_xg - away_xg)))')} logit,
  {R('1 / (1 + pow(10e0, (away_goals * 50 - home_goals * 50) / 400e0))')} elo_e from contests"""))
def f11(spark, d):
    return _out(contests(spark, d), {"logit": s.logistic(F.col("home_xg") - F.col("away_xg")),
                                     "elo_e": s.elo_expectation(F.col("home_goals") * 50, F.col("away_goals") * 50)})


@query("f12_match_key", C("select match_id, strftime(match_date, '%Y-%m-%d') || '_' || home || '_' || away as key from contests"))
def f12(spark, d):
    return contests(spark, d).select(ID, s.match_key(F.col("match_date"), F.col("home"), F.col("away")).alias("key"))


@query("f13_name_normalisation", "select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 'AUTO' when 'HOUSEHOLD' then 'HOME' else c_mktsegment end segment from customer")
def f13(spark, d):
    names = spark.createDataFrame([("AUTOMOBILE", "AUTO"), ("HOUSEHOLD", "HOME")], "raw string, norm string")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return join_dimension(c, names, "segment", "raw", "norm").select("c_custkey", "segment")


@query("f14_xg_derivations", C(f"""select match_id, {R('case when home_xg > 0 then home_goals / home_xg else 0 end')} home_eff,
  {R('case when away_xg > 0 then away_goals / away_xg else 0 end')} away_eff, {R('home_xg - away_xg')} xg_diff, {R('home_xg + away_xg')} xg_total from contests"""))
def f14(spark, d):
    eff = lambda side: F.when(F.col(f"{side}_xg") > 0, F.col(f"{side}_goals") / F.col(f"{side}_xg")).otherwise(0.0)
    a, b = F.col("home_xg"), F.col("away_xg")
    return _out(contests(spark, d), {"home_eff": eff("home"), "away_eff": eff("away"), "xg_diff": a - b, "xg_total": a + b})


FORM_SQL = """, wk as (select match_id, dense_rank() over (partition by pool, season order by match_date) w from contests),
 f as (select l.match_id, l.venue, coalesce(sum(p.points) / (3e0 * count(p.points)), 0.5e0) form from long l
   left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2),
 sd as (select match_id, home_shots - away_shots sd, home_corners - away_corners cd from contests),
 mx as (select max(abs(sd)) ms, max(abs(cd)) mc from sd),
 base as (select h.match_id, (h.form - a.form + 1) / 2 form, (sd / ms + 1) / 2 shots, (cast(cd as double) / mc + 1) / 2 corners, (w - 1) / 37e0 md,
   case when w <= 12 then 0e0 when w <= 26 then 0.5e0 else 1e0 end period
   from f h join f a on a.match_id = h.match_id and h.venue = 'H' and a.venue = 'A'
   join wk on wk.match_id = h.match_id join sd on sd.match_id = h.match_id, mx)"""


def _form_base(spark, d):
    """form, shots and corners differences in [0, 1], match-day share and season period per contest."""
    m = contests(spark, d, shots=True)
    form = h.form_points(contests_long(spark, d)).groupBy(ID).agg(
        F.max(F.when(F.col("venue") == "H", F.col("form"))).alias("hf"), F.max(F.when(F.col("venue") == "A", F.col("form"))).alias("af"))
    m = m.withColumns({"sd": F.col("home_shots") - F.col("away_shots"), "cd": F.col("home_corners") - F.col("away_corners")})
    m = n.symmetric(m, n.fit(m, ["sd", "cd"]), ["sd", "cd"])
    m = h.match_week(m).join(form, ID)
    return m.select(ID, ((F.col("hf") - F.col("af") + 1) / 2).alias("form"), F.col("sd_norm").alias("shots"), F.col("cd_norm").alias("corners"),
                    F.col("week_normalized").alias("md"), s.season_period(F.col("week")).alias("period"))


@query("f15_interactions", P(FORM_SQL + f""" select match_id, {R('shots * form')} strength_form, {R('shots * corners')} shots_corners,
  {R('form * (0.5e0 + 0.5e0 * md)')} form_late, {R('form * period')} form_period, {R('0.6e0 * shots + 0.4e0 * form')} blend from base"""))
def f15(spark, d):
    c = {k: F.col(k) for k in ("form", "shots", "corners", "md", "period")}
    return _out(_form_base(spark, d), {
        "strength_form": c["shots"] * c["form"], "shots_corners": c["shots"] * c["corners"],
        "form_late": c["form"] * (0.5 + 0.5 * c["md"]), "form_period": c["form"] * c["period"], "blend": 0.6 * c["shots"] + 0.4 * c["form"]})


@query("f16_market_interactions", P(FORM_SQL + f"""select match_id, {R('form * (1 - shots)')} elo_efficiency, {R('form * corners')} form_sharp,
  {R('shots * corners')} line_h2h, {R('corners * (0.5e0 - abs(form - 0.5e0))')} velocity_balance, {R('form * (home_xg - away_xg)')} form_xg from base join contests using (match_id)"""))
def f16(spark, d):
    m = _form_base(spark, d).join(contests(spark, d).select(ID, (F.col("home_xg") - F.col("away_xg")).alias("xgd")), ID)
    f, sh, co = F.col("form"), F.col("shots"), F.col("corners")
    return _out(m, {"elo_efficiency": f * (1 - sh), "form_sharp": f * co, "line_h2h": sh * co,
                    "velocity_balance": co * (0.5 - F.abs(f - 0.5)), "form_xg": f * F.col("xgd")})


@query("f17_home_boost", P(FORM_SQL + f""" select match_id, {R('greatest(0e0, least(1e0, form + 0.05e0))')} boosted, {R('shots * (0.5e0 + 0.5e0 * md)')} progress from base"""))
def f17(spark, d):
    return _out(_form_base(spark, d), {"boosted": s.clip(F.col("form") + 0.05, 0.0, 1.0), "progress": F.col("shots") * (0.5 + 0.5 * F.col("md"))})


WEATHER_SQL = f""", rdg as (select s_nationkey place, cast(l_shipdate as date) match_date, avg(l_quantity) t,
    {R('avg(l_discount) * 10')} p, {R('avg(l_tax) * 100')} w from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
  wx as (select match_id, coalesce(t, 15e0) t, coalesce(p, 0e0) p, coalesce(w, 10e0) w from contests c
    left join rdg r on r.place = c.pool and r.match_date = c.match_date)"""


@query("f18_weather", C(WEATHER_SQL + f""" select match_id, cast(t < 5 or t > 25 as integer) extreme, cast(p > 0.5e0 or w > 15 as integer) adverse,
  {R('greatest(0e0, least(1e0, 1 - abs(t - 15) / 20 - p / 10 - w / 30))')} comfort from wx"""))
def f18(spark, d):
    m = join_weather(contests(spark, d), *weather_tables(spark, d), "pool")
    t, p, w = F.col("temperature"), F.col("precipitation"), F.col("wind_speed")
    return m.select(ID, s.extreme_weather(t).alias("extreme"), s.adverse_weather(p, w).alias("adverse"), r6(s.weather_comfort(t, p, w)).alias("comfort"))


REST_SQL = """, g as (select l.match_id, l.venue, coalesce(min(l.match_date - p.bdate), 7) rest,
    count(case when p.bdate >= l.match_date - interval 14 day then 1 end) d14, count(case when p.bdate >= l.match_date - interval 30 day then 1 end) d30
    from long l left join past p on p.match_id = l.match_id and p.venue = l.venue group by 1, 2)"""


@query("f19_rest_and_fatigue", P(REST_SQL + f""" select h.match_id, cast(h.rest - a.rest as integer) rest_advantage,
  {R('h.d14 - a.d14 + 0.5e0 * (h.d30 - a.d30)')} congestion,
  {R('greatest(0e0, least(1e0, 1 / (1 + exp(-(cast(h.rest - a.rest as double) - 2))) - 0.1e0 * (h.d14 - a.d14 + 0.5e0 * (h.d30 - a.d30))))')} fatigue
  from g h join g a on a.match_id = h.match_id and h.venue = 'H' and a.venue = 'A'"""))
def f19(spark, d):
    from formline.plans.features import rest_features
    m = rest_features(contests(spark, d), contests_long(spark, d))
    return m.select(ID, "rest_advantage", r6("congestion").alias("congestion"), r6("fatigue").alias("fatigue"))


@query("f20_momentum_alignment", L(""", o as (select *, avg(cast(res as double)) over w3 p3, avg(cast(res as double)) over w5 p5 from long
    window w3 as (partition by ent order by match_date, match_id rows between 3 preceding and 1 preceding),
           w5 as (partition by ent order by match_date, match_id rows between 5 preceding and 1 preceding))
  select h.match_id, cast(coalesce(h.p3 * h.p5, 0) > 0 as integer) - cast(coalesce(a.p3 * a.p5, 0) > 0 as integer) alignment
  from o h join o a on a.match_id = h.match_id and h.venue = 'H' and a.venue = 'A'"""))
def f20(spark, d):
    from formline.operators.shape import to_wide
    long = h.rolling(contests_long(spark, d), ["res"], [3, 5])
    w = to_wide(long, ["res_mean_3", "res_mean_5"]).fillna(0.0)
    return w.select(ID, s.alignment(*[F.col(f"{side}_res_mean_{k}") for side in ("home", "away") for k in (3, 5)]).alias("alignment"))


@query("f21_high_stakes", C(f""", riv as (select least(home, away) lo, greatest(home, away) hi from contests group by 1, 2 having count(*) >= 6),
  p as (select *, match_date - min(match_date) over (partition by year(match_date)) dd from contests)
  select match_id, {R('greatest(0e0, least(1e0, 0.5e0 * (case when lo is null then 0 else 1 end) + 0.5e0 * least(1e0, dd / 200e0)))')} stakes
  from p left join riv on lo = least(home, away) and hi = greatest(home, away)"""))
def f21(spark, d):
    from formline.operators.shape import pair_flag
    m = contests(spark, d)
    often = m.groupBy(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).count().filter("count >= 6")
    m = pair_flag(h.season_elapsed(m), often, "home", "away", "rivalry")
    return _out(m, {"stakes": s.high_stakes(F.col("rivalry"), F.col("pressure"))})


@query("f22_referee_strictness", C(f""", ref as (select l_suppkey referee, count(*) / cast(count(distinct l_orderkey) as double) cards, avg(l_discount) pens from lineitem group by 1),
  asg as (select l_orderkey, min(l_suppkey) referee from lineitem group by 1)
  select match_id, {R('(cards / 6 + pens) / 2')} strictness from contests left join asg on l_orderkey = match_id left join ref using (referee)"""))
def f22(spark, d):
    lines = table(spark, d, "lineitem")
    ref = lines.groupBy(F.col("l_suppkey").alias("referee")).agg(
        (F.count(F.lit(1)) / F.countDistinct("l_orderkey")).alias("cards"), F.avg("l_discount").alias("pens"))
    assigned = lines.groupBy(F.col("l_orderkey").alias(ID)).agg(F.min("l_suppkey").alias("referee"))
    m = contests(spark, d).select(ID).join(assigned, ID, "left").join(ref, "referee", "left")
    return _out(m, {"strictness": s.strictness(F.col("cards"), F.col("pens"))})


@query("f23_rule_classifier", C("select match_id, case when home_xg - away_xg > 0.5e0 then 0 when home_xg - away_xg < -0.5e0 then 2 else 1 end pred from contests"))
def f23(spark, d):
    return contests(spark, d).select(ID, s.rule_class(F.col("home_xg") - F.col("away_xg")).alias("pred"))


@query("f24_performance_band", C(f""", a as (select pool, avg(case when result = 'H' then 1e0 else 0e0 end) + 0.15e0 acc from contests group by 1)
  select pool, {R('a.acc')} acc, case when a.acc > 0.55e0 then 'EXCELLENT' when a.acc > 0.5e0 then 'GOOD' when a.acc > 0.436e0 then 'ACCEPTABLE' else 'NEEDS_IMPROVEMENT' end band from a"""))
def f24(spark, d):
    m = contests(spark, d).groupBy("pool").agg((F.avg((F.col("result") == "H").cast("double")) + 0.15).alias("acc"))
    return m.select("pool", r6("acc").alias("acc"), s.band(F.col("acc")).alias("band"))


@query("f25_json_default", """select event_id, coalesce(cast(json_extract(props, '$.k') as double), 0e0) k,
  coalesce(cast(json_extract(props, '$.rain.h') as double), 0e0) rain, -(coalesce(cast(json_extract(props, '$.k') as double), 0e0) + 0.25e0) below,
  (coalesce(cast(json_extract(props, '$.k') as double), 0e0) + 0.5e0) * 1e13 large from events""")
def f25(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    return table(spark, d, "events").select("event_id", s.json_number(F.col("props"), "$.k", 0).alias("k"),
                                            s.json_number(F.col("props"), "$.rain.h", 0).alias("rain"),
                                            s.json_number(F.concat(F.lit('{"r":-'), k, F.lit(".25}")), "$.r", 0).alias("below"),
                                            s.json_number(F.concat(F.lit('{"r":'), k, F.lit(".5e13}")), "$.r", 0).alias("large"))


@query("f26_regex_capture", r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, 'href="([^"]*)"')) links,
  regexp_replace(regexp_replace('page_v2024_01_31_101500_' || page_id || '_2024_01_31.csv', '_v?\d{4}_\d{2}_\d{2}_\d{6}', '', 'g'), '_\d{4}_\d{2}_\d{2}', '', 'g') clean from pages""")
def f26(spark, d):
    name = F.concat(F.lit("page_v2024_01_31_101500_"), F.col("page_id").cast("string"), F.lit("_2024_01_31.csv"))
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), s.strip_version(name).alias("clean"))


@query("f27_hex_unescape", "select page_id, url, url mixed from pages")
def f27(spark, d):
    escaped = lambda text: F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", r"\\x$1")
    mixed = F.concat(F.substring("url", 1, 4), escaped(F.substring("url", 5, 3)), F.expr("substring(url, 8)"))
    return table(spark, d, "pages").select("page_id", s.unescape_hex(escaped(F.col("url"))).alias("url"), s.unescape_hex(mixed).alias("mixed"))


@query("f28_array_helpers", P(f"""select l.match_id, l.venue, {R('avg(p.gf)')} mean, {R('coalesce(sum(p.gf), 0)')} total, {R('stddev_pop(p.gf)')} std, count(p.gf) n
  from long l left join past p on p.match_id = l.match_id and p.venue = l.venue and p.rn <= 5 group by 1, 2"""))
def f28(spark, d):
    past = h.with_past(contests_long(spark, d), ["gf"], 5)
    g = h.field(F.col("past"), "gf")
    return past.select(ID, "venue", r6(s.arr_mean(g)).alias("mean"), r6(F.coalesce(s.arr_sum(g), F.lit(0.0))).alias("total"),
                       r6(s.arr_std(g)).alias("std"), F.greatest(F.size(g), F.lit(0)).cast("long").alias("n"))


@query("f29_md5_prefix", "select page_id, substr(md5(url), 1, 8) mark from pages")
def f29(spark, d):
    return table(spark, d, "pages").select("page_id", s.md5_prefix(F.col("url")).alias("mark"))


# --- N -----------------------------------------------------------------------------------------

BEFORE = "1999-01-01"
COLS = ["home_xg", "home_shots"]


def _fit_set(df):
    return df.filter(F.col("match_date") < F.lit(BEFORE).cast("date"))


def _n_sql(rule: str, stats: str, fit: str = "train") -> str:
    """``rule`` uses x and per-column stats; the same text is expanded for both columns."""
    one = lambda c: f"(select {stats.replace('{c}', c)} from {fit})"
    out = ", ".join(f"{R(rule.replace('x', f'c.{c}').replace('S.', f'{c}_s.'))} {c}_norm" for c in COLS)
    return C(f", train as (select * from contests where match_date < date '{BEFORE}') select match_id, {out} from contests c, " +
             ", ".join(f"{one(c)} {c}_s" for c in COLS))


def _norm(spark, d, fn):
    m = contests(spark, d, shots=True)
    return _out(fn(m, _fit_set(m)), {f"{c}_norm": F.col(f"{c}_norm") for c in COLS})


@query("n01_min_max", _n_sql("case when S.hi > S.lo then (x - S.lo) / (S.hi - S.lo) else 0.5e0 end", "min({c}) lo, cast(max({c}) as double) hi"))
def n01(spark, d):
    return _norm(spark, d, lambda m, f: n.min_max(m, n.fit(f, COLS), COLS))


@query("n02_max_scale", _n_sql("case when S.hi > 0 then x / S.hi else 0 end", "cast(max({c}) as double) hi"))
def n02(spark, d):
    return _norm(spark, d, lambda m, f: n.max_scale(m, n.fit(f, COLS), COLS))


@query("n03_fixed_range", C(f"""select match_id, {R('case when home_xg is not null then greatest(0e0, least(1e0, (home_xg - away_xg + 3) / 6)) end')} clipped,
  {R('(home_xg - away_xg + 3) / 6')} free from contests"""))
def n03(spark, d):
    x = F.col("home_xg") - F.col("away_xg")
    return _out(contests(spark, d), {"clipped": n.fixed_range(x, -3, 3), "free": n.fixed_range(x, -3, 3, False)})


@query("n04_symmetric", _n_sql("case when S.m > 0 then (x / S.m + 1) / 2 else 0.5e0 end", "cast(max(abs({c})) as double) m"))
def n04(spark, d):
    return _norm(spark, d, lambda m, f: n.symmetric(m, n.fit(f, COLS), COLS))


_Q = "quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b, stddev_samp({c}) sd, cast(min({c}) as double) lo, cast(max({c}) as double) hi"
_Z = lambda v: f"greatest(-2e0, least(2e0, ({v} - S.a) / (S.b - S.a)))"


@query("n05_iqr_robust", _n_sql(f"case when S.sd <= 1e-6 or S.b - S.a <= 1e-6 then 0.5e0 when x is not null then ({_Z('x')} - {_Z('S.lo')}) / ({_Z('S.hi')} - {_Z('S.lo')}) end", _Q))
def n05(spark, d):
    return _norm(spark, d, lambda m, f: n.iqr_robust(m, n.fit_iqr(f, COLS), COLS))


@query("n06_robust_min_max", _n_sql("(x - S.lo) / (S.hi - S.lo)", _Q))
def n06(spark, d):
    return _norm(spark, d, lambda m, f: n.robust_min_max(m, n.fit_median_iqr(f, COLS), COLS))


@query("n07_z_clip", _n_sql("case when x is not null then greatest(-3e0, least(3e0, (x - S.m) / (S.sd + 1e-8))) / 6 + 0.5e0 end", "avg({c}) m, stddev_samp({c}) sd"))
def n07(spark, d):
    return _norm(spark, d, lambda m, f: n.z_clip(m, n.fit(f, COLS), COLS))


@query("n08_auto", C(f""", x as (select *, sin(2 * pi() * month(match_date) / 12) m_sin, home_xg - away_xg xgd, 1e0 one from contests),
  s as (select min(home_xg) lo, max(home_xg) hi, avg(xgd) m, stddev_samp(xgd) sd from x where match_date < date '{BEFORE}')
  select match_id, {R('(home_xg - lo) / (hi - lo + 1e-8)')} home_xg_norm, {R('(m_sin + 1) / 2')} m_sin_norm,
   {R('case when xgd is not null then greatest(-3e0, least(3e0, (xgd - m) / (sd + 1e-8))) / 6 + 0.5e0 end')} xgd_norm, 0.5e0 one_norm from x, s"""))
def n08(spark, d):
    m = contests(spark, d).withColumns({"m_sin": s.cyclic(F.month("match_date"), 12)[0], "xgd": F.col("home_xg") - F.col("away_xg"), "one": F.lit(1.0)})
    cols = ["home_xg", "m_sin", "xgd", "one"]
    out = n.auto(m, n.fit(_fit_set(m), cols), cols)
    return _out(out, {f"{c}_norm": F.col(f"{c}_norm") for c in cols})


@query("n09_p99_cap", _n_sql("case when x is not null then greatest(0e0, least(1e0, x / S.q)) end", "quantile_cont({c}, 0.99) q"))
def n09(spark, d):
    return _norm(spark, d, lambda m, f: n.p99_cap(m, f, COLS))


PAIR_SQL = """, st as (select ent, sum(points) / cast(count(*) as double) v from long group by 1),
  pr as (select avg(x.v - y.v) m, stddev_pop(x.v - y.v) sd, min(x.v - y.v) lo, max(x.v - y.v) hi from st x join st y on x.ent < y.ent),
  dd as (select match_id, h.v - a.v x from contests join st h on h.ent = home join st a on a.ent = away)"""


@query("n10_dynamic_difference", L(PAIR_SQL + f""" select match_id, {R('greatest(0e0, least(1e0, ((x - m) / sd + 2) / 4))')} z_score,
  {R('greatest(0e0, least(1e0, (x - lo) / (hi - lo)))')} min_max,
  {R('(greatest(-2e0, least(3e0, (x - (m - 0.675e0 * sd)) / (1.35e0 * sd))) + 2) / 5')} robust from dd, pr"""))
def n10(spark, d):
    st = contests_long(spark, d).groupBy("ent").agg((F.sum("points") / F.count(F.lit(1))).alias("v"))
    stats = pair_difference_stats(st, "ent", "v").select(F.struct("*")).scalar()
    m = contests(spark, d).select(ID, "home", "away")
    for side in ("home", "away"):
        m = m.join(st.select(F.col("ent").alias(side), F.col("v").alias(f"{side}_v")), side)
    m = m.withColumns({"x": F.col("home_v") - F.col("away_v"), "st": stats})
    return _out(m, {k: n.dynamic(F.col("x"), F.col("st"), k) for k in ("z_score", "min_max", "robust")})


@query("n11_default_stats", C(f""" select match_id, {R('greatest(0e0, least(1e0, ((x - coalesce(m, 0)) / coalesce(sd, 8e0) + 2) / 4))')} shots_z,
   {R('case when y is not null then greatest(0e0, least(1e0, ((y - 0) / 3e0 + 2) / 4)) end')} corners_z
  from (select match_id, home_shots - away_shots x, home_corners - away_corners y from contests where home_shots is not null and away_shots is not null),
   (select avg(home_shots - away_shots) m, stddev_pop(home_shots - away_shots) sd from contests where match_date < date '{BEFORE}')"""))
def n11(spark, d):
    m = contests(spark, d, shots=True).filter("home_shots is not null and away_shots is not null").select(
        ID, "match_date", (F.col("home_shots") - F.col("away_shots")).alias("x"), (F.col("home_corners") - F.col("away_corners")).alias("y"))
    fitted = _fit_set(m).agg(F.struct(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).alias("s")).scalar()
    none = F.struct(*[F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "max")])
    m = m.withColumns({"fx": fitted, "fy": none})
    return _out(m, {"shots_z": n.dynamic(F.col("x"), n.with_default_stats(F.col("fx"), "shots_diff"), "z_score"),
                    "corners_z": n.dynamic(F.col("y"), n.with_default_stats(F.col("fy"), "corners_diff"), "z_score")})


@query("n12_standard", _n_sql("(x - S.m) / S.sd", "avg({c}) m, stddev_pop({c}) sd"))
def n12(spark, d):
    return _norm(spark, d, lambda m, f: n.standard(m, n.fit_standard(f, COLS), COLS))


# --- K -----------------------------------------------------------------------------------------

B365, PS = ("B365H", "B365D", "B365A"), ("PSH", "PSD", "PSA")
HOME_BOOKS, AWAY_BOOKS, DRAW_BOOKS = ["B365H", "BWH", "PSH", "WHH"], ["B365A", "BWA", "PSA", "WHA"], ["B365D", "BWD", "PSD", "WHD"]


def _mean_sql(cols) -> str:
    n_ = " + ".join(f"({c} is not null)::int" for c in cols)
    return f"(({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({n_}, 0))"


AVG_SQL = ", av as (select *, " + ", ".join(f"{_mean_sql([b + o for b in ('B365', 'PS', 'BW', 'WH')])} Avg{o}" for o in "HDA") + " from contests), " + \
    "mp as (select *, (1/AvgH)/(1/AvgH+1/AvgD+1/AvgA) ph, (1/AvgD)/(1/AvgH+1/AvgD+1/AvgA) pd, (1/AvgA)/(1/AvgH+1/AvgD+1/AvgA) pa from av)"


def _odds(spark, d):
    m = contests(spark, d, odds=True)
    return m.withColumns({f"Avg{o}": mk.row_mean([F.col(b + o) for b in ("B365", "PS", "BW", "WH")]) for o in "HDA"})


def cols(names):
    return [F.col(c) for c in names]


AVG = ("AvgH", "AvgD", "AvgA")


@query("k01_implied_probability", C(f"select match_id, {R('1 / B365H')} p_h, {R('1 / B365D')} p_d, {R('1 / B365A')} p_a from contests"))
def k01(spark, d):
    return _out(_odds(spark, d), dict(zip(("p_h", "p_d", "p_a"), [mk.implied(c) for c in cols(B365)])))


@query("k02_margin_free", C(AVG_SQL + f" select match_id, {R('1/AvgH + 1/AvgD + 1/AvgA')} margin, {R('ph')} p_h, {R('pd')} p_d, {R('pa')} p_a from mp"))
def k02(spark, d):
    return _out(_odds(spark, d), {"margin": mk.overround(cols(AVG)), **dict(zip(("p_h", "p_d", "p_a"), mk.margin_free(cols(AVG))))})


@query("k03_home_advantage", C(AVG_SQL + f""", a as (select match_id, ph - pa m, (1/PSH - 1/PSA) / (1/PSH + 1/PSD + 1/PSA) s from mp)
  select match_id, {R('(m - (select min(m) from a)) / (select max(m) - min(m) from a)')} market,
   {R('coalesce((s - (select min(s) from a)) / (select max(s) - min(s) from a), 0.5e0)')} sharp from a"""))
def k03(spark, d):
    m = _odds(spark, d).withColumns({"m": mk.home_advantage(cols(AVG)), "s": mk.home_advantage(cols(PS))})
    out = n.min_max(m, n.fit(m, ["m", "s"]), ["m", "s"])
    return _out(out, {"market": F.col("m_norm"), "sharp": F.coalesce("s_norm", F.lit(0.5))})


@query("k04_entropy", C(AVG_SQL + f" select match_id, {R('-(ph * ln(ph + 1e-10) + pd * ln(pd + 1e-10) + pa * ln(pa + 1e-10)) / ln(3e0)')} entropy from mp"))
def k04(spark, d):
    return _out(_odds(spark, d), {"entropy": mk.entropy(mk.margin_free(cols(AVG)))})


_FF = lambda names: "[" + ", ".join("coalesce(" + ", ".join(reversed(names[: i + 1])) + ")" for i in range(len(names))) + "]"
_STD = lambda lst: f"case when list_count({lst}) > 1 then list_aggregate({lst}, 'stddev_samp') end"


@query("k05_disagreement", C(f""", s as (select match_id, {_STD(_FF(HOME_BOOKS))} h, {_STD(_FF(AWAY_BOOKS))} a,
    {_STD('[' + ', '.join(DRAW_BOOKS) + ']')} / {_mean_sql(DRAW_BOOKS)} cv from contests)
  select match_id, {R('h / (select max(h) from s)')} disagreement, {R('(h + a) / (select max(h + a) from s)')} inefficiency, {R('cv')} draw_cv from s"""))
def k05(spark, d):
    m = _odds(spark, d)
    filled = row_ffill(row_ffill(m, HOME_BOOKS), AWAY_BOOKS)
    v = filled.select(ID, mk.row_std(cols(HOME_BOOKS)).alias("h"), (mk.row_std(cols(HOME_BOOKS)) + mk.row_std(cols(AWAY_BOOKS))).alias("i"))
    v = n.max_scale(v, n.fit(v, ["h", "i"]), ["h", "i"]).join(m.select(ID, mk.row_cv(cols(DRAW_BOOKS)).alias("cv")), ID)
    return _out(v, {"disagreement": F.col("h_norm"), "inefficiency": F.col("i_norm"), "draw_cv": F.col("cv")})


@query("k06_over_under", C(f"select match_id, {R('coalesce((1/BWH) / (1/BWH + 1/BWA), 0.5e0)')} over_prob, 0.5e0 absent from contests"))
def k06(spark, d):
    """The two-way market is taken from the two BW prices; a missing column pair gives the neutral value."""
    from formline.plans.features import over_under
    m = over_under(_odds(spark, d), "BWH", "BWA", "over_prob")
    return over_under(m, "Avg>2.5", "Avg<2.5", "absent").select(ID, r6("over_prob").alias("over_prob"), "absent")


def _fitted(name, expr, sql, kind):
    scale = {"minmax": f"(v - (select min(v) from s)) / (select max(v) - min(v) from s)", "max": "v / (select max(v) from s)"}[kind]

    @query(name, C(f", s as (select match_id, {sql} v from contests) select match_id, {R(scale)} v from s"))
    def run(spark, d):
        m = _odds(spark, d).withColumn("v", expr())
        fn = n.min_max if kind == "minmax" else n.max_scale
        return _out(fn(m, n.fit(m, ["v"]), ["v"]), {"v": F.col("v_norm")})
    return run


k07 = _fitted("k07_line_movement", lambda: mk.line_movement(*cols(["B365H", "PSH", "B365A", "PSA"])),
              "(PSH - B365H) / B365H - (PSA - B365A) / B365A", "minmax")
k08 = _fitted("k08_sharp_public_divergence", lambda: mk.divergence(*cols(["PSH", "B365H", "PSA", "B365A"])),
              "(1/PSH - 1/B365H) - (1/PSA - 1/B365A)", "minmax")
k09 = _fitted("k09_velocity", lambda: mk.velocity(*cols(["B365H", "PSH", "B365A", "PSA"])),
              "(abs(PSH - B365H) / B365H + abs(PSA - B365A) / B365A) / 2", "max")

_IMP = _mean_sql([f"(1/{b})" for b in DRAW_BOOKS])
_CLIP = lambda e: f"case when {e} is not null then greatest(0e0, least(1e0, {e})) end"


@query("k10_draw_value", C(f", s as (select match_id, (0.15e0 + 0.16e0 * (1 - abs(B365H/B365A - 1) / (B365H/B365A + 1)) - {_IMP} + 0.1e0) / 0.2e0 v from contests) select match_id, {R(_CLIP('v'))} v from s"))
def k10(spark, d):
    return _out(_odds(spark, d), {"v": mk.draw_value(F.col("B365H"), F.col("B365A"), cols(DRAW_BOOKS))})


@query("k11_draw_bias", C(f", s as (select match_id, (2 - B365D / (2 + 2 * abs(B365H - B365A) / (B365H + B365A))) / 2 v from contests) select match_id, {R(_CLIP('v'))} v from s"))
def k11(spark, d):
    return _out(_odds(spark, d), {"v": mk.draw_bias(*cols(B365))})


@query("k12_draw_instability", C(f""", s as (select match_id, (greatest({', '.join(DRAW_BOOKS)}) - least({', '.join(DRAW_BOOKS)})) / {_mean_sql(DRAW_BOOKS)} v from contests)
  select match_id, {R(_CLIP('v / (select quantile_cont(v, 0.99) from s)'))} v from s"""))
def k12(spark, d):
    m = _odds(spark, d).withColumn("v", mk.row_range_share(cols(DRAW_BOOKS)))
    return _out(n.p99_cap(m, m, ["v"]), {"v": F.col("v_norm")})


@query("k13_closeness_opportunity", C(f", s as (select match_id, 1 - abs(B365H - B365A) / (B365H + B365A) c, B365D d from contests) select match_id, {R('c')} closeness, {R(_CLIP('c * (d - 3e0) / 2'))} opportunity from s"))
def k13(spark, d):
    h_, d_, a_ = cols(B365)
    return _out(_odds(spark, d), {"closeness": mk.closeness(h_, a_), "opportunity": mk.draw_opportunity(h_, d_, a_)})


@query("k14_model_vs_market", C(AVG_SQL + f", w as (select match_id, (1 + match_id % 3) / cast(3 + match_id % 7 + match_id % 3 + match_id % 5 as double) p_d from contests) select match_id, {R('w.p_d - pd')} signal from mp join w using (match_id)"))
def k14(spark, d):
    from formline.plans.fixtures import predictions
    m = _odds(spark, d).withColumn("market", mk.margin_free(cols(AVG))[1])
    return _out(m.join(predictions(spark, d).select(ID, "p_d"), ID), {"signal": F.col("p_d") - F.col("market")})


