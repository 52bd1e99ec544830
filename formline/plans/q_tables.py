"""S, P, J, A, O and U families."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


from formline.operators import aggregates as a
from formline.operators import joins as j
from formline.operators import shape as s
from formline.operators.ledger import as_of, attach, day_sums, sums_before
from formline.operators.ordered import with_row_number
from formline.operators.shape import to_long
from formline.plans.base_sql import C, L, with_unplayed
from formline.plans.fixtures import PRED_SQL, predictions, unplayed
from formline.plans.registry import ORACLES, R, query, r6
from formline.session import scratch
from formline.sources import readers as rd
from formline.sources import sinks as sk
from formline.sources import transactions as tx
from formline.sources.contests import BOOKS, contests, contests_long, season_days, table

BASE = ["match_id", "match_date", "season", "pool", "home", "away", "result", "home_goals", "away_goals", "home_xg", "away_xg"]
ODDS = [b[0] for b in BOOKS]


def day_text():
    return F.col("match_date").cast("string").alias("match_date")


def _r(df, cols, keep):
    return df.select(*keep, *[r6(c).alias(c) for c in cols])


# --- S: sources and sinks ---------------------------------------------------------------------

@query("s01_read_contests", C(f"""select match_id, cast(match_date as varchar) match_date, season, pool, home, away, result,
  home_goals, away_goals, {R('home_xg')} home_xg, {R('away_xg')} away_xg from contests"""))
def s01(spark, d):
    path = scratch(spark, "contests-csv")
    contests(spark, d).select(*BASE).write.option("header", True).csv(path)
    return rd.read_contests(spark, path).select("match_id", day_text(), *BASE[2:9], r6("home_xg").alias("home_xg"), r6("away_xg").alias("away_xg"))


@query("s02_read_seasons", C("""select cast(season as varchar) file_season, count(*) n, count(home_xg) with_xg,
  cast(sum(case when season < 1998 then 0 else home_goals end) as bigint) goals from contests group by 1"""))
def s02(spark, d):
    # Season files of two generations: the older ones have no goal column.
    old, new, base = contests(spark, d, **season_days(last=1997)), contests(spark, d, **season_days(1998)), scratch(spark, "seasons")
    cols = ["match_id", "home_xg"]
    old.select("season", *cols).write.partitionBy("season").option("header", True).csv(f"{base}/old")
    new.select("season", *cols, "home_goals").write.partitionBy("season").option("header", True).csv(f"{base}/new")
    field = {f.name: f for f in rd.CONTEST_SCHEMA}
    old = T.StructType([field[c] for c in cols])
    df = rd.read_mixed_seasons(spark, [(f"{base}/old/*", old), (f"{base}/new/*", T.StructType([*old, field["home_goals"]]))])
    return df.groupBy("file_season").agg(F.count(F.lit(1)).alias("n"), F.count("home_xg").alias("with_xg"),
                                         F.coalesce(F.sum("home_goals"), F.lit(0)).alias("goals"))


@query("s03_latest_file", C("select pool, count(*) n from contests where season >= 1998 group by 1"))
def s03(spark, d):
    base = scratch(spark, "stamped")
    for days, stamp in ((season_days(last=1997), "2024_01_01"), (season_days(1998), "2024_02_01")):
        contests(spark, d, **days).select("match_id", "pool", "season").write.parquet(f"{base}/log_{stamp}")
    newest = rd.latest_file(spark, f"{base}/log_*").rsplit("/", 1)[0]
    return spark.read.parquet(newest).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("s04_read_lookup", "select n_name as key, cast(n_nationkey as integer) as value from nation")
def s04(spark, d):
    path = scratch(spark, "lookup")
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))  # 25 nations, fixed by the schema
    table(spark, d, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    return rd.read_lookup(spark, path, "int")


HIST_SQL = PRED_SQL + """,
 daily as (select season, pool, avg(case when actual = pred then 1e0 else 0e0 end) acc from preds group by 1, 2),
 hist as (select season, avg(acc) m, stddev_samp(acc) sd from daily group by 1),
 tot as (select season, count(*) n, avg(case when actual = pred then 1e0 else 0e0 end) acc,
   avg(case when actual = 0 then 1e0 else 0e0 end) home from preds group by 1)"""


def _history(spark, d):
    pred = predictions(spark, d)
    hit = (F.col("actual") == F.col("pred")).cast("double")
    fold = pred.groupBy("season", "pool").agg(F.avg(hit).alias("acc"))
    # One score per pool: bounded by the number of pools.
    cv = fold.groupBy("season").agg(F.avg("acc").alias("mean"), F.stddev_samp("acc").alias("std"), F.collect_list("acc").alias("scores"))
    tot = pred.groupBy("season").agg(F.avg(hit).alias("accuracy"), F.avg((F.col("actual") == 0).cast("double")).alias("home"))
    both = tot.join(cv, "season")
    return both.select(
        F.col("season").cast("string").alias("timestamp"), F.lit("pseudo").alias("model_name"),
        F.create_map(F.lit("accuracy"), F.col("accuracy")).alias("overall_metrics"),
        F.create_map(F.lit("accuracy"), F.struct("mean", "std", "scores")).alias("cross_validation"),
        F.create_map(F.lit("home_always"), F.col("home")).alias("baseline_comparisons"))


HIST_OUT = f"""select cast(season as varchar) as timestamp, 'pseudo' model_name, {R('acc')} overall_accuracy, {R('m')} cv_accuracy_mean,
  {R('sd')} cv_accuracy_std, {R('home')} baseline_home_always from tot join hist using (season)"""


@query("s05_read_json_history", C(HIST_SQL + HIST_OUT))
def s05(spark, d):
    path = scratch(spark, "history")
    # One entry per season, so the array file stays small.
    entries = F.to_json(F.collect_list(F.struct("*")))
    _history(spark, d).agg(entries.alias("value")).write.text(path)
    flat = rd.flatten_history(rd.read_json_history(spark, path), ["accuracy"], ["accuracy"], ["home_always"])
    return _r(flat, flat.columns[2:], ["timestamp", "model_name"])


PAGE_PATTERNS = (*rd.JSON_PATTERNS, r"track\((\d+)\);")


@query("s06_extract_embedded_json", r"""select page_id, nullif(coalesce(
  nullif(regexp_extract(html, 'var datesData = JSON\.parse\(''(.+?)''\);', 1), ''),
  nullif(regexp_extract(html, 'JSON\.parse\(''([^'']+)''\)', 1), ''),
  nullif(regexp_extract(html, 'track\((\d+)\);', 1), '')), '') literal from pages""")
def s06(spark, d):
    return table(spark, d, "pages").select("page_id", rd.embedded_literal(F.col("html"), PAGE_PATTERNS).alias("literal"))


@query("s06b_parse_event_json", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def s06b(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s06c_embedded_records", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def s06c(spark, d):
    """Pages whose literal mixes escapes and plain characters, down to records."""
    body = F.concat(F.lit(r"<script>var datesData = JSON.parse('\x5b\x7B\x22k"), F.lit('":'), F.get_json_object("props", "$.k"), F.lit(r"\x7d]');</script>"))
    pages = table(spark, d, "events").select("event_id", body.alias("html"))
    return rd.embedded_json(pages, "html", "array<struct<k:bigint>>").select("event_id", F.col("rec")["k"].alias("k"))


@query("s07_profile_files", C("""select cast(season as varchar) file, count(*) n, 4 as columns, 1 has_entities, cast(min(match_date) as varchar) first_day,
  cast(max(match_date) as varchar) last_day, cast(season as varchar) seasons from contests group by season"""))
def s07(spark, d):
    base = scratch(spark, "profile")
    contests(spark, d).select("match_id", "match_date", "home", "away", F.col("season").alias("s")).write.partitionBy("s").parquet(base)
    df = spark.read.parquet(base)
    unit = F.regexp_extract(F.col("_metadata.file_path"), r"s=(\d+)", 1)
    df = df.select("match_id", "match_date", "home", "away", F.col("s").alias("season"), unit.alias("_unit"))
    out = rd.profile_files(df, F.col("_unit"), "match_date", "season").withColumn("columns", F.col("columns") - 2)
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("s08_write_versioned", C("select pool, count(*) n, cast(sum(home_goals) as bigint) goals from contests group by 1"))
def s08(spark, d):
    base = scratch(spark, "versions")
    sk.write_versioned(contests(spark, d).select(*BASE), base)
    return sk.read_latest(spark, base).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


@query("s08b_transactional_write", C("""select pool, count(*) n, cast(sum(home_goals) as bigint) goals, cast(1 as integer) same_rows from contests group by 1"""))
def s08b(spark, d):
    """Published in one step by a writer that hashes the rows as it writes them: twice in different splits, with equal fingerprints."""
    base = scratch(spark, "transactions")
    rows = contests(spark, d).select(*BASE)
    one = tx.write_transaction(rows, base)
    two = tx.write_transaction(rows.repartition(5, "match_id"), base)
    same = int((one["fingerprint"], one["rows"]) == (two["fingerprint"], two["rows"]))
    return tx.read_transaction(spark, base).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"), F.lit(same).alias("same_rows"))


@query("s09_content_fingerprint")
def s09(spark, d):
    return sk.content_fingerprint(contests(spark, d).select(*BASE))


MARKED = ["match_id", "match_date", "season", "pool", "home", "away", "result", "home_goals", "away_goals"]


@query("s09b_text_fingerprint", C(f"""select n, md5(concat_ws('|', n, s0, s1, s2, s3)) fingerprint from (select count(*) n, {', '.join(f"sum(cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)) s{i}" for i in range(4))} from (
  select md5(concat_ws('|', {', '.join(f"coalesce(cast({c} as varchar), '~')" for c in MARKED)})) h from contests))"""))
def s09b(spark, d):
    return sk.text_fingerprint(contests(spark, d).select(*MARKED))


@query("s10_split_export", C("""select match_id, home_goals, away_goals,
  case result when 'H' then 0 when 'D' then 1 else 2 end target from contests"""))
def s10(spark, d):
    df = predictions(spark, d).withColumn("target", F.col("actual"))
    paths = sk.split_export(df, ["home_goals", "away_goals"], "target", scratch(spark, "export"))
    return spark.read.parquet(paths["features"]).join(spark.read.parquet(paths["target"]), "match_id")


@query("s11_write_report", C(PRED_SQL + f""" select season, count(*) n, {R('avg(case when actual = pred then 1e0 else 0e0 end)')} accuracy
  from preds group by 1"""))
def s11(spark, d):
    hit = (F.col("actual") == F.col("pred")).cast("double")
    out = predictions(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("accuracy"))
    return spark.read.schema("season int, n bigint, accuracy double").json(sk.write_report(out, scratch(spark, "report")))


@query("s12_append_history", C(HIST_SQL + " select cast(season as varchar) as timestamp, n from tot"))
def s12(spark, d):
    path = scratch(spark, "appended")
    per = predictions(spark, d).groupBy(F.col("season").cast("string").alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    for cond in (F.col("timestamp") < "1998", F.col("timestamp") >= "1998"):
        sk.append_history(per.filter(cond), path)
    return spark.read.schema("timestamp string, n bigint").json(path)


@query("s12b_transactional_append", C("""select season, cast(sum(count(*)) over (order by season) as bigint) as rows, cast(sum(sum(home_goals)) over (order by season) as bigint) goals from contests group by season"""))
def s12b(spark, d):
    """One append a season; every version stays readable, and an append reads none of the rows before it."""
    base = scratch(spark, "history")
    log = contests(spark, d).select(*BASE)
    found = None
    for season in [r["season"] for r in log.select("season").distinct().orderBy("season").collect()]:  # one entry a year
        told = tx.write_transaction(log.filter(F.col("season") == season), base, append=True)
        part = tx.read_transaction(spark, base, told["version"]).agg(F.sum("home_goals").alias("goals")).select(F.lit(season).alias("season"), F.lit(told["rows"]).cast("long").alias("rows"), "goals")
        found = part if found is None else found.unionByName(part)
    return found


@query("s13_state_snapshot", L("""select ent, count(*) games, cast(sum(points) as bigint) points, cast(sum(gf) as bigint) goals_for
  from long where match_date < date '1998-08-01' group by 1"""))
def s13(spark, d):
    path = scratch(spark, "state")
    state = contests_long(spark, d).filter(F.col("match_date") < F.lit("1998-08-01").cast("date")).groupBy("ent").agg(
        F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"), F.sum("gf").alias("goals_for"))
    sk.write_snapshot(state, path, "1998-08-01")
    return sk.load_snapshot(spark, path, "1998-08-01")


# --- P: projections and filters ----------------------------------------------------------------

@query("p01_filter_in", C("select match_id, season from contests where season in (1996, 1997, 1998)"))
def p01(spark, d):
    return contests(spark, d, **season_days(1996, 1998)).filter(F.col("season").isin(1996, 1997, 1998)).select("match_id", "season")


@query("p02_filter_period", C("""select match_id, cast(match_date as varchar) match_date from contests
  where match_date >= date '1997-01-01' and match_date <= date '1997-12-31'"""))
def p02(spark, d):
    return contests(spark, d, start="1997-01-01", end="1997-12-31").select("match_id", day_text())


@query("p03_existing_columns", C("select match_id, result, home_goals from contests"))
def p03(spark, d):
    return s.existing(contests(spark, d), ["match_id", "referee", "result", "home_goals", "attendance"])


@query("p04_columns_like", C("select match_id, home_goals, away_goals from contests"))
def p04(spark, d):
    m = contests(spark, d)
    return m.select("match_id", *s.columns_like(m, ["home_", "away_"], dtypes=["bigint"]))


@query("p05_drop_columns", C("select match_id, season, pool, home, away from contests"))
def p05(spark, d):
    deny = ["result", "home_goals", "away_goals", "home_xg", "away_xg", "match_date", "shots_total"]
    return s.drop_listed(contests(spark, d), deny)


@query("p06_rename_map", C("select match_id, home as home_team, away, result from contests"))
def p06(spark, d):
    m = contests(spark, d).select("match_id", "home", "away", "result")
    return s.rename_absent(m, {"home": "home_team", "FTR": "result", "result": "away"})


@query("p07_with_constants", C("select match_id, 1 home_advantage, 0.5e0 neutral from contests"))
def p07(spark, d):
    return s.with_constants(contests(spark, d).select("match_id"), {"home_advantage": 1, "neutral": 0.5})


@query("p08_drop_incomplete", C("select match_id from contests where home_xg is not null and home_shots is not null and away_shots is not null"))
def p08(spark, d):
    return s.drop_incomplete(contests(spark, d, shots=True), ["home_xg", "home_shots", "away_shots"]).select("match_id")


@query("p09_rows_missing", C(f"""select match_id, home, away, {R('home_shots')} home_shots, {R('away_shots')} away_shots
  from contests where home_shots is null or away_shots is null"""))
def p09(spark, d):
    return _r(s.rows_missing(contests(spark, d, shots=True), ["home_shots", "away_shots"]), ["home_shots", "away_shots"], ["match_id", "home", "away"])


@query("p10_pair_flag", C(""", riv as (select least(home, away) lo, greatest(home, away) hi from contests group by 1, 2 having count(*) >= 6)
  select match_id, cast(case when lo is not null then 1 else 0 end as integer) rivalry from contests
  left join riv on lo = least(home, away) and hi = greatest(home, away)"""))
def p10(spark, d):
    m = contests(spark, d)
    often = m.groupBy(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).count().filter("count >= 6")
    return s.pair_flag(m, often, "home", "away", "rivalry").select("match_id", "rivalry")


@query("p11_fill_neutral", C(f"select match_id, {R('coalesce(home_xg, 1.5e0)')} home_xg, {R('coalesce(home_shots, 0)')} home_shots from contests"))
def p11(spark, d):
    return _r(s.fill(contests(spark, d, shots=True), {"home_xg": 1.5, "home_shots": 0.0}), ["home_xg", "home_shots"], ["match_id"])


@query("p12_fill_mean", C(f"select match_id, {R('coalesce(home_xg, (select avg(home_xg) from contests))')} home_xg from contests"))
def p12(spark, d):
    from formline.operators.normalise import fill_mean
    return _r(fill_mean(contests(spark, d), ["home_xg"]), ["home_xg"], ["match_id"])


@query("p13_fill_median", C(f"""select match_id, {R('''coalesce(home_shots, (select median(home_shots) from contests
  where match_date < date '1999-01-01'))''')} home_shots from contests"""))
def p13(spark, d):
    from formline.operators.normalise import fill_median
    m = contests(spark, d, shots=True)
    return _r(fill_median(m, ["home_shots"], m.filter(F.col("match_date") < F.lit("1999-01-01").cast("date"))), ["home_shots"], ["match_id"])


@query("p14_row_ffill", C(f"""select match_id, {R('B365D')} B365D, {R('coalesce(PSD, B365D)')} PSD, {R('coalesce(BWD, PSD, B365D)')} BWD,
  {R('coalesce(WHD, BWD, PSD, B365D)')} WHD from contests"""))
def p14(spark, d):
    books = ["B365D", "PSD", "BWD", "WHD"]
    return _r(s.row_ffill(contests(spark, d, odds=True), books), books, ["match_id"])


# --- J: joins ----------------------------------------------------------------------------------

KEY_SQL = """, shots as (select match_date, home, away, sum(home_shots) hs, sum(away_shots) as_ from contests
  where home_corners is not null group by 1, 2, 3)"""


def _shots(spark, d):
    m = contests(spark, d, shots=True).filter(F.col("home_corners").isNotNull())
    return m.groupBy(*j.MATCH_KEY).agg(F.sum("home_shots").alias("hs"), F.sum("away_shots").alias("as_"))


@query("j01_join_on_match", C(KEY_SQL + f" select match_id, {R('hs')} hs, {R('as_')} as_ from contests left join shots using (match_date, home, away)"))
def j01(spark, d):
    return _r(j.join_on_match(contests(spark, d), _shots(spark, d)), ["hs", "as_"], ["match_id"])


@query("j02_inner_join", C(KEY_SQL + f" select match_id, {R('hs')} hs from contests join shots using (match_date, home, away)"))
def j02(spark, d):
    return _r(j.join_on_match(contests(spark, d), _shots(spark, d), how="inner"), ["hs"], ["match_id"])


@query("j03_join_side_features", L("""select c.match_id, h.points home_points, a.points away_points, h.gf home_gf, a.gf away_gf from contests c
  join long h on h.match_id = c.match_id and h.venue = 'H' join long a on a.match_id = c.match_id and a.venue = 'A'"""))
def j03(spark, d):
    return s.to_wide(contests_long(spark, d), ["points", "gf"])


@query("j04_join_dimension", C("""select match_id, coalesce(n_name, cast(pool as varchar)) pool_name from contests
  left join (select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA') on n_nationkey = pool"""))
def j04(spark, d):
    region = table(spark, d, "region").filter("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    names = table(spark, d, "nation").join(region, "n_regionkey").select(F.col("n_nationkey").cast("string").alias("raw"), "n_name")
    m = contests(spark, d).select("match_id", F.col("pool").cast("string").alias("pool_name"))
    return j.join_dimension(m, names, "pool_name", "raw", "n_name").select("match_id", "pool_name")


@query("j05_join_first_pair", C(f""", f as (select home, away, B365D, row_number() over (partition by home, away order by season, match_date, match_id) rn from contests)
  select c.match_id, {R('f.B365D')} first_odds from contests c left join f on f.home = c.home and f.away = c.away and rn = 1"""))
def j05(spark, d):
    m = contests(spark, d, odds=True)
    dim = m.select("home", "away", "season", "match_date", "match_id", F.col("B365D").alias("first_odds"))
    order = [F.col(c) for c in ("season", "match_date", "match_id")]
    first = s.first_per_key(dim, ["home", "away"], order).select("home", "away", "first_odds")
    return m.join(first, ["home", "away"], "left").select("match_id", r6("first_odds").alias("first_odds"))


@query("j06_self_range_join", L("""select l.match_id, l.venue, """ + ", ".join(
    f"count(case when b.match_date >= l.match_date - interval {n} day then 1 end) games_{n}d, "
    f"cast(coalesce(sum(case when b.match_date >= l.match_date - interval {n} day then b.points end), 0) as bigint) points_{n}d" for n in (14, 30, 60, 90)) +
    " from long l left join long b on b.ent = l.ent and b.match_date < l.match_date group by 1, 2"))
def j06(spark, d):
    long = contests_long(spark, d)
    spans = (14, 30, 60, 90)
    ledger = sums_before(long, ["ent"], "match_date", {"games": F.count(F.lit(1)), "points_": F.sum("points")}, {f"_{n}d": n for n in spans})
    out = attach(long, ledger, ["ent"], "match_date")
    return out.select("match_id", "venue", *[F.coalesce(f"games_{n}d", F.lit(0)).alias(f"games_{n}d") for n in spans],
                      *[F.coalesce(f"points__{n}d", F.lit(0)).alias(f"points_{n}d") for n in spans])


@query("j07_asof_join", L("""select c.match_id,
  (select arg_max(goals, match_date) from (select ent, match_date, cast(sum(gf) as bigint) goals from long group by 1, 2) s
    where s.ent = c.home and s.match_date < c.match_date) goals_before,
  (select arg_max(goals, match_date) from (select ent, match_date, cast(sum(gf) as bigint) goals from long where venue = 'A' group by 1, 2) s
    where s.ent = c.home and s.match_date <= c.match_date) goals_at from contests c"""))
def j07(spark, d):
    m, long = contests(spark, d), contests_long(spark, d)
    m = m.select("match_id", "match_date", F.col("home").alias("ent"))
    strict = day_sums(long, ["ent"], "match_date", {"goals_before": F.sum("gf")})
    loose = day_sums(long.filter("venue = 'A'"), ["ent"], "match_date", {"goals_at": F.sum("gf")})
    out = as_of(m, strict, ["ent"], "match_date", ["goals_before"])
    return as_of(out, loose, ["ent"], "match_date", ["goals_at"], allow_equal=True).select("match_id", "goals_before", "goals_at")


@query("j08_self_history", C("""select c.match_id, count(b.match_id) meetings, cast(coalesce(sum(b.home_goals + b.away_goals), 0) as bigint) goals
  from contests c left join contests b on least(b.home, b.away) = least(c.home, c.away) and greatest(b.home, b.away) = greatest(c.home, c.away)
   and b.match_date < c.match_date group by 1"""))
def j08(spark, d):
    m = contests(spark, d).withColumns({"lo": F.least("home", "away"), "hi": F.greatest("home", "away")})
    ledger = sums_before(m, ["lo", "hi"], "match_date", {"meetings": F.count(F.lit(1)), "goals": F.sum(F.col("home_goals") + F.col("away_goals"))})
    return attach(m, ledger, ["lo", "hi"], "match_date").select(
        "match_id", F.coalesce("meetings", F.lit(0)).alias("meetings"), F.coalesce("goals", F.lit(0)).alias("goals"))


@query("j09_anti_semi_join", C(""", tr as (select distinct home, away from contests where season < 1999),
  te as (select distinct home, away from contests where season >= 1999)
  select home, away, 'unseen' kind from te where not exists (select 1 from tr where tr.home = te.home and tr.away = te.away)
  union all select home, away, 'known' from te where exists (select 1 from tr where tr.home = te.home and tr.away = te.away)"""))
def j09(spark, d):
    train = contests(spark, d, **season_days(last=1998)).select("home", "away").distinct()
    test = contests(spark, d, **season_days(1999)).select("home", "away").distinct()
    unseen = test.join(train, ["home", "away"], "left_anti").withColumn("kind", F.lit("unseen"))
    return unseen.unionByName(test.join(train, ["home", "away"], "left_semi").withColumn("kind", F.lit("known")))


@query("j10_pair_difference_stats", L(f""", st as (select ent, sum(points) / cast(count(*) as double) v from long group by 1)
  select count(*) pairs, {R('avg(x.v - y.v)')} mean, {R('stddev_pop(x.v - y.v)')} std, {R('min(x.v - y.v)')} as min, {R('max(x.v - y.v)')} as max
  from st x join st y on x.ent < y.ent"""))
def j10(spark, d):
    st = contests_long(spark, d).groupBy("ent").agg((F.sum("points") / F.count(F.lit(1))).alias("v"))
    return _r(j.pair_difference_stats(st, "ent", "v"), ["mean", "std", "min", "max"], ["pairs"])


@query("j11_coverage", C(f""", l as (select distinct match_date, home, away from contests where home_xg is not null),
  r as (select distinct match_date, home, away from contests where home_shots is not null),
  f as (select l.home lh, r.home rh from l full join r using (match_date, home, away))
  select count(case when lh is not null and rh is not null then 1 end) matched, count(case when rh is null then 1 end) left_only,
   count(case when lh is null then 1 end) right_only,
   {R("count(case when lh is not null and rh is not null then 1 end) / cast(count(lh) as double)")} match_rate,
   cast(count(case when lh is not null and rh is not null then 1 end) / cast(count(lh) as double) >= 0.95e0 as integer) passed from f"""))
def j11(spark, d):
    m = contests(spark, d, shots=True)
    out = j.coverage(m.filter("home_xg is not null"), m.filter("home_shots is not null"), j.MATCH_KEY)
    return _r(out, ["match_rate"], ["matched", "left_only", "right_only", "passed"])


@query("j12_join_weather", C(f""", rdg as (select s_nationkey place, cast(l_shipdate as date) match_date, avg(l_quantity) t, {R('avg(l_discount) * 10')} p, {R('avg(l_tax) * 100')} w
    from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
  select match_id, {R('coalesce(t, 15e0)')} temperature, {R('coalesce(p, 0e0)')} precipitation, {R('coalesce(w, 10e0)')} wind_speed
  from contests c left join rdg r on r.place = c.pool and r.match_date = c.match_date"""))
def j12(spark, d):
    out = j.join_weather(contests(spark, d), *weather_tables(spark, d), "pool")
    return _r(out, ["temperature", "precipitation", "wind_speed"], ["match_id"])


def weather_tables(spark, d):
    """(place, day) readings taken from order lines by supplier nation, and the place of each pool."""
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("place"))
    lines = table(spark, d, "lineitem").join(sup, "l_suppkey")
    readings = lines.groupBy("place", F.to_date("l_shipdate").alias("match_date")).agg(
        F.avg("l_quantity").alias("temperature"), r6(F.avg("l_discount") * 10).alias("precipitation"), r6(F.avg("l_tax") * 100).alias("wind_speed"))
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("pool"), F.col("n_nationkey").alias("place"))
    return places, readings


@query("j07b_asof_join_events", """select e.event_id, (select arg_max(value, ts) from events s where s.user_id = e.user_id and s.event_type = 'view'
   and s.ts < e.ts) last_view from events e where event_type = 'purchase'""")
def j07b(spark, d):
    """Each purchase with the value of the user's latest earlier view."""
    ev = table(spark, d, "events")
    views = ev.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return as_of(ev.filter("event_type = 'purchase'"), views, ["user_id"], "ts", ["last_view"]).select("event_id", "last_view")


# --- A: aggregations ---------------------------------------------------------------------------

@query("a01_value_share", C(f"select result as value, count(*) n, {R('count(*) / cast(sum(count(*)) over () as double)')} share from contests group by 1"))
def a01(spark, d):
    return _r(a.value_share(contests(spark, d), "result"), ["share"], ["value", "n"])


@query("a02_group_mean", C(f"select result, {R('avg(home_xg)')} mean_home_xg, {R('avg(home_shots)')} mean_home_shots from contests group by 1"))
def a02(spark, d):
    return _r(a.group_mean(contests(spark, d, shots=True), "result", ["home_xg", "home_shots"]), ["mean_home_xg", "mean_home_shots"], ["result"])


@query("a03_side_stats", L("select ent, count(*) games, " + ", ".join(
    f"{R(f'''avg(case when venue = '{v}' then {c} end)''')} {c}_{t}_mean, {R(f'''stddev_samp(case when venue = '{v}' then {c} end)''')} {c}_{t}_std, "
    f"count(case when venue = '{v}' then {c} end) {c}_{t}_n" for c in ("gf", "shots") for v, t in (("H", "home"), ("A", "away"))) +
    f", {R('avg(gf)')} gf_mean, {R('avg(shots)')} shots_mean from long group by 1"))
def a03(spark, d):
    out = a.side_stats(contests_long(spark, d, shots=True), ["gf", "shots"])
    num = [c for c in out.columns if c.endswith(("_mean", "_std"))]
    return _r(out, num, [c for c in out.columns if c not in num])


@query("a04_grand_mean", C(f"select {R('(avg(home_shots) + avg(away_shots)) / 2')} grand_mean from contests"))
def a04(spark, d):
    return _r(a.grand_mean(contests(spark, d, shots=True), "home_shots", "away_shots"), ["grand_mean"], [])


@query("a05_distinct_entities", C("select home ent from contests union select away from contests"))
def a05(spark, d):
    return contests_long(spark, d).select("ent").distinct()


@query("a06_appearances", L("select ent, count(*) games, cast(count(*) < 76 as integer) is_new from long group by 1"))
def a06(spark, d):
    return a.appearances(contests_long(spark, d))


@query("a07_points_table", L("""select season, ent, count(*) games, cast(sum(case when res = 1 then 1 else 0 end) as bigint) wins,
  cast(sum(case when res = 0 then 1 else 0 end) as bigint) draws, cast(sum(case when res = -1 then 1 else 0 end) as bigint) losses,
  cast(sum(points) as bigint) points, cast(sum(gf - ga) as bigint) goal_diff from long where match_date < date '1998-01-01' group by 1, 2"""))
def a07(spark, d):
    return a.points_table(contests_long(spark, d), F.lit("1998-01-01").cast("date"))


@query("a07b_table_unplayed", with_unplayed(ORACLES["a07_points_table"].replace("count(*) games", "count(res) games").replace("cast(sum(gf - ga) as bigint)", "cast(coalesce(sum(gf - ga), 0) as bigint)")))
def a07b(spark, d):
    return a.points_table(to_long(unplayed(spark, d)), F.lit("1998-01-01").cast("date"))


@query("a08_describe", C(" union all ".join(f"""select '{c}' col, count({c}) n, {R(f'avg({c})')} mean, {R(f'stddev_samp({c})')} std,
  {R(f'min({c})')} as min, {R(f'max({c})')} as max, count(*) - count({c}) nulls, count(case when {c} = 0 then 1 end) zeros,
  {R(f'quantile_cont({c}, 0.25)')} q25, {R(f'quantile_cont({c}, 0.5)')} q50, {R(f'quantile_cont({c}, 0.75)')} q75 from contests"""
    for c in ("home_xg", "home_shots", "home_goals"))))
def a08(spark, d):
    out = a.describe(contests(spark, d, shots=True), ["home_xg", "home_shots", "home_goals"])
    return _r(out, ["mean", "std", "min", "max", "q25", "q50", "q75"], ["col", "n", "nulls", "zeros"])


@query("a09_null_profile", C(" union all ".join(f"""select '{c}' col, count(*) - count({c}) nulls,
  {R(f'(count(*) - count({c})) * 100e0 / count(*)')} pct from contests""" for c in ("home_xg", "home_shots", "away_corners", "result"))))
def a09(spark, d):
    return _r(a.null_profile(contests(spark, d, shots=True), ["home_xg", "home_shots", "away_corners", "result"]), ["pct"], ["col", "nulls"])


@query("a10_date_extent", C("""select pool, season, cast(min(match_date) as varchar) first_day, cast(max(match_date) as varchar) last_day,
  count(distinct match_date) as days, count(*) n, cast(max(match_date) - min(match_date) as integer) span from contests group by 1, 2"""))
def a10(spark, d):
    out = a.date_extent(contests(spark, d), ["pool", "season"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("a11_period_counts", C("""select 'month' unit, strftime(match_date, '%Y-%m') period, count(*) n from contests group by 2
  union all select 'year', strftime(match_date, '%Y'), count(*) from contests group by 2"""))
def a11(spark, d):
    m = contests(spark, d)
    return a.period_counts(m, "yyyy-MM").withColumn("unit", F.lit("month")).unionByName(
        a.period_counts(m, "yyyy").withColumn("unit", F.lit("year")))


@query("a12_season_completeness", L("""select pool, season, count(case when venue = 'H' then 1 end) n, count(distinct ent) entities,
  count(case when venue = 'H' then 1 end) - 380 gap, cast(count(case when venue = 'H' then 1 end) = 380 as integer) complete from long group by 1, 2"""))
def a12(spark, d):
    return a.season_completeness(contests_long(spark, d), ["pool", "season"])


@query("a13_expected_density", C(f"""select cast(max(match_date) - min(match_date) as integer) as days, count(*) actual,
  {R('(max(match_date) - min(match_date)) / 365.25e0 * 380')} expected,
  {R('count(*) / ((max(match_date) - min(match_date)) / 365.25e0 * 380)')} density from contests"""))
def a13(spark, d):
    return _r(a.expected_density(contests(spark, d)), ["expected", "density"], ["days", "actual"])


@query("a14_mode_value", C(f"""select result as value, count(*) n, {R('count(*) / cast((select count(*) from contests) as double)')} share
  from contests group by 1 order by 2 desc, 1 limit 1"""))
def a14(spark, d):
    return _r(a.mode_value(contests(spark, d), "result"), ["share"], ["value", "n"])


@query("a15_sum_sq_shares", C(f"""select {R('sum(s * s)')} expected_accuracy from
  (select count(*) / cast((select count(*) from contests) as double) s from contests group by result)"""))
def a15(spark, d):
    return _r(a.sum_sq_shares(contests(spark, d), "result"), ["expected_accuracy"], [])


@query("a16_team_accuracy", C(PRED_SQL + f""" select ent, count(*) n, {R('avg(hit)')} accuracy from
  (select home ent, case when actual = pred then 1e0 else 0e0 end hit from preds union all
   select away, case when actual = pred then 1e0 else 0e0 end from preds) group by 1"""))
def a16(spark, d):
    return _r(a.side_accuracy(predictions(spark, d)), ["accuracy"], ["ent", "n"])


DAILY_SQL = PRED_SQL + """, daily as (select match_date, count(*) n, avg(case when actual = pred then 1e0 else 0e0 end) acc,
  avg(-ln(case actual when 0 then p_h when 1 then p_d else p_a end)) ll from preds group by 1)"""


@query("a17_daily_accuracy", C(DAILY_SQL + f""" select count(*) as days, {R('avg(acc)')} mean_accuracy, {R('stddev_pop(acc)')} std_accuracy,
  {R('avg(ll)')} mean_log_loss, {R('stddev_pop(ll)')} std_log_loss from daily"""))
def a17(spark, d):
    p = predictions(spark, d)
    loss = -F.log(F.when(F.col("actual") == 0, F.col("p_h")).when(F.col("actual") == 1, F.col("p_d")).otherwise(F.col("p_a")))
    daily = a.daily_accuracy(p, loss)
    return daily.agg(F.count(F.lit(1)).alias("days"), r6(F.avg("accuracy")).alias("mean_accuracy"), r6(F.stddev_pop("accuracy")).alias("std_accuracy"),
                     r6(F.avg("log_loss")).alias("mean_log_loss"), r6(F.stddev_pop("log_loss")).alias("std_log_loss"))


@query("a18_selection_frequency", C(f""", runs as (select season, pool, avg(home_xg) > 2 s1, avg(away_xg) > 2 s2, avg(home_goals) > 1.7 s3 from contests group by 1, 2),
  picked as (select 'home_xg' feature from runs where s1 union all select 'away_xg' from runs where s2 union all select 'home_goals' from runs where s3)
  select feature, count(*) n, {R('count(*) / cast((select count(*) from runs) as double)')} frequency from picked group by 1"""))
def a18(spark, d):
    pick = lambda c, lim: F.when(F.avg(c) > lim, F.lit(c))
    runs = contests(spark, d).groupBy("season", "pool").agg(
        F.array_compact(F.array(pick("home_xg", 2), pick("away_xg", 2), pick("home_goals", 1.7))).alias("selected"))
    return _r(a.selection_frequency(runs), ["frequency"], ["feature", "n"])


@query("a19_weighted_mean", f"select user_id, {R('sum(value * event_id) / sum(event_id)')} weighted_mean from events group by 1")
def a19(spark, d):
    return _r(a.weighted_mean(table(spark, d, "events"), "user_id", F.col("value"), F.col("event_id")), ["weighted_mean"], ["user_id"])


HIST_POOL = PRED_SQL + """, h as (select pool, season, avg(case when actual = pred then 1e0 else 0e0 end) acc from preds group by 1, 2)"""


def _pool_history(spark, d):
    return predictions(spark, d).groupBy("pool", "season").agg(F.avg((F.col("actual") == F.col("pred")).cast("double")).alias("acc"))


@query("a20_trend_recent_vs_old", C(HIST_POOL + f""", k as (select *, row_number() over (partition by pool order by season desc) rd,
   row_number() over (partition by pool order by season) ra, count(*) over (partition by pool) n from h),
   t as (select pool, avg(case when rd <= 3 then acc end) r, avg(case when ra <= greatest(1, n - 3) then acc end) o from k group by 1)
  select pool, {R('r')} recent, {R('o')} older, case when r > o then 'improving' else 'declining' end trend from t"""))
def a20(spark, d):
    return _r(a.trend_recent_vs_old(_pool_history(spark, d), ["pool"], "season", "acc"), ["recent", "older"], ["pool", "trend"])


@query("a21_coef_variation", C(HIST_POOL + f""" select pool, {R('avg(acc)')} mean, {R('stddev_samp(acc)')} std, {R('stddev_samp(acc) / avg(acc)')} cv,
   cast(stddev_samp(acc) / avg(acc) < 0.05e0 as integer) stable from h group by 1"""))
def a21(spark, d):
    return _r(a.coef_variation(_pool_history(spark, d), ["pool"], "acc"), ["mean", "std", "cv"], ["pool", "stable"])


@query("a22_result_mix", C(PRED_SQL + f""", x as (select actual v, count(*) n from preds group by 1), y as (select pred v, count(*) n from preds group by 1)
  select v as value, coalesce(x.n, 0) actual_n, coalesce(y.n, 0) pred_n, {R('coalesce(x.n, 0) / cast((select count(*) from preds) as double)')} actual_share,
   {R('coalesce(y.n, 0) / cast((select count(*) from preds) as double)')} pred_share from x full join y using (v)"""))
def a22(spark, d):
    return _r(a.mix(predictions(spark, d)), ["actual_share", "pred_share"], ["value", "actual_n", "pred_n"])


# --- O: order, top-k, sampling -----------------------------------------------------------------

@query("o01_order_by_time", C("select match_id, row_number() over (order by match_date, match_id) rn from contests"))
def o01(spark, d):
    return with_row_number(contests(spark, d), "match_date", "match_id").select("match_id", "rn")


@query("o02_head_tail", C("""(select match_id, 'head' side from contests order by match_date, match_id limit 100)
  union all (select match_id, 'tail' from contests order by match_date desc, match_id desc limit 100)"""))
def o02(spark, d):
    m = contests(spark, d).select("match_id", "match_date")
    head = s.first_n(m, [F.asc("match_date"), F.asc("match_id")], 100).withColumn("side", F.lit("head"))
    tail = s.first_n(m, [F.desc("match_date"), F.desc("match_id")], 100).withColumn("side", F.lit("tail"))
    return head.unionByName(tail).select("match_id", "side")


@query("o03_last_n_split", C("""select match_id, case when row_number() over (order by match_date desc, match_id desc) <= 380
  then 'test' else 'train' end part from contests"""))
def o03(spark, d):
    from formline.operators.evaluation import last_n_split
    return last_n_split(contests(spark, d), 380).select("match_id", "part")


@query("o04_top_bottom_k", L(f""", st as (select ent, sum(points) / cast(count(*) as double) v from long group by 1)
  select * from (select ent, {R('v')} v, 'top' side from st order by st.v desc, ent limit 5) union all
  select * from (select ent, {R('v')} v, 'bottom' side from st order by st.v, ent limit 5)"""))
def o04(spark, d):
    st = contests_long(spark, d).groupBy("ent").agg((F.sum("points") / F.count(F.lit(1))).alias("v"))
    return _r(s.top_bottom(st, "v", "ent", 5), ["v"], ["ent", "side"])


@query("o05_rank_features", C(f""", p as (select *, case result when 'H' then 0 when 'D' then 1 else 2 end actual from contests),
  k as (select 'home_xg' feature, corr(home_xg, actual) r from p union all select 'away_xg', corr(away_xg, actual) from p
    union all select 'home_shots', corr(home_shots, actual) from p)
  select feature, cast(row_number() over (order by abs(k.r) desc, feature) as integer) rank, {R('k.r')} r from k"""))
def o05(spark, d):
    from formline.operators.selection import rank_scores, target_correlation
    p = predictions(spark, d, shots=True)
    out = rank_scores(target_correlation(p, ["home_xg", "away_xg", "home_shots"], "actual"), F.abs("r"))
    return _r(out, ["r"], ["feature", "rank"])


@query("o06_sample", C("select match_id from contests order by md5('42:' || match_id), match_id limit 50"))
def o06(spark, d):
    return s.sample_n(contests(spark, d), "match_id", 50, 42).select("match_id")


@query("o06b_fraction_sample", C("select match_id from contests where cast('0x' || substr(md5('7:' || match_id), 1, 15) as bigint) < 1152921504606846976 // 8"))
def o06b(spark, d):
    return s.hash_sample(contests(spark, d), "match_id", 0.125, 7).select("match_id")


@query("o07_best_by", C(HIST_POOL + f" select pool, season, {R('acc')} acc from h order by h.acc desc, pool, season limit 1"))
def o07(spark, d):
    out = _pool_history(spark, d).orderBy(F.desc("acc"), "pool", "season").limit(1)
    return _r(out, ["acc"], ["pool", "season"])


# --- U: sets and reshaping ---------------------------------------------------------------------

@query("u01_union_all", C("select season, count(*) n from (select season from contests where season < 1997 union all select season from contests where season >= 1997) group by 1"))
def u01(spark, d):
    old, new = (contests(spark, d, **days).select("match_id", "season") for days in (season_days(last=1996), season_days(1997)))
    return old.unionByName(new).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("u02_set_operations", C(""", l as (select home, away from contests where season < 1998), r as (select home, away from contests where season >= 1998)
  select 'both' kind, home, away from (select * from l intersect select * from r)
  union all select 'left', home, away from (select * from l except select * from r)
  union all select 'right', home, away from (select * from r except select * from l)"""))
def u02(spark, d):
    left, right = (contests(spark, d, **days).select("home", "away") for days in (season_days(last=1997), season_days(1998)))
    parts = {"both": left.intersect(right), "left": left.subtract(right), "right": right.subtract(left)}
    out = None
    for kind, df in parts.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


@query("u03_drop_duplicates", C("select home, away, match_id from contests qualify row_number() over (partition by home, away order by match_date, match_id) = 1"))
def u03(spark, d):
    m = contests(spark, d).select("home", "away", "match_date", "match_id")
    return s.first_per_key(m, ["home", "away"], [F.col("match_date"), F.col("match_id")]).select("home", "away", "match_id")


@query("u04_duplicates", C("select cast(match_date as varchar) match_date, home, count(*) n from contests group by match_date, home having count(*) > 1"))
def u04(spark, d):
    return s.duplicates(contests(spark, d), ["match_date", "home"]).select(day_text(), "home", "n")


@query("u05_to_long", L(f"select match_id, season, ent, opp, venue, gf, ga, points, res, {R('xg')} xg, {R('shots')} shots, corners from long"))
def u05(spark, d):
    return _r(contests_long(spark, d, shots=True), ["xg", "shots"], ["match_id", "season", "ent", "opp", "venue", "gf", "ga", "points", "res", "corners"])


@query("u06_to_wide", C(f"select match_id, home home_ent, away away_ent, home_goals home_gf, away_goals away_gf, {R('home_xg')} home_xg, {R('away_xg')} away_xg from contests"))
def u06(spark, d):
    out = s.to_wide(contests_long(spark, d), ["ent", "gf", "xg"])
    return _r(out, ["home_xg", "away_xg"], ["match_id", "home_ent", "away_ent", "home_gf", "away_gf"])


@query("u07_melt_metrics", C(f"""select match_id, 'home_xg' metric, {R('home_xg')} as value from contests union all
  select match_id, 'home_goals', {R('home_goals')} from contests"""))
def u07(spark, d):
    return _r(s.melt(contests(spark, d), ["match_id"], ["home_xg", "home_goals"]), ["value"], ["match_id", "metric"])


@query("u08_unordered_pair_key", C("select least(home, away) lo, greatest(home, away) hi, count(*) n from contests group by 1, 2"))
def u08(spark, d):
    return contests(spark, d).groupBy(F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("u09_enumerate_pairs", C(" union all ".join(f"select '{x}' f1, '{y}' f2, count(case when {x} is not null and {y} is not null then 1 end) n from contests"
    for i, x in enumerate(ODDS) for y in ODDS[i + 1:])))
def u09(spark, d):
    from formline.operators.selection import column_pairs
    pairs = column_pairs(ODDS)
    one = contests(spark, d, odds=True).agg(*[F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias(f"{x}|{y}") for x, y in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("f1"), F.lit(y).alias("f2"), F.col(f"{x}|{y}").alias("n")) for x, y in pairs])))
