"""M family, and the R operators that train models."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import boosting as bo
from formline.operators import evaluation as ev
from formline.operators import training as tr
from formline.operators.neighbours import exact_neighbours
from formline.plans.base_sql import C
from formline.plans.features import FeatureSet
from formline.plans.fixtures import PRED_SQL, predictions
from formline.plans.q_tables import DAILY_SQL
from formline.plans.registry import R, query, r6
from formline.sources.contests import contests, contests_long

CUT = "1999-08-01"
FEATURES = ["points_diff_normalized", "gf_diff_normalized", "h2h", "elo_diff_normalized"]


def _r(df, cols, keep=()):
    return df.select(*keep, *[r6(c).alias(c) for c in cols])


def matrix(spark, d):
    """Leak-free features with neutral fills, and the class code ``y``."""
    m = FeatureSet(xg=False, season=False).build(contests(spark, d), contests_long(spark, d))
    m = m.withColumns({f: F.coalesce(F.col(f), F.lit(0.5)) for f in FEATURES})
    y = F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).when(F.col("result") == "A", 2)
    return m.select("match_id", "match_date", "season", y.alias("y"), *FEATURES).filter("y is not null")


def as_pred(df):
    return df.withColumnRenamed("y", "actual")


# --- splits ------------------------------------------------------------------------------------

@query("m01_temporal_splits", C(f"""select match_id, case when match_date < date '{CUT}' then 'train' else 'test' end by_date,
  case when match_date <= date '1999-05-31' then 'train' when match_date >= date '{CUT}' then 'test' else 'gap' end by_gap,
  case when season in (1995, 1996, 1997) then 'train' when season in (1998, 1999) then 'test' end by_season from contests"""))
def m01(spark, d):
    m = ev.split_by_date(contests(spark, d), CUT).withColumnRenamed("part", "by_date")
    m = ev.split_with_gap(m, "1999-05-31", CUT).withColumnRenamed("part", "by_gap")
    return ev.split_by_season(m, [1995, 1996, 1997], [1998, 1999]).select("match_id", "by_date", "by_gap", F.col("part").alias("by_season"))


@query("m02_time_series_folds", C(""", n as (select count(*) n, count(*) // 6 s from contests)
  select match_id, cast(case when rn <= n - 5 * s then -1 else (rn - (n - 5 * s) - 1) // s end as integer) fold
  from (select match_id, row_number() over (order by match_date, match_id) rn from contests), n"""))
def m02(spark, d):
    return ev.time_series_folds(contests(spark, d), 5).select("match_id", "fold")


@query("m03_class_weights", C(f"""select match_id, {R('n / (3e0 * k)')} weight from (select match_id, count(*) over () n, count(*) over (partition by result) k from contests)"""))
def m03(spark, d):
    return _r(ev.class_weights(contests(spark, d), "result"), ["weight"], ["match_id"])


# --- training ----------------------------------------------------------------------------------

def _split(spark, d):
    data = tr.stored(tr.assemble(ev.split_by_date(matrix(spark, d), CUT), FEATURES), "matrix")
    return data.filter("part = 'train'"), data.filter("part = 'test'")


@query("m04_train_forest")
def m04(spark, d):
    train, test = _split(spark, d)
    model = tr.forest("y", tr.ForestParams(trees=30, depth=6), "weight").fit(ev.class_weights(train, "y"))
    imp = spark.createDataFrame(tr.importances(model, FEATURES), "feature string, importance double")
    score = tr.evaluate(tr.predict(model, test), "y").select(F.lit("accuracy").alias("feature"), F.col("accuracy").alias("importance"))
    return imp.unionByName(score)


@query("m05_train_logistic")
def m05(spark, d):
    train, test = _split(spark, d)
    return tr.evaluate(tr.predict(tr.logistic("y").fit(train), test), "y")


@query("m06_train_boosted")
def m06(spark, d):
    """One softmax over the three classes; ``first`` and ``last`` are the training loss before and after all rounds."""
    train, test = _split(spark, d)
    model = bo.boost(train, FEATURES, "y", rounds=20)
    score = tr.evaluate(bo.predict_boosted(model, test), "y")
    return score.withColumns({"first": F.lit(model.losses[0]), "last": F.lit(model.losses[-1])})


BOOST_EDGES = {"home_xg": [i / 4 for i in range(1, 16)], "away_xg": [i / 4 for i in range(1, 16)], "home_shots": [float(i) for i in range(10, 150, 10)]}


def _leaves_sql(depth: int = 2, rate: float = 0.1, l2: float = 1.0, least: float = 1.0) -> str:
    """The trees of the first round, grown level by level: p is 1 / 3 for every class."""
    bins = ", ".join(f"case when {c} is null then 0 else 1 + len(list_filter([{', '.join(repr(e) + 'e0' for e in edges)}], lambda e: e < {c})) end" for c, edges in BOOST_EDGES.items())
    cuts = max(len(e) for e in BOOST_EDGES.values()) + 1
    steps = [f", n0 as (select match_id, [{bins}] b, k, 0 node, 1e0 / 3 - cast(y = k as integer) g, 2e0 / 9 h from z, range(3) t(k))"]
    ends = []
    for level in range(depth + 1):
        steps.append(f"""
, s{level} as (select k, node, sum(g) g, sum(h) h from n{level} group by 1, 2)""")
        if level < depth:
            steps.append(f"""
, c{level} as (select k, node, f, b[f + 1] b, sum(g) g, sum(h) h from n{level}, range({len(BOOST_EDGES)}) t(f) group by 1, 2, 3, 4)
, l{level} as (select k, node, f, c, coalesce(sum(g) filter (where b <= c), 0) gl, coalesce(sum(h) filter (where b <= c), 0) hl from c{level}, range({cuts}) t(c) group by 1, 2, 3, 4)
, w{level} as (select k, node, f, c, {R(f'gl * gl / (hl + {l2}) + (g - gl) * (g - gl) / (h - hl + {l2}) - g * g / (h + {l2})', 9)} gain from l{level} join s{level} using (k, node) where hl >= {least} and h - hl >= {least})
, x{level} as (select k, node, f, c from (select *, row_number() over (partition by k, node order by gain desc, f, c) rn from w{level} where gain > 0) where rn = 1)
, n{level + 1} as (select match_id, b, k, 2 * node + case when b[f + 1] <= c then 1 else 2 end node, g, h from n{level} join x{level} using (k, node))""")
            ends.append(f"select k, node, cast(f as integer) feature, cast(c as integer) cut, 0e0 as value from x{level}")
            ends.append(f"select k, node, -1, 0, {R(f'-{rate} * g / (h + {l2})', 9)} from s{level} anti join x{level} using (k, node)")
        else:
            ends.append(f"select k, node, -1, 0, {R(f'-{rate} * g / (h + {l2})', 9)} from s{level}")
    return ", z as (select *, case result when 'H' then 0 when 'D' then 1 else 2 end y from contests)" + "".join(steps) + " select cast(k as integer) k, cast(node as integer) node, feature, cut, value from (" + " union all ".join(ends) + ")"


@query("m06b_boosted_leaves", C(_leaves_sql()))
def m06b(spark, d):
    """Cuts and leaf values of the first round's trees, one a class, on measures of the contests themselves."""
    y = F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).otherwise(2)
    model = bo.boost(contests(spark, d, shots=True).withColumn("y", y), list(BOOST_EDGES), "y", rounds=1, depth=2, edges=BOOST_EDGES)
    rows = spark.createDataFrame(bo.leaf_rows(model, 0), "k int, node int, feature int, cut int, value double")
    return rows.withColumn("value", r6("value", 9))


VOTE_SQL = PRED_SQL + """,
 v as (select match_id, pred p1, 0 p2, case when home_xg > away_xg then 0 when home_xg < away_xg then 2 else 1 end p3, p_h, p_d, p_a,
   1 / (1 + 1e0 + match_id % 2) q_h, 0.5e0 / (1 + 1e0 + match_id % 2) q_d, 1 - 1.5e0 / (1 + 1e0 + match_id % 2) q_a from preds)"""


@query("m07_hard_and_soft_vote", C(VOTE_SQL + f""", t as (select *, (p1 = 0)::int + (p2 = 0)::int + (p3 = 0)::int n0, (p1 = 1)::int + (p2 = 1)::int + (p3 = 1)::int n1,
   (p1 = 2)::int + (p2 = 2)::int + (p3 = 2)::int n2, (p_h + q_h) / 2 s0, (p_d + q_d) / 2 s1, (p_a + q_a) / 2 s2 from v)
  select match_id, case when n0 >= n1 and n0 >= n2 then 0 when n1 >= n2 then 1 else 2 end hard, {R('s0')} p_h, {R('s1')} p_d, {R('s2')} p_a from t"""))
def m07(spark, d):
    x, y = F.col("home_xg"), F.col("away_xg")
    p = predictions(spark, d).withColumns({"p2": F.lit(0), "p3": F.when(x > y, 0).when(x < y, 2).otherwise(1)})
    w = 1 + 1.0 + F.col("match_id") % 2
    probs = ev.soft_vote([[F.col(c) for c in ("p_h", "p_d", "p_a")], [1 / w, 0.5 / w, 1 - 1.5 / w]])
    return p.select("match_id", ev.hard_vote([F.col("pred"), F.col("p2"), F.col("p3")]).alias("hard"),
                    *[r6(c).alias(n) for c, n in zip(probs, ("p_h", "p_d", "p_a"))])


@query("m07b_stacking")
def m07b(spark, d):
    folded = tr.with_folds(matrix(spark, d), FEATURES, "y", 3)
    data = tr.assemble(folded, FEATURES)
    base = [tr.stored(tr.out_of_fold(data, est, 3).drop("features"), "oof") for est in (tr.logistic("y"), tr.forest("y", tr.ForestParams(10, 5)))]
    wide, meta = tr.stack(base, "y")
    # The meta learner sees only folds before the last one and is scored on the last.
    wide = tr.stored(wide.join(base[0].select("match_id", "fold"), "match_id"), "stack")
    model = meta.fit(wide.filter("fold < 2"))
    return tr.evaluate(tr.predict(model, wide.filter("fold = 2")), "y")


@query("m08_grid_search")
def m08(spark, d):
    folded = tr.assemble(tr.with_folds(matrix(spark, d), FEATURES, "y", 2), FEATURES)
    grid = [tr.ForestParams(t, k) for t in (5, 10) for k in (3, 5)]
    rows = [(r["params"].trees, r["params"].depth, r["mean"], r["std"], r["train"]) for r in tr.grid_search(folded, grid, "y", 2)]
    return spark.createDataFrame(rows, "trees int, depth int, mean double, std double, train double")


@query("m09_isotonic_calibration")
def m09(spark, d):
    data = tr.assemble(tr.with_folds(matrix(spark, d), FEATURES, "y", 3), FEATURES)
    oof = tr.stored(tr.out_of_fold(data, tr.forest("y", tr.ForestParams(10, 5)), 3).drop("features"), "oof")
    models = tr.fit_calibrator(oof.filter("fold < 2"), "y")
    cal = tr.calibrate(oof.filter("fold = 2"), models)
    raw = tr.evaluate(cal, "y").withColumn("kind", F.lit("raw"))
    new = cal.select("y", *[F.col(f"cal_{p}").alias(p) for p in ("p_h", "p_d", "p_a")])
    new = new.withColumn("pred", ev.arg_max([F.col(p) for p in ("p_h", "p_d", "p_a")]))
    return raw.unionByName(tr.evaluate(new, "y").withColumn("kind", F.lit("calibrated")))


_CAS = ", ".join(f"case when p_d >= {t}e0 then 1 when p_h / (p_h + p_a) >= 0.5e0 then 0 else 2 end c{int(t * 10)}" for t in (0.3, 0.4, 0.5))


@query("m10_cascade", C(PRED_SQL + f""" select match_id, {_CAS}, {R('(1 - p_d) * p_h / (p_h + p_a)')} q_h, {R('p_d')} q_d, {R('(1 - p_d) * (1 - p_h / (p_h + p_a))')} q_a from preds"""))
def m10(spark, d):
    side = F.col("p_h") / (F.col("p_h") + F.col("p_a"))
    p = predictions(spark, d)
    cls = {f"c{int(t * 10)}": ev.cascade(F.col("p_d"), side, t)[0] for t in (0.3, 0.4, 0.5)}
    probs = ev.cascade(F.col("p_d"), side, 0.3)[1]
    return p.select("match_id", *[c.alias(n) for n, c in cls.items()], *[r6(c).alias(n) for c, n in zip(probs, ("q_h", "q_d", "q_a"))])


@query("m10b_cascade_trained")
def m10b(spark, d):
    train, test = _split(spark, d)
    draw = tr.forest("is_draw", tr.ForestParams(10, 5)).fit(train.withColumn("is_draw", (F.col("y") == 1).cast("int")))
    side = tr.logistic("is_home").fit(train.filter("y <> 1").withColumn("is_home", (F.col("y") == 0).cast("int")))
    arr = tr.vector_to_array("probability")[1]
    both = draw.transform(test).withColumn("pd", arr).drop("rawPrediction", "probability", "prediction")
    both = side.transform(both).withColumn("ph", arr).drop("rawPrediction", "probability", "prediction")
    parts = []
    for t in (0.3, 0.4, 0.5):
        cls, probs = ev.cascade(F.col("pd"), F.col("ph"), t)
        scored = both.select("y", cls.alias("pred"), *[c.alias(n) for c, n in zip(probs, ("p_h", "p_d", "p_a"))])
        parts.append(tr.evaluate(scored, "y").withColumn("threshold", F.lit(t)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m11_oversample")
def m11(spark, d):
    synth = tr.oversample(matrix(spark, d), FEATURES, "y", 1, "match_id")
    return synth.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES])


RAW = ["home_xg", "away_xg", "home_goals", "away_goals"]


@query("m11b_exact_neighbours", C(f""", r as (select match_id, {', '.join(f'cast({c} as double) {c}' for c in RAW)} from contests where result = 'D' and home_xg is not null),
  d as (select a.match_id, b.match_id other, {' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in RAW)} d from r a join r b on a.match_id <> b.match_id),
  k as (select *, row_number() over (partition by match_id order by d, other) rn from d)
  select match_id, string_agg(other, ',' order by rn) near, {R('sqrt(max(d))')} radius from k where rn <= 5 group by 1"""))
def m11b(spark, d):
    """The neighbours that oversampling draws from, on the measures of drawn contests as they are."""
    m = contests(spark, d).filter("result = 'D' and home_xg is not null")
    near = exact_neighbours(m.select(F.col("match_id").cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in RAW]).alias("x")), 5).filter(F.size("nn") > 0)
    names = F.array_join(F.transform("nn", lambda c: c["id"].cast("string")), ",")
    return near.select(F.col("id").alias("match_id"), names.alias("near"), r6(F.element_at("nn", -1)["d"]).alias("radius"))


@query("m12_undersample_centroids")
def m12(spark, d):
    out = tr.undersample_centroids(matrix(spark, d), FEATURES, "y", 20, keep=[1])
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES])


# --- metrics -----------------------------------------------------------------------------------

@query("m13_confusion", C(PRED_SQL + """ select a.c actual, p.c pred, count(x.match_id) n from (values (0), (1), (2)) a(c)
  cross join (values (0), (1), (2)) p(c) left join preds x on x.actual = a.c and x.pred = p.c group by 1, 2"""))
def m13(spark, d):
    return ev.confusion(predictions(spark, d))


REPORT_SQL = PRED_SQL + """, c as (select k, sum(case when actual = k then 1 else 0 end) s, sum(case when pred = k then 1 else 0 end) q,
   sum(case when actual = k and pred = k then 1 else 0 end) h from preds, (values (0), (1), (2)) t(k) group by 1),
  m as (select cast(k as varchar) label, coalesce(h / nullif(cast(q as double), 0), 0) p, coalesce(h / nullif(cast(s as double), 0), 0) r, s from c),
  f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) f1 from m)"""


@query("m14_class_report", C(REPORT_SQL + f""" select label, {R('p')} as precision, {R('r')} recall, {R('f.f1')} f1, cast(s as bigint) support from f
  union all select 'macro', {R('avg(p)')}, {R('avg(r)')}, {R('avg(f.f1)')}, cast(sum(s) as bigint) from f
  union all select 'weighted', {R('sum(p * s) / sum(s)')}, {R('sum(r * s) / sum(s)')}, {R('sum(f.f1 * s) / sum(s)')}, cast(sum(s) as bigint) from f"""))
def m14(spark, d):
    return _r(ev.class_report(ev.confusion(predictions(spark, d))), ["precision", "recall", "f1"], ["label", "support"])


_ACC = lambda p: f"avg(case when part = '{p}' then case when actual = pred then 1e0 else 0e0 end end)"


@query("m15_accuracy_gap", C(PRED_SQL + f""", q as (select *, case when match_date < date '{CUT}' then 'train' else 'test' end part from preds),
  a as (select {_ACC('train')} tr, {_ACC('test')} te from q)
  select {R('tr')} train, {R('te')} test, {R('tr - te')} gap, {R('te - 0.3e0 * greatest(0, tr - te - 0.2e0)')} composite_wide,
   {R('te - 0.3e0 * greatest(0, tr - te - 0.15e0)')} composite_quick, {R('te - 0.2e0 * greatest(0, tr - te - 0.15e0)')} composite_bench from a"""))
def m15(spark, d):
    out = ev.gap_and_composite(ev.split_by_date(predictions(spark, d), CUT))
    return _r(out, out.columns)


LOSS_SQL = PRED_SQL + """, l as (select *, -ln(case actual when 0 then p_h when 1 then p_d else p_a end) loss from preds)"""


@query("m16_log_loss", C(LOSS_SQL + f" select season, {R('avg(loss)')} log_loss from l group by 1"))
def m16(spark, d):
    loss = ev.row_log_loss(F.col("actual"), [F.col(p) for p in ev.PROBS])
    return predictions(spark, d).groupBy("season").agg(r6(F.avg(loss)).alias("log_loss"))


@query("m17_roc_auc", C(PRED_SQL + f""", r as (select actual = 1 pos, rank() over (order by p_d) + (count(*) over (partition by p_d) - 1) / 2e0 k from preds)
  select {R('(sum(case when pos then k end) - count(case when pos then 1 end) * (count(case when pos then 1 end) + 1) / 2e0) / (cast(count(case when pos then 1 end) as double) * count(case when not pos then 1 end))')} auc from r"""))
def m17(spark, d):
    return _r(ev.roc_auc(predictions(spark, d), F.col("actual") == 1, "p_d"), ["auc"])


@query("m18_baselines", C(f""", s as (select result, count(*) / cast((select count(*) from contests) as double) s from contests group by 1),
  b as (select 'uniform' as name, 1 / cast(count(*) as double) v from s union all select 'majority', max(s) from s union all select 'weighted', sum(s * s) from s
    union all select 'home_always', max(case when result = 'H' then s end) from s)
  select name, {R('v')} as value, cast(v > 1/3e0 as integer) beats_random, cast(v > 0.436e0 as integer) beats_minimum, cast(v > 0.5e0 as integer) beats_good,
   cast(v > 0.55e0 as integer) beats_excellent from b"""))
def m18(spark, d):
    out = ev.baselines(predictions(spark, d), "actual")
    return out.withColumn("value", r6("value"))


@query("m19_bootstrap")
def m19(spark, d):
    p = predictions(spark, d)
    scores = ev.bootstrap_scores(p, F.col("pred") == F.col("actual"), F.col("actual") == 0, 1000, 42)
    return ev.bootstrap_summary(scores)


REPLICATES = 400


def _poisson_sql() -> str:
    limits = ev.poisson_limits()
    weight = "case " + " ".join(f"when u < {x} then {i}" for i, x in enumerate(limits)) + f" else {len(limits)} end"
    f1 = [f"coalesce(2e0 * sum(w) filter (where actual = {k} and pred = {k}) / nullif(coalesce(sum(w) filter (where actual = {k}), 0) + coalesce(sum(w) filter (where pred = {k}), 0), 0), 0)" for k in (0, 1, 2)]
    return f""", g as (select actual, pred, loss, g, md5('42:' || match_id || ':' || g) h from l, range({REPLICATES // 4}) t(g)),
  u as (select actual, pred, loss, g * 4 + i replicate, cast('0x' || substr(h, 8 * i + 1, 8) as bigint) u from g, range(4) t(i)),
  w as (select replicate, actual, pred, sum(w) w, sum(w * loss) loss from (select *, {weight} w from u) where w > 0 group by 1, 2, 3),
  s as (select replicate, sum(w) filter (where actual = pred) / sum(w) accuracy, ({' + '.join(f1)}) / 3 macro_f1, sum(loss) / sum(w) log_loss from w group by 1)"""


@query("m19b_poisson_bootstrap", C(LOSS_SQL + _poisson_sql() + " union all ".join(f"""{" " if c == "accuracy" else ""}select '{c}' metric, {R(f's.{c}'.join(['avg(', ')']))} mean,
  {R(f'stddev_pop(s.{c})')} std, {R(f'quantile_cont(s.{c}, 0.025)')} lo, {R(f'quantile_cont(s.{c}, 0.975)')} hi from s""" for c in ("accuracy", "macro_f1", "log_loss"))))
def m19b(spark, d):
    """Intervals of accuracy, F1 and log loss by weights drawn for each row and replicate."""
    loss = ev.row_log_loss(F.col("actual"), [F.col(c) for c in ev.PROBS])
    cells = ev.poisson_cells(predictions(spark, d), "match_id", REPLICATES, 42, ["actual", "pred"], {"loss": loss})
    out = ev.score_intervals(ev.replicate_scores(cells), ["accuracy", "macro_f1", "log_loss"])
    return _r(out, ["mean", "std", "lo", "hi"], ["metric"])


FOLD_SQL = PRED_SQL + """, f as (select season, avg(case when actual = pred then 1e0 else 0e0 end) a, avg(case when actual = 0 then 1e0 else 0e0 end) b from preds group by 1)"""


def _folds(spark, d):
    return predictions(spark, d).groupBy("season").agg(F.avg(ev.hit()).alias("a"), F.avg((F.col("actual") == 0).cast("double")).alias("b"))


@query("m20_paired_t", C(FOLD_SQL + f" select count(*) n, {R('avg(a - b)')} mean_diff, {R('avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))', 4)} t, count(*) - 1 df from f"))
def m20(spark, d):
    return ev.paired_t(_folds(spark, d), "a", "b").select("n", r6("mean_diff").alias("mean_diff"), r6("t", 4).alias("t"), "df")


@query("m21_run_spread", C(FOLD_SQL + f""" select count(*) runs, {R('min(a)')} as min, {R('max(a)')} as max, {R('avg(a)')} mean, {R('stddev_pop(a)')} std,
  {R('avg(a) - 2 * stddev_pop(a)')} lo, {R('avg(a) + 2 * stddev_pop(a)')} hi from f"""))
def m21(spark, d):
    return _r(ev.run_spread(_folds(spark, d), "a"), ["min", "max", "mean", "std", "lo", "hi"], ["runs"])


@query("m22_compare_runs", C(LOSS_SQL + f""", k as (select avg(case when actual = pred then 1e0 else 0e0 end) filter (where match_date < date '{CUT}') a,
   avg(loss) filter (where match_date < date '{CUT}') la, avg(case when actual = pred then 1e0 else 0e0 end) filter (where match_date >= date '{CUT}') b,
   avg(loss) filter (where match_date >= date '{CUT}') lb from l)
  select {R('a - b')} accuracy_diff, {R('la - lb')} log_loss_diff, case when abs(a - b) < 0.005e0 then 'Negligible' when abs(a - b) < 0.01e0 then 'Small'
   when abs(a - b) < 0.02e0 then 'Moderate' else 'Large' end impact, {R('greatest(0e0, a - b)')} leakage_estimate from k"""))
def m22(spark, d):
    p = predictions(spark, d)
    loss = ev.row_log_loss(F.col("actual"), [F.col(c) for c in ev.PROBS])
    one = lambda df: df.agg(F.avg(ev.hit()).alias("accuracy"), F.avg(loss).alias("log_loss"))
    day = F.lit(CUT).cast("date")
    out = ev.compare_runs(one(p.filter(F.col("match_date") < day)), one(p.filter(F.col("match_date") >= day)))
    return _r(out, ["accuracy_diff", "log_loss_diff", "leakage_estimate"], ["impact"])


@query("m23_daily_trend", C(DAILY_SQL + f""", i as (select *, row_number() over (order by match_date) - 1 i from daily), s as (select avg(acc) m, stddev_pop(acc) sd from daily)
  select {R('regr_slope(acc, cast(i as double))', 9)} slope, count(*) as days, count(case when acc < m - sd then 1 end) weak_days, count(case when acc > m + sd then 1 end) strong_days,
   case when abs(regr_slope(acc, cast(i as double))) < 0.001 then 'Stable' when regr_slope(acc, cast(i as double)) > 0 then 'Improving' else 'Declining' end direction from i, s"""))
def m23(spark, d):
    from formline.operators.aggregates import daily_accuracy
    out = ev.daily_trend(daily_accuracy(predictions(spark, d)))
    return out.withColumn("slope", r6("slope", 9))


@query("m24_regression_gate", C(FOLD_SQL + f" select season, {R('f.a')} a, case when f.a - 0.333e0 > 0 then 'improved' when f.a - 0.333e0 >= -0.01e0 then 'maintained' else 'regressed' end status from f"))
def m24(spark, d):
    return ev.gate(_folds(spark, d), "a", 0.333, 0.01).select("season", r6("a").alias("a"), "status")


@query("m25_leak_probe")
def m25(spark, d):
    m = matrix(spark, d).join(contests(spark, d).select("match_id", (F.col("home_goals") - F.col("away_goals")).cast("double").alias("goal_diff")), "match_id")
    rows = tr.leak_probe(m, [*FEATURES, "goal_diff"], "y", 5)
    return spark.createDataFrame(rows, "feature string, train double, cv double, gap double, suspicious int")


@query("r09_recursive_elimination")
def r09(spark, d):
    kept = tr.eliminate(matrix(spark, d), FEATURES, "y", 2, core=["elo_diff_normalized"])
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("r10_ablation")
def r10(spark, d):
    rows = tr.ablation(matrix(spark, d), FEATURES, "y", 5)
    return spark.createDataFrame(rows, "size int, added string, mean double, std double")
