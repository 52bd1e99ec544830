"""Data-quality and temporal-leakage audits (V family).

Every audit yields rows ``check, subject, value, threshold, passed``. All rules on one table are
one aggregate, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formline.functions.scalar import outcome, safe_corr
from formline.operators import history as h
from formline.operators.ledger import attach, sums_before
from formline.operators.normalise import scalar_stats

# Limits of the reference audits.
TOLERANCE = 0.01
DOMINANCE, SHARE_TOLERANCE = 0.5, 0.05
LOW_STD, LOW_VAR = 1e-3, 1e-10
MAX_SKEW, EXTREME_LOW, EXTREME_HIGH, MAX_EXTREME = 3.0, 0.1, 0.9, 0.5
MAX_TARGET_CORR, MAX_FUTURE_CORR = 0.3, 0.10
MAX_JUMP, MAX_JUMP_SHARE, MAX_BORDER_JUMP = 0.3, 0.05, 0.4
SHORT_HISTORY = 5
H2H_TOLERANCE = 0.3
DRIFT_LOW, DRIFT_HIGH, DRIFT_MEAN = 0.5, 2.0, 0.2
OUTSIDE_LOW, OUTSIDE_HIGH, OUTSIDE_SHARE = -0.5, 1.5, 0.05
MAX_STEP, RATING_LOW, RATING_HIGH = 50.0, 800.0, 2200.0
SAFE_GAP_DAYS, MIN_DAYS, MAX_DAYS = 30, 30, 400
PLAUSIBLE = {"xg_eff": (0.25, 3.5), "xg_mean_5": (0.0, 5.0), "xg_mean_10": (0.0, 5.0), "gf_sum_5": (0.0, 25.0), "gf_sum_10": (0.0, 50.0)}
SAME = 1e-10


@dataclass(frozen=True)
class Rule:
    check: str
    subject: str
    value: Column
    threshold: float
    ok: Callable[[Column, float], Column]
    if_null: int = 1


def at_most(v: Column, t: float) -> Column:
    return v <= t


def below(v: Column, t: float) -> Column:
    return v < t


def at_least(v: Column, t: float) -> Column:
    return v >= t


def above(v: Column, t: float) -> Column:
    return v > t


def _inline(one: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = []
    for i, r in enumerate(rules):
        v = F.col(f"v{i}")
        rows.append(F.struct(F.lit(r.check).alias("check"), F.lit(r.subject).alias("subject"), v.alias("value"),
                             F.lit(float(r.threshold)).alias("threshold"),
                             F.coalesce(r.ok(v, r.threshold).cast("int"), F.lit(r.if_null)).alias("passed")))
    return one.select(F.inline(F.array(*rows)))


def audit(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return _inline(df.agg(*[r.value.cast("double").alias(f"v{i}") for i, r in enumerate(rules)]), rules)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def share_if(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def schema_and_domain(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[int]) -> DataFrame:
    """Missing and extra columns, nulls, values outside [0, 1] and unknown targets."""
    missing = [f for f in features if f not in df.columns]
    extra = [c for c in df.columns if c not in (*features, label)]
    rules = [Rule("missing_columns", ",".join(missing), F.max(F.lit(len(missing))), 0, at_most),
             Rule("extra_columns", ",".join(extra), F.max(F.lit(len(extra))), 0, at_most),
             Rule("bad_target", label, count_if(~F.coalesce(F.col(label).isin(*classes), F.lit(False))), 0, at_most)]
    for f in features:
        if f in df.columns:
            rules += [Rule("nulls", f, count_if(F.col(f).isNull()), 0, at_most),
                      Rule("not_normalised", f, count_if((F.col(f) < 0) | (F.col(f) > 1)), 0, at_most)]
    return audit(df, rules)


def ranges(df: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0, tol: float = TOLERANCE) -> DataFrame:
    rules = []
    for c in cols:
        x = F.col(c).cast("double")
        rules += [Rule("min", c, F.min(x), lo - tol, at_least), Rule("max", c, F.max(x), hi + tol, at_most),
                  Rule("infinite", c, count_if(F.isnan(x) | (F.abs(x) == float("inf"))), 0, at_most)]
    return audit(df, rules)


def derived(df: DataFrame, pairs: Mapping[str, Column], tol: float = 1e-6) -> DataFrame:
    return audit(df, [Rule("derived", c, F.max(F.abs(F.col(c) - v)), tol, at_most) for c, v in pairs.items()])


def slice_expectations(df: DataFrame, rules: Sequence[tuple[str, Column, Column, float, float]]) -> DataFrame:
    """(name, slice, value, low, high): the mean of the slice must lie in the range."""
    out = []
    for name, where, value, lo, hi in rules:
        mean = F.avg(F.when(where, value))
        out += [Rule("slice_low", name, mean, lo, at_least), Rule("slice_high", name, mean, hi, at_most)]
    return audit(df, out)


def dominance(df: DataFrame, cols: Sequence[str], limit: float = DOMINANCE) -> DataFrame:
    """Share of the most frequent value of each column. A value owning most rows combines map-side."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "subject", "v")
    per = long.groupBy("subject", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("subject").agg(
        F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("m"), F.sum("n").alias("t"))
    value = F.col("m") / F.col("t")
    return per.select(F.lit("dominance").alias("check"), "subject", value.alias("value"), F.lit(limit).alias("threshold"),
                      (value <= limit).cast("int").alias("passed"))


def class_balance(df: DataFrame, label: str, expected: Mapping[str, float], tol: float = SHARE_TOLERANCE) -> DataFrame:
    share = {k: F.avg((F.col(label) == k).cast("double")) for k in expected}
    rules = [Rule("class_share_gap", k, F.abs(share[k] - v), tol, at_most) for k, v in expected.items()]
    rules.append(Rule("class_spread", label, F.greatest(*share.values()) - F.least(*share.values()), 0.3, at_most))
    return audit(df, rules)


def result_consistency(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    rules = [Rule("result_mismatch", "result", count_if(F.col("result") != outcome(F.col("home_goals"), F.col("away_goals"))), 0, at_most)]
    rules += [Rule("negative", m, count_if(F.col(m) < 0), 0, at_most) for m in measures]
    return audit(df, rules)


def low_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rules = []
    for c in cols:
        rules += [Rule("std", c, F.stddev_samp(c), LOW_STD, at_least, 0), Rule("variance", c, F.var_samp(c), LOW_VAR, at_least, 0)]
    return audit(df, rules)


def skew_and_extremes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rules = []
    for c in cols:
        rules += [Rule("skewness", c, F.abs(F.skewness(c)), MAX_SKEW, at_most),
                  Rule("extreme_share", c, F.avg(F.when(F.col(c).isNotNull(), ((F.col(c) < EXTREME_LOW) | (F.col(c) > EXTREME_HIGH)).cast("double"))),
                       MAX_EXTREME, at_most)]
    return audit(df, rules)


def forbidden_columns(df: DataFrame, deny: Sequence[str]) -> DataFrame:
    """A schema check: one row per forbidden name; no column is read for it."""
    return audit(df, [Rule("forbidden", c, F.max(F.lit(int(c in df.columns))), 0, at_most) for c in deny])


def target_correlation(df: DataFrame, cols: Sequence[str], label: str, limit: float = MAX_TARGET_CORR) -> DataFrame:
    return audit(df, [Rule("target_corr", c, F.abs(safe_corr(F.col(c), F.col(label))), limit, at_most) for c in cols])


def future_correlation(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str] = ("pool",),
                       limit: float = MAX_FUTURE_CORR) -> DataFrame:
    """Correlation of each feature with the target of the next one to three rows."""
    lead = h.row_neighbour(df, keys, label, [-1, -2, -3])
    return audit(lead, [Rule(f"future_corr_{k}", c, F.abs(safe_corr(F.col(c), F.col(f"{label}_lead{k}"))), limit, at_most)
                        for c in cols for k in (1, 2, 3)])


def warm_up(df: DataFrame, cols: Sequence[str], games: str = "games") -> DataFrame:
    """Share of NULLs among rows without any history: a shifted feature must be empty there."""
    fresh = F.col(games) == 0
    return audit(df, [Rule("warm_up_nulls", c, F.avg(F.when(fresh, F.col(c).isNull().cast("double"))), 0.5, at_least) for c in cols])


def jumps(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    lag = h.row_neighbour(df, keys, col, [1])
    step = F.abs(F.col(col) - F.col(f"{col}_lag1"))
    big = F.when(step.isNotNull(), (step > MAX_JUMP).cast("double"))
    return audit(lag, [Rule("jump_share", col, F.avg(big), MAX_JUMP_SHARE, at_most)])


def border_jumps(df: DataFrame, col: str) -> DataFrame:
    """Largest change of an entity's value from the end of one season to the start of the next."""
    ends = h.season_border(df, col)
    return audit(ends, [Rule("border_jump", col, F.max(F.abs(F.col("next_first") - F.col("last_value"))), MAX_BORDER_JUMP, at_most)])


def neutral_when_short(df: DataFrame, col: str, games: str, least: int = SHORT_HISTORY, neutral: float = 0.5) -> DataFrame:
    bad = (F.col(games) < least) & (F.abs(F.col(col) - neutral) > SAME)
    return audit(df, [Rule("neutral_required", col, count_if(bad), 0, at_most)])


def recomputed(df: DataFrame, stored: str, fresh: str, tol: float = H2H_TOLERANCE) -> DataFrame:
    return audit(df, [Rule("recomputed", stored, F.max(F.abs(F.col(stored) - F.col(fresh))), tol, at_most),
                      Rule("recomputed_rows", stored, count_if(F.abs(F.col(stored) - F.col(fresh)) > tol), 0, at_most)])


def split_integrity(df: DataFrame, part: str = "part") -> DataFrame:
    """Order, emptiness and overlap of days and seasons between train and test; one pass plus two small groupings."""
    is_train, is_test = F.col(part) == "train", F.col(part) == "test"
    day = lambda fn, cond: fn(F.when(cond, F.unix_date("match_date")))
    order = audit(df, [
        Rule("train_rows", part, count_if(is_train), 1, at_least), Rule("test_rows", part, count_if(is_test), 1, at_least),
        Rule("gap_days", part, day(F.min, is_test) - day(F.max, is_train), 0, above)])

    def shared(col: str) -> DataFrame:
        per = df.groupBy(col).agg(F.max(is_train.cast("int")).alias("a"), F.max(is_test.cast("int")).alias("b"))
        return audit(per, [Rule("shared", col, F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)), 0, at_most)])

    return order.unionByName(shared("match_date")).unionByName(shared("season"))


def split_drift(df: DataFrame, cols: Sequence[str], part: str = "part") -> DataFrame:
    rules = []
    for c in cols:
        tr, te = (F.when(F.col(part) == p, F.col(c).cast("double")) for p in ("train", "test"))
        ratio = F.try_divide(F.max(te) - F.min(te), F.max(tr) - F.min(tr))
        rules += [Rule("range_ratio_low", c, ratio, DRIFT_LOW, at_least), Rule("range_ratio_high", c, ratio, DRIFT_HIGH, at_most),
                  Rule("mean_shift", c, F.abs(F.avg(te) - F.avg(tr)), DRIFT_MEAN, at_most)]
    return audit(df, rules)


def global_normalisation(df: DataFrame, cols: Sequence[str], part: str = "part") -> DataFrame:
    """Test rows standardised with train statistics: too few outside [-0.5, 1.5] hints at a global fit."""
    train = df.filter(F.col(part) == "train")
    st = scalar_stats(train.agg(*[a for c in cols for a in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))]))
    test = df.filter(F.col(part) == "test").withColumn("_st", st)
    z = lambda c: F.try_divide(F.col(c) - F.col(f"_st.{c}_m"), F.col(f"_st.{c}_s"))
    return audit(test, [Rule("outside_share", c, F.avg(((z(c) < OUTSIDE_LOW) | (z(c) > OUTSIDE_HIGH)).cast("double")), OUTSIDE_SHARE, at_least)
                        for c in cols])


def monotone_order(df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = 1 << 20) -> DataFrame:
    """Rows whose ``value`` falls below that of the previous row in ``order``; ordered in blocks of ids."""
    cut = df.withColumns({"_blk": F.floor(F.col(order) / block), "_val": F.unix_date(value)})
    lag = h.row_neighbour(cut, keys, "_val", [1], t="_blk", id=order)
    return audit(lag, [Rule("reversals", value, count_if(F.col("_val") < F.col("_val_lag1")), 0, at_most)])


def rating_invariants(hist: DataFrame, final_sum: Column, start_sum: Column, step: Column) -> DataFrame:
    return audit(hist, [Rule("zero_sum", "elo", F.abs(final_sum - start_sum), 1e-3, at_most),
                        Rule("max_step", "elo", F.max(F.abs(step)), MAX_STEP, at_most),
                        Rule("min_rating", "elo", F.min(F.least("home_elo", "away_elo")), RATING_LOW, at_least),
                        Rule("max_rating", "elo", F.max(F.greatest("home_elo", "away_elo")), RATING_HIGH, at_most)])


def counter_invariants(state: DataFrame, window: Column, w: int) -> DataFrame:
    total = F.col("wins") + F.col("draws") + F.col("losses")
    return audit(state, [Rule("record_adds_up", "games", count_if(total != F.col("games")), 0, at_most),
                         Rule("points_add_up", "points", count_if(F.col("points") != 3 * F.col("wins") + F.col("draws")), 0, at_most),
                         Rule("negative", "goals", count_if((F.col("goals_for") < 0) | (F.col("goals_against") < 0)), 0, at_most),
                         Rule("window_length", "last", F.max(window), w, at_most)])


def state_cutoff(state: DataFrame, test: DataFrame, cutoff: Column) -> DataFrame:
    """The state ends before the test starts; entities of the test unknown to the state."""
    late = audit(state, [Rule("late_state", "last_day", count_if(F.col("last_day") >= cutoff), 0, at_most)])
    unknown = test.select(F.explode(F.array("home", "away")).alias("ent")).distinct().join(state.select("ent"), "ent", "left_anti")
    return late.unionByName(audit(unknown, [Rule("unknown_entities", "ent", F.count(F.lit(1)), 0, at_most)]))


def determinism(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two computations of one table agree row by row (order-insensitive digest of all rows)."""
    def digest(df: DataFrame) -> Column:
        row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
        return df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"),
                               F.sum(F.pmod(row, F.lit(2147483647)).cast("decimal(20,0)")).alias("s")).alias("d")).scalar()
    carrier = one.sparkSession.range(1)
    same = (digest(one) == digest(two)).cast("int")
    return audit(carrier.select(same.alias("same")), [Rule("deterministic", "rows", F.max("same"), 1, at_least)])


def predict_before_update(long: DataFrame) -> DataFrame:
    """The state a game sees must not yet hold the game: strictly fewer games than the state after its day."""
    one = {"games": F.count(F.lit(1))}
    before = sums_before(long, ["ent"], "match_date", one).withColumnRenamed("games", "before")
    days = long.groupBy("ent", "match_date").agg(F.count(F.lit(1)).alias("today"))
    after = days.withColumn("after", F.sum("today").over(W.partitionBy("ent").orderBy("match_date")))
    seen = attach(attach(long, before, ["ent"], "match_date"), after.drop("today"), ["ent"], "match_date")
    start = F.coalesce("before", F.lit(0))
    return audit(seen, [Rule("update_leaks", "games", count_if(start >= F.col("after")), 0, at_most)])


def test_period(df: DataFrame, part: str = "part") -> DataFrame:
    train = F.max(F.when(F.col(part) == "train", F.unix_date("match_date")))
    start = F.min(F.when(F.col(part) == "test", F.unix_date("match_date")))
    end = F.max(F.when(F.col(part) == "test", F.unix_date("match_date")))
    return audit(df, [Rule("start_before_end", "test", end - start, 0, above), Rule("after_training", "test", start - train, 0, above),
                      Rule("advised_gap", "test", start - train, SAFE_GAP_DAYS, at_least),
                      Rule("min_length", "test", end - start, MIN_DAYS, at_least), Rule("max_length", "test", end - start, MAX_DAYS, at_most)])


def plausible(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    rules = []
    for c, (lo, hi) in bounds.items():
        if c not in df.columns:
            rules.append(Rule("missing_column", c, F.max(F.lit(1)), 0, at_most))
        else:
            rules += [Rule("below_range", c, count_if(F.col(c) < lo), 0, at_most), Rule("above_range", c, count_if(F.col(c) > hi), 0, at_most)]
    return audit(df, rules)


def integrity_level(rows: DataFrame, warnings: Sequence[str] = ()) -> DataFrame:
    """EXCELLENT/GOOD/ACCEPTABLE without failures, else CONCERNS (one) or CRITICAL."""
    warn = F.col("check").isin(*warnings) if warnings else F.lit(False)
    bad = F.col("passed") == 0
    one = rows.agg(count_if(bad & ~warn).alias("failures"), count_if(bad & warn).alias("warnings"))
    f, w = F.col("failures"), F.col("warnings")
    return one.withColumn("level", F.when(f > 1, "CRITICAL").when(f == 1, "CONCERNS").when(w == 0, "EXCELLENT").when(w < 5, "GOOD")
                          .otherwise("ACCEPTABLE"))


def compare_versions(old: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """(stat, old, new, diff) of one feature in two versions of a table."""
    stats = {"mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col),
             "extreme_share": F.avg(F.when(F.col(col).isNotNull(), ((F.col(col) < EXTREME_LOW) | (F.col(col) > EXTREME_HIGH)).cast("double")))}
    one = lambda df: df.agg(*[v.cast("double").alias(k) for k, v in stats.items()])
    both = one(old).withColumn("_n", one(new).select(F.struct("*")).scalar())
    return both.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("old"), F.col("_n")[k].alias("new"),
                                                   (F.col("_n")[k] - F.col(k)).alias("diff")) for k in stats])))
