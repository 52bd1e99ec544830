from pyspark.sql import functions as F

from formline.operators import history as h


def _long(spark):
    rows = [(e, i, (e * 7 + i * i) % 3 - 1) for e, n in ((1, 12), (2, 4), (3, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "ent long, match_id long, res int").withColumn("match_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("match_id").cast("int")))


def _plain(res, current):
    """momentum_3, momentum_5 and acceleration of the last place of a list of results before the current one."""
    def mean(w, back):
        part = res[max(0, len(res) - back - w):max(0, len(res) - back)]
        return sum(part) / len(part) if part else None

    def mom(w, back=0):
        a, b = mean(w, back), mean(w, back + w)
        return 0.0 if a is None or b is None else a - b

    return mom(3), mom(5), mom(3) - mom(3, 1) if len(res) >= 2 else 0.0


def test_momentum_is_that_of_plain_lists(spark):
    rows = sorted(map(tuple, _long(spark).select("ent", "match_id", "res").collect()))
    for current in (False, True):
        got = {(r["ent"], r["match_id"]): (r["momentum_3"], r["momentum_5"], r["acceleration"]) for r in h.perf_momentum(_long(spark), current).collect()}
        assert len(got) == len(rows)
        for ent, i, _ in rows:
            all_ = [x for e, _, x in rows if e == ent]
            res = all_[:i + current][-(11 + current):]
            ok = len(all_) >= 5 if current else len(res) >= 5
            want = _plain(res, current) if ok else (0.0, 0.0, 0.0)
            assert all(abs(a - b) < 1e-9 for a, b in zip(got[ent, i], want)), (current, ent, i)


def test_the_list_is_built_once_a_row(spark):
    """Each column looked the whole list up again, some thirty times a row."""
    for current in (False, True):
        plan = h.perf_momentum(_long(spark), current)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("].res") + plan.count(".res,") <= 12, plan.count(".res")
