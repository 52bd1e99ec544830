"""Column expressions: labels, dates, guarded arithmetic, contextual scores."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): outcome codes.
CLASS_CODE = {"H": 0, "D": 1, "A": 2}
SIGNED_CODE = {"H": 1, "D": 0, "A": -1}
VALUE_CODE = {"H": 2, "D": 1, "A": 0}
WIN_POINTS, DRAW_POINTS, LOSS_POINTS = 3, 1, 0
SEASON_START_MONTH = 8
EARLY_WEEK, MID_WEEK = 12, 26


def code(col: Column, mapping: Mapping[str, int]) -> Column:
    """CASE over a small mapping; anything else is NULL."""
    out = None
    for key, value in mapping.items():
        cond = col == key
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def points(gf: Column, ga: Column) -> Column:
    return F.when(gf > ga, WIN_POINTS).when(gf == ga, DRAW_POINTS).when(gf < ga, LOSS_POINTS)


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def season_start(date: Column) -> Column:
    """Year in which the August-July season of ``date`` began."""
    return F.year(date) - F.when(F.month(date) < SEASON_START_MONTH, 1).otherwise(0)


def season_label(date: Column) -> Column:
    first = season_start(date)
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def parse_date(col: Column, fmt: str | None = None) -> Column:
    """Lenient parse: what does not match becomes NULL instead of failing the job."""
    return F.try_to_timestamp(col, F.lit(fmt or "yyyy-MM-dd")).cast("date")


def clip(col: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (least/greatest alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col)))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def elo_expectation(own: Column, other: Column, scale: float = 400.0) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / scale))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def season_period(week: Column) -> Column:
    return F.when(week <= EARLY_WEEK, 0.0).when(week <= MID_WEEK, 0.5).when(week > MID_WEEK, 1.0)


def match_key(date: Column, home: Column, away: Column) -> Column:
    """Readable key. Joins use the typed columns, never this string."""
    return F.concat_ws("_", F.date_format(date, "yyyy-MM-dd"), home.cast("string"), away.cast("string"))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are present; NULL instead of an error on a constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rule_class(diff: Column, edge: float = 0.5) -> Column:
    return F.when(diff > edge, 0).when(diff < -edge, 2).otherwise(1)


# Accuracy thresholds of the performance bands.
BANDS = (("EXCELLENT", 0.55), ("GOOD", 0.50), ("ACCEPTABLE", 0.436))


def band(accuracy: Column) -> Column:
    out = None
    for name, floor in BANDS:
        out = F.when(accuracy > floor, name) if out is None else out.when(accuracy > floor, name)
    return out.otherwise("NEEDS_IMPROVEMENT")


def json_number(col: Column, path: str, default: float) -> Column:
    """A JSON number of any sign and size, decimals and exponents included; ``default`` where there is none."""
    return F.coalesce(F.get_json_object(col, path).try_cast("double"), F.lit(float(default)))


# Version marks in file names, removed in this order.
VERSION_MARKS = (r"_v?\d{4}_\d{2}_\d{2}_\d{6}", r"_\d{4}_\d{2}_\d{2}")


def strip_version(name: Column) -> Column:
    for mark in VERSION_MARKS:
        name = F.regexp_replace(name, mark, "")
    return name


def unescape_hex(col: Column) -> Column:
    r"""Text with ``\xNN`` escapes among plain characters to UTF-8; bytes that are no UTF-8 become the replacement sign."""
    def piece(p: Column, i: Column) -> Column:
        plain = lambda text: F.hex(F.encode(text, "UTF-8"))
        return F.when(i == 0, plain(p)).otherwise(F.concat(F.substring(p, 1, 2), plain(F.substring(p, 3, 1 << 30))))

    pieces = F.split(col, r"\\x(?=[0-9A-Fa-f]{2})")
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, piece), "")).cast("string"))


def md5_prefix(col: Column, n: int = 8) -> Column:
    return F.substring(F.md5(col), 1, n)


# --- arrays -----------------------------------------------------------------------------------

def tail(arr: Column, n: int) -> Column:
    """Last ``n`` items (slice with a negative start is empty on short arrays, hence the guard)."""
    return F.slice(arr, F.greatest(F.size(arr) - n + 1, F.lit(1)), n)


def push(arr: Column, item: Column, n: int) -> Column:
    """Bounded append; a missing item leaves the list untouched."""
    return F.when(item.isNull(), arr).otherwise(tail(F.concat(arr, F.array(item)), n))


def arr_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def arr_mean(arr: Column) -> Column:
    """Mean of the non-null items, NULL when there are none."""
    kept = F.filter(arr, lambda x: x.isNotNull())
    return F.try_divide(arr_sum(kept), F.size(kept))


def arr_std(arr: Column, ddof: int = 0) -> Column:
    kept = F.filter(arr, lambda x: x.isNotNull())
    mean = arr_mean(kept)
    dev = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean))
    size = F.size(kept)
    return F.when(size > ddof, F.sqrt(F.try_divide(dev, size - ddof)))


# --- contextual scores ------------------------------------------------------------------------

# Thresholds and weights of the contextual scores.
COLD, HOT, RAIN, WIND = 5.0, 25.0, 0.5, 15.0
COMFORT_TEMP = 15.0


def extreme_weather(temp: Column) -> Column:
    return F.when((temp < COLD) | (temp > HOT), 1).otherwise(0)


def adverse_weather(rain: Column, wind: Column) -> Column:
    return F.when((rain > RAIN) | (wind > WIND), 1).otherwise(0)


def weather_comfort(temp: Column, rain: Column, wind: Column) -> Column:
    return clip(1 - F.abs(temp - COMFORT_TEMP) / 20 - rain / 10 - wind / 30, 0.0, 1.0)


def fatigue_score(rest_adv: Column, congestion_gap: Column) -> Column:
    return clip(logistic(rest_adv - 2) - 0.1 * congestion_gap, 0.0, 1.0)


def rest_advantage(home_rest: Column, away_rest: Column) -> Column:
    return home_rest - away_rest


def congestion(d14: Column, d30: Column) -> Column:
    return d14 + 0.5 * d30


def alignment(h_short: Column, h_long: Column, a_short: Column, a_long: Column) -> Column:
    return (h_short * h_long > 0).cast("int") - (a_short * a_long > 0).cast("int")


def high_stakes(rivalry: Column, pressure: Column) -> Column:
    return clip(0.5 * rivalry + 0.5 * pressure, 0.0, 1.0)


def strictness(cards: Column, penalty_rate: Column) -> Column:
    return (cards / 6.0 + penalty_rate) / 2.0
