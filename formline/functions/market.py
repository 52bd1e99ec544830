"""Market (odds) features as row expressions; the few that need a fitted bound are normalised by the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline.functions.scalar import clip

# Fixed values of the reference formulas.
ENTROPY_EPS = 1e-10
FAIR_BASE, FAIR_SPAN = 0.15, 0.16
VALUE_SHIFT, VALUE_SPAN = 0.1, 0.2


def implied(odds: Column) -> Column:
    """1/odds; 0 when the price is not positive; NULL stays NULL."""
    return F.when(odds > 0, F.try_divide(F.lit(1.0), odds)).when(odds.isNotNull(), 0.0)


def overround(odds: Sequence[Column]) -> Column:
    return sum((implied(o) for o in odds[1:]), implied(odds[0]))


def margin_free(odds: Sequence[Column]) -> list[Column]:
    total = overround(odds)
    return [F.try_divide(implied(o), total) for o in odds]


def home_advantage(odds: Sequence[Column]) -> Column:
    p = margin_free(odds)
    return p[0] - p[2]


def entropy(probs: Sequence[Column]) -> Column:
    terms = [p * F.log(p + ENTROPY_EPS) for p in probs]
    return -sum(terms[1:], terms[0]) / math.log(3)


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-null values of one row."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    s = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.try_divide(s, n)


def row_std(cols: Sequence[Column]) -> Column:
    """Sample std of the non-null values of one row; fewer than two give NULL."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    mean = row_mean(cols)
    dev = [F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols]
    return F.when(n > 1, F.sqrt(sum(dev[1:], dev[0]) / (n - 1)))


def row_cv(cols: Sequence[Column]) -> Column:
    return F.try_divide(row_std(cols), row_mean(cols))


def row_range_share(cols: Sequence[Column]) -> Column:
    """(max - min) / mean over the books of one row."""
    return F.try_divide(F.greatest(*cols) - F.least(*cols), row_mean(cols))


def two_way(over: Column, under: Column) -> Column:
    return F.try_divide(implied(over), implied(over) + implied(under))


def move(early: Column, close: Column) -> Column:
    return F.try_divide(close - early, early)


def line_movement(early_h: Column, close_h: Column, early_a: Column, close_a: Column) -> Column:
    return move(early_h, close_h) - move(early_a, close_a)


def divergence(sharp_h: Column, public_h: Column, sharp_a: Column, public_a: Column) -> Column:
    return (implied(sharp_h) - implied(public_h)) - (implied(sharp_a) - implied(public_a))


def velocity(early_h: Column, close_h: Column, early_a: Column, close_a: Column) -> Column:
    return (F.abs(move(early_h, close_h)) + F.abs(move(early_a, close_a))) / 2


def draw_value(home: Column, away: Column, draw_books: Sequence[Column]) -> Column:
    ratio = F.try_divide(home, away)
    balance = 1 - F.abs(ratio - 1) / (ratio + 1)
    fair = FAIR_BASE + FAIR_SPAN * balance
    return clip((fair - row_mean([implied(b) for b in draw_books]) + VALUE_SHIFT) / VALUE_SPAN, 0.0, 1.0)


def draw_bias(home: Column, draw: Column, away: Column) -> Column:
    expected = 2 + 2 * F.abs(home - away) / (home + away)
    return clip((2 - draw / expected) / 2, 0.0, 1.0)


def closeness(home: Column, away: Column) -> Column:
    return 1 - F.abs(home - away) / (home + away)


def draw_opportunity(home: Column, draw: Column, away: Column) -> Column:
    return clip(closeness(home, away) * (draw - 3.0) / 2.0, 0.0, 1.0)
