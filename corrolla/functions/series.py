"""Column builders over an ordered series. Every window is partitioned: by panel, scenario, trial or fold."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def series(*keys: str, order: str = "rn") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def pad(c: Column, w: WindowSpec) -> Column:
    """The last value that isn't missing."""
    return F.last(c, ignorenulls=True).over(upto(w))


def backfill(c: Column, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def simple_return(padded: Column, w: WindowSpec) -> Column:
    return padded / F.lag(padded).over(w) - 1


def forward_return(c: Column, w: WindowSpec, n: int) -> Column:
    return F.lead(c, n).over(w) / c - 1


def _z(c: Column, w: WindowSpec, least: int, ddof: int = 1, floor: float | None = None) -> Column:
    sd = (F.stddev_samp if ddof else F.stddev_pop)(c).over(w)
    sd = F.greatest(sd, F.lit(floor)) if floor is not None else F.nullif(sd, F.lit(0.0))
    return F.when(F.count(c).over(w) >= least, (c - F.avg(c).over(w)) / sd)


def expanding_z(c: Column, w: WindowSpec, least: int = 30, floor: float | None = None) -> Column:
    """Against the mean and sample deviation of all rows so far, this one included; null before `least` values."""
    return _z(c, upto(w), least, 1, floor)


def rolling_z(c: Column, w: WindowSpec, n: int = 90, least: int | None = None, ddof: int = 0) -> Column:
    return _z(c, trailing(w, n), max(20, n // 3) if least is None else least, ddof)


def full_z(c: Column, *keys: str) -> Column:
    """Against the whole series: looks ahead."""
    w = Window.partitionBy(*keys)
    return (c - F.avg(c).over(w)) / F.stddev_samp(c).over(w)


def corr(x, y, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation; null where a side is flat, which the built-in one refuses. Both sides must be present."""
    over = lambda c: c if frame is None else c.over(frame)
    return F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))


def rolling_corr(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    frame = trailing(w, n)
    return F.when(F.count(x + y).over(frame) == n, corr(x, y, frame))


def trailing_z(c: Column, w: WindowSpec, n: int = 28) -> Column:
    """Against the n rows before this one."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) >= n, (c - F.avg(c).over(frame)) / F.nullif(F.stddev_samp(c).over(frame), F.lit(0.0)))


def trailing_window_z(c: Column, w: WindowSpec, ahead: int = 10, n: int = 28) -> Column:
    """The mean of this row and the next ones, `ahead` in all, against the n rows before."""
    frame = w.rowsBetween(-n, -1)
    mean = F.avg(c).over(w.rowsBetween(0, ahead - 1))
    enough = (F.count(c).over(frame) >= n) & (F.count(c).over(w.rowsBetween(0, ahead - 1)) >= ahead)
    return F.when(enough, (mean - F.avg(c).over(frame)) / F.nullif(F.stddev_samp(c).over(frame), F.lit(0.0)))


def delta(c: Column, w: WindowSpec, pre: int = 30, post: int = 30, least: int = 15, scaled: bool = False) -> Column:
    """Mean of the `post` rows from here less that of the `pre` rows before; scaled: in the latter's deviations."""
    before, after = w.rowsBetween(-pre, -1), w.rowsBetween(0, post - 1)
    d = F.avg(c).over(after) - F.avg(c).over(before)
    if scaled:
        d = d / F.nullif(F.stddev_pop(c).over(before), F.lit(0.0))
    return F.when((F.count(c).over(before) >= least) & (F.count(c).over(after) >= least), d)


def hysteresis(on: Column, w: WindowSpec, hold: int = 5, position: str = "rn") -> Column:
    """On wherever the raw signal was on less than `hold` rows ago: each stretch lasts hold - 1 rows longer."""
    last = F.max(F.when(on, F.col(position))).over(upto(w))
    return F.coalesce(F.col(position) - last < hold, F.lit(False))


def changed(c: Column, w: WindowSpec) -> Column:
    return F.coalesce(c != F.lag(c).over(w), F.lit(False))


def growth(r: Column, w: WindowSpec) -> Column:
    return F.product(1 + r).over(upto(w))


def drawdown(equity: Column, w: WindowSpec) -> Column:
    return equity / F.max(equity).over(upto(w)) - 1


def rebased(c: Column, w: WindowSpec, to: float = 100.0) -> Column:
    return c / F.first(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * to


def average_rank(c: Column, *keys: str) -> Column:
    """Ranks in which ties share their mean."""
    order = Window.partitionBy(*keys).orderBy(c)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2


def classify(e_div: Column, z_l1: Column) -> Column:
    """Regimes in order of precedence; null scores fall through."""
    return (
        F.when(e_div >= 0.8, "policy").when(e_div <= -0.5, "strength").when(z_l1 >= 0.7, "volatile").otherwise("calm")
    )


def trade_action(prev: Column, new: Column) -> Column:
    """What a change of regime asks for."""
    return (
        F.when(new.eqNullSafe(prev), "none")
        .when(new == "policy", "close")
        .when(new == "strength", "open_long")
        .when(prev.isin("policy", "strength"), "close_to_neutral")
        .otherwise("none")
    )


#: Signals by name: columns of z_l1, z_unb and e_div to a condition. A missing score is no signal.
SIGNALS = {
    "s1": lambda: F.col("e_div") >= 0.8,
    "s2": lambda: F.col("e_div") <= -0.5,
    "s3": lambda: F.abs("z_l1") >= 1,
    "s4": lambda: F.abs("z_unb") >= 1,
    "s5": lambda: (F.abs("z_l1") >= 1) | (F.abs("z_unb") >= 1),
    "s6": lambda: (F.abs("z_l1") >= 1) & (F.abs("z_unb") >= 1),
}
