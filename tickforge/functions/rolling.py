"""Windows over a symbol's rows in order, full-window aggregates, and scalar functions Spark lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def ordered(keys=("symbol",), order=ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def full(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int) -> Column:
    """agg(x) over the last n rows, null until there are n values."""
    last = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(last) >= n, agg(x).over(last))


def change(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def log_return(x: Column, w: WindowSpec) -> Column:
    """ln(x / previous x), null where either is not above 0."""
    ratio = F.when((x > 0) & (F.lag(x).over(w) > 0), x / F.lag(x).over(w))
    return F.ln(ratio)


def ratio(x: Column, y: Column) -> Column:
    """x / y of doubles where a divisor of 0 gives an infinity of x's sign, and 0 / 0 is NaN; null only for nulls."""
    x, y = x.cast("double"), y.cast("double")
    at_zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf"))
    return F.when(y != 0, F.try_divide(x, y)).when(y == 0, at_zero)


def tick_sign(price: Column, w: WindowSpec) -> Column:
    """The sign of the last price change that was not zero; 0 before there is one."""
    d = change(price, w)
    moved = F.when(d != 0, F.signum(d))
    return F.coalesce(F.last(moved, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-15 (Hart's rational approximation with a continued tail)."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    top = F.lit(3.52624965998911e-02)
    for c in (0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376):
        top = top * a + c
    low = F.lit(8.83883476483184e-02)
    for c in (1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752):
        low = low * a + c
    tail = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * top / low).otherwise(e / tail / 2.506628274631)
    return F.when(z > 0, 1 - upper).otherwise(upper)

