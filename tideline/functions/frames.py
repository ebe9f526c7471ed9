"""Column builders over the ordered rows of a key.

``Frame`` names the key and the order once; its methods return Columns. A rolling value is NULL until
the frame holds ``need`` non-null inputs (default: the full window), so warm-up rows never look like
data. Divisions are ``try_divide`` because ANSI mode raises on zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Col, b: Col) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ln_ratio(a: Col, b: Col) -> Column:
    """ln(a/b) where both are positive, else NULL."""
    return F.when((col(a) > 0) & (col(b) > 0), F.log(col(a) / col(b)))


class Frame:
    def __init__(self, keys: Sequence[str] = ("id",), order: Sequence[str] = ("ts",)):
        self.keys = tuple(keys)
        self.order = tuple(order)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def cum(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    def last_rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1 - n, Window.currentRow)

    def next_rows(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    # --- offsets -------------------------------------------------------------------------------
    def rn(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, x: Col, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.w)

    def lead(self, x: Col, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.w)

    def diff(self, x: Col, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def pct(self, x: Col, k: int = 1) -> Column:
        return div(x, self.lag(x, k)) - 1

    def log_return(self, x: Col, k: int = 1) -> Column:
        return ln_ratio(x, self.lag(x, k))

    def forward_return(self, x: Col, k: int = 1, log: bool = False) -> Column:
        ahead = self.lead(x, k)
        return ln_ratio(ahead, x) if log else div(ahead, x) - 1

    # --- rolling aggregates --------------------------------------------------------------------
    def guarded(self, agg: Column, x: Col, n: int, need: int | None = None) -> Column:
        w = self.last_rows(n)
        return F.when(F.count(col(x)).over(w) >= (n if need is None else need), agg.over(w))

    def mean(self, x: Col, n: int, need: int | None = None) -> Column:
        return self.guarded(F.avg(col(x)), x, n, need)

    def sum(self, x: Col, n: int, need: int | None = None) -> Column:
        return self.guarded(F.sum(col(x)), x, n, need)

    def max(self, x: Col, n: int, need: int | None = None) -> Column:
        return self.guarded(F.max(col(x)), x, n, need)

    def min(self, x: Col, n: int, need: int | None = None) -> Column:
        return self.guarded(F.min(col(x)), x, n, need)

    def std(self, x: Col, n: int, need: int | None = None, ddof: int = 1) -> Column:
        agg = F.stddev_samp(col(x)) if ddof else F.stddev_pop(col(x))
        return self.guarded(agg, x, n, need)

    def quantile(self, x: Col, q: float, n: int, need: int | None = None) -> Column:
        return self.guarded(F.percentile(col(x), q), x, n, need)

    def zscore(self, x: Col, n: int, need: int | None = None, ddof: int = 1) -> Column:
        return div(col(x) - self.mean(x, n, need), self.std(x, n, need, ddof))

    def slope(self, y: Col, x: Col, n: int, need: int | None = None) -> Column:
        """OLS slope of y on x over the last n rows."""
        both = F.when(col(y).isNotNull(), col(x))
        return self.guarded(F.regr_slope(col(y), both.cast("double")), y, n, need)

    def corr(self, a: Col, b: Col, n: int, need: int | None = None) -> Column:
        pa = F.when(col(b).isNotNull(), col(a))
        pb = F.when(col(a).isNotNull(), col(b))
        w = self.last_rows(n)
        value = F.try_divide(
            F.covar_samp(pa, pb).over(w), F.stddev_samp(pa).over(w) * F.stddev_samp(pb).over(w)
        )
        return F.when(F.count(pa).over(w) >= (n if need is None else need), value)

    def moments(self, x: Col, n: int, need: int | None = None) -> tuple[Column, Column]:
        """Bias-corrected skewness and excess kurtosis of the last n rows (n > 3 values)."""
        w = self.last_rows(n)
        c = F.count(col(x)).over(w).cast("double")
        g1 = F.skewness(col(x)).over(w)
        g2 = F.kurtosis(col(x)).over(w)
        ok = c >= (n if need is None else need)
        skew = F.when(ok & (c > 2), F.sqrt(c * (c - 1)) / F.nullif(c - 2, F.lit(0.0)) * g1)
        kurt = F.when(
            ok & (c > 3),
            F.try_divide((c - 1) * ((c + 1) * g2 + 6), (c - 2) * (c - 3)),
        )
        return skew, kurt

    def wma(self, x: Col, n: int, rn: Col) -> Column:
        """Linear weights 1..n, newest heaviest. ``rn`` is the row number column."""
        w = self.last_rows(n)
        weighted = F.sum(col(x) * col(rn)).over(w) - F.sum(col(x)).over(w) * (col(rn) - n)
        return F.when(F.count(col(x)).over(w) >= n, weighted / (n * (n + 1) / 2.0))

    # --- running values ------------------------------------------------------------------------
    def running(self, agg: Column) -> Column:
        return agg.over(self.cum)

    def ffill(self, x: Col, limit: int | None = None) -> Column:
        w = self.cum if limit is None else self.w.rowsBetween(-limit, Window.currentRow)
        return F.last(col(x), ignorenulls=True).over(w)

    def bfill(self, x: Col, limit: int | None = None) -> Column:
        end = Window.unboundedFollowing if limit is None else limit
        return F.first(col(x), ignorenulls=True).over(self.w.rowsBetween(Window.currentRow, end))

    def window_rank(self, x: Col, n: int, need: int) -> Column:
        """Average-tie rank of the current value among the last n rows (1-based, nulls skipped)."""
        w = self.last_rows(n)
        vals = F.collect_list(col(x)).over(w)
        below = F.size(F.filter(vals, lambda v: v < col(x)))
        equal = F.size(F.filter(vals, lambda v: v == col(x)))
        rank = below + (equal + 1) / F.lit(2.0)
        return F.when(col(x).isNotNull() & (F.count(col(x)).over(w) >= need), rank)


def sign(x: Col) -> Column:
    return F.signum(col(x).cast("double"))


def bool0(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def run_ids(df: DataFrame, frame: Frame, state: Col, out: str = "run_id") -> DataFrame:
    """Number the runs of equal (null-safe) state per key: 1, 2, ..."""
    f = frame
    changed = F.when(f.rn() == 1, F.lit(1)).when(
        ~f.lag(state).eqNullSafe(col(state)), F.lit(1)
    ).otherwise(F.lit(0))
    return df.withColumn("_chg", changed).withColumn(
        out, F.sum("_chg").over(f.cum)
    ).drop("_chg")
