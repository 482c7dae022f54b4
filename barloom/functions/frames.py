"""Symbol-ordered evaluation that never depends on one symbol fitting a task.

`Bars` couples a DataFrame with proven group sizes. While the longest symbol
stays under SINGLE_TASK_ROWS, windows partition by symbol: one exchange and one
sort serve every factor. Beyond it the same expressions run on row-numbered
chunks of each symbol. A chunk carries the rows before (and after) it that its
windows look at, so a symbol holding a third of the table is spread over many
tasks and the results stay the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.session import cut_lineage

# Rows one task may sort for one group before the split path takes over.
SINGLE_TASK_ROWS = 1_000_000
# Days per block while row numbers are assigned; (symbol, date) is unique, so a
# block holds at most this many rows of a symbol.
BLOCK_DAYS = 4096


@dataclass(frozen=True)
class Bars:
    """Rows keyed by (symbol, date) with upper bounds on group sizes."""

    df: DataFrame
    rows_per_symbol: int
    rows_per_date: int
    limit: int = SINGLE_TASK_ROWS
    symbols: int | None = None  # distinct symbols and dates, None when not counted
    dates: int | None = None

    @classmethod
    def measure(cls, df: DataFrame, limit: int = SINGLE_TASK_ROWS) -> "Bars":
        """Largest group and number of groups per symbol and date (two small
        jobs over partial counts)."""

        def groups(key: str) -> tuple[int, int]:
            sizes = df.groupBy(key).count()
            most, many = sizes.agg(F.max("count"), F.count("count")).first()
            return int(most or 0), int(many)

        (per_symbol, symbols), (per_date, dates) = groups("symbol"), groups("date")
        return cls(df, per_symbol, per_date, limit, symbols, dates)

    def with_df(self, df: DataFrame) -> "Bars":
        return replace(self, df=df)

    @property
    def symbol_fits(self) -> bool:
        return self.rows_per_symbol <= self.limit

    @property
    def date_fits(self) -> bool:
        return self.rows_per_date <= self.limit

    @property
    def symbols_fit(self) -> bool:
        """Whether one row per symbol fits a task; unknown counts as no."""
        return self.symbols is not None and self.symbols <= self.limit

    @property
    def total_fits(self) -> bool:
        return self.symbols is not None and self.symbols * self.rows_per_symbol <= self.limit


def by_symbol(*extra: str) -> WindowSpec:
    return W.partitionBy("symbol", *extra).orderBy("date")


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def up_to_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(W.unboundedPreceding, 0)


def number_rows(df: DataFrame, out: str = "__idx") -> DataFrame:
    """0-based position of each row within its symbol, without a window over
    the whole symbol: block counts give offsets, blocks number themselves."""
    if out in df.columns:
        return df
    blocked = df.withColumn("__blk", F.floor(F.unix_date(F.to_date("date")) / F.lit(BLOCK_DAYS)))
    offsets = (
        blocked.groupBy("symbol", "__blk")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__off",
            F.coalesce(
                F.sum("__n").over(
                    W.partitionBy("symbol").orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("__n")
    )
    here = F.row_number().over(W.partitionBy("symbol", "__blk").orderBy("date")) - 1
    return (
        blocked.withColumn("__at", here)
        .join(offsets, ["symbol", "__blk"])
        .withColumn(out, F.col("__off") + F.col("__at"))
        .drop("__blk", "__off", "__at")
    )


def chunked(df: DataFrame, back: int, ahead: int, limit: int) -> DataFrame:
    """Split each symbol into chunks of rows; copy border rows to neighbours.

    Adds __chunk and __own (false on the copied border rows).
    """
    size = max(limit, 4 * (back + ahead), 1)
    idx = F.col("__idx")
    first = F.greatest(F.floor((idx - ahead) / F.lit(size)), F.lit(0))
    last = F.floor((idx + back) / F.lit(size))
    return (
        number_rows(df)
        .withColumn("__chunk", F.explode(F.sequence(first, last)))
        .withColumn("__own", F.col("__chunk") == F.floor(idx / F.lit(size)))
    )


def windowed(bars: Bars, back: int, ahead: int, build) -> DataFrame:
    """Run build(df, w) where w sees `back` rows before and `ahead` after."""
    if bars.symbol_fits:
        return build(bars.df, by_symbol())
    df = build(chunked(bars.df, back, ahead, bars.limit), by_symbol("__chunk"))
    helpers = ["__chunk", "__own"] + ([] if "__idx" in bars.df.columns else ["__idx"])
    return df.filter("__own").drop(*helpers)


def numbered(bars: Bars) -> Bars:
    """Row numbers written out once, so later steps do not rebuild them."""
    return bars.with_df(cut_lineage(number_rows(bars.df)))


def running(bars: Bars, cols: dict[str, tuple[str, object]]) -> DataFrame:
    """Add running aggregates from the first bar: name -> (kind, column).

    Kinds: sum, max, min, first and last (earliest, latest non-NULL value). When a symbol is too
    long for one task, each chunk is scanned alone and receives the totals of
    the chunks before it.
    """
    w = by_symbol()
    if bars.symbol_fits:
        aggs = {n: _scan(kind, x).over(up_to_now(w)) for n, (kind, x) in cols.items()}
        return bars.df.withColumns(aggs)
    staged = number_rows(bars.df).withColumn(
        "__chunk", F.floor(F.col("__idx") / F.lit(max(bars.limit, 1)))
    )
    staged = staged.withColumns({f"__x_{n}": x for n, (_, x) in cols.items()})
    local = up_to_now(by_symbol("__chunk"))
    staged = staged.withColumns(
        {f"__l_{n}": _scan(kind, F.col(f"__x_{n}")).over(local) for n, (kind, _) in cols.items()}
    )
    staged = cut_lineage(staged)  # read twice below
    totals = staged.groupBy("symbol", "__chunk").agg(
        *[_total(kind, F.col(f"__x_{n}")).alias(f"__t_{n}") for n, (kind, _) in cols.items()]
    )
    before = W.partitionBy("symbol").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "symbol",
        "__chunk",
        *[_scan(kind, F.col(f"__t_{n}")).over(before).alias(f"__c_{n}") for n, (kind, _) in cols.items()],
    )
    joined = staged.join(totals, ["symbol", "__chunk"])
    out = joined.withColumns(
        {n: _merge(kind, F.col(f"__c_{n}"), F.col(f"__l_{n}")) for n, (kind, _) in cols.items()}
    )
    helpers = [f"__{p}_{n}" for n in cols for p in "xlc"]
    helpers += [] if "__idx" in bars.df.columns else ["__idx"]
    return out.drop("__chunk", *helpers)


def _scan(kind: str, x):
    if kind in ("first", "last"):
        return (F.first if kind == "first" else F.last)(x, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](x)


def _total(kind: str, x):
    if kind in ("first", "last"):
        pick = F.min_by if kind == "first" else F.max_by
        return pick(x, F.when(x.isNotNull(), F.col("date")))
    return _scan(kind, x)


def _merge(kind: str, carry, local):
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "first":
        return F.coalesce(carry, local)
    if kind == "sum":
        return F.when(
            carry.isNotNull() | local.isNotNull(),
            F.coalesce(carry, F.lit(0.0)) + F.coalesce(local, F.lit(0.0)),
        )
    return F.greatest(carry, local) if kind == "max" else F.least(carry, local)
