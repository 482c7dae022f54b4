"""Factor specs and their evaluation.

A Factor is a named column over one symbol's bars. Spark does not nest window
functions, so a factor lists the intermediate columns it needs as dependencies.
All requested factors are merged into one dependency graph on the driver,
shared intermediates are built once, and each level becomes one withColumns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decay import Decay, carried, ewm
from .frames import Bars, by_symbol, last_n, numbered, running, windowed
from .scalar import c


@dataclass(frozen=True)
class Factor:
    """One output column.

    kind "window": build(w) -> Column reading at most `lookback` earlier rows.
    kind "running": build() -> (aggregate, Column), scanned from the first bar.
    kind "grouped": build(pdf) -> Series that reads at most `lookback` earlier rows.
    kind "decay": build() -> (column, alpha, min_periods), an exponential mean
    from the first bar on.
    """

    name: str
    build: Callable = field(compare=False, repr=False)
    deps: tuple["Factor", ...] = field(default=(), repr=False)
    lookback: int = 0
    kind: str = "window"
    hidden: bool = False

    @property
    def warmup(self) -> int:
        return self.lookback + max((d.warmup for d in self.deps), default=0)


def helper(name: str, build, *deps: Factor, lookback: int = 0, kind: str = "window") -> Factor:
    """An intermediate column, dropped from the result."""
    return Factor("_" + name, build, tuple(deps), lookback, kind, hidden=True)


def full(w, x: str | Column, n: int, agg) -> Column:
    """agg over the last n rows, NULL until n non-NULL values are present."""
    wn = last_n(w, n)
    return F.when(F.count(c(x)).over(wn) == n, agg(c(x)).over(wn))


def window_list(w, x: str, n: int) -> Column:
    """The last n values in date order, NULL until n are present."""
    wn = last_n(w, n)
    return F.when(F.count(c(x)).over(wn) == n, F.collect_list(c(x)).over(wn))


def resolve(factors: Sequence[Factor]) -> list[list[Factor]]:
    """Dependency levels of all factors; same spec twice is built once."""
    seen: dict[str, Factor] = {}
    level: dict[str, int] = {}
    open_names: set[str] = set()

    def visit(f: Factor) -> int:
        if f.name in open_names:
            raise ValueError(f"factor dependency cycle at {f.name}")
        if f.name in level:
            if seen[f.name] != f:
                raise ValueError(f"two different factors are named {f.name}")
            return level[f.name]
        open_names.add(f.name)
        depth = 1 + max((visit(d) for d in f.deps), default=-1)
        open_names.discard(f.name)
        seen[f.name], level[f.name] = f, depth
        return depth

    names = [f.name for f in factors]
    if len(set(names)) != len(names):
        raise ValueError("duplicate factor output names")
    for f in factors:
        visit(f)
    levels: list[list[Factor]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for name, depth in level.items():
        levels[depth].append(seen[name])
    return levels


def with_factors(bars: Bars, factors: Sequence[Factor]) -> Bars:
    """Append every factor as a column of the bar table."""
    taken = set(bars.df.columns)
    clash = taken & {f.name for f in factors}
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    out = _in_one_pass(bars, factors) if bars.symbol_fits else _in_phases(bars, factors)
    keep = bars.df.columns + [f.name for f in factors]
    return bars.with_df(out.select(*[c(n) for n in keep]))


PYTHON_KINDS = ("grouped", "decay")


def _schedule(factors: Sequence[Factor]) -> list[list[Factor]]:
    """Levels with the Python stages and what they need first, so that
    the Python stage carries as few columns as possible."""
    levels = resolve(factors)
    early: set[str] = set()

    def mark(f: Factor) -> None:
        if f.name not in early:
            early.add(f.name)
            for d in f.deps:
                mark(d)

    for f in (f for lv in levels for f in lv if f.kind in PYTHON_KINDS):
        mark(f)
    first = [[f for f in lv if f.name in early] for lv in levels]
    rest = [[f for f in lv if f.name not in early] for lv in levels]
    return [lv for lv in first + rest if lv]


def _in_one_pass(bars: Bars, factors: Sequence[Factor]) -> DataFrame:
    df = bars.df
    schedule = _schedule(factors)
    for i, level in enumerate(schedule):
        if any(f.kind in PYTHON_KINDS for f in level):
            wanted = {f.name for f in factors} | {d.name for lv in schedule[i:] for f in lv for d in f.deps}
            df = df.select(*[c(n) for n in df.columns if n in bars.df.columns or n in wanted])
        df = _apply(bars.with_df(df), level)
    return df


def _in_phases(bars: Bars, factors: Sequence[Factor]) -> DataFrame:
    """Chunked evaluation: neighbouring window levels share one split."""
    df = numbered(bars).df
    pending: list[list[Factor]] = []

    def flush(frame: DataFrame) -> DataFrame:
        if not pending:
            return frame
        back = sum(max(f.lookback for f in lv) for lv in pending)
        levels = list(pending)
        pending.clear()

        def build(d, w):
            for lv in levels:
                d = d.withColumns({f.name: f.build(w) for f in lv})
            return d

        return windowed(bars.with_df(frame), back, 0, build)

    for level in _schedule(factors):
        plain = [f for f in level if f.kind == "window"]
        other = [f for f in level if f.kind != "window"]
        if plain:
            pending.append(plain)
        if other:
            df = flush(df)
            df = _apply(bars.with_df(df), other)
    return flush(df)


def _apply(bars: Bars, level: list[Factor]) -> DataFrame:
    df = bars.df
    w = by_symbol()
    plain = {f.name: f.build(w) for f in level if f.kind == "window"}
    if plain:
        df = df.withColumns(plain)
    scans = {f.name: f.build() for f in level if f.kind == "running"}
    if scans:
        df = running(bars.with_df(df), scans)
    grouped = [f for f in level if f.kind == "grouped"]
    if grouped:
        df = _apply_grouped(bars.with_df(df), grouped)
    decays = [Decay(f.name, *f.build()) for f in level if f.kind == "decay"]
    if decays and not bars.symbol_fits:
        df = carried(bars.with_df(df), decays)
    elif decays:
        whole = [Factor(d.name, lambda pdf, d=d: ewm(pdf[d.column], d.alpha, d.min_periods), kind="grouped") for d in decays]
        df = _apply_grouped(bars.with_df(df), whole)
    return df


def _apply_grouped(bars: Bars, factors: list[Factor]) -> DataFrame:
    """Functions of stacked rows per symbol (or per chunk with the rows before
    it that they read) over Arrow."""
    back = max(f.lookback for f in factors)
    builders = [(f.name, f.build) for f in factors]

    def build(df, w):
        # Generated names: Arrow columns cannot be addressed by names with dots.
        names = df.columns
        safe = [f"c{i}" for i in range(len(names))]
        fields = [T.StructField(s, f.dataType) for s, f in zip(safe, df.schema.fields)]
        fields += [T.StructField(f"g{i}", T.DoubleType()) for i in range(len(builders))]
        keys = [s for s, n in zip(safe, names) if n in ("symbol", "__chunk")]

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf.columns = names
            pdf = pdf.sort_values("date", ignore_index=True)
            new = {f"g{i}": fn(pdf) for i, (_, fn) in enumerate(builders)}
            pdf.columns = safe
            return pdf.assign(**new)

        out = df.toDF(*safe).groupBy(*keys).applyInPandas(fold, T.StructType(fields))
        return out.toDF(*names, *[n for n, _ in builders])

    return windowed(bars, back, 0, build)
