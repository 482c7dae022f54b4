"""Factors built from other factors: transforms, combinations, conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from .building_blocks import centred, line_r2, line_slope, need, position, skew_over
from .factor import Factor, full, helper
from .scalar import all_of, any_of, c, compare, div

# Default window of each transform.
DEFAULT_WINDOWS = {
    "rolling_mean": 10,
    "rolling_std": 20,
    "rolling_skew": 20,
    "delta": 5,
    "pct_change": 5,
    "binarize_winrate": 20,
    "zscore": 252,
    "rolling_slope": 20,
    "rolling_r2": 20,
}


def _standardized(w, x: str, n: int):
    return div(c(x) - full(w, x, n, F.avg), full(w, x, n, F.stddev_samp))


def transform(
    of: Factor, kind: str, window: int | None = None, threshold: float = 0.0
) -> Factor:
    """A rolling statistic of another factor."""
    need(kind in DEFAULT_WINDOWS, f"unknown transform {kind!r}")
    n = DEFAULT_WINDOWS[kind] if window is None else int(window)
    need(n >= 1, "window must be at least 1")
    x = of.name
    name = f"{x}__{kind}_{n}"
    deps: tuple[Factor, ...] = (of,)
    back = n - 1
    if kind == "rolling_mean":
        build = lambda w: full(w, x, n, F.avg)
    elif kind == "rolling_std":
        build = lambda w: full(w, x, n, F.stddev_samp)
    elif kind == "rolling_skew":
        shape = centred(x, of)
        deps = (shape,)
        build = lambda w: skew_over(w, shape.name, n)
    elif kind == "delta":
        build, back = (lambda w: c(x) - F.lag(c(x), n).over(w)), n
    elif kind == "pct_change":
        build, back = (lambda w: div(x, F.lag(c(x), n).over(w)) - 1), n
    elif kind == "binarize_winrate":
        # A missing value counts as a loss.
        name += f"_{float(threshold)}"
        win = helper(f"win_{x}_{float(threshold)}", lambda w: compare(x, ">", threshold).cast("double"), of)
        deps = (win,)
        build = lambda w: full(w, win.name, n, F.avg)
    elif kind == "zscore":
        build = lambda w: _standardized(w, x, n)
    else:
        shape = centred(x, of)
        deps = (shape, position())
        line = line_slope if kind == "rolling_slope" else line_r2
        build = lambda w: line(w, shape.name, n)
    return Factor(name, build, deps, lookback=back)


def negate(of: Factor) -> Factor:
    return Factor(f"{of.name}__neg", lambda w: -c(of.name), (of,))


def combine(
    a: Factor,
    b: Factor,
    method: str,
    weight_a: float = 0.5,
    weight_b: float = 0.5,
    normalize: bool = True,
    normalize_window: int = 252,
) -> Factor:
    need(method in ("product", "ratio", "weighted_sum", "diff"), f"unknown method {method!r}")
    x, y = c(a.name), c(b.name)
    back = 0
    if method == "product":
        build = lambda w: x * y
    elif method == "ratio":
        build = lambda w: div(x, y)
    elif method == "diff":
        build = lambda w: x - y
    elif normalize:
        n = normalize_window
        back = n - 1
        build = lambda w: (
            weight_a * _standardized(w, a.name, n) + weight_b * _standardized(w, b.name, n)
        )
    else:
        build = lambda w: weight_a * x + weight_b * y
    deps = (a,) if a == b else (a, b)
    return Factor(f"{a.name}__{method}_{b.name}", build, deps, lookback=back)


@dataclass(frozen=True)
class Condition:
    factor: Factor
    op: str = "gt"
    threshold: float = 0.0

    def __post_init__(self):
        need(self.op in ("gt", "lt", "gte", "lte"), f"unknown operator {self.op!r}")

    @property
    def label(self) -> str:
        return f"{self.factor.name}_{self.op}_{float(self.threshold)}"

    def column(self):
        return compare(self.factor.name, self.op, float(self.threshold))


def _joined(conditions: list[Condition], logic: str):
    need(logic in ("and", "or"), f"unknown logic {logic!r}")
    join = all_of if logic == "and" else any_of
    return join([k.column() for k in conditions])


def _unique(*factors: Factor) -> tuple[Factor, ...]:
    return tuple(dict.fromkeys(factors))


def conditional(
    signal: Factor,
    condition: Factor,
    op: str = "gt",
    threshold: float = 0.0,
    false_value: str = "nan",
) -> Factor:
    """The signal where the condition holds, else missing or zero."""
    return _gated(signal, [Condition(condition, op, threshold)], "and", false_value)


def multi_conditional(
    signal: Factor, conditions: list[Condition], logic: str = "and", false_value: str = "nan"
) -> Factor:
    need(len(conditions) >= 2, "at least two conditions are needed")
    return _gated(signal, conditions, logic, false_value)


def _gated(signal: Factor, conditions: list[Condition], logic: str, false_value: str) -> Factor:
    need(false_value in ("nan", "zero"), "false_value must be nan or zero")
    label = f"_{logic}_".join(k.label for k in conditions)
    other = F.lit(None).cast("double") if false_value == "nan" else F.lit(0.0)
    return Factor(
        f"{signal.name}__if_{label}",
        lambda w: F.when(_joined(conditions, logic), c(signal.name)).otherwise(other),
        _unique(signal, *[k.factor for k in conditions]),
    )


def switch(
    signal_true: Factor,
    signal_false: Factor,
    conditions: list[Condition],
    logic: str = "and",
    false_negate: bool = False,
) -> Factor:
    """One factor where the conditions hold, another (maybe negated) elsewhere."""
    need(len(conditions) >= 1, "a condition is needed")
    label = f"_{logic}_".join(k.label for k in conditions)
    sign = -1.0 if false_negate else 1.0
    return Factor(
        f"{signal_true.name}__if_{label}__else_{signal_false.name}" + ("_neg" if false_negate else ""),
        lambda w: F.when(_joined(conditions, logic), c(signal_true.name)).otherwise(
            c(signal_false.name) * sign
        ),
        _unique(signal_true, signal_false, *[k.factor for k in conditions]),
    )
