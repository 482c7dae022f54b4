"""Recipes with choices, and their evaluation in passes."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import expansion as E
from barloom.functions.factor import with_factors
from barloom.functions.library import from_recipe, make
from fixtures import bar_frame, to_bars

PR = {"factor": "PriceReturn", "params": {"window": {"any": [5, 10]}}}


def test_choices():
    assert E.expand({"factor": "RSI"}) == [{"factor": "RSI"}]
    assert [r["params"]["window"] for r in E.expand(PR)] == [5, 10]
    assert len(E.expand({"combine": {"any": ["product", "diff"]}, "a": PR, "b": PR})) == 8
    same = {"factor": "PriceReturn", "params": {"window": {"same": "w", "any": [5, 10]}}}
    made = E.expand({"combine": "ratio", "a": same, "b": {"factor": "Volatility", "params": {"window": {"same": "w", "any": [5, 10]}}}})
    assert [(r["a"]["params"]["window"], r["b"]["params"]["window"]) for r in made] == [(5, 5), (10, 10)]
    # A choice among recipes that have choices themselves.
    assert len(E.expand({"negate": {"any": [PR, {"factor": "RSI"}]}})) == 3
    with pytest.raises(ValueError):
        E.expand({"a": {"same": "w", "any": [1]}, "b": {"same": "w", "any": [2]}})


def test_references():
    named = {"x": {"combine": "diff", "a": PR, "b": {"factor": "RSI"}}, "y": {"negate": {"ref": "x"}}, "z": {"ref": "z"}}
    assert len(E.expand({"transform": "delta", "of": {"ref": "y"}, "window": {"any": [1, 2]}}, named)) == 4
    for bad in ({"ref": "z"}, {"ref": "nowhere"}):
        with pytest.raises(ValueError):
            E.expand(bad, named)


def test_all_kinds_once_each(spark):
    combos = {"x": {"combine": "product", "a": PR, "b": {"factor": "KaufmanER"}}}
    when = [{"factor": {"factor": "KaufmanER"}, "op": "gt", "threshold": {"any": [0.1, 0.2]}}]
    conditionals = [{"signal": {"ref": "x"}, "when": when}, {"switch": {"factor": "RSI"}, "else": {"negate": {"factor": "RSI"}}, "when": when}, {"ref": "x"}]
    made = E.expand_all(["PriceReturn"], combos, conditionals, transforms=["delta", "rolling_mean"])
    names = [f.name for f in made]
    assert len(names) == len(set(names)) and sum("__if_" in n for n in names) == 6
    assert sum("product" in n and "__if_" not in n for n in names) == 2 and sum("delta" in n for n in names) == 2


def test_passes_hold_their_columns_and_share():
    factors = [from_recipe(r) for r in E.expand({"transform": {"any": ["delta", "rolling_mean", "zscore"]}, "of": PR, "window": {"any": [3, 4]}})]
    for most in (1, 3, 5, 100):
        groups = E.passes(factors, most)
        assert sorted(f.name for g in groups for f in g) == sorted(f.name for f in factors)
        for g in groups:
            columns = set().union(*[E._graph(f) for f in g])
            assert len(columns) <= most or len(g) == 1
    assert len(E.passes(factors, 100)) == 1


def test_evaluation_equals_one_wide_pass(spark):
    bars = to_bars(spark, bar_frame(symbols=3, rows=80))
    factors = E.expand_all((), [{"combine": {"any": ["product", "diff"]}, "a": PR, "b": {"factor": "KaufmanER"}}]) + [make("RSI")]
    long = {(r.symbol, r.date, r.factor_name): (r.factor, r.close) for r in E.evaluate(bars, factors, most=3, keep=["close"]).collect()}
    wide = with_factors(bars, factors).df.collect()
    assert len(long) == len(wide) * len(factors)
    for r in wide:
        for f in factors:
            value, close = long[r.symbol, r.date, f.name]
            assert close == r.close and (value == r[f.name] or value == pytest.approx(r[f.name]))
    one = E.evaluate(bars, factors).groupBy("factor_name").agg(F.count("factor").alias("n")).collect()
    assert {r.factor_name for r in one} == {f.name for f in factors}
