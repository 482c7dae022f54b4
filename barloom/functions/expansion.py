"""Hundreds of derived factors from short descriptions, evaluated in passes.

A recipe (see `from_recipe`) may hold choices in place of values, at any depth:
{"any": [...]} stands for each of its values, {"same": name, "any": [...]} for the
same one wherever the name occurs, {"ref": name} for a recipe named elsewhere. All
combinations of the choices are recipes of their own. Recipes share what they have
in common: a pass computes every distinct intermediate column once, and passes are
cut where a plan would hold more columns than it should.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import shared_path
from .factor import Factor, with_factors
from .frames import Bars
from .library import expand_transforms, from_recipe
from .scalar import c

#: Distinct columns, intermediates included, that one pass computes.
PASS_COLUMNS = 400


def _choices(recipe, named: Mapping, path: tuple = (), inside: tuple = ()) -> Iterator[tuple[object, list]]:
    """(key, values) of every choice in the recipe, references followed."""
    if isinstance(recipe, Mapping):
        if "any" in recipe:
            yield recipe.get("same", path), list(recipe["any"])
        elif "ref" in recipe:
            name = recipe["ref"]
            if name in inside or name not in named:
                raise ValueError(f"{'circular' if name in inside else 'unknown'} reference {name!r}")
            yield from _choices(named[name], named, (*path, name), (*inside, name))
        else:
            for k, v in recipe.items():
                yield from _choices(v, named, (*path, k), inside)
    elif isinstance(recipe, (list, tuple)):
        for i, v in enumerate(recipe):
            yield from _choices(v, named, (*path, i), inside)


def _chosen(recipe, named: Mapping, chosen: Mapping, path: tuple = ()):
    if isinstance(recipe, Mapping):
        if "any" in recipe:
            # A choice may be a recipe with choices of its own; those were made first.
            return chosen[recipe.get("same", path)]
        if "ref" in recipe:
            return _chosen(named[recipe["ref"]], named, chosen, (*path, recipe["ref"]))
        return {k: _chosen(v, named, chosen, (*path, k)) for k, v in recipe.items()}
    if isinstance(recipe, (list, tuple)):
        return [_chosen(v, named, chosen, (*path, i)) for i, v in enumerate(recipe)]
    return recipe


def expand(recipe, named: Mapping | None = None) -> list:
    """Every recipe that the choices in this one allow."""
    named = named or {}
    open_: dict[object, list] = {}
    for key, values in _choices(recipe, named):
        if open_.setdefault(key, values) != values:
            raise ValueError(f"choice {key!r} has two lists of values")
    out = []
    for values in itertools.product(*open_.values()):
        made = _chosen(recipe, named, dict(zip(open_, values, strict=True)))
        nested = any(True for _ in _choices(made, named))
        out += expand(made, named) if nested else [made]
    return out


def expand_all(
    names: Iterable[str] = (),
    combos: Mapping[str, Mapping] | Sequence[Mapping] = (),
    conditionals: Sequence[Mapping] = (),
    **grid,
) -> list[Factor]:
    """The factors of a whole research run, each once, in order: transforms of the
    named factors (`grid` as `expand_transforms` takes it), combinations, and
    conditional and switched factors, which may refer to named combinations."""
    named = dict(combos) if isinstance(combos, Mapping) else {}
    recipes = list(named.values()) if named else list(combos)
    out: dict[str, Factor] = {f.name: f for f in (expand_transforms(names, **grid) if names else ())}
    for recipe in [*recipes, *conditionals]:
        for made in expand(recipe, named):
            f = from_recipe(made)
            out.setdefault(f.name, f)
    return list(out.values())


def _graph(factor: Factor) -> dict[str, Factor]:
    out = {factor.name: factor}
    for d in factor.deps:
        if d.name not in out:
            out.update(_graph(d))
    return out


def passes(factors: Sequence[Factor], most: int = PASS_COLUMNS) -> list[list[Factor]]:
    """The factors in groups whose distinct columns are at most `most`, or that of a
    single factor. Each group takes, as long as there is room, the factor that adds
    the fewest columns to it, so factors over the same intermediates come together."""
    open_ = {f.name: (f, set(_graph(f))) for f in factors}
    out = []
    while open_:
        held: set[str] = set()
        group: list[Factor] = []
        while open_:
            name, (f, nodes) = min(open_.items(), key=lambda item: len(item[1][1] - held))
            if group and len(held | nodes) > most:
                break
            group.append(f)
            held |= nodes
            del open_[name]
        out.append(group)
    return out


def evaluate(bars: Bars, factors: Sequence[Factor], most: int = PASS_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """(date, symbol, *keep, factor_name, factor) of all factors: a pass after the
    other appends its columns as rows to one table, so neither a plan nor a row
    grows with the number of factors."""
    spark = bars.df.sparkSession
    path = shared_path(spark, "expanded")
    for group in passes(factors, most):
        wide = with_factors(bars, group).df
        items = F.explode(F.array(*[F.struct(F.lit(f.name).alias("factor_name"), c(f.name).cast("double").alias("factor")) for f in group]))
        wide.select("date", "symbol", *keep, items.alias("__x")).select("date", "symbol", *keep, "__x.*").write.mode("append").parquet(path)
    return spark.read.parquet(path)
