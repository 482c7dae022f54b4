"""The rank trend of group returns against pairs counted one by one."""

import itertools
import math
import random

import pytest

from barloom.operators.grouping import trend_test


def counted(groups):
    rising = sum(
        (x < y) + 0.5 * (x == y) for (_, a), (_, b) in itertools.combinations(sorted(groups.items()), 2) for x in a for y in b
    )
    sizes, values = [len(a) for a in groups.values()], [x for a in groups.values() for x in a]
    ties = [values.count(x) for x in set(values)]
    m = len(values)
    f = lambda xs, k: sum({0: x * (x - 1) * (2 * x + 5), 1: x * (x - 1) * (x - 2), 2: x * (x - 1)}[k] for x in xs)
    spread = (f([m], 0) - f(sizes, 0) - f(ties, 0)) / 72 + f(sizes, 1) * f(ties, 1) / (36 * f([m], 1)) + f(sizes, 2) * f(ties, 2) / (8 * f([m], 2))
    z = (rising - (m * m - sum(n * n for n in sizes)) / 4) / math.sqrt(spread)
    return rising, z, math.erfc(abs(z) / math.sqrt(2))


def frame(spark, groups):
    rows = [(f"d{i}", g, x) for g, values in groups.items() for i, x in enumerate(values)]
    return spark.createDataFrame([*rows, ("d", 1, None)], "date string, group int, ret double")


@pytest.mark.parametrize("slope", [0.0, 0.4, -0.2])
def test_trend(spark, slope):
    rnd = random.Random(3)
    groups = {g: [round(rnd.gauss(slope * g, 1), 1) for _ in range(rnd.randrange(5, 30))] for g in range(1, 6)}
    got = trend_test(frame(spark, groups)).first()
    assert tuple(got) == pytest.approx(counted(groups), abs=1e-6)


def test_without_groups(spark):
    assert tuple(trend_test(frame(spark, {2: [1.0, 2.0]})).first()) == (None, None, None)
    assert tuple(trend_test(frame(spark, {})).first()) == (None, None, None)
