"""Quantiles by selection against sorted values."""

import math

import numpy as np
import pytest

from quayside.operators.quantiles import class_quantiles, ordered, value_of

SHARES = [0.0, 0.1, 0.5, 0.9, 1.0]


def test_ordered_numbers_keep_the_order():
    v = np.array([-math.inf, -1e300, -2.0, -1e-310, -0.0, 0.0, 5e-324, 1.0, math.inf, math.nan])
    keys = ordered(v)
    assert all(a <= b for a, b in zip(keys.tolist(), keys.tolist()[1:])) and keys[4] == keys[5]
    assert [value_of(int(k)) for k in keys[:-1]] == v[:-1].tolist()
    assert math.isnan(value_of(int(keys[-1])))


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_of_hard_columns(spark, parts):
    rng = np.random.default_rng(3)
    n = 3000
    cols = {"wide": np.exp(rng.normal(0, 80, n)) * rng.choice([-1, 1], n),   # many exponents
            "close": 1.0 + rng.integers(0, 50, n) * 2.0 ** -52,                  # last bits only
            "tied": rng.choice([0.0, 7.0], n, p=[0.9, 0.1]),
            "holes": np.where(rng.random(n) < 0.3, None, rng.normal(size=n))}
    label = rng.choice(["a", "b", "c"], n, p=[0.9, 0.099, 0.001]).tolist()
    rows = [(y, *[None if v is None else float(v) for v in r]) for y, *r in zip(label, *cols.values())]
    df = spark.createDataFrame(rows, "y string, wide double, close double, tied double, holes double")
    got = {(r["label"], r["column"], r["share"]): (r["n"], r["value"])
           for r in class_quantiles(df.repartition(parts), "y", list(cols), SHARES).collect()}
    for y in set(label):
        for j, c in enumerate(cols):
            mine = [r[j + 1] for r in rows if r[0] == y and r[j + 1] is not None]
            for s in SHARES:
                count, value = got.pop((y, c, s))
                assert count == len(mine)
                assert value == pytest.approx(np.quantile(mine, s), rel=1e-12)
    assert not got


def test_defined_cases(spark):
    rows = [(1, 2.0, None), (1, math.nan, None), (1, -0.0, None), (None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    got = {(r["label"], r["column"], r["share"]): r["value"]
           for r in class_quantiles(df, "y", ["a", "b"], [0.0, 0.5, 1.0]).collect()}
    assert math.isnan(got.pop((1, "a", 1.0)))
    assert got == {(1, "a", 0.0): 0.0, (1, "a", 0.5): 2.0, **{(None, "a", s): 5.0 for s in (0.0, 0.5, 1.0)},
                   **{(None, "b", s): 1.0 for s in (0.0, 0.5, 1.0)}}
    assert class_quantiles(df.limit(0), "y", ["a"], [0.5]).collect() == []
    with pytest.raises(ValueError):
        class_quantiles(df, "y", ["a"], [1.5])
