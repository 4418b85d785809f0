import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import values
from pricetide.operators.correlation import correlation_pairs


def brute_force(rows):
    series = {}
    for _, symbol, minute, price in rows:
        series.setdefault(symbol, {})[minute] = price
    out = {}
    for a in series:
        for b in series:
            shared = sorted(set(series[a]) & set(series[b]))
            if a < b and shared:
                x, y = ([series[s][t] for t in shared] for s in (a, b))
                defined = len(shared) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0
                out[a, b] = (len(shared), float(np.corrcoef(x, y)[0, 1]) if defined else None)
    return out


@pytest.mark.parametrize(("block", "tile"), [(256, 2048), (3, 5), (1, 1)])
def test_tiles_match_brute_force(obs, block, tile):
    rng = random.Random(3)
    rows = [
        (s, s, m, round(rng.gauss(1000, 5), 2))
        for s in "ABCDEFG" for m in range(40) if rng.random() < 0.7
    ]
    rows += [("K", "K", m, 4.1) for m in range(40)] + [("L", "L", 1, 2.0)]
    got = correlation_pairs(obs(rows), all_pairs=True, digits=None, symbols_per_block=block, times_per_tile=tile)
    want = brute_force(rows)
    found = {(r["symbol_a"], r["symbol_b"]): r for r in got.collect()}
    assert set(found) == set(want)
    for pair, (n, corr) in want.items():
        assert found[pair]["n_times"] == n
        assert found[pair]["correlation"] == (None if corr is None else pytest.approx(corr))


def test_symbol_list_and_grid(obs):
    rows = obs([(s, s, m, float(m % 4 + i * m)) for i, s in enumerate("ABC") for m in range(20)])
    pairs = correlation_pairs(rows, grid="2 minutes", symbols=["A", "C"])
    assert values(pairs, "symbol_a", "symbol_b", "n_times") == [("A", "C", 10)]


def test_no_rows_no_pairs(obs):
    rows = obs([("a", "A", 0, 1.0)])
    assert correlation_pairs(rows, all_pairs=True).count() == 0
    assert correlation_pairs(rows.filter(F.lit(False)), all_pairs=True).count() == 0
