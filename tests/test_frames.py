"""The chunked window equals the plain one, whatever the shape of the data."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import values
from pricetide.operators import frames, indicators


def both(rows, rows_per_chunk):
    plain = indicators.indicators(rows, rows_per_chunk=None)
    chunked = indicators.indicators(rows, rows_per_chunk=rows_per_chunk)
    names = sorted(plain.columns)
    assert chunked.columns == plain.columns
    return values(plain, *names), values(chunked, *names)


@pytest.mark.parametrize("rows_per_chunk", [1, 3, 16, 50])
def test_one_symbol_with_most_rows(obs, rows_per_chunk):
    rng = random.Random(7)
    rows = [("h", "HOT", m, round(rng.uniform(1, 9), 2)) for m in range(300)]
    rows += [(s, s, m, 1.0 + m) for s in ("x", "y") for m in range(5)]
    rows += [("n", None, m, 2.0) for m in range(40)]
    rng.shuffle(rows)
    plain, chunked = both(obs(rows), rows_per_chunk)
    assert plain == chunked


def test_all_rows_of_a_symbol_at_one_time(obs):
    rows = [(f"{i:04}", "HOT", 0, float(i % 13)) for i in range(200)]
    plain, chunked = both(obs(rows), 8)
    assert plain == chunked


@pytest.mark.parametrize("seconds", [60, 600, 86400])
def test_cells_of_any_width(obs, seconds):
    rng = random.Random(3)
    rows = obs([("h", "HOT", m * m // 50, round(rng.uniform(1, 9), 2)) for m in range(400)])
    plain = indicators.moving_averages(rows, (2, 30), rows_per_chunk=None)
    cut = indicators.moving_averages(rows, (2, 30), rows_per_chunk=40, cell_seconds=seconds)
    assert values(cut, *plain.columns) == values(plain, *plain.columns)


def test_chunks_and_what_they_look_back_to(obs):
    rows = obs([("h", "HOT", m, 1.0) for m in range(1000)] + [("c", "COLD", 0, 1.0)])
    cells = frames.chunk_cells(frames.row_counts(rows, 600), 100, 15).collect()
    assert {r["_symbol"] for r in cells} == {"HOT"}
    ordered = [r["_chunks"] for r in sorted(cells, key=lambda r: r["_cell"])]
    assert [own for own, *_ in ordered] == [i // 10 for i in range(100)]
    # Fifteen rows are two cells of ten, so only the last two of a chunk are looked at again.
    assert [i % 10 for i, (_, *later) in enumerate(ordered) if later] == [8, 9] * 9
    assert all(later in ([], [own + 1]) for own, *later in ordered)


def test_sparse_cells_reach_several_chunks_back(obs):
    rows = obs([("h", "HOT", 600 * m, float(m)) for m in range(30)])
    plain, chunked = both(rows, 2)
    assert plain == chunked


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.sampled_from("AAAB"), st.integers(0, 60), st.integers(1, 9)),
        min_size=1, max_size=120, unique_by=lambda r: (r[0], r[1]),
    ),
    st.integers(1, 20),
)
def test_any_shape(obs, rows, rows_per_chunk):
    plain, chunked = both(
        obs([(s, s, m, float(p)) for s, m, p in rows]), rows_per_chunk
    )
    assert plain == chunked


def test_half_a_million_rows_of_one_symbol_are_cut_by_default(spark):
    """Else a handful of symbols keeps a handful of tasks busy."""
    n = 2 * frames.ROWS_PER_CHUNK
    assert n <= 500_000
    rows = spark.range(n).selectExpr(
        "'s' AS symbol", "cast(id AS string) AS asset_id", "cast(id % 97 AS double) AS price",
        "timestamp_seconds(1704067200 + id) AS observed_at",
    )
    sizes = []

    def add(df, window):
        sizes.append("_chunk" in df.columns)
        return df

    frames.over_rows(rows, add, 1)
    assert sizes == [True]
