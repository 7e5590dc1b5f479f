from __future__ import annotations

import numpy as np
import pytest
from frames import at
from hypothesis import given
from hypothesis import strategies as st

from barloom.operators import quality, rolling

VALUES = st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(float), st.floats(-1e6, 1e6))


@given(st.lists(VALUES, max_size=60), st.integers(1, 12))
def test_frames_by_brute_force(values, n):
    levels = [0.0, 0.1, 0.5, 0.9, 1.0]
    known, found = rolling.slide(values, n, levels)
    for t in range(len(values)):
        frame = [v for v in values[max(t - n, 0) : t] if v is not None]
        frame = sorted(v for v in frame if v == v) + [v for v in frame if v != v]
        assert known[t] == len(frame)
        for q, column in zip(levels, found):
            place = (len(frame) - 1) * q
            low, high = int(np.floor(place)), int(np.ceil(place))
            want = frame[low] + (frame[high] - frame[low]) * (place - low) if frame else None
            assert column[t] == want or column[t] == pytest.approx(want, nan_ok=True, abs=1e-9)


@pytest.mark.parametrize("n", [7, rolling.SHORT + 1])
def test_medians_of_ticks(spark, monkeypatch, n):
    """Short frames, and frames that slide across tiles; both forms are the same."""
    rng = np.random.default_rng(2)
    rows = [(i, "AB"[i % 3 == 0], at(i), 1.0, float(rng.integers(1, 30)) if rng.random() > 0.1 else None) for i in range(900)]
    rows += [(900, "A", None, 1.0, 1.0), (901, None, at(3), 1.0, 1.0), (902, "B", at(901), 1.0, float("nan")), (903, "B", at(902), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "tick_id long, symbol string, ts timestamp_ntz, price double, spread double")
    got = {r.tick_id: r.spread_median for r in quality.spread_median(df, n).collect()}
    assert len(got) == len(rows) and got[900] is got[901] is None
    for symbol in "AB":
        mine = [r for r in rows if r[1] == symbol and r[2] is not None]
        for t, row in enumerate(mine):
            frame = [r[4] for r in mine[max(t - n, 0) : t] if r[4] is not None and r[4] == r[4]]
            assert got[row[0]] == (pytest.approx(np.median(frame)) if frame else None)
    monkeypatch.setattr(rolling, "SHORT", 1000 if n > rolling.SHORT else 0)
    assert {r.tick_id: r.spread_median for r in quality.spread_median(df, n).collect()} == pytest.approx(got)
