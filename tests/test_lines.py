"""Wall lines and gaps of a room with a door, with noise."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.plans import lines as L


@pytest.fixture(scope="module")
def room(spark):
    rng = np.random.default_rng(2)
    rows = []
    # (axis of the normal, sign, coordinate across, from, to): four walls of 5 x 3 m seen from inside, a door from 2.0 to 2.9
    for axis, sign, c, a, b in [(1, 1, 0.0, 0.0, 2.0), (1, 1, 0.0, 2.9, 5.0), (1, -1, 3.0, 0.0, 5.0), (0, 1, 0.0, 0.0, 3.0), (0, -1, 5.0, 0.0, 3.0)]:
        n = int((b - a) * 400)
        t, across = np.linspace(a, b, n), c + rng.normal(0, 0.004, n)
        for u, v in zip(across.tolist(), t.tolist(), strict=True):
            rows.append(("k", u, v, float(sign), 0.0) if axis == 0 else ("k", v, u, 0.0, float(sign)))
    return spark.createDataFrame(rows, "capture string, x double, z double, nx double, nz double")


def test_lines_and_the_door(room):
    lines, parts = L.wall_lines(room)
    got = {(r.axis, r.sign): r.c for r in lines.collect()}
    assert set(got) == {(1, 1), (1, -1), (0, 1), (0, -1)}
    assert got[1, 1] == pytest.approx(0.0, abs=0.002) and got[1, -1] == pytest.approx(3.0, abs=0.002) and got[0, -1] == pytest.approx(5.0, abs=0.002)
    assert sorted((round(r.a, 1), round(r.b, 1)) for r in parts.where("axis = 1 and sign = 1").collect()) == [(0.0, 2.0), (2.9, 5.0)]
    gaps = L.wall_gaps(lines, parts).collect()
    assert len(gaps) == 1 and (gaps[0].axis, gaps[0].sign) == (1, 1)
    assert gaps[0].a == pytest.approx(2.0, abs=0.03) and gaps[0].b == pytest.approx(2.9, abs=0.03)


def test_too_few_points_give_no_line(room):
    assert L.wall_lines(room.limit(40))[0].count() == 0
