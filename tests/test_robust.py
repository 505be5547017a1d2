"""Robust alignment: outliers, the stop by confidence, large groups over chunks, groups without a fit."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from trajecta.operators import robust
from trajecta.operators.robust import align_robust, fit_triples, inliers, tries_needed

SCHEMA = "scene string, sx double, sy double, sz double, tx double, ty double, tz double"


def turn(a):
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def pairs(rnd, scene, n, bad, angle=0.7, scale=1.5):
    out = []
    for k in range(n):
        p = np.array([rnd.uniform(-5, 5) for _ in range(3)])
        q = scale * turn(angle) @ p + [1, 2, 3] if k >= bad else np.array([rnd.uniform(-9, 9) for _ in range(3)])
        out.append((scene, *map(float, p), *map(float, q)))
    return out


def test_triples_and_counts_match_the_definition():
    rng = np.random.default_rng(1)
    s = rng.standard_normal((50, 3, 3))
    t = 2.5 * s @ turn(0.3).T + [1, 0, -1]
    for h in fit_triples(s, t):
        assert h[0] == pytest.approx(2.5) and np.allclose(h[1:].reshape(3, 4), np.column_stack([turn(0.3), [1, 0, -1]]))
        assert np.linalg.det(h[1:].reshape(3, 4)[:, :3]) == pytest.approx(1)
    h = fit_triples(s[:1], t[:1])
    far = t.reshape(-1, 3).copy()
    far[:40] += 1
    assert inliers(h, s.reshape(-1, 3), far, 0.1).tolist() == [110]
    assert tries_needed(0.5, 0.999) == pytest.approx(math.log(0.001) / math.log(1 - 0.125)) and tries_needed(1.0, 0.999) == 0 and tries_needed(0.0, 0.999) == math.inf


@pytest.mark.parametrize("chunk", [robust.CHUNK, 90])
def test_most_pairs_win(spark, monkeypatch, chunk):
    monkeypatch.setattr(robust, "CHUNK", chunk)
    rnd = random.Random(4)
    rows = pairs(rnd, "clean", 300, 0) + pairs(rnd, "half", 700, 350, 1.2, 0.5) + pairs(rnd, "few", 2, 0) + pairs(rnd, None, 60, 20) + [("same", 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)] * 30
    rows += [("clean", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("clean", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r.scene: r for r in align_robust(spark.createDataFrame(rnd.sample(rows, len(rows)), SCHEMA), ["scene"], 0.05).collect()}
    assert set(got) == {"clean", "half", "few", None, "same"}
    for scene, n, angle, scale in (("clean", 300, 0.7, 1.5), ("half", 350, 1.2, 0.5), (None, 40, 0.7, 1.5)):
        r = got[scene]
        assert n <= r.n_inliers <= n + 3 and r.scale == pytest.approx(scale, abs=1e-3)
        assert np.allclose(np.array(r["align"]).reshape(3, 4), np.column_stack([turn(angle), [1, 2, 3]]), atol=1e-2)
    assert (got["few"].n_inliers, got["few"].scale, got["few"].tries) == (0, None, 0)
    # the stop: enough tries for the share found, in whole rounds; where all agree, one round is enough
    assert got["clean"].tries == 128 >= tries_needed(300 / 302, 0.999)
    assert tries_needed(got["half"].n_inliers / 700, 0.999) <= got["half"].tries <= 128


def test_no_agreement_ends_after_the_iterations(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame(pairs(rnd, "noise", 40, 40), SCHEMA)
    r = align_robust(df, ["scene"], 1e-6, iterations=300).first()
    assert r.tries >= 300 and r.n_inliers <= 3
    assert align_robust(df.limit(0), ["scene"], 0.1).collect() == []


def test_a_batch_of_groups_is_scored_as_one_table():
    """Small groups used to give a table each, and their overhead was most of the time; groups of null keys were not scored."""
    rnd = random.Random(2)
    spots = pd.DataFrame([(k, 0, *[rnd.random() for _ in range(6)]) for k in (1.0, 2.0, None) for _ in range(5)], columns=["scene", "_chunk", *robust.SPOTS])
    still = [1.0, *np.eye(4)[:3].ravel()]
    heads = pd.DataFrame({"scene": [1.0, None], "_chunk": [0, 0], "_h": [np.array(still * 2), np.array(still)]})
    both = pd.concat([heads.iloc[:1], spots.iloc[:5], spots.iloc[5:10], heads.iloc[1:], spots.iloc[10:]], ignore_index=True)
    both["_h"] = both["_h"].astype(object).where(both["_h"].notna(), None)
    out = list(robust._score(["scene"], 0.9)([both.iloc[:4], both.iloc[4:]]))
    assert len(out) == 2  # a table a batch
    got = pd.concat(out).groupby(["scene", "_k"], dropna=False)["_good"].sum()
    near = lambda rows: sum(math.dist(r[2:5], r[5:8]) < 0.9 for r in rows.itertuples(index=False))
    assert got.tolist() == [near(spots.iloc[:5])] * 2 + [near(spots.iloc[10:])]
