"""The flight keeps each document's chance, whatever its length."""

from __future__ import annotations

import numpy as np
import pytest

from quantaint.llm import mixing


@pytest.mark.parametrize("chance", [0.3, 0.45, 0.7])
def test_share_taken_per_size_decile(chance):
    size = np.round(np.random.default_rng(1).lognormal(5, 1, 20_000)) + 1
    done = mixing.flight(np.full(len(size), chance), size, 7)
    deciles = np.array_split(done[np.argsort(size, kind="stable")], 10)
    assert [d.mean() for d in deciles] == pytest.approx([chance] * 10, abs=0.04)


def test_single_unit_keeps_its_chance():
    size = np.array([1.0, 2, 3, 50, 51, 400, 401, 1000])
    done = np.mean([mixing.flight(np.full(8, 0.3), size, seed) for seed in range(4000)], axis=0)
    assert done == pytest.approx([0.3] * 8, abs=0.03)


def test_equal_seeds_agree():
    size = np.arange(1.0, 200)
    a, b, c = (mixing.flight(np.full(199, 0.4), size, seed) for seed in (3, 3, 4))
    assert (a == b).all() and (a != c).any()


@pytest.mark.parametrize("units", [12, 500])
def test_shares_after_landing(units):
    size = np.round(np.random.default_rng(1).lognormal(5, 1, units)) + 1
    chance, taken = np.full(units, 0.3), np.zeros(units)
    for seed in range(400):
        landed = mixing.landing(mixing.flight(chance, size, seed), size, seed)
        assert abs((landed * size).sum() - (chance * size).sum()) <= 0.03 * (chance * size).sum()
        taken += landed / 400
    fifths = [part.mean() for part in np.array_split(taken[np.argsort(size)], 5)]
    assert fifths == pytest.approx([0.3] * 5, abs=0.12 if units == 12 else 0.02)


def test_few_units_come_near_the_target():
    """Of five units one choice alone is near: the target goes before the chances."""
    size = np.array([83.0, 166, 407, 223, 99])
    landed = mixing.landing(np.array([0.0, 1, 0.5, 0, 0.2]), size, 1)
    assert abs((landed * size).sum() - 389.3) < 40
