"""The rounded linear program: every piece once, never more sequences than best fit decreasing, near its bound."""

import numpy as np
import pytest

from marquee.llm import packing


def plain_best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("n, mean, spread", [(0, 1, 1), (1, 3, 1), (700, 6, 1), (700, 6.8, 0.3), (700, 4, 2)])
def test_program(n, mean, spread):
    lengths = np.clip(np.random.default_rng(n).lognormal(mean, spread, n).astype(int), 1, 2048)
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    plan, bound = packing.configurations(histogram)
    used = {}
    for configuration, times in plan:
        assert times > 0 and sum(x * k for x, k in configuration) <= 2048
        for x, k in configuration:
            used[x] = used.get(x, 0) + k * times
    assert used == histogram
    made = sum(times for _, times in plan)
    assert -(-int(lengths.sum()) // 2048) <= bound <= made <= plain_best_fit(lengths.tolist(), 2048)


@pytest.mark.parametrize("n, mean, spread", [(700, 4, 2), (5000, 6, 1), (5000, 7.2, 0.2), (200_000, 6.8, 0.3)])
def test_cover_meets_its_bound(n, mean, spread):
    lengths = np.clip(np.random.default_rng(1).lognormal(mean, spread, n).astype(int), 1, 2048)
    count = np.bincount(lengths, minlength=2049)
    amounts, bound = packing.solve(count)
    covered = np.zeros(2049)
    for configuration, amount in amounts.items():
        assert amount > 0 and sum(x * k for x, k in configuration) <= 2048
        for x, k in configuration:
            covered[x] += k * amount
    assert (covered >= count * (1 - 1e-9)).all()
    assert max(lengths.sum() / 2048, (lengths > 1024).sum()) <= bound + 1e-6
    assert bound <= sum(amounts.values()) <= (1 + packing.GAP) * bound


def test_program_saves_sequences_over_best_fit():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.8, 0.3, 5000).astype(int), 1, 2048)
    plan, bound = packing.configurations(dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)))))
    made = sum(times for _, times in plan)
    assert bound <= made <= 1.01 * bound and made < 0.995 * plain_best_fit(lengths.tolist(), 2048)


def test_program_beats_best_fit_where_it_is_wrong():
    # best fit puts the 7s together; 7 + 3 and 4 + 4 + 2 leave nothing
    plan, bound = packing.configurations({7: 40, 3: 40, 4: 40, 2: 20}, 10)
    assert bound == sum(times for _, times in plan) == 60


@pytest.mark.parametrize("capacity", [1, 7, 30])
def test_knapsack_equals_enumeration(capacity):
    price = np.zeros(capacity + 1)
    price[1:] = np.random.default_rng(capacity).random(capacity) * np.arange(1, capacity + 1)
    best, _ = packing.knapsack(price, capacity)
    want = [0.0]
    for room in range(1, capacity + 1):
        want.append(max([want[room - 1], *(want[room - x] + price[x] for x in range(1, room + 1))]))
    assert np.allclose(best, want)
