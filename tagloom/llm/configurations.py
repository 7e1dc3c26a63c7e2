"""Bin packing by a configuration linear program over a histogram of lengths.

A configuration is a multiset of lengths that fits one bin. The program asks for the
fewest bins, configurations with fractional multiplicities, that cover the histogram. It
is solved by multiplicative weights: every length has a price, a knapsack dynamic program
finds the configurations of highest total price through each length, and prices fall for
lengths that those cover more than others and rise for the rest. The multiplicities of
all rounds are averaged; every round's prices, divided by the price of its best
configuration, are a solution of the dual and so give a lower bound on the bins.

The average is rounded at random and taken as far as pieces are left, the program is
solved again for what remains, and the few last pieces are placed by best fit. If best
fit alone needs fewer bins, its result is returned.

All work is on the histogram, which has at most one row for each length up to the
capacity, whatever the number of pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np

#: Rounds of weights times capacity in the first solution, within limits; later ones take a fifth of the rounds.
WORK = 400_000
ROUNDS = (120, 1200)
#: Solutions at most.
PHASES = 10
#: Configurations whose price is within this share of the best one are used in a round.
NEAR = 0.02
#: Growth of prices in the first round; it falls with the square root of the round.
RATE = 0.5
#: Share of an averaged multiplicity that is taken before the rest is solved again.
SHARE = 0.8


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within every capacity, and the length taken last (0: none)."""
    lengths = np.flatnonzero(price > 0)
    values = price[lengths]
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        n = fits[room]
        if n:
            total = values[:n] + best[room - lengths[:n]]
            k = int(total.argmax())
            if total[k] > best[room - 1]:
                best[room], last[room] = total[k], lengths[k]
                continue
        best[room] = best[room - 1]
    return best, last


def _config(last: np.ndarray, room: int) -> Counter:
    found: Counter = Counter()
    while room > 0:
        if last[room]:
            found[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return found


def solve(demand: np.ndarray, capacity: int, price: np.ndarray, rounds: int) -> tuple[dict[tuple[int, ...], float], float]:
    """Averaged multiplicities of configurations, and the best lower bound. ``price`` is changed."""
    lengths = np.flatnonzero(demand)
    need = demand[lengths].astype(np.float64)
    mixed: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for n in range(rounds):
        best, last = _knapsack(price, capacity)
        top = best[capacity]
        bound = max(bound, float((need * price[lengths]).sum() / top))
        through = price[lengths] + best[capacity - lengths]
        covered = np.zeros(capacity + 1)
        taken: list[tuple[tuple[int, ...], float]] = []
        for k in np.flatnonzero(through >= (1 - NEAR) * top):
            config = _config(last, capacity - int(lengths[k]))
            config[int(lengths[k])] += 1
            times = need[k] / config[int(lengths[k])]
            for length, count in config.items():
                covered[length] += times * count
            taken.append((tuple(sorted(config.elements(), reverse=True)), times))
        worth = (need * price[lengths]).sum() / (covered * price).sum()
        gain = worth * covered[lengths] / need
        if n >= rounds // 3:
            for config, times in taken:
                mixed[config] = mixed.get(config, 0.0) + worth * times / (rounds - rounds // 3)
        price[lengths] *= np.exp(np.clip(RATE / np.sqrt(n + 1) * (1 - gain), -1, 1))
    return mixed, bound


def first_price(demand: np.ndarray, capacity: int) -> np.ndarray:
    """Length by capacity, mixed with the step function of the length that gives the best bound."""
    share = np.arange(capacity + 1) / capacity
    best, found = 0.0, share
    for k in range(1, 7):
        steps = share * (k + 1)
        price = np.where(np.isclose(steps, np.round(steps)), share, np.floor(steps + 1e-9) / k)
        price[demand == 0] = 0
        value = float((demand * price).sum()) / max(float(_knapsack(price, capacity)[0][capacity]), 1e-9)
        if value > best:
            best, found = value, price
    return 0.8 * found + 0.2 * share if best > float((demand * share).sum()) else share


def plan(histogram: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """(lengths, multiplicity) of bins that hold every piece exactly once, and a lower bound on their number.

    ``histogram[n]`` is the number of pieces of length n, from 1 to ``capacity``.
    """
    demand = np.zeros(capacity + 1, np.int64)
    demand[: len(histogram)] = histogram
    demand[0] = 0
    whole = int(demand[capacity])
    demand[capacity] = 0
    bound = 0.0
    made = Counter()
    left = demand.copy()
    rng = np.random.default_rng(20260917)
    price = first_price(demand, capacity)
    rounds = int(np.clip(WORK // capacity, *ROUNDS))
    for phase in range(PHASES):
        if np.count_nonzero(left) < 2:
            break
        price[left == 0] = 0
        mixed, low = solve(left, capacity, price, rounds // 5 if phase else rounds)
        if not phase:
            bound = low
        before = left.sum()
        for config, times in sorted(mixed.items(), key=lambda x: (-x[1], x[0])):
            pieces = Counter(config)
            times = min(int(SHARE * times + rng.random()), *(int(left[n]) // c for n, c in pieces.items()))
            if times:
                made[config] += times
                for n, c in pieces.items():
                    left[n] -= times * c
        if left.sum() > 0.98 * before:
            break
    plain = _best_fit(Counter(), demand, capacity)
    mixed_bins = _best_fit(made, left, capacity)
    bins = min(mixed_bins, plain, key=lambda x: sum(times for _, times in x))
    if whole:
        bins = sorted([*bins, ((capacity,), whole)], key=lambda x: (-x[1], x[0]))
    return bins, bound + whole


def configurations(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The bins of ``plan``."""
    return plan(histogram, capacity)[0]


def _best_fit(taken: Counter, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place the remaining pieces, longest first, into the bins with the least sufficient room.

    A bin that takes a piece has the least room afterwards, so it takes pieces of this
    length until none fits: equal bins are filled at once, and steps do not depend on the
    number of pieces.
    """
    opened: Counter = Counter(taken)
    rooms: dict[int, list[tuple[int, ...]]] = {}
    for config in taken:
        room = capacity - sum(config)
        if room and left[1 : room + 1].any():
            rooms.setdefault(room, []).append(config)
    keys = sorted(rooms)

    def add(config: tuple[int, ...], times: int) -> None:
        if not times:
            return
        opened[config] += times
        room = capacity - sum(config)
        if room and opened[config] == times:
            if room not in rooms:
                insort(keys, room)
                rooms[room] = []
            rooms[room].append(config)

    for length in range(len(left) - 1, 0, -1):
        rest = int(left[length])
        while rest:
            at = bisect_left(keys, length)
            config: tuple[int, ...] = ()
            room = capacity
            bins = -(-rest // (capacity // length))
            if at < len(keys):
                room = keys[at]
                config = rooms[room][-1]
                bins = opened[config]
            fits = room // length
            full = min(bins, rest // fits)
            part = rest - full * fits if full < bins else 0
            used = full + bool(part)
            if config:
                opened[config] -= used
                if not opened[config]:
                    del opened[config]
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        keys.pop(at)
            add((*config, *[length] * fits), full)
            add((*config, *[length] * part), bool(part))
            rest -= full * fits + part
    return sorted(opened.items(), key=lambda x: (-x[1], x[0]))
