"""Allocation and matched draws by vectors against the same rules taken a group, or an exchange, at a time."""

import hashlib
import itertools
import random
import time

import pytest

from tessella.operators import sampling


def a_group_at_a_time(counts, shares, seed=0):
    names, total = list(shares), sum(counts.values())
    room = {s: int(total * p) for s, p in shares.items()}
    room[max(names, key=shares.get)] += total - sum(room.values())
    size = {s: max(n, 1) for s, n in room.items()}
    signals = range(len(next(iter(counts))))
    totals = [sum(n * v[j] for v, n in counts.items()) for j in signals]
    have, out = {s: [0] * len(totals) for s in names}, {}

    def rank(v):
        return min((totals[j] for j in signals if v[j]), default=total + 1), -sum(v), hashlib.sha256(f"{seed}:{v}".encode()).hexdigest()

    for v in sorted(counts, key=rank):
        for _ in range(counts[v]):
            lack = {s: round(sum(max(0.0, 1 - have[s][j] / max(shares[s] * totals[j], 1e-9)) for j in signals if v[j]), 9) for s in names}
            s = max((s for s in names if room[s]), key=lambda s: (lack[s], room[s] / size[s], -names.index(s)))
            out[v, s] = out.get((v, s), 0) + 1
            room[s] -= 1
            for j in signals:
                have[s][j] += bool(v[j])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_allocation_is_that_of_single_steps(seed):
    rng = random.Random(seed)
    width, splits = rng.randint(1, 5), rng.randint(1, 5)
    counts = {v: rng.choice((1, 2, 7, 40, 300)) for v in itertools.product((0, 1), repeat=width) if rng.random() < 0.7} or {(0,) * width: 5}
    parts = [rng.random() ** 2 + 0.01 for _ in range(splits)]
    shares = {f"s{k}": p / sum(parts) for k, p in enumerate(parts)}
    assert sampling.greedy_counts(counts, shares, seed) == a_group_at_a_time(counts, shares, seed)


def test_allocation_takes_steps_by_vectors():
    rng = random.Random(1)
    counts = {v: rng.randint(10**7, 10**8) for v in itertools.product((0, 1), repeat=7)}
    began = time.time()
    out = sampling.greedy_counts(counts, sampling.SPLITS)
    assert time.time() - began < 20 and sum(out.values()) == sum(counts.values())  # some ten thousand million groups
    for s, p in sampling.SPLITS.items():
        assert sum(n for (_, x), n in out.items() if x == s) == pytest.approx(p * sum(counts.values()), rel=1e-6)


@pytest.mark.parametrize("seed", range(10))
def test_the_best_of_falling_lists(seed):
    rng = random.Random(seed)
    lists = [sorted(((rng.randint(0, 9), rng.random(), k) for _ in range(rng.randint(0, 12))), reverse=True) for k in range(4)]
    for n in range(sum(map(len, lists)) + 1):
        best = sorted(itertools.chain(*lists), reverse=True)[:n]
        assert sampling.best_of(lambda k, t: lists[k][t], list(map(len, lists)), n) == [sum(x[2] == k for x in best) for k in range(4)]


def mismatch(take, wanted, size, single, multi):
    shares = [sum(n for v, n in take.items() if f(sum(v))) / max(size, 1) for f in (lambda s: s == 1, lambda s: s > 1)]
    return sum(abs(sum(n * v[k] for v, n in take.items()) - w) / max(w, 1) for k, w in enumerate(wanted)) + abs(shares[0] - single) + abs(shares[1] - multi)


def an_exchange_at_a_time(pool, wanted, size, single, multi, seed=0, swaps=100):
    order = sorted(pool, key=lambda v: hashlib.sha256(f"{seed}:{v}".encode()).hexdigest())
    take = dict.fromkeys(order, 0)
    for k in sorted(range(len(wanted)), key=lambda k: (wanted[k], k)):
        for v in order:
            if v[k]:
                take[v] += max(0, min(pool[v] - take[v], wanted[k] - sum(n * u[k] for u, n in take.items()), size - sum(take.values())))
    for v in sorted(order, key=any):
        take[v] += max(0, min(pool[v] - take[v], size - sum(take.values())))
    for _ in range(swaps):
        trials = [(round(mismatch(take | {a: take[a] - 1, b: take[b] + 1}, wanted, size, single, multi), 9), i, j) for i, a in enumerate(order) if take[a] for j, b in enumerate(order) if a != b and take[b] < pool[b]]
        if not trials or min(trials)[0] >= round(mismatch(take, wanted, size, single, multi), 9):
            break
        _, i, j = min(trials)
        take[order[i]], take[order[j]] = take[order[i]] - 1, take[order[j]] + 1
    return {v: n for v, n in take.items() if n}


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("values", [(0, 1), (0, 1, 3)])
def test_matched_counts_are_no_worse_than_exchanges_one_by_one(seed, values):
    rng = random.Random(seed)
    pool = {v: rng.randint(1, 12) for v in itertools.product(values, repeat=3) if rng.random() < 0.8} or {(1, 0, 0): 3}
    case = pool, [rng.randint(0, 25) for _ in range(3)], rng.randint(0, 40), rng.random(), rng.random(), seed
    got, want = sampling.matched_counts(*case), an_exchange_at_a_time(*case)
    assert mismatch(got, *case[1:5]) <= mismatch(want, *case[1:5]) + 1e-8
    assert sum(got.values()) == sum(want.values()) and all(0 < n <= pool[v] for v, n in got.items())


def test_matched_counts_of_many_vectors():
    rng = random.Random(3)
    pool = {v: rng.randint(1, 50) for v in itertools.product((0, 1), repeat=12)}
    began = time.time()
    got = sampling.matched_counts(pool, [300 + 10 * k for k in range(12)], 900, 0.3, 0.6)
    assert sum(got.values()) == 900 and time.time() - began < 60
    assert sampling.matched_counts({}, [1], 3, 0.5, 0.5) == {}
