"""Bins of the packing plan against the fewest possible ones of small cases, found by trying all."""

import random
from collections import Counter

from trajecta.llm.packing import plan_bins


def fewest(sizes, capacity):
    """The least number of bins, by depth-first search over the fill of open bins."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, open_bins):
        if len(open_bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(open_bins)
            return
        for fill in {f for f in open_bins if f + sizes[k] <= capacity}:
            rest = list(open_bins)
            rest[rest.index(fill)] += sizes[k]
            place(k + 1, rest)
        place(k + 1, [*open_bins, sizes[k]])

    place(0, [])
    return best[0]


def bins_of(sizes, capacity):
    """Bins of the plan, each with the (offset, size) of its items; every item has one place."""
    counts = Counter(sizes)
    segments = sorted(plan_bins(dict(counts), capacity))
    bins, placed = {}, Counter()
    for k, (size, first, first_bin, offset) in enumerate(segments):
        upto = segments[k + 1][1] if k + 1 < len(segments) and segments[k + 1][0] == size else counts[size]
        for j in range(upto - first):
            bins.setdefault(first_bin + j, []).append((offset, size))
            placed[size] += 1
    assert placed == counts
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    return bins


def test_small_cases_are_near_the_optimum():
    rnd, worse, n = random.Random(7), 0, 400
    for _ in range(n):
        capacity = rnd.choice([7, 12, 20])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randrange(1, 9))]
        got, want = len(bins_of(sizes, capacity)), fewest(sizes, capacity)
        assert want <= got <= want + 1, (sizes, capacity)
        worse += got > want
    assert worse <= n // 20


def test_at_most_two_large_items_a_bin():
    rnd = random.Random(8)
    sizes = [rnd.randint(1, 2048) for _ in range(3000)]
    bins = bins_of(sizes, 2048)
    assert all(sum(3 * s > 2048 for _, s in own) <= 2 for own in bins.values())
    assert len(bins) <= 1.03 * -(-sum(sizes) // 2048) + 1
