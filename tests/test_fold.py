"""The fold over length classes against greedy planning record by record."""

from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

import naive
from batchloom.plans.fold import NO_LIMIT, GreedyFold

lengths_of = st.lists(st.integers(0, 40), max_size=60)


def expand(classes, fold):
    """(batch, pos) per record of ``classes`` (length, count, cap), in order."""
    out = []
    for length, count, cap in classes:
        batch, filled, room, cap = fold.run(length, count, cap)
        for r in range(count):
            if r < room:
                out.append((batch, filled + r))
            else:
                out.append((batch + 1 + (r - room) // cap, (r - room) % cap))
    return out


@settings(max_examples=1500, deadline=None)
@given(lengths_of, st.integers(1, 60))
def test_capacity(lengths, limit):
    by_seq = dict(enumerate(sorted(lengths)))
    cap = lambda n: max(limit // n, 1) if n else NO_LIMIT
    classes = [
        (max(group), len(group), c)
        for c, group in ((c, list(g)) for c, g in groupby(sorted(lengths), key=cap))
    ]
    expected = naive.capacity(by_seq, limit)
    assert expand(classes, GreedyFold()) == [expected[i] for i in range(len(lengths))]


@settings(max_examples=1500, deadline=None)
@given(lengths_of, st.integers(0, 12), st.integers(1, 9))
def test_difference(lengths, diff, size):
    by_seq = dict(enumerate(sorted(lengths)))
    classes = [(n, len(list(g)), size) for n, g in groupby(sorted(lengths))]
    expected = naive.difference(by_seq, diff, size)
    assert expand(classes, GreedyFold(diff)) == [expected[i] for i in range(len(lengths))]


def test_classes_of_a_capacity_are_few():
    for limit in (10, 4000, 12000, 1_000_000):
        assert len({max(limit // n, 1) for n in range(1, limit + 5)}) + 1 <= 2 * limit**0.5 + 2
