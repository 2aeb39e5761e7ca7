"""Record-at-a-time statements of the policies, to test against on small inputs."""

from __future__ import annotations


def sort(lengths: dict[int, int]) -> list[tuple[int, int]]:
    return sorted(lengths.items(), key=lambda e: (e[1], e[0]))


def number(groups: list[list[int]]) -> dict[int, tuple[int, int]]:
    return {seq: (b, p) for b, group in enumerate(groups) for p, seq in enumerate(group)}


def capacity(lengths: dict[int, int], limit: int) -> dict[int, tuple[int, int]]:
    groups: list[list[int]] = []
    for seq, length in sort(lengths):
        if groups and (len(groups[-1]) + 1) * length <= limit:
            groups[-1].append(seq)
        else:
            groups.append([seq])
    return number(groups)


def difference(lengths: dict[int, int], diff: int, size: int) -> dict[int, tuple[int, int]]:
    groups: list[list[int]] = []
    for seq, length in sort(lengths):
        if groups and len(groups[-1]) < size and length - lengths[groups[-1][0]] <= diff:
            groups[-1].append(seq)
        else:
            groups.append([seq])
    return number(groups)


def fixed(lengths: dict[int, int], size: int, smart: bool) -> dict[int, tuple[int, int]]:
    order = [seq for seq, _ in sort(lengths)] if smart else sorted(lengths)
    return {seq: (i // size, i % size) for i, seq in enumerate(order)}


def max_length(lengths: dict[int, int], most: int, size: int, smart: bool):
    order = [seq for seq, _ in sort(lengths)] if smart else sorted(lengths)
    out, at = {}, 0
    for seq in order:
        length = lengths[seq]
        parts = [length] if length <= most else [min(most, length - i) for i in range(0, length, most)]
        for chunk, part in enumerate(parts):
            out[seq, chunk] = (at // size, at % size, part)
            at += 1
    return out
