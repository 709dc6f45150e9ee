"""Bin completion: branch and bound over the fillings around the largest item.

Items are a multiset of lengths. Each node takes the largest item left and enumerates the
undominated fillings of the room beside it, of any number of items, in order of waste. A branch is cut when its waste
exceeds what a solution better than the incumbent could afford. The first incumbent is best-fit decreasing; the search stops at
a lower bound, when it has seen all branches, or after a given number of steps, and returns the best solution so far.

A filling is lengths with multiplicities, enumerated on a stack with a level for each distinct length: bins of thousands of short
items are as shallow as those of a few long ones. Sets of lengths are the bits of one integer: "which a and t - a are both there" is one
shift and one AND.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Bin = tuple[int, ...]


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[Bin]:
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    bins: list[list[int]] = []
    open_ = 0
    for n in np.sort(lengths)[::-1].tolist():
        fits = open_ >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        room[left - n].append(b)
        open_ |= 1 << (left - n)
    return [tuple(b) for b in bins]


Runs = tuple[tuple[int, int], ...]  # a filling: lengths in descending order, each with how many of it


def _spread(sums: int, n: int, times: int) -> int:
    """The sums with 0 to `times` items of length n more."""
    done = 0
    while done < times:
        step = min(done + 1, times - done)
        sums |= sums << (n * step)
        done += step
    return sums


class _Search:
    """The items left, and the fillings that they allow."""

    def __init__(self, lengths: np.ndarray, capacity: int, steps: int) -> None:
        self.counts, self.capacity, self.steps = np.bincount(lengths, minlength=capacity + 1).tolist(), capacity, steps
        self.volume = int(lengths.sum())
        self.there = sum(1 << n for n, c in enumerate(self.counts) if c)
        self.mirror = sum(1 << (capacity - n) for n, c in enumerate(self.counts) if c)  # bit capacity - n for length n

    def take(self, n: int, times: int = 1) -> None:
        self.counts[n] -= times
        self.volume -= n * times
        if not self.counts[n]:
            self.there ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)

    def put(self, n: int, times: int = 1) -> None:
        if not self.counts[n]:
            self.there ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)
        self.counts[n] += times
        self.volume += n * times

    def all_left(self) -> Runs:
        out, there = [], self.there
        while there:
            n = there.bit_length() - 1
            out.append((n, self.counts[n]))
            there ^= 1 << n
        return tuple(out)

    def _short(self, total: int, most: int, least: int) -> Iterator[Runs]:
        """Fillings of one (if least is 1) or two items, of `most` at most each, that add up to total."""
        if least <= 1 and total <= most and self.counts[total]:
            yield ((total, 1),)
        both = self.there & (self.mirror >> (self.capacity - total)) & ((2 << max(min(most, total - 1), 0)) - 1)
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a < b:
                break
            if a > b:
                yield (a, 1), (b, 1)
            elif self.counts[a] > 1:
                yield ((a, 2),)
            both ^= 1 << a

    def _leads(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Lengths and multiplicities that fillings of three items or more can begin with."""
        lead = self.there & ((2 << max(min(most, total), 0)) - 1)
        while lead and self.steps > 0:
            a = lead.bit_length() - 1
            if 3 * a < total:  # only then can all items up to this length fail to add up to the total
                volume, below = 0, lead
                while below and volume < total:
                    n = below.bit_length() - 1
                    volume += n * self.counts[n]
                    below ^= 1 << n
                if volume < total:
                    return
            for times in range(min(self.counts[a], total // a), 0, -1):
                self.steps -= 1
                if self.steps <= 0:
                    return
                yield a, times
            lead ^= 1 << a

    def exact(self, total: int) -> Iterator[Runs]:
        """All multisets of items left that add up to total. The stack holds a level for each distinct length of a filling, however many items it has."""
        chosen: list[tuple[int, int]] = []
        yield from self._short(total, total, 1)
        stack = [(total, self._leads(total, total))]
        while stack:
            left, leads = stack[-1]
            lead = next(leads, None)
            if lead is None:
                stack.pop()
                if chosen:
                    chosen.pop()
                continue
            a, times = lead
            rest = left - a * times
            head = (*chosen, lead)
            if not rest:
                if times >= 3:  # one or two items are short, and listed where the level began
                    yield head
                continue
            for more in self._short(rest, a - 1, 2 if times == 1 else 1):
                yield (*head, *more)
            if a > 1:
                chosen.append(lead)
                stack.append((rest, self._leads(rest, a - 1)))

    def dominated(self, filling: Runs, waste: int) -> bool:
        """Whether an item left could take the place of none, one or several of the filling's within the waste: the
        filling with that item leaves no worse items over."""
        for n, times in filling:
            self.take(n, times)
        near, reach = self.there, 0  # bit s: an item of length s to s + reach is left
        while reach < waste:
            step = min(reach + 1, waste - reach)
            near |= near >> step
            reach += step
        above = near if not waste else 0  # the same for s + 1 to s + waste
        if waste:
            above, reach = self.there >> 1, 0
            while reach < waste - 1:
                step = min(reach + 1, waste - 1 - reach)
                above |= above >> step
                reach += step
        for n, times in filling:
            self.put(n, times)
        one = several = 0  # sums of single items, and of two or more
        for n, times in filling:
            several = _spread(several, n, times) | _spread(one << n, n, times - 1) | (_spread(1 << 2 * n, n, times - 2) if times > 1 else 0)
            one |= 1 << n
        return bool(several & near) or bool(waste and (one | 1) & above)

    def fillings(self, room: int, most_waste: int) -> Iterator[tuple[Runs, int]]:
        """Undominated fillings of the room beside the largest item, and their waste, by increasing waste."""
        if self.volume <= room:
            yield self.all_left(), room - self.volume
            return
        if not self.there & ((2 << room) - 1):
            yield (), room
            return
        for waste in range(min(room - 1, most_waste) + 1):
            for filling in self.exact(room - waste):
                if not self.dominated(filling, waste):
                    yield filling, waste
            if self.steps <= 0:
                return


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """For each k: items over capacity - k are alone, those over half don't meet, and the volume of
    items from k up that the latter leave no room for needs bins of its own. The largest over all k."""
    count = np.bincount(lengths, minlength=capacity + 1)
    n, v = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    alone = n[-1] - n[capacity - k + 1]
    large, large_volume = n[capacity - k + 1] - n[half + 1], v[capacity - k + 1] - v[half + 1]
    over = (v[half + 1] - v[k]) - (large * capacity - large_volume)
    return int((alone + large + np.maximum(0, -(-over // capacity))).max())


def bin_completion(lengths: np.ndarray, capacity: int, steps: int = 200_000) -> list[Bin]:
    """Bins as tuples of lengths. Lengths are 1 to capacity. steps is the only limit of the search: nodes visited and leads tried."""
    incumbent = best_fit_decreasing(lengths, capacity)
    volume, bound = int(lengths.sum()), lower_bound(lengths, capacity)
    if len(incumbent) <= bound:
        return incumbent
    search = _Search(lengths, capacity, steps)
    path: list[Runs] = []  # bins filled so far, the largest item first
    waste: list[int] = [0]
    best: list[Runs] | None = None
    most = len(incumbent)

    def affordable() -> int:
        return (most - 1) * capacity - volume - waste[-1]

    def node() -> tuple[int, Iterator[tuple[Runs, int]]]:
        top = search.there.bit_length() - 1
        search.take(top)
        return top, search.fillings(capacity - top, affordable())

    open_ = [node()]
    while open_ and search.steps > 0:
        if len(path) == len(open_):  # back from below: undo the filling
            for n, times in path.pop()[1:]:
                search.put(n, times)
            waste.pop()
        top, options = open_[-1]
        filling, lost = next(options, (None, 0))
        search.steps -= 1
        if filling is None or lost > affordable():
            search.put(top)
            open_.pop()
            continue
        for n, times in filling:
            search.take(n, times)
        path.append(((top, 1), *filling))
        waste.append(waste[-1] + lost)
        if search.there:
            open_.append(node())
        elif len(path) < most:
            best, most = list(path), len(path)
            if most <= bound:
                break
    return incumbent if best is None else [tuple(n for n, times in runs for _ in range(times)) for runs in best]


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how much of each bin is used."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = np.flatnonzero(lengths == capacity)
    bin_of[whole] = np.arange(len(whole))
    rest = np.flatnonzero(lengths < capacity)
    bins = bin_completion(lengths[rest], capacity) if len(rest) else []
    order = rest[np.argsort(lengths[rest], kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(lengths[rest], minlength=capacity + 1))])[:-1].tolist()
    for b, items in enumerate(bins, len(whole)):
        used = 0
        for n in items:
            i = order[at[n]]
            at[n] += 1
            bin_of[i], offset[i] = b, used
            used += n
    return bin_of, offset, np.array([capacity] * len(whole) + [sum(b) for b in bins], np.int64)
