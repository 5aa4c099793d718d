"""External induced sorting of all suffixes of a symbol sequence, with common-prefix values.

Suffixes are sorted by induction (as in SA-IS / eSAIS): the leftmost S-type suffixes are put
in order by sorting their substrings the same way, naming them, and sorting the sequence of
names recursively; from them one pass upwards induces the L-type and one pass downwards the
S-type suffixes. Both passes take suffixes from a monotone priority queue keyed by first
symbol and order of arrival: what a pass adds never sorts before what it has taken. The queue
keeps a bounded number of tuples (suffix, common prefix with its predecessor in the queue) in
memory and the rest on disk; a symbol's tuples are worked in blocks of arrays.

Common-prefix values are carried through both passes: neighbours that were induced from
suffixes i and j share one symbol more than the least value between i and j. They are capped
at ``cap``; beyond that depth, and beyond ``rest`` (symbols left in a suffix's own segment),
the order of suffixes is not defined.

Spill files belong to one task, in a folder that goes with it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 16


class SuffixQueue:
    """Tuples (suffix, common prefix) by first symbol, in order of arrival; spills the largest symbols."""

    def __init__(self, folder: str, name: str, memory: int):
        self.base, self.memory, self.held = os.path.join(folder, name), memory, 0
        self.live: dict[int, list[np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.spilled: dict[int, list[str]] = {}
        self.files = 0

    def add(self, symbol: int, suffix: np.ndarray, common: np.ndarray) -> None:
        rec = np.empty(len(suffix), [("s", "<i8"), ("c", "u1")])
        rec["s"], rec["c"] = suffix, common
        self.live.setdefault(symbol, []).append(rec)
        self.size[symbol] = self.size.get(symbol, 0) + rec.nbytes
        self.held += rec.nbytes
        while self.held > self.memory and self.size:
            self._spill(max(self.size, key=self.size.get))

    def _spill(self, symbol: int) -> None:
        path = f"{self.base}-{self.files}.npy"
        self.files += 1
        np.save(path, np.concatenate(self.live.pop(symbol)))
        self.spilled.setdefault(symbol, []).append(path)
        self.held -= self.size.pop(symbol)

    def symbols(self) -> set[int]:
        return set(self.live) | set(self.spilled)

    def take(self, symbol: int, backwards: bool = False, keep: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of a symbol's tuples in order of arrival, or from the last to the first."""
        files, live = self.spilled.get(symbol, []), self.live.get(symbol, [])
        if not keep:
            self.spilled.pop(symbol, None)
            self.live.pop(symbol, None)
            self.held -= self.size.pop(symbol, 0)
        parts: list = [*files, *([np.concatenate(live)] if live else [])]      # few blocks, not many pieces
        for part in reversed(parts) if backwards else parts:
            rec = np.load(part, mmap_mode="r") if isinstance(part, str) else part
            starts = range(0, len(rec), BLOCK)
            for lo in reversed(starts) if backwards else starts:
                b = np.array(rec[lo:lo + BLOCK])
                yield b["s"].copy(), b["c"].copy()
            if isinstance(part, str) and not keep:
                os.remove(part)


class _Pass:
    """One pass: sends predecessors of the taken suffixes to the queue, with common prefixes."""

    def __init__(self, queue: SuffixQueue, text: np.ndarray, cap: int, rest: np.ndarray | None):
        self.queue, self.text, self.cap, self.rest = queue, text, cap, rest
        self.since: dict[int, int] = {}     # least value since a symbol's last tuple
        self.least = cap                    # least value of this pass so far, to bring `since` up to date
        self.stamp: dict[int, int] = {}
        self.floor: list[int] = []

    def send(self, suffix: np.ndarray, common: np.ndarray, wanted: np.ndarray) -> None:
        """``wanted``: which predecessors belong to this pass. ``common``: with the suffix taken before."""
        whole = int(common.min(initial=self.cap))
        at = np.flatnonzero(wanted)
        sym = self.text[suffix[at] - 1]
        order = np.argsort(sym, kind="stable")
        sym, at = sym[order], at[order]
        bounds = np.flatnonzero(np.append(True, sym[1:] != sym[:-1])) if len(sym) else []
        ends = np.append(bounds[1:], len(sym)) if len(sym) else []
        hit = set()
        for a, z in zip(bounds, ends, strict=True):
            c, idx = int(sym[a]), at[a:z]
            hit.add(c)
            # least value in (previous tuple's source, this one's source]
            cut = np.concatenate([[0], idx + 1])
            low = np.minimum.reduceat(np.append(common, self.cap), cut)
            new = low[:-1].astype(np.int64)
            new[0] = min(int(new[0]), self.since.get(c, 0))
            if c not in self.since:
                new[0] = -1
            self.since[c] = int(low[-1]) if idx[-1] + 1 < len(common) else self.cap
            target = suffix[idx] - 1
            value = np.minimum(new + 1, self.cap)
            if self.rest is not None:
                value = np.minimum(value, self.rest[target])
            self.queue.add(c, target, value.astype(np.uint8))
        for c in self.since:
            if c not in hit and self.since[c] > whole:
                self.since[c] = whole


def _common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a:a + cap], text[b:b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def induce(text: np.ndarray, s_type: np.ndarray, seeds: Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]],
           symbols: list[int], folder: str, memory: int, cap: int, rest: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, in blocks (suffix, common prefix with the next smaller).

    ``seeds(symbol)`` gives the sorted leftmost S-type suffixes of a symbol. ``symbols`` are
    those that occur, in ascending order.
    """
    lq, done = SuffixQueue(folder, "l", memory), SuffixQueue(folder, "done", memory)
    up = _Pass(lq, text, cap, rest)

    def wanted_l(x: np.ndarray) -> np.ndarray:
        return (x > 0) & ~s_type[np.maximum(x - 1, 0)]

    for c in symbols:
        first = True
        while c in lq.live or c in lq.spilled:      # equal symbols come back to their own queue
            for x, v in lq.take(c):
                if first:
                    v[0] = 0
                    first = False
                done.add(c, x, v)
                up.send(x, v, wanted_l(x))
        for x, v in seeds(c):
            if first:
                v = v.copy()
                v[0] = 0
                first = False
            elif len(x) and not getattr(up, "in_seeds", None) == c:
                v = v.copy()        # the last L-type and the first S-type suffix of a symbol
                v[0] = _common(text, _last(done, c), int(x[0]), cap)
            up.in_seeds = c
            up.send(x, v, wanted_l(x))
    sq = SuffixQueue(folder, "s", memory)
    down = _Pass(sq, text, cap, rest)

    def wanted_s(x: np.ndarray) -> np.ndarray:
        return (x > 0) & s_type[np.maximum(x - 1, 0)]

    # downwards a tuple's value is shared with the larger neighbour, taken just before
    for c in reversed(symbols):
        last = None
        while c in sq.live or c in sq.spilled:
            for x, v in sq.take(c):
                if last is None:
                    v[0] = 0
                last = int(x[-1])
                down.send(x, v, wanted_s(x))
                yield x, v
        carry = None        # L-type values were made upwards: move each to the tuple taken next
        for x, v in done.take(c, backwards=True):
            x, v = x[::-1], v[::-1]
            head = 0 if last is None and carry is None else carry if carry is not None else _common(text, last, int(x[0]), cap)
            w = np.concatenate([[head], v[:-1]]).astype(np.uint8)
            carry = int(v[-1])
            down.send(x, w, wanted_s(x))
            yield x, w
    # nothing follows the last suffix, so nothing induces it; it is the smallest and stands alone
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)


def _last(q: SuffixQueue, c: int) -> int:
    if c in q.live:
        return int(q.live[c][-1]["s"][-1])
    return int(np.load(q.spilled[c][-1], mmap_mode="r")["s"][-1])


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next suffix. The last one is S-type."""
    last = np.flatnonzero(text[:-1] != text[1:])        # the last place of each run of equal symbols
    runs = np.diff(np.concatenate([[-1], last, [len(text) - 1]]))
    return np.repeat(np.append(text[last] < text[last + 1], True), runs)


def _by_symbol(order: np.ndarray, common: np.ndarray, text: np.ndarray) -> Callable:
    sym = text[order]

    def seeds(c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, z = np.searchsorted(sym, [c, c + 1])
        for lo in range(a, z, BLOCK):
            yield order[lo:min(z, lo + BLOCK)], common[lo:min(z, lo + BLOCK)]
    return seeds


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a sequence that fits in memory, right to ``depth`` names."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:-k or None] = rank[k:] + 1 if k < n else 0
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key)     # equal keys have one rank, in whatever order
        step = np.append(0, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _adjacent(text: np.ndarray, order: np.ndarray, cap: int, rest: np.ndarray | None) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before it, 0 for the first."""
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    a, b = order[1:], order[:-1]
    for d in range(cap):        # the last symbol occurs once, so no pair runs over the end together
        same = text[np.minimum(a + d, len(text) - 1)] == text[np.minimum(b + d, len(text) - 1)]
        open_, a, b = open_[same], a[same], b[same]
        if not len(open_):
            break
        out[open_] = d + 1
    if rest is not None and len(order):
        out[1:] = np.minimum(out[1:], np.minimum(rest[order[1:]], rest[order[:-1]]))
    return out.astype(np.uint8)


def sorted_suffixes(text: np.ndarray, folder: str, cap: int, memory: int = 64 << 20, base: int = 1 << 22,
                    rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest: blocks (suffix, common prefix with the larger neighbour).

    The last symbol must occur once and be the smallest. ``memory`` bounds what a queue holds
    in memory; name sequences of up to ``base`` names are sorted in memory, longer ones by
    recursion.
    """
    s_type = types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    symbols = np.unique(text).tolist()
    if len(lms) > 1:
        # sort the substrings: induce from the leftmost S-type suffixes in order of the text
        rough = np.argsort(text[lms], kind="stable")
        # a symbol's seeds have no order yet, so no common prefix either
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        found = [x[is_lms[x]] for x, _ in induce(text, s_type, _by_symbol(lms[rough], np.zeros(len(lms), np.uint8), text),
                                                 symbols, folder, memory, cap, None)]
        order = np.concatenate(found)[::-1]
        nth = np.empty(len(text), np.int32)
        nth[lms] = np.arange(len(lms), dtype=np.int32)
        at = nth[order]
        name = _names(text, lms, order, at)
        if name.max() + 1 == len(lms):
            lms_order = order
        else:
            reduced = np.empty(len(lms), np.int64)
            reduced[at] = name
            if len(reduced) <= base:
                sub = _doubling(reduced, cap)
            else:
                inner = os.path.join(folder, "r")
                os.makedirs(inner)
                # no rest at this level; the last name stands for the last symbol and is unique
                sub = np.concatenate([x for x, _ in sorted_suffixes(reduced, inner, cap, memory, base)])[::-1]
            lms_order = lms[sub]
    else:
        lms_order = lms
    seeds = _by_symbol(lms_order, _adjacent(text, lms_order, cap, rest), text)
    yield from induce(text, s_type, seeds, symbols, folder, memory, cap, rest)


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Name of each substring in ``order``, number ``at`` of ``lms``: its rank among the distinct ones."""
    size = np.append(np.diff(lms) + 1, 1)[at]
    new = np.ones(len(order), np.int64)
    new[0] = 0
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    d = 0
    while len(same):
        fit = size[same] > d
        new[same[~fit]] = 0
        same = same[fit]
        same = same[text[order[same] + d] == text[order[same - 1] + d]]
        d += 1
    return np.cumsum(new)
