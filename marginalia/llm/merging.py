"""Byte-pair merging on ragged numpy arrays.

A batch of symbol sequences is one flat array of symbol ids and an array of lengths.  In each round every
sequence applies its own pair of lowest rank, all sequences at once.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.int64(1) << 62


class MergeTable:
    """Pairs of symbols that may merge: (left id, right id) -> (rank, merged id).

    ``safe[m]`` tells that no pair holding the merged symbol ``m`` outranks (or ties with) ``m`` itself.  Then all
    occurrences of the pair can be merged in one round; otherwise only the leftmost, as the reference order
    (lowest rank, then leftmost) asks.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, n_symbols: int):
        key = left.astype(np.int64) * n_symbols + right
        order = np.argsort(key, kind="stable")
        self.n, self.key, self.rank, self.merged = n_symbols, key[order], rank[order].astype(np.int64), merged[order].astype(np.int64)
        own = np.full(n_symbols, NO_RANK)
        np.minimum.at(own, merged, rank)
        worst = np.full(n_symbols, np.int64(-1))
        np.maximum.at(worst, merged, rank)
        used = np.full(n_symbols, NO_RANK)
        np.minimum.at(used, left, rank)
        np.minimum.at(used, right, rank)
        values, counts = np.unique(rank[np.unique(merged, return_index=True)[1]], return_counts=True)
        ties = set(values[counts > 1].tolist())
        self.safe = (used > own) & (own == worst)
        if ties:
            self.safe &= ~np.isin(own, list(ties))
        #: Half-full open-addressing table of the keys: few probes per lookup.
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(key)) * 2.5))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        todo, step = np.arange(len(self.key)), 0
        while len(todo):
            at = (self._slot(self.key[todo]) + step) & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo = todo[self.slots[at] != todo]
            step += 1
        self.probes = max(1, step)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, -1 where there is none."""
        key = left * self.n + right
        found, slot = np.full(len(key), -1, np.int64), self._slot(key)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for step in range(self.probes):
            at = self.slots[(slot[todo] + step) & ((1 << self.bits) - 1)]
            hit = (at >= 0) & (self.key[at] == key[todo])
            found[todo[hit]] = at[hit]
            todo = todo[~hit & (at >= 0)]
            if not len(todo):
                break
        return found


#: Symbols above which a sequence's places are held by rank, since a round over all of it would cost its length.
LONG = 256


def merge_batch(table: MergeTable, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges every sequence to its end; returns the surviving symbols and their number per sequence.

    Symbols below zero never merge.  In each round every sequence applies its own pair of lowest rank, at all its places
    at once where that gives the same as one after the other.  Sequences up to ``LONG`` symbols go side by side in one
    array; longer ones each keep lists of places (``merge_ranks``): the same rounds, in another layout.
    """
    lengths = lengths.astype(np.int64)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        short = np.ones(len(lengths), bool)
        short[long] = False
        keep = np.repeat(short, lengths)
        part, size = merge_batch(table, flat[keep], lengths[short])
        out_len = np.zeros(len(lengths), np.int64)
        out_len[short] = size
        done = {i: merge_ranks(table, flat[bounds[i] : bounds[i + 1]]) for i in long}
        for i, x in done.items():
            out_len[i] = len(x)
        out = np.empty(out_len.sum(), np.int64)
        out[np.repeat(short, out_len)] = part
        at = np.concatenate(([0], np.cumsum(out_len)))
        for i, x in done.items():
            out[at[i] : at[i + 1]] = x
        return out, out_len

    flat, owner = flat.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    pair = np.full(len(flat), -1, np.int64)
    if len(flat) > 1:
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair[same] = table.find(flat[same], flat[same + 1])
    active = np.arange(len(flat))  # positions of live symbols of sequences that still merge
    symbols, done_sym, done_own = flat, [], []
    seq, pr = owner, pair
    while len(symbols):
        rank = np.where(pr >= 0, table.rank[np.maximum(pr, 0)], NO_RANK)
        first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.concatenate((first, [len(seq)])))
        alive = np.repeat(best < NO_RANK, size)
        if not alive.all():
            done_sym.append(symbols[~alive])
            done_own.append(seq[~alive])
            symbols, seq, pr, rank = symbols[alive], seq[alive], pr[alive], rank[alive]
            size, best = size[best < NO_RANK], best[best < NO_RANK]
            if not len(symbols):
                break
        hit = rank == np.repeat(best, size)
        at = np.flatnonzero(hit)
        safe = table.safe[table.merged[pr[at]]]
        new_seq = np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))
        # within a run of touching hits every second one merges, counted from the run's start
        run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])))
        run_start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = np.where(safe, (np.arange(len(at)) - run_start) % 2 == 0, new_seq)
        at = at[take]
        symbols = symbols.copy()
        symbols[at] = table.merged[pr[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        symbols, seq, pr, changed = symbols[keep], seq[keep], pr[keep], changed[keep]
        redo = changed.copy()
        redo[:-1] |= changed[1:]
        redo = np.flatnonzero(redo)
        has_next = redo[redo + 1 < len(symbols)]
        has_next = has_next[seq[has_next] == seq[has_next + 1]]
        pr = pr.copy()
        pr[redo] = -1
        pr[has_next] = table.find(symbols[has_next], symbols[has_next + 1])
    del active
    out = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    own = np.concatenate(done_own) if done_own else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    return out[order], np.bincount(own, minlength=len(lengths)).astype(np.int64)


def merge_ranks(table: MergeTable, symbols: np.ndarray) -> np.ndarray:
    """One long sequence, rank by rank: the places of each rank are held in lists, so that a round costs what it merges.

    A round takes all places of the lowest rank from left to right.  Where a merge makes a pair of the same or a lower
    rank, the round ends with it, and that pair comes next.
    """
    n = len(symbols)
    sym = np.append(symbols.astype(np.int64), -1)  # a symbol beyond the end, which merges with nothing
    nxt, prv, live = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
    nxt[n] = n
    pair = np.full(n + 1, -1, np.int64)
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def add(rank: int, at: np.ndarray) -> None:
        if rank not in places:
            places[rank] = []
            heapq.heappush(ranks, rank)
        places[rank].append(at)

    def enter(at: np.ndarray) -> None:
        """Looks up the pairs that begin at these places."""
        pair[at] = table.find(sym[at], sym[nxt[at]])
        at = at[pair[at] >= 0]
        rank = table.rank[pair[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))) if len(at) else []
        for part in np.split(at, first[1:]) if len(at) else ():
            add(int(table.rank[pair[part[0]]]), part)

    enter(np.arange(n))
    while ranks:
        rank = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(rank)))
        at = at[live[at] & (pair[at] >= 0)]
        at = at[table.rank[pair[at]] == rank]
        if not len(at):
            continue
        # of places that touch, every second one from the first of them
        apart = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
        start = np.maximum.accumulate(np.where(apart, np.arange(len(at)), 0))
        take = at[(np.arange(len(at)) - start) % 2 == 0]
        made, right = table.merged[pair[take]], nxt[nxt[take]]
        left = np.where(prv[take] >= 0, sym[prv[take]], -1)
        beside = np.flatnonzero(right[:-1] == take[1:]) + 1  # what is on their left will have merged before
        left[beside] = made[beside - 1]
        low = np.zeros(len(take), bool)
        for f in (table.find(left, made), table.find(made, sym[right])):
            low |= (f >= 0) & (table.rank[np.maximum(f, 0)] <= rank)
        if low.any():
            stop = int(np.argmax(low)) + 1
            add(rank, at[at > take[stop - 1]])
            take, made, right = take[:stop], made[:stop], right[:stop]
        gone = nxt[take]
        live[gone] = False
        sym[take], nxt[take], prv[right] = made, right, take
        before = prv[take]
        enter(np.unique(np.concatenate((take, before[before >= 0]))))
    return sym[:n][live[:n]]
