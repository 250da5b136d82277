"""Strings of a minimum length that occur more than once, from a Burrows-Wheeler transform by threshold-bounded interval expansion."""

from __future__ import annotations

import numpy as np

#: A byte that UTF-8 never uses; it ends every segment and sorts after all text.
END = 0xFF


def suffixes(data: np.ndarray, depth: int, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All positions of data in the order of the `depth` bytes from there on, at least; the data's end counts as END bytes. And for each
    place in that order whether fewer than `known` bytes (8 * a power of two) are shared with the one before it."""
    n = len(data)
    padded = np.concatenate([data, np.full(8, END, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : n + j]
    order = np.argsort(key)
    first = np.r_[True, key[order[1:]] != key[order[:-1]]] if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # where each group of equal keys begins in the order
    rank = np.empty(n, np.int64)
    rank[order] = begin
    done, apart = 8, first.copy()
    while done < depth:
        tied = ~first | np.r_[~first[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = order[at]
        ahead = pos + done
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n)
        key = rank[pos].astype(np.uint64) << np.uint64(32) | nxt.astype(np.uint64)
        by = np.argsort(key)
        key, pos = key[by], pos[by]
        order[at] = pos
        new = np.r_[True, key[1:] != key[:-1]]
        first[at] |= new
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[pos] = begin
        done *= 2
        if done <= known:
            apart = first.copy()
    return order, apart


def boundaries(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place in it whether fewer than `length` bytes are shared with the one before it, wherever the bytes
    on one side at least hold no END.

    Breadth-first over strings by length: the interval of a string is extended backwards by every byte that precedes one of its rows.
    A new interval whose upper edge has no value yet gives that edge the length of the string without its last byte, and lives on;
    edges without a value after `length` rounds have at least that many bytes in common. Strings never contain END. The rounds begin
    with all strings of the most bytes that the doubling of the sort passes on its way. A string of one row ends there: whatever it is
    extended to has one row too, and so edges on both sides.
    """
    n = len(data)
    known = max((8 << i for i in range(24) if 8 << i <= length), default=0)
    order, apart = suffixes(data, length, known)
    before = data[order - 1]
    before[order == 0] = END
    back = np.empty(n, np.int64)  # row of the suffix one byte longer
    by_byte = np.argsort(before, kind="stable")
    back[by_byte] = np.arange(n)
    head = data[order]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    low, high = np.array([0]), np.array([n])
    lone: list[tuple[np.ndarray, int]] = []  # positions of strings of one row, and their length
    stops = np.flatnonzero(data == END)
    if known:
        edge[:n] |= apart
        low = np.flatnonzero(apart)
        high = np.r_[low[1:], n][: len(low)]
        at = order[low]
        whole = np.r_[stops, n][np.searchsorted(stops, at)] - at >= known
        low, high = low[whole], high[whole]
        one = high - low == 1
        lone.append((order[low[one]], known))
        low, high = low[~one], high[~one]
    for done in range(known, length):
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        live = before[rows] != END
        to = np.sort(back[rows[live]].astype(np.uint64) << np.uint64(32) | owner[live].astype(np.uint64))
        if not len(to):
            break
        row, owner = (to >> np.uint64(32)).astype(np.int64), to & np.uint64(0xFFFFFFFF)
        byte = head[row]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1] + 1) | (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])])
        new_low = row[starts]
        new_high = row[np.r_[starts[1:], len(row)] - 1] + 1
        one = new_high - new_low == 1
        lone.append((order[new_low[one]], done + 1))
        open_edge = ~edge[new_high]
        edge[new_high] = True
        low, high = new_low[open_edge & ~one], new_high[open_edge & ~one]
        if not len(low):
            break
    # a lone string of l bytes makes the length - l longer ones that end with it lone, as far as its segment goes
    change = np.zeros(n + 1, np.int64)
    for at, size in lone:
        begin = np.r_[-1, stops][np.searchsorted(stops, at)] + 1
        np.add.at(change, np.maximum(begin, at - (length - size)), 1)
        np.add.at(change, at + 1, -1)
    alone = np.cumsum(change[:n])[order] > 0
    edge[:n] |= alone
    edge[1:] |= alone
    return order, edge[:n]


def later_copies(data: np.ndarray, owned: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Of the owned positions, those whose `length` bytes also start at an owned position of smaller rank. All owned positions have
    that many bytes before the next END. Equal strings never share a rank."""
    order, edge = boundaries(data, length)
    number = np.cumsum(edge)
    mark = np.zeros(len(data), bool)
    mark[owned] = True
    at = order[mark[order]]  # owned positions, in the order of suffixes
    of = np.full(len(data), -1, np.int64)
    of[owned] = rank
    cls = number[mark[order]]
    if not len(at):
        return at
    starts = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    ranks = of[at]
    least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.r_[starts, len(at)]))
    return np.sort(at[ranks > least])
