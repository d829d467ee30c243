"""Sorted suffix runs: front coding, and a loser tree that merges runs without comparing known common prefixes again."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

#: (suffix, left context, context hash, how often the context occurs)
Entry = tuple[bytes, bytes, int, int]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in their first ``known`` bytes."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return n if not differ else ((differ & -differ).bit_length() - 1) // 8


def front_coded(entries: Iterable[Entry]) -> bytes:
    """A sorted run: each suffix as the length it shares with the one before, and the rest."""
    out, before = [], b""
    for suffix, left, context, n in entries:
        shared = common_prefix(before, suffix)
        out += [struct.pack("<HHHqq", shared, len(suffix) - shared, len(left), context, n), suffix[shared:], left]
        before = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """(length shared with the entry before, entry), one at a time."""
    at, before, size = 0, b"", struct.calcsize("<HHHqq")
    while at < len(run):
        shared, rest, left, context, n = struct.unpack_from("<HHHqq", run, at)
        at += size
        before = before[:shared] + run[at : at + rest]
        at += rest
        yield shared, (before, run[at : at + left], context, n)
        at += left


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries of sorted runs in order, each with the length it shares with the entry before it.

    Every waiting head knows how much it shares with the last winner. Of two heads the one that shares more is smaller,
    without a look at its bytes; with equal lengths the comparison starts behind them, and the loser keeps what it shares
    with the winner, which is what the next round needs.
    """
    sources = [decoded(r) for r in runs]
    heads: list[tuple[int, Entry] | None] = [next(s, None) for s in sources]
    k = len(sources)
    if not k:
        return
    shares = [0] * k

    def smaller(a: int, b: int) -> int:
        """The winner of two heads; the loser's shared length is set to what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return b if x is None else a
        if shares[a] != shares[b]:
            return a if shares[a] > shares[b] else b
        p, q = x[1][0], y[1][0]
        n = common_prefix(p, q, shares[a])
        if p[n : n + 1] <= q[n : n + 1]:
            shares[b] = n
            return a
        shares[a] = n
        return b

    losers = [-1] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won = smaller(a, b)
        losers[node] = b if won == a else a
        return won

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        yield shares[winner], heads[winner][1]
        heads[winner] = next(sources[winner], None)
        if heads[winner] is not None:
            shares[winner] = heads[winner][0]
        node = (winner + k) // 2
        while node:
            other = losers[node]
            won = smaller(winner, other)
            if won == other:
                losers[node] = winner
            winner = won
            node //= 2
