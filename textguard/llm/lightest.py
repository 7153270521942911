"""Knuth's lightest derivations on a chain: an agenda of weighted deduction items.

An item (i, s, t) says: from place i in state s, a derivation reaches the end of the chain in state t. Its
weight is (cost, audit). The rule for an edge (cost c, letters w) from (i, s) to (j, q), j >= i, is

    (j, q, t) with (cost, audit)  ->  (i, s, t) with (c + cost, w + audit)

Items are popped by (cost, places derived, audit) and are final when popped first. The rule is superior in
that order: c >= 0, an edge of cost 0 derives more places (an edge within a place must cost), and
of audits at one item the lesser stays the lesser behind the same letters.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

#: An edge against the direction of the chain: (cost, letters, place before, state before).
Edge = tuple[int, str, int, int]


def derive(places: int, ends: Iterable[int], back: Callable[[int, int], Iterable[Edge]],
           goal: tuple[int, int] | None = None) -> dict[tuple[int, int], tuple[int, str, int]]:
    """Lightest (cost, audit, state at the end) of the items that reach a state of ``ends``: of every (place, state), or
    until ``goal`` is popped. ``back(i, s)`` gives the edges that lead into (i, s)."""
    agenda = [(0, 0, "", places, t, t) for t in ends]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple[int, str, int]] = {}
    while agenda:
        cost, _, audit, i, s, t = heapq.heappop(agenda)
        if (i, s) in final:
            continue
        final[i, s] = (cost, audit, t)
        if (i, s) == goal:
            break
        for c, letters, j, q in back(i, s):
            if (j, q) not in final:
                heapq.heappush(agenda, (cost + c, places - j, letters + audit, j, q, t))
    return final
