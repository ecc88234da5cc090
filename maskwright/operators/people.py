"""The distinct people of a scope, kept up to date as names come in.

Of names that may be one person's, the first in order of rank (seeded ones, then fuller names, then
smaller numbers) represents them all: a name is kept if no kept name before it is the same person's.
Two names are the same person's only if two parts of one line up with two of the other, so every name is
filed under its pairs of parts, and a new name meets those alone that share a pair; what follows from it
being kept or not is settled among its neighbours, in order of rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import combinations

from ..functions import names as N


def referent_score(known: tuple[str, ...], other: tuple[str, ...]) -> int:
    """How many parts of one skeleton line up with parts of another, full parts before initials, each used once."""
    free, score = list(known), 0
    for part in sorted(other, key=lambda p: len(p) <= 1):
        hit = next((k for k in free if (k.startswith(part) if len(part) <= 1 else N.stem_match(k, part))), None)
        if hit is not None:
            free.remove(hit)
            score += 1
    return score


def same_person(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return referent_score(a, b) >= 2 or referent_score(b, a) >= 2


def stems(part: str) -> list[str]:
    """Any two parts that have one stem have one of these in common: the shorter part itself."""
    return [part[:n] for n in range(max(4, len(part) - 3), len(part))] + [part]


def _pairs(marks: list[list[str]]) -> set[tuple[str, str]]:
    return {(x, y) if x < y else (y, x) for a, b in combinations(marks, 2) for x in a for y in b}


def offered(bones: tuple[str, ...]) -> set[tuple[str, str]]:
    """The pairs under which a known name is found: each part by its stems or, for an initial, by its letter."""
    return _pairs([[f"~{p[0]}", *stems(p)] for p in bones])


def asked(bones: tuple[str, ...]) -> set[tuple[str, str]]:
    """The pairs of which a known name offers at least one, if it lines up with this one in two parts."""
    return _pairs([[f"~{p}"] if len(p) <= 1 else stems(p) for p in bones])


class People:
    def __init__(self) -> None:
        self.bones: dict[str, tuple[str, ...]] = {}
        self.rank: dict[str, tuple] = {}
        self.kept: set[str] = set()
        self._offered: dict[tuple[str, str], set[str]] = {}
        self._asked: dict[tuple[str, str], set[str]] = {}
        self._stems: dict[str, set[str]] = {}  # of kept names
        self._came: dict[str, int] = {}

    def put(self, token: str, name: str | None, seeded: bool, number: int) -> None:
        """A name that is new, has changed, or (None) is no person's any more."""
        bones = N.skeleton(name) if name is not None else ()
        rank = (not seeded, -len(bones), number, self._came.setdefault(token, len(self._came)))
        if self.bones.get(token, ()) == bones and (not bones or self.rank[token] == rank):
            return
        due = self._drop(token) if token in self.bones else set()
        if bones:
            self.bones[token], self.rank[token] = bones, rank
            for index, pairs in ((self._offered, offered(bones)), (self._asked, asked(bones))):
                for pair in pairs:
                    index.setdefault(pair, set()).add(token)
            due.add(token)
        self._settle(due)

    def _drop(self, token: str) -> set[str]:
        later = {t for t in self.same_as(token) if self.rank[t] > self.rank[token]}
        self._keep(token, False)
        for index, pairs in ((self._offered, offered(self.bones[token])), (self._asked, asked(self.bones[token]))):
            for pair in pairs:
                index[pair].discard(token)
        del self.bones[token], self.rank[token]
        return later

    def _keep(self, token: str, kept: bool) -> None:
        (self.kept.add if kept else self.kept.discard)(token)
        for p in self.bones[token]:
            for s in stems(p):
                held = self._stems.setdefault(s, set())
                (held.add if kept else held.discard)(token)

    def same_as(self, token: str) -> set[str]:
        bones = self.bones[token]
        some = set().union(*(self._offered.get(p, ()) for p in asked(bones)), *(self._asked.get(p, ()) for p in offered(bones)))
        return {t for t in some if t != token and same_person(self.bones[t], bones)}

    def _settle(self, due: Iterable[str]) -> None:
        """Whether each is kept, and then those after it whom that concerns."""
        heap = [(self.rank[t], t) for t in due]
        heapq.heapify(heap)
        while heap:
            rank, token = heapq.heappop(heap)
            near = self.same_as(token)
            kept = not any(t in self.kept and self.rank[t] < rank for t in near)
            if kept != (token in self.kept):
                self._keep(token, kept)
                for t in near:
                    if self.rank[t] > rank:
                        heapq.heappush(heap, (self.rank[t], t))

    def ranked(self) -> list[str]:
        return sorted(self.kept, key=self.rank.__getitem__)

    def fitting(self, bones: tuple[str, ...]) -> list[str]:
        """Kept names of which two parts line up with these."""
        some = set().union(*(self._offered.get(p, ()) for p in asked(bones)))
        return sorted((t for t in some if t in self.kept and referent_score(self.bones[t], bones) >= 2), key=self.rank.__getitem__)

    def with_part(self, bone: str) -> set[str]:
        """Kept names that have a part of this stem."""
        some = set().union(*(self._stems.get(s, ()) for s in stems(bone)))
        return {t for t in some if any(N.stem_match(p, bone) for p in self.bones[t])} if bone else set()
