"""Encoding texts unit by unit: what stands between single spaces is encoded once and remembered.

A byte-level BPE with the usual word expression never joins two words across a space that has no white space beside
it, so a text is the sequence of its units: the first as it stands, each other one with the space before it. Encoding
every distinct unit once and joining the results is exact, and far cheaper than encoding every occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Distinct units that an encoder remembers before it starts afresh; bounds its memory.
REMEMBERED = 800_000
#: Longer units are not remembered.
LONG_UNIT = 64

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
#: Matches units whose words the usual expression tells apart alike: letters and marks, and such again after a line's
#: end. Its groups are the words.
plain_words = re.compile(f"( ?{_LETTERS})({_MARKS})(?:(\n)({_LETTERS})({_MARKS}))?").fullmatch


class UnitEncoder:
    """Texts to little-endian 32-bit ids; encode_units encodes strings independently of each other."""

    def __init__(self, encode_units: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self._encode_units = encode_units
        self._remembered = remembered
        self._known: dict[str, bytes] = {}
        self._firsts: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Encodes units that follow a space; returns those that must not be remembered."""
        if len(self._known) + len(units) > self._remembered:
            self._known.clear()
        passing = {}
        for u, ids in zip(units, self._encode_units([" " + u for u in units]), strict=True):
            if len(u) > LONG_UNIT or not u or len(u.strip()) < len(u):
                passing[u] = ids
            else:
                self._known[u] = ids
        return passing

    def _first_units(self, units: list[str]) -> list[bytes]:
        new = list({u for u in units if u not in self._firsts})
        found = dict(zip(new, self._encode_units(new), strict=True))
        out = [self._firsts.get(u) or found.get(u, b"") for u in units]
        if len(self._firsts) + len(found) > self._remembered // 8:
            self._firsts.clear()
        self._firsts.update((u, ids) for u, ids in found.items() if len(u) <= LONG_UNIT)
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out = []
        at = 0
        while at < len(batch):
            size, to = 0, at
            while to < len(batch) and (to == at or size + len(batch[to]) <= 1 << 20):
                size += len(batch[to])
                to += 1
            out += self._some(batch[at:to])
            at = to
        return out

    def _some(self, batch: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in batch]
        heads, rests = [u[0] for u in split], [u[1:] for u in split]
        firsts, known = self._first_units(heads), self._known
        some = set().union(*rests)
        new = some.difference(known)
        # None of these is known: white space stands beside the space, so the text is cut where no other touches it.
        odd = {u for u in new if not u or u[0].isspace() or u[-1].isspace()}
        cut = [k for k, (head, rest) in enumerate(zip(heads, rests, strict=True)) if head == "" and rest or head[-1:].isspace() or odd and not odd.isdisjoint(rest)]
        for k in cut:
            head, *rests[k] = _BETWEEN.split(batch[k])
            firsts[k] = self._encode_units([head])[0]
        some = some.difference(odd).union(*(rests[k] for k in cut))
        new = some.difference(known)
        passing = self._learn(list(some if len(known) + len(new) > self._remembered else new))
        # The block's own units in a small table: most occurrences are read from the processor's cache.
        own = {u: known[u] for u in some if u in known} | passing
        return [first + b"".join(map(own.__getitem__, rest)) for first, rest in zip(firsts, rests, strict=True)]
