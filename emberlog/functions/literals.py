"""Many literals against many values at once: what a large ruleset needs instead of one test for each literal.

Literals of a field are one Aho-Corasick automaton, so a value is read once however many rules look at it; whole values
are looked up in a table.  What was found in a value is remembered, as events repeat most of theirs.  Rules are then
counted over their clauses.  All of it is built once a worker from a ``Plan``, which is data only.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .predicates import address

#: Values whose hits a worker remembers, and the longest of them.
REMEMBERED, SHORT = 200_000, 512


@dataclass
class Plan:
    """Literals by field number, and clauses in disjunctive form, of a ruleset."""

    name: str
    #: (primitive, field, kind, text): kinds equals, cased, contains, startswith, endswith; texts in lower case but for cased.
    literals: list[tuple[int, int, str, str]] = field(default_factory=list)
    #: (primitive, field, network): a value may be an address in it.
    networks: list[tuple[int, int, str]] = field(default_factory=list)
    #: (primitive, parts): the primitive holds for a value in which all the parts were found; parts have numbers below 0.
    alls: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    #: (rule, clause, primitive, negated)
    clauses: list[tuple[int, int, int, bool]] = field(default_factory=list)


def automaton(words: dict[str, object]) -> Callable[[str], Iterable[tuple[int, object]]]:
    """A function from a text to (index of a match's last character, value) for all matches, overlapping ones too."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: ((i + len(w) - 1, v) for w, v in words.items() for i in _places(text, w))
    found = ahocorasick.Automaton()
    for w, v in words.items():
        found.add_word(w, v)
    found.make_automaton()
    return found.iter


def _places(text: str, word: str) -> Iterable[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


class Search:
    """A plan made ready to run."""

    def __init__(self, plan: Plan):
        self.whole: dict[tuple[int, str], list[int]] = {}
        self.cased: dict[tuple[int, str], list[int]] = {}
        self.always: dict[int, list[int]] = {}
        parts: dict[int, dict[str, tuple[int, list[int], list[int], list[int]]]] = {}
        for pid, f, kind, text in plan.literals:
            if kind == "equals":
                self.whole.setdefault((f, text), []).append(pid)
            elif kind == "cased":
                self.cased.setdefault((f, text), []).append(pid)
            elif not text:
                self.always.setdefault(f, []).append(pid)
            else:
                entry = parts.setdefault(f, {}).setdefault(text, (len(text), [], [], []))
                entry[{"contains": 1, "startswith": 2, "endswith": 3}[kind]].append(pid)
        self.parts = {f: automaton(words) for f, words in parts.items()}
        self.alls: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for pid, pieces in plan.alls:
            self.alls.setdefault(pieces[0], []).append((pid, frozenset(pieces)))
        #: by field and (version, prefix length): networks by their leading bits
        self.networks: dict[int, dict[tuple[int, int], dict[int, list[int]]]] = {}
        for pid, f, text in plan.networks:
            net = ipaddress.ip_network(text)
            by = self.networks.setdefault(f, {}).setdefault((net.version, net.max_prefixlen - net.prefixlen), {})
            by.setdefault(int(net.network_address) >> (net.max_prefixlen - net.prefixlen), []).append(pid)
        number: dict[tuple[int, int], int] = {}
        self.rule: list[int] = []
        self.need: list[int] = []
        self.wants: dict[int, list[int]] = {}
        self.forbids: dict[int, list[int]] = {}
        for rule, clause, pid, negated in plan.clauses:
            c = number.setdefault((rule, clause), len(number))
            if c == len(self.rule):
                self.rule.append(rule)
                self.need.append(0)
            if negated:
                self.forbids.setdefault(pid, []).append(c)
            else:
                self.need[c] += 1
                self.wants.setdefault(pid, []).append(c)
        self.known: dict[tuple[int, str], tuple[int, ...]] = {}

    def in_value(self, f: int, value: str, low: str) -> tuple[int, ...]:
        """Primitives whose literals a value holds as they ask for."""
        seen = self.known.get((f, value))
        if seen is not None:
            return seen
        out = {*self.always.get(f, ()), *self.whole.get((f, low), ()), *self.cased.get((f, value), ())}
        find = self.parts.get(f)
        if find is not None and low:
            last = len(low) - 1
            for end, (n, anywhere, first, at_end) in find(low):
                out.update(anywhere)
                if first and end == n - 1:
                    out.update(first)
                if at_end and end == last:
                    out.update(at_end)
        for part in [x for x in out if x < 0]:
            out.update(pid for pid, pieces in self.alls.get(part, ()) if pieces <= out)
        nets = self.networks.get(f)
        at = address(value) if nets else None
        if at is not None:
            for (version, shift), by in nets.items():
                if version == at.version:
                    out.update(by.get(int(at) >> shift, ()))
        hits = tuple(x for x in out if x >= 0)
        if len(value) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[f, value] = hits
        return hits

    def matched(self, hits: set[int]) -> set[int]:
        """Rules of which a clause has all that it wants and nothing that it forbids."""
        have: dict[int, int] = {}
        for p in hits:
            for c in self.wants.get(p, ()):
                have[c] = have.get(c, 0) + 1
        full = [c for c, n in have.items() if n == self.need[c]]
        if not full:
            return set()
        bad = {c for p in hits for c in self.forbids.get(p, ())}
        return {self.rule[c] for c in full if c not in bad}


_READY: dict[str, Search] = {}


def ready(plan: Plan) -> Search:
    """This worker's search for a plan; the last few are kept."""
    found = _READY.get(plan.name)
    if found is None:
        if len(_READY) >= 4:
            _READY.clear()
        found = _READY[plan.name] = Search(plan)
    return found
