"""Extension points: match types, transforms, field extractors and compile hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..plans.ir import Primitive
from . import predicates, transforms

#: Estimated share of events that a match type lets through; orders cheap, selective tests first.
SELECTIVITY = {"equals": 0.1, "exact": 0.1, "contains": 0.3, "startswith": 0.2, "endswith": 0.2, "regex": 0.4, "cidr": 0.15, "range": 0.25, "fuzzy": 0.5}
PHASES = ("discovery", "pre", "post")


@dataclass
class HookContext:
    """What a hook sees of a primitive."""

    primitive: Primitive
    literals: tuple[str, ...]
    selectivity: float
    literal_only: bool


@dataclass
class FilterReport:
    """Which filter structures the rules' literals would suit; statistics only, as plans need no automata."""

    multi_pattern: list[str] = field(default_factory=list)
    sorted_set: list[str] = field(default_factory=list)
    exact_set: list[str] = field(default_factory=list)
    membership: list[str] = field(default_factory=list)
    selectivity: dict[str, float] = field(default_factory=dict)
    frequency: dict[str, int] = field(default_factory=dict)
    fields: dict[str, int] = field(default_factory=dict)

    def ordered(self) -> list[str]:
        """Literals by falling frequency, then rising selectivity."""
        return sorted(self.frequency, key=lambda v: (-self.frequency[v], self.selectivity[v], v))

    def at_most(self, share: float) -> list[str]:
        return sorted(v for v, s in self.selectivity.items() if s <= share)

    def summary(self) -> dict:
        s = self.selectivity.values()
        return {"patterns": len(self.frequency), "avg_selectivity": sum(s) / len(s) if s else 0.0, "most_frequent_field": max(sorted(self.fields), key=self.fields.get, default="")}


class Registry:
    """Names are looked up without regard to case.  A match type is a function (column, values, modifiers) -> boolean column."""

    def __init__(self, comprehensive: bool = True, advanced: bool = False):
        self.matchers = dict(predicates.MATCHERS) | (predicates.ADVANCED if advanced else {})
        self.transforms = dict(transforms.TRANSFORMS if comprehensive else transforms.DEFAULTS)
        self.extractor: Callable[[str], Column] | None = None
        self._hooks: dict[str, list[Callable[[HookContext], None]]] = {p: [] for p in PHASES}

    def register_match(self, name: str, f: predicates.Matcher) -> Registry:
        self.matchers[name.lower()] = f
        return self

    def register_modifier(self, name: str, f: transforms.Transform) -> Registry:
        self.transforms[name.lower()] = f
        return self

    def with_extractor(self, f: Callable[[str], Column]) -> Registry:
        self.extractor = f
        return self

    def hook(self, phase: str, f: Callable[[HookContext], None]) -> Registry:
        if phase not in self._hooks:
            raise KeyError(phase)
        self._hooks[phase].append(f)
        return self

    def matcher(self, kind: str, strict: bool = False) -> predicates.Matcher:
        """The function of a match type; an unknown one is exact, or an error if ``strict``."""
        found = self.matchers.get(kind.lower())
        if found is None and strict:
            raise KeyError(f"unknown match type {kind!r}")
        return found or predicates.equals

    def context(self, p: Primitive) -> HookContext:
        literal = p.match_type in ("equals", "exact", "contains", "startswith", "endswith") and all(predicates.is_literal(v, True) for v in p.values)
        return HookContext(p, p.values if literal else (), SELECTIVITY.get(p.match_type, 0.5), literal)

    def run_hooks(self, phase: str, p: Primitive) -> None:
        """An error in a hook ends the compilation."""
        for f in self._hooks[phase]:
            f(self.context(p))

    def filters(self, primitives: list[Primitive]) -> FilterReport:
        out = FilterReport()
        for p in primitives:
            c = self.context(p)
            out.fields[p.field] = out.fields.get(p.field, 0) + 1
            for v in c.literals:
                out.frequency[v] = out.frequency.get(v, 0) + 1
                out.selectivity[v] = min(c.selectivity, out.selectivity.get(v, 1.0))
        values = sorted(out.frequency)
        out.multi_pattern = values
        out.sorted_set = [v for v in values if out.selectivity[v] < 0.3]
        out.exact_set = [v for v in values if out.selectivity[v] <= 0.1]
        out.membership = [v for v in values if out.selectivity[v] < 0.5]
        return out
