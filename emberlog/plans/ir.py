"""What rules compile to, before they become columns or joins."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace

#: A primitive with this field looks at every scalar of the event.
ANY_FIELD = "*any*"


@dataclass(frozen=True)
class Primitive:
    """One field against values; values are alternatives."""

    field: str
    match_type: str = "equals"
    values: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()

    @property
    def any_field(self) -> bool:
        return self.field == ANY_FIELD


@dataclass
class Rule:
    rule_id: int
    condition: str
    selections: dict[str, list[int]] = field(default_factory=dict)
    disjunctions: dict[str, list[list[int]]] = field(default_factory=dict)
    rule_uid: str = ""
    name: str = ""
    title: str = ""
    level: str = ""
    description: str = ""

    @property
    def key(self) -> str:
        """The durable identity: the rule's own id, else one from its number."""
        return self.rule_uid or f"rid-{self.rule_id}"


@dataclass
class Correlation:
    name: str
    type: str
    rules: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    timespan_s: float = 0.0
    vc_field: str = ""
    vc_gte: int | None = None
    title: str = ""
    level: str = ""
    description: str = ""
    rule_uid: str = ""


@dataclass
class Dropped:
    """A rule that can't be evaluated, and why."""

    key: str
    reason: str


@dataclass
class Ruleset:
    primitives: list[Primitive] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    correlations: list[Correlation] = field(default_factory=list)
    dropped: list[Dropped] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._ids = {p: i for i, p in enumerate(self.primitives)}

    def intern(self, p: Primitive) -> int:
        """The primitive's number; equal primitives share one."""
        if p not in self._ids:
            self._ids[p] = len(self.primitives)
            self.primitives.append(p)
        return self._ids[p]

    def clone(self) -> Ruleset:
        return copy.deepcopy(self)

    def contains(self, rule_id: int) -> bool:
        return any(r.rule_id == rule_id for r in self.rules)

    def fields(self) -> list[str]:
        """Fields that the rules look at: all that a scan has to extract."""
        return sorted({p.field for p in self.primitives if not p.any_field and p.field})


@dataclass(frozen=True)
class EngineConfig:
    """Presets of an engine; ``mode`` "reference" keeps the rule dialect's quirks, "spec" follows the rule standard."""

    batch_size: int = 100
    strategy: str = "adaptive"
    parallel: bool = True
    prefilter: bool = True
    max_memory_bytes: int = 512 << 20
    mode: str = "reference"
    #: Rules up to this number become one projection; larger rulesets are searched for.
    projection_rules: int = 100

    @classmethod
    def production(cls) -> EngineConfig:
        return cls(batch_size=1000, strategy="production", max_memory_bytes=1 << 30)

    @classmethod
    def development(cls) -> EngineConfig:
        return cls(batch_size=10, strategy="development", parallel=False, prefilter=False, max_memory_bytes=64 << 20)

    def with_(self, **changes) -> EngineConfig:
        return replace(self, **changes)


def complexity(operations: int, depth: int, primitives: int) -> str:
    """Simple, Medium or Complex."""
    if operations <= 3 and depth <= 2:
        return "Simple"
    return "Complex" if operations > 8 or depth > 4 or primitives > 10 else "Medium"


def recommended_strategy(level: str) -> str:
    return "production" if level == "Simple" else "adaptive"
