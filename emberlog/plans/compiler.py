"""Rule text (YAML) to a Ruleset."""

from __future__ import annotations

import re
from collections.abc import Iterable

import yaml

from . import condition as cond
from .ir import ANY_FIELD, Correlation, Dropped, Primitive, Rule, Ruleset


class RuleError(ValueError):
    pass


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 scalars: only true and false are booleans, and dates stay text."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

# What a field's suffixes mean.
MATCH_TYPES = {"contains": "contains", "startswith": "startswith", "endswith": "endswith", "re": "regex", "range": "range", "cidr": "cidr", "fuzzy": "fuzzy"}
MODIFIERS = {"cased": "case_sensitive", "base64": "base64_decode", "base64offset": "base64_offset_decode", "utf16": "utf16_decode", "utf16le": "utf16le_decode", "utf16be": "utf16be_decode", "wide": "wide_decode"}
GATE = "__logsource_gate"


class FieldMapping:
    """Names of fields in rules to names in events."""

    def __init__(self, mapping: dict[str, str] | None = None, taxonomy: str = "sigma"):
        self._map, self.taxonomy = dict(mapping or {}), taxonomy

    def add(self, source: str, target: str) -> None:
        self._map[source] = target

    def load(self, mapping: dict[str, str]) -> None:
        self._map.update(mapping)

    def has(self, name: str) -> bool:
        return name in self._map

    def get(self, name: str) -> str:
        return self._map.get(name, name)

    def mappings(self) -> dict[str, str]:
        return dict(self._map)


def parse_field(spec: str) -> tuple[str, str, tuple[str, ...]]:
    """field|suffix|... to (field, match type, modifiers); the last match type wins."""
    name, *suffixes = spec.split("|")
    kinds = [MATCH_TYPES[s] for s in suffixes if s in MATCH_TYPES]
    return name, kinds[-1] if kinds else "equals", tuple(MODIFIERS.get(s, s) for s in suffixes if s not in MATCH_TYPES)


def scalar(v) -> str | None:
    """The text of a scalar; None for what isn't one."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return v
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)
    return None


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_DURATION = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+")


def duration(text: str) -> float:
    """Seconds of "1h30m" or, for a bare integer, of minutes; days aren't known."""
    t = text.strip()
    if not t or t in ("0", "+0", "-0"):
        return 0.0
    if _DURATION.fullmatch(t):
        total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", t))
        return -total if t[0] == "-" else total
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t) * 60.0
    raise RuleError(f"invalid duration {text!r}")


def _int(v) -> int:
    if isinstance(v, bool):
        return 0
    if isinstance(v, (int, float)):
        return int(v)
    return int(v) if isinstance(v, str) and re.fullmatch(r"[+-]?\d+", v) else 0


def _text(doc: dict, key: str) -> str:
    return doc[key] if isinstance(doc.get(key), str) else ""


class RuleCompiler:
    """Compiles documents one after another into one Ruleset."""

    def __init__(self, mapping: FieldMapping | None = None):
        self.mapping, self.ruleset, self._next = mapping or FieldMapping(), Ruleset(), 1

    def add(self, text: str) -> int | None:
        """Compiles every document of a stream; the last rule's number."""
        try:
            docs = [d for d in yaml.load_all(text, _Loader) if d]
        except yaml.YAMLError as e:
            raise RuleError(f"not YAML: {e}") from e
        if not docs:
            raise RuleError("empty YAML")
        last = None
        for doc in docs:
            if not isinstance(doc, dict):
                raise RuleError("a document must be a mapping")
            if "detection" in doc:
                last = self._rule(doc)
            elif "correlation" in doc:
                self._correlation(doc)
        return last

    def _rule_id(self, doc: dict) -> int:
        v = doc.get("id")
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return int(v) & 0xFFFFFFFF
        if isinstance(v, str) and re.fullmatch(r"[0-9]+", v) and int(v) < 1 << 32:
            return int(v)
        self._next += 1
        return self._next - 1

    def _primitive(self, name: str, match_type: str, values: Iterable[str], modifiers: tuple[str, ...] = ()) -> int:
        return self.ruleset.intern(Primitive(name, match_type, tuple(values), modifiers))

    def _mapping(self, m: dict) -> list[int]:
        """Primitives of a mapping; all must hold."""
        out = []
        for spec, value in m.items():
            name, kind, modifiers = parse_field(str(spec))
            if isinstance(value, list):
                values = [t for t in map(scalar, value) if t is not None]
                if not values:
                    continue
            else:
                one = scalar(value)
                if one is None:
                    raise RuleError(f"unsupported value of field {spec!r}")
                values = [one]
            out.append(self._primitive(self.mapping.get(name), kind, values, modifiers))
        return out

    def _rule(self, doc: dict) -> int:
        detection = doc["detection"]
        rule_id = self._rule_id(doc)
        if not isinstance(detection, dict):
            raise RuleError("detection must be a mapping")
        selections: dict[str, list[int]] = {}
        alternatives: dict[str, list[list[int]]] = {}
        for name, value in detection.items():
            if name == "condition":
                continue
            if isinstance(value, dict):
                selections[name] = self._mapping(value)
            elif isinstance(value, list):
                groups = []
                for item in value:
                    if isinstance(item, dict):
                        groups.append(self._mapping(item))
                    elif (t := scalar(item)) is not None:
                        groups.append([self._primitive(ANY_FIELD, "equals", [t])])
                groups = [g for g in groups if g]
                if groups:
                    selections.setdefault(name, [])
                    alternatives[name] = groups
        text = detection.get("condition")
        if not isinstance(text, str):
            raise RuleError("missing or invalid condition")
        source = doc.get("logsource")
        if isinstance(source, dict) and re.match(r"(?i)not(?:[ (]|$)", text.strip()):
            gate = [self._primitive(f"event.{k}", "equals", [source[k]]) for k in ("product", "category", "service") if isinstance(source.get(k), str) and source[k]]
            if gate:
                selections[GATE] = gate
                text = f"{GATE} and ({text})"
        uid = doc.get("id")
        self.ruleset.rules.append(Rule(rule_id, text, selections, alternatives, "" if uid is None else scalar(uid) or str(uid), *(_text(doc, k) for k in ("name", "title", "level", "description"))))
        return rule_id

    def _correlation(self, doc: dict) -> None:
        c = doc["correlation"]
        if not isinstance(c, dict):
            raise RuleError("correlation must be a mapping")
        if not isinstance(c.get("type"), str):
            raise RuleError("correlation.type is required")
        strings = lambda v: [x for x in v if isinstance(x, str) and x] if isinstance(v, list) else []
        group = c["group-by"] if isinstance(c.get("group-by"), list) else c.get("group_by")
        out = Correlation(_text(doc, "name"), c["type"], strings(c.get("rules")), strings(group), title=_text(doc, "title"), level=_text(doc, "level"), description=_text(doc, "description"), rule_uid="" if doc.get("id") is None else str(doc["id"]))
        if isinstance(c.get("timespan"), str):
            out.timespan_s = duration(c["timespan"])
        if isinstance(c.get("condition"), dict) and out.type.lower() == "value_count":
            out.vc_field = _text(c["condition"], "field")
            out.vc_gte = _int(c["condition"].get("gte"))
        self.ruleset.correlations.append(out)


def compile_rules(texts: Iterable[str], mapping: FieldMapping | None = None, skip_bad: bool = False) -> Ruleset:
    """Compiles rule texts.  With ``skip_bad`` a text that fails is reported in ``dropped``, else it raises."""
    compiler = RuleCompiler(mapping)
    for i, text in enumerate(texts):
        try:
            compiler.add(text)
        except RuleError as e:
            if not skip_bad:
                raise
            compiler.ruleset.dropped.append(Dropped(f"text {i}", str(e)))
    return compiler.ruleset


def usable(ruleset: Ruleset) -> tuple[list[tuple[Rule, tuple]], list[Dropped]]:
    """Rules with their trees, the last of equal numbers, and those dropped for their condition."""
    good: dict[int, tuple[Rule, tuple]] = {}
    bad = list(ruleset.dropped)
    for rule in ruleset.rules:
        try:
            tree = cond.parse(rule.condition, {*rule.selections, *rule.disjunctions})
            cond.fold(tree, rule, lambda p: True, all, any, lambda x: not x)
        except cond.ConditionError as e:
            bad.append(Dropped(rule.key, str(e)))
            continue
        good[rule.rule_id] = (rule, tree)
    return list(good.values()), bad
